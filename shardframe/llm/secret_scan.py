"""Secret scans: fixed patterns, and two character Markov models compared by log-likelihood ratio.

One model is trained on labelled random strings, the other on labelled ordinary identifiers. A run of token characters
that no pattern covers is a secret if the random model explains it better than the ordinary one by a margin. The margin
comes from labelled samples that the models were not trained on: over all but a small share of the ordinary ones, and
halfway from there to the random ones if there is a gap.

Defined cases: null text counts as empty (no spans); offsets are code points, end exclusive; each input row gives one row,
repeated rows and null ids included; an empty table gives no rows. Texts are scanned whole. Columns beside doc_id and text
are not read.
"""

from __future__ import annotations

import random
import re
import string
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardframe.llm.common import bounded_sample, texts

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a whole run, as [0-9a-f]+ takes it
#: Runs that the models score: all that are at least this long. The margin alone keeps identifiers out.
LEAST = 16
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
#: Characters of a labelled token of a document that are learnt from.
SAMPLE_CHARS = 64
KINDS = ("assign", "access", "hex", "random")

CHARS = string.ascii_letters + string.digits + "+/_=-"
_index = np.full(256, len(CHARS), np.int64)
_index[np.frombuffer(CHARS.encode(), np.uint8)] = np.arange(len(CHARS))
N = len(CHARS) + 1


def codes(token: str) -> np.ndarray:
    return _index[np.frombuffer(token.encode("ascii", "replace"), np.uint8)]


def contexts(token: str) -> np.ndarray:
    """Index of each character after its two predecessors."""
    c = np.concatenate([[N - 1, N - 1], codes(token)])
    return (c[:-2] * N + c[1:-1]) * N + c[2:]


@dataclass
class MarkovPair:
    """Log-likelihood ratio per character of random over ordinary; a token at or over the margin is a secret."""

    ratio: np.ndarray
    margin: float

    def score(self, token: str) -> float:
        return float(self.ratio[contexts(token)].mean()) if token else -1e9

    def is_secret(self, token: str) -> bool:
        return self.score(token) >= self.margin


def log_model(tokens: Iterable[str], backoff: float = 2.0) -> np.ndarray:
    """Second-order log-probabilities, smoothed towards the first-order ones, and those towards even chances."""
    counts = np.zeros(N * N * N)
    for t in tokens:
        np.add.at(counts, contexts(t), 1.0)
    second = counts.reshape(N, N, N)
    first = second.sum(0) + backoff / N
    first /= first.sum(1, keepdims=True)
    second = second + backoff * first[None, :, :]
    return np.log(second / second.sum(2, keepdims=True)).ravel()


def train(labelled: Iterable[tuple[str, int]], false_alarms: float = 0.001, missed: float = 0.01) -> MarkovPair:
    """From (token, 1 for random or 0 for ordinary). At most the share false_alarms of the ordinary samples that are held out
    is over the margin; it rises above that towards the score under which the share missed of the random ones is."""
    labelled = sorted(set(labelled))
    held = labelled[::5]  # for the margin
    fit = [x for i, x in enumerate(labelled) if i % 5]
    ratio = log_model(t for t, y in fit if y) - log_model(t for t, y in fit if not y)
    pair = MarkovPair(ratio, 0.0)
    ordinary = sorted(pair.score(t) for t, y in held if not y and len(t) >= LEAST)
    keys = sorted(pair.score(t) for t, y in held if y and len(t) >= LEAST)
    if ordinary:
        pair.margin = ordinary[min(len(ordinary) - 1, int(len(ordinary) * (1 - false_alarms)))] + 1e-9
        if keys:
            pair.margin = max(pair.margin, (pair.margin + keys[int(len(keys) * missed)]) / 2)
    return pair


def random_strings(n: int, seed: int) -> list[str]:
    """Labelled samples of the random kind: keys as services deal them out, drawn evenly from their alphabets."""
    rng = random.Random(seed)
    alphabets = [string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", "0123456789abcdef", string.ascii_lowercase + string.digits, string.ascii_uppercase + string.digits, string.ascii_letters + string.digits + "_-"]
    return ["".join(rng.choices(alphabets[i % len(alphabets)], k=rng.randint(16, 64))) for i in range(n)]


#: Words that identifiers are made of.
WORDS = "get set is has to from with by id name value key list map item index count size user file path data type node page url http api test config version date time max min start end new old add remove update delete create read write open close error message request response server client host port token session cache table column row query result total number first last next prev input output image video text string array object class function method module package example com org net www html json xml".split()


def ordinary_identifiers(n: int, seed: int) -> list[str]:
    """Labelled samples of the ordinary kind: names as programs and addresses have them."""
    rng = random.Random(seed)
    found = []
    for _ in range(n):
        w = rng.choices(WORDS, k=rng.randint(2, 5))
        shape = rng.randrange(6)
        name = ["_".join(w), "-".join(w), w[0] + "".join(x.title() for x in w[1:]), "/".join(w), "_".join(w).upper(), "".join(x.title() for x in w)][shape]
        found.append(name + rng.choice(["", "", str(rng.randrange(10)), str(rng.randrange(1990, 2030)), f"_{rng.randrange(100)}"]))
    return found


#: Folders that paths are made of.
FOLDERS = "usr local lib bin etc var opt home share include python site packages tmp log dev proc src main java resources static assets docs build dist target node modules".split()


#: Beginnings, middles and ends that syllables are made of.
ONSETS = "b bl br c ch d dr f fl g gr h j k kl l m n p pl pr qu r s sch sh sp st t th tr v w z".split()
NUCLEI = "a e i o u y ie ei au ou ea ee io".split()
CODAS = "n r s t l m nd ng nt rt st ch ck gs ss ff ld".split()


def ordinary_runs(n: int, seed: int) -> list[str]:
    """Labelled samples of the ordinary kind that are no names: numbers, dates, rulers, alphabets, paths, versions, UUIDs
    and long words."""
    rng = random.Random(seed)
    found = []
    for i in range(n):
        kind, k, at = i % 8, rng.randint(16, 64), rng.randrange(26)
        digit = rng.choice(["", "", "", str(rng.randrange(10))])
        if kind == 0:
            found.append("".join(rng.choices(string.digits, k=rng.randint(10, 24))))
        elif kind == 1:
            day = f"{rng.randrange(1900, 2100)}-{rng.randrange(1, 13):02d}-{rng.randrange(1, 29):02d}"
            clock = rng.choice(["-", ""]).join(f"{rng.randrange(60):02d}" for _ in range(3))
            found.append(rng.choice([day, day.replace("-", ""), day.replace("-", "/")]) + rng.choice(["T", "_", "-", "/"]) + clock + rng.choice(["", "Z", "Z0"]))
        elif kind == 2:
            found.append(rng.choice(CHARS) * k)
        elif kind == 3:
            run = (rng.choice([string.ascii_lowercase, string.ascii_uppercase, string.digits]) * 4)[at : at + rng.randint(16, 30)]
            found.append(rng.choice([run, run[::-1]]) + digit)
        elif kind == 4:
            found.append(rng.choice(["/", "/", ""]) + "/".join(rng.choices(FOLDERS + WORDS, k=rng.randint(3, 6))) + digit)
        elif kind == 5:
            number = rng.choice(["-", "_"]).join(str(rng.randrange(rng.choice([10, 100]))) for _ in range(rng.randint(2, 4)))
            found.append(rng.choice(WORDS) + rng.choice(["-", "_", "/"]) + rng.choice(["v", "", "release-", "rc"]) + number + rng.choice(["", "-beta", "-alpha1", "-rc2", "-final"]))
        elif kind == 6:
            digits = "".join(rng.choices("0123456789abcdef", k=32))
            found.append("-".join((digits[:8], digits[8:12], digits[12:16], digits[16:20], digits[20:])))
        else:
            word = "".join(rng.choice(ONSETS) + rng.choice(NUCLEI) + rng.choice(CODAS + [""] * 12) for _ in range(rng.randint(5, 12)))
            found.append(rng.choice([word, word.title(), word + digit]))
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns, leftmost and non-overlapping for each kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def uncovered(base: list[tuple[int, int, int]], runs: Iterable[re.Match]) -> Iterator[tuple[int, int]]:
    """The parts of the runs that no span of base touches; both are in order of their starts."""
    covered: list[list[int]] = []
    for s, _, e in base:
        if covered and s <= covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], e)
        else:
            covered.append([s, e])
    k = 0
    for m in runs:
        a, b = m.span()
        while k < len(covered) and covered[k][0] < b:
            s, e = covered[k]
            if a < s:
                yield a, s
            a = max(a, e)
            if e > b:  # it may reach into the next run too
                break
            k += 1
        if a < b:
            yield a, b


def scan(text: str, pair: MarkovPair) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The pattern spans, and the spans that the models add beside them: whole runs, or what pattern spans leave of them."""
    base = base_spans(text)
    added = [(a, 3, b) for a, b in uncovered(base, CANDIDATE.finditer(text)) if b - a >= LEAST and pair.is_secret(text[a:b])]
    return base, added


def corpus_samples(docs: DataFrame, rows: int, seed: int, tokens: int) -> list[tuple[str, int]]:
    """Labelled tokens of a bounded sample of documents: those inside pattern spans are random, words are ordinary. Of a
    token the SAMPLE_CHARS at the end (random) or the beginning (ordinary) are learnt from; scans take whole runs."""

    def label(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: set[tuple[str, int]] = set()
            for text in b.column("text").to_pylist():
                base = base_spans(text)
                found.update((text[s:e][-SAMPLE_CHARS:] if k else ASSIGN.match(text, s)[2][-SAMPLE_CHARS:], 1) for s, k, e in base)
                found.update((m[0][:SAMPLE_CHARS], 0) for m in re.finditer(r"[A-Za-z][A-Za-z_/-]{7,}[0-9]{0,4}(?![A-Za-z0-9+/_=-])", text) if not any(s < m.end() and m.start() < e for s, _, e in base))
            rows = sorted(found)
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in rows], pa.string()), pa.array([y for _, y in rows], pa.int32())], ["token", "label"])

    sample = texts(bounded_sample(docs.select("doc_id", "text"), rows, seed)).mapInArrow(label, "token string, label int").distinct()
    return [(r[0], r[1]) for r in sample.orderBy(F.xxhash64(F.lit(seed), "token"), "token", "label").limit(tokens).collect()]


def fit_models(docs: DataFrame | None = None, sample_rows: int = 1500, sample_tokens: int = 20_000, seed: int = 7) -> MarkovPair:
    """Trained on generated labelled samples and, with docs, on labelled tokens of at most sample_rows documents."""
    labelled = [(t, 1) for t in random_strings(6000, seed)] + [(t, 0) for t in ordinary_identifiers(6000, seed) + ordinary_runs(8000, seed)]
    return train(labelled + (corpus_samples(docs, sample_rows, seed, sample_tokens) if docs is not None else []))


def find_secrets(docs: DataFrame, pair: MarkovPair) -> DataFrame:
    """doc_id and spans, an array of (kind, start, end, text) by start: patterns first where they start together."""
    sent = docs.sparkSession.sparkContext.broadcast(pair)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string())]))

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text in b.column("text").to_pylist():
                base, added = scan(text, sent.value)
                out.append([{"kind": KINDS[k], "start": s, "end": e, "text": text[s:e]} for s, k, e in sorted(base + added)])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, kind)], ["doc_id", "spans"])

    return texts(docs).mapInArrow(find, "doc_id long, spans array<struct<kind:string,start:long,end:long,text:string>>")


def secret_report(docs: DataFrame, pair: MarkovPair) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans: one row for each document."""
    spans = find_secrets(docs, pair)
    base = F.filter("spans", lambda s: s["kind"] != KINDS[3])

    def joined(column):
        return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return spans.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
