"""Substring dedup by fixed-block anchors.

A repeat of ``window`` words covers a whole aligned block of half as many. So the index holds the non-overlapping blocks of
every text, and every rolling window of block length probes it (the exchange deals both by hash; a block is a marked key).
Where probes hit, the anchors are extended: the windows around a hit that hold it are compared over all texts by their own
hash, and runs of neighbouring windows that an earlier document has too are the maximal repeats. What a document repeats
from one with a smaller id is removed.

Documents with one sequence of words are one unit, judged once with its smallest id; its other documents repeat that one.

Defined cases: null text counts as empty: no words; a text shorter than a window repeats nothing; documents with one id do
not repeat each other, a repeated row has the same result; a row with null id neither loses words nor makes others lose
them; an empty table gives no rows. Documents are one unit if the SHA-256 of their words is the same. Words are removed
where 128 bits of hash say so: two independent lanes over the window's words; anchors, which only propose windows, go by
64 bits and sequences of words travel under 64 bits, so a chance collision there can leave a repeat but removes nothing.
Columns beside doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardframe.llm.common import join_groups, partitions_for, texts, written
from shardframe.llm.exchange import REPLY, batches_of, by_home, gathered, order_by, range_of, shared_keys
from shardframe.llm.wordhash import EMPTY, text_hash, window_hashes, word_hashes

#: Of a probe's hash, its range and 32 + 7 bits travel.
UPPER = np.uint64(0x7F)
#: Candidates are sent to every task as a filter up to this many (8 bytes each); beyond it their ids are joined.
SENT_IDS = 1_000_000


def probes_of(found: list[str], block: int, window: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(unit, hashes of its rolling windows of block length, whether one of the hash's windows is aligned) of each text."""
    words, begin = word_hashes([t.encode() for t in found])
    rolling = window_hashes(words, block)
    for a, b in zip(begin[:-1], begin[1:], strict=True):
        if b - a < window:
            yield 0, EMPTY, np.zeros(0, bool)
            continue
        keys, at = np.unique(rolling[a : b - block + 1], return_inverse=True)
        aligned = np.zeros(len(keys), bool)
        aligned[at[::block]] = True
        yield text_hash(words[a:b]), keys, aligned


def units(docs: DataFrame) -> DataFrame:
    """doc_id, mark (a hash of the text as it is), n_words, unit, sha of each row: sha of all its words joined by a space."""

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in batches_of(batches):
            for b in held:
                data = [t.encode() for t in b.column("text").to_pylist()]
                words, begin = word_hashes(data)
                sha = [hashlib.sha256(b" ".join(d.split())).digest() for d in data]
                unit = [text_hash(words[x:y]) for x, y in zip(begin[:-1], begin[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("mark"), pa.array(np.diff(begin), pa.int64()), pa.array(unit, pa.int64()), pa.array(sha, pa.binary())], ["doc_id", "mark", "n_words", "unit", "sha"])

    return texts(docs).withColumn("mark", F.xxhash64("text")).mapInArrow(measure, "doc_id long, mark long, n_words long, unit long, sha binary")


def sent_form(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """A hash as the exchange returns it."""
    return (hashes & np.uint64(0xFFFFFFFF)) | (((hashes >> np.uint64(32)) & UPPER) << np.uint64(32)) | (range_of(hashes, ranges).astype(np.uint64) << np.uint64(48))


def both_lanes(data: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words' hashes, where each text's begin, and the windows' hashes in two lanes: a row for each window."""
    words, begin = word_hashes(data)
    again, _ = word_hashes(data, lane=1)
    return words, begin, np.stack([window_hashes(words, window), window_hashes(again, window)], axis=1)


def by_key(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc and key (two lanes) sorted by key and doc, whether each row is its key's first, and its key's smallest doc."""
    order = np.lexsort((doc, key[:, 1], key[:, 0]))
    doc, key = doc[order], key[order]
    first = np.concatenate([[True], (key[1:] != key[:-1]).any(1)])[: len(key)]
    return doc, key, first, doc[np.flatnonzero(first)][np.cumsum(first) - 1]


def extended(anchored: DataFrame, ranges: int, block: int, window: int) -> DataFrame:
    """doc_id and keys: the hashes of the windows around its anchors that a document with a smaller id has too.

    In a batch a window's smallest document alone asks; the others have their answer."""

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in batches_of(batches):
            docs, keys = [np.zeros(0, np.int64)], [np.zeros((0, 2), np.uint64)]
            for b in held:
                words, begin, large = both_lanes([t.encode() for t in b.column("text").to_pylist()], window)
                small = sent_form(window_hashes(words, block), ranges)
                for doc, unit, anchors, x, y in zip(b.column("doc_id").to_pylist(), b.column("unit").to_pylist(), b.column("keys"), begin[:-1], begin[1:], strict=True):
                    if y - x < window or text_hash(words[x:y]) != unit:
                        continue  # another row with this id
                    hit = np.isin(small[x : y - block + 1], np.frombuffer(anchors.as_buffer(), "<u8"))
                    sums = np.concatenate([[0], np.cumsum(hit)])
                    near = sums[window - block + 1 :] > sums[: y - x - window + 1]
                    own = large[x : y - window + 1][near]
                    docs.append(np.full(len(own), doc))
                    keys.append(own)
            doc, key, first, least = by_key(np.concatenate(docs), np.concatenate(keys))
            told = doc > least
            rows = [(h, True, who, sizes, own) for h, who, sizes, own in by_home(doc[told], key[told], ranges)]
            doc, key = doc[first], key[first]
            at = range_of(key[:, 0], ranges)
            order = order_by(at, ranges)
            order = order[np.lexsort((doc[order], at[order]))]
            doc, key, at = doc[order], key[order], at[order]
            bounds = np.searchsorted(at, np.arange(ranges + 1))
            for r in np.flatnonzero(np.diff(bounds)):
                d = doc[bounds[r] : bounds[r + 1]]
                run = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
                rows.append((int(r), False, d[run].tobytes(), np.diff(np.append(run, len(d))).astype(np.uint32).tobytes(), key[bounds[r] : bounds[r + 1]].tobytes()))
            kinds = (pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], kind) for i, kind in enumerate(kinds)], ["at", "reply", "units", "sizes", "keys"])

    def answer(table: pa.Table) -> pa.Table:
        at, out, docs, keys = table["at"][0].as_py(), [], [], []
        for reply, who, sizes, own in zip(*(table[c].to_pylist() for c in ("reply", "units", "sizes", "keys")), strict=True):
            if reply:
                out.append((at, who, sizes, own))
            else:
                docs.append(np.repeat(np.frombuffer(who, np.int64), np.frombuffer(sizes, np.uint32)))
                keys.append(np.frombuffer(own, np.uint64).reshape(-1, 2))
        if docs:
            doc, key, _, least = by_key(np.concatenate(docs), np.concatenate(keys))
            told = doc > least
            out += list(by_home(doc[told], key[told], ranges))
        return pa.table([pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["at", "units", "sizes", "keys"])

    asked = anchored.mapInArrow(ask, "at int, reply boolean, units binary, sizes binary, keys binary")
    replies = asked.groupBy("at").applyInArrow(answer, REPLY)
    return replies.groupBy("at").applyInArrow(lambda t: gathered(t, "keys", 2), "unit long, keys binary").withColumnRenamed("unit", "doc_id")


def repeats(begin: int, end: int, hit: np.ndarray, window: int) -> np.ndarray:
    """Of the words begin to end: whether one of the hit windows covers it; runs of hits are maximal repeats."""
    edge = np.zeros(end - begin + 1, np.int64)
    at = np.flatnonzero(hit)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return np.cumsum(edge[:-1]) > 0


def cut(anchored: DataFrame, found: DataFrame, window: int) -> DataFrame:
    """doc_id, unit, n_removed, kept (the words left, joined by a space) of the documents that lose words."""

    def remove(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in batches_of(batches):
            for b in held:
                data = [t.encode() for t in b.column("text").to_pylist()]
                (words, begin, large), rows = both_lanes(data, window), []
                for doc, unit, keys, d, x, y in zip(b.column("doc_id").to_pylist(), b.column("unit").to_pylist(), b.column("found"), data, begin[:-1], begin[1:], strict=True):
                    if y - x < window or text_hash(words[x:y]) != unit:
                        continue
                    own, said = large[x : y - window + 1], np.frombuffer(keys.as_buffer(), "<u8").reshape(-1, 2)
                    gone = repeats(x, y, np.isin(own[:, 0], said[:, 0]) & np.isin(own[:, 1], said[:, 1]), window)
                    left = [w for w, g in zip(d.split(), gone.tolist(), strict=True) if not g]
                    rows.append((doc, unit, int(gone.sum()), b" ".join(left).decode()))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["doc_id", "unit", "n_removed", "kept"])

    both = anchored.select("doc_id", "unit", "text").join(found.withColumnRenamed("keys", "found"), "doc_id")
    return both.mapInArrow(remove, "doc_id long, unit long, n_removed long, kept string")


def passages(docs: DataFrame, window: int = 50) -> tuple[DataFrame, DataFrame]:
    """Of docs: its rows (doc_id, mark, n_words, unit, sha, keep_id: the smallest id with the same words), and what is cut
    from those first documents (doc_id, unit, n_removed, kept)."""
    block, ranges = window // 2, partitions_for(docs, 2)
    rows = written(units(docs), "units")
    first = rows.where("doc_id is not null").groupBy("sha").agg(F.min("doc_id").alias("keep_id"), F.min("unit").alias("unit"), F.count(F.lit(1)).alias("rows"))
    shared = shared_keys(texts(docs), lambda found: probes_of(found, block, window), ranges, np.uint8, marked=True)
    anchors = written(shared.join(first, "unit").select(F.col("keep_id").alias("doc_id"), "unit", "keys"), "anchors")
    own = texts(docs)
    if anchors.count() <= SENT_IDS:
        own = own.join(F.broadcast(anchors.select("doc_id").distinct()), "doc_id", "left_semi")
    anchored = written(own.join(anchors.hint("merge"), "doc_id"), "anchored")
    found = written(extended(anchored, ranges, block, window), "repeats")
    return join_groups(rows, first.drop("unit"), "sha"), cut(anchored, found.hint("merge"), window)


def substring_dedup(docs: DataFrame, window: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each row of docs."""
    rows, cuts = passages(docs, window)
    less = cuts.select("doc_id", "unit", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("less")).dropDuplicates(["doc_id", "unit"])
    again = (F.col("n_words") >= window) & (F.col("doc_id") > F.col("keep_id"))
    nothing = hashlib.sha256(b"").hexdigest()
    return rows.join(less, ["doc_id", "unit"], "left").select(
        "doc_id",
        "n_words",
        F.when(again, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(again, F.lit(nothing)).otherwise(F.coalesce("less", F.lower(F.hex("sha")))).alias("kept_sha256"),
    )


def cut_documents(docs: DataFrame, window: int = 50) -> DataFrame:
    """docs with all its columns, the text of documents that lose words replaced by the words left."""
    rows, cuts = passages(docs, window)
    again = (F.col("n_words") >= window) & (F.col("doc_id") > F.col("keep_id"))
    new = rows.join(cuts, ["doc_id", "unit"]).select("doc_id", "mark", "kept").unionByName(rows.where(again).select("doc_id", "mark", F.lit("").alias("kept")))
    new = new.select(F.col("doc_id").alias("_doc_id"), F.col("mark").alias("_mark"), F.col("kept").alias("_kept")).dropDuplicates(["_doc_id", "_mark"])
    joined = docs.join(new, (docs["doc_id"] == new["_doc_id"]) & (F.xxhash64(F.coalesce("text", F.lit(""))) == new["_mark"]), "left")
    return joined.select(*(F.coalesce("_kept", "text").alias("text") if c == "text" else F.col(c) for c in docs.columns))
