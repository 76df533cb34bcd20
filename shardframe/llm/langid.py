"""Language ID: averaged hashed subword embeddings and a linear softmax, trained by stochastic gradient descent in numpy.

A text's subwords are its letter sequences of two and three characters, word ends included; each is hashed to a bucket,
and the buckets' embeddings are averaged. Averaging and the softmax's weights are both linear, so for prediction a bucket's
embedding and the weights fold into one row of scores. A temperature and a threshold for rejection are set on labelled
rows held out of training.

Defined cases: null text, or text without a letter, gives und with score 0 and is rejected; without any labelled row all
texts do. Each input row gives one row, repeated rows and null ids included; an empty table gives no rows. Texts are read
whole. Columns beside doc_id, text and, for training, lang are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS, WIDTH = 8192, 16
#: Characters hashed at a time.
BLOCK = 1 << 20
UNKNOWN = "und"
#: Ids are sampled by parts of their hashes, 2 to the power of this.
PART_BITS = 12

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def subwords(text: str) -> np.ndarray:
    """How often each bucket occurs in the text; all zero without a letter."""
    counts = np.zeros(BUCKETS, np.int64)
    padded = f" {text.lower()} "
    for first in range(0, len(padded) - 1, BLOCK):  # blocks overlap by what their last subwords reach into
        c = np.frombuffer(padded[first : first + BLOCK + 2].encode("utf-32-le", "surrogatepass"), "<u4")
        is_letter = letters()[c]
        x = np.where(is_letter, c, 0).astype(np.uint64)
        two = x[:-1] * np.uint64(0x9E3779B97F4A7C15) + x[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
        three = two[:-1] * np.uint64(0x165667B19E3779F9) + x[2:] * np.uint64(0x27D4EB2F165667C5) + np.uint64(1)
        for grams, has in ((two[:BLOCK], is_letter[:-1] | is_letter[1:]), (three[:BLOCK], is_letter[1:-1])):
            grams = grams[has[: len(grams)]]
            grams = (grams ^ (grams >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            counts += np.bincount((grams >> np.uint64(51)).astype(np.int64), minlength=BUCKETS)
    return counts


@dataclass
class LanguageModel:
    """languages, the folded score of each bucket, the bias, the softmax's temperature, and the threshold for rejection."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score and whether it is rejected."""
        if not text or not self.languages:
            return UNKNOWN, 0.0, True
        counts = subwords(text)
        if not counts.any():
            return UNKNOWN, 0.0, True
        p = self.chances(counts[None, :])[0]
        best = int(p.argmax())
        return self.languages[best], float(p[best]), bool(p[best] < self.threshold)

    def chances(self, counts: np.ndarray) -> np.ndarray:
        mean = counts / np.maximum(1, counts.sum(1, keepdims=True))
        return softmax((mean @ self.table + self.bias) / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def dense(counts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Rows of BUCKETS numbers from (buckets, how often each occurs)."""
    found = np.zeros((len(counts), BUCKETS), np.float32)
    for row, (at, n) in zip(found, counts, strict=True):
        row[at] = n
    return found


def train(counts: list[tuple[np.ndarray, np.ndarray]], labels: list[str], epochs: int = 40, rate: float = 4.0, seed: int = 3, rejected: float = 0.001) -> LanguageModel:
    """By stochastic gradient descent over four fifths of the rows, which are made dense a batch at a time; the other fifth
    sets the temperature and the threshold, under which at most the share ``rejected`` of its rightly predicted rows falls, and never more than an even chance."""
    languages = sorted(set(labels))
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 0)), np.zeros(0))
    y = np.array([languages.index(x) for x in labels])
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held, fit = order[: len(y) // 5], order[len(y) // 5 :]
    embed = rng.normal(0, 0.5, (BUCKETS, WIDTH)).astype(np.float32)
    weights, bias = rng.normal(0, 0.1, (WIDTH, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for rows in np.array_split(rng.permutation(fit), max(1, len(fit) // 32)):
            if not len(rows):
                continue
            x = dense([counts[i] for i in rows])
            x /= np.maximum(1, x.sum(1, keepdims=True))
            inner = x @ embed
            error = softmax(inner @ weights + bias)
            error[np.arange(len(rows)), y[rows]] -= 1
            error /= len(rows)
            back = error @ weights.T
            used = np.flatnonzero(x.any(0))
            embed[used] -= step * 25 * (x[:, used].T @ back)
            weights -= step * (inner.T @ error)
            bias -= step * error.sum(0)
    model = LanguageModel(languages, (embed @ weights).astype(np.float64), bias.astype(np.float64))
    if len(held):
        apart = dense([counts[i] for i in held])

        def loss(t: float) -> float:
            model.temperature = t
            return float(-np.log(model.chances(apart)[np.arange(len(held)), y[held]] + 1e-12).mean())

        model.temperature = min((2.0**k for k in range(-4, 5)), key=loss)
        p = model.chances(apart)
        right = np.sort(p.max(1)[p.argmax(1) == y[held]])
        if len(right):
            model.threshold = float(min(0.5, right[int(len(right) * rejected)]))
    return model


def held_out() -> Column:
    """The rows that nothing is learned from: crc32 of the id as text leaves 2 by 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, sample_rows: int = 2000, seed: int = 11) -> LanguageModel:
    """Trained on at most sample_rows labelled rows that are not held out, shared evenly among the languages.

    Of the sampled texts the subwords are counted on the executors; the driver gets BUCKETS numbers a row at most."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "lang", "text")
    ids = usable.select("doc_id", "lang").groupBy("doc_id").agg(F.min("lang").alias("lang"))
    names = ids.agg(F.count_distinct("lang")).first()[0]
    each = max(1, sample_rows // max(1, names))
    ids = ids.withColumn("h", F.xxhash64(F.lit(seed), "doc_id")).withColumn("part", F.shiftrightunsigned("h", 64 - PART_BITS))
    earlier = Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ids.groupBy("lang", "part").count().withColumn("before", F.coalesce(F.sum("count").over(earlier), F.lit(0)))
    few = ids.join(parts.where(F.col("before") < each), ["lang", "part"], "left_semi")  # so that no task ranks a whole language
    at = F.row_number().over(Window.partitionBy("lang").orderBy("part", "h", "doc_id"))
    chosen = few.withColumn("at", at).where(F.col("at") <= each).orderBy("at", "lang").limit(sample_rows).select("doc_id", "lang")
    sample = usable.where("text is not null").join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi").dropDuplicates(["doc_id"])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [subwords(t) for t in b.column("text").to_pylist()]
            at = [np.flatnonzero(c).astype(np.int32) for c in found]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), pa.array(at, pa.list_(pa.int32())), pa.array([c[i].astype(np.int32) for c, i in zip(found, at, strict=True)], pa.list_(pa.int32()))], ["doc_id", "lang", "bucket", "n"])

    rows = sample.mapInArrow(count, "doc_id long, lang string, bucket array<int>, n array<int>").toArrow().sort_by([("doc_id", "ascending"), ("lang", "ascending")])
    counts = [(at.values.to_numpy(), n.values.to_numpy()) for at, n in zip(rows["bucket"], rows["n"], strict=True)]
    good = [i for i, (at, _) in enumerate(counts) if len(at)]
    langs = rows["lang"].to_pylist()
    return train([counts[i] for i in good], [langs[i] for i in good])


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score, rejected for each whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sent.value.predict(t) for t in b.column("text").to_pylist()]
            arrays = [pa.array([x[i] for x in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *arrays], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The documents, with all their columns, that the model does not reject."""

    sent = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = [not sent.value.predict(t)[2] for t in b.column("text").to_pylist()]
            yield b.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
