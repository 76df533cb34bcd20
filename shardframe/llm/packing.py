"""Best-fit packing with large-item matching.

What fits together depends on lengths alone, and there are at most ``capacity`` lengths; so the plan is made on the driver
from the count of each length, in runs of equal pieces, and its size has a bound whatever the corpus. Every piece then
finds its place by its length and its rank among the pieces of that length.

Large pieces (over a third of the capacity) go at most two to a sequence: from the longest down, each is matched with the
longest earlier one that leaves room, else it opens a sequence. The smaller ones then go, from the longest down, into the
smallest gap that holds them.

Defined cases: null text counts as empty, which is the end id alone; each input row is packed, repeated rows and ids too;
an empty table gives no rows. Only documents longer than the capacity are cut. Columns beside doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shardframe.llm.bpe import byte_encoder
from shardframe.llm.common import texts, written


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, pieces, first sequence, offset): a run's k-th piece goes to its k-th sequence."""
    open_runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by gap: first sequence, sequences
    has = bytearray(capacity + 1)
    runs: list[tuple[int, int, int, int, int]] = []
    sequences = 0

    def put(gap: int, first: int, n: int) -> None:
        if gap and n:
            open_runs[gap].append((first, n))
            has[gap] = 1

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            gap = has.find(1, length)
            if gap < 0:
                break
            first, n = open_runs[gap].pop()
            has[gap] = bool(open_runs[gap])
            took = min(left, n)
            runs.append((length, rank, took, first, capacity - gap))
            put(gap - length, first, took)
            put(gap, first + took, n - took)
            left, rank = left - took, rank + took
        each = capacity // length  # at most 2 for large pieces
        for n, deep in ((left // each, each), (1, left % each)):
            if n and deep:
                for k in range(deep):
                    runs.append((length, rank, n, sequences, k * length))
                    rank += n
                put(capacity - deep * length, sequences, n)
                sequences += n
    return sorted(runs)


def pieces(docs: DataFrame, capacity: int, vocabulary: str, end_id: int, keep_ids: bool) -> DataFrame:
    """Each document's pieces, with rk: the piece's rank among those of its length that the same task made."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rk long" + ", ids binary" * keep_ids

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = byte_encoder(vocabulary), np.array([end_id], "<u4").tobytes()
        made = [0] * (capacity + 1)
        part = TaskContext.get().partitionId()
        for b in batches:
            out: list[list] = [[], [], [], [], [], [], [], []]
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = encode(text) + end
                n = len(ids) // 4
                for k, start in enumerate(range(0, n, capacity)):
                    own = ids[4 * start : 4 * (start + capacity)]
                    length = len(own) // 4
                    for column, value in zip(out, (doc_id, k, start, length, zlib.crc32(own), part, made[length], own if keep_ids else None), strict=True):
                        column.append(value)
                    made[length] += 1
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rk", "ids"]
            arrays = [pa.array(column, kind) for column, kind in zip(out, types, strict=True)]
            k = len(names) - (not keep_ids)
            yield pa.RecordBatch.from_arrays(arrays[:k], names[:k])

    return texts(docs).mapInArrow(cut, schema)


def pack(docs: DataFrame, capacity: int = 4096, vocabulary: str = "word_bpe_49k.json", end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, little-endian 32-bit) of every piece."""
    rows = written(pieces(docs, capacity, vocabulary, end_id, keep_ids), "pieces")
    made = rows.groupBy("part", "length").agg((F.max("rk") + 1).alias("n"))
    counts = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = made.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = rows.join(before, ["part", "length"]).withColumn("rank", F.col("before") + F.col("rk"))

    runs = np.array(plan(counts, capacity), np.int64).reshape(-1, 5)
    sent = docs.sparkSession.sparkContext.broadcast(runs)
    kept = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids + ", sequence_id long, offset long"

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, _, sequence, offset = sent.value.T
        keys = (length << 44) + first
        for b in batches:
            rank = b.column("rank").to_numpy()
            at = np.searchsorted(keys, (b.column("length").to_numpy() << 44) + rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(sequence[at] + rank - first[at]), pa.array(offset[at])], [*kept, "sequence_id", "offset"])

    return ranked.select(*kept, "rank").mapInArrow(place, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, its ids and its doc_ids in order; a sequence has at most ``capacity`` pieces. Needs keep_ids."""
    own = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id"))).alias("p"))
    return own.select("sequence_id", F.expr("aggregate(p, X'', (a, x) -> concat(a, x.ids))").alias("ids"), F.col("p.doc_id").alias("doc_ids"))
