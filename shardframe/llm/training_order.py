"""Training-order materialisation: token sequences in a keyed random order, in shards with records of one size.

The documents' ids, each closed by the end id, are a stream, which every task cuts into sequences of one length. Every
sequence has a place from 0 in corpus order. A keyed Feistel network permutes the numbers below a power of four; walking
its cycle until the number is below the count of sequences permutes the places themselves, so each task computes its
sequences' slots alone, without a sort or a table of the order. Records are then dealt by shard range and written in slot
order through Spark's file writer, so to any file system that Spark writes to: slot s is record s mod shard_rows of shard
s div shard_rows, at byte (s mod shard_rows) * stride of that shard's one file, and a reader starts anywhere.

A record is a header (big-endian: slot, the id of the document that it begins in, how many of that document's ids come
before, the number of ids that are not filling, and whether the document's id is null), the ids (little-endian, 16 bits or
32 if the vocabulary needs them), and two closing bytes.

A broken run is resumed by running it again with the same documents, parameters and path: the sequences, which are written
first, are read again if they are complete, and shards whose file is there are left out. Files appear whole.

Defined cases: null text counts as empty, which is the end id alone; each input row is written, repeated rows and ids too;
an empty table makes no shards. The last sequence of a task is filled up with the end id; n_tokens is its own length.
Columns beside doc_id and text are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardframe.llm.common import scratch_path, small_batches, texts
from shardframe.llm.wordhash import mix

ROUNDS = 6
#: Fixed value: the string of the end id; in a text it stands for that id.
END = "<|endoftext|>"
HEADER = ">qqqIH"
CLOSING = "\n\n"
SEQUENCES = "part int, at long, doc_id long, start long, n_tokens int, ids binary"


def permuted(places: np.ndarray, count: int, key: int) -> np.ndarray:
    """A keyed permutation of the numbers below count."""
    half = np.uint64(max(1, -(-max(1, count - 1).bit_length() // 2)))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key % 2**64))

    def network(x: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & mask
        for k in keys:
            left, right = right, left ^ (mix(right + k) & mask)
        return (left << half) | right

    x = network(places.astype(np.uint64))
    out = np.flatnonzero(x >= np.uint64(count))
    while len(out):
        x[out] = network(x[out])
        out = out[x[out] >= np.uint64(count)]
    return x.astype(np.int64)


_encodings: dict[str, tiktoken.Encoding] = {}


def encoding(vocabulary: str) -> tiktoken.Encoding:
    """A vocabulary of ranks with the end string as its one special token; one per process and vocabulary."""
    if vocabulary not in _encodings:
        with open(public_tokenizers.path(vocabulary), "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        _encodings[vocabulary] = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={END: len(ranks)})
    return _encodings[vocabulary]


class Layout:
    """Where records are: ids of ``width`` bytes, records of ``stride`` bytes, ``shard_rows`` of them in a shard."""

    def __init__(self, vocabulary: str, length: int, shard_rows: int):
        self.code = "H" if encoding(vocabulary).n_vocab <= 1 << 16 else "I"
        self.width = array(self.code).itemsize
        self.length, self.shard_rows = length, shard_rows
        self.stride = struct.calcsize(HEADER) + length * self.width + len(CLOSING)


def token_sequences(docs: DataFrame, layout: Layout, vocabulary: str, end_id: int) -> DataFrame:
    """part, at (the sequence's place in its task), doc_id and start (the document that it begins in, and that one's ids
    before), n_tokens, ids."""
    size, code = layout.length * layout.width, layout.code

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoding(vocabulary).encode, np.array([end_id], f"<u{layout.width}").tobytes()
        part, at, held, first = TaskContext.get().partitionId(), 0, bytearray(), None
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        names = [x.split()[0] for x in SEQUENCES.split(", ")]

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)

        for b in batches:
            rows = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids, done = np.array(encode(text, allowed_special="all"), f"<u{layout.width}").tobytes() + end, 0
                while done < len(ids):
                    if not held:
                        first = (doc_id, done // layout.width)
                    took = ids[done : done + size - len(held)]
                    held += took
                    done += len(took)
                    if len(held) == size:
                        rows.append((part, at, *first, layout.length, bytes(held)))
                        at += 1
                        held.clear()
            yield made(rows)
        if held:
            n = len(held) // layout.width
            yield made([(part, at, *first, n, bytes(held) + end * (layout.length - n))])

    return texts(docs).mapInArrow(cut, SEQUENCES)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def files_of(spark: SparkSession, path: str) -> DataFrame:
    """The shards' files: path, length, content, shard. Without content in the query, files are listed only."""
    return spark.read.format("binaryFile").load(path)


def materialise(docs: DataFrame, path: str, layout: Layout, key: int, vocabulary: str, end_id: int) -> str:
    """Writes the shards under path, in a folder that its parameters name, and returns that folder. Each shard is one task's
    work and one file; a task that is lost is run again and writes the same records."""
    spark = docs.sparkSession
    cut = hashlib.sha256(repr((layout.length, vocabulary, end_id)).encode()).hexdigest()[:12]
    own = hashlib.sha256(repr((layout.length, vocabulary, end_id, layout.shard_rows, key)).encode()).hexdigest()[:12]
    cut_path, shard_path = f"{path.rstrip('/')}/sequences-{cut}", f"{path.rstrip('/')}/shards-{own}"
    if not exists(spark, f"{cut_path}/_SUCCESS"):
        with small_batches(spark):
            token_sequences(docs, layout, vocabulary, end_id).write.mode("overwrite").options(**{"compression": "zstd", "parquet.compression.codec.zstd.level": "6"}).parquet(cut_path)
    rows = spark.read.schema(SEQUENCES).parquet(cut_path)
    sizes = {r["part"]: r["n"] for r in rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # a number for each task
    firsts = np.zeros(max(sizes, default=0) + 1, np.int64)
    firsts[sorted(sizes)] = np.cumsum([0] + [sizes[p] for p in sorted(sizes)])[:-1]
    count = sum(sizes.values())
    if not count:
        return shard_path
    sent, shard_rows = spark.sparkContext.broadcast(firsts), layout.shard_rows

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor().compress  # on its way to the shard
        for b in batches:
            slot = permuted(sent.value[b.column("part").to_numpy()] + b.column("at").to_numpy(), count, key)
            packed = pa.array([pack(x.as_buffer()) for x in b.column("ids")], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array((slot // shard_rows).astype(np.int32)), pa.array(slot), *(b.column(c) for c in ("doc_id", "start", "n_tokens")), packed], ["shard", "slot", "doc_id", "start", "n_tokens", "ids"])

    def records(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            fields = zip(*(b.column(c).to_pylist() for c in ("slot", "doc_id", "start", "n_tokens", "ids")), strict=True)
            made = [struct.pack(HEADER, slot, doc_id or 0, start, n, doc_id is None) + unpack(ids) for slot, doc_id, start, n, ids in fields]
            yield pa.RecordBatch.from_arrays([b.column("shard"), b.column("slot"), pa.array(made, pa.binary())], ["shard", "slot", "record"])

    slots = rows.mapInArrow(assign, "shard int, slot long, doc_id long, start long, n_tokens int, ids binary")
    if exists(spark, shard_path):
        whole = F.least(F.lit(shard_rows), F.lit(count) - F.col("shard") * shard_rows) * layout.stride
        done = files_of(spark, shard_path).where(F.col("length") == whole).select(F.col("shard").cast("int").alias("shard")).distinct()
        slots = slots.join(done, "shard", "left_anti")
    dealt = slots.repartitionById(-(-count // shard_rows), F.col("shard")).mapInArrow(records, "shard int, slot long, record binary")
    lines = dealt.sortWithinPartitions("shard", "slot").select("shard", F.col("record").cast("string").alias("record"))
    writer = lines.write.partitionBy("shard").mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2")
    with small_batches(spark):
        writer.option("lineSep", CLOSING).text(shard_path)
    return shard_path


def read_records(spark: SparkSession, folder: str, layout: Layout, first_slot: int = 0) -> DataFrame:
    """The records from first_slot on, as they lie in the files: shard, place in the shard, byte_offset, and what the record
    says: slot, doc_id, start, n_tokens, ids (n_tokens of them). Shards before first_slot's are not opened. Order by shard
    and place to read in training order."""
    if not exists(spark, folder):
        schema = "shard int, place long, byte_offset long, slot long, doc_id long, start long, n_tokens long, ids binary"
        return spark.createDataFrame([], schema)
    n, width = layout.stride, layout.stride - len(CLOSING)
    places = F.expr(f"explode(sequence(0, cast(length div {n} as int) - 1))").alias("place")  # a file's bytes are held once, in generated code

    def number(at: int, size: int):
        return F.conv(F.hex(F.substring("record", at + 1, size)), 16, -10).cast("long")

    files = files_of(spark, folder).where(F.col("shard") >= first_slot // layout.shard_rows)
    rows = files.select(F.col("shard").cast("int").alias("shard"), "content", places)
    rows = rows.select("shard", F.col("place").cast("long").alias("place"), F.expr(f"substring(content, place * {n} + 1, {width})").alias("record"))
    own = rows.select(
        "shard", "place", (F.col("place") * n).alias("byte_offset"), number(0, 8).alias("slot"),
        F.when(number(28, 2) == 0, number(8, 8)).alias("doc_id"), number(16, 8).alias("start"), number(24, 4).alias("n_tokens"), "record",
    )
    ids = F.substring("record", F.lit(struct.calcsize(HEADER) + 1), (F.col("n_tokens") * layout.width).cast("int"))
    return own.select(*own.columns[:-1], ids.alias("ids")).where(F.col("shard") * F.lit(layout.shard_rows).cast("long") + F.col("place") >= first_slot)


def training_order(docs: DataFrame, path: str | None = None, length: int = 2048, shard_rows: int = 4096, key: int = 20_240_601, vocabulary: str = "byte_bpe_50k.tiktoken", end_id: int = 50_256) -> DataFrame:
    """Materialises docs and reports what the shards' files hold, read back: slot, shard, place in the shard, byte_offset,
    record_bytes, doc_id and start (where the record begins), n_tokens, ids_crc32."""
    spark, layout = docs.sparkSession, Layout(vocabulary, length, shard_rows)
    folder = materialise(docs, path or scratch_path(spark, "training-order"), layout, key, vocabulary, end_id)
    return read_records(spark, folder, layout).select(
        "slot", "shard", "place", "byte_offset", F.lit(layout.stride).cast("long").alias("record_bytes"), "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )
