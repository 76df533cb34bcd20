"""What the corpus operators share: scratch tables in the cluster's shared folder, and column clean-up."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardframe.sources import scratch
from shardframe.sources.scratch import scratch_path  # noqa: F401

#: Words, as the contracts state them: runs of anything but space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows that are handed to Python at a time: texts of some kilobytes make batches of a few megabytes.
ARROW_ROWS = 1000


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs inside hands at most ARROW_ROWS rows to Python at a time; the session's own number holds again after."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(ARROW_ROWS, int(before)) if int(before) > 0 else ARROW_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written(df: DataFrame, label: str, few: bool = False) -> DataFrame:
    """Writes df to the shared folder and reads it back, with small batches for Python. few is for narrow tables: they are
    written as an eighth of the shuffle's partitions, or four files a core if those are more."""
    spark = df.sparkSession
    if few:
        df = df.coalesce(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))
    with small_batches(spark):
        return scratch.written(df, label)


def drop_scratch(df: DataFrame) -> None:
    """Deletes the scratch folders that df reads; for callers that have stored df's result."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles() if "/shardframe/" in f}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def partitions_for(df: DataFrame, per_input: int = 1) -> int:
    """Shuffle partitions that grow with the input: the session's number, or more if the scan has more splits."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), per_input * df.rdd.getNumPartitions())


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, the named columns, and the whole text with null as empty. Other columns of docs are not read."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *more, F.coalesce(F.col("text"), F.lit("")).alias("text"))


def bounded_sample(docs: DataFrame, rows: int, seed: int) -> DataFrame:
    """At most ``rows`` rows of docs with different ids, the ones with the smallest seeded hash of their id.

    The ids are chosen from the id column alone; only the chosen rows' texts are read and moved. For fitting models."""
    ids = docs.select("doc_id").where("doc_id is not null").distinct()
    chosen = ids.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(rows)
    return docs.join(F.broadcast(chosen), "doc_id", "left_semi").dropDuplicates(["doc_id"])


#: A key is hot from this share of all rows on: so there are at most a thousand hot keys.
HOT_SHARE = 1000


def join_groups(rows: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """rows left join groups, which has one row for each key and its number of rows in ``rows``.

    Hot keys (a thousandth of all rows or more, so a thousand keys at most) are joined by broadcast and the others by
    sort-merge, so that no task gets a hot key's rows."""
    groups = written(groups, "groups", few=True)
    total = groups.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    is_hot = F.col("rows") * HOT_SHARE >= max(total, HOT_SHARE * HOT_SHARE)
    others = [c for c in groups.columns if c not in (key, "rows")]
    hot = F.broadcast(groups.where(is_hot).select(key, F.lit(True).alias("_hot"), *(F.col(c).alias(f"_{c}") for c in others)))
    dealt = rows.join(hot, key, "left")
    of_hot = dealt.where("_hot").select(*rows.columns, *(F.col(f"_{c}").alias(c) for c in others))
    cold = groups.where(~is_hot).drop("rows").hint("merge")
    of_others = dealt.where("_hot is null").select(*rows.columns).join(cold, key, "left").select(*rows.columns, *others)
    return of_hot.unionByName(of_others)
