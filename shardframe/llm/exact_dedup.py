"""Exact dedup over a persistent digest index (DataFrame operations only).

The index is a table bucketed and sorted by digest. New data comes in batches, the largest ids first: a batch is summed up
by digest before the shuffle, held against the index by a sort-merge anti-join that reads the buckets in place, and its new
digests are appended. So the first batch that has a text has its largest id, and later batches meet a filled index.

Defined cases: null text counts as empty, and empty texts equal each other. Rows are compared by the SHA-256 of their
UTF-8 bytes, without normalisation. Of equal rows the largest doc_id stays; a repeated (doc_id, text) row is equal to
itself, so each such row reads kept (keep_one keeps one of them). A null doc_id never beats a number; a group of null ids
only reads kept in all its rows (keep_one keeps one). An empty table gives no rows. Columns beside doc_id and text are not
read.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardframe.llm.common import join_groups, partitions_for, scratch_path, written


class DigestIndex:
    """Digests seen so far: (digest, keep_id, group_size), in ``buckets`` buckets sorted by digest under ``path``.

    The files outlive the session. Opening a path that holds an index registers it anew with its bucketing, so ``buckets``
    has to be the number it was made with. A batch is appended by one writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.table = f"digest_index_{uuid.uuid5(uuid.NAMESPACE_URL, path).hex}"
        if not spark.catalog.tableExists(self.table):
            spark.sql(
                f"CREATE TABLE {self.table} (digest BINARY, keep_id BIGINT, group_size BIGINT) USING parquet "
                f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
            )

    def read(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.table)
        return self.spark.table(self.table)

    def append_new(self, groups: DataFrame) -> None:
        """Appends the groups (one row per digest) whose digest the index does not hold yet.

        The anti-join is a sort-merge join on the index's own buckets: the index side is neither shuffled nor sorted."""
        new = groups.join(self.read().hint("merge"), "digest", "left_anti").select("digest", "keep_id", "group_size")
        (
            new.repartition(self.buckets, "digest")
            .write.mode("append")
            .format("parquet")
            .bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .option("path", self.path)
            .saveAsTable(self.table)
        )


    def drop(self) -> None:
        """Takes the index out of the catalogue; its files stay until the folder is cleaned."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def digests(docs: DataFrame, row: list[str]) -> DataFrame:
    return docs.select(
        *row,
        F.col("doc_id").cast("long").alias("doc_id"),
        F.unhex(F.sha2(F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8"), 256)).alias("digest"),
    )


def by_digest(rows: DataFrame) -> DataFrame:
    """One row per digest; each task sums up its own rows first, so that a large group is a row per task in the shuffle."""
    return rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


def in_batches(rows: DataFrame, batches: int) -> list[DataFrame]:
    """rows cut by doc_id into about even batches, the largest ids first and null ids last."""
    at = rows.agg(F.percentile_approx("doc_id", [k / batches for k in range(batches - 1, 0, -1)] or [0.5])).first()[0] or []
    bounds = sorted(set(at[: batches - 1]), reverse=True)
    least = [F.col("doc_id") >= x for x in bounds]
    below = [F.col("doc_id") < x for x in bounds]
    return [rows.where(x) for x in [*least[:1], *(a & b for a, b in zip(least[1:], below, strict=False)), F.col("doc_id").isNull() | (below[-1] if below else F.lit(True))]]


def decided(docs: DataFrame, row: list[str], index: DigestIndex | None = None, batches: int = 2) -> DataFrame:
    """row, doc_id, digest, keep_id, group_size of each row of docs."""
    spark = docs.sparkSession
    n = partitions_for(docs)
    own = index or DigestIndex(spark, scratch_path(spark, "digest-index"), n)
    rows = written(digests(docs, row), "digests")
    counted = []
    for batch in in_batches(rows, batches):
        counted.append(written(by_digest(batch), "digest-groups", few=True))  # written, as the optimizer would put the anti-join first
        own.append_new(counted[-1])
    sizes = reduce(DataFrame.unionByName, counted).groupBy("digest").agg(F.sum("group_size").alias("group_size"))
    kept = own.read().select("digest", "keep_id").hint("merge")
    groups = written(sizes.join(kept, "digest").withColumn("rows", F.col("group_size")), "decisions", few=True)
    if index is None:
        own.drop()
    return join_groups(rows, groups, "digest")


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, batches: int = 2) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of docs, dropped rows included.

    With an index that already holds digests, a text seen in an earlier call keeps the row that was kept then, and
    group_size is the size of its group in this call.
    """
    return decided(docs, [], index, batches).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_one(docs: DataFrame, index: DigestIndex | None = None, batches: int = 2) -> DataFrame:
    """One row of each group of equal texts, with all its columns: one that has the group's keep_id. Of repeated rows, and of
    a group of null ids, it is one of them; with an index, a group whose row was kept in an earlier call has none.

    Rows are told apart by a key that is made once and written."""
    rows = written(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    verdict = decided(rows, ["_row"], index, batches).where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    return rows.join(verdict.groupBy("digest").agg(F.min("_row").alias("_row")).select("_row"), "_row", "left_semi").select(*docs.columns)
