"""Tables written to the folder that driver and executors share, to cut a plan where it has to give one result."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows up to which Spark may broadcast a side of a join whose number of rows is known.
SENT_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir is not set: it has to name a folder that driver and executors share.")
    base = "file://" + tempfile.mkdtemp(prefix="shardframe-")
    spark.sparkContext.setCheckpointDir(base)
    return base


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/shardframe/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage, and survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unsent(df: DataFrame, rows: int) -> DataFrame:
    """df as a join's right side, never broadcast if it has many rows. Spark judges by the size of the files, and millions
    of keys compress to less than its threshold."""
    return df.hint("merge") if rows > SENT_ROWS else df
