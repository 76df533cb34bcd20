"""A sharded table in Parquet: a folder for each shard, in versions that are replaced whole.

A new version is written beside the old one and counts from the moment that it is complete, so readers see one or the
other, and a shard that loses all its rows is empty in the new one. Batches that may be run again are kept beside the
version, each in a folder of its own that a rerun replaces; the next version takes them in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from shardframe.functions.routing import REPLICA, SHARD


class ShardStore:
    def __init__(self, spark: SparkSession, path: str, schema: StructType):
        """schema: the table's own columns."""
        own = [f for f in schema.fields if f.name not in (SHARD, REPLICA)]
        self.spark, self.path = spark, path
        self.schema = StructType([*own, StructField(REPLICA, BooleanType()), StructField(SHARD, StringType())])

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        make = jvm.org.apache.hadoop.fs.Path
        return make, make(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """The complete versions, oldest first."""
        make, fs = self._fs()
        root = make(self.path)
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        return sorted(int(n[2:]) for n in names if n.startswith("v=") and fs.exists(make(f"{self.path}/{n}/_SUCCESS")))

    def migrate(self, df: DataFrame | None = None) -> None:
        """Makes an empty first version, or checks that df has the table's columns."""
        if df is not None:
            self.check(df)
        if not self.versions():
            self.replace(self.spark.createDataFrame([], self.schema))

    def check(self, df: DataFrame) -> None:
        want = {f.name: f.dataType.simpleString() for f in self.schema}
        have = dict(df.dtypes)
        if want != have:
            raise ValueError(f"The rows' columns {have} are not the table's {want}.")

    def read(self) -> DataFrame:
        done = self.versions()
        if not done:
            return self.spark.createDataFrame([], self.schema)
        whole = self.spark.read.schema(self.schema).parquet(f"{self.path}/v={done[-1]}")
        make, fs = self._fs()
        if not fs.exists(make(f"{self.path}/b={done[-1]}")):
            return whole
        return whole.unionByName(self.spark.read.schema(self.schema).parquet(f"{self.path}/b={done[-1]}").select(*self.schema.names))

    def append(self, df: DataFrame, batch: str | None = None) -> None:
        """A batch that has a name replaces the one that was appended under it."""
        self.check(df)
        done = self.versions() or [1]
        if batch is None:
            df.write.partitionBy(SHARD).mode("append").parquet(f"{self.path}/v={done[-1]}")
        else:
            df.write.partitionBy(SHARD).mode("overwrite").parquet(f"{self.path}/b={done[-1]}/batch={batch}")

    def replace(self, df: DataFrame, keep: int = 1) -> None:
        """df may read the present version; ``keep`` older versions stay for readers that are under way."""
        self.check(df)
        done = self.versions()
        df.select(*self.schema.names).write.partitionBy(SHARD).mode("overwrite").parquet(f"{self.path}/v={max(done, default=0) + 1}")
        make, fs = self._fs()
        for old in done[: max(0, len(done) - keep)]:
            fs.delete(make(f"{self.path}/v={old}"), True)
            fs.delete(make(f"{self.path}/b={old}"), True)
