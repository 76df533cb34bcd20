"""The engine: configuration, metadata and the tables made with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardframe.config import ShardConfig
from shardframe.functions.ids import generator_for
from shardframe.functions.routing import REPLICA, ROUTE, SHARD, strategy_for
from shardframe.operators.table import ShardedTable
from shardframe.operators.writes import fan_out
from shardframe.sources.metadata import Metadata
from shardframe.sources.store import ShardStore


class ShardEngine:
    def __init__(self, spark: SparkSession, config: ShardConfig, meta: Metadata | None = None):
        self.spark, self.config = spark, config
        self.meta = meta or Metadata(spark)

    def key(self, table: str) -> str:
        return self.config.placement(table).own.key

    def members(self, table: str) -> list[str]:
        """The tables of the table's group, or the table alone."""
        group = self.config.group_for(table)
        return list(self.config.groups[group]) if group else [table]

    def with_route(self, df: DataFrame, table: str, key: str | None = None) -> DataFrame:
        """Adds ``_route``: the primary shard and the replicas of each row's key."""
        place = self.config.placement(table)
        return strategy_for(place).with_route(df, key or place.own.key, place, self.meta)

    def connection_for(self, table: str, key) -> list[str]:
        place = self.config.placement(table)
        return strategy_for(place).resolve(key, place, self.meta)

    def explain_route(self, table: str, key) -> dict[str, object]:
        """Where a key is placed and why."""
        place = self.config.placement(table)
        route = self.connection_for(table, key)
        return {"table": table, "group": self.config.group_for(table), "strategy": place.strategy, "connection": route[0], "replicas": route[1:]}

    def record_replica(self, table: str, key, connection: str) -> None:
        place = self.config.placement(table)
        strategy_for(place).record_replica(key, connection, place, self.meta)

    def with_ids(self, df: DataFrame, table: str, key: str) -> DataFrame:
        """Rows whose key is null, or all rows where there is no key column, get one from the table's generator."""
        if key not in df.columns:
            df = df.withColumn(key, F.lit(None).cast("long"))
        elif df.schema[key].nullable is False:
            return df
        elif df.where(F.col(key).isNull()).isEmpty():
            return df
        return generator_for(self.config, table)(df, key, table, self.meta)

    def table(self, name: str, df: DataFrame) -> ShardedTable:
        """A table whose rows have ``_shard`` and ``is_replica``."""
        return ShardedTable(self, name, df)

    def shard(self, name: str, df: DataFrame, replicas: bool = True) -> ShardedTable:
        """Plain rows as a sharded table: each on the shards of its route."""
        routed = self.with_route(df, name)
        primaries = routed.withColumn(SHARD, F.col(ROUTE)[0]).withColumn(REPLICA, F.lit(False)).drop(ROUTE)
        if not replicas:
            return ShardedTable(self, name, primaries, primaries=primaries)
        return ShardedTable(self, name, fan_out(routed), primaries=primaries.where(F.col(SHARD).isNotNull()))

    def open(self, name: str, store: ShardStore) -> ShardedTable:
        return ShardedTable(self, name, store.read())

    def migrate(self, stores: dict[str, ShardStore]) -> list[str]:
        """Prepares each table's store; returns all the shards they are on, each once, in order."""
        for store in stores.values():
            store.migrate()
        return list(dict.fromkeys([*self.config.connections, *(n for t in stores for n in self.config.connections_for(t))]))
