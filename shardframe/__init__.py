"""Logically sharded tables on Spark: a shard is a value of the ``_shard`` column, placement is a Column expression."""

from shardframe.config import KeyRange, Placement, ShardConfig, TableConfig, parse_migrating, parse_shards, parse_weights
from shardframe.engine import ShardEngine

__all__ = ["KeyRange", "Placement", "ShardConfig", "ShardEngine", "TableConfig", "parse_migrating", "parse_shards", "parse_weights"]
