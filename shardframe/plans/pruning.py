"""Shard pruning: keys fixed by a query become a literal filter on ``_shard``, which prunes partitions or whole sources."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def shards_of_keys(table: Any, keys: Sequence) -> list[str]:
    """The shards where the keys' rows are: where new ones would go, and the migrating ones.

    Strategies that look keys up in metadata do so for all of them in one job; the answer has a row for each shard."""
    from shardframe.functions.routing import ROUTE, strategy_for

    place, meta = table.engine.config.placement(table.name), table.engine.meta
    strategy, keys = strategy_for(place), [k for k in keys if k is not None]
    if strategy.is_stored and len(keys) > 1:
        rows = meta.spark.createDataFrame([(k,) for k in keys], StructType([StructField("_k", table.df.schema[table.key].dataType)]))
        found = {r[0] for r in strategy.with_route(rows, "_k", place, meta).select(F.col(ROUTE)[0]).distinct().collect()}
    else:
        found = {strategy.resolve(k, place, meta)[0] for k in keys}
    return sorted(found | (set(place.connections) - set(place.routed)))


def plan_of(df: DataFrame, mode: str = "formatted") -> str:
    """The plan as text."""
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)
