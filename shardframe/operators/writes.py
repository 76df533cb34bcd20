"""Routed writes: keys, routes, replicas and metadata of a whole batch at once."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardframe.functions.routing import REPLICA, ROUTE, SHARD, strategy_for
from shardframe.operators.table import ShardedTable
from shardframe.sources.scratch import written

Values = dict[str, Any] | Callable[[DataFrame], DataFrame]


def fan_out(routed: DataFrame) -> DataFrame:
    """A row for each shard of the route: the primary, then the replicas."""
    at = routed.select("*", F.posexplode(ROUTE).alias("_pos", SHARD))
    return at.withColumn(REPLICA, F.col("_pos") > 0).drop("_pos", ROUTE)


def routed(table: ShardedTable, rows: DataFrame) -> DataFrame:
    """rows with their routes; rows marked as replicas are left out, and those without a key are given one."""
    if REPLICA in rows.columns:
        rows = rows.where(~F.col(REPLICA)).drop(REPLICA)
    with_ids = table.engine.with_ids(rows, table.name, table.key)
    return strategy_for(table.place).with_route(with_ids, table.key, table.place, table.engine.meta)


def insert(table: ShardedTable, rows: DataFrame) -> tuple[ShardedTable, DataFrame]:
    """The table with the rows and their replicas added, and the added rows; metadata is kept with the batch."""
    ready = written(routed(table, rows), "routed")
    strategy_for(table.place).record(ready, table.key, table.place, table.engine.meta)
    added = fan_out(ready)
    return table.with_rows(table.df.unionByName(added, allowMissingColumns=True)), added


def with_values(candidates: DataFrame, values: Values) -> DataFrame:
    if callable(values):
        return values(candidates)
    return reduce(lambda df, kv: df.withColumn(kv[0], F.lit(kv[1])), values.items(), candidates)


def one_each(candidates: DataFrame, on: list[str]) -> DataFrame:
    return candidates.dropDuplicates(on)


def same(left: DataFrame, right: DataFrame, on: list[str]):
    return reduce(lambda a, b: a & b, (left[c].eqNullSafe(right[c]) for c in on))


def first_or_create(table: ShardedTable, candidates: DataFrame, on: list[str], values: Values) -> tuple[ShardedTable, DataFrame]:
    """For each candidate its first match in shard order, else a new row of its attributes and values.

    A callable makes the values for the candidates without a match only. Returns the table and the rows."""
    own = one_each(candidates.select(*on), on)
    rows = table.query().df
    hits = rows.join(own, same(rows, own, on), "left_semi").withColumn("_at", F.struct(table.shard_place(), F.col(table.key)))
    existing = hits.groupBy(*on).agg(F.min_by(F.struct(*[c for c in hits.columns if c != "_at"]), "_at").alias("_row")).select("_row.*")
    missing = own.join(rows, same(own, rows, on), "left_anti")
    grown, added = insert(table, with_values(missing, values))
    return grown, existing.unionByName(added.where(~F.col(REPLICA)), allowMissingColumns=True)


def update_or_create(table: ShardedTable, candidates: DataFrame, on: list[str], values: Values) -> tuple[ShardedTable, DataFrame]:
    """For each candidate its first match takes the values, else a new row has them. A callable makes the values for all
    candidates, before the look-up. Replicas of an updated row take its values too. Returns the table and the rows."""
    given = written(one_each(with_values(candidates, values), on), "given")
    changed = [c for c in given.columns if c not in on]
    rows = table.query().df
    at = F.struct(table.shard_place(), F.col(table.key))
    hits = rows.join(given.select(*on), same(rows, given, on), "left_semi").groupBy(*on).agg(F.min_by(table.key, at).alias("_key"))
    new = given.join(hits, same(given, hits, on)).select(F.col("_key"), *(given[c].alias(f"_new_{c}") for c in changed))
    new = written(new, "updates")
    joined = table.df.join(new, table.df[table.key] == new["_key"], "left")
    updated = joined.select(*(F.when(F.col("_key").isNotNull(), F.col(f"_new_{c}")).otherwise(table.df[c]).alias(c) if c in changed else table.df[c] for c in table.df.columns))
    missing = given.join(rows, same(given, rows, on), "left_anti")
    grown, added = insert(table.with_rows(updated), missing)
    touched = updated.where(~F.col(REPLICA)).join(new.select(F.col("_key").alias(table.key)), table.key, "left_semi")
    return grown, touched.unionByName(added.where(~F.col(REPLICA)), allowMissingColumns=True)
