"""Movement of rows between shards: placement of a whole table, and rebalancing of a part of it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardframe.checks import has_foreign_keys
from shardframe.config import NO_REBALANCE
from shardframe.functions.routing import REPLICA, ROUTE, SHARD, strategy_for
from shardframe.operators.table import ShardedTable
from shardframe.operators.writes import fan_out
from shardframe.sources.scratch import unsent, written

Metrics = Callable[[str, int], None]


@dataclass(frozen=True)
class Moved:
    """The table after a movement, the moved primaries (key, ``_from``, ``_to``) and their number."""

    table: ShardedTable
    rows: DataFrame
    count: int


def distribute_plan(table: ShardedTable) -> DataFrame:
    """Each primary row with its route and ``_from``, the shard that it is on."""
    rows = table.query().df.withColumnRenamed(SHARD, "_from").drop(REPLICA)
    return strategy_for(table.place).with_route(rows, table.key, table.place, table.engine.meta)


def distribute(table: ShardedTable) -> Moved:
    """Every row to where its key's route has it, with its replicas and metadata. Tables that foreign keys tie to others
    cannot be spread over databases."""
    tied = [t for t in table.engine.members(table.name) if has_foreign_keys(table.engine.config, t)]
    if tied:
        raise ValueError(f"Tables with foreign keys cannot be distributed: {', '.join(tied)}")
    plan = written(distribute_plan(table), "distributed")
    strategy_for(table.place).record(plan, table.key, table.place, table.engine.meta)
    moved = plan.where(F.col("_from") != F.col(ROUTE)[0]).select(table.key, "_from", F.col(ROUTE)[0].alias("_to"))
    return Moved(table.with_rows(fan_out(plan.drop("_from")), is_placed=True), moved, moved.count())


def on_route(table: ShardedTable) -> bool:
    """Whether every primary is where its key's route now has it, so that look-ups may go to that shard alone. After a
    partial move, or one that the metadata does not follow, it is not."""
    at = table.df.where(~F.col(REPLICA)).select(table.key, SHARD)
    routed = strategy_for(table.place).with_route(at, table.key, table.place, table.engine.meta)
    return routed.where(~F.col(ROUTE)[0].eqNullSafe(F.col(SHARD))).isEmpty()


def in_scope(key: str, source: str | None, start: int | None, end: int | None) -> Column:
    found = ~F.col(REPLICA)
    found = found if source is None else found & (F.col(SHARD) == source)
    found = found if start is None else found & (F.col(key) >= start)
    return found if end is None else found & (F.col(key) <= end)


def rebalance_plan(table: ShardedTable, source: str | None = None, to: str | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """The primaries that move (all their columns, ``_from``, ``_to``): to the given shard, else to where their route has
    them."""
    rows = table.df.where(in_scope(table.key, source, start, end))
    if to is not None:
        at = rows.withColumn("_to", F.lit(to))
    else:
        at = strategy_for(table.place).with_route(rows, table.key, table.place, table.engine.meta).withColumn("_to", F.col(ROUTE)[0]).drop(ROUTE)
    return at.where(F.col("_to") != F.col(SHARD)).withColumnRenamed(SHARD, "_from")


def rebalance(table: ShardedTable, source: str | None = None, to: str | None = None, start: int | None = None, end: int | None = None, metrics: Metrics | None = None) -> Moved:
    """Moves primaries. Where the target has a replica of the row, the two swap roles and the primary's data is kept; the
    other replicas stay. Then the strategy updates its metadata; if that leaves rows off their keys' routes, look-ups in
    the new table go to all shards."""
    strategy = strategy_for(table.place)
    if not strategy.can_rebalance:
        raise ValueError(NO_REBALANCE.format(table.place.strategy))
    if to is not None and to not in table.place.connections:
        raise ValueError(f"Shard [{to}] is not one of the table's.")
    moved = written(rebalance_plan(table, source, to, start, end), "moved")
    n = moved.count()
    keys = moved.select(F.col(table.key).alias("_k"), "_from", "_to")
    primaries = table.df.where(~F.col(REPLICA)).join(unsent(keys.select("_k"), n), F.col(table.key) == F.col("_k"), "left_anti")
    replicas = table.df.where(REPLICA)
    new = moved.withColumn(SHARD, F.col("_to")).select(*table.df.columns)
    taken = (F.col(table.key) == F.col("_k")) & (F.col(SHARD) == F.col("_to"))
    others = replicas.join(unsent(keys, n), taken, "left_anti")
    held = replicas.select(F.col(table.key).alias("_k"), F.col(SHARD).alias("_to")).hint("merge")  # as many as the table has
    swapped = moved.join(held, (F.col(table.key) == held["_k"]) & (moved["_to"] == held["_to"]), "left_semi")
    back = swapped.withColumn(SHARD, F.col("_from")).withColumn(REPLICA, F.lit(True)).select(*table.df.columns)
    result = primaries.unionByName(others).unionByName(new).unionByName(back)
    rows = moved.select(table.key, "_from", "_to")
    strategy.on_moved(rows, primaries.select(table.key), table.key, table.place, table.engine.meta)
    place = strategy.after_rebalance(start, end, to, table.place, table.engine.meta)
    if place is not table.place:
        table.engine.config = table.engine.config.with_table(place.table, place.own)
    if metrics:
        metrics("shards.rebalance.moved", n)
    after = table.with_rows(result)
    return Moved(table.with_rows(result, is_placed=table.is_placed and on_route(after)), rows, n)
