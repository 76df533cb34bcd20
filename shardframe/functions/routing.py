"""Placement of keys: every strategy gives [primary, replica, ...] as a Column, so that plans fold, prune and push down.

A key is hashed by the CRC-32 of its text. Keys have to be integers or strings, since other types' texts differ between
systems; a null key has no route.
"""

from __future__ import annotations

import zlib
from abc import ABC, abstractmethod
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardframe.config import NO_MAPPING, NO_RANGE, NO_SHARDS, NO_STRATEGY, KeyRange, Placement
from shardframe.sources.metadata import Metadata

ROUTE, SHARD, REPLICA = "_route", "_shard", "is_replica"


def key_hash(key: Column) -> Column:
    """Unsigned CRC-32 of the key's text."""
    return F.crc32(key.cast("string"))


def hash_of(key) -> int:
    return zlib.crc32(str(key).encode())


def bounds(weights: dict[str, int]) -> tuple[int, list[tuple[int, str]]]:
    """The sum of the weights, and (upper bound, name) of each shard in order."""
    if not weights:
        raise ValueError(NO_SHARDS)
    upper, found = 0, []
    for name, weight in weights.items():
        upper += weight
        found.append((upper, name))
    if upper <= 0:
        raise ValueError("The shards' weights add up to nothing.")
    return upper, found


def weighted(hashed: Column, weights: dict[str, int]) -> Column:
    """The shard in whose share of the weights the hash falls, in configured order."""
    total, shares = bounds(weights)
    place = hashed % F.lit(total)
    return reduce(lambda chain, x: chain.when(place < x[0], F.lit(x[1])), shares[1:], F.when(place < shares[0][0], F.lit(shares[0][1])))


def weighted_of(hashed: int, weights: dict[str, int]) -> str:
    total, shares = bounds(weights)
    return next(name for upper, name in shares if hashed % total < upper)


def ring_of(primary: str, weights: dict[str, int], count: int) -> list[str]:
    """The next names after primary in sorted order, wrapping; from the first one if primary is not among them."""
    names = sorted(weights)
    at = names.index(primary) if primary in names else 0
    return [names[(at + i) % len(names)] for i in range(1, min(count, len(names) - 1) + 1)]


def ring(primary: Column, weights: dict[str, int], count: int) -> Column:
    none = F.array().cast("array<string>")
    if count < 1 or len(weights) < 2:
        return none

    def literal(name: str) -> Column:
        return F.array(*map(F.lit, ring_of(name, weights, count)))

    rings = F.create_map(*(c for n in sorted(weights) for c in (F.lit(n), literal(n))))
    return F.coalesce(F.element_at(rings, primary), literal(""))


def route(primary: Column, place: Placement) -> Column:
    return F.concat(F.array(primary), ring(primary, place.routed, place.replica_count))


class RoutingStrategy(ABC):
    """A way to place keys. ``with_route`` adds the route of each row, ``resolve`` gives that of one key on the driver."""

    can_rebalance = True
    #: Whether routes depend on tables of metadata, so that many keys are better looked up at once.
    is_stored = False

    @abstractmethod
    def with_route(self, df: DataFrame, key: str, place: Placement, meta: Metadata) -> DataFrame: ...

    @abstractmethod
    def resolve(self, key, place: Placement, meta: Metadata) -> list[str]: ...

    def record(self, routed: DataFrame, key: str, place: Placement, meta: Metadata) -> None:
        """Keeps what newly written rows (with their routes) fix for later keys."""

    def record_replica(self, key, connection: str, place: Placement, meta: Metadata) -> None:
        """Adds a replica for one key."""

    def on_moved(self, moved: DataFrame, kept: DataFrame, key: str, place: Placement, meta: Metadata) -> None:
        """After rows moved: moved has the key and ``_to``; kept has the keys of the table's rows that did not."""

    def after_rebalance(self, start: int | None, end: int | None, to: str | None, place: Placement, meta: Metadata) -> Placement:
        """After a rebalance over a range of keys; the table's placement from then on."""
        return place


class HashStrategy(RoutingStrategy):
    can_rebalance = False

    def with_route(self, df, key, place, meta):
        primary = F.when(F.col(key).isNotNull(), weighted(key_hash(F.col(key)), place.routed))
        return df.withColumn(ROUTE, F.when(primary.isNotNull(), route(primary, place)))

    def resolve(self, key, place, meta):
        primary = weighted_of(hash_of(key), place.routed)
        return [primary, *ring_of(primary, place.routed, place.replica_count)]


class RangeStrategy(RoutingStrategy):
    """Ranges in the configuration: the first that holds the key; none is an error, or null where lenient."""

    def __init__(self, strict: bool = True):
        self.strict = strict

    def with_route(self, df, key, place, meta):
        k, primary = F.col(key), F.lit(None).cast("string")
        message = F.concat(F.lit(NO_RANGE.split("{")[0]), k.cast("string"), F.lit(NO_RANGE.split("}")[1]))
        if self.strict:
            primary = F.when(k.isNotNull(), F.raise_error(message).cast("string"))
        for r in reversed(place.own.ranges):
            inside = k.isNotNull()
            inside = inside if r.start is None else inside & (k >= r.start)
            inside = inside if r.end is None else inside & (k <= r.end)
            primary = F.when(inside, F.lit(r.connection)).otherwise(primary)
        return df.withColumn("_primary", primary).withColumn(ROUTE, F.when(F.col("_primary").isNotNull(), route(F.col("_primary"), place))).drop("_primary")

    def resolve(self, key, place, meta):
        for r in place.own.ranges:
            if (r.start is None or key >= r.start) and (r.end is None or key <= r.end):
                return [r.connection, *ring_of(r.connection, place.routed, place.replica_count)]
        raise KeyError(NO_RANGE.format(key))

    def after_rebalance(self, start, end, to, place, meta):
        if to is None:
            return place
        new = KeyRange(start, end, to)
        return replace(place, own=replace(place.own, ranges=(new, *without(place.own.ranges, start, end))))


def without(ranges: tuple[KeyRange, ...], start: int | None, end: int | None) -> tuple[KeyRange, ...]:
    """The ranges without the keys from start to end: cut, split or left out."""
    low, high = float("-inf") if start is None else start, float("inf") if end is None else end
    found = []
    for r in ranges:
        a, b = float("-inf") if r.start is None else r.start, float("inf") if r.end is None else r.end
        if b < low or a > high:
            found.append(r)
            continue
        if a < low:
            found.append(KeyRange(r.start, int(low) - 1, r.connection))
        if b > high:
            found.append(KeyRange(int(high) + 1, r.end, r.connection))
    return tuple(found)


def stored_or(connection: Column, replicas: Column, fallback: Column, place: Placement) -> Column:
    """The stored route, with the ring where it has no replicas; else the route of the fallback."""
    stored = F.coalesce(replicas, F.array().cast("array<string>"))
    own = F.when(F.size(stored) > 0, F.concat(F.array(connection), stored)).otherwise(route(connection, place))
    return F.when(connection.isNotNull(), own).otherwise(route(fallback, place))


class StoredRangeStrategy(RoutingStrategy):
    """Ranges in a metadata table; a key in none goes where the hash of its aligned range's start says."""

    is_stored = True

    @staticmethod
    def range_start(key: Column, size: int) -> Column:
        """Start of the aligned range. The division truncates, so keys below 1 fall outside their own range."""
        return (key - 1) - (key - 1) % F.lit(size) + 1

    def with_route(self, df, key, place, meta):
        k = F.col(key).cast("long")
        found = meta.join_ranges(df, key, place.scope, place.own.range_size)
        fallback = F.when(k.isNotNull(), weighted(key_hash(self.range_start(k, place.own.range_size)), place.routed))
        chosen = stored_or(F.col("_stored.connection"), F.col("_stored.replicas"), fallback, place)
        return found.withColumn(ROUTE, F.when(k.isNotNull(), chosen)).drop("_stored")

    def resolve(self, key, place, meta):
        row = meta.range_of(key, place.scope)
        size = place.own.range_size
        primary = row["connection"] if row else weighted_of(hash_of(start_of(key, size)), place.routed)
        return [primary, *((row and row["replicas"]) or ring_of(primary, place.routed, place.replica_count))]

    def record(self, routed, key, place, meta):
        meta.merge_ranges(routed, key, self.range_start(F.col(key).cast("long"), place.own.range_size), place)

    def record_replica(self, key, connection, place, meta):
        start = start_of(key, place.own.range_size)
        meta.add_range_replica(place.scope, start, start + place.own.range_size - 1, connection)

    def after_rebalance(self, start, end, to, place, meta):
        if to is not None and start is not None:
            meta.put_range(place.scope, start, end, to, ring_of(to, place.routed, place.replica_count), place.own.range_size)
        return place


def start_of(key: int, size: int) -> int:
    return key - (abs(key - 1) % size) * (1 if key > 0 else -1)


class SlotStrategy(RoutingStrategy):
    """Slots of the hash space in a metadata table; a slot that is not there goes where its own number's hash says."""

    is_stored = True

    @staticmethod
    def slot(key: Column, size: int) -> Column:
        return F.floor(key_hash(key) / F.lit(size)).cast("long")

    def with_route(self, df, key, place, meta):
        slot = self.slot(F.col(key), place.own.slot_size)
        found = meta.join_slots(df.withColumn("_slot", slot), place.scope)
        fallback = F.when(F.col("_slot").isNotNull(), weighted(key_hash(F.col("_slot")), place.routed))
        chosen = stored_or(F.col("_stored.connection"), F.col("_stored.replicas"), fallback, place)
        return found.withColumn(ROUTE, F.when(F.col("_slot").isNotNull(), chosen)).drop("_slot", "_stored")

    def resolve(self, key, place, meta):
        slot = hash_of(key) // place.own.slot_size
        row = meta.slot_of(slot, place.scope)
        primary = row["connection"] if row else weighted_of(hash_of(slot), place.routed)
        return [primary, *((row and row["replicas"]) or ring_of(primary, place.routed, place.replica_count))]

    def record(self, routed, key, place, meta):
        meta.merge_slots(routed, key, self.slot(F.col(key), place.own.slot_size), place)

    def record_replica(self, key, connection, place, meta):
        meta.add_slot_replica(place.scope, hash_of(key) // place.own.slot_size, connection)

    def on_moved(self, moved, kept, key, place, meta):
        def numbered(df):
            return df.withColumn("slot", self.slot(F.col(key), place.own.slot_size))

        whole = numbered(moved).join(numbered(kept).select("slot").distinct(), "slot", "left_anti")
        meta.move_slots(whole.groupBy("slot").agg(F.max("_to").alias("to"), F.count_distinct("_to").alias("n")).where("n = 1").drop("n"), place, ring)


class MappingStrategy(RoutingStrategy):
    """A key-value mapping: a JSON list is the route, a bare name the primary; a missing key is hashed."""

    is_stored = True

    def with_route(self, df, key, place, meta):
        k = F.concat(F.lit(place.prefix), F.col(key).cast("string"))
        found = meta.join_mapping(df.withColumn("_kv", k))
        fallback = route(weighted(key_hash(F.col(key)), place.routed), place) if place.routed else F.raise_error(F.concat(F.lit(NO_MAPPING.split("{")[0]), k, F.lit(NO_MAPPING.split("}")[1]))).cast("array<string>")
        single = F.when(F.size("_stored") == 1, F.col("_bare"))
        chosen = F.when(single, route(F.col("_stored")[0], place)).when(F.col("_stored").isNotNull(), F.col("_stored")).otherwise(fallback)
        return found.withColumn(ROUTE, F.when(F.col(key).isNotNull(), chosen)).drop("_kv", "_stored", "_bare")

    def resolve(self, key, place, meta):
        stored, bare = meta.mapping_of(f"{place.prefix}{key}")
        if stored is None:
            if not place.routed:
                raise KeyError(NO_MAPPING.format(f"{place.prefix}{key}"))
            stored, bare = [weighted_of(hash_of(key), place.routed)], True
        return [stored[0], *ring_of(stored[0], place.routed, place.replica_count)] if bare else stored

    def record(self, routed, key, place, meta):
        meta.put_mapping(routed.select(F.concat(F.lit(place.prefix), F.col(key).cast("string")).alias("k"), F.to_json(ROUTE).alias("v")))

    def record_replica(self, key, connection, place, meta):
        meta.add_mapping_replica(f"{place.prefix}{key}", connection)

    def on_moved(self, moved, kept, key, place, meta):
        meta.move_mapping(moved.select(F.concat(F.lit(place.prefix), F.col(key).cast("string")).alias("k"), F.col("_to").alias("to")), place, ring)


STRATEGIES: dict[str, RoutingStrategy] = {
    "hash": HashStrategy(),
    "range": RangeStrategy(),
    "db_range": StoredRangeStrategy(),
    "db_hash_range": SlotStrategy(),
    "redis": MappingStrategy(),
}


def register_strategy(name: str, strategy: RoutingStrategy) -> None:
    STRATEGIES[name] = strategy


def strategy_for(place: Placement) -> RoutingStrategy:
    if place.strategy not in STRATEGIES:
        raise LookupError(NO_STRATEGY.format(place.strategy))
    return STRATEGIES[place.strategy]
