"""Reads of a sharded table. A query is immutable; each method returns a new one or a DataFrame over all shards."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from shardframe.functions.numbering import dense_index
from shardframe.functions.routing import REPLICA, SHARD
from shardframe.plans.pruning import shards_of_keys


@dataclass(frozen=True)
class Page:
    """A page's rows with the count over all pages."""

    df: DataFrame
    total: int
    per_page: int
    page: int

    @property
    def last_page(self) -> int:
        return max(1, math.ceil(self.total / self.per_page))


def matches(attrs: dict[str, Any]) -> Column:
    """All attributes equal; None matches null."""
    return reduce(lambda a, b: a & b, (F.col(k).isNull() if v is None else F.col(k) == F.lit(v) for k, v in attrs.items()), F.lit(True))


@dataclass(frozen=True)
class Query:
    """Rows of a table, without replicas unless asked for; the order is the key's if none is given."""

    table: Any  # ShardedTable
    df: DataFrame
    order: tuple[tuple[str, bool], ...] = ()
    columns: tuple[str, ...] = ()
    limited: int | None = None
    skipped: int | None = None

    # filters ------------------------------------------------------------------------------------------------------

    def where(self, condition: Column | None = None, **attrs: Any) -> Query:
        found = self.df if condition is None else self.df.where(condition)
        return replace(self, df=found.where(matches(attrs)) if attrs else found)

    def or_where(self, *conditions: Column) -> Query:
        return self.where(reduce(lambda a, b: a | b, conditions))

    def where_in(self, column: str, values: Sequence) -> Query:
        """On the shard key it reads only the shards of those keys."""
        q = self.where(F.col(column).isin(list(values)))
        return q.on_shards(*shards_of_keys(self.table, values)) if column == self.table.key and self.table.is_placed else q

    def where_between(self, column: str, low: Any, high: Any) -> Query:
        return self.where(F.col(column).between(low, high))

    def where_null(self, column: str, null: bool = True) -> Query:
        return self.where(F.col(column).isNull() if null else F.col(column).isNotNull())

    def where_has(self, other: DataFrame, on: Column | str | list[str], has: bool = True) -> Query:
        """Rows with a match in other, or those without."""
        return replace(self, df=self.df.join(other, on, "left_semi" if has else "left_anti"))

    def on_shards(self, *names: str) -> Query:
        return self.where(F.col(SHARD).isin(list(names)))

    # order and limits ---------------------------------------------------------------------------------------------

    def order_by(self, column: str, descending: bool = False) -> Query:
        return replace(self, order=(*self.order, (column, descending)))

    def select(self, *columns: str) -> Query:
        return replace(self, columns=columns)

    def limit(self, n: int) -> Query:
        return replace(self, limited=max(0, n))

    def offset(self, n: int) -> Query:
        return replace(self, skipped=max(0, n))

    def sort_keys(self) -> list[Column]:
        """Nulls first ascending and last descending; ties go to the shard that is configured first, then to the key."""
        named = [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_first() for c, down in self.order or ((self.table.key, False),)]
        return [*named, self.table.shard_place(), F.col(self.table.key).asc_nulls_first()]

    def get(self, *columns: str) -> DataFrame:
        """All rows in order; a limit becomes a top-k of each partition."""
        df = self.df.orderBy(*self.sort_keys())
        df = df.offset(self.skipped) if self.skipped else df
        df = df if self.limited is None else df.limit(self.limited)
        chosen = columns or self.columns
        return df.select(*chosen) if chosen else df

    def unordered(self, *columns: str) -> DataFrame:
        chosen = columns or self.columns
        return self.df.select(*chosen) if chosen else self.df

    def first(self) -> Row | None:
        return self.limit(1).get().first()

    def find(self, key: Any) -> DataFrame:
        """The row with the key, from the shards that the key is placed on: the literal shard prunes partitions."""
        q = self.where(F.col(self.table.key) == F.lit(key))
        return (q.on_shards(*shards_of_keys(self.table, [key])) if self.table.is_placed else q).limit(1).get()

    def first_match(self, attrs: dict[str, Any]) -> DataFrame:
        """The first row that matches, in shard order."""
        return self.df.where(matches(attrs)).orderBy(self.table.shard_place(), F.col(self.table.key)).limit(1)

    # pages and chunks ---------------------------------------------------------------------------------------------

    def paginate(self, per_page: int, page: int = 1, total: int | None = None) -> Page:
        """A given total takes the count's place."""
        page = max(1, page)
        rows = self.offset((page - 1) * per_page).limit(per_page).get()
        return Page(rows, self.df.count() if total is None else total, per_page, page)

    def simple_paginate(self, per_page: int, page: int = 1) -> DataFrame:
        """A page and one row more, which tells whether another page follows."""
        return self.offset((max(1, page) - 1) * per_page).limit(per_page + 1).get()

    def after(self, last: Any, n: int) -> DataFrame:
        """The n rows by key after the last one: a filter, so that no rows are skipped over."""
        q = self if last is None else self.where(F.col(self.table.key) > F.lit(last))
        return replace(q, order=()).limit(n).get()

    def chunks(self, n: int, column: str | None = None) -> DataFrame:
        """Adds ``chunk``: shard by shard in configured order, n rows each (the last one of a shard may have fewer)."""
        order = [F.col(column).asc_nulls_first(), F.col(self.table.key)] if column else [c for i, c in enumerate(self.sort_keys()) if i != len(self.sort_keys()) - 2]
        rows = dense_index(self.df, "_place", [self.table.shard_place(), *order])
        first = rows.groupBy(SHARD).agg(F.min("_place").alias("_first"))  # a row for each shard
        return rows.join(F.broadcast(first), SHARD).withColumn("chunk", F.floor((F.col("_place") - F.col("_first")) / n)).drop("_place", "_first")

    def chunk(self, n: int, callback: Callable[[list[Row]], Any], column: str | None = None) -> bool:
        """Calls back with each chunk's rows, partition by partition; False from it stops all chunks, and is returned."""
        held: list[Row] = []
        at = None
        rows = self.chunks(n, column).orderBy(self.table.shard_place(), "chunk", *([column] if column else []), self.table.key)
        for row in rows.toLocalIterator():
            if held and (row[SHARD], row["chunk"]) != at:
                if callback(held) is False:
                    return False
                held = []
            at = (row[SHARD], row["chunk"])
            held.append(row)
        return not held or callback(held) is not False

    def lazy(self) -> Iterator[Row]:
        """Rows in order, a partition at a time on the client."""
        return self.get().toLocalIterator()

    # aggregates, over all shards ----------------------------------------------------------------------------------

    def agg(self, *columns: Column) -> DataFrame:
        return self.df.agg(*columns)

    def group_by(self, *columns: str, having: Column | None = None, **aggregates: Column) -> DataFrame:
        found = self.df.groupBy(*columns).agg(*(c.alias(k) for k, c in aggregates.items()))
        return found if having is None else found.where(having)

    def count(self) -> int:
        return self.df.count()

    def exists(self) -> bool:
        return not self.df.isEmpty()

    def scalar(self, column: Column) -> Any:
        return self.df.agg(column).first()[0]

    def distinct(self, *columns: str) -> DataFrame:
        return self.df.select(*columns).distinct()

    def shard_counts(self) -> DataFrame:
        return self.df.groupBy(SHARD).agg(F.count(F.lit(1)).alias("rows"))

    # sets ---------------------------------------------------------------------------------------------------------

    def union_all(self, other: Query, *columns: str) -> DataFrame:
        return self.unordered(*columns).unionByName(other.unordered(*columns))

    def union(self, other: Query, *columns: str) -> DataFrame:
        return self.union_all(other, *columns).distinct()

    def intersect(self, other: Query, *columns: str) -> DataFrame:
        return self.unordered(*columns).intersect(other.unordered(*columns))

    def except_(self, other: Query, *columns: str) -> DataFrame:
        return self.unordered(*columns).subtract(other.unordered(*columns))


class ShardedTable:
    """A DataFrame with ``_shard`` and ``is_replica``, and how its keys are placed.

    Scopes are filters that hold for every query. is_placed says that each row is where its key's route has it, which
    look-ups by key then use; a table that is being moved is not."""

    def __init__(self, engine: Any, name: str, df: DataFrame, is_placed: bool = True, scopes: tuple[Column, ...] = (), primaries: DataFrame | None = None):
        """primaries: df's rows that are no replicas, where there is a plan for them that does not make the replicas."""
        self.engine, self.name, self.df, self.is_placed, self.scopes = engine, name, df, is_placed, scopes
        self.primaries = df.where(~F.col(REPLICA)) if primaries is None else primaries
        self.place = engine.config.placement(name)

    @property
    def key(self) -> str:
        return self.place.own.key

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c not in (SHARD, REPLICA)]

    def shard_place(self) -> Column:
        """The shard's place in the configured order."""
        return F.array_position(F.array(*map(F.lit, self.place.connections)), F.col(SHARD))

    def query(self, include_replicas: bool = False) -> Query:
        df = self.df if include_replicas else self.primaries
        return Query(self, reduce(lambda d, s: d.where(s), self.scopes, df))

    def on_shard(self, name: str) -> Query:
        """The query on one shard, without replicas."""
        return self.query().on_shards(name)

    def with_scope(self, scope: Column) -> ShardedTable:
        return ShardedTable(self.engine, self.name, self.df, self.is_placed, (*self.scopes, scope), self.primaries)

    def with_rows(self, df: DataFrame, is_placed: bool | None = None) -> ShardedTable:
        return ShardedTable(self.engine, self.name, df, self.is_placed if is_placed is None else is_placed, self.scopes)

    def misplaced(self) -> DataFrame:
        """Keys that are primary on more than one shard."""
        return self.query().df.groupBy(self.key).agg(F.count_distinct(SHARD).alias("shards")).where("shards > 1")
