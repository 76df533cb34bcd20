"""Relations across shards as global joins: one join for all parents, whatever shards the rows are on."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*(F.col(c).alias(prefix + c) for c in df.columns))


def first_child(children: DataFrame, by: list[str], key: str) -> DataFrame:
    """Of the children of each parent the one with the smallest key: an aggregate, so that tasks reduce their rows first."""
    own = children.groupBy(*by).agg(F.min_by(F.struct(*children.columns), key).alias("_c"))
    return own.select("_c.*")


@dataclass(frozen=True)
class BelongsTo:
    """Child to parent by the child's foreign key; a null key has no parent."""

    foreign_key: str
    owner_key: str
    prefix: str = "parent_"

    def load(self, children: DataFrame, parents: DataFrame) -> DataFrame:
        p = prefixed(parents, self.prefix)
        return children.join(p, F.col(self.foreign_key) == F.col(self.prefix + self.owner_key), "left")


@dataclass(frozen=True)
class HasMany:
    """Parent to children; nested gives an array of children for each parent, in the order of their key."""

    foreign_key: str
    local_key: str
    child_key: str
    prefix: str = "child_"

    def load(self, parents: DataFrame, children: DataFrame, how: str = "left") -> DataFrame:
        c = prefixed(children, self.prefix)
        return parents.join(c, F.col(self.local_key) == F.col(self.prefix + self.foreign_key), how)

    def nested(self, parents: DataFrame, children: DataFrame, column: str = "children") -> DataFrame:
        others = [c for c in children.columns if c != self.child_key]
        own = children.groupBy(F.col(self.foreign_key).alias("_fk")).agg(F.array_sort(F.collect_list(F.struct(self.child_key, *others))).alias(column))
        return parents.join(own, F.col(self.local_key) == F.col("_fk"), "left").drop("_fk").withColumn(column, F.coalesce(column, F.array().cast(own.schema[column].dataType)))


@dataclass(frozen=True)
class HasOne(HasMany):
    """Parent to the child with the smallest key."""

    def load(self, parents: DataFrame, children: DataFrame, how: str = "left") -> DataFrame:
        return super().load(parents, first_child(children, [self.foreign_key], self.child_key), how)


@dataclass(frozen=True)
class HasManyThrough:
    """Parent to the children of its intermediates."""

    first_key: str  # of the intermediate, to the parent
    second_key: str  # of the child, to the intermediate
    local_key: str
    middle_key: str
    child_key: str
    prefix: str = "child_"

    def pairs(self, middles: DataFrame, children: DataFrame) -> DataFrame:
        """The children with ``_parent``, the parent's key."""
        m = middles.select(F.col(self.middle_key).alias("_middle"), F.col(self.first_key).alias("_parent"))
        return children.join(m, F.col(self.second_key) == F.col("_middle")).drop("_middle")

    def load(self, parents: DataFrame, middles: DataFrame, children: DataFrame) -> DataFrame:
        c = prefixed(self.pairs(middles, children), self.prefix)
        return parents.join(c, F.col(self.local_key) == F.col(f"{self.prefix}_parent")).drop(f"{self.prefix}_parent")


@dataclass(frozen=True)
class HasOneThrough(HasManyThrough):
    """Parent to the smallest child of its intermediates; parents without one stay."""

    def load(self, parents: DataFrame, middles: DataFrame, children: DataFrame) -> DataFrame:
        one = prefixed(first_child(self.pairs(middles, children), ["_parent"], self.child_key), self.prefix)
        return parents.join(one, F.col(self.local_key) == F.col(f"{self.prefix}_parent"), "left").drop(f"{self.prefix}_parent")


@dataclass(frozen=True)
class BelongsToMany:
    """Parents and related rows by a pivot table; same_shard keeps to pivot rows and related rows of one shard."""

    pivot_parent: str
    pivot_related: str
    parent_key: str
    related_key: str
    prefix: str = "related_"
    same_shard: bool = False

    def load(self, parents: DataFrame, pivot: DataFrame, related: DataFrame, condition: Column | None = None) -> DataFrame:
        p = pivot if condition is None else pivot.where(condition)
        p = p.select(F.col(self.pivot_parent).alias("_pp"), F.col(self.pivot_related).alias("_pr"), *([F.col("_shard").alias("_ps")] if self.same_shard else []))
        r = prefixed(related, self.prefix)
        on = F.col("_pr") == F.col(self.prefix + self.related_key)
        if self.same_shard:
            on = on & (F.col("_ps") == F.col(f"{self.prefix}_shard"))
        return parents.join(p, F.col(self.parent_key) == F.col("_pp")).join(r, on).drop("_pp", "_pr", "_ps")


@dataclass(frozen=True)
class MorphMany:
    """Parent of one type to rows that name their owner by type and key."""

    type_column: str
    id_column: str
    type_name: str
    local_key: str
    child_key: str
    prefix: str = "child_"

    def own(self, children: DataFrame) -> DataFrame:
        return children.where(F.col(self.type_column) == self.type_name)

    def load(self, parents: DataFrame, children: DataFrame, how: str = "left") -> DataFrame:
        c = prefixed(self.own(children), self.prefix)
        return parents.join(c, F.col(self.local_key) == F.col(self.prefix + self.id_column), how)


@dataclass(frozen=True)
class MorphOne(MorphMany):
    """The same, the child with the smallest key alone."""

    def load(self, parents: DataFrame, children: DataFrame, how: str = "left") -> DataFrame:
        return super().load(parents, first_child(self.own(children), [self.id_column], self.child_key), how)


@dataclass(frozen=True)
class MorphTo:
    """Row to its owner, whose table its type column names; a type that no table has gives no owner."""

    type_column: str
    id_column: str
    prefix: str = "owner_"

    def load(self, children: DataFrame, owners: dict[str, tuple[DataFrame, str]]) -> DataFrame:
        """owners: {type: (table, its key)}; the result has all the tables' columns, prefixed."""
        parts = []
        for name, (owner, key) in owners.items():
            own = children.where(F.col(self.type_column) == name)
            parts.append(own.join(prefixed(owner, self.prefix), F.col(self.id_column) == F.col(self.prefix + key), "left"))
        known = F.coalesce(F.col(self.type_column).isin(list(owners)), F.lit(False))
        parts.append(children.where(~known))
        found = parts[0]
        for p in parts[1:]:
            found = found.unionByName(p, allowMissingColumns=True)
        return found


@dataclass(frozen=True)
class MorphToMany(BelongsToMany):
    """Many to many by a pivot that also names a type; inverse reads it from the related side."""

    type_column: str = "type"
    type_name: str = ""

    def load(self, parents: DataFrame, pivot: DataFrame, related: DataFrame, condition: Column | None = None) -> DataFrame:
        typed = F.col(self.type_column) == self.type_name
        return super().load(parents, pivot, related, typed if condition is None else typed & condition)

    def inverse(self) -> MorphToMany:
        return MorphToMany(self.pivot_related, self.pivot_parent, self.related_key, self.parent_key, self.prefix, self.same_shard, self.type_column, self.type_name)
