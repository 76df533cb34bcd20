"""Keys for new rows: time-ordered 64-bit numbers, and sequences reserved in blocks."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardframe.config import NO_GENERATOR, ShardConfig
from shardframe.functions.numbering import dense_index
from shardframe.sources.metadata import Metadata

#: Numbers in a millisecond.
PER_MS = 1 << 16


def snowflake(index: Column, base_ms: int) -> Column:
    """The index-th number from base_ms on: 16 lower bits count within a millisecond, then the time goes on by one.

    Unique and rising within a batch, unlike random lower bits."""
    ms = F.lit(base_ms) + F.shiftright(index, 16)
    return F.shiftleft(ms, 16).bitwiseOR(index.bitwiseAND(F.lit(PER_MS - 1)))


def fill(df: DataFrame, key: str, number: Callable[[Column, int], Column]) -> DataFrame:
    """Gives the rows without a key one; number(index, how many) makes it. Only null is no key: 0 is one."""
    kind = df.schema[key].dataType
    missing = dense_index(df.where(F.col(key).isNull()), "_index")
    n = missing.count()
    given = missing.withColumn(key, number(F.col("_index"), n).cast(kind)).select(*df.columns)
    return df.where(F.col(key).isNotNull()).unionByName(given)


def with_snowflake_ids(df: DataFrame, key: str, table: str, meta: Metadata) -> DataFrame:
    return fill(df, key, lambda index, n: snowflake(index, int(time.time() * 1000)))


def with_sequence_ids(df: DataFrame, key: str, table: str, meta: Metadata) -> DataFrame:
    """The table's next numbers, from 1 on; the block is reserved before the rows are written."""

    def number(index: Column, n: int) -> Column:
        return index + F.lit(meta.reserve(table, n) + 1 if n else 0)

    return fill(df, key, number)


GENERATORS: dict[str, Callable[[DataFrame, str, str, Metadata], DataFrame]] = {
    "snowflake": with_snowflake_ids,
    "sequence": with_sequence_ids,
}


def register_generator(name: str, generator: Callable[[DataFrame, str, str, Metadata], DataFrame]) -> None:
    GENERATORS[name] = generator


def generator_for(config: ShardConfig, table: str) -> Callable[[DataFrame, str, str, Metadata], DataFrame]:
    """The table's own generator or the default. Groups are not resolved: each table has its own sequence."""
    own = config.tables.get(table)
    name = (own and own.id_generator) or config.id_generator
    if name not in GENERATORS:
        raise LookupError(NO_GENERATOR.format(name))
    return GENERATORS[name]
