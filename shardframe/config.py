"""Shards, tables and groups: what a sharded table's placement depends on, checked once."""

from __future__ import annotations

import logging
import os
from collections.abc import Mapping
from dataclasses import dataclass, field, replace

log = logging.getLogger(__name__)

#: Error messages.
NO_SHARDS = "No shards configured."
NO_RANGE = "No range configured for key [{}]"
NO_MAPPING = "Shard for key [{}] not found."
NO_STRATEGY = "Sharding strategy [{}] not configured."
NO_GENERATOR = "ID generator strategy [{}] not configured."
NO_REBALANCE = "Rebalancing is not supported for {} strategy."


@dataclass(frozen=True)
class KeyRange:
    """An inclusive range of keys on one shard; None is an open bound."""

    start: int | None
    end: int | None
    connection: str


@dataclass(frozen=True)
class TableConfig:
    """What a table overrides; None means the engine's own setting."""

    key: str = "id"
    strategy: str | None = None
    connections: Mapping[str, int] | None = None
    replica_count: int | None = None
    group: str | None = None
    ranges: tuple[KeyRange, ...] = ()
    range_size: int = 1000
    slot_size: int = 1_000_000
    kv_prefix: str | None = None
    id_generator: str | None = None
    foreign_keys: tuple[str, ...] = ()


@dataclass(frozen=True)
class Placement:
    """A table's settings with all fall-backs taken; ``routed`` are the shards that new keys may go to."""

    table: str
    strategy: str
    connections: dict[str, int]
    routed: dict[str, int]
    replica_count: int
    scope: str
    own: TableConfig

    @property
    def prefix(self) -> str:
        return self.own.kv_prefix if self.own.kv_prefix is not None else f"shard:{self.table}"


@dataclass(frozen=True)
class ShardConfig:
    """All shards by name and weight, in an order that placement depends on, and the tables on them."""

    connections: Mapping[str, int]
    tables: Mapping[str, TableConfig] = field(default_factory=dict)
    default: str = "hash"
    replica_count: int = 0
    groups: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    migrating: frozenset[str] = frozenset()
    id_generator: str = "snowflake"

    def __post_init__(self) -> None:
        for names in (self.connections, *(t.connections for t in self.tables.values() if t.connections is not None)):
            for name, weight in names.items():
                if not name or name.isdigit():
                    raise ValueError(f"Shard name [{name}] has to be a word: folders named by numbers come back as numbers.")
                if weight < 0:
                    raise ValueError(f"Weight of shard [{name}] is negative.")
        for name, t in self.tables.items():
            if t.range_size < 1 or t.slot_size < 1:
                raise ValueError(f"Range and slot sizes of table [{name}] have to be positive.")

    def resolve_table(self, table: str) -> str:
        """The owner (the first table) of the table's group, or the table itself."""
        return next((members[0] for members in self.groups.values() if table in members), table)

    def group_for(self, table: str) -> str | None:
        return next((g for g, members in self.groups.items() if table in members), None)

    def connections_for(self, table: str) -> dict[str, int]:
        """The table's shards; migrating ones too, as their rows are still there."""
        own = self.tables.get(self.resolve_table(table), TableConfig()).connections
        return dict(self.connections if own is None else own)

    def placement(self, table: str) -> Placement:
        owner = self.resolve_table(table)
        own = self.tables.get(owner, TableConfig())
        key = self.tables.get(table, own).key
        names = self.connections_for(owner)
        return Placement(
            table=owner,
            strategy=own.strategy or self.default,
            connections=names,
            routed={n: w for n, w in names.items() if n not in self.migrating},
            replica_count=self.replica_count if own.replica_count is None else own.replica_count,
            scope=own.group or owner,
            own=replace(own, key=key),
        )

    def with_table(self, table: str, own: TableConfig) -> ShardConfig:
        return replace(self, tables={**self.tables, table: own})


def base_options(env: Mapping[str, str] | None = None) -> dict[str, str]:
    """The options that all shard databases share. The variables' names and the defaults."""
    env = os.environ if env is None else env
    options = {
        "driver": env.get("DB_SHARD_DRIVER", "mysql"),
        "username": env.get("DB_USERNAME", "forge"),
        "password": env.get("DB_PASSWORD", ""),
        "charset": env.get("DB_CHARSET", "utf8mb4"),
        "collation": env.get("DB_COLLATION", "utf8mb4_unicode_ci"),
    }
    return options | ({"ssl_ca": env["MYSQL_ATTR_SSL_CA"]} if env.get("MYSQL_ATTR_SSL_CA") else {})


def parse_shards(definitions: str | None = None, env: Mapping[str, str] | None = None) -> dict[str, dict[str, str]]:
    """``name:host:port:database;...`` as {name: options}. A blank port is DB_PORT; a part that lacks anything else is
    reported and left out."""
    env = os.environ if env is None else env
    definitions = env.get("DB_SHARDS", "") if definitions is None else definitions
    found = {}
    for part in filter(None, definitions.split(";")):
        name, host, port, database = (part.strip().split(":") + [""] * 4)[:4]
        if name and host and database:
            found[name] = base_options(env) | {"host": host, "port": port or env.get("DB_PORT", "3306"), "database": database}
        else:
            log.warning("Invalid shard DSN: %s", part)
    return found


def parse_weights(definitions: str | None = None, env: Mapping[str, str] | None = None) -> dict[str, int]:
    """The same definitions as {name: 1}."""
    return dict.fromkeys(parse_shards(definitions, env), 1)


def parse_migrating(definitions: str | None = None, env: Mapping[str, str] | None = None) -> frozenset[str]:
    """``a;b`` as a set of names."""
    env = os.environ if env is None else env
    definitions = env.get("DB_SHARD_MIGRATIONS", "") if definitions is None else definitions
    return frozenset(name.strip() for name in definitions.split(";") if name)
