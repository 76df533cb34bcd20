"""Checks around writes and movement."""

from __future__ import annotations

from shardframe.config import ShardConfig

#: SQL states, server codes and phrases of broken unique keys.
STATES, CODES, PHRASES = ("23000", "23505"), (1062, 2601, 2627), ("duplicate", "unique constraint")


def broke_unique_key(error: BaseException) -> bool:
    """Whether a database's error (or one that caused it) reports a broken unique key."""
    seen: set[int] = set()
    cause: BaseException | None = error
    while cause is not None and id(cause) not in seen:
        seen.add(id(cause))
        state, code = getattr(cause, "sqlstate", None), getattr(cause, "code", None)
        text = str(cause).lower()
        if state in STATES or code in CODES or any(p in text for p in PHRASES):
            return True
        cause = cause.__cause__ or cause.__context__
    return False


def has_foreign_keys(config: ShardConfig, table: str) -> bool:
    """Whether a declared foreign key starts at the table or points to it."""
    own = config.tables.get(table)
    return bool(own and own.foreign_keys) or any(table in t.foreign_keys for t in config.tables.values())
