import pytest

from shardframe import ShardConfig, TableConfig, parse_migrating, parse_shards, parse_weights


def test_shards_are_parsed():
    env = {"DB_PORT": "4400"}
    found = parse_shards("app:db.example.com::shards; b:h:3307:d;", env)
    assert found["app"]["port"] == "4400" and found["app"]["database"] == "shards"
    assert found["b"]["port"] == "3307" and found["b"]["host"] == "h"


@pytest.mark.parametrize("text", [":host:3306:db", "shard::3306:db", "shard:host:3306:", "x"])
def test_broken_definitions_are_reported(text, caplog):
    assert parse_shards(text, {}) == {} and parse_weights(text, {}) == {}
    assert "Invalid shard DSN" in caplog.text


def test_definitions_from_the_environment():
    env = {"DB_SHARDS": "a:h:1:d;b:h:1:d", "DB_SHARD_MIGRATIONS": " a ;;b"}
    assert parse_weights(env=env) == {"a": 1, "b": 1}
    assert parse_migrating(env=env) == {"a", "b"}
    assert parse_shards(env=env)["a"]["driver"] == "mysql"


def test_placement_falls_back():
    config = ShardConfig(
        {"a": 1, "b": 2},
        {"orders": TableConfig(strategy="range", replica_count=2), "items": TableConfig(key="item_id"), "alone": TableConfig(connections={"b": 1})},
        replica_count=1,
        groups={"sales": ("orders", "items")},
        migrating=frozenset({"b"}),
    )
    items = config.placement("items")
    assert (items.table, items.strategy, items.replica_count, items.own.key) == ("orders", "range", 2, "item_id")
    assert items.connections == {"a": 1, "b": 2} and items.routed == {"a": 1}
    other = config.placement("other")
    assert (other.strategy, other.replica_count, other.scope) == ("hash", 1, "other")
    assert config.group_for("items") == "sales" and config.group_for("other") is None
    assert config.connections_for("alone") == {"b": 1}
    assert config.resolve_table("items") == "orders" and config.resolve_table("x") == "x"


@pytest.mark.parametrize("bad", [{"1": 1}, {"": 1}, {"a": -1}])
def test_bad_shards_are_refused(bad):
    with pytest.raises(ValueError):
        ShardConfig(bad)
