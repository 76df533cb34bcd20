import zlib

import pytest

from shardframe import KeyRange, ShardConfig, ShardEngine, TableConfig
from shardframe.functions.routing import hash_of, ring_of, start_of, strategy_for, weighted_of, without
from shardframe.sources.metadata import SCHEMAS, Metadata

THREE = {"shard1": 1, "shard2": 1, "shard3": 1}


def engine(spark, meta=None, connections=THREE, replicas=1, migrating=(), **own):
    return ShardEngine(spark, ShardConfig(connections, {"t": TableConfig(**own)}, replica_count=replicas, migrating=frozenset(migrating)), meta)


def by_column(e, spark, keys, kind="string"):
    df = e.with_route(spark.createDataFrame([(k,) for k in keys], f"id {kind}"), "t")
    return {r["id"]: r["_route"] for r in df.collect()}


def both(e, spark, keys, kind="string"):
    """Column and driver agree."""
    found = by_column(e, spark, keys, kind)
    assert found == {k: e.connection_for("t", k) for k in keys}
    return found


def test_known_hashes():
    assert [hash_of(k) for k in ("1", "key2", "example", "44")] == [2212294583, 3042260458, 1861000095, 3678868925]


def test_hash(spark):
    assert both(engine(spark), spark, ["key2"]) == {"key2": ["shard2", "shard3"]}
    assert both(engine(spark, replicas=2), spark, ["example"]) == {"example": ["shard1", "shard2", "shard3"]}
    assert both(engine(spark, replicas=9), spark, ["example"])["example"] == ["shard1", "shard2", "shard3"]


def test_two_equal_shards(spark):
    found = both(engine(spark, connections={"shard_1": 1, "shard_2": 1}, replicas=0), spark, list(range(1, 21)), "long")
    assert [found[k][0] for k in (1, 4, 5, 10)] == ["shard_2", "shard_1", "shard_1", "shard_2"]
    assert abs(sum(r[0] == "shard_1" for r in found.values()) - 10) <= 3


def test_weights_follow_the_configured_order(spark):
    found = both(engine(spark, connections={"b": 2, "a": 1}, replicas=0), spark, list(range(60)), "long")
    assert all(r == (["b"] if zlib.crc32(str(k).encode()) % 3 < 2 else ["a"]) for k, r in found.items())


def test_null_keys_have_no_route(spark):
    assert by_column(engine(spark), spark, [None]) == {None: None}


def test_migrating_shards_get_no_new_keys(spark):
    assert both(engine(spark, connections={"shard-1": 1, "shard-2": 1}, migrating=["shard-1"]), spark, [4], "long") == {4: ["shard-2"]}


def test_no_shards_or_weights():
    with pytest.raises(ValueError, match="No shards configured"):
        weighted_of(1, {})
    with pytest.raises(ValueError, match="weights"):
        weighted_of(1, {"a": 0})


def test_unknown_strategy(spark):
    with pytest.raises(LookupError, match="not configured"):
        strategy_for(engine(spark, strategy="none").config.placement("t"))


def test_ring_of_a_stranger_starts_at_the_first():
    assert ring_of("x", {"c": 1, "a": 1, "b": 1}, 2) == ["b", "c"]
    assert ring_of("c", {"c": 1, "a": 1, "b": 1}, 2) == ["a", "b"]


def test_range(spark):
    e = engine(spark, connections={"shard_a": 1, "shard_b": 1}, strategy="range", ranges=(KeyRange(1, 10, "shard_a"),))
    assert both(e, spark, [5], "long") == {5: ["shard_a", "shard_b"]}
    with pytest.raises(KeyError, match=r"No range configured for key \[11\]"):
        e.connection_for("t", 11)
    with pytest.raises(Exception, match=r"No range configured for key \[11\]"):
        by_column(e, spark, [11], "long")


def test_first_range_wins_and_bounds_are_open(spark):
    ranges = (KeyRange(None, 5, "shard1"), KeyRange(3, 9, "shard2"), KeyRange(10, None, "shard3"))
    found = both(engine(spark, replicas=0, strategy="range", ranges=ranges), spark, [-7, 3, 5, 6, 10, 10**12], "long")
    assert [r[0] for r in found.values()] == ["shard1", "shard1", "shard1", "shard2", "shard3", "shard3"]


def test_ranges_are_cut():
    old = (KeyRange(None, 10, "a"), KeyRange(11, 20, "b"), KeyRange(21, None, "c"))
    assert without(old, 5, 25) == (KeyRange(None, 4, "a"), KeyRange(26, None, "c"))
    assert without((KeyRange(1, 9, "a"),), 4, 5) == (KeyRange(1, 3, "a"), KeyRange(6, 9, "a"))
    assert without(old, None, None) == ()


def ranges(spark, *rows):
    return Metadata(spark, ranges=spark.createDataFrame([("t", *r) for r in rows], SCHEMAS["ranges"]))


def test_stored_range(spark):
    meta = ranges(spark, (1, 1000, "shard_b", ["shard_c"]))
    e = engine(spark, meta, {"shard_a": 1, "shard_b": 1, "shard_c": 1}, strategy="db_range")
    found = both(e, spark, [50, 1500], "long")
    assert found == {50: ["shard_b", "shard_c"], 1500: ["shard_c", "shard_a"]}  # 1500 by the hash of 1001


def test_stored_ranges_of_any_width(spark):
    meta = ranges(spark, (-50, 10**13, "shard1", []), (5, 5, "shard2", []), (1000, 5_000_000, "shard3", ["shard1", "shard2"]), (2000, 2999, "shard2", None), (9, 3, "shard3", []))
    e = engine(spark, meta, strategy="db_range", range_size=10)
    keys = [-51, -50, -1, 0, 4, 5, 6, 999, 1000, 2000, 2999, 3000, 5_000_000, 5_000_001, 10**13, 10**13 + 1]
    found = both(e, spark, keys, "long")
    assert found[5][0] == "shard2" and found[6][0] == "shard1" and found[2500 if 2500 in found else 2999][0] == "shard2"
    assert found[3000] == ["shard3", "shard1", "shard2"] and found[10**13][0] == "shard1"


@pytest.mark.parametrize(("key", "start"), [(1, 1), (1000, 1), (1001, 1001), (1500, 1001), (0, 1), (-1, 1), (-999, -999), (-998, 1)])
def test_division_truncates(key, start):
    assert start_of(key, 1000) == start


def test_stored_slots(spark):
    rows = [("t", 276921150 // 1000, "shard2", ["shard1", "shard3"]), ("t", 3042260, "shard3", [])]
    e = engine(spark, Metadata(spark, slots=spark.createDataFrame(rows, SCHEMAS["slots"])), strategy="db_hash_range", slot_size=1000)
    found = both(e, spark, ["existing-slot", "key2", "example"])
    assert found["existing-slot"] == ["shard2", "shard1", "shard3"]
    assert found["key2"] == ["shard3", "shard1"]
    assert found["example"][0] == weighted_of(hash_of(1861000), THREE)


def test_mapping(spark):
    rows = [("prefix42", '["primary","replica"]'), ("prefix55", "shard2"), ("prefix7", '["shard1"]')]
    meta = Metadata(spark, mapping=spark.createDataFrame(rows, SCHEMAS["mapping"]))
    found = both(engine(spark, meta, replicas=2, strategy="redis", kv_prefix="prefix"), spark, [42, 55, 7, 99], "long")
    assert found[42] == ["primary", "replica"] and found[55] == ["shard2", "shard3", "shard1"] and found[7] == ["shard1"]
    assert found[99][0] == weighted_of(hash_of(99), THREE)
    empty = engine(spark, meta, connections={}, strategy="redis", kv_prefix="prefix")
    with pytest.raises(KeyError, match="not found"):
        empty.connection_for("t", 99)


def test_literal_keys_prune_shards(spark, tmp_path):
    from shardframe.plans.pruning import plan_of

    e = engine(spark, replicas=0)
    e.shard("t", spark.range(100)).df.write.partitionBy("_shard").parquet(str(tmp_path / "t"))
    t = e.table("t", spark.read.parquet(str(tmp_path / "t")))
    found = t.query().find(42)
    assert [r["id"] for r in found.collect()] == [42]
    assert "PartitionFilters: [isnotnull(_shard" in plan_of(found)
    assert sorted(r["id"] for r in t.query().where_in("id", [3, 5]).get().collect()) == [3, 5]
