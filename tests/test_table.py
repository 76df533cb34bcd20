import pytest
from pyspark.sql import functions as F

from shardframe import ShardConfig, ShardEngine, TableConfig

TWO = {"shard_1": 1, "shard_2": 1}


def table(spark, rows, **own):
    """rows: (id, value, shard, is_replica)"""
    e = ShardEngine(spark, ShardConfig(TWO, {"items": TableConfig(**own)}))
    t = e.table("items", spark.createDataFrame(rows, "id long, value int, _shard string, is_replica boolean"))
    t.is_placed = False
    return t


@pytest.fixture
def interleaved(spark):
    own = [(i, i, "shard_1" if i % 2 else "shard_2", False) for i in range(1, 7)]
    copies = [(i, i, "shard_2" if i % 2 else "shard_1", True) for i in range(1, 7)]
    return table(spark, own + copies)


def ids(df):
    return [r["id"] for r in df.collect()]


def test_merge_is_ordered_and_without_replicas(interleaved):
    q = interleaved.query()
    assert ids(q.get()) == [1, 2, 3, 4, 5, 6]
    assert ids(q.order_by("value", descending=True).get()) == [6, 5, 4, 3, 2, 1]
    assert ids(q.limit(3).get()) == [1, 2, 3]
    assert ids(q.offset(2).limit(3).get()) == [3, 4, 5]
    assert ids(q.offset(4).get()) == [5, 6]
    assert ids(q.limit(0).get()) == []
    assert len(ids(interleaved.query(include_replicas=True).get())) == 12
    assert ids(interleaved.on_shard("shard_1").get()) == [1, 3, 5]


def test_pages(spark):
    rows = [(i, 0, "shard_1" if i <= 1000 else "shard_2", False) for i in range(1, 2001)] + [(i, 0, "shard_2" if i <= 1000 else "shard_1", True) for i in range(1, 2001)]
    q = table(spark, rows).query()
    page = q.paginate(10, page=2)
    assert ids(page.df) == list(range(11, 21)) and (page.total, page.last_page) == (2000, 200)
    assert q.paginate(10, page=1, total=7).total == 7
    assert ids(q.simple_paginate(3, 2)) == [4, 5, 6, 7]
    assert ids(q.after(1999, 5)) == [2000] and ids(q.after(None, 2)) == [1, 2]


def test_ties_and_nulls(spark):
    t = table(spark, [(1, None, "shard_2", False), (2, 5, "shard_2", False), (3, 5, "shard_1", False), (4, None, "shard_1", False)])
    assert ids(t.query().order_by("value").get()) == [4, 1, 3, 2]
    assert ids(t.query().order_by("value", descending=True).get()) == [3, 2, 4, 1]
    assert ids(t.query().where(value=None).get()) == [1, 4]
    assert t.query().order_by("value").first()["id"] == 4


def test_chunks_are_shard_by_shard(spark):
    t = table(spark, [(i, 7 - i, "shard_1" if i <= 3 else "shard_2", False) for i in range(1, 7)])
    seen = []
    assert t.query().chunk(2, lambda rows: seen.append([r["id"] for r in rows])) is True
    assert seen == [[1, 2], [3], [4, 5], [6]]
    seen.clear()
    assert t.query().chunk(2, lambda rows: seen.append([r["id"] for r in rows]), column="value") is True
    assert seen == [[3, 2], [1], [6, 5], [4]]
    seen.clear()
    assert t.query().chunk(2, lambda rows: bool(seen.append(rows))) is False and len(seen) == 1


def test_filters_sets_and_aggregates(interleaved, spark):
    q = interleaved.query()
    assert ids(q.where_between("value", 2, 4).get()) == [2, 3, 4]
    assert ids(q.or_where(F.col("value") < 2, F.col("value") > 5).get()) == [1, 6]
    assert ids(q.where_in("id", [2, 9]).get()) == [2]
    assert ids(q.where_null("value").get()) == []
    other = spark.createDataFrame([(2,), (3,)], "id long")
    assert ids(q.where_has(other, "id").get()) == [2, 3]
    assert ids(q.where_has(other, "id", has=False).get()) == [1, 4, 5, 6]
    assert (q.count(), q.exists(), q.scalar(F.sum("value"))) == (6, True, 21)
    assert q.group_by("_shard", n=F.count(F.lit(1)), having=F.col("n") > 2).count() == 2
    assert {r["id"] for r in q.where(F.col("id") < 4).intersect(q.where(F.col("id") > 2), "id").collect()} == {3}
    assert {r["id"] for r in q.where(F.col("id") < 4).except_(q.where(F.col("id") > 2), "id").collect()} == {1, 2}
    assert q.union_all(q, "id").count() == 12 and q.union(q, "id").count() == 6
    assert q.get("value").columns == ["value"] and [r["id"] for r in q.lazy()] == [1, 2, 3, 4, 5, 6]


def test_scopes_hold_for_every_query(interleaved):
    t = interleaved.with_scope(F.col("value") > 3)
    assert ids(t.query().get()) == [4, 5, 6] and t.query().count() == 3
    assert ids(t.query().first_match({"value": 4})) == [4] and ids(t.query().first_match({"value": 1})) == []


def test_keys_on_two_shards_are_found(spark):
    t = table(spark, [(1, 1, "shard_1", False), (1, 1, "shard_2", False), (2, 1, "shard_2", False)])
    assert ids(t.misplaced()) == [1]
