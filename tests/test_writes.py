import random

import pytest
from pyspark.sql import functions as F

from shardframe import KeyRange, ShardConfig, ShardEngine, TableConfig
from shardframe.checks import broke_unique_key, has_foreign_keys
from shardframe.functions.ids import GENERATORS, generator_for, register_generator, with_sequence_ids, with_snowflake_ids
from shardframe.operators import movement, writes
from shardframe.plans.pruning import plan_of
from shardframe.sources.jdbc import jdbc_options, read_shards, write_shards
from shardframe.sources.metadata import SCHEMAS, Metadata
from shardframe.sources.store import ShardStore
from shardframe.streaming.ingest import ingest

THREE = {"s1": 1, "s2": 1, "s3": 1}


def engine(spark, replicas=1, meta=None, connections=THREE, **own):
    return ShardEngine(spark, ShardConfig(connections, {"t": TableConfig(**own)}, replica_count=replicas), meta)


def empty(e, spark):
    return e.table("t", spark.createDataFrame([], "id long, value int, _shard string, is_replica boolean"))


def values(df):
    return {r["id"]: r["value"] for r in df.collect()}


def test_insert_makes_replicas_and_ids(spark):
    e = engine(spark, id_generator="sequence")
    rows = spark.createDataFrame([(0, 1), (None, 2), (None, 3)], "id long, value int")
    t, added = writes.insert(empty(e, spark), rows)
    assert sorted(r["id"] for r in t.query().get().collect()) == [0, 1, 2]
    assert added.count() == 6
    by = {(r["id"], r["is_replica"]): r["_shard"] for r in added.collect()}
    assert all([by[i, False], by[i, True]] == e.connection_for("t", i) for i in (0, 1, 2))


def test_replica_rows_are_not_inserted_again(spark):
    e = engine(spark)
    rows = spark.createDataFrame([(1, 1, False), (2, 1, True)], "id long, value int, is_replica boolean")
    assert [r["id"] for r in writes.insert(empty(e, spark), rows)[0].query().get().collect()] == [1]


def test_first_or_create(spark):
    e = engine(spark)
    t = e.table("t", spark.createDataFrame([(50, 100, "s2", False)], "id long, value int, _shard string, is_replica boolean"))
    asked = []

    def make(df):
        asked.append(sorted(r["id"] for r in df.collect()))
        return df.withColumn("value", F.lit(200))

    t, rows = writes.first_or_create(t, spark.createDataFrame([(50,), (51,), (51,)], "id long"), ["id"], make)
    assert values(rows) == {50: 100, 51: 200} and asked == [[51]]
    assert t.query().count() == 2


def test_update_or_create(spark):
    e = engine(spark)
    t = e.table("t", spark.createDataFrame([(75, 10, "s1", False), (75, 10, "s2", True)], "id long, value int, _shard string, is_replica boolean"))
    t, rows = writes.update_or_create(t, spark.createDataFrame([(75,), (76,)], "id long"), ["id"], {"value": 20})
    assert values(rows) == {75: 20, 76: 20}
    all_rows = t.query(include_replicas=True).df.where("id = 75").collect()
    assert {(r["_shard"], r["value"]) for r in all_rows} == {("s1", 20), ("s2", 20)}


def test_sequences(spark):
    meta = Metadata(spark)
    rows = spark.createDataFrame([(None,)] * 3 + [(7,)], "id long")
    assert sorted(r["id"] for r in with_sequence_ids(rows, "id", "a", meta).collect()) == [1, 2, 3, 7]
    assert sorted(r["id"] for r in with_sequence_ids(rows, "id", "a", meta).collect()) == [4, 5, 6, 7]
    assert meta.reserve("b", 1) == 0 and meta.reserve("a", 1) == 6
    assert with_sequence_ids(rows.where("id is not null"), "id", "a", meta).count() == 1


def test_snowflakes_rise(spark):
    rows = spark.range(0, 70_000, numPartitions=3).select(F.lit(None).cast("long").alias("id"))
    found = [r["id"] for r in with_snowflake_ids(rows, "id", "t", Metadata(spark)).collect()]
    assert len(set(found)) == 70_000 and max(found) - min(found) == 69_999


def test_generators(spark):
    config = ShardConfig(THREE, {"a": TableConfig(id_generator="sequence"), "b": TableConfig(id_generator="x")}, groups={"g": ("a", "c")})
    assert generator_for(config, "a") is GENERATORS["sequence"]
    assert generator_for(config, "c") is GENERATORS["snowflake"]
    with pytest.raises(LookupError, match="not configured"):
        generator_for(config, "b")
    register_generator("x", with_sequence_ids)
    assert generator_for(config, "b") is with_sequence_ids
    del GENERATORS["x"]


def test_metadata_is_merged(spark, tmp_path):
    meta = Metadata(spark, str(tmp_path / "meta"))
    e = engine(spark, meta=meta, strategy="db_range", range_size=10)
    writes.insert(empty(e, spark), spark.createDataFrame([(i, 0) for i in range(1, 25)], "id long, value int"))
    writes.insert(empty(e, spark), spark.createDataFrame([(5, 0), (35, 0)], "id long, value int"))
    again = Metadata(spark, str(tmp_path / "meta"))
    assert sorted((r["start"], r["end"]) for r in again.tables["ranges"].collect()) == [(1, 10), (11, 20), (21, 30), (31, 40)]
    e.record_replica("t", 5, "s9")
    e.record_replica("t", 5, "s9")
    e.record_replica("t", 99, "s1")
    rows = {r["start"]: (r["connection"], r["replicas"]) for r in meta.tables["ranges"].collect()}
    assert rows[1][1].count("s9") == 1 and rows[91] == ("s1", [])


def test_replicas_of_slots_and_mappings(spark):
    slots = engine(spark, strategy="db_hash_range")
    slots.record_replica("t", "key2", "s2")
    slots.record_replica("t", "key2", "s3")
    assert slots.connection_for("t", "key2") == ["s2", "s3"]
    kv = engine(spark, strategy="redis", meta=Metadata(spark, mapping=spark.createDataFrame([("shard:t1", "s1")], SCHEMAS["mapping"])))
    kv.record_replica("t", 1, "s3")
    assert kv.connection_for("t", 1) == ["s1", "s3"]


def test_rebalance_swaps_roles(spark):
    meta = Metadata(spark, slots=spark.createDataFrame([("t", 3678, "s2", ["s1"])], SCHEMAS["slots"]))
    e = engine(spark, meta=meta, strategy="db_hash_range")
    rows = [(44, 1, "s2", False), (44, 0, "s1", True), (44, 2, "s3", True)]
    t = e.table("t", spark.createDataFrame(rows, "id long, value int, _shard string, is_replica boolean"))
    counted = []
    moved = movement.rebalance(t, to="s1", metrics=lambda name, n: counted.append(n))
    found = {r["_shard"]: (r["value"], r["is_replica"]) for r in moved.table.df.collect()}
    assert found == {"s1": (1, False), "s2": (1, True), "s3": (2, True)} and counted == [1]
    assert e.connection_for("t", 44) == ["s1", "s2"]


def test_slots_are_pointed_anew_when_all_their_rows_moved(spark):
    e = engine(spark, strategy="db_hash_range", slot_size=2**32)
    t = e.table("t", spark.createDataFrame([(1, 0, "s1", False), (2, 0, "s1", False)], "id long, value int, _shard string, is_replica boolean"))
    movement.rebalance(t, to="s2", end=1)
    assert e.meta.tables["slots"].count() == 0
    movement.rebalance(t, to="s2")
    assert e.connection_for("t", 1)[0] == "s2"


def test_mappings_follow_their_rows(spark):
    e = engine(spark, strategy="redis", replicas=2, meta=Metadata(spark, mapping=spark.createDataFrame([("shard:t1", '["s1","s3"]'), ("shard:t2", "s1")], SCHEMAS["mapping"])))
    t = e.table("t", spark.createDataFrame([(1, 0, "s1", False), (2, 0, "s1", False)], "id long, value int, _shard string, is_replica boolean"))
    movement.rebalance(t, to="s3")
    assert e.connection_for("t", 1) == ["s3", "s1"] and e.connection_for("t", 2) == ["s3", "s1", "s2"]


def test_ranges_follow_a_rebalance(spark):
    e = engine(spark, strategy="range", ranges=(KeyRange(None, None, "s1"),))
    t = e.shard("t", spark.createDataFrame([(i, 0) for i in range(10)], "id long, value int"))
    moved = movement.rebalance(t, source="s1", to="s2", start=3, end=5)
    assert moved.count == 3 and sorted(r["id"] for r in moved.rows.collect()) == [3, 4, 5]
    assert [e.connection_for("t", k)[0] for k in (2, 3, 5, 6)] == ["s1", "s2", "s2", "s1"]


def test_hash_tables_are_not_rebalanced(spark):
    e = engine(spark)
    with pytest.raises(ValueError, match="not supported"):
        movement.rebalance(empty(e, spark))
    with pytest.raises(ValueError, match="not one of"):
        movement.rebalance(empty(engine(spark, strategy="db_range"), spark), to="x")


def test_distribute(spark):
    e = engine(spark)
    t = e.table("t", spark.createDataFrame([(i, 0, "s1", False) for i in range(30)], "id long, value int, _shard string, is_replica boolean"))
    moved = movement.distribute(t)
    assert moved.count == sum(e.connection_for("t", i)[0] != "s1" for i in range(30))
    assert moved.table.query().count() == 30 and moved.table.query(include_replicas=True).count() == 60
    tied = engine(spark, foreign_keys=("parents",))
    with pytest.raises(ValueError, match="foreign keys"):
        movement.distribute(empty(tied, spark))


def test_store_keeps_whole_versions(spark, tmp_path):
    e = engine(spark)
    t = e.shard("t", spark.createDataFrame([(i, 0) for i in range(9)], "id long, value int"))
    store = ShardStore(spark, str(tmp_path / "t"), t.df.schema)
    assert e.migrate({"t": store}) == ["s1", "s2", "s3"] and store.read().count() == 0
    store.append(t.df.select(*store.schema.names))
    opened = e.open("t", store)
    assert opened.query().count() == 9
    gone = opened.df.where("_shard <> 's1'")
    store.replace(gone.select(*store.schema.names))
    assert store.read().where("_shard = 's1'").count() == 0
    with pytest.raises(ValueError, match="columns"):
        store.append(t.df.withColumn("more", F.lit(1)))


def test_streams_are_ingested(spark, tmp_path):
    e = engine(spark)
    rows = spark.createDataFrame([(i, 0) for i in range(20)], "id long, value int")
    rows.write.parquet(str(tmp_path / "in"))
    store = ShardStore(spark, str(tmp_path / "t"), e.shard("t", rows).df.schema)
    store.migrate()
    stream = spark.readStream.schema("id long, value int").parquet(str(tmp_path / "in"))
    ingest(stream, e.open("t", store), store, str(tmp_path / "checkpoint")).awaitTermination(120)
    assert e.open("t", store).query().count() == 20 and store.read().count() == 40


def test_explained_routes(spark):
    e = ShardEngine(spark, ShardConfig(THREE, groups={"g": ("t", "u")}, replica_count=1))
    assert e.explain_route("u", "key2") == {"table": "u", "group": "g", "strategy": "hash", "connection": "s2", "replicas": ["s3"]}
    assert e.members("u") == ["t", "u"] and e.members("x") == ["x"]


def test_checks():
    class Failed(Exception):
        sqlstate = "23505"

    coded = Exception("x")
    coded.code = 1062
    outer = RuntimeError("outer")
    outer.__cause__ = Failed("no")
    assert all(map(broke_unique_key, (Failed("no"), coded, outer, Exception("Duplicate entry"), Exception("UNIQUE constraint failed"))))
    assert not broke_unique_key(Exception("syntax error"))
    config = ShardConfig(THREE, {"children": TableConfig(foreign_keys=("parents",))})
    assert [has_foreign_keys(config, t) for t in ("children", "parents", "plain")] == [True, True, False]


def test_jdbc_options():
    options = jdbc_options({"driver": "pgsql", "host": "h", "port": "1", "database": "d", "username": "u"}, "t")
    assert options["url"] == "jdbc:postgresql://h:1/d" and options["dbtable"] == "t" and options["user"] == "u"


@pytest.mark.parametrize("strategy", ["db_range", "redis"])
def test_many_moved_rows_are_not_broadcast(spark, strategy):
    """Their files are small, the rows are not: the driver's memory must not grow with them."""
    e = engine(spark, strategy=strategy)
    rows = spark.range(120_000).select("id", F.lit(0).alias("value"), F.lit("s1").alias("_shard"), (F.col("id") < 0).alias("is_replica"))
    moved = movement.rebalance(e.table("t", rows), to="s2")
    assert moved.count == moved.table.df.where("_shard = 's2' and not is_replica").count() == 120_000
    assert "BroadcastHashJoin" not in plan_of(moved.table.df)
    if strategy == "redis":
        assert e.meta.tables["mapping"].where("v like '[\"s2\",%'").count() == 120_000
        assert "BroadcastHashJoin" not in plan_of(e.meta.tables["mapping"])
        assert "BroadcastHashJoin" not in plan_of(e.with_route(rows.select("id"), "t"))
    few = movement.rebalance(moved.table, to="s3", end=9)
    assert few.count == 10 and few.table.df.where("_shard = 's3'").count() == 10 and "BroadcastHashJoin" in plan_of(few.table.df)


def found_shards(table, keys):
    return {k: [r["_shard"] for r in table.query().find(k).collect()] for k in keys}


@pytest.mark.parametrize("strategy", ["db_range", "db_hash_range", "redis", "range"])
@pytest.mark.parametrize("moves", [{"to": "s1", "end": 4}, {"source": "s2", "to": "s1", "start": 2, "end": 8}, {"to": "s2", "start": 5, "end": 5}])
def test_rows_are_found_after_any_rebalance(spark, strategy, moves):
    own = {"ranges": (KeyRange(None, 5, "s2"), KeyRange(6, None, "s3"))} if strategy == "range" else {"range_size": 4} if strategy == "db_range" else {}
    e = engine(spark, strategy=strategy, **own)
    t = e.shard("t", spark.createDataFrame([(i, 0) for i in range(1, 12)], "id long, value int"))
    moved = movement.rebalance(t, **moves).table
    want = {r["id"]: [r["_shard"]] for r in moved.df.where("not is_replica").collect()}
    assert found_shards(moved, (3, 5)) == {k: want[k] for k in (3, 5)}
    assert {r["id"]: [r["_shard"]] for r in moved.query().where_in("id", list(range(1, 12))).get().collect()} == want


@pytest.mark.parametrize("seed", range(3))
def test_a_stored_range_leaves_other_keys_alone(spark, seed):
    """Random overlapping ranges, against the rule key by key."""
    rng = random.Random(seed)
    rows = {}
    for _ in range(9):
        a = rng.randrange(1, 60)
        rows[a] = ("t", a, rng.choice([a, a + rng.randrange(40)]), rng.choice(["s1", "s2", "s3"]), rng.choice([[], ["s1"], None]))
    start, end = sorted((rng.randrange(1, 60), rng.randrange(1, 60)))
    meta = Metadata(spark, ranges=spark.createDataFrame(list(rows.values()), SCHEMAS["ranges"]))
    e = engine(spark, meta=meta, strategy="db_range", range_size=7)
    keys = spark.range(1, 110).withColumnRenamed("id", "k")
    before = {r["k"]: (r["_stored"]["connection"], r["_stored"]["replicas"]) if r["_stored"] else None for r in meta.join_ranges(keys, "k", "t", 7).collect()}
    meta.put_range("t", start, end, "new", ["x"], 7)
    after = {r["k"]: (r["_stored"]["connection"], r["_stored"]["replicas"]) if r["_stored"] else None for r in meta.join_ranges(keys, "k", "t", 7).collect()}
    assert after == {k: ("new", ["x"]) if start <= k <= end else v for k, v in before.items()}
    starts = [r["start"] for r in meta.tables["ranges"].collect()]
    assert len(starts) == len(set(starts)) and e.connection_for("t", start)[0] == "new"


def test_metadata_is_merged_in_steps_and_comes_back(spark, tmp_path):
    from shardframe.sources import metadata

    path = f"file://{tmp_path}/meta"
    meta = Metadata(spark, path)
    want = {}
    for i in range(metadata.MOST_DELTAS + 3):
        meta.put_mapping(spark.createDataFrame([(f"k{i}", f"v{i}"), ("k", str(i))], SCHEMAS["mapping"]))
        want |= {f"k{i}": f"v{i}", "k": str(i)}
        if i in (2, metadata.MOST_DELTAS, metadata.MOST_DELTAS + 2):
            for m in (meta, Metadata(spark, path)):
                assert dict(map(tuple, m.tables["mapping"].collect())) == want
    kinds = [p.name[0] for p in (tmp_path / "meta" / "mapping").iterdir()]
    assert kinds.count("v") == 1 and kinds.count("d") == metadata.MOST_DELTAS + 3
    assert meta.reserve("t", 5) == 0 and Metadata(spark, path).reserve("t", 1) == 5


def test_writers_that_share_a_path_lose_nothing(spark, tmp_path, monkeypatch):
    """Two sessions' metadata, neither of which has seen the other's merges, and a claim that was never written."""
    from concurrent.futures import ThreadPoolExecutor

    from shardframe.sources import metadata

    path = f"file://{tmp_path}/meta"
    one, two = Metadata(spark, path), Metadata(spark, path)
    given = []
    for i in range(3):
        for m in (one, two):
            given.append(m.reserve("t", 10))
            m.put_mapping(spark.createDataFrame([(f"k{len(given)}", "s1")], SCHEMAS["mapping"]))
    assert given == [0, 10, 20, 30, 40, 50] and Metadata(spark, path).tables["mapping"].count() == 6
    with ThreadPoolExecutor(4) as pool:
        more = list(pool.map(lambda m: m.reserve("t", 1), [Metadata(spark, path) for _ in range(4)]))
    assert sorted(more) == [60, 61, 62, 63]
    monkeypatch.setattr(metadata, "DEAD_AFTER", 0.5)
    (tmp_path / "meta" / "sequences" / "claim=99").write_text("")
    one.version["sequences"] = 98
    assert two.reserve("t", 1) == 64 and one.reserve("t", 1) == 65


def test_a_number_is_claimed_by_one_writer_only(spark, tmp_path, monkeypatch):
    from concurrent.futures import ThreadPoolExecutor

    writers = [Metadata(spark, f"file://{tmp_path}/meta") for _ in range(8)]
    monkeypatch.setattr(Metadata, "_load", lambda self, name: None)  # as if none had seen another's merge
    monkeypatch.setattr(Metadata, "_under_way", lambda self, name, before: False)
    with ThreadPoolExecutor(len(writers)) as pool:
        found = list(pool.map(lambda m: [m._claim("slots") for _ in range(12)], writers))
    assert sorted(n for own in found for n in own) == list(range(1, 97))


def test_all_replicas_of_a_route_are_kept(spark):
    from shardframe.sources.metadata import after_first

    row = spark.range(1).select(F.sequence(F.lit(1), F.lit(1500)).alias("r")).select(after_first("r").alias("r")).first()
    assert row["r"] == list(range(2, 1501))


def test_a_batch_that_runs_again_is_kept_once(spark, tmp_path):
    e = engine(spark)
    t = e.shard("t", spark.createDataFrame([(i, 0) for i in range(9)], "id long, value int"))
    store = ShardStore(spark, str(tmp_path / "t"), t.df.schema)
    store.migrate()
    rows = t.df.select(*store.schema.names)
    for name in ("a-0", "a-0", "a-1"):
        store.append(rows, name)
    assert store.read().count() == 2 * rows.count()
    store.append(rows)
    store.replace(store.read())
    assert store.read().count() == 3 * rows.count()


def test_primaries_are_read_without_making_replicas(spark):
    t = engine(spark, replicas=2).shard("t", spark.createDataFrame([(1, 0), (None, 1)], "id long, value int"))
    assert "Generate" not in plan_of(t.query().df) and "Generate" in plan_of(t.query(include_replicas=True).df)
    assert [r["id"] for r in t.query().get().collect()] == [1]
    assert t.query().get().exceptAll(t.query(include_replicas=True).df.where("not is_replica")).count() == 0


def test_scratch_needs_a_shared_folder_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from shardframe.sources import scratch

    none = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none)))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=context))


def test_shards_in_databases_are_written_and_read(spark, tmp_path):
    """Two databases of the embedded server that comes with Spark."""
    shards = {n: {"driver": "derby", "host": "", "port": "", "database": str(tmp_path / n)} for n in ("s1", "s2")}
    rows = spark.createDataFrame([(i, f"v{i}", "s1" if i % 3 else "s2") for i in range(1, 30)], "id long, value string, _shard string")
    write_shards(rows, shards, "items")
    write_shards(spark.createDataFrame([(100, "more", "s2")], rows.schema), shards, "items")
    for how in ({}, {"key": "id", "bounds": (1, 100), "parts": 3}):
        found = read_shards(spark, shards, "items", **how).toDF("id", "value", "_shard")
        assert sorted(map(tuple, found.collect())) == sorted([*map(tuple, rows.collect()), (100, "more", "s2")])
        assert found.where("_shard = 's2' and id > 50").count() == 1
