"""The engine's queries by name over the TPC-H-like tables; each comment names the operators that it shows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardframe.checks import broke_unique_key, has_foreign_keys
from shardframe.config import KeyRange, ShardConfig, TableConfig, parse_migrating, parse_shards, parse_weights
from shardframe.engine import ShardEngine
from shardframe.functions.ids import with_sequence_ids, with_snowflake_ids
from shardframe.functions.numbering import dense_index
from shardframe.functions.routing import REPLICA, ROUTE, SHARD, strategy_for
from shardframe.operators import movement, relations, writes
from shardframe.operators.table import ShardedTable
from shardframe.sources.metadata import SCHEMAS, Metadata
from shardframe.sources.scratch import scratch_path
from shardframe.sources.store import ShardStore
from shardframe.streaming.ingest import ingest

WEIGHTS = {"s1": 2, "s2": 1, "s3": 1}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def engine(spark: SparkSession, strategy: str = "hash", replicas: int = 1, migrating: tuple[str, ...] = (), meta: Metadata | None = None, weights: dict[str, int] | None = None, **own) -> ShardEngine:
    keys = {"orders": "o_orderkey", "customer": "c_custkey", "lineitem": "l_orderkey", "events": "event_id"}
    tables = {n: TableConfig(key=k) for n, k in keys.items()}
    tables["orders"] = TableConfig(key="o_orderkey", strategy=strategy, **own)
    config = ShardConfig(weights or WEIGHTS, tables, replica_count=replicas, groups={"sales": ("orders", "lineitem")}, migrating=frozenset(migrating))
    return ShardEngine(spark, config, meta)


def routes(spark: SparkSession, sf_dir: str, e: ShardEngine) -> DataFrame:
    at = e.with_route(read(spark, sf_dir, "orders", "o_orderkey"), "orders")
    return at.select("o_orderkey", F.array_join(ROUTE, ",").alias("route"))


def orders(spark: SparkSession, sf_dir: str, *columns: str, e: ShardEngine | None = None) -> ShardedTable:
    return (e or engine(spark)).shard("orders", read(spark, sf_dir, "orders", "o_orderkey", *columns))


# routing ----------------------------------------------------------------------------------------------------------


@query
def route_hash(spark, sf_dir):  # C1 I1 I2 I4
    return routes(spark, sf_dir, engine(spark, replicas=0, weights={"a": 1, "b": 1, "c": 1}))


@query
def route_weighted(spark, sf_dir):  # C1 E2
    return routes(spark, sf_dir, engine(spark, replicas=0))


@query
def route_replicas(spark, sf_dir):  # C2 G7 I8
    return routes(spark, sf_dir, engine(spark, replicas=2))


@query
def route_range(spark, sf_dir):  # C3 B7
    ranges = (KeyRange(None, 499, "s1"), KeyRange(300, 999, "s2"), KeyRange(1000, None, "s3"))
    return routes(spark, sf_dir, engine(spark, "range", ranges=ranges))


def range_meta(spark: SparkSession) -> Metadata:
    rows = [("orders", 1, 400, "s1", None), ("orders", 401, 1000, "s2", ["s1"]), ("orders", 600, 699, "s3", []), ("other", 1001, 9000, "s3", [])]
    return Metadata(spark, ranges=spark.createDataFrame(rows, SCHEMAS["ranges"]))


@query
def route_db_range(spark, sf_dir):  # C4 A22 D16 I3 I13
    return routes(spark, sf_dir, engine(spark, "db_range", meta=range_meta(spark), range_size=100))


def slot_meta(spark: SparkSession) -> Metadata:
    rows = [("orders", 0, "s3", []), ("orders", 841, "s2", ["s3"]), ("orders", 2212, "s1", None), ("orders", 3678, "s3", ["s1"]), ("other", 7, "s3", [])]
    return Metadata(spark, slots=spark.createDataFrame(rows, SCHEMAS["slots"]))


@query
def route_slots(spark, sf_dir):  # C5 A23
    return routes(spark, sf_dir, engine(spark, "db_hash_range", meta=slot_meta(spark)))


@query
def route_kv(spark, sf_dir):  # C6 A24 I5 I6
    rows = [("shard:orders1", "s3"), ("shard:orders2", '["s2","s1"]'), ("shard:orders3", '["s1"]'), ("shard:users5", "s3")]
    return routes(spark, sf_dir, engine(spark, "redis", meta=Metadata(spark, mapping=spark.createDataFrame(rows, SCHEMAS["mapping"]))))


@query
def route_migrating(spark, sf_dir):  # B8 C7 H4
    return routes(spark, sf_dir, engine(spark, migrating=("s2",)))


@query
def route_group(spark, sf_dir):  # C8 C9 C10 O8: members are placed by the owner's settings, so that joins stay in a shard
    e = engine(spark, replicas=0)
    items = e.with_route(read(spark, sf_dir, "lineitem", "l_orderkey", "l_quantity"), "lineitem").withColumn(SHARD, F.col(ROUTE)[0])
    o = orders(spark, sf_dir, e=e).query().df.select("o_orderkey", F.col(SHARD).alias("o_shard"))
    joined = items.join(o, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col(SHARD) == F.col("o_shard")))
    return joined.groupBy(F.col(SHARD).alias("shard")).agg(F.count(F.lit(1)).alias("items"), F.sum("l_quantity").alias("quantity"))


@query
def shard_counts(spark, sf_dir):  # E5
    return orders(spark, sf_dir).query().shard_counts().select(F.col(SHARD).alias("shard"), "rows")


# reads ------------------------------------------------------------------------------------------------------------


@query
def scan_merge(spark, sf_dir):  # A3 G1 G2 H1
    found = orders(spark, sf_dir, "o_totalprice").query().order_by("o_totalprice", descending=True).get("o_orderkey", "o_totalprice", SHARD)
    return dense_index(found.withColumnRenamed(SHARD, "shard"), "place")


@query
def filter_project(spark, sf_dir):  # B1 B5 B9 A2
    t = orders(spark, sf_dir, "o_custkey", "o_orderstatus", "o_totalprice")
    q = t.on_shard("s1").where(o_orderstatus="F").where_between("o_totalprice", 1000, 200000).or_where(F.col("o_custkey") < 500, F.col("o_custkey") > 1000)
    return q.get("o_orderkey", "o_totalprice")


@query
def where_in_keys(spark, sf_dir):  # B9 O3
    return orders(spark, sf_dir, "o_custkey").query().where_in("o_orderkey", [3, 5, 8, 13, 21, 34, 55, 89, 144]).get("o_orderkey", "o_custkey")


@query
def find_pruned(spark, sf_dir):  # B10 C13 O3
    return orders(spark, sf_dir, "o_custkey", "o_totalprice").query().find(1234).select("o_orderkey", "o_custkey", "o_totalprice")


@query
def limit_offset(spark, sf_dir):  # G3 O5
    return orders(spark, sf_dir, "o_totalprice").query().order_by("o_totalprice", descending=True).offset(25).limit(50).get("o_orderkey", "o_totalprice").transform(dense_index, "place")


@query
def limit_only(spark, sf_dir):  # G4 G6
    return orders(spark, sf_dir, "o_totalprice").query().limit(7).get("o_orderkey", "o_totalprice")


@query
def offset_only(spark, sf_dir):  # G4
    return orders(spark, sf_dir).query().offset(1000).get("o_orderkey")


@query
def order_multi(spark, sf_dir):  # G2
    q = orders(spark, sf_dir, "o_orderpriority", "o_totalprice").query()
    return q.order_by("o_orderpriority").order_by("o_totalprice", descending=True).limit(100).get("o_orderkey", "o_orderpriority", "o_totalprice").transform(dense_index, "place")


@query
def paginate_page(spark, sf_dir):  # G5
    return orders(spark, sf_dir).query().paginate(10, page=2, total=0).df.select("o_orderkey")


@query
def paginate_total(spark, sf_dir):  # G5 E1
    page = orders(spark, sf_dir).query().paginate(10, page=3)
    return spark.createDataFrame([(page.total, page.per_page, page.page, page.last_page)], "total long, per_page int, page int, last_page int")


@query
def keyset_page(spark, sf_dir):  # G8
    return orders(spark, sf_dir, "o_custkey").query().after(500, 20).select("o_orderkey", "o_custkey")


@query
def chunk_ids(spark, sf_dir):  # A5 K7
    return orders(spark, sf_dir).query().chunks(100).select("o_orderkey", F.col(SHARD).alias("shard"), F.col("chunk").cast("long").alias("chunk"))


@query
def chunk_by_id(spark, sf_dir):  # A6
    return orders(spark, sf_dir, "o_custkey").query().chunks(64, "o_custkey").groupBy(F.col(SHARD).alias("shard"), F.col("chunk").cast("long").alias("chunk")).agg(F.count(F.lit(1)).alias("rows"), F.max("o_custkey").alias("last"))


@query
def first_match(spark, sf_dir):  # A16
    return orders(spark, sf_dir, "o_orderstatus", "o_orderpriority").query().first_match({"o_orderstatus": "F", "o_orderpriority": "1-URGENT"}).select("o_orderkey", F.col(SHARD).alias("shard"))


@query
def replica_filter(spark, sf_dir):  # B2 B3 B4 H2
    t = orders(spark, sf_dir)
    count = F.count(F.lit(1)).alias("rows")
    both = t.query(include_replicas=True).df.groupBy(SHARD).agg(count).withColumn("view", F.lit("all"))
    return both.unionByName(t.query().df.groupBy(SHARD).agg(count).withColumn("view", F.lit("primary"))).withColumnRenamed(SHARD, "shard")


@query
def agg_global(spark, sf_dir):  # E6
    q = orders(spark, sf_dir, "o_totalprice").query()
    price = F.col("o_totalprice").cast("decimal(18,2)")
    return q.agg(F.count(F.lit(1)).alias("n"), F.sum(price).cast("double").alias("total"), F.min("o_totalprice").alias("least"), F.max("o_totalprice").alias("most"))


@query
def agg_group(spark, sf_dir):  # E7
    q = orders(spark, sf_dir, "o_orderstatus", "o_orderpriority", "o_totalprice").query()
    return q.group_by("o_orderstatus", "o_orderpriority", having=F.col("n") > 10, n=F.count(F.lit(1)), most=F.max("o_totalprice"))


@query
def distinct_keys(spark, sf_dir):  # E7 H3
    return orders(spark, sf_dir, "o_custkey", "o_orderstatus").query().distinct("o_custkey", "o_orderstatus")


def of_status(spark: SparkSession, sf_dir: str, status: str):
    return orders(spark, sf_dir, "o_custkey", "o_orderstatus").query().where(o_orderstatus=status)


@query
def union_shards(spark, sf_dir):  # H5
    return of_status(spark, sf_dir, "F").union(of_status(spark, sf_dir, "P"), "o_custkey")


@query
def intersect_shards(spark, sf_dir):  # H5
    return of_status(spark, sf_dir, "F").intersect(of_status(spark, sf_dir, "P"), "o_custkey")


@query
def except_shards(spark, sf_dir):  # H5
    return of_status(spark, sf_dir, "F").except_(of_status(spark, sf_dir, "P"), "o_custkey")


@query
def semi_exists(spark, sf_dir):  # D15 B9
    c = read(spark, sf_dir, "customer", "c_custkey", "c_mktsegment").where("c_mktsegment = 'BUILDING'")
    return orders(spark, sf_dir, "o_custkey").query().where_has(c, F.col("o_custkey") == F.col("c_custkey")).unordered("o_orderkey", "o_custkey")


@query
def anti_missing(spark, sf_dir):  # D15
    o = read(spark, sf_dir, "orders", "o_custkey", "o_orderstatus").where("o_orderstatus = 'P'")
    t = engine(spark).shard("customer", read(spark, sf_dir, "customer", "c_custkey"))
    return t.query().where_has(o, F.col("o_custkey") == F.col("c_custkey"), has=False).unordered("c_custkey")


@query
def range_join(spark, sf_dir):  # D16 A22
    found = range_meta(spark).join_ranges(read(spark, sf_dir, "orders", "o_orderkey", "o_totalprice"), "o_orderkey", "orders", 100)
    at = found.where("_stored is not null").groupBy(F.col("_stored.start").alias("start"), F.col("_stored.connection").alias("connection"))
    return at.agg(F.count(F.lit(1)).alias("rows"), F.max("o_totalprice").alias("most"))


# relations --------------------------------------------------------------------------------------------------------


@query
def belongs_to(spark, sf_dir):  # D1 D2 D12
    o = orders(spark, sf_dir, "o_custkey").query().df.withColumn("fk", F.when(F.col("o_custkey") % 10 != 0, F.col("o_custkey")))
    c = engine(spark).shard("customer", read(spark, sf_dir, "customer", "c_custkey", "c_name")).query().df
    return relations.BelongsTo("fk", "c_custkey").load(o, c).select("o_orderkey", "fk", F.col("parent_c_name").alias("name"))


def customers_and_orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = engine(spark).shard("customer", read(spark, sf_dir, "customer", "c_custkey")).query().df.drop(SHARD, REPLICA)
    return c, orders(spark, sf_dir, "o_custkey", "o_totalprice").query().df.drop(SHARD, REPLICA)


@query
def has_one(spark, sf_dir):  # D3
    found = relations.HasOne("o_custkey", "c_custkey", "o_orderkey").load(*customers_and_orders(spark, sf_dir))
    return found.select("c_custkey", F.col("child_o_orderkey").alias("o_orderkey"), F.col("child_o_totalprice").alias("o_totalprice"))


@query
def has_many(spark, sf_dir):  # D4
    found = relations.HasMany("o_custkey", "c_custkey", "o_orderkey").load(*customers_and_orders(spark, sf_dir))
    return found.select("c_custkey", F.col("child_o_orderkey").alias("o_orderkey"))


@query
def eager_load(spark, sf_dir):  # D13
    found = relations.HasMany("o_custkey", "c_custkey", "o_orderkey").nested(*customers_and_orders(spark, sf_dir))
    return found.select("c_custkey", F.size("children").alias("n"), F.array_join(F.transform("children", lambda c: c["o_orderkey"].cast("string")), ",").alias("keys"))


def geography(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return read(spark, sf_dir, "region", "r_regionkey", "r_name"), read(spark, sf_dir, "nation", "n_nationkey", "n_regionkey"), read(spark, sf_dir, "customer", "c_custkey", "c_nationkey")


@query
def has_many_through(spark, sf_dir):  # D6
    rel = relations.HasManyThrough("n_regionkey", "c_nationkey", "r_regionkey", "n_nationkey", "c_custkey")
    return rel.load(*geography(spark, sf_dir)).select("r_name", F.col("child_c_custkey").alias("c_custkey"))


@query
def has_one_through(spark, sf_dir):  # D5
    rel = relations.HasOneThrough("n_regionkey", "c_nationkey", "r_regionkey", "n_nationkey", "c_custkey")
    return rel.load(*geography(spark, sf_dir)).select("r_name", F.col("child_c_custkey").alias("c_custkey"))


@query
def belongs_to_many(spark, sf_dir):  # D7
    pivot = read(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey").distinct()
    found = relations.BelongsToMany("l_orderkey", "l_partkey", "o_orderkey", "p_partkey").load(orders(spark, sf_dir).query().df, pivot, read(spark, sf_dir, "part", "p_partkey", "p_brand"))
    return found.groupBy("related_p_brand").agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct("o_orderkey").alias("orders")).withColumnRenamed("related_p_brand", "brand")


def owned_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_id") % 2 == 0, "customer").otherwise("supplier")
    return read(spark, sf_dir, "events", "event_id", "user_id", "value").withColumn("owner_type", kind)


@query
def morph_one(spark, sf_dir):  # D8
    rel = relations.MorphOne("owner_type", "user_id", "customer", "c_custkey", "event_id")
    return rel.load(read(spark, sf_dir, "customer", "c_custkey"), owned_events(spark, sf_dir)).select("c_custkey", F.col("child_event_id").alias("event_id"))


@query
def morph_many(spark, sf_dir):  # D9
    rel = relations.MorphMany("owner_type", "user_id", "supplier", "s_suppkey", "event_id")
    return rel.load(read(spark, sf_dir, "supplier", "s_suppkey"), owned_events(spark, sf_dir)).select("s_suppkey", F.col("child_event_id").alias("event_id"))


@query
def morph_to(spark, sf_dir):  # D10
    owners = {"customer": (read(spark, sf_dir, "customer", "c_custkey", "c_name"), "c_custkey"), "supplier": (read(spark, sf_dir, "supplier", "s_suppkey", "s_name"), "s_suppkey")}
    found = relations.MorphTo("owner_type", "user_id").load(owned_events(spark, sf_dir), owners)
    return found.select("event_id", "owner_type", F.coalesce("owner_c_name", "owner_s_name").alias("owner"))


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return owned_events(spark, sf_dir).select(F.col("user_id").alias("tagged"), (F.col("event_id") % 7).cast("int").alias("tag"), "owner_type").distinct()


@query
def morph_to_many(spark, sf_dir):  # D11
    rel = relations.MorphToMany("tagged", "tag", "c_custkey", "n_nationkey", type_column="owner_type", type_name="customer")
    found = rel.load(read(spark, sf_dir, "customer", "c_custkey"), tags(spark, sf_dir), read(spark, sf_dir, "nation", "n_nationkey", "n_name"))
    return found.select("c_custkey", F.col("related_n_name").alias("n_name"))


@query
def morphed_by_many(spark, sf_dir):  # D11
    rel = relations.MorphToMany("tagged", "tag", "c_custkey", "n_nationkey", type_column="owner_type", type_name="customer").inverse()
    found = rel.load(read(spark, sf_dir, "nation", "n_nationkey", "n_name"), tags(spark, sf_dir), read(spark, sf_dir, "customer", "c_custkey"))
    return found.groupBy("n_name").agg(F.count(F.lit(1)).alias("customers"))


# writes -----------------------------------------------------------------------------------------------------------


@query
def replica_fanout(spark, sf_dir):  # A13
    t = orders(spark, sf_dir, e=engine(spark, replicas=2))
    return t.query(include_replicas=True).df.select("o_orderkey", F.col(SHARD).alias("shard"), REPLICA)


@query
def insert_route(spark, sf_dir):  # A12 A25
    e = engine(spark, "db_range", range_size=250)
    t = orders(spark, sf_dir, e=e)
    writes.insert(t, read(spark, sf_dir, "orders", "o_orderkey"))
    return e.meta.tables["ranges"].select("start", "end", "connection", F.array_join("replicas", ",").alias("replicas"))


@query
def insert_slots(spark, sf_dir):  # A12 A26
    e = engine(spark, "db_hash_range", slot_size=100_000_000)
    writes.insert(orders(spark, sf_dir, e=e), read(spark, sf_dir, "orders", "o_orderkey"))
    return e.meta.tables["slots"].select("slot", "connection", F.array_join("replicas", ",").alias("replicas"))


@query
def insert_mapping(spark, sf_dir):  # A12 A27
    e = engine(spark, "redis", kv_prefix="o:")
    writes.insert(orders(spark, sf_dir, e=e), read(spark, sf_dir, "orders", "o_orderkey"))
    return e.meta.tables["mapping"]


def wanted(spark: SparkSession, sf_dir: str) -> tuple[ShardedTable, DataFrame]:
    """Orders without those of status P as the table, and all orders as candidates."""
    rows = read(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus")
    return engine(spark).shard("orders", rows.where("o_orderstatus <> 'P'")), rows.select("o_orderkey")


@query
def first_or_create(spark, sf_dir):  # A14 K8
    _, rows = writes.first_or_create(*wanted(spark, sf_dir), ["o_orderkey"], {"o_orderstatus": "new"})
    return rows.select("o_orderkey", "o_orderstatus", F.col(SHARD).alias("shard"))


@query
def update_or_create(spark, sf_dir):  # A15 K8
    t, _ = writes.update_or_create(*wanted(spark, sf_dir), ["o_orderkey"], lambda df: df.withColumn("o_orderstatus", F.concat(F.lit("u"), "o_orderkey")))
    return t.query(include_replicas=True).df.select("o_orderkey", "o_orderstatus", F.col(SHARD).alias("shard"), REPLICA)


@query
def seq_ids(spark, sf_dir):  # C16 C17 K4
    rows = read(spark, sf_dir, "nation", "n_nationkey").withColumn("id", F.when(F.col("n_nationkey") % 5 == 0, F.col("n_nationkey").cast("long") + 1000))
    meta = Metadata(spark, sequences=spark.createDataFrame([("nation", 41)], SCHEMAS["sequences"]))
    found = with_sequence_ids(rows, "id", "nation", meta)
    last = meta.tables["sequences"].select(F.lit(-1).alias("k"), F.col("last_id").alias("id"))
    return found.select(F.when(F.col("id") > 1000, F.col("n_nationkey")).alias("k"), "id").unionByName(last)


@query
def snowflake_ids(spark, sf_dir):  # C15 I10 I11; the ids depend on the clock, their places from the first one on do not
    found = with_snowflake_ids(read(spark, sf_dir, "orders", "o_orderkey").withColumn("id", F.lit(None).cast("long")), "id", "orders", Metadata(spark))
    least = found.agg(F.min("id")).first()[0]
    return found.select((F.col("id") - F.lit(least)).alias("place"))


# movement ---------------------------------------------------------------------------------------------------------


def piled(spark: SparkSession, sf_dir: str, e: ShardEngine) -> ShardedTable:
    """Orders that are all on s1, without replicas."""
    rows = read(spark, sf_dir, "orders", "o_orderkey").withColumns({SHARD: F.lit("s1"), REPLICA: F.lit(False)})
    return e.table("orders", rows)


@query
def distribute_plan(spark, sf_dir):  # A17 E4
    moved = movement.distribute(piled(spark, sf_dir, engine(spark)))
    return moved.rows.groupBy(F.col("_from").alias("source"), F.col("_to").alias("target")).agg(F.count(F.lit(1)).alias("rows"))


@query
def rebalance_to(spark, sf_dir):  # A18 A19 B6 E3
    e = engine(spark, "db_range", meta=range_meta(spark), range_size=100)
    moved = movement.rebalance(piled(spark, sf_dir, e), source="s1", to="s3", start=250, end=1199)
    return moved.table.query(include_replicas=True).df.select("o_orderkey", F.col(SHARD).alias("shard"), REPLICA)


@query
def rebalance_range(spark, sf_dir):  # A19: without a target rows go where their routes have them
    e = engine(spark, "range", ranges=(KeyRange(None, 499, "s2"), KeyRange(500, None, "s3")))
    moved = movement.rebalance(piled(spark, sf_dir, e), start=100, end=899)
    return moved.table.query().df.select("o_orderkey", F.col(SHARD).alias("shard"))


@query
def rebalance_swap(spark, sf_dir):  # A19: a replica on the target swaps roles with its primary
    e = engine(spark, "db_hash_range", weights={"s1": 1, "s2": 1})
    moved = movement.rebalance(orders(spark, sf_dir, e=e), source="s1", to="s2", end=599)
    return moved.table.query(include_replicas=True).df.select("o_orderkey", F.col(SHARD).alias("shard"), REPLICA)


@query
def slot_row_moved(spark, sf_dir):  # A29 K2
    e = engine(spark, "db_hash_range", meta=slot_meta(spark), slot_size=1_000_000_000)
    movement.rebalance(orders(spark, sf_dir, e=e), to="s2")
    return e.meta.tables["slots"].select("table", "slot", "connection", F.array_join(F.coalesce("replicas", F.array().cast("array<string>")), ",").alias("replicas"))


@query
def after_rebalance(spark, sf_dir):  # A31 K3
    e = engine(spark, "db_range", meta=range_meta(spark), range_size=100)
    movement.rebalance(orders(spark, sf_dir, e=e), to="s1", start=300, end=650)
    return e.meta.tables["ranges"].select("table", "start", "end", "connection", F.array_join(F.coalesce("replicas", F.array().cast("array<string>")), ",").alias("replicas"))


@query
def routes_after_rebalance(spark, sf_dir):  # A31 K3: keys outside the rebalanced range keep their routes
    e = engine(spark, "db_range", meta=range_meta(spark), range_size=100)
    movement.rebalance(orders(spark, sf_dir, e=e), to="s1", start=300, end=650)
    return routes(spark, sf_dir, e)


@query
def config_after_rebalance(spark, sf_dir):  # A32 K3
    ranges = (KeyRange(None, 499, "s1"), KeyRange(300, 999, "s2"), KeyRange(1000, None, "s3"))
    e = engine(spark, "range", ranges=ranges)
    movement.rebalance(orders(spark, sf_dir, e=e), to="s3", start=400, end=1200)
    return routes(spark, sf_dir, e)


@query
def mapping_row_moved(spark, sf_dir):  # A30 K2
    rows = [("shard:orders1", "s3"), ("shard:orders2", '["s2","s1"]'), ("shard:orders3", '["s1"]'), ("shard:users5", "s3")]
    e = engine(spark, "redis", meta=Metadata(spark, mapping=spark.createDataFrame(rows, SCHEMAS["mapping"])))
    movement.rebalance(orders(spark, sf_dir, e=e), to="s3")
    return e.meta.tables["mapping"]


@query
def record_replica(spark, sf_dir):  # A28: a replica of a key's range, slot and mapping, stored or not
    kept = "array_join(coalesce(replicas, array()), ',') AS replicas"
    ranges = engine(spark, "db_range", meta=range_meta(spark), range_size=100)
    slots = engine(spark, "db_hash_range", meta=slot_meta(spark), slot_size=1_000_000_000)
    mapping = engine(spark, "redis", meta=Metadata(spark, mapping=spark.createDataFrame([("shard:orders1", "s3")], SCHEMAS["mapping"])))
    for key, name in ((650, "s2"), (650, "s3"), (2500, "s1")):
        for e in (ranges, slots, mapping):
            e.record_replica("orders", key, name)
    mapping.record_replica("orders", 1, "s2")
    found = ranges.meta.tables["ranges"].selectExpr("'range' AS kind", "concat(table, ':', start, ':', end) AS place", "connection", kept)
    found = found.unionByName(slots.meta.tables["slots"].selectExpr("'slot' AS kind", "concat(table, ':', slot) AS place", "connection", kept))
    return found.unionByName(mapping.meta.tables["mapping"].selectExpr("'key' AS kind", "k AS place", "v AS connection", "'' AS replicas"))


@query
def find_after_rebalance(spark, sf_dir):  # B10 A18 A19: rows are found wherever a rebalance has left them
    keys = [3, 250, 299, 300, 400, 401, 599, 600, 650, 651, 660, 699, 700, 1000, 1234]
    cases = [
        ("slots", engine(spark, "db_hash_range", weights={"s1": 1, "s2": 1}), {"source": "s1", "to": "s2", "end": 599}),
        ("ranges", engine(spark, "db_range", meta=range_meta(spark), range_size=100), {"to": "s1", "start": 300, "end": 650}),
        ("source", engine(spark, "db_range", meta=range_meta(spark), range_size=100), {"source": "s2", "to": "s1", "start": 300, "end": 650}),
        ("open", engine(spark, "db_range", meta=range_meta(spark), range_size=100), {"to": "s3", "end": 400}),
    ]
    found = []
    for kind, e, moves in cases:
        q = movement.rebalance(orders(spark, sf_dir, e=e), **moves).table.query()
        rows = [q.where_in("o_orderkey", keys).get("o_orderkey", SHARD), *(q.find(k).select("o_orderkey", SHARD) for k in (300, 660))]
        found += [r.select(F.lit(f"{kind} {how}").alias("kind"), "o_orderkey", F.col(SHARD).alias("shard")) for r, how in zip(rows, ("in", "find", "find"), strict=True)]
    return reduce(DataFrame.unionByName, found)


# set-up and checks ------------------------------------------------------------------------------------------------

DEFINITIONS = "s1:db1:3306:shards;s2:db2::shards;bad::3306:x;s3:db3:4400:other"


@query
def parse_definitions(spark, sf_dir):  # A1 A7 A8 A9 A10
    env = {"DB_PORT": "4406", "DB_USERNAME": "app", "DB_SHARD_MIGRATIONS": "s2;s3"}
    weights, migrating = parse_weights(DEFINITIONS, env), parse_migrating(None, env)
    rows = [(n, o["host"], o["port"], o["database"], o["driver"], o["username"], weights[n], n in migrating) for n, o in parse_shards(DEFINITIONS, env).items()]
    return spark.createDataFrame(rows, "name string, host string, port string, database string, driver string, username string, weight long, migrating boolean")


@query
def explain_routes(spark, sf_dir):  # A21 C9 C10 C13 C14: keys are explained one by one
    e = engine(spark)
    keys = [r[0] for r in read(spark, sf_dir, "nation", "n_nationkey").collect()]
    found = [e.explain_route("orders", k) for k in keys]
    rows = [(e.key("orders"), k, f["group"], f["strategy"], f["connection"], ",".join(f["replicas"])) for k, f in zip(keys, found, strict=True)]
    return spark.createDataFrame(rows, "column string, k long, group string, strategy string, connection string, replicas string")


@query
def cursor_scan(spark, sf_dir):  # A4: rows come to the client in order, a partition at a time
    rows = orders(spark, sf_dir, "o_totalprice").query().order_by("o_totalprice", descending=True).limit(100).lazy()
    return spark.createDataFrame([(i, r["o_orderkey"], r["o_totalprice"]) for i, r in enumerate(rows)], "place long, o_orderkey long, o_totalprice double")


@query
def rebalance_rules(spark, sf_dir):  # C11 C12 K1
    found = []
    for name in ("hash", "range", "db_range", "db_hash_range", "redis"):
        e, error = engine(spark, name), None
        if not strategy_for(e.config.placement("orders")).can_rebalance:
            try:
                movement.rebalance(piled(spark, sf_dir, e), to="s2")
            except ValueError as x:
                error = str(x)
        found.append((name, error is None, error))
    return spark.createDataFrame(found, "strategy string, can_rebalance boolean, error string")


@query
def rebalance_metrics(spark, sf_dir):  # K6 E3
    counted = []
    e = engine(spark, "db_range", meta=range_meta(spark), range_size=100)
    movement.rebalance(piled(spark, sf_dir, e), source="s1", to="s3", start=250, end=1199, metrics=lambda name, n: counted.append((name, n)))
    return spark.createDataFrame(counted, "name string, n long")


@query
def foreign_keys(spark, sf_dir):  # D14 L8
    keys = {"lineitem": ("orders", "part"), "orders": ("customer",), "customer": ("nation",)}
    config = ShardConfig(WEIGHTS, {t: TableConfig(foreign_keys=k) for t, k in keys.items()})
    names = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
    return spark.createDataFrame([(n, has_foreign_keys(config, n)) for n in names], "table string, tied boolean")


@query
def broken_keys(spark, sf_dir):  # L7
    texts = ["Duplicate entry 7 for key PRIMARY", "UNIQUE constraint failed: items.id", "duplicate key value violates unique constraint", "syntax error at or near", "deadlock found"]
    return spark.createDataFrame([(t, broke_unique_key(RuntimeError(t))) for t in texts], "message string, broke boolean")


def stored(spark: SparkSession, sf_dir: str, e: ShardEngine) -> ShardStore:
    """An empty store for orders' keys."""
    store = ShardStore(spark, scratch_path(spark, "orders-store"), read(spark, sf_dir, "orders", "o_orderkey").schema)
    e.migrate({"orders": store})
    return store


def shards_of(df: DataFrame) -> DataFrame:
    return df.groupBy(F.col(SHARD).alias("shard"), REPLICA).agg(F.count(F.lit(1)).alias("rows"), F.sum("o_orderkey").alias("keys"))


@query
def store_shards(spark, sf_dir):  # A20 A33
    e = engine(spark)
    store = stored(spark, sf_dir, e)
    store.append(orders(spark, sf_dir, e=e).df.select(*store.schema.names))
    return shards_of(e.open("orders", store).query(include_replicas=True).df)


@query
def stream_ingest(spark, sf_dir):  # streaming: routed, fanned out and stored, micro-batch by micro-batch
    e = engine(spark)
    store = stored(spark, sf_dir, e)
    stream = spark.readStream.schema(read(spark, sf_dir, "orders", "o_orderkey").schema).option("pathGlobFilter", "orders.parquet").parquet(sf_dir)
    ingest(stream, e.open("orders", store), store, scratch_path(spark, "orders-checkpoint")).awaitTermination()
    return shards_of(store.read())
