"""Queries of writes over whole tables, against plain Python over the same rows."""

from shardframe import queries

SF = "/root/testdata/sf0.01"


def keys_of(spark):
    return [r[0] for r in queries.read(spark, SF, "orders", "o_orderkey").collect()]


def test_ranges_of_all_orders_are_stored(spark):
    rows = queries.QUERIES["insert_route"](spark, SF).collect()
    e = queries.engine(spark, "db_range", range_size=250)
    starts = sorted({int((k - 1) / 250) * 250 + 1 for k in keys_of(spark)})  # truncated, as key 0 has it
    assert sorted(r["start"] for r in rows) == starts and len(starts) > 4
    for r in rows:
        primary, *replicas = e.connection_for("orders", r["start"])
        assert (r["end"], r["connection"], r["replicas"]) == (r["start"] + 249, primary, ",".join(replicas))


def placed(spark, orders):
    """Shards of each key's route, the primary first."""
    at = queries.engine(spark).with_route(orders.select("o_orderkey"), "orders")
    return {r["o_orderkey"]: r["_route"] for r in at.collect()}


def test_all_orders_are_found_or_created(spark):
    orders = queries.read(spark, SF, "orders", "o_orderkey", "o_orderstatus")
    route = placed(spark, orders)
    want = sorted((k, "new" if s == "P" else s, route[k][0]) for k, s in orders.collect())
    assert sorted(map(tuple, queries.QUERIES["first_or_create"](spark, SF).collect())) == want
    assert len(want) == 15_000 and len({s for _, s, _ in want}) == 3


def test_all_orders_are_updated_or_created(spark):
    route = placed(spark, queries.read(spark, SF, "orders", "o_orderkey"))
    want = sorted((k, f"u{k}", shard, i > 0) for k, shards in route.items() for i, shard in enumerate(shards))
    assert sorted(map(tuple, queries.QUERIES["update_or_create"](spark, SF).collect())) == want
    assert len(want) == 30_000
