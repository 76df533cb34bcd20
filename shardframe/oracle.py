"""The queries' SQL for DuckDB, which has no CRC-32: it is spelled out over the byte table of its polynomial."""

from __future__ import annotations


def byte_table() -> str:
    found = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        found.append(n)
    return f"{found}::BIGINT[]"


def crc(text: str) -> str:
    """CRC-32 of an ASCII text."""
    chars = f"list_transform(string_split(({text})::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)"
    step = f"lambda a, b: xor(a >> 8, ({byte_table()})[(xor(a, b) & 255) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {chars}), {step}), 4294967295::BIGINT)"


#: Hashes of the distinct numbers, once each.
def hashed(values: str) -> str:
    return f"(SELECT k, {crc('k')} AS h FROM (SELECT DISTINCT {values}))"


def weighted(h: str) -> str:
    return f"(CASE WHEN {h} % 4 < 2 THEN 's1' WHEN {h} % 4 < 3 THEN 's2' ELSE 's3' END)"


def ring1(p: str) -> str:
    return f"(CASE {p} WHEN 's1' THEN 's2' WHEN 's2' THEN 's3' ELSE 's1' END)"


KEYS = hashed("o_orderkey AS k FROM orders")
PLACED = f"(SELECT k AS o_orderkey, {weighted('h')} AS shard FROM {KEYS})"
START = "((k - 1) - (k - 1) % {0} + 1)"
STORED = "(SELECT * FROM (VALUES (1, 400, 's1', ''), (401, 1000, 's2', 's1'), (600, 699, 's3', '')) v(start, \"end\", connection, replicas))"
SLOTS = "(SELECT * FROM (VALUES (0, 's3', ''), (841, 's2', 's3'), (2212, 's1', ''), (3678, 's3', 's1')) v(slot, connection, replicas))"
EVENTS = "(SELECT *, CASE WHEN event_id % 2 = 0 THEN 'customer' ELSE 'supplier' END AS owner_type FROM events)"
TAGS = f"(SELECT DISTINCT user_id AS tagged, event_id % 7 AS tag, owner_type FROM {EVENTS})"


def route(p: str) -> str:
    return f"{p} || ',' || {ring1(p)}"


#: The route of each order by the stored ranges: of several the one that starts last, else the hash of the aligned start.
STORED_ROUTE = f"""(        WITH hit AS (SELECT o_orderkey AS k, arg_max(r.connection, r.start) AS c, arg_max(r.replicas, r.start) AS rep FROM orders JOIN {STORED} r ON o_orderkey BETWEEN r.start AND r."end" GROUP BY 1),
        miss AS (SELECT o_orderkey AS k, {START.format(100).replace('k', 'o_orderkey')} AS start FROM orders ANTI JOIN hit ON o_orderkey = hit.k),
        starts AS (SELECT k AS start, {weighted('h')} AS p FROM {hashed('start AS k FROM miss')})
        SELECT k AS o_orderkey, CASE WHEN rep <> '' THEN c || ',' || rep ELSE {route('c')} END AS route FROM hit
        UNION ALL SELECT miss.k, {route('p')} FROM miss JOIN starts USING (start))"""

#: All orders on the shards of their routes.
STORED_SHARDS = f"""
    WITH p AS {PLACED}, r AS (SELECT o_orderkey, shard, false AS is_replica FROM p UNION ALL SELECT o_orderkey, {ring1('shard')}, true FROM p)
    SELECT shard, is_replica, count(*) AS rows, sum(o_orderkey)::BIGINT AS keys FROM r GROUP BY shard, is_replica"""

ORACLE: dict[str, str] = {
    "route_hash": f"SELECT k AS o_orderkey, (['a', 'b', 'c'])[h % 3 + 1] AS route FROM {KEYS}",
    "route_weighted": f"SELECT o_orderkey, shard AS route FROM {PLACED}",
    "route_replicas": f"SELECT o_orderkey, shard || CASE shard WHEN 's1' THEN ',s2,s3' WHEN 's2' THEN ',s3,s1' ELSE ',s1,s2' END AS route FROM {PLACED}",
    "route_range": f"SELECT o_orderkey, {route('p')} AS route FROM (SELECT o_orderkey, CASE WHEN o_orderkey <= 499 THEN 's1' WHEN o_orderkey <= 999 THEN 's2' ELSE 's3' END AS p FROM orders)",
    "route_db_range": f"SELECT * FROM {STORED_ROUTE}",
    "route_slots": f"""
        WITH own AS (SELECT k, h // 1000000 AS slot FROM {KEYS}),
        free AS (SELECT k AS slot, {weighted('h')} AS p FROM {hashed('slot AS k FROM own')})
        SELECT own.k AS o_orderkey, CASE WHEN s.slot IS NULL THEN {route('p')} WHEN s.replicas <> '' THEN s.connection || ',' || s.replicas ELSE {route('s.connection')} END AS route
        FROM own JOIN free USING (slot) LEFT JOIN {SLOTS} s ON s.slot = own.slot""",
    "route_kv": f"SELECT o_orderkey, CASE o_orderkey WHEN 1 THEN 's3,s1' WHEN 2 THEN 's2,s1' WHEN 3 THEN 's1' ELSE {route('shard')} END AS route FROM {PLACED}",
    "route_migrating": f"SELECT k AS o_orderkey, CASE WHEN h % 3 < 2 THEN 's1,s3' ELSE 's3,s1' END AS route FROM {KEYS}",
    "route_group": f"SELECT shard, count(*) AS items, sum(l_quantity) AS quantity FROM lineitem JOIN {PLACED} p ON l_orderkey = p.o_orderkey GROUP BY shard",
    "shard_counts": f"SELECT shard, count(*) AS rows FROM {PLACED} GROUP BY shard",
    "scan_merge": f"SELECT o_orderkey, o_totalprice, shard, row_number() OVER (ORDER BY o_totalprice DESC NULLS LAST, shard, o_orderkey) - 1 AS place FROM orders JOIN {PLACED} USING (o_orderkey)",
    "filter_project": f"SELECT o_orderkey, o_totalprice FROM orders JOIN {PLACED} USING (o_orderkey) WHERE shard = 's1' AND o_orderstatus = 'F' AND o_totalprice BETWEEN 1000 AND 200000 AND (o_custkey < 500 OR o_custkey > 1000)",
    "where_in_keys": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (3, 5, 8, 13, 21, 34, 55, 89, 144)",
    "find_pruned": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 1234",
    "limit_offset": f"SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC NULLS LAST, shard, o_orderkey) - 26 AS place FROM orders JOIN {PLACED} USING (o_orderkey) ORDER BY place LIMIT 50 OFFSET 25",
    "limit_only": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 7",
    "offset_only": "SELECT o_orderkey FROM orders ORDER BY o_orderkey OFFSET 1000",
    "order_multi": f"SELECT o_orderkey, o_orderpriority, o_totalprice, row_number() OVER (ORDER BY o_orderpriority NULLS FIRST, o_totalprice DESC NULLS LAST, shard, o_orderkey) - 1 AS place FROM orders JOIN {PLACED} USING (o_orderkey) ORDER BY place LIMIT 100",
    "paginate_page": "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 10",
    "paginate_total": "SELECT count(*) AS total, 10 AS per_page, 3 AS page, ceil(count(*) / 10)::INT AS last_page FROM orders",
    "keyset_page": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 20",
    "chunk_ids": f"SELECT o_orderkey, shard, (row_number() OVER (PARTITION BY shard ORDER BY o_orderkey) - 1) // 100 AS chunk FROM {PLACED}",
    "chunk_by_id": f"SELECT shard, chunk, count(*) AS rows, max(o_custkey) AS last FROM (SELECT shard, o_custkey, (row_number() OVER (PARTITION BY shard ORDER BY o_custkey, o_orderkey) - 1) // 64 AS chunk FROM orders JOIN {PLACED} USING (o_orderkey)) GROUP BY shard, chunk",
    "first_match": f"SELECT o_orderkey, shard FROM orders JOIN {PLACED} USING (o_orderkey) WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' ORDER BY shard, o_orderkey LIMIT 1",
    "replica_filter": f"""
        WITH p AS {PLACED}, r AS (SELECT shard, {ring1('shard')} AS other FROM p)
        SELECT shard, count(*) AS rows, 'all' AS "view" FROM (SELECT shard FROM r UNION ALL SELECT other FROM r) GROUP BY shard
        UNION ALL SELECT shard, count(*), 'primary' FROM r GROUP BY shard""",
    "agg_global": "SELECT count(*) AS n, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total, min(o_totalprice) AS least, max(o_totalprice) AS most FROM orders",
    "agg_group": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, max(o_totalprice) AS most FROM orders GROUP BY ALL HAVING count(*) > 10",
    "distinct_keys": "SELECT DISTINCT o_custkey, o_orderstatus FROM orders",
    "union_shards": "SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' UNION SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'",
    "intersect_shards": "SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'",
    "except_shards": "SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'",
    "semi_exists": "SELECT o_orderkey, o_custkey FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING')",
    "anti_missing": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')",
    "range_join": f"""
        SELECT start, connection, count(*) AS rows, max(price) AS most FROM (
            SELECT max(r.start) AS start, arg_max(r.connection, r.start) AS connection, any_value(o_totalprice) AS price
            FROM orders JOIN {STORED} r ON o_orderkey BETWEEN r.start AND r."end" GROUP BY o_orderkey) GROUP BY start, connection""",
    "belongs_to": "SELECT o_orderkey, fk, c_name AS name FROM (SELECT o_orderkey, CASE WHEN o_custkey % 10 <> 0 THEN o_custkey END AS fk FROM orders) LEFT JOIN customer ON fk = c_custkey",
    "has_one": "SELECT c_custkey, min(o_orderkey) AS o_orderkey, arg_min(o_totalprice, o_orderkey) AS o_totalprice FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey",
    "has_many": "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey",
    "eager_load": "SELECT c_custkey, count(o_orderkey) AS n, coalesce(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey), '') AS keys FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey",
    "has_many_through": "SELECT r_name, c_custkey FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey",
    "has_one_through": "SELECT r_name, min(c_custkey) AS c_custkey FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY r_name",
    "belongs_to_many": "SELECT p_brand AS brand, count(*) AS pairs, count(DISTINCT o_orderkey) AS orders FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY p_brand",
    "morph_one": f"SELECT c_custkey, min(event_id) AS event_id FROM customer LEFT JOIN {EVENTS} e ON owner_type = 'customer' AND user_id = c_custkey GROUP BY c_custkey",
    "morph_many": f"SELECT s_suppkey, event_id FROM supplier LEFT JOIN {EVENTS} e ON owner_type = 'supplier' AND user_id = s_suppkey",
    "morph_to": f"SELECT event_id, owner_type, coalesce(c_name, s_name) AS owner FROM {EVENTS} e LEFT JOIN customer ON owner_type = 'customer' AND user_id = c_custkey LEFT JOIN supplier ON owner_type = 'supplier' AND user_id = s_suppkey",
    "morph_to_many": f"SELECT c_custkey, n_name FROM customer JOIN {TAGS} t ON owner_type = 'customer' AND tagged = c_custkey JOIN nation ON tag = n_nationkey",
    "morphed_by_many": f"SELECT n_name, count(*) AS customers FROM customer JOIN {TAGS} t ON owner_type = 'customer' AND tagged = c_custkey JOIN nation ON tag = n_nationkey GROUP BY n_name",
    "replica_fanout": f"""
        WITH p AS {PLACED}
        SELECT o_orderkey, s AS shard, s <> shard AS is_replica FROM p, (VALUES ('s1'), ('s2'), ('s3')) v(s)""",
    "insert_route": f"""
        WITH s AS (SELECT DISTINCT {START.format(250).replace('k', 'o_orderkey')} AS start FROM orders)
        SELECT k AS start, k + 249 AS "end", p AS connection, {ring1('p')} AS replicas FROM (SELECT k, {weighted('h')} AS p FROM {hashed('start AS k FROM s')})""",
    "insert_slots": f"""
        WITH s AS (SELECT DISTINCT h // 100000000 AS slot FROM {KEYS})
        SELECT k AS slot, p AS connection, {ring1('p')} AS replicas FROM (SELECT k, {weighted('h')} AS p FROM {hashed('slot AS k FROM s')})""",
    "insert_mapping": f"""SELECT 'o:' || o_orderkey AS k, '["' || shard || '","' || {ring1('shard')} || '"]' AS v FROM {PLACED}""",
    "first_or_create": f"SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus ELSE 'new' END AS o_orderstatus, shard FROM orders JOIN {PLACED} USING (o_orderkey)",
    "update_or_create": f"""
        WITH p AS (SELECT o_orderkey, 'u' || o_orderkey AS o_orderstatus, shard FROM orders JOIN {PLACED} USING (o_orderkey))
        SELECT o_orderkey, o_orderstatus, shard, false AS is_replica FROM p UNION ALL SELECT o_orderkey, o_orderstatus, {ring1('shard')}, true FROM p""",
    "seq_ids": """
        WITH n AS (SELECT count(*) FILTER (n_nationkey % 5 <> 0) AS n FROM nation)
        SELECT n_nationkey AS k, n_nationkey::BIGINT + 1000 AS id FROM nation WHERE n_nationkey % 5 = 0 AND n_nationkey > 0
        UNION ALL SELECT NULL, 1000 FROM nation WHERE n_nationkey = 0
        UNION ALL SELECT NULL, unnest(range(42, 42 + n)) FROM n UNION ALL SELECT -1, 41 + n FROM n""",
    "snowflake_ids": "SELECT unnest(range(count(*))) AS place FROM orders",
    "distribute_plan": f"SELECT 's1' AS source, shard AS target, count(*) AS rows FROM {PLACED} WHERE shard <> 's1' GROUP BY shard",
    "rebalance_to": "SELECT o_orderkey, CASE WHEN o_orderkey BETWEEN 250 AND 1199 THEN 's3' ELSE 's1' END AS shard, false AS is_replica FROM orders",
    "rebalance_range": "SELECT o_orderkey, CASE WHEN o_orderkey NOT BETWEEN 100 AND 899 THEN 's1' WHEN o_orderkey <= 499 THEN 's2' ELSE 's3' END AS shard FROM orders",
    "rebalance_swap": f"""
        WITH own AS (SELECT k, h // 1000000 AS slot FROM {KEYS}),
        p AS (SELECT own.k, f.h % 2 AS on2 FROM own JOIN {hashed('slot AS k FROM own')} f ON f.k = own.slot),
        q AS (SELECT k, CASE WHEN on2 = 1 OR k <= 599 THEN 's2' ELSE 's1' END AS shard FROM p)
        SELECT k AS o_orderkey, shard, false AS is_replica FROM q UNION ALL SELECT k, CASE shard WHEN 's1' THEN 's2' ELSE 's1' END, true FROM q""",
    "slot_row_moved": f"""
        WITH old AS (SELECT * FROM {SLOTS}), used AS (SELECT DISTINCT h // 1000000000 AS slot FROM {KEYS}),
        p AS (SELECT u.slot, coalesce(o.connection, {weighted('f.h')}) AS c FROM used u JOIN {hashed('slot AS k FROM used')} f ON f.k = u.slot LEFT JOIN old o ON o.slot = u.slot),
        moved AS (SELECT slot FROM p WHERE c <> 's2')
        SELECT 'orders' AS "table", slot, 's2' AS connection, 's3' AS replicas FROM moved
        UNION ALL SELECT 'orders', slot, connection, replicas FROM old ANTI JOIN moved USING (slot)
        UNION ALL SELECT 'other', 7, 's3', ''""",
    "after_rebalance": f"""
        WITH old AS (SELECT * FROM {STORED}), inside AS (SELECT * FROM old WHERE start BETWEEN 300 AND 650),
        keys AS (SELECT 651 AS k UNION SELECT "end" + 1 FROM old WHERE "end" >= 650 AND "end" < (SELECT max("end") FROM inside)),
        counts AS (SELECT k, max_by(old, old.start) AS r FROM keys JOIN old ON k BETWEEN start AND "end" GROUP BY k)
        SELECT 'orders' AS "table", start, "end", connection, replicas FROM old WHERE start NOT BETWEEN 300 AND 650
        UNION ALL SELECT 'orders', k, r."end", r.connection, r.replicas FROM counts WHERE r.start BETWEEN 300 AND 650
        UNION ALL SELECT 'orders', 300, 650, 's1', 's2' UNION ALL SELECT 'other', 1001, 9000, 's3', ''""",
    "routes_after_rebalance": f"SELECT o_orderkey, CASE WHEN o_orderkey BETWEEN 300 AND 650 THEN 's1,s2' ELSE route END AS route FROM {STORED_ROUTE}",
    "config_after_rebalance": f"SELECT o_orderkey, {route('p')} AS route FROM (SELECT o_orderkey, CASE WHEN o_orderkey BETWEEN 400 AND 1200 THEN 's3' WHEN o_orderkey <= 499 THEN 's1' WHEN o_orderkey <= 999 THEN 's2' ELSE 's3' END AS p FROM orders)",
    "mapping_row_moved": f"""
        WITH p AS (SELECT o_orderkey, CASE o_orderkey WHEN 1 THEN 's3' WHEN 2 THEN 's2' WHEN 3 THEN 's1' ELSE shard END AS p FROM {PLACED})
        SELECT 'shard:orders' || o_orderkey AS k, '["s3","' || {ring1("'s3'")} || '"]' AS v FROM p WHERE p <> 's3'
        UNION ALL SELECT 'shard:orders' || o_orderkey, 's3' FROM p WHERE o_orderkey = 1 UNION ALL SELECT 'shard:users5', 's3'""",
    "record_replica": f"""
        WITH asked AS (SELECT * FROM (VALUES (650, 's2', 1), (650, 's3', 2), (2500, 's1', 3)) v(k, name, turn)),
        ranges AS (SELECT (k - 1) // 100 * 100 + 1 AS start, name, turn FROM asked),
        slots AS (SELECT h // 1000000000 AS slot, name, turn FROM asked JOIN {hashed('k FROM asked')} USING (k)),
        own AS (SELECT start, list(name ORDER BY turn) AS names FROM ranges GROUP BY start),
        cells AS (SELECT slot, list(name ORDER BY turn) AS names FROM slots GROUP BY slot),
        keys AS (SELECT k, list(name ORDER BY turn) AS names FROM asked GROUP BY k)
        SELECT 'range' AS kind, 'orders:' || start || ':' || (start + 99) AS place, names[1] AS connection, array_to_string(names[2:], ',') AS replicas FROM own
        UNION ALL SELECT 'range', 'orders:' || start || ':' || "end", connection, replicas FROM {STORED} UNION ALL SELECT 'range', 'other:1001:9000', 's3', ''
        UNION ALL SELECT 'slot', 'orders:' || slot, coalesce(s.connection, names[1]), CASE WHEN s.slot IS NULL THEN array_to_string(names[2:], ',') ELSE concat_ws(',', nullif(s.replicas, ''), array_to_string(list_filter(names, lambda x: NOT contains(s.replicas, x)), ',')) END
            FROM cells LEFT JOIN {SLOTS} s USING (slot)
        UNION ALL SELECT 'slot', 'orders:' || slot, connection, replicas FROM {SLOTS} ANTI JOIN cells USING (slot) UNION ALL SELECT 'slot', 'other:7', 's3', ''
        UNION ALL SELECT 'key', 'shard:orders' || k, '["' || array_to_string(names, '","') || '"]', '' FROM keys UNION ALL SELECT 'key', 'shard:orders1', '["s3","s2"]', ''""",
    "find_after_rebalance": f"""
        WITH own AS (SELECT k, h // 1000000 AS slot FROM {KEYS}),
        slots AS (SELECT own.k, CASE WHEN f.h % 2 = 1 OR own.k <= 599 THEN 's2' ELSE 's1' END AS shard FROM own JOIN {hashed('slot AS k FROM own')} f ON f.k = own.slot),
        stored AS (SELECT o_orderkey AS k, string_split(route, ',')[1] AS p FROM {STORED_ROUTE}),
        moved AS (SELECT 'slots' AS kind, k, shard FROM slots
            UNION ALL SELECT 'ranges', k, CASE WHEN k BETWEEN 300 AND 650 THEN 's1' ELSE p END FROM stored
            UNION ALL SELECT 'source', k, CASE WHEN k BETWEEN 300 AND 650 AND p = 's2' THEN 's1' ELSE p END FROM stored
            UNION ALL SELECT 'open', k, CASE WHEN k <= 400 THEN 's3' ELSE p END FROM stored)
        SELECT kind || ' in' AS kind, k AS o_orderkey, shard FROM moved WHERE k IN (3, 250, 299, 300, 400, 401, 599, 600, 650, 651, 660, 699, 700, 1000, 1234)
        UNION ALL SELECT kind || ' find', k, shard FROM moved WHERE k IN (300, 660)""",
    "parse_definitions": """
        WITH d AS (SELECT string_split(unnest(string_split('s1:db1:3306:shards;s2:db2::shards;bad::3306:x;s3:db3:4400:other', ';')), ':') AS p)
        SELECT p[1] AS name, p[2] AS host, coalesce(nullif(p[3], ''), '4406') AS port, p[4] AS database, 'mysql' AS driver, 'app' AS username, 1::BIGINT AS weight, p[1] IN ('s2', 's3') AS migrating
        FROM d WHERE p[1] <> '' AND p[2] <> '' AND p[4] <> ''""",
    "explain_routes": f"""SELECT 'o_orderkey' AS "column", k::BIGINT AS k, 'sales' AS "group", 'hash' AS strategy, {weighted('h')} AS connection, {ring1(weighted('h'))} AS replicas FROM {hashed('n_nationkey AS k FROM nation')}""",
    "cursor_scan": f"SELECT row_number() OVER (ORDER BY o_totalprice DESC NULLS LAST, shard, o_orderkey) - 1 AS place, o_orderkey, o_totalprice FROM orders JOIN {PLACED} USING (o_orderkey) ORDER BY place LIMIT 100",
    "rebalance_rules": "SELECT s AS strategy, s <> 'hash' AS can_rebalance, CASE WHEN s = 'hash' THEN 'Rebalancing is not supported for ' || s || ' strategy.' END AS error FROM (VALUES ('hash'), ('range'), ('db_range'), ('db_hash_range'), ('redis')) v(s)",
    "rebalance_metrics": "SELECT 'shards.rebalance.moved' AS name, count(*) AS n FROM orders WHERE o_orderkey BETWEEN 250 AND 1199",
    "foreign_keys": """
        WITH fk AS (SELECT * FROM (VALUES ('lineitem', 'orders'), ('lineitem', 'part'), ('orders', 'customer'), ('customer', 'nation')) v(a, b))
        SELECT t AS "table", t IN (SELECT a FROM fk) OR t IN (SELECT b FROM fk) AS tied FROM (VALUES ('region'), ('nation'), ('customer'), ('supplier'), ('part'), ('orders'), ('lineitem'), ('events')) v(t)""",
    "broken_keys": """
        SELECT t AS message, contains(lower(t), 'duplicate') OR contains(lower(t), 'unique constraint') AS broke
        FROM (VALUES ('Duplicate entry 7 for key PRIMARY'), ('UNIQUE constraint failed: items.id'), ('duplicate key value violates unique constraint'), ('syntax error at or near'), ('deadlock found')) v(t)""",
    "store_shards": STORED_SHARDS,
    "stream_ingest": STORED_SHARDS,
}
