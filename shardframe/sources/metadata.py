"""Placement metadata: stored ranges, slots, key mapping and sequences, as tables of a base and what was merged since.

A merge writes its own rows only; after MOST_DELTAS of them the table is written whole. Where a path is given, each table
is kept under it as numbered folders, v= for a whole table and d= for a merge; the last complete whole one counts with the
merges after it, so that a broken write leaves what was before. Several writers may share a path: each claims the next
number by making a file that must not be there, waits for the lower ones and reads them before it makes its rows.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shardframe.config import Placement
from shardframe.sources.scratch import unsent, written

SCHEMAS = {
    "ranges": "table string, start long, end long, connection string, replicas array<string>",
    "slots": "table string, slot long, connection string, replicas array<string>",
    "mapping": "k string, v string",
    "sequences": "table string, last_id long",
}
#: A range is looked up on cells of the table's range size times a power of this; it spans so many cells at most.
FAN = 4096
LEVELS = 6
#: Merges that a read goes through before the table is written whole.
MOST_DELTAS = 8
#: Seconds after which a claim without a table is taken for a broken write.
DEAD_AFTER = 600
#: The columns by which a merge's rows replace others.
KEYS = {"ranges": ["table", "start", "end"], "slots": ["table", "slot"], "mapping": ["k"], "sequences": ["table"]}


def after_first(names: str) -> Column:
    """All of an array but its first element."""
    return F.slice(names, 2, F.size(names))


class Metadata:
    def __init__(self, spark: SparkSession, path: str | None = None, **tables: DataFrame):
        self.spark, self.path, self.version = spark, path, {}
        self.deltas = dict.fromkeys(SCHEMAS, 0)
        self.counted: dict[tuple[str, int], int] = {}
        self.tables = {name: tables.get(name) for name in SCHEMAS}
        for name, df in self.tables.items():
            if df is None:
                self.tables[name] = self._load(name)

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _load(self, name: str) -> DataFrame:
        empty = self.spark.createDataFrame([], SCHEMAS[name])
        if self.path is None:
            return empty
        jvm, fs = self._fs()
        done = []
        root = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if fs.exists(root):
            names = [s.getPath().getName() for s in fs.listStatus(root) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
            done = sorted((int(n[2:]), n[0]) for n in names)
        self.version[name] = max((n for n, _ in done), default=0)
        base, self.deltas[name] = max((n for n, kind in done if kind == "v"), default=0), 0
        read = self.spark.read.schema(SCHEMAS[name])
        found = read.parquet(f"{self.path}/{name}/v={base}") if base else empty
        for n, _ in (x for x in done if x[0] > base):
            found = self._over(name, found, read.parquet(f"{self.path}/{name}/d={n}"), n)
            self.deltas[name] += 1
        return found

    def _under_way(self, name: str, before: int) -> bool:
        """Whether another writer has claimed a lower number lately and not written it yet."""
        jvm, fs = self._fs()
        make = jvm.org.apache.hadoop.fs.Path
        for s in fs.listStatus(make(f"{self.path}/{name}")):
            kind, _, n = s.getPath().getName().partition("=")
            if kind == "claim" and int(n) < before and time.time() - s.getModificationTime() / 1000 < DEAD_AFTER:
                if not any(fs.exists(make(f"{self.path}/{name}/{k}={n}/_SUCCESS")) for k in "vd"):
                    return True
        return False

    def _made(self, name: str, n: int) -> bool:
        """Makes the file that claims the number, unless it is there. Hadoop's local file system looks before it makes a file,
        so that two writers can both make it; there the operating system's own exclusive call does it."""
        jvm, fs = self._fs()
        root = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        fs.mkdirs(root)
        at = fs.resolvePath(root).toUri()
        try:
            if at.getScheme() == "file":
                open(f"{at.getPath()}/claim={n}", "x").close()
                return True
            return fs.createNewFile(jvm.org.apache.hadoop.fs.Path(root, f"claim={n}"))
        except FileExistsError:
            return False
        except Py4JJavaError as x:  # made by another writer after createNewFile had looked
            if x.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
                return False
            raise

    def _claim(self, name: str) -> int:
        """The next number of the table, which no other writer has. Lower ones are waited for, and read."""
        self.tables[name] = self._load(name)
        n = self.version.get(name, 0) + 1
        while not self._made(name, n):
            n += 1
        while self._under_way(name, n):
            time.sleep(0.1)
        self.tables[name] = self._load(name)
        return n

    def _kept(self, name: str, kind: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """What make gives of the table as it is, stored."""
        columns = [f.name for f in self.tables[name].schema]
        if self.path is None:
            self.version[name] = self.version.get(name, 0) + 1
            return written(make(self.tables[name]).select(*columns), f"meta-{name}")
        n = self._claim(name)
        target = f"{self.path}/{name}/{kind}={n}"
        make(self.tables[name]).select(*columns).write.mode("overwrite").parquet(target)
        self.version[name] = n
        return self.spark.read.schema(SCHEMAS[name]).parquet(target)

    def _over(self, name: str, df: DataFrame, new: DataFrame, n: int) -> DataFrame:
        """df with the rows of the merge of that number, which are counted once."""
        rows = self.counted.get((name, n))
        if rows is None:
            rows = self.counted[name, n] = new.count()
        return df.join(unsent(new.select(*KEYS[name]), rows), KEYS[name], "left_anti").select(*df.columns).unionByName(new)

    def _put(self, name: str, make: Callable[[DataFrame], DataFrame]) -> None:
        self.tables[name], self.deltas[name] = self._kept(name, "v", make), 0

    def _merge(self, name: str, make: Callable[[DataFrame], DataFrame]) -> None:
        """The rows that make gives replace those with the same keys."""
        new = self._kept(name, "d", make)
        self.tables[name] = self._over(name, self.tables[name], new, self.version[name])
        self.deltas[name] += 1
        if self.deltas[name] >= MOST_DELTAS:
            self._put(name, lambda t: t)

    # look-ups of whole tables -------------------------------------------------------------------------------------

    def join_ranges(self, df: DataFrame, key: str, scope: str, size: int) -> DataFrame:
        """Adds ``_stored``, the range that holds the key: of several the one that starts last.

        A range goes to the finest level on which it spans at most FAN cells; a level is one equi-join by cell, whose
        side Spark broadcasts or not by its size."""
        ranges = self.tables["ranges"].where((F.col("table") == scope) & (F.col("end") >= F.col("start")))
        cells = [size * FAN**i for i in range(LEVELS)]
        level = F.lit(LEVELS - 1)
        for i in reversed(range(LEVELS - 1)):
            level = F.when(F.floor(F.col("end") / cells[i]) - F.floor(F.col("start") / cells[i]) < FAN, F.lit(i)).otherwise(level)
        ranges = ranges.withColumn("_level", level)
        held = []
        for i in sorted(r[0] for r in ranges.select("_level").distinct().collect()):  # LEVELS rows at most
            cell = F.explode(F.sequence(F.floor(F.col("start") / cells[i]), F.floor(F.col("end") / cells[i])))
            at = ranges.where(F.col("_level") == i).withColumn("_cell", cell)
            lists = at.groupBy("_cell").agg(F.collect_list(F.struct("start", "end", "connection", "replicas")).alias(f"_ranges{i}"))
            df = df.withColumn("_cell", F.floor(F.col(key).cast("long") / cells[i])).join(lists, "_cell", "left").drop("_cell")
            held.append(f"_ranges{i}")
        if not held:
            return df.withColumn("_stored", F.lit(None).cast("struct<start:bigint,end:bigint,connection:string,replicas:array<string>>"))
        k = F.col(key).cast("long")
        every = F.concat(*(F.coalesce(c, F.array().cast(df.schema[c].dataType)) for c in held))
        inside = F.filter(every, lambda r: (r["start"] <= k) & (r["end"] >= k))
        return df.withColumn("_stored", F.array_max(inside)).drop(*held)  # structs are ordered by their start first

    def join_slots(self, df: DataFrame, scope: str) -> DataFrame:
        own = self.tables["slots"].where(F.col("table") == scope).dropDuplicates(["slot"])
        return df.join(own.select(F.col("slot").alias("_slot"), F.struct("connection", "replicas").alias("_stored")), "_slot", "left")

    def join_mapping(self, df: DataFrame) -> DataFrame:
        """Adds ``_stored``, the list of names, and ``_bare``, whether it is one name and no list. The mapping can have a row
        for each key, so it is not broadcast."""
        names = F.when(F.col("v").startswith("["), F.from_json("v", "array<string>")).otherwise(F.array(F.regexp_replace("v", '^"|"$', "")))
        own = self.tables["mapping"].dropDuplicates(["k"])
        own = own.select(F.col("k").alias("_kv"), names.alias("_stored"), (~F.col("v").startswith("[")).alias("_bare"))
        return df.join(own.hint("merge"), "_kv", "left")

    # look-ups of one key ------------------------------------------------------------------------------------------

    def range_of(self, key: int, scope: str):
        own = self.tables["ranges"].where((F.col("table") == scope) & (F.col("start") <= key) & (F.col("end") >= key))
        return own.orderBy(F.desc("start"), F.desc("end")).first()

    def slot_of(self, slot: int, scope: str):
        return self.tables["slots"].where((F.col("table") == scope) & (F.col("slot") == slot)).first()

    def mapping_of(self, k: str) -> tuple[list[str] | None, bool]:
        row = self.tables["mapping"].where(F.col("k") == k).first()
        if row is None:
            return None, False
        return (json.loads(row["v"]), False) if row["v"].startswith("[") else ([row["v"].strip('"')], True)

    # merges -------------------------------------------------------------------------------------------------------

    def merge_ranges(self, routed: DataFrame, key: str, start: Column, place: Placement) -> None:
        """One row for each aligned range of the batch; of its keys the largest one's route counts."""
        last = routed.where(F.col(key).isNotNull()).groupBy(start.alias("start")).agg(F.max_by("_route", key).alias("r"))
        new = last.select(F.lit(place.scope).alias("table"), "start", (F.col("start") + place.own.range_size - 1).alias("end"), F.col("r")[0].alias("connection"), after_first("r").alias("replicas"))
        self._merge("ranges", lambda _: new)

    def merge_slots(self, routed: DataFrame, key: str, slot: Column, place: Placement) -> None:
        last = routed.where(F.col(key).isNotNull()).groupBy(slot.alias("slot")).agg(F.max_by("_route", F.col(key)).alias("r"))
        new = last.select(F.lit(place.scope).alias("table"), "slot", F.col("r")[0].alias("connection"), after_first("r").alias("replicas"))
        self._merge("slots", lambda _: new)

    def put_mapping(self, new: DataFrame) -> None:
        self._merge("mapping", lambda _: new.dropDuplicates(["k"]))

    def put_range(self, scope: str, start: int, end: int | None, connection: str, replicas: list[str], size: int) -> None:
        """Stores a range, and leaves every key outside it with the range that it had.

        Of overlapping ranges the one that starts last counts. So those that start before keep their rows: they lose to the
        new one inside, and stand as they did outside. Those that start inside give way; where one of them counted beyond
        the end, a piece of it is stored. Such pieces begin right after the end or after the end of another range, and what
        counts there is looked up for all these keys in one join."""
        end = 2**63 - 1 if end is None else end
        own = (F.col("table") == scope) & (F.col("end") >= F.col("start"))
        inside = own & F.col("start").between(start, end)

        def make(t: DataFrame) -> DataFrame:
            rows = t.where(~inside).unionByName(self.spark.createDataFrame([(scope, start, end, connection, replicas)], SCHEMAS["ranges"]))
            last = t.where(inside).agg(F.max("end")).first()[0]
            if last is None or last <= end:
                return rows
            after = t.where(own & (F.col("end") >= end) & (F.col("end") < last)).select((F.col("end") + 1).alias("k"))
            keys = after.unionByName(self.spark.createDataFrame([(end + 1,)], "k long")).distinct()
            counts = self.join_ranges(keys, "k", scope, size).where(F.col("_stored.start").between(start, end))
            return rows.unionByName(counts.select(F.lit(scope).alias("table"), F.col("k").alias("start"), "_stored.end", "_stored.connection", "_stored.replicas"))

        self._put("ranges", make)

    def _add_replica(self, name: str, found: Column, new: DataFrame, connection: str) -> None:
        more = F.when(found, F.array_union(F.coalesce("replicas", F.array().cast("array<string>")), F.array(F.lit(connection)))).otherwise(F.col("replicas"))
        self._put(name, lambda t: t.unionByName(new) if t.where(found).isEmpty() else t.withColumn("replicas", more))

    def add_range_replica(self, scope: str, start: int, end: int, connection: str) -> None:
        """Adds the replica to the stored range; one that is missing is stored with the name as its primary."""
        new = self.spark.createDataFrame([(scope, start, end, connection, [])], SCHEMAS["ranges"])
        self._add_replica("ranges", (F.col("table") == scope) & (F.col("start") == start) & (F.col("end") == end), new, connection)

    def add_slot_replica(self, scope: str, slot: int, connection: str) -> None:
        new = self.spark.createDataFrame([(scope, slot, connection, [])], SCHEMAS["slots"])
        self._add_replica("slots", (F.col("table") == scope) & (F.col("slot") == slot), new, connection)

    def add_mapping_replica(self, k: str, connection: str) -> None:
        stored, _ = self.mapping_of(k)
        names = stored or []
        if connection not in names:
            self.put_mapping(self.spark.createDataFrame([(k, json.dumps([*names, connection], separators=(",", ":")))], SCHEMAS["mapping"]))

    def move_slots(self, moves: DataFrame, place: Placement, ring: Callable) -> None:
        """moves: slot, to. A replica that becomes primary swaps places with the old one; a slot without replicas gets
        the ring's."""
        old = self.tables["slots"].where(F.col("table") == place.scope).select("slot", F.col("connection").alias("old"), F.coalesce("replicas", F.array().cast("array<string>")).alias("had"))
        swapped = F.transform("had", lambda r: F.when(r == F.col("to"), F.col("old")).otherwise(r))
        replicas = F.when(F.size("had") > 0, swapped).otherwise(ring(F.col("to"), place.connections, place.replica_count))
        new = moves.join(old, "slot", "left").select(F.lit(place.scope).alias("table"), "slot", F.col("to").alias("connection"), replicas.alias("replicas"))
        self._merge("slots", lambda _: new)

    def move_mapping(self, moves: DataFrame, place: Placement, ring: Callable) -> None:
        """moves: k, to. As for slots, but a key whose replicas do not hold the new primary gets the ring's."""
        at = self.join_mapping(moves.withColumnRenamed("k", "_kv"))
        had, old = after_first("_stored"), F.col("_stored")[0]
        swapped = F.transform(had, lambda r: F.when(r == F.col("to"), old).otherwise(r))
        replicas = F.when(F.array_contains(had, F.col("to")), swapped).otherwise(ring(F.col("to"), place.connections, place.replica_count))
        self.put_mapping(written(at.select(F.col("_kv").alias("k"), F.to_json(F.concat(F.array("to"), replicas)).alias("v")), "moved-keys"))

    def reserve(self, table: str, n: int) -> int:
        """Reserves n numbers of the table's sequence and returns the last one given out before."""
        last = []

        def make(t: DataFrame) -> DataFrame:
            row = t.where(F.col("table") == table).first()
            last.append(row["last_id"] if row else 0)
            return self.spark.createDataFrame([(table, last[0] + n)], SCHEMAS["sequences"])

        self._merge("sequences", make)
        return last[0]
