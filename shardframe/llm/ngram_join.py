"""N-gram Jaccard self-join by set relations: index lists skipped in blocks, and answers derived from similar sets.

Equal sets are one unit. The exchange tells each unit which of its shingles other units have too; a unit with a link has at
least the threshold's share of those, so the other units are done, and those left are joined on their shared shingles alone.

Their order is global: shingles of one unit alone first, then the shared ones from the rarest on, as a table of counters
of fixed size has them (any one order is right; a good one keeps passages of many documents out of the index). Two sets
over the threshold meet in the first (size - least overlap + 1) places of both, so only those are indexed. A list of the
index is sorted by size and position and cut into blocks: a set skips the blocks whose sizes or positions rule out the
overlap. If few pairs are left, all of them are compared, and the list is done. Else each of its sets is paired with the
list's most central one, whose shingles are the most common, and links make components.

What is open then lies between the components of a list. In further rounds the sets ask the most central set of another
component, until few pairs are left or a round has hardly made them fewer. Then each set outside its list's largest
component asks that component as a family, unless the bounds of the family's block rule it out; and sets outside are
compared with each other if blocks and parity sketches allow. A family's answers derive from one: the asks are counted
against its middle, and a member's overlap is the middle's, less what the member lacks of it, and what it has beside it;
members whose difference cannot make up the overlap are skipped. So no link between components is lost.

Defined cases: words are taken after lower-casing A-Z only; null text counts as empty, has an empty set, links with nothing
and is its own component; with fewer words than the shingle's, the whole sequence is the one shingle. Each input row gives
one row, and components go by texts: rows of one doc_id with texts that do not link are in components of their own (the SQL
goes by doc_id, and agrees where ids are not repeated). A row with null doc_id passes links on, and its component is the
smallest id that there is, else null. An empty table gives no rows. Shingles are told apart by 64-bit
hashes, of which 48 bits and the range of the hash space travel. Columns beside doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardframe.llm.common import join_groups, partitions_for, texts, written
from shardframe.llm.components import components
from shardframe.llm.exchange import batches_of, range_of, shared_keys
from shardframe.llm.wordhash import EMPTY, mix, text_hash, window_hashes, word_hashes

#: Lists of so many entries are compared at once, all with each other; longer ones if their blocks leave few pairs.
SHORT = 4
#: Entries of a list that are skipped together.
BLOCK = 64
#: Few: pairs for each entry of a list.
FEW_PAIRS = 4
#: Pairs of an entry and a component that it is not in, for each entry of the open lists, that are left to the last round.
LAST_PAIRS = 64
#: Entries of a list's part.
PART_ROWS = 4096
#: Entries of a part where entries are compared by their sketches: two parts are a task's work, each pair of parts is one.
OUTSIDE_ROWS = 64
#: Bytes of keys in a part of a family, or of its asks.
PART_BYTES = 256 << 10
#: Cut families whose number of parts is sent to every task; beyond it they are joined.
SENT_FAMILIES = 100_000
#: Counters of the shingles' order.
COUNTERS = 1 << 22


def sets_of(found: list[str], width: int) -> Iterator[tuple[int, np.ndarray, None]]:
    """(unit, distinct shingles sorted, None) of each text; unit is a hash of the set, 0 for the empty one."""
    words, begin = word_hashes([t.encode().lower() for t in found])
    windows = window_hashes(words, width)
    for a, b in zip(begin[:-1], begin[1:], strict=True):
        n = b - a
        if n >= width:
            own = np.unique(windows[a : b - width + 1])
        elif n:
            own = np.array([text_hash(words[a:b])], np.int64).view(np.uint64)
        else:
            own = EMPTY
        yield text_hash(own) if n else 0, own, None


def units(docs: DataFrame, width: int, *more: str) -> DataFrame:
    """doc_id, n_shingles, unit of each row of docs, and its columns named by more, which are long."""

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in batches_of(batches):
            for b in held:
                got = [(unit, len(own)) for unit, own, _ in sets_of(b.column("text").to_pylist(), width)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([n for _, n in got], pa.int64()), pa.array([u for u, _ in got], pa.int64()), *(b.column(c) for c in more)], ["doc_id", "n_shingles", "unit", *more])

    return texts(docs, *more).mapInArrow(measure, ", ".join(f"{c} long" for c in ("doc_id", "n_shingles", "unit", *more)))


def overlap_needed(a, b, percent: int):
    """The least overlap of sets of sizes a and b: 100 * overlap >= percent * union."""
    return -((-percent * (a + b)) // (100 + percent))


def counters(sets: DataFrame) -> np.ndarray:
    """How many sets have a key, by the key's counter: COUNTERS numbers. Only the counts over SHORT leave the executors,
    as rows; 1 stands for the others."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = np.frombuffer(b"".join(k.as_buffer() for k in b.column("keys")), "<u8")
            at, n = np.unique(counter_of(keys), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n, pa.int64())], ["counter", "n"])

    found = sets.select("keys").mapInArrow(count, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).where(F.col("n") > SHORT).toArrow()
    total = np.ones(COUNTERS, np.uint32)
    total[found["counter"].to_numpy()] = np.minimum(found["n"].to_numpy(), 2**32 - 1)
    return total


def counter_of(keys: np.ndarray) -> np.ndarray:
    return (mix(keys) >> np.uint64(64 - COUNTERS.bit_length() + 1)).astype(np.int64)


def index_entries(sets: DataFrame, ranges: int, percent: int) -> DataFrame:
    """The first places of each set (unit, n, keys), dealt by key: at, and packed arrays.

    A list that the counters show to be long is dealt in parts by unit, and its entries say so. An entry's weight is how
    common its set's shingles are: the set in the middle of a family of near copies has the most."""
    sent = sets.sparkSession.sparkContext.broadcast(counters(sets))

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = sent.value
        for b in batches:
            unit, n = b.column("unit").to_numpy(), b.column("n").to_numpy()
            keys = [np.frombuffer(k.as_buffer(), "<u8") for k in b.column("keys")]
            counts = [count[counter_of(k)] for k in keys]
            weight = np.array([np.log2(c).sum() for c in counts]) / np.maximum(n, 1)
            alone = n - np.fromiter(map(len, keys), np.int64, len(keys))
            first = np.maximum(0, n - -(-percent * n // 100) + 1 - alone)
            order = [np.lexsort((k, c))[:f] for k, c, f in zip(keys, counts, first, strict=True)]
            keys, counts = [k[o] for k, o in zip(keys, order, strict=True)], [c[o] for c, o in zip(counts, order, strict=True)]
            who = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
            key = np.concatenate([EMPTY, *keys])
            parts = -(-np.concatenate([np.zeros(0, np.int64), *counts]).astype(np.int64) // PART_ROWS)
            salt = mix(unit.view(np.uint64))[who] % parts.astype(np.uint64)
            place = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(k)) for k in keys)]) + alone[who]
            at = range_of(mix(key + mix(salt)), ranges)
            order = np.argsort(at, kind="stable")
            bounds = np.flatnonzero(np.diff(at[order], prepend=-1, append=-1))
            rows = []
            for x, y in zip(bounds[:-1], bounds[1:], strict=True):
                o = order[x:y]
                own = who[o]
                rows.append((int(at[o[0]]), unit[own].tobytes(), n[own].astype("<u4").tobytes(), place[o].astype("<u4").tobytes(), key[o].tobytes(), weight[own].astype("<f4").tobytes(), (parts[o] > 1).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int32(), *[pa.binary()] * len(PACKED)))], ["at", *PACKED])

    return sets.select("unit", "n", "keys").mapInArrow(deal, f"at int, {', '.join(f'{c} binary' for c in PACKED)}")


#: An index entry's fields, as packed arrays.
PACKED = {"units": "<i8", "sizes": "<u4", "places": "<u4", "keys": "<u8", "weights": "<f4", "cut": "?"}


def may_link(n_a, at_a, n_b, at_b, percent: int):
    """Whether sets of these sizes that meet at these positions can reach the overlap."""
    most = np.minimum(at_a, at_b) + np.minimum(n_a - at_a, n_b - at_b)
    return most >= overlap_needed(n_a, n_b, percent)


def sketch(keys: np.ndarray) -> np.ndarray:
    """The parities of the keys' counts in bits of their hashes, at least four bits a key: two sets differ in as many keys
    as their sketches in bits, or in more."""
    bits = 1 << max(6, (4 * len(keys) - 1).bit_length())
    at = (mix(keys ^ np.uint64(0x2545F4914F6CDD1D)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=bits).astype(np.uint8) & 1, bitorder="little").view(np.uint64)


def sketched(sets: DataFrame) -> DataFrame:
    """unit, shared (the number of its keys), sketch."""

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [np.frombuffer(k.as_buffer(), "<u8") for k in b.column("keys")]
            yield pa.RecordBatch.from_arrays([b.column("unit"), pa.array(map(len, keys), pa.int64()), pa.array([sketch(k).tobytes() for k in keys], pa.binary())], ["unit", "shared", "sketch"])

    return sets.select("unit", "keys").mapInArrow(make, "unit long, shared long, sketch binary")


class Sketches:
    """Of a list's entries: which of them may reach the overlap with one of them, by their sketches."""

    def __init__(self, n: np.ndarray, shared: np.ndarray, sketches: list[np.ndarray], percent: int):
        self.n, self.shared, self.percent = n, shared, percent
        self.size = np.array([len(x) for x in sketches])
        self.folds = {}  # by length: the sketches of that length, and larger ones folded to it
        for length in np.unique(self.size).tolist():
            m = self.folds[length] = np.zeros((len(sketches), length), np.uint64)
            for k in np.flatnonzero(self.size >= length):
                m[k] = np.bitwise_xor.reduce(sketches[k].reshape(-1, length), axis=0)

    def allow(self, i: int, j: np.ndarray) -> np.ndarray:
        common, good = np.minimum(self.size[j], self.size[i]), np.zeros(len(j), bool)
        for length in np.unique(common).tolist():
            own = np.flatnonzero(common == length)
            differ = np.bitwise_count(self.folds[length][j[own]] ^ self.folds[length][i]).sum(1, dtype=np.int64)
            good[own] = self.shared[i] + self.shared[j[own]] - differ >= 2 * overlap_needed(self.n[i], self.n[j[own]], self.percent)
        return good


def block_pairs(n: np.ndarray, at: np.ndarray, percent: int, most: float = float("inf"), allow: Callable | None = None) -> tuple[np.ndarray, np.ndarray] | None:
    """The pairs (i < j) of a list's entries, sorted by size and position, that can reach the overlap, or None if they are
    more than ``most``. An entry skips the blocks whose sizes or positions rule it out, and in the others goes by entry;
    allow(i, j) says which of those stay."""
    left, right, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    starts = np.arange(0, len(n), BLOCK)
    ends = np.append(starts[1:], len(n))
    least_n, most_n = np.minimum.reduceat(n, starts), np.maximum.reduceat(n, starts)
    most_at, most_rest = np.maximum.reduceat(at, starts), np.maximum.reduceat(n - at, starts)
    for i in range(len(n)):
        possible = (most_n * 100 >= percent * n[i]) & (least_n * percent <= 100 * n[i]) & (ends > i + 1)
        possible &= np.minimum(most_at, at[i]) + np.minimum(most_rest, n[i] - at[i]) >= overlap_needed(n[i], least_n, percent)
        for k in np.flatnonzero(possible):
            j = np.arange(max(i + 1, starts[k]), ends[k])
            j = j[may_link(n[i], at[i], n[j], at[j], percent)]
            j = j[allow(i, j)] if allow and len(j) else j
            left.append(np.full(len(j), i))
            right.append(j)
            found += len(j)
        if found > most:
            return None
    return np.concatenate(left), np.concatenate(right)


def candidates(index: DataFrame, percent: int) -> DataFrame:
    """Of each range: as family and unit the pairs to compare first, and as key's rows (unit, n, place, weight) the lists
    that are open. A list is done if its blocks leave few pairs; else each of its sets is paired with the one of the
    largest weight, and it stays open. So does each part of a list that is cut."""

    def pair(table: pa.Table) -> pa.Table:
        unit, n, place, key, weight, cut = (np.concatenate([np.frombuffer(x, kind) for x in table[c].to_pylist()]) for c, kind in PACKED.items())
        n, place = n.astype(np.int64), place.astype(np.int64)
        order = np.lexsort((unit, place, n, key))
        unit, n, place, key, weight, cut = unit[order], n[order], place[order], key[order], weight[order], cut[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(first, len(key)))
        whole = ~np.logical_or.reduceat(cut, first)
        pairs = [np.zeros((2, 0), np.int64)]
        for width in range(2, SHORT + 1):  # one block each: the entries' own bounds are enough
            at = first[whole & (size == width)]
            for i in range(width):
                for j in range(i + 1, width):
                    good = may_link(n[at + i], place[at + i], n[at + j], place[at + j], percent)
                    pairs.append(np.stack([unit[at + i][good], unit[at + j][good]]))
        is_open = ~whole
        for k in np.flatnonzero(whole & (size > SHORT)):
            own = slice(first[k], first[k] + size[k])
            few = block_pairs(n[own], place[own], percent, FEW_PAIRS * size[k])
            if few is None:
                is_open[k] = True
            else:
                pairs.append(np.stack([unit[own][few[0]], unit[own][few[1]]]))
        long = np.repeat(is_open, size)
        lead = np.repeat(np.lexsort((unit, -weight, key))[first], size)
        other = np.flatnonzero(long & (unit[lead] != unit))
        good = may_link(n[lead[other]], place[lead[other]], n[other], place[other], percent)
        pairs.append(np.stack([unit[lead[other]][good], unit[other][good]]))
        found = np.unique(np.concatenate(pairs, axis=1), axis=1)
        kept, none = np.flatnonzero(long), np.full(found.shape[1], -1)
        columns = {"family": found[0], "unit": found[1], "key": none, "n": none, "place": none, "weight": none.astype("<f4")}
        rows = {"family": np.full(len(kept), -1), "unit": unit[kept], "key": key[kept].view("<i8"), "n": n[kept], "place": place[kept], "weight": weight[kept]}
        opened = pa.array(np.repeat([False, True], [found.shape[1], len(kept)]))
        return pa.table({c: pa.array(np.concatenate([columns[c], rows[c]])) for c in columns} | {"open": opened})

    return index.groupBy("at").applyInArrow(pair, "family long, unit long, key long, n long, place long, weight float, open boolean")


def answers(members: list[np.ndarray], sizes: np.ndarray, asks: list[np.ndarray], ask_sizes: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """(ask, member): for each ask that links to a member, one that it links to.

    The asks are counted against one of the members, the middle of the family. Another member's overlaps follow from those
    by its difference: less what it lacks of the middle, and what it has beside it. Members whose bounds rule out an ask
    are skipped; so an ask that is far from the middle costs no more than its count."""
    middle = members[0]
    if len(members) > 1:
        _, at, count = np.unique(np.concatenate(members), return_inverse=True, return_counts=True)
        first = np.cumsum([0, *map(len, members[:-1])])
        middle = members[int((np.add.reduceat(count[at], first) / sizes).argmax())]

    def against(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each set's bits in the middle, and the keys that it has beside it with their owners."""
        key, who = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.searchsorted(middle, key)
        inside = (at < len(middle)) & (middle[np.minimum(at, len(middle) - 1)] == key)
        bits = np.zeros((len(sets), len(middle)), bool)
        bits[who[inside], at[inside]] = True
        return np.packbits(np.pad(bits, ((0, 0), (0, -len(middle) % 64))), axis=1).view(np.uint64), key[~inside], who[~inside]

    ask_bits, ask_more, ask_who = against(asks)
    common = np.bitwise_count(ask_bits).sum(1, dtype=np.int64)
    if len(members) == 1:
        for z in np.flatnonzero(common >= overlap_needed(sizes[0], ask_sizes, percent)).tolist():
            yield z, 0
        return
    bits, more, who = against(members)
    extra, ask_extra = np.bincount(who, minlength=len(members)), np.bincount(ask_who, minlength=len(asks))
    order = np.argsort(more)
    more, who = more[order], who[order]
    ask_first = np.concatenate([[0], np.cumsum(ask_extra)])
    for z in range(len(asks)):
        need = overlap_needed(sizes, ask_sizes[z], percent)
        near = np.flatnonzero(common[z] + np.minimum(extra, ask_extra[z]) >= need)
        if not len(near):
            continue
        own = ask_more[ask_first[z] : ask_first[z + 1]]
        a, b = np.searchsorted(more, own), np.searchsorted(more, own, "right")
        beside = np.bincount(who[np.concatenate([np.arange(x, y) for x, y in zip(a, b, strict=True) if y > x] or [np.zeros(0, np.int64)])], minlength=len(members))
        overlap = np.bitwise_count(bits[near] & ask_bits[z]).sum(1, dtype=np.int64) + beside[near]
        linked = near[overlap >= need[near]]
        if len(linked):
            yield z, int(linked[0])


def compared(members: DataFrame, asks: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between members (family, unit, n) and asks (family, unit, n) of the same family, by exact overlap: one
    for each ask and task. Common shingles are shared ones, so the sets' shared keys are enough.

    A family's keys are sent once, not once for each pair. Families and asks of more than PART_BYTES are cut in parts, and
    each pair of parts is a task's work; the number of tasks follows from the bytes to send."""
    spark = sets.sparkSession
    own = members.groupBy("family").agg(F.sum(8 * F.col("n")).alias("own"))
    loads = own.join(asks.groupBy("family").agg(F.sum(8 * F.col("n")).alias("asked")), "family")
    loads = loads.select("family", "own", "asked", F.ceil((F.col("own") + 1) / PART_BYTES).alias("own_parts"), F.ceil((F.col("asked") + 1) / PART_BYTES).alias("ask_parts"))
    is_cut = (F.col("own_parts") > 1) | (F.col("ask_parts") > 1)
    row = loads.agg(F.sum(F.col("own") * F.col("ask_parts") + F.col("asked") * F.col("own_parts")).alias("total"), F.count_if(is_cut).alias("cut")).first()
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int((row["total"] or 0) // (8 * PART_BYTES)))
    cut = loads.where(is_cut).select("family", "own_parts", "ask_parts")
    cut = F.broadcast(cut) if row["cut"] <= SENT_FAMILIES else cut.hint("merge")

    def dealt(rows: DataFrame, is_ask: bool) -> DataFrame:
        at = rows.join(cut, "family", "left").na.fill(1, ["own_parts", "ask_parts"])
        parts, others = ("ask_parts", "own_parts") if is_ask else ("own_parts", "ask_parts")
        part, other = F.pmod(F.xxhash64("unit"), F.col(parts)), F.explode(F.sequence(F.lit(0).cast("long"), F.col(others) - 1))
        at = at.select("family", "unit", part.alias("part"), other.alias("other"))
        i, j = ("other", "part") if is_ask else ("part", "other")
        return at.select("family", F.col(i).alias("i"), F.col(j).alias("j"), "unit", F.lit(is_ask).alias("is_ask"))

    rows = dealt(members, False).unionByName(dealt(asks, True)).join(sets.select("unit", "n", "keys"), "unit")

    def compare(table: pa.Table) -> pa.Table:
        family, i, j, unit, n = (table[c].to_numpy() for c in ("family", "i", "j", "unit", "n"))
        is_ask = table["is_ask"].to_numpy()
        keys = [np.frombuffer(k.as_buffer(), "<u8") for k in table["keys"]]
        order = np.lexsort((unit, is_ask, j, i, family))
        tasks = np.stack([family, i, j])[:, order]
        bounds = np.flatnonzero(np.concatenate([[True], (tasks[:, 1:] != tasks[:, :-1]).any(0), [True]])) if len(order) else []
        a, b = [], []
        for x, y in zip(bounds[:-1], bounds[1:], strict=True):
            o = order[x:y]
            m = len(o) - int(is_ask[o].sum())
            if 0 < m < len(o):
                for z, k in answers([keys[r] for r in o[:m]], n[o[:m]], [keys[r] for r in o[m:]], n[o[m:]], percent):
                    a.append(unit[o[k]])
                    b.append(unit[o[m + z]])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    at = F.pmod(F.xxhash64("family", "i", "j"), F.lit(buckets)).cast("int").alias("at")
    return rows.select(at, "family", "i", "j", "unit", "is_ask", "n", "keys").repartition(buckets, "at").groupBy("at").applyInArrow(compare, "a long, b long")


def with_lead(asks: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of asks (family, unit) whose family is one set's unit."""
    sized = asks.join(sets.select("unit", "n"), "unit")
    return compared(asks.select("family", F.col("family").alias("unit"), F.lit(0).cast("long").alias("n")).distinct(), sized.select("family", "unit", "n"), sets, percent)


def mixed_lists(lists: DataFrame, label: DataFrame, turn: int) -> DataFrame:
    """key, unit, n, place, weight, component of the lists that hold more than one component, and p: in each turn the set of
    the largest weight in another of the list's components."""
    at = lists.select("key", "unit", "n", "place", "weight").join(label, "unit")
    middle = F.max_by(F.struct("unit", "n", "place", "component"), F.struct(F.xxhash64("component", F.lit(turn)), "weight", "unit"))
    kinds = at.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("rows"), middle.alias("p"))
    return written(join_groups(at, kinds.where("x <> y").select("key", "rows", "p"), "key").where("p is not null"), "mixed-lists", few=True)


def by_pivot(mixed: DataFrame, percent: int) -> DataFrame:
    """The asks of each list's sets in other components than its p."""
    most = F.least("place", "p.place") + F.least(F.col("n") - F.col("place"), F.col("p.n") - F.col("p.place"))
    able = mixed.where("component <> p.component").where(most * (100 + percent) >= (F.col("n") + F.col("p.n")) * percent)
    return able.select(F.col("p.unit").alias("family"), "unit").distinct()


def blocks_of(mixed: DataFrame) -> DataFrame:
    """Each list cut into blocks by component, with the bounds of the block's sizes and positions."""
    rest = F.col("n") - F.col("place")
    return mixed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("least_n"), F.max("n").alias("most_n"), F.max("place").alias("most_at"), F.max(rest).alias("most_rest"))


def outside_pairs(outside: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The asks of sets outside their lists' largest blocks, of different components, that blocks and sketches leave.

    Of a list with more than OUTSIDE_ROWS such sets, each pair of parts is a task's work."""
    size = outside.groupBy("key").agg(F.count(F.lit(1)).alias("rows"))
    parts = F.ceil(F.col("rows") / OUTSIDE_ROWS).cast("int")
    dealt = join_groups(outside.select("key", "unit", "n", "place", "component"), size.withColumn("parts", parts).where("rows > 1"), "key").where("parts is not null")
    cut = dealt.withColumn("part", F.pmod(F.xxhash64("unit"), F.col("parts")).cast("int")).select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    cut = cut.withColumn("low", F.least("part", "other")).withColumn("high", F.greatest("part", "other")).join(sketched(sets), "unit")
    load = size.agg(F.sum(F.col("rows") * parts)).first()[0] or 0
    buckets = max(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(load // OUTSIDE_ROWS))

    def pair(table: pa.Table) -> pa.Table:
        unit, n, place, component, part, shared, key, low, high = (table[c].to_numpy() for c in ("unit", "n", "place", "component", "part", "shared", "key", "low", "high"))
        order = np.lexsort((unit, place, n, high, low, key))
        tasks = np.stack([key, low, high])[:, order]
        bounds = np.flatnonzero(np.concatenate([[True], (tasks[:, 1:] != tasks[:, :-1]).any(0), [True]]))
        found = [np.zeros((2, 0), np.int64)]
        for x, y in zip(bounds[:-1], bounds[1:], strict=True):
            o = order[x:y]
            sketches = Sketches(n[o], shared[o], [np.frombuffer(table["sketch"][int(k)].as_buffer(), np.uint64) for k in o], percent)
            apart, own, across_parts = component[o], part[o], low[o[0]] != high[o[0]]

            def allow(i: int, j: np.ndarray, sketches=sketches, apart=apart, own=own, across_parts=across_parts) -> np.ndarray:
                return (apart[j] != apart[i]) & ((own[j] != own[i]) | ~across_parts) & sketches.allow(i, j)

            i, j = block_pairs(n[o], place[o], percent, allow=allow)
            found.append(np.stack([unit[o][i], unit[o][j]]))
        pairs = np.unique(np.sort(np.concatenate(found, axis=1), axis=0), axis=1)
        return pa.table({"family": pa.array(pairs[0]), "unit": pa.array(pairs[1])})

    at = F.pmod(F.xxhash64("key", "low", "high"), F.lit(buckets)).cast("int").alias("at")
    return cut.select(at, "key", "low", "high", "unit", "n", "place", "component", "part", "shared", "sketch").groupBy("at").applyInArrow(pair, "family long, unit long").distinct()


def across(mixed: DataFrame, blocks: DataFrame, label: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between the components that meet in a list, so that none is lost: each set outside its list's largest block
    asks that block's component, unless the block's bounds rule it out, and the others outside that sketches allow."""
    largest = blocks.groupBy("key").agg(F.max(F.struct("c", "component", "least_n", "most_n", "most_at", "most_rest")).alias("main"), F.sum("c").alias("rows"))
    outside = written(join_groups(mixed.drop("p"), largest, "key").where("component <> main.component"), "outside", few=True)
    most = F.least("main.most_at", "place") + F.least("main.most_rest", F.col("n") - F.col("place"))
    able = outside.where((F.col("main.most_n") * 100 >= percent * F.col("n")) & (F.col("main.least_n") * percent <= 100 * F.col("n")) & (most * (100 + percent) >= (F.col("n") + F.col("main.least_n")) * percent))
    asks = written(able.select(F.col("main.component").alias("family"), "unit", "n").distinct(), "asks", few=True)
    members = label.withColumnRenamed("component", "family").join(asks.select("family").distinct(), "family").join(sets.select("unit", "n"), "unit")
    pairs = written(outside_pairs(outside, sets, percent), "outside-pairs", few=True)
    return compared(members.select("family", "unit", "n"), asks, sets, percent).unionByName(with_lead(pairs, sets, percent))


def joined(label: DataFrame, links: DataFrame) -> DataFrame:
    """label (unit, component) after more links."""
    at = links.join(label.select(F.col("unit").alias("a"), F.col("component").alias("x")), "a").join(label.select(F.col("unit").alias("b"), F.col("component").alias("y")), "b")
    to = components(at.select(F.col("x").alias("a"), F.col("y").alias("b")))
    new = label.join(to.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left")
    return written(new.select("unit", F.coalesce("to", "component").alias("component")), "label", few=True)


def links_and_components(docs: DataFrame, width: int = 5, percent: int = 75, *more: str) -> tuple[DataFrame, DataFrame]:
    """Of docs: doc_id, n_shingles, unit and more; and unit, component of the units that may link."""
    ranges = partitions_for(docs, 2)
    rows = written(units(docs, width, *more), "units")
    shared = written(shared_keys(texts(docs), lambda found: sets_of(found, width), ranges), "shared")
    sizes = rows.groupBy("unit").agg(F.max("n_shingles").alias("n"))
    near = shared.join(sizes, "unit").where(F.octet_length("keys") / 8 * 100 >= percent * F.col("n"))
    sets = written(near, "sets")
    found = written(candidates(index_entries(sets, ranges, percent), percent), "candidates")
    first = written(with_lead(found.where("not open").select("family", "unit").distinct(), sets, percent), "links", few=True)
    label = joined(sets.select("unit", F.col("unit").alias("component")), first)
    lists, turn, before = found.where("open"), 0, float("inf")
    while True:
        mixed = mixed_lists(lists, label, turn)
        blocks = blocks_of(mixed)
        of_list = blocks.groupBy("key").agg(F.sum("c").alias("rows"), F.max("c").alias("main"), F.count(F.lit(1)).alias("blocks"))
        row = of_list.agg(F.sum("rows").alias("rows"), F.sum(F.col("rows").cast("double") * F.col("blocks") - F.col("main") * F.col("blocks")).alias("left")).first()
        if not row["rows"]:
            return rows, label
        last = row["left"] <= LAST_PAIRS * row["rows"] or row["left"] > 0.5 * before  # pairs of a set and a block that it is not in
        links = across(mixed, blocks, label, sets, percent) if last else with_lead(by_pivot(mixed, percent), sets, percent)
        label = joined(label, written(links, "links", few=True))
        if last:
            return rows, label
        lists, turn, before = mixed, turn + 1, row["left"]


def ngram_join(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs."""
    rows, label = links_and_components(docs, width, percent)
    least = rows.where("n_shingles > 0").groupBy("unit").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows"))
    named = least.join(label, "unit", "left").withColumn("component", F.coalesce("component", "unit"))
    of_component = named.groupBy("component").agg(F.min("least").alias("component_id"))
    groups = named.join(of_component, "component").select("unit", "component_id", "rows")
    return join_groups(rows, groups, "unit").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """Of each component the rows of docs, with all their columns, that have its smallest doc_id (null comes last) and one
    text; of those with null doc_id one row. Rows without shingles all stay."""
    own = docs.withColumn("_digest", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    rows, label = links_and_components(own, width, percent, "_digest")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_digest")).alias("first")
    of_unit = rows.where("n_shingles > 0").groupBy("unit").agg(first).join(label, "unit", "left")
    of_component = of_unit.groupBy(F.coalesce("component", "unit").alias("component")).agg(F.min("first").alias("first"))
    full = of_component.select(F.col("first.doc_id").alias("_doc_id"), F.col("first._digest").alias("_kept"), F.lit(True).alias("_full"))
    empty = rows.where("n_shingles = 0").select(F.col("doc_id").alias("_doc_id"), F.col("_digest").alias("_kept"), F.lit(False).alias("_full")).distinct()
    kept = written(full.unionByName(empty), "kept", few=True)
    found = own.join(kept, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("_digest") == F.col("_kept")))
    alone = F.col("doc_id").isNull() & F.col("_full")
    return found.where(~alone).unionByName(found.where(alone).dropDuplicates(["_digest"])).select(*docs.columns)
