"""A request-and-reply exchange that finds which keys of a unit other units have too.

A unit is a class of equal documents; it has 64-bit keys (hashes of its shingles or windows). Each task drops units it has
already seen in its batch, and of a key that several of its units have it sends one entry on: so that a key of a third of
all rows is an entry for each batch, and such units get their answer at once. The other keys are dealt by ranges of the
key, in packed arrays of a few bytes a key. Where a range is gathered, keys of two or more units are sent back to the
units that asked, dealt by unit.

The ranges grow with the input, a task's batch does not. So beyond WIDE ranges the keys are dealt twice, to groups of
ranges first and from there, in batches again, to the ranges: else a row would hold a key or two.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardframe.llm.wordhash import mix

#: Bytes of text that a task turns into entries at a time.
BATCH = 4 << 20
#: Parts of a range that are sorted one after another: the values of a key's three upper bits as sent.
SLICES = 8
#: Ranges that a batch is dealt to at once.
WIDE = 1024
LOW = np.uint64(0xFFFFFFFF)


def range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    return (((keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)


def home_of(units: np.ndarray, homes: int) -> np.ndarray:
    return (mix(units.view(np.uint64)) % np.uint64(homes)).astype(np.int64)


def order_by(numbers: np.ndarray, below: int) -> np.ndarray:
    return np.argsort(numbers.astype(np.uint16 if below <= 1 << 16 else np.uint32), kind="stable")


def batches_of(batches: Iterable[pa.RecordBatch], column: str = "text") -> Iterator[list[pa.RecordBatch]]:
    """Groups of batches of about BATCH bytes of text."""
    held, size = [], 0
    for whole in batches:
        step = max(1, int(whole.num_rows * BATCH / max(1, whole.nbytes)))
        for at in range(0, whole.num_rows, step):
            held.append(whole.slice(at, step))
            size += whole.nbytes * min(step, whole.num_rows - at) // max(1, whole.num_rows)
            if size >= BATCH:
                yield held
                held, size = [], 0
    if held:
        yield held


def by_home(units: np.ndarray, keys: np.ndarray, homes: int) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """(home, units, keys of each, keys) for pairs of a unit and a key; the keys of a unit are put together."""
    home = home_of(units, homes)
    order = np.lexsort((units, home))
    units, keys, home = units[order], keys[order], home[order]
    first = np.flatnonzero(np.concatenate([[True], units[1:] != units[:-1]])) if len(units) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(units))).astype(np.uint32)
    found = np.unique(home)
    bounds, runs = np.searchsorted(home, [*found, homes]), np.searchsorted(home[first], [*found, homes])
    for i, h in enumerate(found):
        own = slice(runs[i], runs[i + 1])
        yield int(h), units[first[own]].tobytes(), size[own].tobytes(), keys[bounds[i] : bounds[i + 1]].tobytes()


SCHEMA = "at int, reply boolean, units binary, sizes binary, low binary, high binary, many_low binary, many_high binary"
FIELDS = ["at", "reply", "units", "sizes", "low", "high", "many_low", "many_high"]
KINDS = [pa.int32(), pa.bool_(), *[pa.binary()] * 6]
REPLY = "at int, units binary, sizes binary, keys binary"


def packed(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(KINDS)], FIELDS)


def shared_keys(docs: DataFrame, units: Callable, ranges: int, high: type = np.uint16, marked: bool = False) -> DataFrame:
    """unit and keys (little-endian 64-bit, sorted): the keys of each unit that another unit has too.

    units(texts) yields (unit, keys, marks) of each text, keys without repeats. With marked, keys that no
    unit marks are left out, but for those that units of one batch share. high is the type of a key's upper part as sent: with its range and 32 lower bits it identifies
    the key, so that other keys pass for it rarely; callers that need all 64 bits check again.
    """
    bits = np.dtype(high).itemsize * 8 - marked
    upper = np.uint64((1 << bits) - 1)
    flag = np.uint64(1 << bits)
    each = -(-ranges // WIDE)  # ranges of a group

    def deal(key: np.ndarray, unit: np.ndarray, mark: np.ndarray, reps: np.ndarray, rep_mark: np.ndarray, whole: bool) -> Iterator[tuple]:
        """Rows of keys with their units, and of keys that several units have: by range, or with whole by group of ranges
        with all of the key's bits."""
        kind, kept, top = (np.dtype("<u8"), LOW, np.uint64(1 << 32)) if whole else (np.dtype(high), upper, flag)
        at, rep_at = range_of(key, ranges), range_of(reps, ranges)
        if whole:
            at, rep_at = at // each, rep_at // each
        order = order_by(at, ranges)
        key, unit, mark, at = key[order], unit[order], mark[order], at[order]
        again = order_by(rep_at, ranges)
        reps, rep_mark, rep_at = reps[again], rep_mark[again], rep_at[again]

        def above(keys: np.ndarray, marks: np.ndarray) -> np.ndarray:
            found = (keys >> np.uint64(32)) & kept
            return (found | np.where(marks, top, np.uint64(0)) if marked else found).astype(kind)

        low, high_part, rep_low, rep_high = (key & LOW).astype("<u4"), above(key, mark), (reps & LOW).astype("<u4"), above(reps, rep_mark)
        run = np.flatnonzero(np.concatenate([[True], (unit[1:] != unit[:-1]) | (at[1:] != at[:-1])])) if len(unit) else np.zeros(0, np.int64)
        run_size, run_unit, run_at = np.diff(np.append(run, len(unit))).astype(np.uint32), unit[run], at[run]
        found = np.union1d(at, rep_at)  # those that have a row
        bounds, run_bounds, rep_bounds = (zip(np.searchsorted(x, found), np.searchsorted(x, found, "right"), strict=True) for x in (at, run_at, rep_at))
        for r, (a, b), (c, d), (e, f) in zip(found.tolist(), bounds, run_bounds, rep_bounds, strict=True):
            yield r, False, run_unit[c:d].tobytes(), run_size[c:d].tobytes(), low[a:b].tobytes(), high_part[a:b].tobytes(), rep_low[e:f].tobytes(), rep_high[e:f].tobytes()

    def opened(rows: Iterable[tuple], kind: np.dtype) -> tuple[np.ndarray, ...]:
        """The arrays that rows of deal hold: low, high, unit, and low and high of the keys of several units."""
        parts = [(np.frombuffer(lo, "<u4"), np.frombuffer(hi, kind), np.repeat(np.frombuffer(u, np.int64), np.frombuffer(n, np.uint32)), np.frombuffer(m_lo, "<u4"), np.frombuffer(m_hi, kind)) for u, n, lo, hi, m_lo, m_hi in rows]
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def refine(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From groups of ranges to ranges: the rows that a task gets of a group are put together first."""
        held: dict[int, list[tuple]] = {}
        size: dict[int, int] = {}

        def flush(group: int) -> pa.RecordBatch:
            low, above, unit, m_low, m_above = opened(held.pop(group), np.dtype("<u8"))
            size.pop(group)

            def whole(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
                return lo.astype(np.uint64) | ((hi & LOW) << np.uint64(32))

            def marks(hi: np.ndarray) -> np.ndarray:
                return hi > LOW

            order = np.argsort(unit, kind="stable")
            key, unit, mark = whole(low, above)[order], unit[order], marks(above)[order]
            return packed(list(deal(key, unit, mark, whole(m_low, m_above), marks(m_above), False)))

        for b in batches:
            for at, reply, *row in zip(*(b.column(c).to_pylist() for c in FIELDS), strict=True):
                if reply:
                    yield packed([(at, True, *row)])
                    continue
                held.setdefault(at, []).append(tuple(row))
                size[at] = size.get(at, 0) + sum(map(len, row))
                if size[at] >= BATCH:
                    yield flush(at)
        for group in list(held):
            yield flush(group)

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in batches_of(batches):
            ids, keys, marks, seen = [], [], [], set()
            for unit, own, own_marks in units([t for b in held for t in b.column("text").to_pylist()]):
                if unit not in seen and len(own):
                    seen.add(unit)
                    ids.append(unit)
                    keys.append(own)
                    marks.append(own_marks)
            if not ids:
                continue
            size = np.fromiter(map(len, keys), np.int64, len(keys))
            unit = np.repeat(np.array(ids, np.int64), size)
            key = np.concatenate(keys)
            mark = np.concatenate(marks) if marked else np.ones(len(key), bool)
            del keys, marks
            place = np.argsort(key)
            same = key[place][1:] == key[place][:-1]
            more = np.zeros(len(key), bool)  # a key of several units here
            more[place[1:][same]] = True
            more[place[:-1][same]] = True
            lone = np.flatnonzero(~more)
            several = np.flatnonzero(more)
            all_keys, all_marks = key[several], mark[several]
            reps, inverse = np.unique(all_keys, return_inverse=True)
            rep_mark = np.zeros(len(reps), bool)
            np.logical_or.at(rep_mark, inverse, all_marks)
            rows = list(deal(key[lone], unit[lone], mark[lone], reps, rep_mark, each > 1))
            trimmed = (all_keys & LOW) | (((all_keys >> np.uint64(32)) & upper) << np.uint64(32)) | (range_of(all_keys, ranges).astype(np.uint64) << np.uint64(48))
            for h, who, sizes, own in by_home(unit[several], trimmed, ranges):
                rows.append((h, True, who, sizes, own, None, None, None))
            yield packed(rows)

    def several_have(low: np.ndarray, above: np.ndarray, unit: np.ndarray, m_low: np.ndarray, m_above: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(unit, key) for the keys that another unit has too, among those that come with a unit."""
        n = len(low)
        if not n:
            return unit, np.zeros(0, np.uint64)
        lows, highs = np.concatenate([low, m_low]).astype(np.uint64), np.concatenate([above, m_above]).astype(np.uint64)
        key = lows | ((highs & upper) << np.uint64(32))
        place = np.argsort(key)
        ordered = key[place]
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        real = place < n  # the others are several units' already
        own = unit[np.minimum(place, n - 1)]
        least, most = np.where(real, own, np.iinfo(np.int64).min), np.where(real, own, np.iinfo(np.int64).max)
        good = np.minimum.reduceat(least, first) != np.maximum.reduceat(most, first)
        if marked:
            good &= np.bitwise_or.reduceat(highs[place] & flag, first) > 0
        good = np.repeat(good, np.diff(np.append(first, len(ordered)))) & real
        return unit[place[good]], key[place[good]]

    def answer(table: pa.Table) -> pa.Table:
        at = table["at"][0].as_py()
        out: list[tuple] = []
        asked = []
        for reply, *row in zip(*(table[c].to_pylist() for c in FIELDS[1:]), strict=True):
            if reply:
                out.append((at, *row[:3]))
            else:
                asked.append(row)
        if asked:
            low, above, unit, m_low, m_above = opened(asked, np.dtype(high))
            units, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for k in range(SLICES):  # by the keys' upper bits, so that only a slice's arrays are wide
                x, y = (np.flatnonzero((h.astype(np.uint32) & int(upper)) >> (bits - 3) == k) for h in (above, m_above))
                own_units, own_keys = several_have(low[x], above[x], unit[x], m_low[y], m_above[y])
                units.append(own_units)
                keys.append(own_keys | (np.uint64(at) << np.uint64(48)))
            out += list(by_home(np.concatenate(units), np.concatenate(keys), ranges))
        return pa.table([pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["at", "units", "sizes", "keys"])

    def gather(table: pa.Table) -> pa.Table:
        return gathered(table, "keys")

    asked = docs.select("text").mapInArrow(ask, SCHEMA)
    if each > 1:
        told = F.when(F.col("reply"), F.xxhash64("at")).otherwise(F.pmod(F.spark_partition_id(), F.lit(each)))  # a group is several tasks' work
        asked = asked.withColumn("_to", told).repartition(ranges, "reply", "at", "_to").drop("_to").mapInArrow(refine, SCHEMA)
    replies = asked.groupBy("at").applyInArrow(answer, REPLY)
    return replies.groupBy("at").applyInArrow(gather, "unit long, keys binary")


def gathered(table: pa.Table, name: str, lanes: int = 1) -> pa.Table:
    """One row for each unit, its keys sorted and without repeats; with more lanes, the rows of its keys as they come."""
    units = [np.repeat(np.frombuffer(u, np.int64), np.frombuffer(s, np.uint32)) for u, s in zip(table["units"].to_pylist(), table["sizes"].to_pylist(), strict=True)]
    unit = np.concatenate(units)
    key = np.concatenate([np.frombuffer(k, np.uint64) for k in table["keys"].to_pylist()])
    place = np.argsort(unit, kind="stable")
    unit, key = unit[place], key.reshape(-1, lanes)[place]
    first = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
    own = [(np.unique(x) if lanes == 1 else x).astype("<u8").tobytes() for x in np.split(key, first[1:])]
    return pa.table([pa.array(unit[first], pa.int64()), pa.array(own, pa.binary())], names=["unit", name])
