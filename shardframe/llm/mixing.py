"""Mixing sources to target weights by subset-sum budget fitting.

A source's documents are counted by exact length. Its target is met by whole passes over the source and, for what
remains, by a number of documents of each length: all but the words of a few of its longest documents in proportion, and
those by a bounded-knapsack dynamic programme over all its lengths. Which documents of a length are taken follows a seeded
hash of id and text.

Rows are ranked by one sort of narrow rows, dealt by range, so that neither a large source nor a length that many documents
have is one task's work; documents without an id are told apart by their texts, equal rows by a number.

Defined cases: null text has size 0; sources are ordered by code point, null last; documents of size 0 are taken with 0
words; a repeated row counts as a row of its own; an empty table gives no rows, and a corpus without words only zeros.
No document is taken more than max_repeats times. Columns beside doc_id, text and source are not read.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardframe.functions.numbering import dense_index
from shardframe.llm.common import WORD, join_groups, written

#: How often the longest document's words are left to the dynamic programme.
HELD = 4


def in_proportion(lengths: list[int], spare: list[int], budget: int) -> list[int]:
    """How many documents of each length come to the same share of each length's words, from the shortest on; what is left
    of a length's share goes on to the next, so that less than one of the longest is left in the end."""
    total, take, rest = sum(n * x for n, x in zip(spare, lengths, strict=True)), [0] * len(lengths), 0
    for i in sorted(range(len(lengths)), key=lengths.__getitem__):
        if lengths[i] and total:
            words = spare[i] * lengths[i] * budget + rest
            take[i] = min(spare[i], words // (total * lengths[i]))
            rest = words - take[i] * total * lengths[i]
    return take


def fit(lengths: list[int], spare: list[int], budget: int) -> list[int]:
    """How many documents of each length to take, so that their words come as near to budget as can be."""
    longest = max((x for x, s in zip(lengths, spare, strict=True) if s), default=0)
    take = in_proportion(lengths, spare, max(0, min(budget, sum(n * x for n, x in zip(spare, lengths, strict=True))) - HELD * longest))
    budget -= sum(n * x for n, x in zip(take, lengths, strict=True))
    most = budget + min(budget, max((n for n, s, t in zip(lengths, spare, take, strict=True) if s > t), default=0))
    reach, steps, full = 1, [], (1 << (most + 1)) - 1  # bit n of reach: n words can be taken
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        length = lengths[i]
        left, k = min(spare[i] - take[i], most // length if length else 0), 1
        while left > 0 and not reach >> budget & 1:
            n = min(k, left)
            new = (reach << n * length) & full & ~reach
            if new:
                steps.append((i, n, new))
                reach |= new
            left, k = left - n, 2 * k
    at = (reach & ((1 << (budget + 1)) - 1)).bit_length() - 1
    beyond = reach >> (budget + 1)
    if beyond and (above := (beyond & -beyond).bit_length()) < budget - at:
        at = budget + above
    for i, n, new in reversed(steps):
        if new >> at & 1:
            take[i] += n
            at -= n * lengths[i]
    return take


def targets(sized: DataFrame, weights: tuple[float, ...], share: float, max_repeats: int) -> DataFrame:
    """skey, total, target of each source; targets above max_repeats times the total give their excess to the others."""
    own = sized.groupBy("skey", "source").agg(F.sum("size").alias("total"))
    at = dense_index(own, "at", [F.col("source").isNull(), F.col("source")])
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("at") % len(weights) + 1).cast("int")).cast("double")
    table = written(at.select("skey", "total", weight.alias("weight")), "weights", few=True)
    whole = share * (table.agg(F.sum("total")).first()[0] or 0)
    rate = 0.0
    while True:  # each pass caps a source at least; the rate only rises
        cap = (F.col("weight") * rate > max_repeats * F.col("total")) if rate else F.lit(False)
        row = table.agg(F.sum(F.when(cap, max_repeats * F.col("total")).otherwise(0)).alias("capped"), F.sum(F.when(cap, 0.0).otherwise(F.col("weight"))).alias("free")).first()
        new = (whole - (row["capped"] or 0)) / row["free"] if row["free"] else rate
        if new <= rate * (1 + 1e-12):
            break
        rate = new
    # the sources' targets at the last rate
    return table.select("skey", "total", F.least(F.col("weight") * rate, (max_repeats * F.col("total")).cast("double")).alias("target"))


def decided(docs: DataFrame, row: list[str], weights: tuple[float, ...] = (5, 2, 1), share: float = 1.0, max_repeats: int = 3, seed: int = 1) -> DataFrame:
    """mix with the columns of row beside its own; they settle ties of equal rows."""
    sized = written(
        docs.select(
            *row,
            F.col("doc_id").cast("long").alias("doc_id"),
            F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("skey"),
            "source",
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.xxhash64(F.lit(seed), "doc_id", "text").alias("h"),
            F.monotonically_increasing_id().alias("u"),
        ),
        "sized",
    )
    goal = written(targets(sized, weights, share, max_repeats), "targets", few=True)
    group = F.concat_ws(":", F.col("size").cast("string"), "skey")
    placed = dense_index(sized, "at", [F.col("skey"), F.col("size"), F.col("h"), F.col("doc_id"), *map(F.col, row), F.col("u")])
    counts = placed.groupBy("skey", "size").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("start"))

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        """Of one source: a row for each of its lengths."""
        rows = rows.sort_values("size")
        total, target = int(rows["total"].iloc[0]), float(rows["target"].iloc[0])
        passes = min(max_repeats, int(target // total)) if total else 0
        left = round(target - passes * total) if total and passes < max_repeats else 0
        lengths, n = rows["size"].tolist(), rows["n"].tolist()
        return pd.DataFrame({"skey": rows["skey"], "size": rows["size"], "rows": rows["n"], "start": rows["start"], "passes": passes, "first": fit(lengths, n, left), "source_size": total, "target": target})

    chosen = counts.join(goal, "skey").groupBy("skey").applyInPandas(choose, "skey string, size long, rows long, start long, passes long, first long, source_size long, target double")
    decided_by = chosen.select(group.alias("group"), "rows", "start", "passes", "first", "source_size", "target")
    ranked = join_groups(placed.select(group.alias("group"), "at", *row, "doc_id", "size"), decided_by, "group")
    extra = (F.col("at") - F.col("start") < F.col("first")).cast("long")
    return ranked.select(*row, "doc_id", "size", "source_size", "target", (F.col("size") * (F.col("passes") + extra)).alias("taken"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of docs; taken is a multiple of size."""
    return decided(docs, [], **options)


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix with all their columns; one taken k times has k rows.

    Rows are told apart by a key that is made once and written, so null and repeated doc_ids are rows of their own."""
    rows = written(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    copies = decided(rows, ["_row"], **options).where("taken > 0").select("_row", F.expr("cast(taken div size as int)").alias("_copies"))
    return rows.join(copies, "_row").withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies"))).select(*docs.columns)
