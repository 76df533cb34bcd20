"""Connected components of a table of links, by contraction: no links or components are gathered on the driver."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardframe.llm.common import written

#: Links that one task takes at once (16 bytes each); more are contracted in rounds until they are so few.
ONE_TASK = 1_000_000


def smallest_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links, and the smallest node that each reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    to = np.arange(len(nodes))
    while True:
        least = np.minimum(to[x], to[y])
        new = to.copy()
        np.minimum.at(new, to[x], least)
        np.minimum.at(new, to[y], least)
        while (new[new] != new).any():
            new = new[new]
        if (new == to).all():
            return nodes, nodes[to]
        to = new


def in_one_task(links: DataFrame) -> DataFrame:
    """node, component of a bounded number of links."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches]
        if parts:
            node, least = smallest_of(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(least, pa.int64())], ["node", "component"])

    return links.select("a", "b").coalesce(1).mapInArrow(run, "node long, component long")


def components(links: DataFrame) -> DataFrame:
    """From links (a, b): node and component, the smallest node reachable, for every node that has a link to another.

    Up to ONE_TASK links are one task's work. Of more, each round points every node to its smallest neighbour and contracts the links; the number of components that still
    have links at least halves. Rounds are written to the shared folder, so that a lost executor repeats one of them."""
    left = written(links.where("a <> b").select("a", "b").distinct(), "links", few=True)
    label: DataFrame | None = None
    while True:
        if left.count() <= ONE_TASK:
            last = written(in_one_task(left), "components", few=True)
            if label is None:
                return last
            return label.join(last.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = written(both.groupBy("a").agg(F.min("b").alias("to")).select(F.col("a").alias("node"), F.least("a", "to").alias("to")), "step", few=True)
        label = (
            to.withColumnRenamed("to", "component")
            if label is None
            else label.join(to.select(F.col("node").alias("component"), "to"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        )
        label = written(label, "labels", few=True)
        at_a, at_b = to.select(F.col("node").alias("a"), F.col("to").alias("to_a")), to.select(F.col("node").alias("b"), F.col("to").alias("to_b"))
        moved = left.join(at_a, "a").join(at_b, "b").where("to_a <> to_b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b")).distinct()
        left = written(moved, "links", few=True)
