"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut

#: Edges that one task joins up: 16 bytes each, and as much again for their nodes.
SMALL = 1_000_000


def reduced(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges (a, b) and the smallest node that each reaches: each round every node takes the smallest label around it, and its label's label."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        while (again := new[new]).tobytes() != new.tobytes():
            new = again
        new = new[label]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def joined_up(edges):
    """Components of all edges of a bounded table, in one task."""
    for_all = [b for b in edges if b.num_rows]
    if not for_all:
        return
    t = pa.Table.from_batches(for_all)
    nodes, labels = reduced(t["a"].to_numpy(), t["b"].to_numpy())
    yield pa.record_batch([pa.array(nodes), pa.array(labels)], names=["node", "component"])


def components(edges: DataFrame, keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: cut(df), small: int = SMALL) -> DataFrame:
    """node, component (smallest node reachable) of each node that has an edge (a, b). Up to `small` edges in one task, beyond by alternating large and small stars.

    keep cuts a table's lineage; tables are kept where they are used again.
    """
    now = keep(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    if now.count() <= small:
        return keep(now.select(F.col("u").alias("a"), F.col("v").alias("b")).coalesce(1).mapInArrow(joined_up, "node long, component long"), "components")
    return stars_joined(now, keep)


def stars_joined(now: DataFrame, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return keep(now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct(), "components")
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = keep(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = keep(small.where("u <> v").distinct(), "small")
