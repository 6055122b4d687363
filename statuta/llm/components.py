"""Connected components by alternating large-star and small-star steps, all in joins and partial aggregates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuta.llm.common import cut

#: Links that one task joins; more take the steps.
FEW = 1_000_000


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, root of all links (u, v), whose arrays are 16 bytes a link."""
    held = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches if b.num_rows]
    if not held:
        return
    ends = np.concatenate(held, 1)
    nodes, at = np.unique(ends, return_inverse=True)
    u, v = at.reshape(2, -1)
    label = np.arange(len(nodes))
    while len(u):
        least = np.minimum(label[u], label[v])
        np.minimum.at(label, label[u], least)
        np.minimum.at(label, label[v], least)
        while (label[label] != label).any():
            label = label[label]
        open_ = label[u] != label[v]
        u, v = u[open_], v[open_]
    for i in range(0, len(nodes), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[i : i + 100_000]), pa.array(nodes[label[i : i + 100_000]])], ["node", "root"])


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root (the smallest node reachable) for every node of links. Hot nodes are only ever one side of a join or a group that is summed partially."""
    edges = cut(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    if edges.limit(FEW + 1).count() <= FEW:
        return edges.coalesce(1).mapInArrow(_joined, "node long, root long")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(below, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = cut(small.unionByName(below.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        # stars are final: every u has one v, and no v is a u
        if not edges.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").limit(1).count() and not edges.select(F.col("v").alias("u")).distinct().join(edges, "u", "left_semi").limit(1).count():
            break
    return edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node").unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
