"""Mixing sources to target weights by Pfair scheduling.

Each source's documents form blocks. With weight w, block i (from 0) of a source may not start before slot floor(i / w) and must be placed
before slot ceil((i + 1) / w); earliest deadline first then keeps every source within less than one block of w * t at each slot
t. Releases and deadlines come from the weights as given, in whole numbers without rounding, so the bound holds however long the
schedule is and however many sources there are. When a source runs out, the others go on in a next phase with their weights
renormalised, and slots count from the phase's start; every document is placed exactly once.

A block is ``blocks``-th of the table (or one document, in small tables), so the schedule that the driver makes has at most ``blocks`` slots and one per source,
whatever the size of the table; it holds a number per source besides. Ranks within a source come from counts per (source, hash bucket), summed up in two
levels, and a row number within each bucket, so no task holds a whole source or its buckets. Rows are dealt by the hash of all their columns: only rows that are equal in
every column share a bucket for certain.

Defined cases: a null source is a source of its own; weights not given for a source count as 0, which puts it into
a last phase after all others, equally weighted; empty table gives no row; repeated rows are placed one after another;
extra columns pass through (columns named like the added ones are replaced).
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping
from math import lcm

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statuta.llm.common import BROADCAST_ROWS, cut

NULL = "\x00null"
#: Buckets of a group whose counts one task sums up.
BUCKETS = 1024


def whole(weights: Mapping[str, float]) -> dict[str, int]:
    """Whole numbers in exactly the proportions of the weights."""
    ratios = {k: float(w).as_integer_ratio() for k, w in weights.items()}
    scale = lcm(*(d for _, d in ratios.values()))
    return {k: n * (scale // d) for k, (n, d) in ratios.items()}


def schedule(blocks: Mapping[str, int], weights: Mapping[str, float]) -> Iterator[tuple[str, int, int, int, float]]:
    """(source, block, slot, first slot of its phase, weight in force), slot by slot, until every source is used up."""
    left, used, start = {k: n for k, n in blocks.items() if n}, dict.fromkeys(blocks, 0), 0
    while left:
        w = whole({k: weights.get(k, 0.0) for k in left if weights.get(k, 0.0) > 0} or dict.fromkeys(left, 1.0))
        total, slot, last = sum(w.values()), 0, None
        share = {k: n / total for k, n in w.items()}
        waiting = [(0, k, 0) for k in sorted(w)]
        ready: list[tuple[int, str, int]] = []
        while last is None:
            while waiting and waiting[0][0] <= slot:
                _, k, i = heapq.heappop(waiting)
                heapq.heappush(ready, (-(-(i + 1) * total // w[k]), k, i))
            _, k, i = heapq.heappop(ready)
            yield k, used[k], start + slot, start, share[k]
            used[k] += 1
            left[k] -= 1
            slot += 1
            if not left[k]:
                last = left.pop(k)
            else:
                heapq.heappush(waiting, ((i + 1) * total // w[k], k, i + 1))
        start += slot


def temperature(counts: Mapping[str, int], alpha: float) -> dict[str, float]:
    """Target weights in proportion to counts ** alpha."""
    total = sum(n**alpha for n in counts.values())
    return {k: n**alpha / total for k, n in counts.items()}


def mix(docs: DataFrame, weights: Mapping[str | None, float] | None = None, *, key: str = "doc_id", source: str = "source", alpha: float = 0.5, blocks: int = 1 << 18, bucket_docs: int = 2_000) -> DataFrame:
    """docs with stream, block (of its stream), slot, pos (place in its slot), phase (its first slot) and target (weight in force) added.

    weights: by source; None takes counts ** alpha. Sort by (slot, pos) for the mixed order.
    """
    spark = docs.sparkSession
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("stream", "block", "slot", "pos", "phase", "target")])
    name = F.coalesce(F.col(source).cast("string"), F.lit(NULL))
    content = F.xxhash64(*[F.col(c) for c, t in docs.dtypes if not t.startswith("map")])
    counts = {r["stream"]: r["n"] for r in docs.groupBy(name.alias("stream")).agg(F.count("*").alias("n")).toLocalIterator()}
    total = sum(counts.values())
    block_docs = max(1, -(-total // blocks))
    target = temperature(counts, alpha) if weights is None else {NULL if k is None else str(k): float(v) for k, v in weights.items()}
    plan = list(schedule({k: -(-n // block_docs) for k, n in counts.items()}, target))
    columns = ["_of", "_block", "slot", "phase", "target"]
    schema = "_of string, _block long, slot long, phase long, target double"
    planned = spark.createDataFrame(pd.DataFrame(plan, columns=columns), schema) if plan else spark.createDataFrame([], schema)

    buckets = max(1, -(-total // bucket_docs))
    hashed = F.xxhash64(F.col(key), content, F.lit(8))  # rows of one key, as of none, spread by what else they hold
    at = F.pmod(F.shiftrightunsigned(hashed, 20), F.lit(buckets))
    rows = docs.select(F.struct("*").alias("r"), name.alias("stream"), hashed.alias("_hash"), at.alias("_bucket"), content.alias("_content"))
    sums = cut(rows.groupBy("stream", "_bucket").agg(F.count("*").alias("n")).withColumn("_group", F.floor(F.col("_bucket") / BUCKETS)))
    over = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    groups = sums.groupBy("stream", "_group").agg(F.sum("n").alias("n")).withColumn("_sum", F.coalesce(F.sum("n").over(over("stream").orderBy("_group")), F.lit(0))).drop("n")
    inner = sums.withColumn("_own", F.coalesce(F.sum("n").over(over("stream", "_group").orderBy("_bucket")), F.lit(0)))
    before = cut(inner.join(groups, ["stream", "_group"]).select("stream", "_bucket", (F.col("_sum") + F.col("_own")).alias("_before")))
    rank = F.row_number().over(Window.partitionBy("stream", "_bucket").orderBy("_hash", F.col(f"r.`{key}`"), "_content")) - 1
    small = before.limit(BROADCAST_ROWS // 4 + 1).count() <= BROADCAST_ROWS // 4
    ranked = rows.withColumn("_row", rank).join(F.broadcast(before) if small else before, ["stream", "_bucket"]).withColumn("_rank", F.col("_row") + F.col("_before"))
    ranked = ranked.withColumn("block", F.floor(F.col("_rank") / block_docs))
    fits = len(plan) <= BROADCAST_ROWS // 4
    placed = ranked.join(F.broadcast(planned) if fits else planned, (F.col("stream") == F.col("_of")) & (F.col("block") == F.col("_block")))
    return placed.select("r.*", "stream", "block", "slot", (F.col("_rank") % block_docs).cast("int").alias("pos"), "phase", "target")
