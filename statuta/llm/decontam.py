"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are far shorter than documents, so a signature of a whole document says nothing of them. Items are partitioned by their
number of distinct 5-word shingles into classes of doubling size; for each class every document is cut into blocks of half the class
size, and every three blocks in a row are a window, so that a passage as long as any item of the class lies within one window. The
MinHash of a window of 1.5 n shingles then compares with that of an item of more than n / 2: where containment is 0.75 the Jaccard
similarity is at least 0.375 n / (1.5 n + 0.125 n), about 0.23, and ``bands`` bands of one row each miss it with
probability (1 - 0.23) ** bands at worst, 3 in 100,000 for 40. Candidates are verified by exact containment: distinct shingles
of the item that occur in the document, over all of the item's.

Items reach the tasks by broadcast in blocks of at most ``block_items`` items and ``block_chars`` characters (counted
beforehand), and each block is one pass over the documents; documents are never shuffled.

Defined cases: null or empty texts match nothing; items of fewer than five words are one shingle, the whole sequence, and match only
documents of the same words; equal items, and repeated documents, each get their rows; an empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuta.llm.common import without
from statuta.llm.words import mix64, pieces, shingles, texts_of, words

_rng = np.random.Generator(np.random.PCG64(77))
SEEDS = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def permuted(hashed: np.ndarray, k: int) -> np.ndarray:
    """The k-th MinHash permutation, on 32 bits: hashes are well mixed, so a product's upper half orders them anew."""
    return ((hashed * SEEDS[k]) >> np.uint64(32)).astype(np.uint32)


class Items:
    """A block of items: distinct shingles, size classes and signatures, looked up by arrays."""

    def __init__(self, ids: list[int], texts: list[str | None], bands: int):
        hashed, _, _, first = words(texts_of(pa.array(texts, pa.large_string())))
        found, bounds = shingles(hashed, first)
        sets = [np.unique(found[bounds[i] : bounds[i + 1]]) for i in range(len(ids))]
        used = [i for i, s in enumerate(sets) if len(s)]
        self.ids, self.sets, self.bands = [ids[i] for i in used], [sets[i] for i in used], bands
        self.classes: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        by_class: dict[int, list[int]] = {}
        for j, s in enumerate(self.sets):
            by_class.setdefault(max(3, int(len(s) - 1).bit_length()), []).append(j)
        for c, members in by_class.items():
            tables = []
            for k in range(bands):
                keys = np.array([permuted(self.sets[j], k).min() for j in members], np.uint32)
                order = np.argsort(keys, kind="stable")
                tables.append((keys[order], np.array(members)[order]))
            self.classes[c] = tables


def search(found: np.ndarray, bounds: np.ndarray, items: Items) -> set[tuple[int, int]]:
    """(text, item) whose window signatures agree in a band."""
    hits: set[tuple[int, int]] = set()
    if not len(found) or not items.classes:
        return hits
    low = min(items.classes) - 1
    count = np.diff(bounds)
    text = np.flatnonzero(count)
    blocks = -(-count[text] // (1 << low))
    owner = np.repeat(text, blocks)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    edges = bounds[owner] + (at << low)
    for k in range(items.bands):
        level, who, place = np.minimum.reduceat(permuted(found, k), edges), owner, at
        for c in range(low + 1, max(items.classes) + 1):
            if c in items.classes:
                # level has blocks of 2 ** (c - 1): windows of three
                keys, members = items.classes[c][k]
                reach = level.copy()
                for step in (1, 2):
                    same = who[step:] == who[:-step]
                    reach[:-step][same] = np.minimum(reach[:-step][same], level[step:][same])
                left = np.searchsorted(keys, reach)
                ok = left < len(keys)
                ok[ok] = keys[left[ok]] == reach[ok]
                for w in np.flatnonzero(ok):
                    right = np.searchsorted(keys, reach[w], "right")
                    hits.update((int(who[w]), int(m)) for m in members[left[w] : right])
            # blocks of twice the size
            even = np.flatnonzero(place % 2 == 0)
            pair = np.minimum(even + 1, len(level) - 1)
            joined = (who[pair] == who[even]) & (pair > even)
            level, who, place = np.where(joined, np.minimum(level[even], level[pair]), level[even]), who[even], place[even] // 2
    return hits


def hits(docs: DataFrame, items: DataFrame, *, threshold: float = 0.75, bands: int = 40, block_items: int = 100_000, block_chars: int = 40_000_000) -> DataFrame:
    """A row for each document and item it contains: doc_id, h (the text's hash), item_id, n_item (its shingles), n_shared, containment."""
    spark = docs.sparkSession
    schema = "doc_id long, h long, item_id long, n_item long, n_shared long, containment double"
    out = None
    source = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    hundredths = round(threshold * 100)
    for ids, texts in _blocks(items, block_items, block_chars):
        shared = spark.sparkContext.broadcast(Items(ids, texts, bands))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = shared.value
            for batch, t in pieces(batches, "text"):
                hashed, _, _, first = words(t)
                found, bounds = shingles(hashed, first)
                rows = []
                for i, j in sorted(search(found, bounds, block)):
                    want = block.sets[j]
                    n = int(np.isin(want, found[bounds[i] : bounds[i + 1]]).sum())
                    if 100 * n >= hundredths * len(want):
                        rows.append((batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), block.ids[j], len(want), n, n / len(want)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()))], ["doc_id", "h", "item_id", "n_item", "n_shared", "containment"])

        part = source.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def _blocks(items: DataFrame, most: int, chars: int) -> Iterator[tuple[list, list]]:
    """Items in blocks bounded in number and characters, one partition of the table at a time on the driver."""
    ids, texts, n = [], [], 0
    for row in items.select("item_id", "text").where("text IS NOT NULL").toLocalIterator():
        if ids and (len(ids) >= most or n + len(row["text"]) > chars):
            yield ids, texts
            ids, texts, n = [], [], 0
        ids.append(row["item_id"])
        texts.append(row["text"])
        n += len(row["text"])
    if ids:
        yield ids, texts


def find(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """A row for each document and item it contains: doc_id, item_id, n_item (its shingles), n_shared, containment."""
    return hits(docs, items, **options).drop("h")


def clean(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """docs without those that contain an item; rows of a null doc_id are told apart by their texts."""
    return without(docs, hits(docs, items, **options))
