"""Ranked lexical search by bit-sliced Bloom signatures.

Index: a document's signature is a Bloom filter over its terms, each once for every level of LEVELS that its occurrences reach. Documents whose filters have
the same number of bits lie side by side in blocks: one row of a block is one bit of all its documents, so a term's documents are the
conjunction of a few rows. These bitmaps hold every document of the term, and some more.

Search: a document's occurrences of a term are at most the next level less one, so a score is at most the sum over levels of (what the level can add
to the term's part) times (the summed weights of the item's terms whose bitmaps hold the document). Such sums over the slices bound every document's score from
above. The documents of largest bounds are scored exactly; the k-th of their scores is a floor that the k-th of all can not lie under. Every document whose bound
reaches it is scored exactly from its text; all others are provably not among the best k.

The index is a table in the shared folder, about a quarter of the texts; documents meet their items by broadcast of keys while these are few, else in a join.
Items come in blocks of at most ``block_items``, with one pass over the documents for each block. Terms are told apart by 64-bit hashes.

Defined cases: null and empty texts, and items, have no terms and no rows; repeated documents rank each by itself, by text hash where doc_id is equal or null (null ids last);
equal rows of items count once, an item_id that several texts share is ranked for each; empty tables give no row; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statuta.llm.common import BROADCAST_ROWS, cut
from statuta.llm.words import Texts, mix64, pieces, texts_of, words

_GAP = np.ones(256, bool)
_GAP[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
#: Occurrences from which a term is in a document's filter once more.
LEVELS = [1, 2, 3, *(x for k in range(2, 40) for x in (1 << k, 3 << k - 1))]
#: Rows of a term in a filter, and bits for each entry.
ROWS, BITS = 4, 12
#: Bytes of a block before its bits are packed.
BLOCK = 1 << 23


def terms(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms, and the bounds of each text's."""
    hashed, _, _, first = words(t, _GAP)
    return hashed, first


def counted(hashed: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, term and occurrences of each distinct term of each text, by text and term."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((hashed, text))
    hashed, text = hashed[order], text[order]
    new = np.ones(len(hashed), bool)
    new[1:] = (hashed[1:] != hashed[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    return text[at], hashed[at], np.diff(np.append(at, len(hashed)))


def rows_of(entries: np.ndarray, bits: int) -> np.ndarray:
    """The rows of each entry in filters of that many bits."""
    low, high = entries & np.uint64(0xFFFFFFFF), (entries >> np.uint64(32)) | np.uint64(1)
    return ((low[:, None] + np.arange(ROWS, dtype=np.uint64) * high[:, None]) % np.uint64(bits)).astype(np.int64)


def at_level(hashed: np.ndarray, level: int) -> np.ndarray:
    return mix64(hashed + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))


def bits_for(entries: int) -> int:
    """A power of two, or one and a half of it, that gives each entry BITS."""
    power = 1 << max(6, (entries * BITS - 1).bit_length())
    return power * 3 // 4 if power * 3 // 4 >= max(64, entries * BITS) else power


@dataclass
class Items:
    """Terms of a block of items: distinct hashes in order, and places in them by item."""

    keys: list[Row]
    hashes: np.ndarray
    places: np.ndarray
    bounds: np.ndarray
    weight: np.ndarray | None = None
    n_docs: int = 0
    n_terms: int = 0

    @classmethod
    def of(cls, rows: list[Row]) -> Items:
        hashed, first = terms(texts_of(pa.array([r["text"] for r in rows], pa.large_string())))
        item, own, _ = counted(hashed, first)
        hashes, places = np.unique(own, return_inverse=True)
        return cls(rows, hashes, places, np.searchsorted(item, np.arange(len(rows) + 1)))

    def weighed(self, df: dict[int, int], n_docs: int, n_terms: int) -> Items:
        w = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(self.hashes))], np.int64)
        return Items(self.keys, self.hashes, self.places, self.bounds, w, n_docs, n_terms)

    def length(self, n: np.ndarray) -> np.ndarray:
        """What a document's number of terms stands for in its scores."""
        return np.array([50 + 50 * int(x) * self.n_docs // self.n_terms for x in n], np.int64)


def part(tf: np.ndarray | int, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


INDEX = "term int, df long, bits int, ids array<long>, hs array<long>, ns array<long>, rows binary"


def index(docs: DataFrame, hashes: np.ndarray) -> DataFrame:
    """Blocks of signatures of docs (doc_id, h, text), and among them rows of counts: term (its place in hashes) and in how many documents it is;
    term -1 holds how many documents have terms, term -2 how many terms they have."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(hashes) + 2, np.int64)
        waiting: dict[int, list] = {}
        size: dict[int, int] = {}

        def block(bits: int) -> pa.RecordBatch:
            own = waiting.pop(bits)
            n = size.pop(bits)
            table = np.zeros((-(-n // 8) * 8, bits), np.uint8)
            at = 0
            for _, _, ns, doc, entries in own:
                table[np.repeat(doc + at, ROWS), rows_of(entries, bits).ravel()] = 1
                at += len(ns)
            packed = np.ascontiguousarray(np.packbits(table, 0, bitorder="little").T)
            ids, hs, ns = ([x for c in own for x in c[i]] for i in range(3))
            return pa.record_batch([pa.array(x, t) for x, t in (([None], pa.int32()), ([None], pa.int64()), ([bits], pa.int32()), ([ids], pa.list_(pa.int64())), ([hs], pa.list_(pa.int64())), ([ns], pa.list_(pa.int64())), ([packed.tobytes()], pa.binary()))], names)

        for batch, texts in pieces(batches, "text"):
            hashed, first = terms(texts)
            n = np.diff(first)
            text, term, tf = counted(hashed, first)
            df[-1] += int(n.sum())
            df[-2] += int((n > 0).sum())
            if len(hashes):
                place = np.minimum(np.searchsorted(hashes, term), len(hashes) - 1)
                df[:-2] += np.bincount(place[hashes[place] == term], minlength=len(hashes))
            entry, of = [], []
            for level, least in enumerate(LEVELS):
                there = tf >= least
                if not there.any():
                    break
                entry.append(at_level(term[there], level))
                of.append(text[there])
            if not entry:
                continue
            entry, of = np.concatenate(entry), np.concatenate(of)
            order = np.argsort(of, kind="stable")
            entry, of = entry[order], of[order]
            entries = np.bincount(of, minlength=len(n))
            bits = np.array([bits_for(int(x)) for x in entries])
            ids, hs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for b in np.unique(bits[entries > 0]).tolist():
                # documents of one size go to its block, as many at a time as it has room for
                mine = np.flatnonzero((bits == b) & (entries > 0))
                room = max(8, BLOCK // b // 8 * 8)
                while len(mine):
                    take = mine[: room - size.get(b, 0)]
                    mine = mine[len(take) :]
                    number = np.full(len(n), -1)
                    number[take] = np.arange(len(take))
                    own = number[of] >= 0
                    waiting.setdefault(b, []).append(([ids[i] for i in take], [hs[i] for i in take], n[take].tolist(), number[of[own]], entry[own]))
                    size[b] = size.get(b, 0) + len(take)
                    if size[b] >= room:
                        yield block(b)
        for b in list(waiting):
            yield block(b)
        there = np.flatnonzero(df)
        place = np.where(there >= len(hashes), len(hashes) - 1 - there, there)  # the last two are -1 and -2
        empty = [pa.nulls(len(there), t) for t in (pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())]
        yield pa.record_batch([pa.array(place, pa.int32()), pa.array(df[there]), *empty], names)

    names = [f.split()[0] for f in INDEX.split(", ")]
    return docs.select("doc_id", "h", "text").mapInArrow(build, INDEX)


def bounds(packed: np.ndarray, n: np.ndarray, items: Items, at: range) -> np.ndarray:
    """(item, document): bounds of the scores of the items in ``at`` for the documents of a block."""
    lo, hi = items.bounds[at.start], items.bounds[at.stop]
    own, local = np.unique(items.places[lo:hi], return_inverse=True)
    weight = items.weight[own].astype(np.float64)
    m = items.length(n)
    out, before, there = np.zeros((len(at), len(n))), np.zeros(len(n), np.int64), np.arange(len(own))
    bitmap = np.full((len(own), packed.shape[1]), 255, np.uint8)
    for level, upto in enumerate(LEVELS[1:]):
        bitmap[there] &= np.bitwise_and.reduce(packed[rows_of(at_level(items.hashes[own[there]], level), len(packed))], 1)
        gone = there[~bitmap[there].any(1)]
        bitmap[gone] = 0
        there = np.setdiff1d(there, gone, assume_unique=True)
        if not len(there):
            break
        most = part(np.minimum(upto - 1, n), m)
        step, before = most - before, most
        spread = np.zeros(len(own), np.int64) - 1
        spread[there] = np.arange(len(there))
        slices = np.unpackbits(bitmap[there], 1, count=len(n), bitorder="little") * weight[there][:, None]
        for k, i in enumerate(at):
            mine = spread[local[items.bounds[i] - lo : items.bounds[i + 1] - lo]]
            mine = mine[mine >= 0]
            if len(mine):
                out[k] += step * slices[mine].sum(0)
    return out


def _blocks(batches: Iterator[pa.RecordBatch], items: Items, group: int = 256) -> Iterator[tuple[list, list, range, np.ndarray]]:
    """ids, hs, items, bounds of each block of signatures."""
    for batch in batches:
        for bits, ids, hs, ns, rows in zip(*(batch.column(i).to_pylist() for i in range(5))):
            packed, n = np.frombuffer(rows, np.uint8).reshape(bits, -1), np.array(ns, np.int64)
            for start in range(0, len(items.keys), group):
                at = range(start, min(start + group, len(items.keys)))
                yield ids, hs, at, bounds(packed, n, items, at)


def likely(signatures: DataFrame, items: Items, k: int) -> DataFrame:
    """item, doc_id, h, bound: of each task, k documents of the largest bounds for each item."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list] = {}
        for ids, hs, at, bound in _blocks(batches, items):
            for row, i in enumerate(at):
                top = np.argpartition(-bound[row], min(k, bound.shape[1]) - 1)[:k]
                top = top[bound[row][top] > 0]
                held = best.setdefault(i, [])
                floor = held[-1][0] if len(held) >= k else 0
                held.extend((bound[row][j], ids[j], hs[j]) for j in top if bound[row][j] > floor)
                held.sort(key=lambda x: -x[0])
                del held[k:]
        flat = [(i, x[1], x[2], x[0]) for i, held in best.items() for x in held]
        if flat:
            i, ids, hs, bound = zip(*flat)
            yield pa.record_batch([pa.array(i, pa.int32()), pa.array(ids, pa.int64()), pa.array(hs, pa.int64()), pa.array(bound, pa.float64())], ["item", "doc_id", "h", "bound"])

    found = signatures.mapInArrow(search, "item int, doc_id long, h long, bound double")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("bound"), "doc_id", "h"))
    return found.withColumn("r", rank).where(F.col("r") <= k).drop("r")


def possible(signatures: DataFrame, items: Items, floors: np.ndarray) -> DataFrame:
    """doc_id, h, items: every document with the items for which its bound reaches the floor."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, hs, at, bound in _blocks(batches, items):
            doc, item = np.nonzero(bound.T >= np.maximum(floors[at.start : at.stop], 1)[None])
            heads, first = np.unique(doc, return_index=True)
            offsets = pa.array(np.append(first, len(doc)).astype(np.int32))
            yield pa.record_batch([pa.array([ids[i] for i in heads], pa.int64()), pa.array([hs[i] for i in heads], pa.int64()), pa.ListArray.from_arrays(offsets, pa.array((item + at.start).astype(np.int32)))], ["doc_id", "h", "items"])

    return signatures.mapInArrow(search, "doc_id long, h long, items array<int>")


def scored(docs: DataFrame, wanted: DataFrame, items: Items) -> DataFrame:
    """item, doc_id, h, score (above 0) of docs (doc_id, h, text) for the items that are wanted of them (doc_id, h, items); exact, from whole texts."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, "text"):
            hashed, first = terms(texts)
            m = items.length(np.diff(first))
            text, term, tf = counted(hashed, first)
            place = np.minimum(np.searchsorted(items.hashes, term), len(items.hashes) - 1)
            ours = items.hashes[place] == term
            key = text[ours] * len(items.hashes) + place[ours]  # sorted, as text and term are
            tf = tf[ours]
            asked = batch.column(3)
            doc = np.repeat(np.arange(batch.num_rows), asked.value_lengths().to_numpy())
            item = asked.flatten().to_numpy()
            for at in range(0, len(item), 20_000):
                d, i = doc[at : at + 20_000], item[at : at + 20_000]
                size = items.bounds[i + 1] - items.bounds[i]
                pair = np.repeat(np.arange(len(i)), size)
                own = items.places[np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(items.bounds[i], size)]
                want = d[pair] * len(items.hashes) + own
                where = np.minimum(np.searchsorted(key, want), max(len(key) - 1, 0))
                hit = key[where] == want if len(key) else np.zeros(len(want), bool)
                total = np.zeros(len(i), np.int64)
                np.add.at(total, pair[hit], items.weight[own[hit]] * part(tf[where[hit]], m[d[pair[hit]]]))
                some = np.flatnonzero(total > 0)
                yield pa.record_batch([pa.array(i[some]), batch.column(0).take(pa.array(d[some])), batch.column(1).take(pa.array(d[some])), pa.array(total[some])], ["item", "doc_id", "h", "score"])

    wanted = cut(wanted.groupBy("doc_id", "h").agg(F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")))
    few = wanted.limit(BROADCAST_ROWS // 4 + 1).count() <= BROADCAST_ROWS // 4 and (wanted.agg(F.sum(F.size("items"))).first()[0] or 0) <= 4 * BROADCAST_ROWS
    keys = wanted.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), "items")
    asked = docs.join(F.broadcast(keys) if few else keys, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h"))).select("doc_id", "h", "text", "items")
    return asked.mapInArrow(score, "item int, doc_id long, h long, score long")


def _block(docs: DataFrame, rows: list[Row], schema: T.StructType, k: int, seeds: int) -> DataFrame | None:
    items = Items.of(rows)
    if not len(items.hashes):
        return None
    made = cut(index(docs, items.hashes))
    df = {r["term"]: r["df"] for r in made.where("term IS NOT NULL").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator()}
    if not df.get(-1):
        return None
    items = items.weighed(df, df[-1], df[-2])
    signatures = made.where("term IS NULL").select("bits", "ids", "hs", "ns", "rows")
    first = likely(signatures, items, seeds).select("doc_id", "h", F.array("item").alias("items"))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "h")
    kth = scored(docs, first, items).withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k)
    floors = np.zeros(len(rows), np.int64)
    for r in kth.select("item", "score").toLocalIterator():
        floors[r["item"]] = r["score"]
    found = scored(docs, possible(signatures, items, floors), items).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = docs.sparkSession.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", schema["item_id"].dataType)]))
    return found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def rank(docs: DataFrame, items: DataFrame, *, k: int = 50, seeds: int = 100, block_items: int = 20_000) -> DataFrame:
    """item_id, rank, doc_id, score of the k documents of docs (doc_id, text) with the highest scores above 0 for each of items (item_id, text), equal scores by doc_id."""
    docs = docs.select("doc_id", F.xxhash64("text").alias("h"), "text").where("text IS NOT NULL")
    rows = items.select("item_id", "text").where("text IS NOT NULL").distinct().orderBy("item_id", "text").toLocalIterator()
    found: list[DataFrame] = []
    while own := list(islice(rows, block_items)):
        if (one := _block(docs, own, items.schema, k, seeds)) is not None:
            found.append(one)
    if not found:
        return items.sparkSession.createDataFrame([], T.StructType([items.schema["item_id"], *(T.StructField(n, t) for n, t in (("rank", T.IntegerType()), ("doc_id", T.LongType()), ("score", T.LongType())))]))
    return reduce(DataFrame.unionByName, found)
