"""Substring dedup by paragraph MinHash banding.

Paragraphs of a text are of three kinds:

* lines: each line with at least ``min_words`` words. Distinct lines (by their sets of 5-word shingles) get MinHash signatures; bands and
  rows are tuned so that a pair at the threshold collides with at least ``recall``; colliding lines join on their band; pairs are
  verified by exact Jaccard similarity of shingle sets; components of the links are clusters.
* passages: ``passage_words`` words in a row, wherever they stand in lines. They begin at each shingle of least hash among ``reach`` shingles in a
  row, so any repeated run of passage_words + reach + 3 words (50) holds one whole passage that begins alike in all its copies.
  Passages of equal shingles are a cluster.
* stretches: ``stretch_words`` words in a row of a line that is too long to be alike to them as a whole. They begin at each shingle that is the least
  of those up to ``apart`` places away, so copies of a passage choose alike wherever they stand, and stretches of a text overlap too little to be
  alike. They go through the same bands (fewer of them: a word of a long copy is in two or three stretches), the same exact Jaccard similarity and the same
  components as lines, so copies with a word changed here and there are found inside long lines. With the numbers given, a word changed every 40
  words leaves a similarity of 0.756; beyond one change in 39 words a copy is none.

Within a cluster the first paragraph by (doc_id, start) stays, later ones are removed.

A band bucket of many lines gives a star around its member of smallest hash first. Members that the star leaves outside its
component are paired in blocks, not listed: see ``jaccard``, whose verification and block products this module shares.

Defined cases: null and empty texts have no paragraph; lines of fewer words, and lines without words, are kept; passages of fewer than
``variety`` changes from shingle to shingle (one word over and over) are no paragraphs, nor are stretches with a shingle that came before, in them or
as many places before them; lines and stretches that are alike are one cluster; a paragraph repeated within a document counts like one
in another; rows of equal doc_id and text share their fate; null doc_ids come last and are told apart by their texts; empty tables give no row; extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from statuta.llm.common import BROADCAST_ROWS, cut, parts_for, shared_folder
from statuta.llm.decontam import permuted
from statuta.llm.jaccard import _meet, dealing, histogram, resolve
from statuta.llm.packets import Dealer, gathered, planes, runs, unplanes
from statuta.llm.words import Texts, mix64, pieces, shingles, words

LINE, PASSAGE, STRETCH, HISTOGRAM = 0, 1, 2, 3
STRETCH_WORDS = 40
#: Bytes of text worked on at once: what is made of them stays in a processor's cache.
PIECE = 1 << 18
#: Blocks of an open cluster whose rows all meet, in one group or not.
WHOLE = 16
#: Paragraphs of a cluster that counts as large.
LARGE = 100_000
#: What a piece of the table tells of each paragraph; row is the row's place in the piece.
UNIT = {"row": np.uint32, "start": np.uint32, "size": np.uint32, "words": np.uint32, "shingles": np.uint32, "c": np.int64}


def tune(threshold: float, recall: float, least_rows: int = 2) -> tuple[int, int]:
    """(bands, rows): how many bands of that many rows let a pair at the threshold collide with the recall asked for."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**least_rows))), least_rows


class Seen:
    """Classes that a task has met lately, in a table of fixed size, a place for each remainder."""

    def __init__(self, bits: int = 20):
        self.held, self.mask = ~np.arange(1 << bits), (1 << bits) - 1  # no class of that place

    def fresh(self, classes: np.ndarray) -> np.ndarray:
        """Which of these are new: of equal ones the first, unless the table has it. A class that another has displaced is new again."""
        at = classes & self.mask
        out = np.zeros(len(classes), bool)
        out[np.unique(classes, return_index=True)[1]] = True
        out &= self.held[at] != classes
        self.held[at[out]] = classes[out]
        return out


class Lines:
    """The lines of some texts that are long enough: text, bytes, word count and shingles of each."""

    def __init__(self, t: Texts, min_words: int, worded: tuple | None = None):
        breaks = np.flatnonzero(t.buf == 10)
        begin = np.unique(np.concatenate([t.ends[:-1][np.diff(t.ends) > 0], breaks + 1]))
        begin = begin[begin < len(t.buf)]
        doc = np.searchsorted(t.ends, begin, "right") - 1
        hashed, start, _, _ = worded or words(t)
        edges = np.append(np.searchsorted(start, begin), len(hashed))
        found, bounds = shingles(hashed, edges)
        # of all lines, as they stand: shingles, where each line's begin, and its first word
        self.every, self.bounds, self.edges = found, bounds, edges
        kept = np.flatnonzero(np.diff(edges) >= max(min_words, 1))
        stop = np.minimum(np.append(begin[1:], len(t.buf)), t.ends[doc + 1])
        self.kept, self.doc, self.start, self.stop = kept, doc[kept], begin[kept], stop[kept]
        self.stop = self.stop - (t.buf[self.stop - 1] == 10)
        self.words, size = np.diff(edges)[kept], np.diff(bounds)[kept]
        line = np.repeat(np.arange(len(kept)), size)
        found = found[np.arange(len(line)) + np.repeat(bounds[kept] - np.cumsum(size) + size, size)]
        order = np.argsort(found)  # then by line: of small integers, which is a count
        found = found[order[np.argsort((line.astype(np.uint16) if len(kept) < 1 << 16 else line)[order], kind="stable")]]
        new = np.ones(len(found), bool)
        new[1:] = (found[1:] != found[:-1]) | (line[1:] != line[:-1])
        # the distinct shingles line by line, where each line's begin, how many they are, and their class
        self.found, self.sizes = found[new], np.bincount(line[new], minlength=len(kept))
        self.begin = np.cumsum(self.sizes) - self.sizes
        sums = np.add.reduceat(mix64(self.found), self.begin) if len(kept) else np.zeros(0, np.uint64)
        self.classes = mix64(sums + self.sizes.astype(np.uint64)).view(np.int64)


def passages(t: Texts, worded: tuple, length: int, reach: int, variety: int) -> tuple[np.ndarray, ...]:
    """Text, first and end byte, and class of each passage."""
    hashed, start, end, first = worded
    found, bounds = shingles(hashed, first)
    span = length - 4
    none = np.zeros(0, np.int64)
    if length < 5 or len(found) < span:
        return none, none, none, none
    # the upper half of the hash, then the later place: equal runs choose alike; with reach places between texts, so that none depends on its neighbours
    own = np.arange(len(found)) + reach * (np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)) + 1)
    low = np.full(own[-1] + reach + 1, np.iinfo(np.uint64).max, np.uint64)
    low[own] = (found & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - np.arange(len(found), dtype=np.uint64))
    far = 1
    while 2 * far <= reach:
        low = np.minimum(low[:-far], low[far:])
        far *= 2
    if far < reach:
        low = np.minimum(low[: len(low) - (reach - far)], low[reach - far :])
    at = np.unique(np.uint64(0xFFFFFFFF) - (low[low < np.iinfo(np.uint64).max] & np.uint64(0xFFFFFFFF))).astype(np.int64)
    at = at[at + span <= len(found)]
    text = np.searchsorted(bounds, at, "right") - 1
    changes = np.concatenate([[0], np.cumsum(found[1:] != found[:-1])])
    fine = (at + span <= bounds[text + 1]) & (np.diff(first)[text] >= length) & (changes[at + span - 1] - changes[at] >= variety)
    at, text = at[fine], text[fine]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(found))])
    word = first[text] + at - bounds[text]
    return text, start[word], end[word + length - 1], mix64(sums[at + span] - sums[at] + np.uint64(1) + (np.uint64(1) << np.uint64(40))).view(np.int64)


class Stretches:
    """Stretches of long lines: text, first and end byte, shingles (a sorted row each) and class."""

    def __init__(self, t: Texts, worded: tuple, lines: Lines, length: int, apart: int, hundredths: int):
        _, first, last, _ = worded
        span, found, bounds = max(length - 4, 1), lines.every, lines.bounds
        # the whole line has every shingle of its stretches: it must have too many more to be alike
        long = np.flatnonzero((100 * span < hundredths * lines.sizes) & (np.diff(bounds)[lines.kept] >= span)) if length >= 5 else np.zeros(0, np.int64)
        size = np.diff(bounds)[lines.kept[long]]
        line = np.repeat(np.arange(len(long)), size)
        place = np.arange(len(line)) - np.repeat(np.cumsum(size) - size, size)
        found = found[place + np.repeat(bounds[lines.kept[long]], size)]
        # lines with apart places between them, so that what is least does not depend on neighbours
        spread = np.full(len(found) + apart * (len(long) + 1), np.iinfo(np.uint64).max, np.uint64)
        own = np.arange(len(found)) + apart * (line + 1)
        spread[own] = found
        low, far, reach = spread, 1, 2 * apart + 1
        while 2 * far <= reach and len(found):
            low, far = np.minimum(low[:-far], low[far:]), 2 * far
        if far < reach and len(found):
            low = np.minimum(low[: len(low) - (reach - far)], low[reach - far :])
        at = np.flatnonzero((place + span <= size[line]) & (low[own - apart] == found)) if len(found) else np.zeros(0, np.int64)
        order = np.argsort(found)
        same = np.flatnonzero(found[order[1:]] == found[order[:-1]])
        order = order[np.union1d(same, same + 1)]  # of shingles that occur again, by their places
        order = order[np.lexsort((order, found[order]))]
        before = np.full(len(found), -1, np.int64)
        same = found[order[1:]] == found[order[:-1]]
        before[order[1:][same]] = order[:-1][same]
        whole = at[:, None] + np.arange(span)
        at = at[(before[whole].max(1, initial=-1) < np.maximum(at - span, at - place[at]))]
        self.found = np.sort(found[at[:, None] + np.arange(span)], axis=1)
        word = lines.edges[lines.kept[long[line[at]]]] + place[at]
        self.doc, self.start, self.stop = lines.doc[long[line[at]]], first[word], last[word + length - 1]
        self.classes = mix64(mix64(self.found.reshape(-1)).reshape(len(at), span).sum(1, dtype=np.uint64) + np.uint64(span)).view(np.int64)

    def histograms(self, bins: int) -> np.ndarray:
        """Counts of each stretch's hashes in bins by their first bits, as ``jaccard.histogram`` has them."""
        k = len(self.found)
        place = (self.found >> np.uint64(64 - (bins.bit_length() - 1))).astype(np.int64) + np.arange(k)[:, None] * bins
        return np.minimum(np.bincount(place.reshape(-1), minlength=k * bins), 255).astype(np.uint8)


def _listed(ids: pa.Array, hashes: pa.Array, kind: int, columns: dict[str, np.ndarray]) -> tuple:
    data = np.array([len(ids)], np.int64).tobytes() + np.array([-1 if i is None else i for i in ids.to_pylist()], np.int64).tobytes()
    data += np.array([i is None for i in ids.to_pylist()], np.uint8).tobytes() + hashes.to_numpy().tobytes()
    return kind, data + b"".join(planes(columns[k].astype(d)) for k, d in UNIT.items())


def _unlisted(kind: int, data: bytes) -> pa.RecordBatch:
    n = int(np.frombuffer(data[:8], np.int64)[0])
    at = 8
    ids, at = np.frombuffer(data[at : at + 8 * n], np.int64), at + 8 * n
    null, at = np.frombuffer(data[at : at + n], np.uint8).astype(bool), at + n
    hashes, at = np.frombuffer(data[at : at + 8 * n], np.int64), at + 8 * n
    k = (len(data) - at) // sum(np.dtype(d).itemsize for d in UNIT.values())
    x = {}
    for name, d in UNIT.items():
        size = k * np.dtype(d).itemsize
        x[name], at = unplanes(data[at : at + size], d), at + size
    row = x["row"].astype(np.int64)
    start = x["start"].astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(ids[row], mask=null[row]), pa.array(hashes[row]), pa.array(np.full(k, kind, np.int8)), pa.array(start), pa.array(start + x["size"]), pa.array(x["words"].astype(np.int32)), pa.array(x["shingles"].astype(np.int32)), pa.array(x["c"])],
                                      ["doc_id", "h", "kind", "start", "end", "n_words", "n", "c"])


UNITS = "doc_id long, h long, kind tinyint, start long, end long, n_words int, n int, c long"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for kind, data in zip(batch.column(batch.schema.get_field_index("kind")).to_pylist(), batch.column(batch.schema.get_field_index("data"))):
            yield _unlisted(kind, data.as_py())


def _classes(blocks: int):
    """The classes of the table's paragraphs with their numbers in the task, dealt to buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer, held, n = Dealer(["c", "many"]), [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            c, k = np.unique(np.concatenate(held), return_counts=True)
            yield from dealer.add((c.view(np.uint64) % np.uint64(blocks)).astype(np.int32), c, (k > 1).astype(np.uint8))

        for batch in batches:
            for data in batch.column(batch.schema.get_field_index("data")):
                b = data.as_py()
                docs = int(np.frombuffer(b[:8], np.int64)[0])
                k = (len(b) - 8 - 17 * docs) // sum(np.dtype(d).itemsize for d in UNIT.values())
                held.append(unplanes(b[len(b) - 8 * k :], np.int64))
                n += k
            if n >= 1_000_000:
                yield from flush()
                held, n = [], 0
        if held:
            yield from flush()
        yield from dealer.flush()

    return run


def _repeated(table: pa.Table) -> pa.Table:
    """Classes that occur more than once."""
    c, many = gathered(table, "c", np.int64), gathered(table, "many", np.uint8)
    order = np.argsort(c, kind="stable")
    c, many = c[order], many[order]
    starts, ends = runs(c)
    twice = (ends - starts > 1) | (many[starts] > 0)
    return pa.table({"c": pa.array(c[starts[twice]])})


def _histograms(span: int, bins: int):
    """Classes of stretches with their histograms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(batch.schema.get_field_index("data")).to_pylist():
                k = len(data) // (8 + bins)
                hists = [data[8 * k + bins * i : 8 * k + bins * (i + 1)] for i in range(k)]
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(data[: 8 * k], np.int64)), pa.array(np.full(k, span, np.int32)), pa.array(hists, pa.binary())], ["c", "n", "hist"])

    return run


def _wide(table: pa.Table) -> pa.Table:
    """Bands with the types that ``_meet`` takes."""
    token, size = gathered(table, "token", np.uint32).astype(np.uint64), gathered(table, "size", np.uint32).astype(np.int32)
    return pa.table({"token": pa.array([token.tobytes()], pa.binary()), "row": pa.array([gathered(table, "row", np.int64).tobytes()], pa.binary()), "size": pa.array([size.tobytes()], pa.binary())})


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: as a checkpoint, but its columns are compressed."""
    path = f"{shared_folder(df.sparkSession)}/paragraphs-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def find(docs: DataFrame, *, min_words: int = 1, hundredths: int = 75, recall: float = 0.9999, passage_words: int = 25, reach: int = 22, variety: int = 8, stretch_words: int | None = None, apart: int = 8, stretch_recall: float = 0.99) -> DataFrame:
    """A row for each paragraph of a cluster of two or more: doc_id, h (the text's hash), start and end (bytes of the text), n_words, first_doc_id, first_start, n_copies, removed. passage_words=0 leaves passages out and, where stretch_words is not given (40 otherwise), stretches; stretch_words=0 leaves out stretches alone."""
    if stretch_words is None:
        stretch_words = STRETCH_WORDS if passage_words else 0
    span = stretch_words - 4
    if stretch_words and 100 * (span - apart - 1) >= hundredths * (span + apart + 1):
        raise ValueError("stretches that begin so near to each other would be alike: let apart be larger")
    bands, rows = tune(hundredths / 100, recall)
    fewer, _ = tune(hundredths / 100, stretch_recall)
    bins = len(histogram(np.zeros(max(span, 1), np.uint64)))
    source = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    blocks = parts_for(source, 4 << 20)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The paragraphs of each piece, a row for each kind."""
        for batch, t in pieces(batches, "text", PIECE):
            worded = words(t)
            lines = Lines(t, min_words, worded)
            wide = Stretches(t, worded, lines, stretch_words, apart, hundredths)
            text, start, end, c = passages(t, worded, passage_words, reach, variety)
            each = {LINE: {"row": lines.doc, "start": lines.start - t.ends[lines.doc], "size": lines.stop - lines.start, "words": lines.words, "shingles": lines.sizes, "c": lines.classes},
                    PASSAGE: {"row": text, "start": start - t.ends[text], "size": end - start, "words": np.full(len(c), passage_words), "shingles": np.full(len(c), passage_words - 4), "c": c},
                    STRETCH: {"row": wide.doc, "start": wide.start - t.ends[wide.doc], "size": wide.stop - wide.start, "words": np.full(len(wide.doc), stretch_words), "shingles": np.full(len(wide.doc), span), "c": wide.classes}}
            kinds = [_listed(batch.column(0), batch.column(1), kind, x) for kind, x in each.items() if len(x["c"])]
            if len(wide.doc):
                kinds.append((HISTOGRAM, wide.classes.tobytes() + wide.histograms(bins).tobytes()))
            if kinds:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in kinds], pa.int8()), pa.array([d for _, d in kinds], pa.binary())], ["kind", "data"])

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bands of distinct lines and stretches, dealt to buckets: half of the band's hash, class and size."""
        dealer, seen = Dealer(["token", "row", "size"]), Seen()
        for _, t in pieces(batches, "text", PIECE):
            worded = words(t)
            lines = Lines(t, min_words, worded)
            wide = Stretches(t, worded, lines, stretch_words, apart, hundredths)
            # a set of k differs from any other by one of k + 1 at least: smaller ones are alike only if equal, which classes tell
            linked = np.concatenate([100 * lines.sizes >= hundredths * (lines.sizes + 1), np.ones(len(wide.doc), bool)])
            classes, sizes = np.concatenate([lines.classes, wide.classes]), np.concatenate([lines.sizes, np.full(len(wide.doc), span)])
            chosen = linked.copy()
            chosen[linked] = seen.fresh(classes[linked])
            every = np.concatenate([lines.found, wide.found.reshape(-1)])[np.repeat(chosen, sizes)]
            classes, sizes, line = classes[chosen], sizes[chosen], int(chosen[: len(lines.sizes)].sum())
            at = np.cumsum(sizes) - sizes
            for b in range(bands):
                n = len(at) if b < fewer else line
                if not n:
                    continue
                key, some = np.full(n, b + 1, np.uint64), every[: at[n - 1] + sizes[n - 1]]
                for r in range(rows):
                    key = mix64(key * np.uint64(31) + np.minimum.reduceat(permuted(some, b * rows + r), at[:n]))
                # the bucket comes from the lower half, so in it the upper half tells bands apart
                low, high = (key & np.uint64(0xFFFFFFFF)) % np.uint64(blocks), (key >> np.uint64(32)).astype(np.uint32)
                yield from dealer.add(low.astype(np.int32), high, classes[:n], sizes[:n].astype(np.uint32))
        yield from dealer.flush()

    scanned = written(source.mapInArrow(listed, "kind tinyint, data binary"))
    table = scanned.where(F.col("kind") != HISTOGRAM)
    dealt = source.mapInArrow(banded, "bucket int, token binary, row binary, size binary")
    met = written(dealt.groupBy("bucket").applyInArrow(lambda x: _meet(_wide(x), hundredths), "a long, b long, g long, n int"))
    compared = table.where(F.col("kind") != PASSAGE).mapInArrow(_rows, UNITS)
    deal = dealing(source, compared, lambda t: _sets(t, min_words, stretch_words, apart, hundredths))
    # histograms of stretches discard candidates before their sets travel; lines go without
    lines_only = table.where(F.col("kind") == LINE).mapInArrow(_rows, UNITS).select("c", "n", F.lit(None).cast("binary").alias("hist"))
    hists = scanned.where(F.col("kind") == HISTOGRAM).mapInArrow(_histograms(span, bins), "c long, n int, hist binary")
    roots = resolve(met, lines_only.unionByName(hists), deal, hundredths, WHOLE)
    twice = table.mapInArrow(_classes(blocks), "bucket int, c binary, many binary").groupBy("bucket").applyInArrow(_repeated, "c long")
    clustered = cut(twice.join(roots.withColumnRenamed("node", "c"), "c", "full").select("c", F.coalesce("root", "c").alias("root")))
    few = clustered.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    placed = table.mapInArrow(_rows, UNITS).join(F.broadcast(clustered) if few else clustered, "c").select("root", "doc_id", "h", "start", "end", "n_words")
    order = F.struct(F.isnull("doc_id").alias("u"), "doc_id", "h", "start")
    clusters = cut(placed.groupBy("root").agg(F.count("*").alias("n_copies"), F.min(order).alias("first")).where("n_copies > 1"))
    if clusters.limit(BROADCAST_ROWS // 4 + 1).count() <= BROADCAST_ROWS // 4:
        out = placed.join(F.broadcast(clusters), "root")
    else:  # large clusters are few: their rows stay where they are, those of the others shuffle
        large = clusters.where(F.col("n_copies") > LARGE)
        rest = placed.join(F.broadcast(large.select("root")), "root", "left_anti").join(clusters.where(F.col("n_copies") <= LARGE), "root")
        out = placed.join(F.broadcast(large), "root").unionByName(rest)
    return out.select("doc_id", "h", "start", "end", "n_words", F.col("first.doc_id").alias("first_doc_id"), F.col("first.start").alias("first_start"), "n_copies", (order != F.col("first")).alias("removed"))


def _sets(t: Texts, min_words: int, stretch_words: int, apart: int, hundredths: int) -> list[dict[int, np.ndarray]]:
    """The sets of each text's lines and stretches by their classes."""
    worded = words(t)
    lines = Lines(t, min_words, worded)
    wide = Stretches(t, worded, lines, stretch_words, apart, hundredths)
    out: list[dict[int, np.ndarray]] = [{} for _ in range(len(t.ends) - 1)]
    for doc, c, s, n in zip(lines.doc.tolist(), lines.classes.tolist(), lines.begin.tolist(), lines.sizes.tolist()):
        out[doc][c] = lines.found[s : s + n]
    for doc, c, own in zip(wide.doc.tolist(), wide.classes.tolist(), wide.found):
        out[doc][c] = own
    return out


def clean(docs: DataFrame, **options) -> DataFrame:
    """docs without the paragraphs to remove; a line goes with its line break where nothing of it is left. n_chars, where there is one, is counted anew."""
    gone = find(docs, **options).where("removed").groupBy(F.col("doc_id").alias("_d"), F.col("h").alias("_h")).agg(F.collect_set(F.struct("start", "end")).alias("_gone"))
    rows = docs.select(F.struct("*").alias("r"))
    joined = rows.join(gone, F.col("r.doc_id").eqNullSafe(F.col("_d")) & (F.xxhash64("r.text") == F.col("_h")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                texts.append(text if not spans else remaining(text, [(x["start"], x["end"]) for x in spans]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["r", "t"])

    cleaned = joined.select("r", F.col("r.text").alias("t"), "_gone").mapInArrow(run, StructType([StructField("r", docs.schema), StructField("t", StringType())]))
    new = {"text": F.col("t")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("t") != F.col("r.text"), F.length("t").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("r.n_chars"))
    return cleaned.select(*[new.get(c, F.col(f"r.`{c}`")).alias(c) for c in docs.columns])


def remaining(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without these spans of its UTF-8 bytes, and without the lines of which they leave nothing."""
    data = text.encode()
    keep = np.ones(len(data), bool)
    for s, e in spans:
        keep[s:e] = False
    out, at = [], 0
    for line in data.split(b"\n"):
        own = keep[at : at + len(line)]
        if not len(line) or own.any():
            out.append(np.frombuffer(line, np.uint8)[own].tobytes())
        at += len(line) + 1
    return b"\n".join(out).decode("utf-8", "ignore")
