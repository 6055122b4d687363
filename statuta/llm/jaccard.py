"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

Two documents link when the Jaccard similarity of their sets of 5-word shingles is at least 0.75. Documents of equal sets are one row of
the matrix (a class). Work goes in these steps:

1. one pass over the texts gives each document's class and two count sketches (of fixed size): how many documents hold a shingle, and how often a word occurs;
2. columns are ordered rare first: by the count that a shingle's words foresee, and by what its slot of the sketch has beyond the usual load of
   slots. In a large corpus all slots are full of other shingles; the words still tell which shingles meet by chance. A link of sets x and y needs an overlap of 0.75 * max(|x|, |y|), so it shows among the
   first |x| - ceil(0.75 |x|) + 1 columns of each; only these entries are dealt to column blocks;
3. each block of columns finds the rows that meet in a column. Few rows give all pairs within the size bound 0.75 * max <= min; many rows give a
   star around the row of smallest hash, and the group itself is kept;
4. pairs whose overlap the sets' histograms bound below what the sizes ask for are discarded. Each set left is dealt once to every block it is
   needed in, straight from its text: the block of a star holds the star's centre and its members in a row, and their overlap counts accumulate
   over the centre's columns, so memory is a batch; links give components. Groups that still hold several components are multiplied out in
   blocks of rows (those of the largest component meet only blocks of others), one by one or, where that deals fewer rows, all that share rows at once: histograms first, then the rows that have a possible partner; a block pair accumulates overlap counts column by
   column and keeps a spanning forest of the links found, so no pair is lost and no group is held or listed whole;
5. components of all links give each document the smallest doc_id it reaches.

Defined cases: a text of fewer than five words is one shingle; no text, or none but white space, links with nothing; equal rows are
copies of one another; rows with a null doc_id take part (a row is known by its doc_id and its text's hash) and get the smallest known doc_id of their component,
null where there is none; an empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuta.llm.common import BROADCAST_ROWS, cut, parts_for, without
from statuta.llm.components import components
from statuta.llm.packets import Dealer, gathered, runs
from statuta.llm.words import Texts, mix64, pieces, shingles, words

SKETCH_BITS, SLICE_BITS, WORD_BITS = 22, 18, 20
#: Rows that meet in a column and are paired at once; groups of more get a star, and blocks if need be.
SMALL = 8
#: Bits of a column's number that tell how rare it is; the others are its hash.
RANK_BITS = 10
#: Rows and shingles of a block of a large group, and shingles of a star's block.
BLOCK, BLOCK_SHINGLES, STAR_SHINGLES = 256, 1 << 19, 1 << 22
#: Rows that a task deals to blocks.
DEALT_ROWS = 50_000


def sets_of(t, n: int = 5, worded: tuple | None = None) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text."""
    hashed, _, _, first = worded or words(t)
    found, bounds = shingles(hashed, first, n)
    for i in range(len(bounds) - 1):
        yield np.unique(found[bounds[i] : bounds[i + 1]])


def class_of(s: np.ndarray) -> int:
    """A 64-bit name of a set."""
    return int(mix64(np.array([mix64(s).sum() + np.uint64(len(s))], np.uint64))[0].view(np.int64)) if len(s) else 0


def histogram(s: np.ndarray) -> bytes:
    """Counts of the set's hashes in bins by their first bits, two to four hashes to a bin; a count of 255 stands for any larger one, too.

    The sum of the smaller counts of two sets bounds their overlap from above; neighbouring bins add up to half as many.
    """
    bits = max(3, (len(s) // 4).bit_length())
    return np.minimum(np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def _halved(x: np.ndarray) -> np.ndarray:
    """Histograms with half the bins; a bin that gets full may stand for any larger count."""
    return np.minimum(x[:, ::2].astype(np.int32) + x[:, 1::2], 255)


def _slot(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _word_slot(hashed: np.ndarray) -> np.ndarray:
    """Words have their slots after those of shingles."""
    return (hashed >> np.uint64(64 - WORD_BITS)).astype(np.int64) + (1 << SKETCH_BITS)


def columns_of(t, n: int, level: np.ndarray, base: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The set of each text and its columns, rare first: numbers that begin with the rank, equal for equal shingles. base: the rank of a count of one."""
    hashed, _, _, first = words(t)
    found, bounds = shingles(hashed, first, n)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    at = np.arange(len(found)) - bounds[text] + first[text]
    sums = np.concatenate([[0], np.cumsum(level[_word_slot(hashed)], dtype=np.int64)])
    foreseen = sums[np.minimum(at + n, first[text + 1])] - sums[at]
    seen = level[_slot(found)].astype(np.int64)
    rank = np.minimum(np.maximum(foreseen, np.where(seen > 0, seen + base, 0)), (1 << RANK_BITS) - 1).astype(np.uint64)
    columns = (rank << np.uint64(64 - RANK_BITS)) | (found >> np.uint64(RANK_BITS))
    for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        yield np.unique(found[s:e]), np.unique(columns[s:e])


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "h", "n", "c", "hist", "slice", "counts"]
    sketch = np.zeros((1 << SKETCH_BITS) + (1 << WORD_BITS), np.uint32)
    for batch, t in pieces(batches, "text"):
        worded = words(t)
        sizes, classes, seen, hists = [], [], [_word_slot(worded[0])], []
        for s in sets_of(t, worded=worded):
            sizes.append(len(s))
            classes.append(class_of(s))
            seen.append(_slot(s))
            hists.append(histogram(s))
        np.add.at(sketch, np.concatenate(seen), 1)
        k = len(sizes)
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), batch.column(batch.schema.get_field_index("h")), pa.array(sizes, pa.int32()), pa.array(classes, pa.int64()), pa.array(hists, pa.binary()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names)
    for i in range(len(sketch) >> SLICE_BITS):
        part = sketch[i << SLICE_BITS : (i + 1) << SLICE_BITS]
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([i], pa.int32()), pa.array([zlib.compress(part.astype(np.uint32).tobytes(), 1)], pa.binary())], names)


def _levels(table: pa.Table) -> pa.Table:
    """Counts of a slice added up, as steps of a quarter of a doubling: of words as they are, of shingles what is beyond the load and the noise of slots."""
    i, total = table.column("slice")[0].as_py(), np.zeros(1 << SLICE_BITS, np.uint64)
    for x in table.column("counts"):
        total += np.frombuffer(zlib.decompress(x.as_py()), np.uint32)
    if i < 1 << (SKETCH_BITS - SLICE_BITS):
        load = float(np.median(total))
        steps = np.log2(1 + np.where(total > load + 4 * np.sqrt(load), total - max(load, 1.0), 0).clip(0))
    else:
        steps = np.log2(np.maximum(total, 1))
    level = np.minimum(255, np.round(4 * steps)).astype(np.uint8)
    return pa.table({"slice": pa.array([i], pa.int32()), "level": pa.array([level.tobytes()], pa.binary()), "total": pa.array([int(total.sum())], pa.int64())})


def _needed(n: int, hundredths: int) -> int:
    return -(-hundredths * n // 100)


def _distinct(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The pairs, a row each, copies left out (save where two pairs have one key, which ``resolve`` sees to)."""
    order = np.argsort(mix64(a.view(np.uint64)) * np.uint64(31) + b.view(np.uint64))
    a, b = a[order], b[order]
    fresh = np.ones(len(a), bool)
    fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return np.stack([a[fresh], b[fresh]], 1)


def _meet(table: pa.Table, hundredths: int) -> pa.Table:
    """Pairs (a of the smaller hash, a star's centre) and large groups of the rows that meet in a column of this block. Group rows have b null, pairs g null."""
    token, row, size = gathered(table, "token", np.uint64), gathered(table, "row", np.int64), gathered(table, "size", np.int32)
    order = np.argsort(token)
    starts, ends = runs(token[order])
    order = order[np.repeat(ends - starts > 1, ends - starts)]  # most columns have one row, which meets none
    order = order[np.lexsort((row[order], token[order]))]
    token, row, size = token[order], row[order], size[order]
    fresh = np.ones(len(token), bool)
    fresh[1:] = (token[1:] != token[:-1]) | (row[1:] != row[:-1])
    token, row, size = token[fresh], row[fresh], size[fresh]
    starts, ends = runs(token)
    hashed = mix64(row.view(np.uint64))
    left, right, groups, seen = [], [], [], set()
    for k in range(2, SMALL + 1):
        i, j = np.triu_indices(k, 1)
        at = starts[ends - starts == k][:, None]
        i, j = (at + i).reshape(-1), (at + j).reshape(-1)
        swap = hashed[i] > hashed[j]
        left.append(np.where(swap, j, i))
        right.append(np.where(swap, i, j))
    large = ends - starts > SMALL
    for s, e in zip(starts[large].tolist(), ends[large].tolist()):
        key = row[s:e].tobytes()
        if key in seen:
            continue
        seen.add(key)
        lead = s + int(np.argmin(hashed[s:e]))
        right.append(np.delete(np.arange(s, e), lead - s))
        left.append(np.full(e - s - 1, lead))
        groups.append((np.full(e - s, np.bitwise_xor.reduce(hashed[s:e]).view(np.int64)), row[s:e], size[s:e]))
    i, j = np.concatenate(left), np.concatenate(right)
    ok = 100 * np.minimum(size[i], size[j]).astype(np.int64) >= hundredths * np.maximum(size[i], size[j]).astype(np.int64)
    pairs = _distinct(row[i[ok]], row[j[ok]])
    g, r, n = (np.concatenate(x) for x in zip(*groups)) if groups else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32))
    k = len(pairs)
    return pa.table({"a": pa.array(np.concatenate([pairs[:, 0], r])), "b": pa.concat_arrays([pa.array(pairs[:, 1]), pa.nulls(len(r), pa.int64())]), "g": pa.concat_arrays([pa.nulls(k, pa.int64()), pa.array(g)]), "n": pa.concat_arrays([pa.nulls(k, pa.int32()), pa.array(n)])})


def _verify(hundredths: int):
    """Links between the centre and the members of stars, whose rows come one after another with the centre first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        star, centre = None, np.zeros(0, np.uint64)
        for batch in batches:
            p, q, c, first = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            sets = batch.column(4)
            links: list[np.ndarray] = []
            new = np.ones(len(p), bool)
            new[1:] = (p[1:] != p[:-1]) | (q[1:] != q[:-1])
            starts = np.flatnonzero(new)
            for s, e in zip(starts, np.append(starts[1:], len(p))):
                while s < e and first[s]:  # a centre may come from several equal rows
                    star, centre = (p[s], q[s]), np.frombuffer(sets[s].as_buffer(), np.uint64)
                    s += 1
                if s == e or star != (p[s], q[s]):
                    continue
                rows = [np.frombuffer(sets[i].as_buffer(), np.uint64) for i in range(s, e)]
                sizes = np.array([len(x) for x in rows])
                token = np.concatenate(rows)
                place = np.minimum(np.searchsorted(centre, token), len(centre) - 1)
                overlap = np.add.reduceat((centre[place] == token).astype(np.int64), np.cumsum(sizes) - sizes)
                linked = c[s:e][_possible(overlap, sizes, len(centre), hundredths)]
                links.append(np.stack([np.full(len(linked), p[s]), linked], 1))
            if links:
                a, b = np.concatenate(links).T
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(a)), pa.array(np.ascontiguousarray(b))], ["a", "b"])

    return run


def _possible(overlap: np.ndarray, n: np.ndarray, m: np.ndarray | int, hundredths: int) -> np.ndarray:
    """Whether sets of n and m with this overlap link."""
    return 100 * overlap >= hundredths * (n + m - overlap)


def _alike(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, hundredths: int) -> np.ndarray:
    """Whether histograms of as many bins leave a link possible."""
    full = (x == 255).any(-1) | (y == 255).any(-1)
    return full | _possible(np.minimum(x, y).sum(-1, dtype=np.int64), n, m, hundredths)


def _bounded(hundredths: int):
    """Pairs that the histograms x and y (of sets of n and m) leave possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            n, m = batch.column(4).to_numpy().astype(np.int64), batch.column(5).to_numpy().astype(np.int64)
            keep = np.zeros(len(n), bool)
            kinds = np.array([len(v) for v in x]) * (1 << 32) + np.array([len(v) for v in y])
            for kind in np.unique(kinds).tolist():
                at = np.flatnonzero(kinds == kind)
                u, v = (np.frombuffer(b"".join(side[i] for i in at), np.uint8).reshape(len(at), -1) for side in (x, y))
                while u.shape[1] > v.shape[1]:
                    u = _halved(u)
                while v.shape[1] > u.shape[1]:
                    v = _halved(v)
                keep[at] = _alike(u, v, n[at], m[at], hundredths)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))

    return run


def _partners(hundredths: int):
    """Of a block pair, what joins the rows that their histograms leave alike (a and b), and the rows that may link with one that has no histogram, or have none (a; b is null)."""

    def run(table: pa.Table) -> pa.Table:
        hists, root, n, a = table.column("hist").to_pylist(), table.column("root").to_numpy(), table.column("n").to_numpy().astype(np.int64), table.column("a").to_numpy()
        bins, label = np.array([len(h or b"") for h in hists]), np.arange(len(hists))
        bare, left, right = np.flatnonzero(bins == 0), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        fits = (root[bare][:, None] != root) & (100 * np.minimum(n[bare][:, None], n) >= hundredths * np.maximum(n[bare][:, None], n))
        direct = fits.any(0)
        direct[bare] |= fits.any(1)
        for size in np.unique(bins[bins > 0]).tolist():
            # linked sets differ by a third in size at most, so their bins by a factor of two
            own, above = np.flatnonzero(bins == size), np.flatnonzero(bins == 2 * size)
            at = np.concatenate([own, above])
            x = np.frombuffer(b"".join(hists[i] for i in own), np.uint8).reshape(len(own), size).astype(np.int32)
            if len(above):
                x = np.concatenate([x, _halved(np.frombuffer(b"".join(hists[i] for i in above), np.uint8).reshape(len(above), 2 * size))])
            for k, i in enumerate(own):
                met = at[(root[at] != root[i]) & _alike(x, x[k], n[at], n[i], hundredths)]
                far, first = np.unique(label[met], return_index=True)
                first, far = first[far != label[i]], far[far != label[i]]
                if len(far):
                    left.append(np.full(len(far), a[i]))
                    right.append(a[met[first]])
                    label[np.isin(label, np.append(far, label[i]))] = min(label[i], far[0])
        left, right = np.concatenate(left), np.concatenate(right)
        g, i, j = (table.column(k)[0].as_py() for k in ("g", "i", "j"))
        m = len(left) + int(direct.sum())
        return pa.table({"g": pa.array([g] * m, pa.int64()), "i": pa.array([i] * m, pa.int32()), "j": pa.array([j] * m, pa.int32()), "a": pa.array(np.concatenate([left, a[direct]])), "b": pa.concat_arrays([pa.array(right), pa.nulls(int(direct.sum()), pa.int64())])})

    return run


class Forest:
    """Which rows are joined already."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def _multiply(hundredths: int):
    """Overlap counts of a block pair's rows, accumulated by columns; a spanning forest of the links."""

    def run(table: pa.Table) -> pa.Table:
        by = {r: np.frombuffer(x.as_py(), np.uint64) for r, x in zip(table.column("c").to_pylist(), table.column("set"))}
        rows = sorted(by)
        sizes = np.array([len(by[r]) for r in rows], np.int64)
        token = np.concatenate([by[r] for r in rows])
        owner = np.repeat(np.arange(len(rows)), sizes)
        order = np.argsort(token, kind="stable")
        token, owner = token[order], owner[order]
        overlap = np.zeros((len(rows), len(rows)), np.int32)
        starts, ends = runs(token)
        many = np.flatnonzero(ends - starts > 1)
        sets: dict[bytes, int] = {}
        for k in many:  # equal columns count once with their number
            key = owner[starts[k] : ends[k]].astype(np.int32).tobytes()
            sets[key] = sets.get(key, 0) + 1
        for key, times in sets.items():
            at = np.frombuffer(key, np.int32)
            overlap[np.ix_(at, at)] += times
        union = sizes[:, None] + sizes[None] - overlap
        i, j = np.nonzero(np.triu(100 * overlap.astype(np.int64) >= hundredths * union, 1))
        forest = Forest(len(rows))
        kept = [(rows[x], rows[y]) for x, y in zip(i, j) if forest.join(int(x), int(y))]
        return pa.table({"a": pa.array([p[0] for p in kept], pa.int64()), "b": pa.array([p[1] for p in kept], pa.int64())})

    return run


def extracted(sets: Callable[[Texts], list[dict[int, np.ndarray]]]):
    """For mapInArrow over (text, _want): each class wanted of a row, to each of its places. sets gives a text's classes and sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()  # rows that are known by the same id and text come once a task
        for batch, t in pieces(batches, "text", 1 << 18):
            want, out = batch.column(batch.schema.get_field_index("_want")).to_pylist(), []
            for known, asked in zip(sets(t), want):
                for x in asked:
                    if x["c"] in known and x["c"] not in done:
                        if len(done) < 500_000:
                            done.add(x["c"])
                        data = known[x["c"]].tobytes()
                        out += [(to["p"], to["q"], x["c"], to["first"], data) for to in x["to"]]
            for at in range(0, len(out), 1000):
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out[at : at + 1000]), (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()))], ["p", "q", "c", "first", "set"])

    return run


PLACED = "p long, q long, c long, first boolean, set binary"


def dealing(source: DataFrame, owners: DataFrame, sets: Callable[[Texts], list[dict[int, np.ndarray]]]) -> Callable[[DataFrame], DataFrame]:
    """A function that takes (c, p, q, first) and gives the rows of PLACED. source: doc_id, h, text; owners: c, doc_id, h of rows that have c."""

    def deal(places: DataFrame) -> DataFrame:
        wanted = cut(places.select("c").distinct())
        few = wanted.limit(BROADCAST_ROWS // 8 + 1).count() <= BROADCAST_ROWS // 8
        held = owners.join(F.broadcast(wanted) if few else wanted, "c", "left_semi")  # before rows are sorted for their groups
        owner = held.groupBy("c").agg(F.min(F.struct(F.isnull("doc_id").alias("u"), "doc_id", "h")).alias("o")).select("c", F.col("o.doc_id").alias("_d"), F.col("o.h").alias("_h"))
        to = places.groupBy("c").agg(F.collect_list(F.struct("p", "q", "first")).alias("to"))
        chosen = cut(to.join(owner, "c").groupBy("_d", "_h").agg(F.collect_list(F.struct("c", "to")).alias("_want")))
        n = chosen.agg(F.coalesce(F.sum(F.aggregate("_want", F.lit(1), lambda k, x: k + 1 + F.size(x["to"]))), F.lit(0))).first()[0]
        on = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("h") == F.col("_h"))
        return source.join(F.broadcast(chosen) if n <= BROADCAST_ROWS else chosen, on).select("text", "_want").mapInArrow(extracted(sets), PLACED)

    return deal


def _sizes(rows: DataFrame, own: list[str]) -> DataFrame:
    """For each group (own) of rows (a, root, n) its largest component (main), the blocks of that (km) and of other rows (k), and how many rows are dealt to their pairs (cost).

    Rows of the main component need no look at one another: their blocks meet those of other rows only.
    """
    by_root = rows.groupBy(*own, "root").agg(F.count("*").alias("count"), F.sum("n").alias("n"))
    groups = by_root.groupBy(*own).agg(F.max(F.struct("count", "root", "n")).alias("m"), F.sum("count").alias("count"), F.sum("n").alias("n"))
    blocks = lambda count, n: F.ceil(F.greatest(count / BLOCK, n / BLOCK_SHINGLES)).cast("int")
    main, rest = F.col("m.count"), F.col("count") - F.col("m.count")
    several = blocks(F.col("count"), F.col("n")) > 1  # else all rows are in one block
    sizes = groups.where(rest > 0).select(*own, F.when(several, F.col("m.root")).alias("main"), F.when(several, blocks(main, F.col("m.n"))).otherwise(0).alias("km"), F.when(several, blocks(rest, F.col("n") - F.col("m.n"))).otherwise(1).alias("k"),
                                          F.when(several, main).otherwise(0).alias("count"), F.when(several, rest).otherwise(F.col("count")).alias("rest"))
    return sizes.select(*own, "main", "km", "k", (F.col("count") * F.col("k") + F.col("rest") * (F.col("km") + F.col("k"))).alias("cost"))


def _blocked(rows: DataFrame, sizes: DataFrame, own: list[str], more: DataFrame | None = None) -> DataFrame:
    """g, i, j, a, root, n: rows dealt to the pairs of blocks that _sizes has; more: columns to add by a."""
    parts = -(-(sizes.agg(F.sum("cost")).first()[0] or 0) // DEALT_ROWS)
    main = F.coalesce(F.col("root") == F.col("main"), F.lit(False))
    blk = F.when(main, F.pmod(F.xxhash64("a"), "km")).otherwise(F.col("km") + F.pmod(F.xxhash64("a"), "k")).cast("int")
    spread = rows.join(sizes, own)
    spread = (spread.join(more, "a") if more is not None else spread).withColumn("blk", blk)
    spread = spread.repartition(parts, "a", "g") if parts > 1 else spread
    every = spread.withColumn("other", F.explode(F.sequence(F.when(main, F.col("km")).otherwise(0), F.col("km") + F.col("k") - 1)))
    return every.select("g", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"), "a", "root", "n", *(x for x in (more.columns if more is not None else []) if x != "a"))


def resolve(met: DataFrame, classes: DataFrame, deal: Callable[[DataFrame], DataFrame], hundredths: int, whole_blocks: int = 0) -> DataFrame:
    """node, root of all links among the candidates of ``_meet``; classes: c, n (its shingles) and hist (null: none kept). Clusters of at most whole_blocks blocks are compared as a whole, which finds links that bands have missed."""
    pairs = cut(met.where("b IS NOT NULL").select("a", "b").distinct())
    groups = cut(met.where("g IS NOT NULL").select("g", "a").distinct())
    wanted = pairs.select(F.col("a").alias("c")).union(pairs.select("b")).union(groups.select("a")).distinct()
    classes = cut(classes.join(wanted, "c").groupBy("c").agg(F.first("n").alias("n"), F.first("hist").alias("hist")))
    left, right = classes.withColumnsRenamed({"c": "a", "n": "n", "hist": "x"}), classes.withColumnsRenamed({"c": "b", "n": "m", "hist": "y"})
    pairs = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y", "n", "m")
    bounded = pairs.where("x IS NOT NULL AND y IS NOT NULL").mapInArrow(_bounded(hundredths), "a long, b long")
    pairs = cut(bounded.unionByName(pairs.where("x IS NULL OR y IS NULL").select("a", "b")))

    # a star's members by blocks of about STAR_SHINGLES
    stars = pairs.join(right, "b").groupBy("a").agg(F.ceil(F.sum("m") / STAR_SHINGLES).cast("long").alias("k"))
    members = pairs.join(stars, "a").select(F.col("b").alias("c"), F.col("a").alias("p"), F.pmod(F.xxhash64("b", F.lit(6)), "k").alias("q"), F.lit(False).alias("first"))
    centres = members.select(F.col("p").alias("c"), "p", "q", F.lit(True).alias("first")).distinct()
    placed = deal(cut(members.unionByName(centres))).repartition("p", "q").sortWithinPartitions("p", "q", F.desc("first"))
    links = cut(placed.mapInArrow(_verify(hundredths), "a long, b long"))
    roots = cut(components(links))

    # groups that hold several components still: in blocks of rows, all pairs of blocks
    labelled = groups.join(roots.withColumnRenamed("node", "a"), "a", "left").select("g", "a", F.coalesce("root", "a").alias("root"))
    mixed = labelled.groupBy("g").agg(F.min("a").alias("b"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("g", "b")
    open_rows = cut(labelled.join(mixed, "g").select("g", "a", "b", "root"))
    if not open_rows.limit(1).count():
        return roots
    # groups that share rows make one cluster, in which each row is dealt once per block; where the groups one by one deal fewer rows, they stay apart
    clusters = components(open_rows.select("a", "b")).withColumnsRenamed({"node": "a", "root": "cluster"})
    narrow = cut(open_rows.select("g", "a", "root").join(clusters, "a").join(classes.select(F.col("c").alias("a"), "n"), "a"))
    own = ["cluster", "whole", "g"]
    rows = narrow.withColumn("whole", F.lit(False)).unionByName(narrow.withColumns({"whole": F.lit(True), "g": F.col("cluster")}).distinct())
    sizes = _sizes(rows, own)
    costs = sizes.groupBy("cluster").agg(*(F.sum(F.when(F.col("whole") == x, F.col("cost"))).alias(k) for k, x in (("one", True), ("each", False))), F.max(F.when(F.col("whole"), F.col("km") + F.col("k"))).alias("blocks"))
    sizes = sizes.join(costs, "cluster").where(F.col("whole") == ((F.col("one") <= F.col("each")) | (F.col("blocks") <= whole_blocks))).select(*own, "main", "km", "k", "cost")
    hists = classes.select(F.col("c").alias("a"), "hist")
    possible = cut(_blocked(rows, cut(sizes), own, hists).groupBy("g", "i", "j").applyInArrow(_partners(hundredths), "g long, i int, j int, a long, b long"))
    # what histograms join are the groups whose sets meet; a set goes once to each block that it is needed in
    families = components(possible.where("b IS NOT NULL").select("a", "b")).withColumnsRenamed({"node": "a", "root": "g"})
    rows = cut(narrow.select("a", "root", "n").distinct().join(families, "a"))
    dealt = _blocked(rows, cut(_sizes(rows, ["g"])), ["g"]).select("g", "i", "j", "a").unionByName(possible.where("b IS NULL").select("g", "i", "j", "a"))
    places = dealt.select(F.col("a").alias("c"), F.col("g").alias("p"), (F.col("i").cast("long") * (1 << 31) + F.col("j")).alias("q"), F.lit(False).alias("first"))
    more = deal(places).groupBy("p", "q").applyInArrow(_multiply(hundredths), "a long, b long")
    return cut(components(links.unionByName(more)))


def classified(docs: DataFrame, hundredths: int = 75, n: int = 5) -> DataFrame:
    """doc_id, h (the text's hash), n_shingles and root (equal in a component) of every row of docs."""
    spark = docs.sparkSession
    source = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    first = cut(source.mapInArrow(_first_pass, "doc_id long, h long, n int, c long, hist binary, slice int, counts binary"))
    rows = first.where("slice IS NULL").select("doc_id", "h", "n", "c")
    sliced = first.where("slice IS NOT NULL").select("slice", "counts").groupBy("slice").applyInArrow(_levels, "slice int, level binary, total long")
    level, total = np.zeros((1 << SKETCH_BITS) + (1 << WORD_BITS), np.uint8), 1
    for r in sliced.collect():  # 5 MB, whatever the input
        level[r["slice"] << SLICE_BITS : (r["slice"] + 1) << SLICE_BITS] = np.frombuffer(r["level"], np.uint8)
        total += r["total"] if r["slice"] >= 1 << (SKETCH_BITS - SLICE_BITS) else 0
    # a shingle is foreseen total * product(count of word / total) times
    shared = spark.sparkContext.broadcast((level, round(4 * (n - 1) * math.log2(total))))
    blocks = parts_for(source, 4 << 20)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (level, base), dealer, done = shared.value, Dealer(["token", "row", "size"]), set()
        for _, t in pieces(batches, "text"):
            tokens, rows, sizes = [], [], []
            for s, columns in columns_of(t, n, level, base):
                c = class_of(s)
                # sets that differ from one of so few by a shingle are not alike
                if 100 * len(s) < hundredths * (len(s) + 1) or c in done:
                    continue
                if len(done) < 200_000:
                    done.add(c)
                k = len(s) - _needed(len(s), hundredths) + 1
                tokens.append(columns[:k])
                rows.append(np.full(len(tokens[-1]), c, np.int64))
                sizes.append(np.full(len(tokens[-1]), len(s), np.int32))
            if tokens:
                token = np.concatenate(tokens)
                yield from dealer.add(((token & np.uint64(0xFFFFFFFF)) % np.uint64(blocks)).astype(np.int32), token, np.concatenate(rows), np.concatenate(sizes))
        yield from dealer.flush()

    dealt = source.mapInArrow(entries, "bucket int, token binary, row binary, size binary")
    met = cut(dealt.groupBy("bucket").applyInArrow(lambda table: _meet(table, hundredths), "a long, b long, g long, n int"))

    deal = dealing(source, rows.where("n > 0"), lambda t: [{class_of(s): s} for s in sets_of(t, n)])
    roots = resolve(met, first.where("slice IS NULL AND n > 0").select("c", "n", "hist"), deal, hundredths)
    placed = rows.join(roots.withColumnsRenamed({"node": "c", "root": "_root"}), "c", "left")
    return cut(placed.select("doc_id", "h", F.col("n").cast("long").alias("n_shingles"), F.coalesce("_root", "c").alias("root")))


def join(docs: DataFrame, *, hundredths: int = 75, n: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs."""
    placed = classified(docs, hundredths, n).select("doc_id", "n_shingles", "root")
    smallest = placed.where("n_shingles > 0").groupBy("root").agg(F.min("doc_id").alias("_least"))
    alone = placed.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return placed.where("n_shingles > 0").join(smallest, "root").select("doc_id", "n_shingles", F.col("_least").alias("component_id")).unionByName(alone)


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """docs with one document of each component, the one of smallest doc_id (null last), then of smallest text hash; of equal rows one stays. Documents without words stay."""
    keys = classified(docs, **options).where("n_shingles > 0")
    key = F.struct(F.isnull("doc_id").alias("u"), "doc_id", "h")
    first = keys.groupBy("root").agg(F.min(key).alias("o"), F.count("*").alias("k")).where("k > 1")
    shared = cut(keys.join(first, "root").select("doc_id", "h", (key == F.col("o")).alias("stays")).distinct())
    out = without(docs, shared.where("NOT stays"))
    # copies of one doc_id and text among the rows that stay
    repeated = keys.groupBy("doc_id", "h").count().where("count > 1").join(shared.where("stays"), ["doc_id", "h"], "left_semi")
    nulls = keys.where("doc_id IS NULL").groupBy("h").count().where("count > 1").join(shared.where("stays AND doc_id IS NULL"), "h", "left_semi").select(F.lit(None).cast("long").alias("doc_id"), "h")
    repeated = cut(repeated.select("doc_id", "h").unionByName(nulls))
    if not repeated.limit(1).count():
        return out
    return without(out, repeated).unionByName(without(out, repeated, keep=True).dropDuplicates(["doc_id", "text"]))
