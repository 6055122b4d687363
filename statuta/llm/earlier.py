"""Suffix-array dedup by longest-previous-factor arrays.

A byte goes if a string of ``width`` bytes that covers it also starts in a document of smaller doc_id. Every string of ``width``
bytes holds the k-gram of least hash among its k-grams (its anchor, the last one on ties), and equal strings hold equal
anchors at equal places. So the suffixes that can matter are found first, and sorted in groups that hold all their equals:

1. each anchor sends its k-gram hash, fingerprints of the whole stretch that strings of this anchor can reach and of its halves, and its document to a
   bucket. A stretch that occurs in an earlier document (158 bits agree) is the inside of a copy and goes in full; an anchor whose halves occur in
   no other document stays. What is left open are the ends of matches. Anchors that a sample shows in very many documents are open at once: their bucket would hold
   a record for each of the texts around them;
2. open anchors' stretches are read again, as ``CLASSES`` windows of a few bytes more than ``width``: a window's strings share a core of all but
   ``STEP`` - 1 of their bytes, and windows meet by the hash of that core. A bucket's distinct windows give their suffixes; these are sorted as bytes, and the
   previous and next smaller doc_ids in suffix order give each suffix its longest earlier match: those of at least ``width`` bytes are removed;
3. the strings to remove return to their documents, where covered bytes merge to spans.

Before each shuffle a task keeps only the smallest document of equal stretches or windows, so a passage that a third of
all documents share arrives once per task. All that ends a match is decided by the suffixes' bytes.

Defined cases: null and empty texts have no byte; texts shorter than ``width`` lose nothing; rows of equal doc_id are one document (no removal between them), each treated
alone otherwise (they are told apart by their texts' hashes); a null doc_id comes after all others; an empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuta.llm.common import BROADCAST_ROWS, cut, parts_for
from statuta.llm.packets import planes, runs, unplanes
from statuta.llm.words import Texts, mix64, pieces

_rng = np.random.Generator(np.random.PCG64(90125))
_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 2**64)
#: Anchors of k bytes; a side of a match holds at least half of what a string has besides its anchor.
K = 20
#: Columns of the records of anchors, and of the ranges of string starts that go back to documents.
ANCHOR = {"h": np.uint64, "left": np.uint32, "right": np.uint32, "whole": np.uint32, "doc": np.int64, "alt": np.int64, "lo": np.uint32, "n": np.uint16}
RANGE = {"doc": np.int64, "alt": np.int64, "lo": np.uint32, "n": np.uint32, "kind": np.uint8}
#: Strings of a window at most, and windows of an anchor's strings; a sample's share of texts, and what makes a k-gram frequent in it.
STEP, CLASSES = 8, 4
SAMPLE, FREQUENT, FREQUENT_SHARE = 64, 64, 1 << 20
#: Bytes of text that a task works on at once.
AT_ONCE = 1 << 19
GONE, ASKED = 0, 1
NO_ID = np.iinfo(np.int64).max


class Hashes:
    """Hash of any stretch of a buffer, from sums over prefixes."""

    def __init__(self, buf: np.ndarray):
        n = len(buf)
        power = np.full(n + 1, _BASE, np.uint64)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        self.inverse = np.full(n + 1, _INVERSE, np.uint64)
        self.inverse[0] = 1
        np.multiply.accumulate(self.inverse, out=self.inverse)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUE[buf] * power[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))

    def every(self, k: int) -> np.ndarray:
        n = max(0, len(self.sums) - k)
        return mix64((self.sums[k:] - self.sums[:n]) * self.inverse[:n] + np.uint64(k))


def anchors(t: Texts, width: int) -> dict[str, np.ndarray] | None:
    """Anchors of the texts: text, lo (first string start, in the text), n (string starts), and hashes."""
    span = width - K + 1
    if len(t.buf) < width:
        return None
    hashes = Hashes(t.buf)
    grams = hashes.every(K)
    # the upper half of the hash, then the later place first: equal strings choose alike
    low = (grams & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - np.arange(len(grams), dtype=np.uint64))
    reach = 1
    while 2 * reach <= span:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if reach < span:
        low = np.minimum(low[: len(low) - (span - reach)], low[span - reach :])
    place = (np.uint64(0xFFFFFFFF) - (low & np.uint64(0xFFFFFFFF))).astype(np.int64)
    valid = np.ones(len(place), bool)
    for end in t.ends[1:]:
        valid[max(0, end - width + 1) : end] = False
    start = np.flatnonzero(valid)
    if not len(start):
        return None
    at = place[start]
    new = np.ones(len(start), bool)
    new[1:] = (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    lo, hi, at = start[first], start[last], at[first]
    text = np.searchsorted(t.ends, lo, "right") - 1
    side = (width - K) // 2
    rest = width - K - side
    begin, end = t.ends[text], t.ends[text + 1]
    left = hashes.of(np.maximum(at - side, begin), at + K).astype(np.uint32) | np.uint32(1)
    left[at - side < begin] = 0
    right = hashes.of(at, np.minimum(at + K + rest, end)).astype(np.uint32) | np.uint32(1)
    right[at + K + rest > end] = 0
    whole = (mix64(hashes.of(lo, hi + width) + (at - lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
    return {"text": text, "lo": (lo - begin).astype(np.uint32), "n": (hi - lo + 1).astype(np.uint16), "h": grams[at], "left": left, "right": right, "whole": whole, "at": at - begin}


def _rows(bucket: np.ndarray, columns: dict[str, np.ndarray], layout: dict[str, type | str]) -> list[tuple[int, bytes]]:
    """(bucket, the columns' planes one after another)."""
    order = np.argsort(bucket, kind="stable")
    starts, ends = runs(bucket[order])
    columns = {k: columns[k][order] for k in layout}
    return [(int(bucket[order[s]]), b"".join(c[s:e].tobytes() if c.dtype.kind == "V" else planes(c[s:e]) for c in columns.values())) for s, e in zip(starts, ends)]


def _columns(values: list[bytes], layout: dict[str, type]) -> dict[str, np.ndarray]:
    width = sum(np.dtype(d).itemsize for d in layout.values())
    parts: dict[str, list] = {k: [] for k in layout}
    for v in values:
        n, at = len(v) // width, 0
        for k, d in layout.items():
            size = n * np.dtype(d).itemsize
            parts[k].append(np.frombuffer(v[at : at + size], d) if np.dtype(d).kind == "V" else unplanes(v[at : at + size], d))
            at += size
    return {k: np.concatenate(p) if p else np.zeros(0, layout[k]) for k, p in parts.items()}


def _take(columns: dict[str, np.ndarray], at: np.ndarray) -> dict[str, np.ndarray]:
    return {k: v[at] for k, v in columns.items()}


def _least(keys: tuple[np.ndarray, ...], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each element the smallest doc of those with its keys, and the first element that has it."""
    order = np.lexsort((doc, *keys[::-1]))
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([k[order[1:]] != k[order[:-1]] for k in keys], axis=0)
    first = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    out = np.empty(len(order), np.int64)
    out[order] = first
    return doc[out], out


def _bucket(doc: np.ndarray, n: int) -> np.ndarray:
    return (mix64(doc.view(np.uint64)) % np.uint64(n)).astype(np.int64)


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int8()), pa.array([r[2] for r in rows], pa.binary())], ["bucket", "kind", "data"])


def _back(x: dict[str, np.ndarray], kind: int, buckets: int) -> list[tuple[int, int, bytes]]:
    """Rows of ranges of string starts on their way to their documents."""
    columns = {"doc": x["doc"], "alt": x["alt"], "lo": x["lo"], "n": x["n"].astype(np.uint32), "kind": np.full(len(x["doc"]), kind, np.uint8)}
    return [(b, 1, data) for b, data in _rows(_bucket(x["doc"], buckets), columns, RANGE)]


def _local(held: dict[str, np.ndarray], buckets: int, frequent: np.ndarray) -> pa.RecordBatch:
    """Anchors of frequent k-grams are open; of other equal stretches the smallest document's go to the k-gram's bucket, those of larger documents are gone."""
    often = np.isin(held["h"], frequent)
    rows = _back(_take(held, np.flatnonzero(often)), ASKED, buckets) if often.any() else []
    held = _take(held, np.flatnonzero(~often))
    least, _ = _least(tuple(held[k] for k in ("h", "left", "right", "whole")), held["doc"])
    gone = held["doc"] > least
    own = np.flatnonzero(~gone)  # of one document, all starts of equal strings share an answer; each is sent
    rows += [(b, 0, data) for b, data in _rows((held["h"][own] % np.uint64(buckets)).astype(np.int64), _take(held, own), ANCHOR)]
    if gone.any():
        rows += _back(_take(held, np.flatnonzero(gone)), GONE, buckets)
    return _batch(rows)


def _passed(table: pa.Table) -> list[tuple[int, int, bytes]]:
    return [(b, 1, d) for b, k, d in zip(*(table.column(c).to_pylist() for c in ("bucket", "kind", "data"))) if k]


def _match(buckets: int):
    """A bucket of anchors: what is gone, and the stretches to ask for."""

    def run(table: pa.Table) -> pa.Table:
        out = _passed(table)
        a = _columns([d for k, d in zip(table.column("kind").to_pylist(), table.column("data").to_pylist()) if not k], ANCHOR)
        order = np.argsort(a["h"], kind="stable")
        s = a["h"][order]
        twice = np.zeros(len(s), bool)
        twice[1:] = s[1:] == s[:-1]
        twice[:-1] |= s[1:] == s[:-1]
        a = _take(a, order[twice])
        least, first = _least((a["h"], a["left"], a["right"], a["whole"]), a["doc"])
        gone = a["doc"] > least
        # ends of matches: another document with the same left or right half; one record per distinct stretch is enough
        rep = np.unique(first)
        r = _take(a, rep)
        ask = np.zeros(len(rep), bool)
        for side in ("left", "right"):
            low, _ = _least((r["h"], r[side]), r["doc"])
            high, _ = _least((r["h"], r[side]), ~r["doc"])
            ask |= (r[side] > 0) & (low < ~high)
        # every start of an asked stretch within the same document has the same answer
        asked = np.zeros(len(a["h"]), bool)
        asked[rep[ask]] = True
        asked = asked[first] & ~gone
        for mask, kind in ((gone, GONE), (asked, ASKED)):
            if mask.any():
                out += _back(_take(a, np.flatnonzero(mask)), kind, buckets)
        return pa.Table.from_batches([_batch(out)])

    return run


def _merge_ranges(width: int):
    """A bucket of documents: per document the bytes gone, as merged spans, and the string starts asked for."""

    def run(table: pa.Table) -> pa.Table:
        x = _columns(table.column("data").to_pylist(), RANGE)
        ids, alts, kinds, data = [], [], [], []
        order = np.lexsort((x["lo"], x["kind"], x["alt"], x["doc"]))
        x = _take(x, order)
        new = np.ones(len(order), bool)
        if len(order):
            new[1:] = (x["doc"][1:] != x["doc"][:-1]) | (x["alt"][1:] != x["alt"][:-1]) | (x["kind"][1:] != x["kind"][:-1])
        starts = np.flatnonzero(new)
        for s, e in zip(starts, np.append(starts[1:], len(order))):
            lo = x["lo"][s:e].astype(np.int64)
            reach = lo + x["n"][s:e] + (width - 1 if x["kind"][s] == GONE else 0)
            far = np.maximum.accumulate(reach)
            cutat = np.ones(e - s, bool)
            cutat[1:] = lo[1:] > far[:-1]
            at = np.flatnonzero(cutat)
            spans = np.stack([lo[at], far[np.append(at[1:], e - s) - 1]], 1).astype(np.int64)
            ids.append(int(x["doc"][s]))
            alts.append(int(x["alt"][s]))
            kinds.append(int(x["kind"][s]))
            data.append(spans.tobytes())
        return pa.table({"doc_id": pa.array([None if i == NO_ID else i for i in ids], pa.int64()), "alt": pa.array(alts, pa.int64()), "kind": pa.array(kinds, pa.int32()), "spans": pa.array(data, pa.binary())})

    return run


def longest_previous(strings: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For suffixes (equal-length byte strings) the longest prefix shared with a suffix of a smaller doc.

    In suffix order, the previous and the next smaller doc are the nearest such suffixes on either side, so no other shares more:
    the least common prefix on the way to them is the answer.
    """
    n, width = len(strings), strings.dtype.itemsize
    order = np.argsort(strings, kind="stable")
    letters = strings[order].view(np.uint8).reshape(n, width)
    differ = letters[1:] != letters[:-1]
    shared = np.where(differ.any(1), differ.argmax(1), width)
    d = doc[order]
    best = np.zeros(n, np.int64)
    for ahead in (1, -1):
        stack: list[tuple[int, int]] = []  # docs, increasing, with the least common prefix to the one below
        sweep = range(n) if ahead == 1 else range(n - 1, -1, -1)
        values, common = d.tolist(), shared.tolist()
        found = [0] * n
        for i in sweep:
            reach = (common[i - 1] if ahead == 1 else common[i]) if (i if ahead == 1 else i < n - 1) else 0
            while stack and values[stack[-1][0]] >= values[i]:
                reach = min(reach, stack.pop()[1])
            if stack:
                found[i] = reach
            stack.append((i, reach))
        best = np.maximum(best, found)
    out = np.empty(n, np.int64)
    out[order] = best
    return out


def _layout(width: int) -> dict[str, type | str]:
    """A window: its core's hash; class, first string and number of strings with its bytes; document, text and place of its first string."""
    return {"h": np.uint64, "view": f"V{3 + width + STEP - 1}", "doc": np.int64, "alt": np.int64, "lo": np.uint32, "n": np.uint16}


def windows(t: Texts, width: int, open_: list[np.ndarray]) -> dict[str, np.ndarray] | None:
    """The windows of the anchors whose string starts lie in open_ (per text: pairs of first and end)."""
    found = anchors(t, width)
    if found is None:
        return None
    text, lo = found["text"], found["lo"].astype(np.int64)
    chosen = np.zeros(len(text), bool)
    bounds = np.searchsorted(text, np.arange(len(open_) + 1))
    for i, pairs in enumerate(open_):
        if len(pairs):
            own = lo[bounds[i] : bounds[i + 1]]
            k = np.searchsorted(pairs[:, 0], own, "right") - 1
            chosen[bounds[i] : bounds[i + 1]] = (k >= 0) & (own < pairs[np.maximum(k, 0), 1])
    text, lo = text[chosen], lo[chosen]
    last, at = lo + found["n"][chosen].astype(np.int64) - 1, found["at"][chosen].astype(np.int64)
    hashes, size = Hashes(t.buf), width + STEP - 1
    parts: list[dict[str, np.ndarray]] = []
    for j in range(CLASSES):
        begin = at - STEP * j - STEP + 1  # where the class's first string would start
        s, e = np.maximum(lo, begin), np.minimum(last, at - STEP * j)
        some = np.flatnonzero(s <= e)
        if not len(some):
            continue
        s, e, begin, own = s[some], e[some], begin[some], text[some]
        base = t.ends[own]
        place = base[:, None] + begin[:, None] + np.arange(size)
        inside = (np.arange(size) >= (s - begin)[:, None]) & (np.arange(size) < (e - begin)[:, None] + width)
        view = np.empty((len(some), 3 + size), np.uint8)
        view[:, 0], view[:, 1], view[:, 2] = j, s - begin, e - s + 1
        view[:, 3:] = np.where(inside, t.buf[np.clip(place, 0, len(t.buf) - 1)], 0)
        core = base + begin + STEP - 1
        h = mix64(hashes.of(core, core + width - STEP + 1) + np.uint64(j))
        parts.append({"h": h, "view": view.view(f"V{3 + size}").reshape(-1), "text": own, "lo": s.astype(np.uint32), "n": (e - s + 1).astype(np.uint16)})
    return {k: np.concatenate([x[k] for x in parts]) for k in parts[0]} if parts else None


def _first_of(view: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct windows, which of them each one is, and the smallest document of each distinct one.

    Windows are ordered by a hash and compared by their bytes; should two share a hash, one of them may come up twice, which costs time alone.
    """
    n, size = len(view), view.dtype.itemsize
    letters = np.zeros((n, -(-size // 8) * 8), np.uint8)
    letters[:, :size] = view.view(np.uint8).reshape(n, size)
    words = letters.view(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(words.shape[1]):
        key = mix64(key * np.uint64(_BASE) + words[:, k])
    order = np.argsort(key, kind="stable")
    new = np.ones(n, bool)
    new[1:] = (words[order[1:]] != words[order[:-1]]).any(1)
    which = np.empty(n, np.int64)
    which[order] = np.cumsum(new) - 1
    distinct = view[order[new]]
    least = np.full(len(distinct), NO_ID, np.int64)
    np.minimum.at(least, which, doc)
    return distinct, which, least


def _windows(width: int, buckets: int):
    """Windows of open anchors by their cores' buckets; those that another document of the task has earlier are gone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout = _layout(width)
        held: list[dict[str, np.ndarray]] = []
        n = 0

        def flush() -> pa.RecordBatch:
            x = {k: np.concatenate([h[k] for h in held]) for k in layout}
            _, which, least = _first_of(x["view"], x["doc"])
            gone = x["doc"] > least[which]
            own = np.flatnonzero(~gone)
            rows = [(b, 0, d) for b, d in _rows((x["h"][own] % np.uint64(buckets)).astype(np.int64), _take(x, own), layout)]
            return _batch(rows + (_back(_take(x, np.flatnonzero(gone)), GONE, buckets) if gone.any() else []))

        for batch, t in pieces(batches, "text", AT_ONCE):
            ids, alts, open_ = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "alt", "spans"))
            found = windows(t, width, [np.frombuffer(x, np.int64).reshape(-1, 2) for x in open_])
            if found is None:
                continue
            text = found.pop("text")
            found |= {"doc": np.array([NO_ID if i is None else i for i in ids], np.int64)[text], "alt": np.array(alts, np.int64)[text]}
            held.append(found)
            n += len(text)
            if n >= 200_000:
                yield flush()
                held, n = [], 0
        if held:
            yield flush()

    return run


def _match_windows(width: int, buckets: int):
    """A bucket of windows: suffixes of the distinct ones in order, and what has a longest earlier match of the width."""

    def run(table: pa.Table) -> pa.Table:
        out = _passed(table)
        a = _columns([d for k, d in zip(table.column("kind").to_pylist(), table.column("data").to_pylist()) if not k], _layout(width))
        if not len(a["h"]):
            return pa.Table.from_batches([_batch(out)])
        distinct, which, least = _first_of(a["view"], a["doc"])
        gone = a["doc"] > least[which]
        if gone.any():
            out += _back(_take(a, np.flatnonzero(gone)), GONE, buckets)
        # suffixes of windows whose core others have, too
        core = np.zeros(len(distinct), np.uint64)
        core[which] = a["h"]
        _, inverse, times = np.unique(core, return_inverse=True, return_counts=True)
        shared = np.flatnonzero(times[inverse] > 1)
        if len(shared):
            letters = distinct[shared].view(np.uint8).reshape(len(shared), -1)
            count = letters[:, 2].astype(np.int64)
            owner = np.repeat(np.arange(len(shared)), count)
            step = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            start = letters[owner, 1] + step
            suffixes = letters[owner[:, None], 3 + start[:, None] + np.arange(width)]
            found = longest_previous(np.ascontiguousarray(suffixes).view(f"V{width}").reshape(-1), least[shared][owner]) >= width
            # each window of the document that has it first loses the strings found
            hit = np.zeros((len(distinct), STEP), bool)
            hit[shared[owner[found]], step[found]] = True
            row, k = np.nonzero(hit[which] & ~gone[:, None])
            if len(row):
                x = _take(a, row)
                x["lo"], x["n"] = (x["lo"] + k).astype(np.uint32), np.ones(len(row), np.uint16)
                out += _back(x, GONE, buckets)
        return pa.Table.from_batches([_batch(out)])

    return run


def _frequent(source: DataFrame, width: int) -> np.ndarray:
    """Hashes of the k-grams that are anchors in very many texts, as a sample shows them: at most FREQUENT_SHARE of them. It decides only which way an anchor goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in pieces(batches, "text", AT_ONCE):
            found = anchors(t, width)
            if found is not None:
                every = np.unique(np.stack([found["h"], found["text"].astype(np.uint64)], 1), axis=0)[:, 0].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(every))], ["h"])

    counted = cut(source.where(F.pmod(F.xxhash64("text", F.lit(9)), F.lit(SAMPLE)) == 0).mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")))
    total = counted.agg(F.sum("n")).first()[0] or 0
    often = counted.where(F.col("n") >= max(FREQUENT, total / FREQUENT_SHARE)).select("h").collect()  # at most FREQUENT_SHARE numbers
    return np.sort(np.array([r["h"] for r in often], np.int64).view(np.uint64))


def spans(docs: DataFrame, width: int = 50) -> tuple[DataFrame, DataFrame]:
    """docs with alt (the text's hash where texts share a doc_id), and (doc_id, alt, spans): int64 pairs of merged byte ranges to remove."""
    source = docs.select("doc_id", "text")
    buckets = parts_for(source, 4 << 20)
    repeated = source.where("doc_id IS NULL").select("doc_id").limit(1).unionByName(source.groupBy("doc_id").count().where("count > 1").select("doc_id").limit(1))
    source = source.withColumn("alt", F.xxhash64("text") if repeated.limit(1).count() else F.lit(0).cast("long"))
    frequent = docs.sparkSession.sparkContext.broadcast(_frequent(source, width))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        n = 0
        for batch, t in pieces(batches, "text", AT_ONCE):
            found = anchors(t, width)
            if found is None:
                continue
            text = found.pop("text")
            ids = np.array([NO_ID if i is None else i for i in batch.column(0).to_pylist()], np.int64)
            found |= {"doc": ids[text], "alt": np.array(batch.column(2).to_pylist(), np.int64)[text]}
            held.append(found)
            n += len(text)
            if n >= 250_000:
                yield _local({k: np.concatenate([x[k] for x in held]) for k in ANCHOR}, buckets, frequent.value)
                held, n = [], 0
        if held:
            yield _local({k: np.concatenate([x[k] for x in held]) for k in ANCHOR}, buckets, frequent.value)

    row = "bucket int, kind tinyint, data binary"
    result = "doc_id long, alt long, kind int, spans binary"
    matched = source.mapInArrow(deal, row).groupBy("bucket").applyInArrow(_match(buckets), row)
    first = cut(matched.groupBy("bucket").applyInArrow(_merge_ranges(width), result))
    asked = first.where(F.col("kind") == ASKED).select(F.col("doc_id").alias("_d"), F.col("alt").alias("_a"), "spans")
    small = (asked.agg(F.sum(F.length("spans") + 40)).first()[0] or 0) <= 64 << 20
    on = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("alt") == F.col("_a"))
    second = source.join(F.broadcast(asked) if small else asked, on).select("doc_id", "alt", "text", "spans")
    ends = second.mapInArrow(_windows(width, buckets), row).groupBy("bucket").applyInArrow(_match_windows(width, buckets), row).groupBy("bucket").applyInArrow(_merge_ranges(width), result)
    every = first.where(F.col("kind") == GONE).unionByName(ends)
    merged = F.flatten(F.collect_list(F.array("spans")))
    return source, cut(every.groupBy("doc_id", "alt").agg(merged.alias("spans")))


def _union(parts: list[bytes] | None) -> np.ndarray:
    if not parts:
        return np.zeros((0, 2), np.int64)
    s = np.concatenate([np.frombuffer(p, np.int64).reshape(-1, 2) for p in parts])
    s = s[np.argsort(s[:, 0], kind="stable")]
    far = np.maximum.accumulate(s[:, 1])
    new = np.ones(len(s), bool)
    new[1:] = s[1:, 0] > far[:-1]
    at = np.flatnonzero(new)
    return np.stack([s[at, 0], far[np.append(at[1:], len(s)) - 1]], 1)


def remove(docs: DataFrame, width: int = 50) -> DataFrame:
    """Per row of docs: doc_id, kept (the bytes left), n_bytes, n_removed, n_spans and removed (array of start and end bytes)."""
    source, found = spans(docs, width)
    found = found.withColumnsRenamed({"doc_id": "_d", "alt": "_a"})
    small = (found.agg(F.sum(F.aggregate("spans", F.lit(40), lambda n, x: n + F.length(x)))).first()[0] or 0) <= 64 << 20
    joined = source.join(F.broadcast(found) if small else found, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("alt") == F.col("_a")), "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, t in pieces(batches, "text", AT_ONCE):
            out: dict[str, list] = {k: [] for k in ("kept", "n_bytes", "n_removed", "n_spans", "removed")}
            for i, parts in enumerate(batch.column(2).to_pylist()):
                own, gone = t.buf[t.ends[i] : t.ends[i + 1]], _union(parts)
                keep = np.ones(len(own), bool)
                for s, e in gone:
                    keep[s:e] = False
                out["kept"].append(own[keep].tobytes())
                out["n_bytes"].append(len(own))
                out["n_removed"].append(int(len(own) - keep.sum()))
                out["n_spans"].append(len(gone))
                out["removed"].append(gone.reshape(-1).tolist())
            types = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, t) for v, t in zip(out.values(), types))], ["doc_id", *out])

    return joined.mapInArrow(run, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long, removed array<long>")
