"""Language model scoring by logistic mixing of hashed-context bit predictors.

The text, A-Z lower-cased, is a sequence of bytes with a closing zero; each byte is eight binary decisions. For orders 1 to 5 a table
keyed by the hash of the last bytes and the bits so far counts zeros and ones over all training documents; a predictor's vote is the
log odds of its counts. The votes are combined by weights that a gate selects (the bit's place, the longest context known and how often it was
seen), learned online by gradient steps in which each training event is first taken out of its own counts. A map of the mixed odds, by
gate, corrects the probability. Last, the state of the document itself refines it: where the last five bytes occurred in the document before, the byte
that followed them is expected again, to a share that follows how often such expectations have come true in the document so
far. The score sums log10 of the probabilities of all bytes.

Spark does the counting: tasks send distinct 6-byte strings with counts to buckets, buckets send their bit counts to table slices, and
only the tables (two slots or more for each distinct context as sampled, at most 2 ** MOST_BITS, where contexts begin to push out rarer ones),
weights and map reach the driver and, by broadcast, the tasks. Counts are kept whole up to 80 and on a logarithmic scale beyond, so large
ones keep their ratios to half a percent. The word statistics of the base score are exact: tasks send
their distinct words to buckets and get each word's count over the training documents back, for any number of words.

Defined cases: a null or empty text is its end alone; a null doc_id counts as held in; repeated rows count as often as they occur and are scored alike; without training
text every predictor is silent and each bit costs one bit; an empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.llm.common import cut, parts_for
from statuta.llm.packets import planes, runs, unplanes
from statuta.llm.words import _LOWER, Texts, mix64, pieces, words

#: Orders of the contexts, log2 of their tables' usual sizes (see table_sizes), of their least, of their largest and of a slice, and bytes of a context kept at most.
ORDERS, TABLE_BITS, LEAST_BITS, MOST_BITS, SLICE_BITS = (1, 2, 3, 4, 5), (16, 20, 21, 22, 22), 20, 26, 16
BACK = max(ORDERS)
#: Gates: a bit's place, the longest order known and the level of its count; levels of the map.
COUNT_LEVELS = (1.5, 3.5, 15.5)
GATES, LEVELS = 8 * (len(ORDERS) + 1) * (len(COUNT_LEVELS) + 1), 33
#: Steps of a count's logarithm.
SCALE = 180
#: Expectations from the document itself: their share of the probability at most, and by confidence what is expected of them at first, as so many observations.
OWN_SHARE, OWN_FIRST, OWN_WEIGHT = 0.3, np.array([0.25, 0.6, 0.75, 0.9]), 4.0
#: Strings whose probabilities a task keeps (16 bytes each).
REMEMBERED = 3 << 20
#: Slices of a table are numbered below SLICES.
SLICES = 1 << 32
#: One context in so many is counted to size the tables.
SAMPLE = 256
_SEED = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93], np.uint64)
END = np.array([0xE0D0C0B0A0908071], np.uint64)


def strings(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Each byte of the texts, and each end, with the BACK bytes before it: 48 bits; bounds per text."""
    n = len(t.ends) - 1
    out = np.zeros(len(t.buf) + (BACK + 1) * n, np.uint64)
    text = np.repeat(np.arange(n), np.diff(t.ends))
    out[np.arange(len(t.buf)) + (BACK + 1) * text + BACK] = _LOWER[t.buf]
    grams = out[BACK:].copy()
    for k in range(1, BACK + 1):
        grams |= out[BACK - k : len(out) - k] << np.uint64(8 * k)
    inner = np.ones(len(grams), bool)
    edges = t.ends[1:] + (BACK + 1) * np.arange(1, n + 1) - BACK  # the pads after each end
    for k in range(BACK):
        at = edges + k
        inner[at[at < len(grams)]] = False
    return grams[inner], t.ends + np.arange(n + 1)


def contexts(grams: np.ndarray) -> list[np.ndarray]:
    """A hash of each order's context; the context itself for order 1."""
    out = []
    for which, order in enumerate(ORDERS):
        context = (grams >> np.uint64(8)) & np.uint64((1 << (8 * order)) - 1)
        out.append(context if which == 0 else mix64(context * _SEED[which]))
    return out


def hashed(context: np.ndarray, node: np.ndarray) -> np.ndarray:
    """64-bit keys of contexts with the bits so far."""
    return (context + node.astype(np.uint64) * _SEED[-1]) * _SEED[0]


def slots(context: np.ndarray, which: int, node: np.ndarray, table_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in the table of ORDERS[which], of 2 ** table_bits slots, and a check of 8 bits that tells most contexts of a place apart."""
    if which == 0:
        return (context << np.uint64(8) | node.astype(np.uint64)).astype(np.int64), np.ones(len(context), np.uint32)
    h = hashed(context, node)
    return (h >> np.uint64(64 - table_bits)).astype(np.int64), (h >> np.uint64(56 - table_bits)).astype(np.uint32) & np.uint32(0xFF)


def bits(grams: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place, node: a one and the bits so far, bit) from the highest bit down."""
    byte = (grams & np.uint64(0xFF)).astype(np.int32)
    for place in range(8):
        yield place, (256 | byte) >> (8 - place), (byte >> (7 - place)) & 1


def coded(n: np.ndarray) -> np.ndarray:
    """Counts on the logarithmic scale, 12 bits."""
    return np.minimum(np.round(np.log1p(n) * SCALE), 4095).astype(np.uint32)


_COUNT = np.expm1(np.arange(4096) / SCALE)
_COUNT = np.where(_COUNT < 80, np.round(_COUNT), _COUNT).astype(np.float32)
_LOG = np.log(_COUNT + np.float32(0.02))


class Mixer:
    """Tables per order (each slot the check of its context, then the coded ones and zeros), weights per gate, and the map."""

    def __init__(self, tables: list[np.ndarray]):
        self.tables = tables
        self.table_bits = [len(t).bit_length() - 1 for t in tables]
        self.weights = np.tile(np.array([0.9 / len(ORDERS)] * len(ORDERS) + [0.0], np.float32), (GATES, 1))
        self.map: np.ndarray | None = None
        self.seen, self.seen_p = np.zeros(0, np.uint64), np.zeros(0)

    def __getstate__(self) -> dict:
        # most slots are empty or hold small counts: the broadcast is a fraction of the tables
        return self.__dict__ | {"tables": [zlib.compress(planes(t), 1) for t in self.tables]}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state | {"tables": [unplanes(zlib.decompress(t), np.uint32) for t in state["tables"]]}

    def votes(self, context: list[np.ndarray], node: np.ndarray, place: int, bit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Log odds by order and a constant, and the gate; with bit, the event itself is taken out of the counts."""
        x = np.empty((len(ORDERS) + 1, len(node)), np.float32)
        x[-1] = 0.3
        top, seen = np.zeros(len(node), np.int64), np.zeros(len(node), np.float32)
        for which in range(len(ORDERS)):
            at, check = slots(context[which], which, node, self.table_bits[which])
            slot = self.tables[which][at]
            slot[slot >> np.uint32(24) != check] = 0
            zero, one = slot & np.uint32(4095), slot >> np.uint32(12) & np.uint32(4095)
            if bit is None:
                x[which] = _LOG[one] - _LOG[zero]
                total = _COUNT[one] + _COUNT[zero]
            else:
                ones, zeros = np.maximum(_COUNT[one] - bit, 0), np.maximum(_COUNT[zero] - (1 - bit), 0)
                x[which] = np.log((ones + 0.02) / (zeros + 0.02))
                total = ones + zeros
            known = total > 0.5
            top[known], seen[known] = which + 1, total[known]
        level = np.searchsorted(COUNT_LEVELS, seen)
        return x, place + 8 * (top * (len(COUNT_LEVELS) + 1) + level)

    def mixed(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        return np.clip(sum(w[gate] * votes for w, votes in zip(np.ascontiguousarray(self.weights.T), x)), -11.5, 11.5)

    def refined(self, odds: np.ndarray, gate: np.ndarray) -> np.ndarray:
        """Probability of a one."""
        p = 1 / (1 + np.exp(-odds.astype(np.float64)))
        if self.map is None:
            return p
        at = (odds + 12) * ((LEVELS - 1) / 24)
        low = np.minimum(at.astype(np.int64), LEVELS - 2)
        part = at - low
        return 0.5 * p + 0.5 * (self.map[gate, low] * (1 - part) + self.map[gate, low + 1] * part)

    def learn(self, grams: np.ndarray, counts: np.ndarray, rate: float = 0.02, batch: int = 2048) -> np.ndarray:
        """Online steps over batches of strings in a mixed order, each weighted by its count; the weighted zeros and ones by gate and level of the odds before each step."""
        times = np.ceil(counts / (4 * counts.mean())).astype(np.int64)  # a frequent string is learned in several steps, a share of its weight in each
        every = np.repeat(np.arange(len(grams)), times)
        every = every[np.argsort(mix64(grams[every] + np.arange(len(every), dtype=np.uint64) * _SEED[0]), kind="stable")]
        share, mean = counts / times, counts.sum() / max(len(every), 1)
        seen = np.zeros((GATES, LEVELS, 2))
        for at in range(0, len(every), batch):
            part = every[at : at + batch]
            g, n = grams[part], share[part]
            w = (n / mean).astype(np.float32)
            context = contexts(g)
            for place, node, bit in bits(g):
                x, gate = self.votes(context, node, place, bit)
                odds = self.mixed(x, gate)
                level = np.round((odds + 12) * ((LEVELS - 1) / 24)).astype(np.int64)
                np.add.at(seen, (gate, level, bit), n)
                error = (bit - 1 / (1 + np.exp(-odds))) * w
                step = np.stack([np.bincount(gate, weights=error * votes, minlength=GATES) for votes in x], 1)
                total = np.bincount(gate, weights=w, minlength=GATES)
                self.weights += (rate * step / np.sqrt(np.maximum(total, 1))[:, None]).clip(-0.05, 0.05).astype(np.float32)
        return seen

    def probability(self, grams: np.ndarray) -> np.ndarray:
        """The probability of each string's last byte after the others."""
        total = np.ones(len(grams))
        for at in range(0, len(grams), 1 << 15):
            g = grams[at : at + (1 << 15)]
            context = contexts(g)
            for place, node, bit in bits(g):
                x, gate = self.votes(context, node, place)
                p = self.refined(self.mixed(x, gate), gate)
                total[at : at + (1 << 15)] *= np.maximum(np.where(bit == 1, p, 1 - p), 1e-6)
        return total

    def remembered(self, every: np.ndarray) -> np.ndarray:
        """The probabilities of distinct strings, each worked out once as long as no more than REMEMBERED are."""
        at = np.minimum(np.searchsorted(self.seen, every), max(len(self.seen) - 1, 0))
        there = self.seen[at] == every if len(self.seen) else np.zeros(len(every), bool)
        p = np.empty(len(every))
        p[there] = self.seen_p[at[there]]
        p[~there] = fresh = self.probability(every[~there])
        if len(fresh) and len(self.seen) + len(fresh) <= REMEMBERED:
            keys = np.concatenate([self.seen, every[~there]])
            order = np.argsort(keys, kind="stable")
            self.seen, self.seen_p = keys[order], np.concatenate([self.seen_p, fresh])[order]
        return p

    def log10(self, grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """log10 of the probabilities of whole texts' strings, refined by what each text has shown so far."""
        every, at = np.unique(grams, return_inverse=True)
        share, right = expected(grams, bounds)
        p = self.remembered(every)[at] * (1 - share) + share * right
        return np.add.reduceat(np.log10(p), bounds[:-1])


def expected(grams: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place of the texts: the share given to the byte that followed its context in the text before, and whether that byte came.

    The share depends on places before only: how many expectations in a row came true up to here, and how many of such confidence
    have come true in the text.
    """
    n = len(grams)
    text = np.repeat(np.arange(len(bounds) - 1, dtype=np.int32), np.diff(bounds))
    # sorted by text and context, then place: the place is the lower part of the key
    low = np.uint64(max(1, n.bit_length()))
    key = mix64((grams >> np.uint64(8)) * _SEED[0] + text.astype(np.uint64) * _SEED[1])
    key = np.sort((key & ~((np.uint64(1) << low) - np.uint64(1))) | np.arange(n, dtype=np.uint64))
    order = (key & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
    again = np.flatnonzero(key[1:] >> low == key[:-1] >> low)
    here, before = order[again + 1], order[again]
    late = here - bounds[:-1][text[here]] >= BACK
    here, before = here[late], before[late]
    byte = grams.astype(np.uint8)
    right = np.zeros(n, bool)
    right[here] = byte[before] == byte[here]
    place = np.arange(n, dtype=np.int32)
    since = place - np.maximum.accumulate(np.where(right, np.int32(-1), place))
    row = np.zeros(n, np.int32)
    row[1:] = since[:-1]  # expectations that came true just before; runs end at the text's first places, where there is none
    here = np.sort(here)
    group = np.minimum(row[here], 15) >> 2
    share = np.zeros(n)
    first = np.searchsorted(here, bounds)
    for g in range(len(OWN_FIRST)):
        own = group == g
        tried = np.concatenate([[0], np.cumsum(own)])
        came = np.concatenate([[0], np.cumsum(own & right[here])])
        at = np.flatnonzero(own)
        begin = first[text[here[at]]]
        share[here[at]] = OWN_SHARE * (came[at] - came[begin] + OWN_WEIGHT * OWN_FIRST[g]) / (tried[at] - tried[begin] + OWN_WEIGHT)
    return share, right


def _scan(buckets: int, chunk_bytes: int = 8 << 20):
    """Rows (kind, key, chunk, data): 0 words of a chunk for a bucket, 1 what a chunk needs to sum its documents, 2 strings for a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId() << 24, 0
        held: list[tuple] = []
        size = 0
        parts: list[tuple[np.ndarray, np.ndarray]] = []

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int8(), pa.int64(), pa.int64(), pa.binary()))], ["kind", "key", "chunk", "data"])

        def chunk() -> pa.RecordBatch:
            token = np.concatenate([h[0] for h in held])
            train = np.concatenate([h[1] for h in held])
            length = np.concatenate([h[2] for h in held])
            text = np.repeat(np.arange(len(length)), length)
            unique, at = np.unique(token, return_inverse=True)
            n = np.bincount(at, weights=train[text], minlength=len(unique)).astype(np.uint32)
            # words are listed by bucket, so that replies come in the same order
            bucket = (unique % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            starts, ends = runs(bucket[order])
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            rows = [(0, int(bucket[order[s]]), task + number, planes(unique[order[s:e]]) + planes(n[order[s:e]])) for s, e in zip(starts, ends)]
            ids = np.concatenate([h[3] for h in held])
            hashes = np.concatenate([h[4] for h in held])
            body = np.array([len(length)], np.int64).tobytes() + ids.tobytes() + hashes.tobytes() + length.tobytes() + planes(place[at].astype(np.uint32))
            rows.append((1, task + number, task + number, zlib.compress(body, 1)))
            return batch_of(rows)

        def gathered() -> None:
            """The parts' strings with their counts, as one part."""
            every, n = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(every)
            every, n = every[order], n[order]
            starts, _ = runs(every)
            parts[:] = [(every[starts], np.add.reduceat(n, starts))]

        fresh: list[np.ndarray] = []
        for batch, t in pieces(batches, "text"):
            ids = batch.column(0).to_pylist()
            train = np.array([not x for x in batch.column(2).to_pylist()])
            hashed, _, _, first = words(t)
            # each document's words, then its end
            k = len(ids)
            token = np.insert(hashed, first[1:], END[0])
            held.append((token, train.astype(np.int64), np.diff(first) + 1, np.array([0 if i is None else i for i in ids], np.int64), np.array(batch.column(3).to_pylist(), np.int64)))
            found, bounds = strings(t)
            if train.all():
                fresh.append(found)
            elif train.any():
                fresh.append(found[np.repeat(train, np.diff(bounds))])
            size += len(t.buf) + 8 * k
            if sum(map(len, fresh)) >= 2 << 20:
                parts.append(np.unique(np.concatenate(fresh), return_counts=True))
                fresh = []
                if len(parts) > 1 and sum(len(x) for x, _ in parts) > 8 << 20:
                    gathered()
            if size >= chunk_bytes:
                yield chunk()
                held, size, number = [], 0, number + 1
        if held:
            yield chunk()
        if fresh:
            parts.append(np.unique(np.concatenate(fresh), return_counts=True))
        if parts and sum(len(x) for x, _ in parts):
            gathered()
            grams, counts = parts[0]
            bucket = (mix64(grams >> np.uint64(8)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            starts, ends = runs(bucket[order])
            yield batch_of([(2, int(bucket[order[s]]), -1, packed(grams[order[s:e]], counts[order[s:e]])) for s, e in zip(starts, ends)])

    return run


def packed(grams: np.ndarray, counts: np.ndarray) -> bytes:
    """Strings in order and their counts, compressed."""
    order = np.argsort(grams, kind="stable")
    return zlib.compress(planes(grams[order]) + planes(counts[order].astype(np.uint64)), 1)


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    return _halves(zlib.decompress(data), np.uint64, np.uint64)


def _halves(data: bytes, first: type, second: type) -> tuple[np.ndarray, np.ndarray]:
    a, b = np.dtype(first).itemsize, np.dtype(second).itemsize
    n = len(data) // (a + b)
    return unplanes(data[: n * a], first), unplanes(data[n * a :], second)


def _reply(table: pa.Table) -> pa.Table:
    """Per chunk the training counts of its words in this bucket; with chunk -1 the bucket's tokens and distinct words."""
    key = table.column("key")[0].as_py()
    parts = [(c.as_py(), *_halves(d.as_py(), np.uint64, np.uint32)) for c, d in zip(table.column("chunk"), table.column("data"))]
    every, at = np.unique(np.concatenate([p[1] for p in parts]), return_inverse=True)
    total = np.bincount(at, weights=np.concatenate([p[2] for p in parts]).astype(np.float64), minlength=len(every)).astype(np.int64)
    out, start = [(key, -1, None, int(total.sum()), int((total > 0).sum()))], 0
    for chunk, h, _ in parts:
        out.append((key, chunk, planes(total[at[start : start + len(h)]].astype(np.uint64)), 0, 0))
        start += len(h)
    return pa.table({"key": pa.array([o[0] for o in out], pa.int64()), "chunk": pa.array([o[1] for o in out], pa.int64()), "data": pa.array([o[2] for o in out], pa.binary()), "n": pa.array([o[3] for o in out], pa.int64()), "v": pa.array([o[4] for o in out], pa.int64())})


def _sum_documents(n_all: int, n_distinct: int):
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("key").to_pylist(), table.column("data").to_pylist(), table.column("kind").to_pylist()), key=lambda r: (r[2], r[0]))
        counts = np.concatenate([unplanes(d, np.uint64) for _, d, kind in rows if kind == 0]).astype(np.float64)
        out: dict[str, list] = {k: [] for k in ("doc_id", "h", "n_tokens", "n_known", "base_score")}
        for _, d, kind in rows:
            if kind == 1:
                body = zlib.decompress(d)
                m = int(np.frombuffer(body[:8], np.int64)[0])
                ids, h, length = np.frombuffer(body[8 : 8 + 24 * m], np.int64).reshape(3, m)
                c = counts[unplanes(body[8 + 24 * m :], np.uint32)]
                at = np.concatenate([[0], np.cumsum(length)])[:-1]
                out["doc_id"].append(ids)
                out["h"].append(h)
                out["n_tokens"].append(length)
                out["n_known"].append(np.add.reduceat((c > 0).astype(np.int64), at))
                out["base_score"].append(np.add.reduceat(np.log10((c + 0.5) / (n_all + 0.5 * (n_distinct + 1))), at))
        return pa.table({k: np.concatenate(v) for k, v in out.items()})

    return run


def _join_strings(table: pa.Table) -> pa.Table:
    parts = [unpacked(d.as_py()) for d in table.column("data")]
    every, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    total = np.bincount(at, weights=np.concatenate([p[1] for p in parts]).astype(np.float64), minlength=len(every))
    return pa.table({"key": pa.array([table.column("key")[0].as_py()], pa.int64()), "data": pa.array([packed(every, total)], pa.binary())})


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct keys of a bucket, one in SAMPLE, by hashed order."""
    for batch in batches:
        for data in batch.column(batch.schema.get_field_index("data")):
            grams, _ = unpacked(data.as_py())
            context = contexts(grams)
            for which in range(1, len(ORDERS)):
                keys = [k[k >> np.uint64(56) == 0] for k in (mix64(hashed(context[which], node)) for _, node, _ in bits(grams))]  # one in SAMPLE
                every = np.unique(np.concatenate(keys)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(every), which, np.int32)), pa.array(every)], ["which", "k"])


def table_sizes(grams: DataFrame) -> list[int]:
    """log2 of the tables' sizes: at least two slots for each distinct context, as sampled, and at most MOST_BITS; up to TABLE_BITS, 32 to 64 slots."""
    seen = {r["which"]: r["n"] * SAMPLE for r in grams.mapInArrow(_sampled, "which int, k long").distinct().groupBy("which").agg(F.count("*").alias("n")).collect()}
    roomy = [TABLE_BITS[0]] + [min(most, max(LEAST_BITS, (32 * seen.get(which, 0)).bit_length())) for which, most in enumerate(TABLE_BITS) if which]
    return [min(MOST_BITS, max(size, (2 * seen.get(which, 0)).bit_length())) for which, size in enumerate(roomy)]


def _table_parts(sizes: list[int]):
    """Bit counts of a bucket's strings by table slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(batch.schema.get_field_index("data")):
                grams, counts = unpacked(data.as_py())
                slot: list[list] = [[] for _ in ORDERS]
                context = contexts(grams)
                for _, node, bit in bits(grams):
                    for which in range(len(ORDERS)):
                        at, check = slots(context[which], which, node, sizes[which])
                        slot[which].append((2 * at + bit) << 8 | check)
                rows = []
                for which in range(len(ORDERS)):
                    every, at = np.unique(np.concatenate(slot[which]), return_inverse=True)
                    n = np.bincount(at, weights=np.tile(counts.astype(np.float64), 8), minlength=len(every)).astype(np.float32)
                    part = every >> (SLICE_BITS + 8)
                    starts, ends = runs(part)
                    rows += [(int(which * SLICES + part[s]), planes((every[s:e] & ((1 << (SLICE_BITS + 8)) - 1)).astype(np.uint32)) + planes(n[s:e])) for s, e in zip(starts, ends)]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["key", "data"])

    return run


def _table_slice(table: pa.Table) -> pa.Table:
    """A slice's slots; each keeps the context that was seen most."""
    parts = [_halves(d.as_py(), np.uint32, np.float32) for d in table.column("data")]
    every, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    n = np.bincount(at, weights=np.concatenate([p[1] for p in parts]).astype(np.float64), minlength=len(every))
    slot, bit, check = every.astype(np.int64) >> 9, every >> 8 & 1, every & 0xFF
    context, at = np.unique(slot << 8 | check, return_inverse=True)
    seen = np.bincount(at, weights=n, minlength=len(context))
    order = np.lexsort((-seen, context >> 8))
    first = np.ones(len(order), bool)
    first[1:] = (context[order[1:]] >> 8) != (context[order[:-1]] >> 8)
    kept = np.zeros(len(context), bool)
    kept[order[first]] = True
    own = kept[at]
    total, checks = np.zeros((1 << SLICE_BITS - 1, 2)), np.zeros(1 << SLICE_BITS - 1, np.uint8)
    total[slot[own], bit[own]], checks[slot[own]] = n[own], check[own]
    return pa.table({"key": pa.array([table.column("key")[0].as_py()], pa.int64()), "data": pa.array([(checks.astype(np.uint32) << np.uint32(24) | coded(total[:, 1]) << np.uint32(12) | coded(total[:, 0])).tobytes()], pa.binary())})


def train(grams: DataFrame) -> tuple[Mixer, Broadcast]:
    """The model from (key, data) buckets of distinct strings, and the broadcast of its tables."""
    spark = grams.sparkSession
    sizes = table_sizes(grams)
    tables = [np.zeros(1 << b, np.uint32) for b in sizes]
    for row in grams.mapInArrow(_table_parts(sizes), "key long, data binary").groupBy("key").applyInArrow(_table_slice, "key long, data binary").toLocalIterator():
        which, part = divmod(row["key"], SLICES)
        tables[which][part << SLICE_BITS - 1 : (part + 1) << SLICE_BITS - 1] = np.frombuffer(row["data"], np.uint32)
    model = Mixer(tables)
    shared = spark.sparkContext.broadcast(model)

    names = ["i", "v", "n"]

    def mixers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What a task learns from its strings: weights, each with the task's events, and the map's counts behind them."""
        own, n, seen = Mixer(shared.value.tables), 0.0, np.zeros((GATES, LEVELS, 2))
        for batch in batches:
            for data in batch.column(batch.schema.get_field_index("data")):
                g, k = unpacked(data.as_py())
                seen += own.learn(g, k)
                n += float(k.sum())
        if n:
            w, at = own.weights.ravel().astype(np.float64), np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.arange(len(w)), len(w) + at])), pa.array(np.concatenate([w * n, seen.ravel()[at]])), pa.array(np.concatenate([np.full(len(w), n), np.ones(len(at))]))], names)

    size = model.weights.size
    seen = np.zeros(GATES * LEVELS * 2)
    for row in grams.mapInArrow(mixers, "i long, v double, n double").groupBy("i").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).collect():  # as many numbers as weights and map have
        if row["i"] < size:
            model.weights.ravel()[row["i"]] = row["v"] / row["n"]
        else:
            seen[row["i"] - size] = row["v"]
    seen = seen.reshape(GATES, LEVELS, 2)
    centre = 1 / (1 + np.exp(-(np.arange(LEVELS) * 24 / (LEVELS - 1) - 12)))
    model.map = (seen[:, :, 1] + 20 * centre) / (seen.sum(2) + 20)
    return model, shared


def score(docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes and bits_per_byte of every row; learns where held_out is false."""
    source = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"), F.xxhash64("text", F.isnull("doc_id")).alias("h"))
    buckets = parts_for(source.select("text"), 4 << 20)
    scanned = cut(source.mapInArrow(_scan(buckets), "kind tinyint, key long, chunk long, data binary"))
    replies = cut(scanned.where("kind = 0").groupBy("key").applyInArrow(_reply, "key long, chunk long, data binary, n long, v long"))
    totals = replies.agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    n_all, n_distinct = totals["n"] or 0, totals["v"] or 0
    both = replies.where("chunk >= 0").select(F.lit(0).cast("tinyint").alias("kind"), "key", "chunk", "data").unionByName(scanned.where("kind = 1"))
    base = both.groupBy("chunk").applyInArrow(_sum_documents(n_all, n_distinct), "doc_id long, h long, n_tokens long, n_known long, base_score double")
    base = base.groupBy("doc_id", "h").agg(*[F.first(c).alias(c) for c in ("n_tokens", "n_known", "base_score")]).withColumnsRenamed({"doc_id": "_d", "h": "_h"})
    grams = cut(scanned.where("kind = 2").groupBy("key").applyInArrow(_join_strings, "key long, data binary"))
    trained, shared = train(grams)
    weights, refine = trained.weights, trained.map

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Mixer(shared.value.tables)
        model.weights, model.map = weights, refine
        for batch, t in pieces(batches, "text"):
            found, bounds = strings(t)
            s = model.log10(found, bounds)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(s), pa.array(np.diff(t.ends))], ["doc_id", "held_out", "h", "score", "n_bytes"])

    scores = source.mapInArrow(run, "doc_id long, held_out boolean, h long, score double, n_bytes long")
    joined = scores.join(base, (F.coalesce("doc_id", F.lit(0)) == F.col("_d")) & (F.col("h") == F.col("_h")))
    per_byte = -F.col("score") * float(np.log2(10)) / F.greatest(F.col("n_bytes"), F.lit(1))
    return joined.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), "base_score", "score", "n_bytes", per_byte.alias("bits_per_byte"))
