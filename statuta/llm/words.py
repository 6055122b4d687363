"""Words and shingles of many texts at once, on numpy arrays.

A word is a run of bytes outside [space, \\t-\\r] of the UTF-8 text with A-Z lower-cased; shingles are runs of n words.
Both are 64-bit hashes: random multipliers per byte value and place, then a finalizer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_WORD = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_OF = _BYTE[_LOWER]
_GAP = np.zeros(256, bool)
_GAP[[32, *range(9, 14)]] = True
#: Bytes of text worked on at once; bounds the arrays made from it. A longer text is one piece of its own.
PIECE = 1 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


@dataclass
class Texts:
    """Bytes of consecutive texts; text i is buf[ends[i]:ends[i + 1]]."""

    buf: np.ndarray
    ends: np.ndarray


def texts_of(column: pa.Array) -> Texts:
    """Without a copy; a null is an empty text."""
    if pa.types.is_large_string(column.type):
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    else:
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    if column.null_count:
        import pyarrow.compute as pc

        return texts_of(pc.fill_null(column, "").combine_chunks() if isinstance(column, pa.ChunkedArray) else pc.fill_null(column, ""))
    if data is None or not len(column):
        return Texts(np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64))
    return Texts(np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0])


def pieces(batches: Iterator[pa.RecordBatch], text: str, size: int = PIECE) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Slices of the batches with about size bytes of text each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        whole = texts_of(batch.column(batch.schema.get_field_index(text)))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(whole.ends, whole.ends[start] + size, "right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start), Texts(whole.buf[whole.ends[start] : whole.ends[stop]], whole.ends[start : stop + 1] - whole.ends[start])
            start = stop


def words(t: Texts, gap: np.ndarray = _GAP) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end byte of each word; first: words of text i are first[i]:first[i + 1]. gap: for each byte value, whether it parts words."""
    if not len(t.buf):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(t.ends), np.int64)
    inside = ~gap[t.buf]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cuts = t.ends[:-1][np.diff(t.ends) > 0]
    begins[cuts] = inside[cuts]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    stops[cuts[1:] - 1] = inside[cuts[1:] - 1]
    start = np.flatnonzero(begins)
    end = np.flatnonzero(stops) + 1
    if not len(start):
        return np.zeros(0, np.uint64), start, end, np.zeros(len(t.ends), np.int64)
    length = end - start
    offset = np.cumsum(length) - length
    own = t.buf[inside]
    place = np.arange(len(own)) - np.repeat(offset, length)
    if length.max() <= 64:
        value = _BYTE_OF[own] * _PLACE[place]
    else:
        low, high = place & 63, place >> 6
        value = _BYTE_OF[own] * _PLACE[low]
        far = high > 0
        value[far] = mix64(value[far] + high[far].astype(np.uint64) * _STEP)
    hashed = mix64(np.add.reduceat(value, offset) + length.astype(np.uint64) * _STEP)
    return hashed, start, end, np.searchsorted(start, t.ends)


def shingles(hashed: np.ndarray, first: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of n words, in order, and the bounds per text; a text of fewer words is one shingle, of none has none."""
    count = np.diff(first)
    m = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    bounds = np.concatenate([[0], np.cumsum(m)])
    out = np.zeros(bounds[-1], np.uint64)
    if len(hashed) >= n:
        total = hashed[: len(hashed) - n + 1] * _WORD[0]
        for k in range(1, n):
            total += hashed[k : len(hashed) - n + 1 + k] * _WORD[k]
        text = np.repeat(np.arange(len(m)), m)
        at = np.arange(len(out)) - bounds[text] + first[text]
        full = count[text] >= n
        out[full] = mix64(total[at[full]])
    for k in range(1, n):
        i = np.flatnonzero(count == k)
        out[bounds[i]] = mix64((hashed[first[i][:, None] + np.arange(k)] * _WORD[:k]).sum(1) + np.uint64(1000 + k))
    return out, bounds
