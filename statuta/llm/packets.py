"""Arrays dealt to buckets: rows of a bucket number and one binary value per array, for shuffles of many small records."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa


def deal(bucket: np.ndarray, arrays: Sequence[np.ndarray], names: Sequence[str]) -> pa.RecordBatch:
    """One row per bucket that occurs, with the arrays' elements that fall in it."""
    order = np.argsort(bucket, kind="stable")
    sorted_ = bucket[order]
    starts = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(sorted_) else np.zeros(0, np.int64)
    ends = np.append(starts[1:], len(sorted_))
    columns = [pa.array(sorted_[starts].astype(np.int32))]
    for a in arrays:
        a = a[order]
        columns.append(pa.array([a[s:e].tobytes() for s, e in zip(starts, ends)], pa.binary()))
    return pa.RecordBatch.from_arrays(columns, ["bucket", *names])


def gathered(table: pa.Table, name: str, dtype: type) -> np.ndarray:
    """The arrays of a column, joined."""
    return np.frombuffer(b"".join(x.as_py() for x in table.column(name)), dtype)


class Dealer:
    """Collects elements and gives them out as rows once there are ``most`` of them."""

    def __init__(self, names: Sequence[str], most: int = 250_000):
        self.names, self.most, self.held, self.n = names, most, [], 0

    def add(self, bucket: np.ndarray, *arrays: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append((bucket, *arrays))
        self.n += len(bucket)
        if self.n >= self.most:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            bucket, *arrays = (np.concatenate(x) for x in zip(*self.held))
            self.held, self.n = [], 0
            yield deal(bucket, arrays, self.names)


def runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of equal values."""
    starts = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else np.zeros(0, np.int64)
    return starts, np.append(starts[1:], len(sorted_keys))[: len(starts)]


def planes(a: np.ndarray) -> bytes:
    """The elements' first bytes, then their second bytes, and so on: high bytes of small numbers compress away in shuffles."""
    return np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


def unplanes(data: bytes, dtype: type) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, len(data) // size).T).reshape(-1).view(dtype)
