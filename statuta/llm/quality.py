"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors of its hashed features: words, pairs of neighbouring words, and n-grams of 3 and 4 characters (code points) within
words and their bounds. A pair is hashed by the difference of its words' hashes; so a word twice is one and the same pair, whatever the word,
and what is learned of it holds for words never seen. They are followed by a softmax over the two labels; numpy stochastic gradient descent learns both layers. Fitting uses at most
``max_train`` labelled documents (those of smallest hash among the rows allowed), whole texts; scoring covers every
document. As the output is linear in the average, a fitted model scores with one learned number per feature, which
is what tasks receive (its size is fixed by ``buckets``).

Defined cases: a null or empty text has no feature and gets the score of the bias alone; documents without a label are
scored like others; a document labelled twice takes the smaller label; labels other than 0 and 1 are ignored; with fewer than one label of
each kind every score is the smoothed share of label 1; repeated rows are scored alike; an empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.llm.common import fold
from statuta.llm.words import Texts, mix64, pieces, words

BUCKET_BITS = 18
BUCKETS = 1 << BUCKET_BITS
_SHIFT = np.uint64(64 - BUCKET_BITS)
#: Kinds of features, in the order of features().
KINDS = ("words", "pairs", "3-grams", "4-grams")


def _characters(t: Texts, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of the words one after another, each word between two marks, as their bytes in one number; and the word of each."""
    at = np.flatnonzero((t.buf & 0xC0) != 0x80)
    code, padded = t.buf[at].astype(np.uint32), np.concatenate([t.buf, np.zeros(3, np.uint8)])
    more = np.ones(len(at), bool)
    for k in range(1, 4):
        more &= (padded[at + k] & 0xC0) == 0x80
        code |= np.where(more, padded[at + k].astype(np.uint32) << np.uint32(8 * k), np.uint32(0))
    low, high = np.searchsorted(at, start), np.searchsorted(at, end)
    size = high - low + 2
    word = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)
    out = np.where(place == 0, np.uint32(1), np.uint32(2))
    inner = (place > 0) & (place < size[word] - 1)
    out[inner] = code[low[word[inner]] + place[inner] - 1]
    return out, word


def features(t: Texts) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind of feature: the buckets, and the bounds of each text in them."""
    out = []
    hashed, start, end, first = words(t)
    out.append(((hashed >> _SHIFT).astype(np.uint32), first))
    pair = (mix64(hashed[1:] - hashed[:-1] + np.uint64(2)) >> _SHIFT).astype(np.uint32)
    within = np.ones(len(pair), bool)
    heads = first[:-1][np.diff(first) > 0]
    within[heads[heads > 0] - 1] = False
    out.append((pair[within], np.searchsorted(np.flatnonzero(within), first)))
    code, word = _characters(t, start, end) if len(start) else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
    for n in (3, 4):
        m = max(0, len(code) - n + 1)
        x = np.full(m, n, np.uint64)
        for k in range(n):
            x = mix64(x * np.uint64(0x9E3779B97F4A7C15) + code[k : m + k])
        within = word[:m] == word[n - 1 :] if m else np.zeros(0, bool)
        out.append(((x[within] >> _SHIFT).astype(np.uint32), np.searchsorted(word[:m][within], first)))
    return out


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[bounds[1:]] - total[bounds[:-1]]


@dataclass
class Model:
    """score = sigmoid(mean of value[feature] + bias)."""

    value: np.ndarray
    bias: float

    def scores(self, t: Texts) -> np.ndarray:
        total, count = np.zeros(len(t.ends) - 1), np.zeros(len(t.ends) - 1)
        for found, bounds in features(t):
            total += _sums(self.value[found], bounds)
            count += np.diff(bounds)
        return 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + self.bias, -30, 30)))


def fit_sgd(docs: list[tuple[np.ndarray, np.ndarray, int]], *, dim: int = 16, epochs: int = 5, rate: float = 1.0, seed: int = 1) -> Model:
    """docs: unique buckets, their shares of the document's features, label."""
    labels = np.array([y for _, _, y in docs], float)
    prior = (labels.sum() + 1) / (len(labels) + 2)
    if not len(labels) or labels.min() == labels.max():
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(prior / (1 - prior))))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim)).astype(np.float32)
    out, bias = rng.uniform(-1, 1, (dim, 2)).astype(np.float32), np.zeros(2, np.float32)
    for step, i in enumerate(np.concatenate([rng.permutation(len(docs)) for _ in range(epochs)])):
        lr = rate * (1 - step / (epochs * len(docs)))
        at, share, y = docs[i]
        rows = vectors[at]
        hidden = share @ rows
        z = hidden @ out + bias
        p = np.exp(z - z.max())
        p /= p.sum()
        p[y] -= 1
        back = out @ p
        out -= lr * np.outer(hidden, p)
        bias -= 0.1 * lr * p
        vectors[at] = rows - np.minimum(lr * 20 * share, 0.5)[:, None] * back
    return Model((vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, allowed: Column | None = None, *, max_train: int = 4000) -> Model:
    """Learns from at most max_train labelled documents (the bound of what reaches the driver) among those allowed (a condition on doc_id)."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    known = (known.where(allowed) if allowed is not None else known).groupBy("doc_id").agg(F.min("quality").cast("int").alias("y"))
    sample = known.orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(max_train)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, t in pieces(batches, "text", 1 << 18):
            kinds, rows = features(t), []
            for i in range(batch.num_rows):
                at, n = np.unique(np.concatenate([f[b[i] : b[i + 1]] for f, b in kinds]), return_counts=True)
                rows.append((at.astype(np.uint32).tobytes(), (n / max(1, n.sum())).astype(np.float32).tobytes()))
            yield pa.record_batch([batch.column(batch.schema.get_field_index("doc_id")), batch.column(batch.schema.get_field_index("y")), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], ["doc_id", "y", "at", "share"])

    found = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "y", "text").mapInArrow(extract, "doc_id long, y int, at binary, share binary")
    rows = sorted(((r["doc_id"], bytes(r["at"]), bytes(r["share"]), r["y"]) for r in found.toLocalIterator()))[: 2 * max_train]
    return fit_sgd([(np.frombuffer(a, np.uint32).astype(np.int64), np.frombuffer(s, np.float32), y) for _, a, s, y in rows])


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, score and predicted of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, t in pieces(batches, "text"):
            s = model.scores(t)
            yield pa.record_batch([batch.column(batch.schema.get_field_index("doc_id")), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, allowed: Column | None = None, *, threshold: float = 0.3, max_train: int = 4000) -> DataFrame:
    return score(docs, fit(docs, labels, allowed, max_train=max_train), threshold)


def held_out(doc_id: str = "doc_id") -> Column:
    return fold(doc_id) == 0


def accept(docs: DataFrame, labels: DataFrame, allowed: Column | None = None, *, threshold: float = 0.3, max_train: int = 4000) -> DataFrame:
    """The rows of docs scored at threshold or more, in the same pass that scores them."""
    model = fit(docs, labels, allowed, max_train=max_train)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, t in pieces(batches, "text"):
            yield batch.filter(pa.array(model.scores(t) >= threshold))

    return docs.mapInArrow(run, docs.schema)
