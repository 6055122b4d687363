"""Grouping of spelling variants by a frequency-vector trie.

Words are the letter runs of the texts, counted over all of them. A word's frequency vector holds how often letters of each group of GROUPS
occur in it, group after group. One inserted letter adds one to one count; one replaced letter adds one to a count and takes one from another, or changes
none. So from a word, the words one edit away lie where a trie over the vectors is searched depth first with a budget of one surplus and one deficit.

The trie is cut into shards, each a prefix of counts that holds at most ``shard_words`` words: over-full prefixes are extended count by count. Every
word lives in one shard and visits those that its budget reaches, so no task holds more than a shard's words and its visitors. Within
a shard the search goes on down the same trie, for all visitors of a node side by side, and words at its leaves are verified letter by letter.
Each pair of words is found once: from the shorter one, or of equal lengths from the one that has the smaller count where their vectors first differ.

Defined cases: null and empty texts have no words; a null doc_id counts as the empty text in the noise's hash; repeated rows count each time; words longer
than the letters of most are verified like others; no word gives no row; extra columns are ignored. Only anagrams of one another can not be split between shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.llm.common import cut

#: Runs of letters, in patterns of this alphabet: every letter is one byte of Latin-1.
LETTERS = r"A-Za-zÀ-ÿ"
#: Letter groups in the order of the trie: common letters alone and first; the letters above 0xC0 by their last two bits.
GROUPS = [*"etaoinsrhldcumfpgwybvk", "jqxz", *("".join(chr(c) for c in range(0xC0, 0x100) if c % 4 == k) for k in range(4))]
_GROUP = np.zeros(256, np.int64)
for _i, _letters in enumerate(GROUPS):
    for _c in _letters:
        _GROUP[ord(_c)] = _i
SIZE = len(GROUPS)
#: Pairs of visitors and words that are compared at once.
AT_ONCE = 1 << 16


def noisy_words(docs: DataFrame, least: int = 7, every: int = 31) -> DataFrame:
    """word of each letter run of docs (doc_id, text) with at least ``least`` letters: A-Z lower-cased; where ``every`` divides the crc32 of "<doc_id>:<run>", without the letter that the hash picks."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col("text"), F.lit(f"[{LETTERS}]{{{least},}}+"), F.lit(0))).alias("run"))
    lower = F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hashed = runs.select(lower.alias("run"), F.crc32(F.concat("id", F.lit(":"), lower).cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % every == 0, F.overlay("run", F.lit(""), at + 1, F.lit(1))).otherwise(F.col("run"))
    return hashed.select(word.alias("word")).where(F.length("word") >= least)


def counted(words: DataFrame, least: int = 2) -> DataFrame:
    """word, n of the words with at least ``least`` occurrences."""
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def group_count(i: int, word: str = "word") -> Column:
    """How often letters of group i occur."""
    return F.length(word) - F.length(F.translate(word, GROUPS[i], ""))


def shards_of(words: DataFrame, most: int) -> list[tuple[int, ...]]:
    """Prefixes of counts, none a prefix of another, that together hold all words, each at most ``most`` words (or words of one vector)."""
    done: list[tuple[int, ...]] = []
    open_ = words.select("word")
    for depth in range(1, SIZE + 1):
        by = [group_count(i).alias(f"c{i}") for i in range(depth)]
        full: list[tuple[int, ...]] = []
        for *prefix, n in open_.groupBy(*by).count().toLocalIterator():
            (full if n > most and depth < SIZE else done).append(tuple(prefix))
        if not full:
            break
        keys = words.sparkSession.createDataFrame(full, ", ".join(f"p{i} int" for i in range(depth)))
        same = [group_count(i) == F.col(f"p{i}") for i in range(depth)]
        open_ = words.join(F.broadcast(keys), same, "left_semi").select("word")
    return sorted(done)


def letters(words: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words' Latin-1 bytes one after another, their bounds, and their frequency vectors."""
    own = [w.encode("latin-1") for w in (words.to_pylist() if isinstance(words, (pa.Array, pa.ChunkedArray)) else words)]
    size = np.array([len(w) for w in own], np.int64)
    buf = np.frombuffer(b"".join(own), np.uint8)
    bounds = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(np.arange(len(own)), size) * SIZE + _GROUP[buf]
    return buf, bounds, np.bincount(at, minlength=len(own) * SIZE).reshape(len(own), SIZE).astype(np.int32)


def _step(count: np.ndarray, child: np.ndarray | int, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which visitors may enter a child with that count, and their states after it: 0 nothing spent, 1 the surplus, 2 the deficit too.

    A deficit is only spent after the surplus, so that of two vectors of equal sums only one finds the other."""
    off = child - count
    may = (off == 0) | ((off == 1) & (state == 0)) | ((off == -1) & (state == 1))
    return may, state + (off != 0)


def visits(shards: list[tuple[int, ...]], vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vector, shard) of each shard that a vector's budget reaches; shards are sorted prefixes."""
    found: list[tuple[np.ndarray, int]] = []

    def enter(lo: int, hi: int, depth: int, who: np.ndarray, state: np.ndarray) -> None:
        if hi - lo == 1 and len(shards[lo]) == depth:
            found.append((who, lo))
            return
        while lo < hi:
            child = shards[lo][depth]
            end = lo
            while end < hi and shards[end][depth] == child:
                end += 1
            may, then = _step(vectors[who, depth], child, state)
            if may.any():
                enter(lo, end, depth + 1, who[may], then[may])
            lo = end

    if shards:
        enter(0, len(shards), 0, np.arange(len(vectors)), np.zeros(len(vectors), np.int8))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([w for w, _ in found]), np.repeat([s for _, s in found], [len(w) for w, _ in found])


def one_edit(buf: np.ndarray, bounds: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether words a and b differ by one replaced letter, or b has one more; lengths are equal or b's is one more."""
    size, start, other = bounds[a + 1] - bounds[a], bounds[a], bounds[b]
    longer = bounds[b + 1] - bounds[b] - size
    # letters in common from the front, then from the back, each pair as far as it agrees
    front, back = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    for run, left, right, way in ((front, start, other, 1), (back, start + size - 1, other + size - 1 + longer, -1)):
        live = np.arange(len(a))
        k = 0
        while len(live):
            live = live[size[live] > k]
            live = live[buf[left[live] + way * k] == buf[right[live] + way * k]]
            run[live] += 1
            k += 1
    return (front < size) & (front + back >= size - 1) & (longer == 0) | (longer == 1) & (front + back >= size)


def near_pairs(words: list[str], home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): word a visits word b, which is at home, and they are one edit apart; a depth-first search of the trie over the vectors of words at home."""
    buf, bounds, vectors = letters(words)
    own = np.flatnonzero(home)
    own = own[np.lexsort(vectors[own].T[::-1])]
    trie = vectors[own]
    size = np.diff(bounds)
    # one edit leaves the first three letters of a word or its last three alone
    ends = [sum(buf[np.minimum(at + k, len(buf) - 1)].astype(np.int64) << (8 * k) for k in range(3)) for at in (bounds[:-1], np.maximum(bounds[1:] - 3, 0))]
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def leaf(lo: int, hi: int, depth: int, who: np.ndarray, state: np.ndarray) -> None:
        """The words of a small part of the trie with the visitors that reach it: those with an end in common walk the rest of the vectors, then are verified."""
        them = own[lo:hi]
        for at in range(0, len(who), max(1, AT_ONCE // (hi - lo))):
            w, spent = (x[at : at + max(1, AT_ONCE // (hi - lo))] for x in (who, state))
            i, j = np.nonzero((ends[0][w][:, None] == ends[0][them][None]) | (ends[1][w][:, None] == ends[1][them][None]))
            a, b, spent = w[i], them[j], spent[i]
            for d in range(depth, SIZE):
                may, spent = _step(vectors[a, d], vectors[b, d], spent)
                a, b, spent = a[may], b[may], spent[may]
            # equal vectors: the earlier of two words finds the later
            keep = (spent > 0) & (size[b] - size[a] == (spent == 1)) | (spent == 0) & (a < b)
            a, b = a[keep], b[keep]
            ok = one_edit(buf, bounds, a, b)
            found.append((a[ok], b[ok]))

    stack = [(0, len(own), 0, np.arange(len(words)), np.zeros(len(words), np.int8))]
    while stack:
        lo, hi, depth, who, state = stack.pop()
        if not len(who) or hi == lo:
            continue
        if depth == SIZE or (hi - lo) * len(who) <= AT_ONCE or hi - lo <= 8:
            leaf(lo, hi, depth, who, state)
            continue
        cuts = np.flatnonzero(np.diff(trie[lo:hi, depth])) + 1 + lo
        for begin, end in zip([lo, *cuts], [*cuts, hi]):
            may, then = _step(vectors[who, depth], trie[begin, depth], state)
            stack.append((begin, end, depth + 1, who[may], then[may].astype(np.int8)))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def near(words: DataFrame, shard_words: int = 20_000) -> DataFrame:
    """word, n_near, best (struct of -n and word of the near word with most occurrences) of the words (word, n) with a near word."""
    shards = shards_of(words, shard_words)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = letters(batch.column(0))[2]
            who, shard = visits(shards, vectors)
            # a word is at home where it spends nothing: in the one shard that its own vector lies in
            depth = np.array([len(s) for s in shards])[shard]
            wide = np.array([(*s, *[0] * (SIZE - len(s))) for s in shards], np.int32)[shard]
            home = ((vectors[who] == wide) | (np.arange(SIZE)[None] >= depth[:, None])).all(1)
            took = batch.take(pa.array(who))
            yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), pa.array(home), took.column(0), took.column(1)], ["shard", "home", "word", "n"])

    def search(table: pa.Table) -> pa.Table:
        table = table.sort_by("word")
        words, n = table.column("word").to_pylist(), table.column("n").to_numpy()
        a, b = near_pairs(words, np.asarray(table.column("home")))
        one, two = np.concatenate([a, b]), np.concatenate([b, a])
        order = np.lexsort((two, -n[two], one))  # the table is in the order of words
        one, two = one[order], two[order]
        heads, first, count = np.unique(one, return_index=True, return_counts=True)
        best = two[first]
        return pa.table({"word": pa.array([words[i] for i in heads], pa.string()), "n_near": pa.array(count.astype(np.int64)), "m": pa.array(-n[best]), "best": pa.array([words[i] for i in best], pa.string())})

    dealt = words.select("word", "n").mapInArrow(deal, "shard int, home boolean, word string, n long")
    found = dealt.groupBy("shard").applyInArrow(search, "word string, n_near long, m long, best string")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("m", "best")).alias("best"))


def group(docs: DataFrame, *, least: int = 7, times: int = 10, shard_words: int = 20_000) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words of docs.

    form: the near word with the most occurrences, if it has at least ``times`` those of the word. root: the last of the forms from the word on."""
    words = cut(counted(noisy_words(docs, least)))
    with_near = words.join(near(words, shard_words), "word", "left")
    form_n = -F.col("best.m")
    has = form_n >= times * F.col("n")
    rows = cut(with_near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("best.best")).alias("form"), F.when(has, form_n).alias("form_n")))
    # each step doubles how far a word's root is followed; occurrences rise tenfold with each form, so there are few
    roots = rows.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        if not roots.join(on, "root", "left_semi").limit(1).count():
            break
        roots = cut(roots.join(on, "root", "left").select("word", F.coalesce("_next", "root").alias("root")))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
