"""Nulls, empty and long texts, repeated rows, ties, empty tables, clashing columns: every operator against a plain version."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from statuta.llm import chat, components, decontam, earlier, jaccard, mixing, mixture, neighbours, paragraphs, pii, quality

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = "doc_id long, text string, source string, h string, spans string, block long, c int, bucket string, alt int, `_d` int"


def words(t):
    return [w for w in re.split("[\x20\x09-\x0d]+", (t or "").translate(LOWER)) if w]


def shingles(t, n=5):
    w = words(t)
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def random_text(rng, n):
    return " ".join(rng.choice("alpha Beta gamma delta eps zeta eta theta iota kappa").lower() if False else f"w{rng.randint(0, 400)}" for _ in range(n))


def make_rows():
    rng = random.Random(3)
    base = [random_text(rng, 80) for _ in range(12)]
    rows = []
    for i in range(60):
        t = base[i % 12].split()
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(len(t))] = f"x{rng.randint(0, 99)}"
        rows.append([i, " ".join(t)])
    rows += [[60, None], [61, ""], [62, " \n\t "], [63, "only three words"], [64, "Only three  words"], [65, "long " * 20_000], [68, " ".join(f"d{i}x{i * 7919 % 10007}" for i in range(12_000))], [66, base[0].upper()], [67, base[1] + "\n" + base[2]], [1, rows[1][1]], [1, rows[1][1]], [None, base[3]], [None, None]]
    return [(d, t, ["a", "b", None][k % 3], "x", "y", 7, 1, "z", 5, 6) for k, (d, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(make_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def groups(keys, linked):
    up = list(range(len(keys)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(keys)):
        for j in range(i):
            if linked(i, j):
                up[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(keys))]


def test_jaccard(docs, empty):
    rows = [(r[0], r[1]) for r in make_rows()]
    sets = [shingles(t) for _, t in rows]
    roots = groups(rows, lambda i, j: bool(sets[i]) and bool(sets[j]) and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]))
    least = {}
    for (d, _), r in zip(rows, roots):
        if d is not None:
            least[r] = min(d, least.get(r, d))
    want = sorted((str(d), len(s), str(least.get(r, d) if s else d)) for (d, _), s, r in zip(rows, sets, roots))
    assert sorted((str(r[0]), r[1], str(r[2])) for r in jaccard.join(docs).collect()) == want
    assert jaccard.join(empty).count() == 0
    kept = [r["doc_id"] for r in jaccard.keep_first(docs).collect()]
    assert kept.count(1) == 1 and set(kept) - {None} == {int(c) for d, _, c in want if d != "None"}


def test_large_groups_lose_no_link(spark):
    rng = random.Random(8)
    base = random_text(rng, 60).split()
    rows = []
    for i in range(90):
        t = list(base)
        for _ in range(rng.randint(1, 3)):
            t[rng.randrange(len(t))] = f"y{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(t)))
    sets = [shingles(t) for _, t in rows]
    roots = groups(rows, lambda i, j: 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]))
    got = {r[0]: r[2] for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(enumerate(roots))


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1040)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {}
    for a, b in edges:
        seen = {a, b} | {n for n, r in up.items() if r in (up.get(a, a), up.get(b, b))}
        for n in seen:
            up[n] = min(min(seen), *[up.get(x, x) for x in seen])
    assert got == {n: r for n, r in up.items() if any(a != b and n in (a, b) for a, b in edges)}


def test_decontamination(spark, docs, empty):
    rng = random.Random(5)
    rows = make_rows()
    items = [(1, " ".join(rows[3][1].split()[5:40])), (2, "only THREE words"), (3, None), (4, ""), (5, random_text(rng, 50)), (6, " ".join(rows[7][1].split()[:30])), (6, " ".join(rows[7][1].split()[:30]))]
    frame = spark.createDataFrame(items, "item_id long, text string")
    want = Counter()
    for d, t, *_ in rows:
        for i, x in items:
            q, s = shingles(x), shingles(t)
            if q and 100 * len(q & s) >= 75 * len(q):
                want[(d, i, len(q), len(q & s))] += 1
    got = Counter((r[0], r[1], r[2], r[3]) for r in decontam.find(docs, frame, block_items=2).collect())
    assert got == want
    assert decontam.find(empty, frame).count() == 0 and decontam.find(docs, frame.limit(0)).count() == 0
    assert decontam.clean(docs, frame).columns == docs.columns


def line_rows(rows, min_words):
    """What find should give for lines: (doc_id, start, end, n_words, first_doc_id, first_start, n_copies, removed)."""
    lines = []
    for d, t in rows:
        at = 0
        for x in (t or "").split("\n"):
            if len(words(x)) >= min_words:
                lines.append((d, at, at + len(x.encode()), x))
            at += len(x.encode()) + 1
    sets = [shingles(x) for *_, x in lines]
    roots = groups(lines, lambda i, j: 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]))
    size = Counter(roots)
    first = {r: min((d, s) for (d, s, _, _), q in zip(lines, roots) if q == r) for r in size}
    return {(d, s, e, len(words(x)), *first[r], size[r], (d, s) != first[r]) for (d, s, e, x), r in zip(lines, roots) if size[r] > 1}


def test_paragraphs(spark, docs, empty):
    rows = [(r[0], r[1]) for r in make_rows() if r[0] is not None and r[0] != 1]
    plain = spark.createDataFrame(rows, "doc_id long, text string")
    got = {tuple(r) for r in paragraphs.find(plain, min_words=20, passage_words=0).drop("h").collect()}
    assert got == line_rows(rows, 20)
    assert paragraphs.find(empty).count() == 0
    assert paragraphs.clean(plain).where("doc_id = 67").first()["text"].count("\n") < 1
    cleaned = paragraphs.clean(docs)
    assert cleaned.columns == docs.columns and cleaned.count() == docs.count()
    assert cleaned.drop("text").exceptAll(docs.drop("text")).count() == 0
    texts = [r["text"] for r in cleaned.where("doc_id IS NULL").collect()]
    assert sorted("none" if x is None else x for x in texts) == ["", "none"]  # the null row's text is a copy of document 3's


def test_null_ids_link(spark):
    rng = random.Random(4)
    base = random_text(rng, 60).split()
    near = [" ".join(base[:k] + ["other"] + base[k + 1 :]) for k in (0, 20, 59)]
    rows = [(1, near[0]), (None, near[1]), (None, near[2]), (5, near[2]), (None, "quite alone here"), (None, "quite alone here")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(r["component_id"] for r in jaccard.join(frame).collect()) == {1: 4, None: 2}
    assert sorted((r[0] or 0, r[1]) for r in jaccard.keep_first(frame).collect()) == [(0, "quite alone here"), (1, near[0])]
    # linked only through a row without an id
    far = [" ".join(base[:-5] + [f"v{i}" for i in range(5)]), " ".join(base), " ".join([f"v{i}" for i in range(5)] + base[5:])]
    sets = [shingles(t) for t in far]
    assert 100 * len(sets[0] & sets[2]) < 75 * len(sets[0] | sets[2])
    frame = spark.createDataFrame([(1, far[0]), (None, far[1]), (2, far[2])], "doc_id long, text string")
    assert {r["component_id"] for r in jaccard.join(frame).collect()} == {1}
    item = spark.createDataFrame([(1, " ".join(base[5:40]))], "item_id long, text string")
    assert [r["doc_id"] for r in decontam.clean(spark.createDataFrame([(None, " ".join(base)), (None, "fine"), (3, None)], "doc_id long, text string"), item).collect()] in ([None, 3], [3, None])


def test_short_paragraphs(spark):
    rng = random.Random(8)
    long = [random_text(rng, n) for n in (5, 6, 7, 8, 12, 15, 19, 24)]
    rows = [(i, "\n".join(["Home page", "", " \t", long[i % 8], " ".join(random_text(rng, 9).split() + ["end"]), long[(i + 3) % 8] + f" more{i % 4}", f"{i % 5}"])) for i in range(24)]
    want = line_rows(rows, 1)
    got = {tuple(r) for r in paragraphs.find(spark.createDataFrame(rows, "doc_id long, text string"), passage_words=0).drop("h").collect()}
    assert got == want and {1, 2, 8} <= {w[3] for w in want}


def test_passages_in_long_lines(spark, tmp_path):
    from statuta.llm import queries

    rng = random.Random(9)
    own = lambda n: " ".join(f"u{rng.randint(0, 10**9)}" for _ in range(n))
    shared = [own(51) for _ in range(20)]
    rows = [(i, own(rng.randint(0, 90)) + rng.choice([" ", "\n"]) + shared[i % 20] + " " + own(rng.randint(0, 90))) for i in range(40)] + [(90, own(300)), (91, "the " * 200), (92, "The " * 90)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op10_paragraph_dedup(spark, str(tmp_path)).where("n_words = 25").collect()
    texts = {d: t.encode() for d, t in rows}
    assert {r["doc_id"] for r in found} == set(range(40))
    for r in found:
        assert r["removed"] == (r["doc_id"] >= 20) and r["first_doc_id"] == r["doc_id"] % 20 and r["n_copies"] == 2
        here = words(texts[r["doc_id"]][r["start"] : r["end"]].decode())
        there = words(texts[r["first_doc_id"]][r["first_start"] :].decode())[:25]
        assert here == there and " ".join(here) in shared[r["doc_id"] % 20]
    cleaned = {r["doc_id"]: r["text"] for r in paragraphs.clean(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(cleaned[d] == t for d, t in rows if d < 20 or d == 90) and all(len(words(cleaned[d])) < len(words(t)) - 24 for d, t in rows if 20 <= d < 40)


def stretches_of(text, length, apart):
    """(start, end) of the stretches of a line, by plain loops over its shingles and their hashes."""
    import numpy as np

    from statuta.llm import words as hashing

    data = text.encode()
    t = hashing.Texts(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    hashed, first, last, bounds = hashing.words(t)
    found = hashing.shingles(hashed, bounds)[0].tolist()
    span, out = length - 4, []
    if 100 * span >= 75 * len(set(found)):
        return out
    for p in range(len(found) - span + 1):
        own = found[p : p + span]
        if found[p] == min(found[max(0, p - apart) : p + apart + 1]) and len(set(own)) == span and not set(own) & set(found[max(0, p - span) : p]):
            out.append((int(first[p]), int(last[p + length - 1])))
    return out


def test_stretches_of_long_lines(spark):
    rng = random.Random(12)
    base = [random_text(rng, n).split() for n in (90, 130, 260, 60, 47)]

    def changed(w, every):
        return [f"new{rng.randint(0, 10**9)}" if i % every == every - 1 else x for i, x in enumerate(w)]

    rows = []
    for d in range(24):
        parts = [random_text(rng, rng.randint(0, 60)), " ".join(changed(base[d % 5], rng.choice([30, 40, 55, 1000]))), random_text(rng, rng.randint(0, 60))]
        rows.append((d, rng.choice([" ", " ", "\n", " \t é "]).join(parts)))
    rows += [(30, " ".join(base[0] + base[0] + base[0])), (31, " ".join(base[4] * 6)), (32, "one word " * 90), (33, ""), (34, None), (35, " ".join(base[3]) + "\n" + " ".join(base[3][:45]))]
    every = []
    for d, t in rows:
        at = 0
        for x in (t or "").split("\n"):
            if words(x):
                every.append((d, at, at + len(x.encode()), x))
                every += [(d, at + s, at + e, x.encode()[s:e].decode()) for s, e in stretches_of(x, 40, 8)]
            at += len(x.encode()) + 1
    sets = [shingles(x) for *_, x in every]
    roots = groups(every, lambda i, j: 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]))
    size = Counter(roots)
    first = {r: min((d, s) for (d, s, _, _), q in zip(every, roots) if q == r) for r in size}
    want = {(d, s, e, len(words(x)), *first[r], size[r], (d, s) != first[r]) for (d, s, e, x), r in zip(every, roots) if size[r] > 1}
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {tuple(r) for r in paragraphs.find(frame, passage_words=0, stretch_words=40, stretch_recall=0.9999999).drop("h").collect()}
    assert got == want and sum(w[3] == 40 and w[7] for w in want) > 20
    assert paragraphs.find(frame, passage_words=0).where("n_words = 40").count() == 0
    with pytest.raises(ValueError):
        paragraphs.find(frame, apart=3)


def test_near_passages_in_long_lines(spark):
    rng = random.Random(13)
    own = lambda n: [f"u{rng.randint(0, 10**12)}" for _ in range(n)]
    rows, place = [], {}
    for i in range(60):
        shared, every = own(120), (40, 60)[i % 2]
        for k in (0, 1):
            head, there = own(rng.randint(200, 400)), [x if not k or j % every != every - 1 else own(1)[0] for j, x in enumerate(shared)]
            rows.append((2 * i + k, " ".join(head + there + own(300))))
            place[2 * i + k] = (len(" ".join(head)) + 1, len(" ".join(head)) + 1 + len(" ".join(there)))
    rows += [(1000 + i, " ".join(own(700))) for i in range(20)]
    gone = {d: set() for d, _ in rows}
    for r in paragraphs.find(spark.createDataFrame(rows, "doc_id long, text string")).where("removed").collect():
        gone[r["doc_id"]].update(range(r["start"], r["end"]))
    copies = [2 * i + 1 for i in range(60)]
    assert not any(gone[d] for d, _ in rows if d not in copies)  # first copies and texts of their own stay whole
    share = [len(gone[d] & set(range(*place[d]))) / (place[d][1] - place[d][0]) for d in copies]
    assert sum(x > 0.5 for x in share) >= 57 and sum(share) / 60 > 0.87
    assert all(len(gone[d] - set(range(*place[d]))) < 15 * 14 for d in copies)  # a stretch may reach over an end by some words


def test_earlier_strings(spark, docs, empty):
    rows = [(r[0], r[1]) for r in make_rows()]
    first, far = {}, 2**63
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            first[b[i : i + 50]] = min(first.get(b[i : i + 50], far), far if d is None else d)
    want = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < (far if d is None else d):
                gone[i : i + 50] = b"\1" * 50
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        want.append((str(d), len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    got = [(str(r[0]), *r[1:]) for r in earlier.remove(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()]
    assert sorted(got) == sorted(want)
    assert earlier.remove(empty).count() == 0


def test_suffix_order_decides(spark, docs, monkeypatch):
    """Without longest earlier matches less is removed; k-grams that count as frequent go another way to the same result."""
    import numpy as np
    import pyarrow as pa

    from statuta.llm import words as w

    def result():
        out = earlier.remove(docs).select("doc_id", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept"))
        return Counter(tuple(r) for r in out.collect())

    usual = result()
    monkeypatch.setattr(earlier, "SAMPLE", 1)
    monkeypatch.setattr(earlier, "FREQUENT", 1)
    source = docs.select("doc_id", "text", F.lit(0).cast("long").alias("alt"))
    assert len(earlier._frequent(source, 50)) > 100
    assert result() == usual
    monkeypatch.undo()
    t = w.texts_of(pa.array([r[1] for r in make_rows()[:20]], pa.large_string()))
    found = earlier.windows(t, 50, [np.array([[0, 10**6]])] * 20)
    n = sum(max(0, len(r[1].encode()) - 49) for r in make_rows()[:20])
    assert found["n"].sum() == n  # every string is in one window
    layout = earlier._layout(50)
    data = earlier._rows(np.zeros(len(found["h"]), np.int64), found | {"doc": found["text"].astype(np.int64), "alt": np.zeros(len(found["h"]), np.int64)}, layout)
    table = pa.table({"bucket": [0], "kind": pa.array([0], pa.int8()), "data": pa.array([data[0][1]], pa.binary())})
    with_order = earlier._match_windows(50, 1)(table).num_rows
    monkeypatch.setattr(earlier, "longest_previous", lambda strings, doc: np.zeros(len(strings), np.int64))
    assert earlier._match_windows(50, 1)(table).num_rows < with_order


def test_many_texts_without_an_id(spark):
    frame = spark.range(70_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("a line of text that all of these share, of more than fifty bytes "), F.col("id").cast("string")).alias("text"))
    one = spark.createDataFrame([(7, "a line of text that all of these share, of more than fifty bytes ")], "doc_id long, text string")
    out = earlier.remove(frame.unionByName(one)).groupBy("doc_id").agg(F.count("*").alias("n"), F.min("n_removed").alias("lo"), F.max("n_removed").alias("hi"))
    assert {(r["doc_id"], r["n"], r["lo"], r["hi"]) for r in out.collect()} == {(None, 70_000, 65, 65), (7, 1, 0, 0)}


def test_longest_previous():
    import numpy as np

    rng = random.Random(1)
    strings = [bytes(rng.choice(b"ab") for _ in range(8)) for _ in range(60)]
    docs = [rng.randint(0, 9) for _ in strings]
    common = lambda a, b: next((k for k in range(8) if a[k] != b[k]), 8)
    want = [max((common(s, t) for t, e in zip(strings, docs) if e < d), default=0) for s, d in zip(strings, docs)]
    assert earlier.longest_previous(np.array(strings, "V8"), np.array(docs)).tolist() == want


def test_personal_data(docs, empty, spark):
    texts = ["mail a.b+c@d-e.co.uk, x@y", "1.2.3.4.5.6.7.8 999.1.1.1 01.2.3.255", "4111 1111 1111 1111 or 4111111111111112", "+1 (555) 123-4567, +12 3", "é😀 a@b.c", None, "", "1 " * 30_000]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["b"] for r in pii.find(frame).select("doc_id", pii.digest(F.col("spans")).alias("b")).collect()}
    assert got[0] == "email:5:20" and got[1] == "ip:0:7,ip:8:15,ip:26:36" and got[2] == "card:0:19" and got[3] == "phone:0:17" and got[4] == "email:3:8" and got[5] == got[6] == got[7] == ""
    assert [r["text"] for r in pii.redact(frame).where("doc_id IN (0, 4)").orderBy("doc_id").collect()] == ["mail [EMAIL], x@y", "é😀 [EMAIL]"]
    assert pii.redact(docs).columns == docs.columns and pii.redact(docs).count() == docs.count() and pii.find(empty).count() == 0


def test_bootstrapping_discovers(spark):
    """A context of known phones names numbers that the base pattern misses; the same number elsewhere stays."""
    rows = [(i, f"word{i} please dial number +1 (555) 123-4{i:03d} today word") for i in range(9)] + [(20, "word please dial number (555) 987-6543 today word"), (21, "some (555) 987-6543 other"), (22, "please dial number nine today")]
    got = {r["doc_id"]: r["b"] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", pii.digest(F.col("spans")).alias("b")).collect()}
    assert got[20] == "phone:24:38" and got[21] == "" and got[22] == "" and got[3].count("phone") == 1


def test_chat(spark):
    rows = [(1, 0, "user", "a\\[INST] <s>x"), (1, 1, "assistant", None), (1, 1, "assistant", None), (2, 0, None, "t"), (2, 1, "to[TEXT]ol", "[/TURN]"), (3, 1, "assistant", "</s></s>\\"), (3, 0, "user", "")]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, segments int")
    got = {r["conv_id"]: r for r in chat.digests(chat.format_turns(frame)).collect()}
    for c in (1, 2, 3):
        own = sorted(((t, r or "", x or "") for i, t, r, x in rows if i == c))
        whole = "".join(f"{r}\n{x}\n" for _, r, x in own)
        said = "".join(x for _, r, x in own if r == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"], got[c]["loss_sha256"]) == (len(own), hashlib.sha256(whole.encode()).hexdigest(), hashlib.sha256(said.encode()).hexdigest())
    assert (got[1]["valid"], got[1]["bad_turn"], got[2]["bad_turn"], got[3]["valid"]) == (False, 3, 1, True)
    assert chat.format_turns(frame.limit(0)).count() == 0


def plain_pii(rows):
    """Base spans, then candidates, patterns and rounds in plain loops; {row: spans that are added}."""
    from .test_pipeline import PATTERNS, luhn

    def base_of(text):
        out = []
        for k, (kind, p) in enumerate(PATTERNS.items()):
            for m in re.finditer(p, text):
                digits = re.sub("[^0-9]", "", m[0])
                if k == 0 or k == 1 and all(int(x) <= 255 for x in m[0].split(".")) or k == 2 and 12 <= len(digits) <= 19 and luhn(digits) or k == 3 and 9 <= len(digits) <= 15:
                    out.append((m.start(), k, m.end()))
        return sorted(out)

    kinds_of = lambda v: [k for k, name in enumerate(pii.KINDS) if re.search(pii.SHAPES[name], v)]
    edge = lambda v: re.sub(r"^[^A-Za-z0-9+(\[]+|[^A-Za-z0-9\])]+$", "", v)
    places = []
    for d, text in rows:
        base = base_of(text)
        tokens = [m for m in re.finditer(r"[^ \t-\r]+", text) if re.search(r"[0-9@]|[\[(](?:at|dot)[\])]", m[0])]
        starts = [0] + [m.end() for m in tokens]
        gap = [text[a : m.start()] for a, m in zip(starts, tokens)] + [text[starts[-1] :]]
        said, reach = [m[0] for m in tokens] + [""], -1
        for i, m in enumerate(tokens):
            seed = next((x for x in base if m.start() <= x[0] < m.end()), None)
            s = m.start() + len(re.match(r"[^A-Za-z0-9+(\[]*", m[0])[0])
            runs = [edge(" ".join(said[i : i + n])) for n in range(pii.MOST, 0, -1) if i + n <= len(tokens) and all(g == " " for g in gap[i + 1 : i + n])]
            v = next((x for x in runs if kinds_of(x)), edge(m[0]))
            s, e = (seed[0], seed[2]) if seed else (s, s + len(v))
            if s >= reach and e > s:
                inside = sum(x.start() < e for x in tokens[i + 1 : i + 3 + pii.MOST])
                prior = (gap[i - 1] + said[i - 1] if i else "") + gap[i]
                last = lambda p: (re.search(p + r"[ \t-\r]+\Z", prior) or ["", ""])[1].lower()
                l1, l2 = last(r"(?<![^ \t-\r])([^ \t-\r]+)"), last(r"(?<![^ \t-\r])([^ \t-\r]+[ \t-\r]+[^ \t-\r]+)")
                r1 = (re.match(r"[ \t-\r]+([^ \t-\r]+)", gap[i + inside + 1] + said[i + inside + 1]) or ["", ""])[1].lower()
                v = " ".join(said[i : i + inside + 1]) if seed else v
                free = not any(x[0] < e and s < x[2] for x in base)
                p = [x for x in ("1:" + l1 if l1 else "", "2:" + l2 if l2 else "", f"3:{l1} _ {r1}" if l1 and r1 else "") if x]
                places.append((d, s, e, v, seed[1] if seed else None, free, [seed[1]] if seed else kinds_of(v) if free else [], p))
            reach = max(reach, e)
    edges = {}
    for *_, v, seed, _, ks, ps in places:
        for p in ps:
            was = edges.get((p, v), (-1, []))
            edges[p, v] = (max(was[0], -1 if seed is None else seed), max(was[1], ks))
    n = Counter(p for p, _ in edges)
    known = {(v, s): 1.0 for (_, v), (s, _) in edges.items() if s >= 0}
    while True:
        got = {}
        for p, v in edges:
            for k in range(4):
                if (v, k) in known:
                    got.setdefault((p, k), []).append(known[v, k])
        trusted = {pk: sum(x) / (n[pk[0]] + 0.5) for pk, x in got.items() if len(x) >= 3 and sum(x) / (n[pk[0]] + 0.5) >= 0.7}
        fresh = {}
        for (p, v), (s, ks) in edges.items():
            for k in ks if s < 0 else []:
                if (p, k) in trusted and (v, k) not in known:
                    fresh[v, k] = max(fresh.get((v, k), 0), trusted[p, k])
        if not fresh:
            break
        known |= fresh
    return {(d, s, max((trusted[p, k], -k, k) for p in ps for k in ks if (p, k) in trusted)[2], e) for d, s, e, _, seed, free, ks, ps in places if free and seed is None and any((p, k) in trusted for p in ps for k in ks)}


def test_bootstrapping_against_plain_loops(spark):
    rng = random.Random(12)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    leads = ["call me on", "my phone:", "reach us at", "order no", "dial number", "since", "mail to"]
    rows = []
    for i in range(3000):
        parts = []
        for _ in range(rng.randint(0, 4)):
            lead = rng.choice(leads)
            known = {"call me on": 0.9, "my phone:": 0.7, "dial number": 0.3}.get(lead, 0.1)
            number = f"+1 ({digits(3)}) {digits(3)}-{digits(4)}" if rng.random() < known else rng.choice([f"({digits(3)}) {digits(3)}-{digits(4)}", digits(4), f"({digits(3)}) {digits(3)}-{digits(4)}, {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(4)} {digits(4)}-05-01"])
            if lead == "mail to":
                number = rng.choice([f"a{digits(2)}@b{digits(1)}.org", f"a{digits(2)}@b{digits(1)}.org", f"a{digits(2)}@b{digits(1)}.org", f"john{digits(1)}[at]example[dot]com"])
            parts.append(f"{random_text(rng, rng.randint(0, 2))} {lead} {number}{rng.choice(['', ',', '.'])} {rng.choice(['today', 'please', ''])}")
        rows.append((i, " ".join(parts) + rng.choice(["", " end", "\n"])))
    want = plain_pii(rows)
    found = pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {(r["doc_id"], x["s"], x["k"], x["e"]) for r in found for x in r["spans"] if x not in r["base"]}
    assert got == want and len(want) > 100 and {k for _, _, k, _ in want} == {0, 3}
    assert any("[at]" in dict(rows)[d][s:e] for d, s, _, e in want)


def test_many_matches_in_one_text(spark):
    """Work grows with the matches, not with their square."""
    import time

    frame = spark.createDataFrame([(1, "tel 10.0.0.1, " * 30_000)], "doc_id long, text string")
    began = time.time()
    r = pii.find(frame).select(F.size("base").alias("n"), F.element_at("base", -1).alias("b")).first()
    assert r["n"] == 30_000 and r["b"]["s"] == 14 * 29_999 + 4
    assert pii.redact(frame).first()["text"] == "tel [IP], " * 30_000
    assert time.time() - began < 90


def plain_schedule(blocks, weights):
    """Every slot goes to the released block of earliest deadline, with fractions."""
    left, used, start, out = {k: n for k, n in blocks.items() if n}, dict.fromkeys(blocks, 0), 0, {}
    while left:
        w = {k: Fraction(weights.get(k, 0.0)) for k in left if weights.get(k, 0.0) > 0} or {k: Fraction(1) for k in left}
        w = {k: x / sum(w.values()) for k, x in w.items()}
        done, slot = dict.fromkeys(w, 0), 0
        while all(left[k] for k in w):
            k = min((k for k in w if math.floor(done[k] / w[k]) <= slot), key=lambda k: (math.ceil((done[k] + 1) / w[k]), k))
            out[k, used[k]] = (start + slot, start, float(w[k]))
            done[k], used[k], left[k], slot = done[k] + 1, used[k] + 1, left[k] - 1, slot + 1
        left = {k: n for k, n in left.items() if n}
        start += slot
    return out


def test_mixing(spark, docs, empty):
    out = mixing.mix(docs, blocks=18, bucket_docs=10)
    rows = out.orderBy("slot", "pos").collect()
    assert len(rows) == docs.count() and len({(r["slot"], r["pos"]) for r in rows}) == len(rows)
    # against a plain version: documents by bucket and hash within their source, blocks, slots by plain earliest deadline first
    own = docs.select("doc_id", "text", F.coalesce("source", F.lit(mixing.NULL)).alias("s"), F.xxhash64("doc_id", F.xxhash64(*[c for c in docs.columns if c != "block"]), F.lit(8)).alias("o")).collect()
    by = {}
    for r in sorted(own, key=lambda r: ((r["o"] % 2**64 >> 20) % -(-len(own) // 10), r["o"], r["doc_id"] or 0)):
        by.setdefault(r["s"], []).append(r["doc_id"])
    size = -(-len(own) // 18)
    slots = plain_schedule({k: -(-len(v) // size) for k, v in by.items()}, mixing.temperature({k: len(v) for k, v in by.items()}, 0.5))
    want = Counter((d, k, n // size, slots[k, n // size][0], n % size, slots[k, n // size][1], round(slots[k, n // size][2], 12)) for k, v in by.items() for n, d in enumerate(v))
    assert Counter((r["doc_id"], r["stream"], r["block"], r["slot"], r["pos"], r["phase"], round(r["target"], 12)) for r in rows) == want
    assert mixing.mix(empty).count() == 0 and mixing.mix(docs, {"a": 1.0, None: 1.0}).where("stream = 'b' AND slot < 10").count() == 0


@pytest.mark.parametrize("kind", ["thirds", "tiny", "many"])
def test_mixing_keeps_to_the_weights(kind):
    rng = random.Random(kind)
    weights = {"thirds": {"a": 1 / 3, "b": 2 / 3}, "tiny": {"a": 0.6666, "b": 0.33325, "c": 0.00015}, "many": {f"s{i}": rng.random() ** 4 + 1e-6 for i in range(1000)}}[kind]
    total = sum(Fraction(w) for w in weights.values())
    blocks = {k: int(100_000 * Fraction(w) / total) + 2 for k, w in weights.items()}
    plan = list(mixing.schedule(blocks, weights))
    assert [slot for _, _, slot, _, _ in plan] == list(range(sum(blocks.values()))) and {k: n for k, n in Counter(p[0] for p in plan).items()} == blocks
    end = next((i for i, p in enumerate(plan) if p[3] > 0), len(plan))
    assert end > 50_000
    w, n = {k: Fraction(x) / total for k, x in weights.items()}, dict.fromkeys(weights, 0)
    for k, block, slot, _, target in plan[:end]:
        assert n[k] == block and w[k] * slot - n[k] < 1 and n[k] + 1 - w[k] * (slot + 1) < 1 and abs(target - weights[k] / float(total)) < 1e-12
        n[k] += 1
    assert all(abs(w[k] * end - n[k]) < 1 for k in w)


def test_quality(spark, docs, empty):
    rng = random.Random(6)
    rows = [(i, random_text(rng, 40) if i % 2 else "!! ".join(random_text(rng, 40).upper().split())) for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(160)] + [(None, 1, 0), (5, 0, 0), (6, None, 0)], "doc_id long, quality int, toxic int")
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["predicted"] for r in quality.classify(frame, labels).collect()}
    assert sum(got[i] == i % 2 for i in range(160, 200)) >= 39
    for l in (labels, labels.limit(0)):
        out = quality.classify(docs, l).collect()
        assert len(out) == docs.count() and all(0 <= r["score"] <= 1 for r in out)
    assert quality.classify(empty, labels).count() == 0 and quality.accept(docs, labels).columns == docs.columns


def test_language_model(docs, empty):
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    rows = [(r[0], words(r[1])) for r in make_rows()]
    train = Counter(w for d, t in rows if d is None or zlib.crc32(str(d).encode()) % 5 != 1 for w in [*t, None])
    n, v = sum(train.values()), len(train)
    want = sorted((str(d), len(t) + 1, sum(train[w] > 0 for w in [*t, None]), n, round(sum(math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*t, None]), 6)) for d, t in rows)
    out = mixture.score(docs, held).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out) == want
    assert all(r["score"] < 0 for r in out)
    assert mixture.score(empty, held).count() == 0


def test_bits_sum_to_one():
    """Probabilities of the 256 bytes after any context add up to one."""
    import numpy as np

    model = mixture.Mixer([np.zeros(1 << b, np.uint32) for b in mixture.TABLE_BITS])
    t = [0x61626364 << 8 | b for b in range(256)]
    rng = np.random.default_rng(0)
    model.tables[0][:] = 1 << 24 | mixture.coded(rng.integers(0, 50, 1 << 16)) << 12 | mixture.coded(rng.integers(0, 50, 1 << 16))
    assert abs(model.probability(np.array(t, np.uint64)).sum() - 1) < 1e-9


def test_scores_against_a_plain_scorer(spark):
    """Exact counts, one bit and one byte at a time."""
    import numpy as np
    import pyarrow as pa

    from statuta.llm.words import texts_of

    rng = random.Random(6)
    word = ["the", "theory", "of", "offers", "Offer", "é", "more"]
    texts = [" ".join(rng.choice(word) for _ in range(n)) for n in (300, 200, 90, 0, 1, 40)] + ["again and again " * 12]
    trained, (grams, bounds) = texts[:3], mixture.strings(texts_of(pa.array(texts, pa.large_string())))
    every, n = np.unique(grams[: bounds[3]], return_counts=True)
    model, _ = mixture.train(spark.createDataFrame([(0, bytearray(mixture.packed(every, n)))], "key long, data binary"))
    counts = Counter()
    lowered = [bytes(b + 32 if 65 <= b <= 90 else b for b in t.encode()) + b"\0" for t in texts]
    path = lambda byte, place: (256 | byte) >> (8 - place)
    past = lambda b, i, k: (b"\0" * k + b[:i])[-k:]
    for b in lowered[: len(trained)]:
        for i, byte in enumerate(b):
            for place in range(8):
                for k in mixture.ORDERS:
                    counts[k, past(b, i, k), path(byte, place), byte >> (7 - place) & 1] += 1
    for b, got in zip(lowered, model.log10(grams, bounds)):
        total, followed, run, tried, came = 0.0, {}, 0, [0] * 4, [0] * 4
        for i, byte in enumerate(b):
            p = 1.0
            for place in range(8):
                x, top, seen = [], 0, 0
                for k in mixture.ORDERS:
                    n0, n1 = (counts[k, past(b, i, k), path(byte, place), y] for y in (0, 1))
                    x.append(math.log((n1 + 0.02) / (n0 + 0.02)))
                    top, seen = (len(x), n0 + n1) if n0 + n1 else (top, seen)
                gate = place + 8 * (4 * top + sum(seen > y for y in (1.5, 3.5, 15.5)))
                odds = max(-11.5, min(11.5, sum(float(w) * y for w, y in zip(model.weights[gate], [*x, 0.3]))))
                at = (odds + 12) * 32 / 24
                low = min(int(at), 31)
                one = 0.5 / (1 + math.exp(-odds)) + 0.5 * (model.map[gate, low] * (low + 1 - at) + model.map[gate, low + 1] * (at - low))
                p *= max(one if byte >> (7 - place) & 1 else 1 - one, 1e-6)
            context = past(b, i, 5)
            right = i >= 5 and followed.get(context) == byte
            if i >= 5 and context in followed:
                g = min(run, 15) // 4
                share = 0.3 * (came[g] + 4 * (0.25, 0.6, 0.75, 0.9)[g]) / (tried[g] + 4)
                p = p * (1 - share) + share * right
                tried[g], came[g] = tried[g] + 1, came[g] + right
            followed[context] = byte
            run = run + 1 if right else 0
            total += math.log10(p)
        assert got == pytest.approx(total, rel=2e-3, abs=1e-3)


def test_scores_beat_the_base(spark):
    from .test_pipeline import DATA

    docs = spark.read.parquet(f"{DATA.replace('sf0.001', 'sf0.01')}/documents.parquet")
    r = mixture.score(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > r[1]


def test_frequent_contexts_keep_their_ratio(spark, monkeypatch):
    import numpy as np

    def bucket(grams, counts):
        return spark.createDataFrame([(0, bytearray(mixture.packed(np.array(grams, np.uint64), np.array(counts, np.uint64))))], "key long, data binary")

    # after "aaaaa" 2,000,000 times b, 30,000 times c: they differ in the last bit alone
    b, c = (int.from_bytes(b"aaaaa" + x, "big") for x in (b"b", b"c"))
    model, _ = mixture.train(bucket([b, c], [2_000_000, 30_000]))
    votes, _ = model.votes(mixture.contexts(np.array([b], np.uint64)), np.array([256 + 98 >> 1 | 128]), 7)
    assert abs(votes[:5, 0] - math.log(30_000 / 2_000_000)).max() < 0.01
    n = np.arange(10**6)
    assert (mixture._COUNT[mixture.coded(n[:80])] == n[:80]).all() and (abs(mixture._COUNT[mixture.coded(n)] - n) <= 0.003 * n + 0.01).all()
    counts = [10, 1000, 100_000]
    learned = [mixture.Mixer(model.tables) for _ in range(2)]
    for m, most in zip(learned, (10**6, 1000)):
        m.learn(np.array([b, c, c ^ 1 << 8], np.uint64), np.minimum(counts, most).astype(np.uint64))
    assert abs(learned[0].weights - learned[1].weights).max() > 1e-4
    # tables have at least two slots for each distinct context, as sampled
    monkeypatch.setattr(mixture, "TABLE_BITS", (16, 4, 4, 4, 4))
    monkeypatch.setattr(mixture, "SLICE_BITS", 4)
    grams = np.unique(np.random.default_rng(5).integers(0, 1 << 48, 60_000, np.uint64))
    sizes = mixture.table_sizes(bucket(grams, np.ones(len(grams))))
    for which, size in list(enumerate(sizes))[1:]:
        n = len({(int(g) >> 8 & (1 << 8 * mixture.ORDERS[which]) - 1, int(k)) for _, node, _ in mixture.bits(grams) for g, k in zip(grams, node)})
        assert sizes[0] == 16 and 1.6 * n < 1 << size < 5 * n


def test_neighbours(spark):
    rng = random.Random(9)
    vec = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(300)]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vec)] + [(300 + i, vec[0]) for i in range(9)]
    rows += [(400, None), (401, [0.0] * 8), (402, [1.0] * 7), (403, [float("nan")] * 8), (404, [None] + [1.0] * 7), (None, vec[1])]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, rank int")
    got = neighbours.nearest(frame, F.col("vec_id") % 50 == 0, shard_rows=80).collect()
    good = [(i, v) for i, v in rows if i is not None and i < 400]
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(x * x for x in b))
    hit = 0
    for q in range(0, 301, 50):
        best = sorted(((-round(cos(dict(good)[q], v), 12), i) for i, v in good if i != q))[:5]
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [r for r, *_ in own] == [1, 2, 3, 4, 5]
        hit += len({i for _, i, _ in own} & {i for _, i in best})
    assert hit >= 0.9 * 35 and {r["vec_id"] for r in got if r["query_id"] == 0} == {300, 301, 302, 303, 304}
    assert neighbours.nearest(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_neighbours_of_huge_and_tiny_vectors(spark):
    vec = [[1e200, 1e200], [1e200, 2e200], [1e-200, 0.0], [3.0, -1.0], [5e-324, 5e-324], [1.7e308, 1.7e308]]
    exact = [[1.0, 1.0], [1.0, 2.0], [1.0, 0.0], [3.0, -1.0], [1.0, 1.0], [1.0, 1.0]]
    frame = spark.createDataFrame([(50 * i, v) for i, v in enumerate(vec)], "vec_id long, embedding array<double>")
    cos = lambda a, b: (a[0] * b[0] + a[1] * b[1]) / math.hypot(*a) / math.hypot(*b)
    got = neighbours.nearest(frame, F.col("vec_id") >= 0).collect()
    assert len(got) == 30
    for r in got:
        assert r["score"] == pytest.approx(cos(exact[r["query_id"] // 50], exact[r["vec_id"] // 50]), abs=1e-12)


def test_recall_over_several_shards(spark):
    """Vectors without any cluster, in eight shards, against brute force."""
    import numpy as np

    v = np.random.default_rng(3).normal(size=(2000, 48))
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = neighbours.nearest(frame, F.col("vec_id") % 50 == 0, shard_rows=250).collect()
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = u[::50] @ u.T
    near[np.arange(40), np.arange(0, 2000, 50)] = -2
    best = np.argsort(-near, 1)[:, :5]
    assert len(got) == 200
    assert sum(r["vec_id"] in best[r["query_id"] // 50] for r in got) >= 0.95 * 200


def test_multiples_of_a_vector_tie(spark):
    """More multiples of the query than an answer or a beam holds: the smallest ids win, whatever the lengths."""
    rng = random.Random(12)
    base = [rng.randint(-999, 999) / 64 for _ in range(16)]  # multiples of these are exact
    rows = [(i, [rng.gauss(0, 1) for _ in range(16)]) for i in range(1, 300)] + [(0, base)] + [(950 + i, [x * (i + 0.5) for x in base]) for i in range(1, 51)]
    rows += [(2000 + i, [x + 1e-5 * rng.random() for x in base]) for i in range(120)]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, shard_rows=200, beam=16).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [951, 952, 953, 954, 955] and all(r["score"] == pytest.approx(1, abs=1e-15) for r in got)


def test_mixing_spreads_rows_without_an_id(spark):
    """Half of the rows have no id: each block of a source still takes rows of a few buckets only, none of most."""
    rows = [(None if i % 2 else i, "a", f"t{i}") for i in range(4000)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string")
    content = F.xxhash64(F.col("doc_id"), F.xxhash64("doc_id", "source", "text"), F.lit(8))
    sizes = [r[1] for r in frame.groupBy(F.pmod(F.shiftrightunsigned(content, 20), F.lit(40))).count().collect()]
    assert max(sizes) <= 3 * sorted(sizes)[len(sizes) // 2]
    mixed = mixing.mix(frame, bucket_docs=100)
    assert sorted(r["text"] for r in mixed.collect()) == sorted(t for *_, t in rows)
    assert mixed.groupBy("slot", "pos").count().where("count > 1").count() == 0


def test_passages_do_not_depend_on_neighbours():
    import numpy as np

    from statuta.llm import words as hashing

    rng = random.Random(14)
    texts = [random_text(rng, n).encode() for n in (60, 25, 24, 33, 90, 3, 51, 400)]

    def chosen(some):
        t = hashing.Texts(np.frombuffer(b"".join(some), np.uint8), np.cumsum([0, *map(len, some)]))
        found = paragraphs.passages(t, hashing.words(t), 25, 22, 8)
        return {(some[i], int(s - t.ends[i]), int(e - t.ends[i]), int(c)) for i, s, e, c in zip(*found)}

    alone = set().union(*(chosen([x]) for x in texts))
    assert chosen(texts) == alone == chosen(texts[::-1]) and len(alone) > 20


def test_meeting_rows_and_seen_classes():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(15)
    token, row = rng.integers(0, 300, 3000).astype(np.uint64), rng.integers(0, 200, 3000)
    token, row = np.concatenate([token, np.full(30, 400, np.uint64), np.arange(500, 900, dtype=np.uint64)]), np.concatenate([row, np.arange(30), np.arange(400)])
    size = (10 + row % 7).astype(np.int32)
    columns = {"token": token, "row": row.astype(np.int64), "size": size}
    met = jaccard._meet(pa.table({k: pa.array([v[:1000].tobytes(), v[1000:].tobytes()], pa.binary()) for k, v in columns.items()}), 75).to_pylist()
    held, pairs, groups = {}, set(), set()
    for t, r in zip(token.tolist(), row.tolist()):
        held.setdefault(t, set()).add(r)
    h = lambda r: int(jaccard.mix64(np.array([r], np.uint64))[0])
    for rows in held.values():
        lead = [min(rows, key=h)] if len(rows) > jaccard.SMALL else rows
        pairs |= {(a, b) for a in lead for b in rows if h(a) < h(b) and 100 * min(10 + a % 7, 10 + b % 7) >= 75 * max(10 + a % 7, 10 + b % 7)}
        groups |= {frozenset(rows)} if len(rows) > jaccard.SMALL else set()
    by = {}
    for r in met:
        by.setdefault(r["g"], []).append(r["a"])
    assert sorted((r["a"], r["b"]) for r in met if r["b"] is not None) == sorted(pairs)
    assert {frozenset(v) for k, v in by.items() if k is not None} == groups and all(len(v) == len(set(v)) for k, v in by.items() if k is not None)
    alone = {k: pa.array([v[-400:].tobytes()], pa.binary()) for k, v in columns.items()}
    assert jaccard._meet(pa.table(alone), 75).num_rows == 0
    seen = paragraphs.Seen(4)
    assert seen.fresh(np.array([0, 5, 0, -1, 21])).tolist() == [True, True, False, True, True]
    assert not seen.fresh(np.array([0, -1])).any() and seen.held.nbytes == 128


def test_small_open_groups_stay_apart(spark, tmp_path, monkeypatch):
    """Groups of twelve rows that form a chain: dealt one by one they cost a row each, as one cluster a row for each block of it."""
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    partners = jaccard._partners(75)

    def counted(table):
        (tmp_path / f"{table.column('g')[0].as_py()}-{table.column('i')[0].as_py()}-{table.column('j')[0].as_py()}").write_text(str(table.num_rows))
        return partners(table)

    monkeypatch.setattr(jaccard, "_partners", lambda hundredths: counted)
    sets = {c: np.sort(jaccard.mix64(np.arange(40, dtype=np.uint64) + np.uint64(1000 * c))) for c in range(1, 551)}
    sets[30] = np.sort(np.append(sets[25][:38], sets[30][:2]))  # the only link, within the third group
    chain = [(10 * g + k, 10 * g, g + 1, 40) for g in range(54) for k in range(1, 13)]
    met = spark.createDataFrame([(a, None, g, n) for a, _, g, n in chain], "a long, b long, g long, n int")
    classes = spark.createDataFrame([(c, 40, bytearray(jaccard.histogram(s))) for c, s in sets.items()], "c long, n int, hist binary")
    table = spark.createDataFrame([(c, s.tobytes()) for c, s in sets.items()], "c long, set binary")
    roots = jaccard.resolve(met, classes, lambda places: places.join(table, "c").select("p", "q", "c", "first", "set"), 75)
    assert {r["node"]: r["root"] for r in roots.collect()} == {25: 25, 30: 25}
    assert sum(int(p.read_text()) for p in tmp_path.iterdir()) == len(chain)


def test_open_group_of_rows_with_and_without_histogram(spark):
    """A line (no histogram) and a stretch that meet in a large group only are compared, too."""
    own = lambda c: np.sort(jaccard.mix64(np.arange(36, dtype=np.uint64) + np.uint64(1000 * c)))
    sets = {c: own(c) for c in range(1, 11)}
    sets[2] = np.sort(np.append(sets[1][:34], sets[2][:2]))
    met = spark.createDataFrame([(c, None, 7, 36) for c in sets], "a long, b long, g long, n int")
    classes = spark.createDataFrame([(c, 36, None if c % 2 else bytearray(jaccard.histogram(s))) for c, s in sets.items()], "c long, n int, hist binary")
    table = spark.createDataFrame([(c, s.tobytes()) for c, s in sets.items()], "c long, set binary")
    roots = jaccard.resolve(met, classes, lambda places: places.join(table, "c").select("p", "q", "c", "first", "set"), 75)
    assert {r["node"]: r["root"] for r in roots.collect()} == {1: 1, 2: 1}


def test_columns_foreseen_by_their_words(spark):
    """Where all slots are full of other shingles, words tell which shingle is rare."""
    level = np.zeros((1 << jaccard.SKETCH_BITS) + (1 << jaccard.WORD_BITS), np.uint8)
    t = jaccard.Texts(np.frombuffer(b"of of of of of rare one two three four", np.uint8), np.array([0, 38]))
    level[jaccard._word_slot(jaccard.words(t)[0][:5])] = 100
    (s, columns), = jaccard.columns_of(t, 5, level, 400)
    found, _ = jaccard.shingles(jaccard.words(t)[0], jaccard.words(t)[3])
    tail = columns & np.uint64((1 << 54) - 1)
    assert len(s) == len(columns) == 6 and tail[-1] == found[0] >> np.uint64(10) and tail[0] == found[5] >> np.uint64(10)
    level[jaccard._slot(found[5:6])] = 120  # what stands out of the slots' load goes last
    assert (list(jaccard.columns_of(t, 5, level, 400))[0][1] & np.uint64((1 << 54) - 1))[-1] == found[5] >> np.uint64(10)


def test_components_in_steps(spark, monkeypatch):
    rng = random.Random(3)
    links = spark.createDataFrame([(rng.randint(0, 200), rng.randint(0, 200)) for _ in range(130)] + [(i, i + 1) for i in range(1000, 1030)], "a long, b long")
    few = {tuple(r) for r in components.components(links).collect()}
    monkeypatch.setattr(components, "FEW", 0)
    assert {tuple(r) for r in components.components(links).collect()} == few
