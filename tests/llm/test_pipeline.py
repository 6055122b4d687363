"""The pipeline's rows against a plain version of each stage."""

import random
import re

import corpus_pipeline
from statuta.llm import queries

from ..conftest import DATA
from .test_edges import groups, shingles

# the base patterns as the contract states them
PATTERNS = {"EMAIL": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "IP": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "CARD": r"[0-9]([\x20-]?[0-9])+", "PHONE": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(n - 9 * (n > 9) for n in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits)))) % 10 == 0


def redacted(text):
    found = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "EMAIL" or kind == "IP" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "CARD" and 12 <= len(digits) <= 19 and luhn(digits) or kind == "PHONE" and 9 <= len(digits) <= 15:
                found.append((m.start(), k, m.end(), kind))
    out, at = "", 0
    for s, _, e, kind in sorted(found):
        if s >= at:
            out += text[at:s] + f"[{kind}]"
        at = max(at, e)
    return out + text[at:]


def test_pipeline(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    good = sorted(r["doc_id"] for r in queries.QUERIES["op3_quality_classifier"](spark, DATA).where("predicted = 1").collect())
    sets = [shingles(docs[i]["text"]) for i in good]
    roots = groups(good, lambda i, j: bool(sets[i]) and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]))
    kept = [(good[i], sets[i]) for i, r in enumerate(roots) if r == i]
    items = [s for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect() if (s := shingles(r["text"]))]
    clean = [i for i, s in kept if not any(100 * len(q & s) >= 75 * len(q) for q in items)]
    want = {i: redacted(docs[i]["text"]) for i in clean}
    out = corpus_pipeline.run(spark, DATA).collect()
    assert {r["doc_id"]: r["text"] for r in out} == want
    assert len(out) == len(want) and all(r["n_chars"] == len(r["text"]) for r in out)
    assert sorted(r["slot"] for r in out)[0] == 0 and len({(r["slot"], r["pos"]) for r in out}) == len(out)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_classifier", "ngram_jaccard_join", "benchmark_decontamination", "personal_data", "source_mixing"]


def test_stages_on_awkward_rows(spark, tmp_path):
    """Nulls, repeated rows, empty texts and columns that clash with those that stages add; then empty tables."""
    rng = random.Random(2)
    base = " ".join(f"w{rng.randint(0, 300)}" for _ in range(80))
    item = " ".join(f"q{rng.randint(0, 300)}" for _ in range(40))
    rows = [(1, base), (2, base + " more"), (None, base + " other"), (None, "ask me at 10.1.2.3"), (None, "ask me at 10.1.2.3"), (3, "ask me at 10.1.2.3"), (4, None), (5, ""), (6, "x " + item), (None, "y " + item), (7, "alone here"), (7, "alone here"), (7, "other text")]
    names = "doc_id long, text string, lang string, source string, n_chars long, h string, spans string, block int, slot int, `_d` int, root int, `_row` int"
    data = [(d, t, "en", ["a", None][k % 2], None if t is None else len(t), "h", "s", 7, 8, 9, 5, k) for k, (d, t) in enumerate(rows)]
    for name, frame in {"documents": spark.createDataFrame(data, names), "labels": spark.createDataFrame([(1, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int"), "benchmark": spark.createDataFrame([(1, item), (2, None)], "item_id long, text string")}.items():
        frame.write.parquet(f"{tmp_path}/some/{name}.parquet")
        frame.limit(0).write.parquet(f"{tmp_path}/none/{name}.parquet")
    sf_dir = f"{tmp_path}/some"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    plain = {r["_row"]: r for r in docs.collect()}
    own = lambda frame: {r["_row"] for r in frame.collect()}
    accepted = stage["quality_classifier"](spark, docs, sf_dir)
    assert accepted.columns == docs.columns and own(accepted) == set(plain)
    kept = stage["ngram_jaccard_join"](spark, docs, sf_dir)
    assert kept.columns == docs.columns and all(r == plain[r["_row"]] for r in kept.collect())
    # near copies leave document 1, copies one row of the smallest id, rows of one id and text one row; texts without words stay
    ids = sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect())
    assert ids == sorted([(1, base), (3, "ask me at 10.1.2.3"), (4, ""), (5, ""), (6, "x " + item), (7, "alone here"), (7, "other text")])
    clean = stage["benchmark_decontamination"](spark, docs, sf_dir)
    assert clean.columns == docs.columns and own(clean) == {k for k, (_, t) in enumerate(rows) if item not in (t or "")}
    redacted_rows = {r["_row"]: r for r in stage["personal_data"](spark, docs, sf_dir).collect()}
    assert {k: r["text"] for k, r in redacted_rows.items()} == {k: t and t.replace("10.1.2.3", "[IP]") for k, (_, t) in enumerate(rows)}
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) and r["h"] == "h" and r["_d"] == 9 for r in redacted_rows.values())
    mixed = stage["source_mixing"](spark, docs, sf_dir)
    assert own(mixed) == set(plain) and all(r["text"] == plain[r["_row"]]["text"] for r in mixed.collect()) and mixed.columns.count("slot") == 1
    assert corpus_pipeline.run(spark, sf_dir).count() == 6
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_queries_are_registered():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 14)]
    assert set(queries.ORACLE) <= set(queries.QUERIES)


def test_sql_agrees(spark):
    from ..test_queries import compare

    for name, sql in queries.ORACLE.items():
        compare(spark, queries.QUERIES[name](spark, DATA), sql)
