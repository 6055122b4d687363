"""Ranked lexical search, spelling variants and HTML extraction: edge cases, and every result against a plain version."""

import html
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from statuta.llm import lexical, queries, variants, wrappers
from tests.conftest import DATA
from tests.test_queries import compare

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
DOCS = "doc_id long, text string, h string, term int, word string, n long, items int, bits string, host string"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", 1, "w", 2, 3, "b", "h") for d, t in rows], DOCS)


# ---- ranked lexical search


def terms(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))


def plain_rank(docs, items, k):
    own = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    total, df = sum(c.total() for _, c in own), Counter(w for _, c in own for w in c)
    out = []
    for item, text in sorted({i for i in items if i[1] is not None}, key=str):
        best = []
        for d, c in own:
            m = 50 + (50 * c.total() * len(own)) // total
            s = sum(math.floor(1000 * math.log((2 * len(own) + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * c[w]) // (1000 * c[w] + 20 * m)) for w in set(terms(text)) & set(c))
            if s > 0:
                best.append((-s, d is None, d))
        out += [(item, r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(best, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


def search_rows():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)] + ["Straße", "é2", "İ"]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 60)))) for i in range(200)]
    rows += [(300, "w1 " * 5000 + " ".join(f"u{i}" for i in range(3000))), (301, None), (302, ""), (303, " .,-\n"), (304, "W1,w2;w3"), (304, "W1,w2;w3"), (None, "w1 w2 w5"), (305, rows[7][1]), (306, rows[7][1])]
    items = [(1, "w1 w2 w3 w3"), (2, rows[7][1]), (3, "straße é2 nowhere"), (4, ""), (5, None), (6, "nowhere"), (7, "W1"), (7, "W1"), (None, "w5 w6 İ")]
    return rows, items


@pytest.mark.parametrize("k, seeds, block_items", [(5, 5, 100), (50, 100, 3), (500, 2, 100)])
def test_lexical_search(spark, monkeypatch, k, seeds, block_items):
    monkeypatch.setattr(lexical, "BLOCK", 1 << 14)  # many small blocks
    rows, items = search_rows()
    got = lexical.rank(frame(spark, rows).repartition(3), spark.createDataFrame(items, "item_id long, text string"), k=k, seeds=seeds, block_items=block_items)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_rank(rows, items, k)


def test_lexical_search_of_nothing(spark):
    none, some = frame(spark, []), frame(spark, [(1, "a b"), (2, None)])
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.rank(none, items).count() == 0 and lexical.rank(some, items.limit(0)).count() == 0
    assert lexical.rank(frame(spark, [(1, " "), (2, None)]), items).count() == 0


def test_few_documents_are_scored(spark, monkeypatch):
    """The bounds leave out most documents, and none that ranks; the document itself is always among the possible."""
    seen = []
    possible = lexical.possible
    monkeypatch.setattr(lexical, "possible", lambda *a: seen.append(possible(*a)) or seen[-1])
    rng = random.Random(6)
    rows = [(i, " ".join(f"w{min(int(rng.paretovariate(0.6)), 5000)}" for _ in range(120))) for i in range(1500)]
    items = [(i, rows[i * 10][1][:150]) for i in range(20)]
    got = lexical.rank(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"), k=3, seeds=10)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_rank(rows, items, 3)
    pairs = seen[0].select(F.explode("items")).count()
    assert pairs < 0.1 * len(rows) * len(items)


def test_lexical_search_matches_sql(spark):
    compare(spark, queries.QUERIES["op11_lexical_search"](spark, DATA), queries.ORACLE["op11_lexical_search"])


# ---- spelling variants


def plain_variants(rows, times=10):
    n = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 31 == 0 else w] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    gaps = defaultdict(set)
    for w in n:
        for i in range(len(w)):
            gaps[w[:i], w[i + 1 :]].add(w)
    near = defaultdict(set)
    for (a, b), own in gaps.items():
        for w in own:
            near[w] |= own - {w}
            if a + b in n:
                near[w].add(a + b)
                near[a + b].add(w)
    best = {w: min(x, key=lambda y: (-n[y], y)) for w, x in near.items() if x}
    form = {w: f for w, f in best.items() if n[f] >= times * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return sorted(((w, form.get(w), root(w), c, len(near[w]), n[form[w]] if w in form else None) for w, c in n.items()), key=str)


def variant_rows():
    rng = random.Random(5)
    base = ["regulation", "Contract", "straßenbau", "Überzeugung", "aaaaaaaa", "consumer", "consumed", "x" * 3000]
    rows = []
    for i in range(400):
        text = []
        for w in rng.choices(base, k=30):
            if rng.random() < 0.2:
                p = rng.randrange(len(w))
                w = rng.choice([w[:p] + w[p + 1 :], w[:p] + rng.choice("abcé") + w[p:], w[:p] + rng.choice("abcé") + w[p + 1 :]])
            text.append(w)
        rows.append((i, " ".join(text)))
    return rows + [(500, None), (501, ""), (502, "12 34"), (None, "regulations regulations"), (1, rows[1][1]), (1, rows[1][1]), (503, "œuvres œuvres consum×r consum×r")]


@pytest.mark.parametrize("shard_words", [20_000, 40])
def test_variants(spark, shard_words):
    rows = variant_rows()
    got = variants.group(frame(spark, rows).repartition(4), shard_words=shard_words)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_variants(rows)
    assert variants.group(frame(spark, [])).count() == 0 and variants.group(frame(spark, [(1, None), (2, "short words")])).count() == 0


def test_variants_of_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in queries.op12_spelling_variants(spark, DATA).collect()), key=str) == plain_variants(rows)


def test_forms_lead_to_roots(spark):
    kept = [(i, w) for i, w in enumerate(["abcdefgh"] * 700 + ["abcdefghi"] * 50 + ["abcdefghij"] * 20) if zlib.crc32(f"{i}:{w}".encode()) % 31]
    rows = [r for r in kept if len(r[1]) < 10] + [r for r in kept if len(r[1]) == 10][:3]
    assert [tuple(r)[:3] for r in variants.group(frame(spark, rows)).orderBy("word").collect()] == [("abcdefgh", None, "abcdefgh"), ("abcdefghi", "abcdefgh", "abcdefgh"), ("abcdefghij", "abcdefghi", "abcdefgh")]


# ---- HTML extraction


def paragraph(i, j):
    return f"Paragraph {j} of page {i} is long enough to be text, &amp; has <a href=x>a link</a>\n and more&nbsp;words."


def board(i):
    """No element says what is text: constant notices, menus of links, and what varies tell it."""
    return (
        f"<html><body><div class=t1><a href=/>Home</a> <a href=/a>About</a> <a href=/b>Contact us</a></div><div class=x1>We keep small files here.</div>"
        f"<div class=w><div class=c1><h1>Title {i}</h1>{''.join('<p>' + paragraph(i, j) for j in range(i + 2))}{f'<ul><li>point {i}<li>another {i}</ul>' if i % 2 else ''}<div class=x2>Follow us for more</div></div>"
        f"<div class=r><ul><li><a href=1>Other {i}</a></li><li><a href=2>Another {i}</a><li><a>Third {i}</a></ul></div></div><div class=comments><p>Nice {i}</p></div><p>Imprint</p>"
    )


def board_text(i):
    return "\n\n".join([f"Title {i}", *(" ".join(html.unescape(re.sub("<[^>]*>", "", paragraph(i, j))).split()) for j in range(i + 2)), *([f"point {i}", f"another {i}"] if i % 2 else [])])


ODD = """<!doctype html><html><head><title>t</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1><nav><a>m</a></nav></header><main><article class="post-7"><header><h2>Head &lt;1&gt;</h2></header>
<p>Text&nbsp;one &amp; two &#8212;<br>line<script>if(a<b) "</p>"</script> more <b>bold</p><!-- <p>no</p> --><aside>aside</aside><div class="ad-slot ads">buy</div><figure><img src=x><figcaption>Cap</figcaption></figure>
<table><tr><td>c1<td>c2</table><blockquote>Quote <p>inner</p> tail</blockquote><form><label>Mail</label><button>Go</button></form><p hidden>no</p><span class="share">no</span><noscript>no</noscript><footer>Tags</footer></article>
<section id="comments"><article class="comment"><p>reader says</p></article></section></main><footer>f</footer>"""


def test_wrappers(spark):
    rows = [(i, f"http://u@B.example:80/{i}", board(i)) for i in range(8)] + [(20, "https://c.example", ODD), (21, None, ODD), (22, "no host", board(3)), (23, "https://c.example/x", None), (24, "https://c.example/y", ""), (25, "https://d.example", "plain <b>text</b> only"), (26, "https://d.example", "<nav>menu</nav>")]
    rows += [(2, rows[2][1], rows[2][2]), (None, rows[3][1], rows[3][2])]
    got = sorted(((r["page_id"], r["text"], r["n_chars"]) for r in wrappers.extract(spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, wrapper string, host string").repartition(5)).collect()), key=str)
    odd = "Head <1>\n\nText one & two — line more bold\n\nCap\n\nc1\n\nc2\n\nQuote\n\ninner\n\ntail"
    want = [(i, board_text(i)) for i in range(8)] + [(20, odd), (21, odd), (23, ""), (24, ""), (25, "plain text only"), (26, ""), (2, board_text(2)), (None, board_text(3))]
    # a page without a host has only itself to tell what is text: its constant lines stay
    alone = [r for r in got if r[0] == 22]
    assert [r for r in got if r[0] != 22] == sorted(((i, t, len(t)) for i, t in want), key=str)
    assert len(alone) == 1 and all(p in alone[0][1] for p in board_text(3).split("\n\n")) and "Other 3" not in alone[0][1]
    assert wrappers.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


LAYOUTS = {
    "content in content": ("<div id=content><div class='post-content'><h1>T {i}</h1><p>A long text of page {i}, with all that it says and more.</p></div><div class=z9>Also {i} here</div></div>", "T {i}\n\nA long text of page {i}, with all that it says and more."),
    "heading outside": ("<div id=main><h1>T {i}</h1><div class='entry-content'><p>A long text of page {i}, with all that it says and more.</p></div></div>", "T {i}\n\nA long text of page {i}, with all that it says and more."),
    "comments and boxes": ("<main><h1>T {i}</h1><p>Text {i} <span class=share-box>share</span> goes on.</p><div class='related-posts'>no {i}</div><ins class=adsbygoogle>no</ins><div class=newsletterSignup>no {i}</div><ol class=commentlist><li>no {i}</ol></main><div id=cookie-banner>no</div>", "T {i}\n\nText {i} goes on."),
    "menu in the article": ("<article><ul><li><a href=1>One {i}</a><li><a href=2>Two {i}</a><li><a href=3>Three {i}</a></ul><h2>T {i}</h2><ol><li>first {i}<li>second {i}</ol></article>", "T {i}\n\nfirst {i}\n\nsecond {i}"),
    "two articles": ("<div><article><h2>A {i}</h2><p>text {i}</article><article><h2>B {i}</h2><p>text of {i}</article></div><aside>no</aside>", "A {i}\n\ntext {i}\n\nB {i}\n\ntext of {i}"),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts(name):
    page, want = LAYOUTS[name]
    merger = wrappers.Merger(4)
    pages = ["<header>Site<nav>a</nav></header>" + page.replace("{i}", str(i)) + "<footer>f</footer>" for i in range(6)]
    for i, p in enumerate(pages):
        merger.add("h", wrappers.expression(wrappers.Page(p).root.kids), 1, [i])
    ((_, items, n, bodies),) = merger.results()
    wrapper = wrappers._loaded(wrappers._bare(wrappers.labelled(items, len(bodies), n)))
    for i, p in enumerate(pages):
        assert wrappers.text_of(p, wrapper) == wrappers.text_of(p, None) == want.replace("{i}", str(i))


def test_merging_in_groups_gives_the_same_texts(spark):
    rows = [(i, "http://h.example/", board(i)) for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(10)
    own = pages.select("page_id", "html", F.lit("h").alias("host"))
    one = wrappers.infer(own, at_once=3).collect()
    assert len(one) == 1
    import json

    wrapper = wrappers._loaded(json.loads(one[0]["wrapper"]))
    assert [wrappers.text_of(board(i), wrapper) for i in range(40)] == [board_text(i) for i in range(40)]


def test_pages_of_the_tables(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    for r in queries.op13_html_extraction(spark, DATA).collect():
        article = re.search("<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:p|h1)>", article))
        assert r["text"] == "\n\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


@pytest.mark.parametrize("source", ["<" * 100_000, "<div>" * 20_000 + "x", '<a x="' * 20_000, "<!--" * 20_000, "<p>" * 20_000 + "x", "<![foo[" * 1000 + "x", "&amp" * 20_000, "<ul><li>" * 5000 + "x", "<a><b>" * 5000], ids=range(9))
def test_broken_pages_are_read_in_time(source):
    import time

    began = time.time()
    wrappers.text_of(source, None)
    assert time.time() - began < 10
