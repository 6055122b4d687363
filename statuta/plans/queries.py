"""The engine's queries over the driver's tables, and their SQL equivalents.

The tables hold no Korean text and no board pages, so records of those shapes are derived from them row by row, by
expressions that both engines read alike (``DERIVED``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statuta.checkpoints import new_folder
from statuta.functions import html, json_, rules, text
from statuta.operators import builders, records, walk
from statuta.sources import boards, decode, paged
from statuta.streaming import incremental

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
W = text.WHITE
#: Columns of a decision list and of legal texts, from a whole document.
DERIVED = {
    "page": "CAST(floor(doc_id / 10.0) AS BIGINT)",
    "pos": "doc_id % 10",
    "case_no": "CASE WHEN doc_id % 7 = 0 THEN '' ELSE concat('제', doc_id % 50, '호 ') END",
    "decision_no": "CASE WHEN doc_id % 5 = 0 THEN '' ELSE concat(' 의결 ', doc_id % 40) END",
    "title": "CASE WHEN doc_id % 35 = 0 THEN '' ELSE replace(text, chr(10), ' ') END",
    "first_cell": "CASE WHEN doc_id % 13 = 0 THEN concat('조회된 데이터가 없습니다 ', doc_id) ELSE CAST(doc_id AS VARCHAR(20)) END",
    "legal": "concat('의결서 ', doc_id, chr(10), '피심인의 약관 제', doc_id % 20 + 1, '조 (', lang, ')는 ', text, chr(10), ' 2. ', lang, chr(10), CASE WHEN doc_id % 2 = 0 THEN '3. ' ELSE '- ' END, source, chr(10), '고객에게 부당하게 불리한 조항으로서 상당한 이유 없이 ', source, ' 불리한 조항. 약관규제법 제', doc_id % 20, '조 제', doc_id % 4, '항 제1호, 국가배상법 제', doc_id % 9, '조, 민법  제', doc_id % 700, '조 제2항', chr(10), '시정내용', chr(10), text, chr(10), CASE WHEN doc_id % 3 = 0 THEN chr(10) ELSE '' END, '4. 삭제하여야 한다 ', source)",
}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", *[F.expr(DERIVED[n]).alias(n) for n in names])


def d(*names: str) -> str:
    return "(SELECT doc_id, " + ", ".join(f"{DERIVED[n]} AS {n}" for n in names) + " FROM documents)"


def norm(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '{W}+', ' ', 'g'), '^ | $', '', 'g')"


def strip(c: str) -> str:
    return rf"regexp_replace({c}, '^{W}+|{W}+\z', '', 'g')"


def safe(c: str, default: str = "'unknown'") -> str:
    return rf"""coalesce(nullif(substr(regexp_replace(regexp_replace(regexp_replace({c}, '[\\/:*?"<>|]', '_', 'g'), '{W}+', '_', 'g'), '^[._]+|[._]+\z', '', 'g'), 1, 140), ''), {default})"""


KEY = f"concat_ws(' | ', nullif({norm('case_no')}, ''), nullif({norm('decision_no')}, ''), nullif(title, ''))"


def _key():
    return text.composite_key(text.normalize(F.col("case_no")), text.normalize(F.col("decision_no")), F.col("title"))


@query(f"SELECT doc_id, sha256({norm('text')}) AS digest, CAST(length({strip('text')}) AS BIGINT) AS stripped FROM documents")
def normalize_text(spark, sf_dir):
    """X1, X2."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.normalize(t), 256).alias("digest"), F.length(text.strip(t)).cast("long").alias("stripped"))


@query(f"""SELECT page_id, sha256({norm("regexp_replace(html, '<[^>]+>', '', 'g')")}) AS digest FROM pages""")
def tag_strip(spark, sf_dir):
    """X9."""
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(text.strip_tags(F.col("html")), 256).alias("digest"))


_NAME = """concat(CASE WHEN p_partkey % 11 = 0 THEN '...' ELSE p_name END, CASE WHEN p_partkey % 11 = 0 THEN '' ELSE concat(' /: "', p_type, '"?  ', CASE WHEN p_partkey % 5 = 0 THEN repeat(p_brand, 20) ELSE '._' END) END)"""


@query(f"SELECT p_partkey, {safe(_NAME)} AS name FROM part")
def safe_filename(spark, sf_dir):
    """X4, O3."""
    return table(spark, sf_dir, "part").select("p_partkey", text.safe_name(F.expr(_NAME)).alias("name"))


@query(f"""SELECT doc_id, {safe(f"coalesce(nullif(concat_ws(' | ', nullif({strip('case_no')}, ''), nullif({strip('decision_no')}, ''), nullif({strip('title')}, '')), ''), concat('case_', doc_id))", "concat('case_', doc_id)")} AS name FROM {d('case_no', 'decision_no', 'title')}""")
def case_identifier(spark, sf_dir):
    """X5, X3, P10."""
    rows = derived(spark, sf_dir, "case_no", "decision_no", "title")
    return rows.select("doc_id", text.case_identifier(F.col("case_no"), F.col("decision_no"), F.col("title"), F.col("doc_id")).alias("name"))


@query(f"SELECT doc_id, {KEY} AS dedup_key FROM {d('case_no', 'decision_no', 'title')}")
def composite_key(spark, sf_dir):
    """X3."""
    return derived(spark, sf_dir, "case_no", "decision_no", "title").select("doc_id", _key().alias("dedup_key"))


@query(f"""SELECT dedup_key, arg_min(doc_id, page * 1000000000 + doc_id) AS doc_id, min(page) AS lowest_page, min(doc_id) AS first_seen
FROM (SELECT doc_id, {norm('text')} AS k, sha256({norm('text')}) AS dedup_key, (doc_id * 7) % 100 AS page FROM documents) WHERE k <> '' GROUP BY dedup_key""")
def dedup_keep_lowest_page(spark, sf_dir):
    """A4, F8: documents of equal normalised text, the one of lowest page stays."""
    docs = table(spark, sf_dir, "documents").select("doc_id", text.normalize(F.col("text")).alias("k"), ((F.col("doc_id") * 7) % 100).alias("page"))
    key = F.when(F.col("k") != "", F.sha2("k", 256))
    best = records.dedup_lowest_page(docs.withColumn("k", key), F.col("k"), order=["doc_id"])
    return best.select("dedup_key", "doc_id", F.col("page").alias("lowest_page"), F.col("first_place.doc_id").alias("first_seen"))


@query(f"SELECT count(*) AS n_before, count(DISTINCT nullif(k, '')) AS n_after, count(*) - count(DISTINCT nullif(k, '')) AS n_removed FROM (SELECT {norm('text')} AS k FROM documents)")
def dedup_report(spark, sf_dir):
    """A7."""
    return records.dedup_report(table(spark, sf_dir, "documents"), text.normalize(F.col("text")))


_SIGNATURES = f"SELECT source, page, count(*) AS n, concat_ws('||', substr(arg_min(t, doc_id), 1, 50), substr(arg_max(t, doc_id), 1, 50), CAST(count(*) AS VARCHAR)) AS signature FROM (SELECT source, CAST(floor(doc_id / 200.0) AS BIGINT) AS page, doc_id, {norm('text')} AS t FROM documents) GROUP BY source, page"


def _board(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", F.floor(F.col("doc_id") / 200.0).cast("long").alias("page"), F.col("doc_id").alias("pos"), text.normalize(F.col("text")).alias("t"))
    return walk.signatures(docs, ["source"], "t")


@query(_SIGNATURES)
def page_signature(spark, sf_dir):
    """Boards are sources, pages hold their documents of 200 ids."""
    return _board(spark, sf_dir)


_REPEATED = "CASE WHEN page % 17 = 11 THEN 'again' WHEN page % 17 = 12 THEN 'again' ELSE signature END"


@query(f"""WITH s AS (SELECT source, page, n, {_REPEATED} AS signature FROM ({_SIGNATURES})), f AS (SELECT *, signature = lag(signature, 1, '') OVER (PARTITION BY source ORDER BY page) AS rep FROM s WHERE page <= 500)
SELECT source, page, n, signature FROM (SELECT *, sum(CAST(rep AS INT)) OVER (PARTITION BY source ORDER BY page ROWS UNBOUNDED PRECEDING) AS c FROM f) WHERE c = 0""")
def page_walk_stop(spark, sf_dir):
    """A walk ends before the first page that repeats its predecessor."""
    return walk.until_repeat(_board(spark, sf_dir).withColumn("signature", F.expr(_REPEATED)), ["source"], most=500)


@query(f"""WITH p AS (SELECT source, page, CASE WHEN page % 23 = 20 THEN 0 ELSE n END AS n, 10 AS rows, 150 + 10 * (ascii(substr(source, 4, 1)) % 7) AS total FROM ({_SIGNATURES})),
a AS (SELECT *, sum(CASE WHEN n = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY page ROWS UNBOUNDED PRECEDING) AS empty FROM p),
b AS (SELECT *, coalesce(sum(CASE WHEN page * rows >= total THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reached FROM a WHERE empty = 0)
SELECT source, page, CAST(n AS BIGINT) AS n FROM b WHERE reached = 0""")
def page_walk_count_stop(spark, sf_dir):
    """W5."""
    pages = _board(spark, sf_dir).selectExpr("source", "page", "CASE WHEN page % 23 = 20 THEN 0 ELSE n END AS n", "10 AS rows", "150 + 10 * (ascii(substr(source, 4, 1)) % 7) AS total")
    return walk.until_count(pages, ["source"]).select("source", "page", "n")


@query(f"""SELECT doc_id, source FROM (SELECT *, max(CAST(contains(first_cell, '데이터') OR contains(first_cell, '없습니다') AS INT)) OVER (PARTITION BY source, page ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS hit
FROM (SELECT doc_id, source, CAST(floor(doc_id / 200.0) AS BIGINT) AS page, {DERIVED['first_cell']} AS first_cell FROM documents) WHERE 3 + doc_id % 3 >= 4) WHERE hit = 0""")
def sentinel_cut(spark, sf_dir):
    """F1, F2, W6."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.floor(F.col("doc_id") / 200.0).cast("long").alias("page"), F.col("doc_id").alias("pos"), F.expr(DERIVED["first_cell"]).alias("first_cell"))
    rows = docs.withColumn("cells", F.concat(F.array("first_cell"), F.array_repeat(F.lit("x"), (2 + F.col("doc_id") % 3).cast("int"))))
    return walk.until_sentinel(rows, ["source"]).select("doc_id", "source")


@query(f"SELECT source, page, n, CAST(sum(n) OVER (PARTITION BY source ORDER BY page ROWS UNBOUNDED PRECEDING) AS BIGINT) AS so_far FROM ({_SIGNATURES})")
def running_total(spark, sf_dir):
    """W4."""
    return walk.running_total(_board(spark, sf_dir).select("source", "page", "n"), ["source"])


@query("SELECT doc_id, row_number() OVER (PARTITION BY source, CAST(floor(doc_id / 200.0) AS BIGINT) ORDER BY doc_id) AS ordinal FROM documents")
def ordinals(spark, sf_dir):
    """W3, within a page."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.floor(F.col("doc_id") / 200.0).cast("long").alias("page"))
    return walk.ordinals(docs, ["source", "page"], ["doc_id"]).select("doc_id", "ordinal")


@query("""SELECT page, (row_number() OVER (PARTITION BY page ORDER BY doc_id) - 1) AS pos, id, name, (page + 1) * 10 >= 500 AS is_last FROM
(SELECT CASE WHEN CAST(floor(doc_id / 10.0) AS BIGINT) % 3 = 1 THEN 1000000000000 + doc_id ELSE CAST(floor(doc_id / 10.0) AS BIGINT) END AS page, doc_id, CASE WHEN doc_id % 9 <> 0 THEN concat('P', doc_id) WHEN doc_id % 2 = 0 THEN concat('M', doc_id) ELSE '' END AS id, CASE WHEN doc_id % 4 = 0 THEN '' ELSE lang END AS name FROM documents)
QUALIFY id <> ''""")
def list_envelope_explode(spark, sf_dir):
    """Envelopes of ten entries, and of one object for every third ten, as a service would send them; parsed back."""
    ten = F.floor(F.col("doc_id") / 10.0).cast("long")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.when(ten % 3 == 1, 1000000000000 + F.col("doc_id")).otherwise(ten).alias("page"))
    entry = F.struct(F.when(F.col("doc_id") % 9 == 0, "").otherwise(F.concat(F.lit("P"), "doc_id")).alias("판례일련번호"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("M"), "doc_id")).otherwise("").alias("ID"), F.when(F.col("doc_id") % 4 == 0, None).otherwise(F.col("lang")).alias("사건명"))
    pages = docs.withColumn("e", entry).groupBy("page").agg(F.sort_array(F.collect_list(F.struct("doc_id", "e"))).alias("e"))
    inner = F.when(F.col("page") >= 1000000000000, F.to_json(F.get("e", F.lit(0))["e"])).otherwise(F.to_json(F.transform("e", lambda x: x["e"])))
    body = F.concat(F.lit('{"PrecSearch":{"prec":'), inner, F.lit(',"totalCnt":"500","numOfRows":"10"}}'))
    sent = pages.select("page", body.alias("body"))
    total, rows = json_.counts(F.col("body"), json_.PRECEDENT)
    ends = sent.select("page", ((F.col("page") + 1) * rows >= total).alias("is_last"))
    return json_.list_entries(sent, json_.PRECEDENT).join(ends, "page").select("page", F.col("pos").cast("long").alias("pos"), "id", "name", "is_last")


@query(f"""WITH c AS (SELECT doc_id, ['번호', '사건명', '번호'] AS h, [first_cell, title, lang, source] AS cells, title FROM (SELECT doc_id, {DERIVED['first_cell']} AS first_cell, {DERIVED['title']} AS title, lang, source FROM documents)),
n AS (SELECT doc_id, CASE WHEN i <= 3 AND doc_id % 4 > 0 THEN h[i] ELSE concat('col_', i - 1) END AS name, cells[i] AS value, i FROM c, (SELECT unnest(range(1, 5)) AS i)),
l AS (SELECT doc_id, name, arg_max(value, i) AS value FROM n GROUP BY doc_id, name)
SELECT doc_id, name, value FROM l WHERE doc_id % 4 > 0 UNION ALL SELECT doc_id, name, value FROM l WHERE doc_id % 4 = 0
UNION ALL SELECT doc_id, '사건명', title FROM c WHERE doc_id % 4 = 0 AND title <> ''""")
def dynamic_columns(spark, sf_dir):
    """Cells named by a header with equal names, or by place; a title overwrites."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", *[F.expr(DERIVED[n]).alias(n) for n in ("first_cell", "title")])
    header = F.when(F.col("doc_id") % 4 > 0, F.array(F.lit("번호"), F.lit("사건명"), F.lit("번호"))).otherwise(F.array().cast("array<string>"))
    named = html.with_title(html.named_cells(header, F.array("first_cell", "title", "lang", "source")), F.col("title"))
    return docs.select("doc_id", F.explode(named).alias("name", "value"))


@query("""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN concat('A', doc_id) WHEN 1 THEN concat('D', doc_id) WHEN 2 THEN concat('H', doc_id) WHEN 3 THEN concat('R', doc_id) END AS doc, CASE doc_id % 5 WHEN 0 THEN '1' WHEN 1 THEN '' WHEN 2 THEN lang WHEN 3 THEN '9' END AS sn FROM documents""")
def pdf_info_cascade(spark, sf_dir):
    """Identifiers from a call, data attributes, hidden inputs, or markup, in that order."""
    docs, k = table(spark, sf_dir, "documents").select("doc_id", "lang"), F.col("doc_id") % 5
    el = lambda call, doc: F.struct(call.alias("onclick"), doc.alias("doc_id"), F.lit(None).cast("string").alias("doc_sn"))
    none = F.lit(None).cast("string")
    elements = F.array(el(F.when(k == 0, F.concat(F.lit("fn_downloadFile('A"), "doc_id", F.lit("','1')"))).otherwise(F.lit("fn_downloadFile('one')")), none), el(none, F.when(k <= 1, F.concat(F.lit("D"), "doc_id"))))
    hidden = F.when(k == 2, F.array(F.lit(""), F.concat(F.lit("H"), "doc_id"), "lang")).otherwise(F.array(F.lit("only")))
    markup = F.when(k == 3, F.concat(F.lit("<a href=# onclick=\"fn_downloadFile( 'R"), "doc_id", F.lit("', '9')\">")))
    f = html.file_of(elements, hidden, markup)
    return docs.select("doc_id", f.alias("f")).select("doc_id", F.col("f.docId").alias("doc"), F.col("f.docSn").alias("sn"))


@query("""SELECT page_id, CAST(i - 1 AS BIGINT) AS pos, l[i] AS href FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]+)"', 1) AS l FROM pages), LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i)""")
def link_extract(spark, sf_dir):
    """X7, P1."""
    found = table(spark, sf_dir, "pages").select("page_id", F.posexplode(html.links(F.col("html"), 'href="([^"]+)"')).alias("pos", "href"))
    return found.withColumn("pos", F.col("pos").cast("long"))


@query("SELECT l_orderkey, l_linenumber, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey ")
def attachment_explode_join(spark, sf_dir):
    """Orders hold attachments (their line numbers), joined with the files that exist."""
    files = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    most = files.agg(F.coalesce(F.max("l_linenumber"), F.lit(1))).first()[0]
    items = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.explode(F.sequence(F.lit(1), F.lit(most))).alias("n"))
    return items.join(files, (F.col("o_orderkey") == F.col("l_orderkey")) & (F.col("n") == F.col("l_linenumber"))).select("l_orderkey", "l_linenumber", "o_orderstatus")


@query(f"""WITH c AS {d('title')}, f AS (SELECT title, arg_max(concat('/pdf/', doc_id), doc_id) AS path FROM c JOIN labels USING (doc_id) GROUP BY title) SELECT doc_id, path FROM c JOIN f USING (title)""")
def title_keyed_join(spark, sf_dir):
    """J2, A10, Q1 (compatible form): files (of the labelled cases) keyed by title, the last one registered wins."""
    cases = derived(spark, sf_dir, "title")
    files = records.found(cases, table(spark, sf_dir, "labels"), "doc_id").withColumn("path", F.concat(F.lit("/pdf/"), "doc_id"))
    return cases.join(records.last_wins(files, "title", "path", "doc_id"), "title").select("doc_id", "path")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def skip_existing(spark, sf_dir):
    """J3, U2."""
    return records.missing(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query(f"SELECT r.doc_id, l.quality FROM {d('first_cell')} r JOIN (SELECT CAST(doc_id AS VARCHAR) AS doc, quality FROM labels) l ON r.first_cell = l.doc")
def row_pending_match(spark, sf_dir):
    """Page rows whose first cell is a pending id."""
    pending = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("first_cell"), "quality")
    return derived(spark, sf_dir, "first_cell").join(pending, "first_cell").select("doc_id", "quality")


@query("""SELECT doc_id, arg_min(path, k) AS path FROM (SELECT l_orderkey AS doc_id, concat('f', l_orderkey, CASE l_linenumber % 4 WHEN 0 THEN '.hwp' WHEN 1 THEN '.hwpx' WHEN 2 THEN '.pdf' ELSE '.txt' END) AS path, l_linenumber % 4 AS k FROM lineitem) WHERE k < 3 GROUP BY doc_id""")
def extension_priority(spark, sf_dir):
    """The file of the first extension in order."""
    listing = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS doc_id", "CASE l_linenumber % 4 WHEN 0 THEN '.HWP' WHEN 1 THEN '.HWPX' WHEN 2 THEN '.PDF' ELSE '.TXT' END AS suffix")
    listing = listing.withColumn("path", text.with_suffix(F.concat(F.lit("f"), "doc_id", "suffix"), F.col("suffix"))).withColumn("extension", F.lower("suffix"))
    items = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"))
    return records.best_extension(items, listing, "doc_id", decode.EXTENSIONS).select("doc_id", "path")


_ARTICLES = ", ".join(f"('{k}', '{v}')" for k, v in rules.ARTICLES.items())


@query(f"SELECT doc_id, concat('약관규제법 제', n, '조 - ', label) AS named FROM (SELECT doc_id, CAST(doc_id % 20 AS VARCHAR) AS n FROM documents) JOIN (VALUES {_ARTICLES}) a(n, label) USING (n)")
def registry_lookup(spark, sf_dir):
    """A registry of nine rows, broadcast."""
    registry = spark.createDataFrame(list(rules.ARTICLES.items()), "n string, label string")
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 20).cast("string").alias("n"))
    return docs.join(F.broadcast(registry), "n").select("doc_id", F.concat(F.lit("약관규제법 제"), "n", F.lit("조 - "), "label").alias("named"))


@query("SELECT coalesce(nullif(CASE WHEN doc_id % 10 = 0 THEN '' ELSE source END, ''), '기타') AS category, count(*) AS n FROM documents GROUP BY 1")
def category_counts(spark, sf_dir):
    """A2, A3, K4."""
    return records.by_category(table(spark, sf_dir, "documents"), F.when(F.col("doc_id") % 10 == 0, "").otherwise(F.col("source")))


_OUTCOME = "CASE WHEN doc_id % 6 = 0 THEN 'no_pdf' WHEN quality IS NOT NULL THEN 'skipped' WHEN n_chars < 100 THEN 'failed' ELSE 'success' END"


@query(f"SELECT {_OUTCOME} AS outcome, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def outcome_tally(spark, sf_dir):
    """A6, A5, F4, F6, F7, R3."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return records.outcomes(rows, F.expr(_OUTCOME))


@query(f"""WITH w AS (SELECT doc_id, string_split({norm('text')}, ' ') AS w FROM documents), u AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM w), f AS (SELECT doc_id, x, min(i) AS i, count(*) AS n FROM u GROUP BY doc_id, x)
SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_words, count(*) AS n_distinct, sha256(string_agg(x, ' ' ORDER BY i)) AS digest FROM f GROUP BY doc_id""")
def array_stats(spark, sf_dir):
    """Words, distinct words, and the words without repeats joined in order."""
    w = table(spark, sf_dir, "documents").select("doc_id", F.split(text.normalize(F.col("text")), " ").alias("w"))
    return w.select("doc_id", F.size("w").cast("long").alias("n_words"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"), F.sha2(F.array_join(text.distinct_in_order(F.col("w")), " "), 256).alias("digest"))


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 ELSE 3 END AS part FROM documents")
def union_categories(spark, sf_dir):
    """U1."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    named = ("en", "fr", "de")
    return records.concatenated([*[docs.where(F.col("lang") == k) for k in named], docs.where(~F.coalesce(F.col("lang").isin(*named), F.lit(False)))]).select("doc_id", "part")


@query(f"SELECT doc_id, CAST(length(text) AS BIGINT) AS chars, length({strip('text')}) > 20 AS long_enough FROM documents")
def text_length(spark, sf_dir):
    """X11, F5."""
    return table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("chars"), (F.length(text.strip(F.col("text"))) > 20).alias("long_enough"))


@query("SELECT doc_id, concat('https://board.example/list.do?', 'pageIndex=', doc_id % 250, '&searchKeyword=', replace(url_encode(source || ' ' || lang), '%20', '+')) AS url FROM documents")
def url_build(spark, sf_dir):
    """P12, X16."""
    return table(spark, sf_dir, "documents").select("doc_id", text.url("https://board.example/list.do", pageIndex=F.col("doc_id") % 250, searchKeyword=F.concat_ws(" ", "source", "lang")).alias("url"))


def _listed(spark, sf_dir, extract):
    found = derived(spark, sf_dir, "legal").select("doc_id", F.posexplode(extract(F.col("legal"))).alias("pos", "value"))
    return found.withColumn("pos", F.col("pos").cast("long"))


def _listed_sql(lists: list[str], longer_than: int) -> str:
    joined = "list_concat(" + ", ".join(lists) + ")" if len(lists) > 1 else lists[0]
    kept = f"list_filter(list_transform({joined}, lambda x: {strip('x')}), lambda x: length(x) > {longer_than})"
    return f"""WITH l AS (SELECT doc_id, list_filter(v, lambda x, i: list_position(v, x) = i) AS u FROM (SELECT doc_id, {kept} AS v FROM (SELECT doc_id, {DERIVED['legal']} AS t FROM documents)))
SELECT doc_id, CAST(i - 1 AS BIGINT) AS pos, u[i] AS value FROM l, LATERAL (SELECT unnest(range(1, len(u) + 1)) AS i)"""


def _re(pattern: str, group: int = 0, t: str = "t") -> str:
    return f"regexp_extract_all({t}, '{pattern.replace('_', W + '*')}', {group})"


_N = r"\p{Nd}+"
_NUMBERED = rf"regexp_replace(t, '\n({_N}\.)', chr(1) || '\1', 'g')"
_ARTICLE = rf"regexp_replace(t, '\n({W}*제{_N}조)', chr(1) || '\1', 'g')"
_BACK = "list_transform({}, lambda x: replace(x, chr(1), chr(10)))"


CLAUSES_SQL = [_BACK.format(_re(rf"피심인의_약관_제{_N}조[^\x01]*", t=_NUMBERED)), _BACK.format(_re(rf"약관_제{_N}조(?:[가-힣]|{W})*\([^)]*\)[^\x01]*", t=_NUMBERED)), _BACK.format(_re(rf"제{_N}조_[(（][^)）]*[)）][^\x01]*", t=_ARTICLE))]


@query(_listed_sql(CLAUSES_SQL, 20))
def clauses_extract(spark, sf_dir):
    """E1."""
    return _listed(spark, sf_dir, rules.clauses)


_LABELS = "MAP {" + ", ".join(f"'{k}': '약관규제법 제{k}조 - {v}'" for k, v in rules.ARTICLES.items()) + "}"


VIOLATIONS_SQL = [*[_re(p) for p in rules.PHRASES], f"list_filter(list_transform({_re(rules.TERMS_ACT + f'제({_N})조', 1)}, lambda n: {_LABELS}[n]), lambda x: x IS NOT NULL)"]


@query(_listed_sql(VIOLATIONS_SQL, -1))
def violations_extract(spark, sf_dir):
    """E2."""
    return _listed(spark, sf_dir, rules.violations)


BASES_SQL = [_re(rf"{law}제{_N}조(?:_제{_N}항)?" + (rf"(?:_제{_N}호)?" if items else "")) for law, items in rules.STATUTES]


@query(_listed_sql(BASES_SQL, -1))
def legal_basis_extract(spark, sf_dir):
    """E3."""
    return _listed(spark, sf_dir, rules.legal_bases)


_ENDED = r"regexp_replace(t, '([^\n])\n{1,2}\z', '\1')"
_CUT = rf"regexp_replace({_ENDED}, '\n\n{W}*({_N}\.)?', chr(2) || '\1', 'g')"
_SECTIONS = rf"string_split(regexp_replace({_CUT}, chr(2) || '({_N}\.)', chr(3) || chr(2) || '\1', 'g') || chr(3), chr(2))"


def _blocks_sql(heading: str) -> str:
    head = heading.replace("_", f"{text.LINE_WHITE}*")
    within = rf"CASE WHEN suffix(s, chr(3)) THEN rtrim(s, chr(3)) ELSE regexp_extract(s, '(?s)\A(.*)\n{text.LINE_WHITE}*{_N}\.', 1) END"
    return rf"list_filter(list_transform(list_filter({_SECTIONS}, lambda s: regexp_matches(s, '{head}')), lambda s: regexp_extract({within}, '(?s){head}[^\n]*\n(.+)\z', 1)), lambda x: x <> '')"


CORRECTIONS_SQL = [*[_blocks_sql(h) for h in rules.HEADINGS], _re(r"「[^」]+」_(?:으로|로)_(?:수정|변경|개정)[^\n]*"), _re(r"삭제_(?:한다|하여야|하도록)[^\n]*")]


@query(_listed_sql(CORRECTIONS_SQL, 10))
def corrective_extract(spark, sf_dir):
    """E4."""
    return _listed(spark, sf_dir, rules.corrections)


_HITS = ", ".join(f"('{k}', '{v}')" for k, v in rules.GENERIC.items())


@query(f"""WITH d AS (SELECT lang, t FROM (SELECT lang, {norm('text')} AS k, text AS t, row_number() OVER (PARTITION BY {norm('text')} ORDER BY n_chars, doc_id) AS r FROM documents) WHERE r = 1 AND k <> ''),
h AS ({" UNION ALL ".join(f"SELECT lang, '{k}' AS rule, len(regexp_extract_all(t, '{v}')) AS n FROM d" for k, v in rules.GENERIC.items())})
SELECT lang, rule, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_hits FROM h WHERE n > 0 GROUP BY lang, rule""")
def rule_hits_by_lang(spark, sf_dir):
    """The flagship: normalise, keep one document per text, extract by rules, count by rule and language."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text", "n_chars", text.normalize(F.col("text")).alias("k"))
    # documents are told apart by a digest, so texts are not shuffled; hits are found before
    hits = docs.select("doc_id", "lang", "n_chars", F.when(F.col("k") != "", F.sha2("k", 256)).alias("k"), rules.rule_hits(F.col("text")).alias("hits"))
    best = records.dedup_lowest_page(hits, F.col("k"), page="n_chars", order=["doc_id"])
    return best.select("lang", F.explode("hits").alias("h")).groupBy("lang", F.col("h.rule").alias("rule")).agg(F.count("*").alias("n_docs"), F.sum("h.n").alias("n_hits"))


@query("SELECT CAST(floor(doc_id / 100.0) AS BIGINT) AS chunk, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents GROUP BY 1")
def json_envelope(spark, sf_dir):
    """K5: envelopes of at most 100 records, read back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    sent = records.envelope_chunks(docs, F.col("doc_id"), 100, 출처=F.lit("documents"))
    back = F.from_json("body", "`총_건수` long, `사례` array<struct<doc_id:long>>")
    return sent.select("chunk", back.alias("b")).select("chunk", F.col("b.`총_건수`").alias("n"), F.array_min(F.col("b.`사례`.doc_id")).alias("first_id"), F.array_max(F.col("b.`사례`.doc_id")).alias("last_id"))


@query(f"SELECT doc_id, sha256({strip('regexp_replace(replace(text, chr(9), chr(32)), chr(91) || chr(65536) || chr(45) || chr(1114111) || chr(93), chr(63) || chr(63), chr(103))')}) AS digest FROM documents WHERE text <> ''")
def hwp_decode(spark, sf_dir):
    """Each document as a compressed stream of paragraph records, decoded again."""
    docs = table(spark, sf_dir, "documents").where("text <> ''").select("doc_id", decode.to_records(F.translate("text", "\t", " ")).alias("stream"))
    return docs.select("doc_id", decode.body_text("stream").alias("t")).select("doc_id", F.sha2(text.strip(F.col("t.text")), 256).alias("digest"))


@query(f"SELECT page_id, sha256({norm("regexp_replace(html, '<[^>]+>', '', 'g')")}) AS digest FROM pages")
def hwpx_decode(spark, sf_dir):
    """Each page as the section of an archive, decoded again."""
    packed = table(spark, sf_dir, "pages").select("page_id", decode.to_archive("html").alias("z"))
    return packed.select("page_id", decode.archive_text("z").alias("t")).select("page_id", F.sha2(text.normalize(F.col("t.text")), 256).alias("digest"))


@query()
def binary_listing(spark, sf_dir):
    """The part files of documents that a listing finds, without reading contents; small ones dropped at the scan."""
    return decode.listing(spark, f"{sf_dir}/documents.parquet", "*.parquet").select(F.regexp_extract("path", r"([^/]+)\z", 1).alias("name"), "length")


@query("SELECT CAST(doc_id AS VARCHAR) AS id, lang AS name, sha256(text) AS digest FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def paged_source(spark, sf_dir):
    """A list in pages as a service sends them, parsed; entries that are there already (labels) left out, detail bodies joined to the others."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "lang", "text", "doc_id")
    entries = paged.collect(paged.serve(docs.select("id", F.col("lang").alias("name"), "doc_id")), json_.PRECEDENT)
    there = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("id"))
    return records.missing(entries, there, "id").join(docs.select("id", F.sha2("text", 256).alias("digest")), "id").select("id", "name", "digest")


@query("""WITH p AS (SELECT DISTINCT source, CAST(floor(doc_id / 20.0) AS BIGINT) + 1 AS page FROM documents JOIN labels USING (doc_id)),
i AS (SELECT source, min(page) AS a, max(page) AS b FROM (SELECT *, page - row_number() OVER (PARTITION BY source ORDER BY page) AS g FROM p) GROUP BY source, g),
w AS (SELECT source, coalesce(lag(b) OVER (PARTITION BY source ORDER BY a), 0) + 1 AS first, a - 1 AS last FROM i)
SELECT * FROM w WHERE first <= last""")
def page_gaps(spark, sf_dir):
    """Runs of pages that a store (of the labelled documents, twenty ids to a page) lacks, by source: what a resumed walk asks for."""
    there = records.found(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")
    return walk.gaps(there.select("source", (F.floor(F.col("doc_id") / 20.0) + 1).alias("page")), ["source"])


@query("""WITH e AS (SELECT doc_id, CAST(floor(doc_id / 10.0) AS BIGINT) + 1 AS page, lang FROM documents)
SELECT page, row_number() OVER (PARTITION BY page ORDER BY doc_id) - 1 AS pos, CAST(doc_id AS VARCHAR) AS id, lang AS name, CAST(NULL AS VARCHAR) AS error FROM e WHERE page % 14 <> 3
UNION ALL SELECT DISTINCT page, NULL, NULL, NULL, 'again' FROM e WHERE page % 14 = 3""")
def resumed_walk(spark, sf_dir):
    """A list of which every seventh page failed in a first run, and half of these again in a second; each page settles, none after a failed one is lost."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("name"))
    sent = paged.serve(docs, size=10, total=1 << 60).withColumn("page", F.col("page") + 1)
    failed = F.col("page") % 7 == 3
    none = F.lit(None).cast("string")
    first = sent.select("page", F.when(~failed, F.col("body")).alias("body"), F.when(failed, "once").alias("error"))
    again = F.col("page") % 14 == 3
    second = sent.where(failed).select("page", F.when(~again, F.col("body")).alias("body"), F.when(again, "again").otherwise(none).alias("error"))
    found = paged.entries(paged.settled(first.unionByName(second)), json_.PRECEDENT)
    return found.withColumn("pos", F.col("pos").cast("long"))


_CATEGORY = "CASE doc_id % 6 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(builders.CATEGORIES)) + " END"
_ESCAPED = "replace(replace({}, '&', '&amp;'), '<', '&lt;')"
_TITLE = "replace(text, chr(10), ' ')"


@query(f"""WITH r AS (SELECT doc_id, {_CATEGORY} AS category, CAST(floor(doc_id / 60.0) AS BIGINT) + 1 AS page, {DERIVED['first_cell']} AS number, {strip(_TITLE)} AS title, source, lang, doc_id % 3 AS k FROM documents),
p AS (SELECT category, page, string_agg(concat(number, title), chr(10) ORDER BY doc_id) AS body FROM r GROUP BY category, page),
w AS (SELECT category, page FROM p QUALIFY row_number() OVER (PARTITION BY category ORDER BY page) = page),
h AS (SELECT *, max(CAST(contains(number, '데이터') OR contains(number, '없습니다') AS INT)) OVER (PARTITION BY category, page ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS hit, row_number() OVER (PARTITION BY category, page ORDER BY doc_id) - 1 AS pos FROM r JOIN w USING (category, page))
SELECT category, page, pos, number, sha256(title) AS title, source AS department, lang AS registered, CAST(CASE k WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS INT) AS n_files,
CASE k WHEN 0 THEN NULL ELSE concat('{builders.DOWNLOAD_URL}?atchmnflNo=', doc_id) END AS url FROM h WHERE hit = 0""")
def contract_items(spark, sf_dir):
    """Boards of six categories as pages of HTML, ten rows to a page, read back to items."""
    cell = lambda c: f"concat('<td>', {c}, '</td>')"
    link = "concat('<a href=\"/download/downloadBbsFile.do?atchmnflNo=', {}, '&x=1\">file</a>')"
    files = f"concat('<td><a href=\"/other\">no</a>', CASE WHEN doc_id % 3 > 0 THEN {link.format('doc_id')} ELSE '' END, CASE WHEN doc_id % 3 = 2 THEN {link.format('doc_id + 1')} ELSE '' END, '</td>')"
    row = f"concat('<tr>', {cell('first_cell')}, '<td><a href=\"v\"> ', {_ESCAPED.format(_TITLE)}, '</a> new</td>', {cell('source')}, {cell('lang')}, {files}, '</tr>')"
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_CATEGORY} AS category", "CAST(floor(doc_id / 60.0) AS BIGINT) + 1 AS page", f"{DERIVED['first_cell']} AS first_cell", "text", "source", "lang")
    rows = docs.select("category", "page", F.struct("doc_id", F.expr(row).alias("r")).alias("r")).groupBy("category", "page").agg(F.sort_array(F.collect_list("r")).alias("r"))
    pages = rows.select("category", "page", F.concat(F.lit("<table><tr><td>menu</td></tr></table><table class='x p-table'><thead><tr><th>no</th></tr></thead><tbody>"), F.array_join(F.transform("r", lambda x: x["r"]), "\n"), F.lit("</tbody></table>")).alias("html"))
    found = boards.contract_items(pages.join(F.broadcast(builders.chosen(spark).select("category")), "category"), most=1 << 30)
    url = F.get(F.transform("첨부파일", lambda f: f["download_url"]), F.lit(0))
    return found.select(F.col("카테고리").alias("category"), "page", F.col("pos").cast("long").alias("pos"), F.col("번호").alias("number"), F.sha2("제목", 256).alias("title"), F.col("담당부서").alias("department"), F.col("등록일").alias("registered"), F.size("첨부파일").alias("n_files"), url.alias("url"))


_CASE = "SELECT doc_id, source AS board, CAST(floor(doc_id / 200.0) AS BIGINT) AS page, {first_cell} AS number, {case_no} AS case_no, {decision_no} AS decision_no, {title} AS title FROM documents"


@query(f"""WITH r AS ({_CASE.format(**DERIVED)}), v AS (SELECT *, {norm('title')} AS t FROM r WHERE NOT contains(number, '데이터') AND NOT contains(number, '없습니다')),
p AS (SELECT board, page, row_number() OVER (PARTITION BY board ORDER BY page) AS n, concat_ws('||', arg_min(t, doc_id), arg_max(t, doc_id), CAST(count(*) AS VARCHAR)) AS signature FROM v GROUP BY board, page),
s AS (SELECT *, CAST(signature = lag(signature, 1, '') OVER (PARTITION BY board ORDER BY n) AS INT) AS rep FROM p),
w AS (SELECT board, page, n FROM s QUALIFY sum(rep) OVER (PARTITION BY board ORDER BY n ROWS UNBOUNDED PRECEDING) = 0)
SELECT v.board, w.n AS page, CASE WHEN t = '' THEN '' ELSE sha256(t) END AS name, {norm('number')} AS number, {norm('case_no')} AS case_no, {norm('decision_no')} AS decision_no, CASE doc_id % 3 WHEN 0 THEN concat('D', doc_id) WHEN 1 THEN concat('A', doc_id) ELSE concat('H', doc_id) END AS doc, CASE doc_id % 3 WHEN 0 THEN '1' WHEN 1 THEN '' ELSE '2' END AS sn
FROM v JOIN w USING (board, page)""")
def case_records(spark, sf_dir):
    """Decision lists as pages of HTML, read back to case records. Boards are sources; their filled pages are numbered in a row."""
    rows = table(spark, sf_dir, "documents").selectExpr("doc_id", "source AS board", "CAST(floor(doc_id / 200.0) AS BIGINT) AS page", *[f"{DERIVED[n]} AS {n}" for n in ("first_cell", "case_no", "decision_no", "title")])
    info = "CASE doc_id % 3 WHEN 0 THEN concat('<button onclick=\"fn_downloadFile(''D', doc_id, ''', ''1'')\">pdf</button>') WHEN 1 THEN concat('<button data-doc-id=A', doc_id, '>pdf</button>') ELSE concat('<input type=hidden value=H', doc_id, '><input type=hidden value=2>') END"
    title = f"CASE WHEN title = '' THEN '' ELSE concat('<a href=v>', {_ESCAPED.format('title')}, '</a>') END"
    cells = f"concat('<tr><td>', first_cell, '</td><td>', case_no, '</td><td>', decision_no, '</td><td>', {title}, '</td><td>', {info}, '</td></tr>')"
    filled = rows.select("board", "page").where(~F.expr("contains(first_cell, '데이터') OR contains(first_cell, '없습니다')")).distinct()
    numbered = filled.withColumn("n", F.row_number().over(Window.partitionBy("board").orderBy("page")).cast("long"))
    listed = rows.select("board", "page", F.struct("doc_id", F.expr(cells).alias("r")).alias("r")).groupBy("board", "page").agg(F.sort_array(F.collect_list("r")).alias("r")).join(numbered, ["board", "page"])
    head = "<div id=contents><table class=list><thead><tr><th>번호</th><th>사건번호</th><th>의결번호</th><th>사건명</th></tr></thead><tbody>"
    pages = listed.select("board", F.col("n").alias("page"), F.concat(F.lit(head), F.array_join(F.transform("r", lambda x: x["r"]), ""), F.lit("</tbody></table></div>")).alias("html"))
    found = boards.case_records(pages, most=1 << 30)
    value = lambda k: F.col("셀_데이터")[k]
    return found.select("board", F.col("수집_페이지").alias("page"), F.when(F.col("사건명") == "", "").otherwise(F.sha2("사건명", 256)).alias("name"), value("번호").alias("number"), value("사건번호").alias("case_no"), value("의결번호").alias("decision_no"), F.col("pdf_info.docId").alias("doc"), F.col("pdf_info.docSn").alias("sn"))


_CONTRACT = f"SELECT doc_id, {_CATEGORY} AS category, source, lang, {strip(_TITLE)} AS title, text FROM documents"


def _contracts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_CATEGORY} AS category", "source", "lang", f"{_TITLE} AS title", "text")
    link = lambda n: F.concat(F.lit(f"/x/{builders.FILE_LINK}.do?atchmnflNo="), n.cast("string"))
    rows = docs.select("category", F.array(F.col("doc_id").cast("string"), "title", "source", "lang", F.lit("")).alias("cells"), F.lit(None).cast("string").alias("title_link"), F.array(link(F.col("doc_id")), link(F.col("doc_id") + 1), F.lit("/none")).alias("hrefs"))
    texts = docs.select(F.col("doc_id").cast("string").alias("file_id"), F.concat(builders.file_name(F.col("category"), text.strip(F.col("title")), F.col("doc_id").cast("string")), F.lit(".hwp")).alias("name"), "text")
    return builders.parsed_contracts(builders.items(rows), texts)


@query(f"""WITH c AS ({_CONTRACT}) SELECT t.doc_id AS file_id, c.doc_id AS item_id, c.category, sha256(c.title) AS title, {safe("concat_ws('_', t.category, t.title, CAST(t.doc_id AS VARCHAR))")} || '.hwp' AS name, CAST(length(t.text) AS INT) AS n_chars
FROM c JOIN c t ON t.doc_id IN (c.doc_id, c.doc_id + 1) WHERE t.text <> ''""".replace("SELECT t.doc_id AS file_id, c.doc_id AS item_id,", "SELECT t.doc_id AS file_id,").replace("t.doc_id IN (c.doc_id, c.doc_id + 1)", "(t.doc_id = c.doc_id OR t.doc_id = c.doc_id + 1)"))
def parsed_contracts(spark, sf_dir):
    """Records of the attachments whose file gave a text; two files to an item."""
    return _contracts(spark, sf_dir).select(F.col("파일ID").cast("long").alias("file_id"), F.col("카테고리").alias("category"), F.sha2("제목", 256).alias("title"), F.col("원본_파일명").alias("name"), F.col("텍스트_길이").alias("n_chars"))


@query(f"""WITH c AS ({_CONTRACT}), r AS (SELECT c.category, t.doc_id AS f FROM c JOIN c t ON (t.doc_id = c.doc_id OR t.doc_id = c.doc_id + 1) WHERE t.text <> '')
SELECT category, f AS file_id, CAST(count(*) OVER (PARTITION BY category) AS BIGINT) AS total FROM r""")
def contracts_by_category(spark, sf_dir):
    """A2, K4: enveloped records by category in parts of bounded size, read back row by row."""
    parts = builders.categorised(_contracts(spark, sf_dir), size=500)
    return parts.select("category", F.explode("사례").alias("r"), F.col("총_건수").alias("total")).select("category", F.col("r.파일ID").cast("long").alias("file_id"), "total")


def _counted(lists: list[str], longer_than: int, name: str) -> str:
    return f"SELECT doc_id, count(*) AS {name} FROM ({_listed_sql(lists, longer_than)}) GROUP BY doc_id"


@query(f"""SELECT d.doc_id, concat(d.doc_id, '.pdf') AS file, CAST(length({DERIVED['legal']}) AS INT) AS n_chars, coalesce(a.n, 0) AS n_clauses, coalesce(b.n, 0) AS n_violations, coalesce(c.n, 0) AS n_bases, coalesce(e.n, 0) AS n_corrections, 'High' AS risk_level
FROM documents d LEFT JOIN ({_counted(CLAUSES_SQL, 20, 'n')}) a USING (doc_id) LEFT JOIN ({_counted(VIOLATIONS_SQL, -1, 'n')}) b USING (doc_id) LEFT JOIN ({_counted(BASES_SQL, -1, 'n')}) c USING (doc_id) LEFT JOIN ({_counted(CORRECTIONS_SQL, 10, 'n')}) e USING (doc_id)""")
def parsed_cases(spark, sf_dir):
    """Records of decisions from their whole texts."""
    docs = derived(spark, sf_dir, "legal")
    cells = F.create_map(F.lit("번호"), F.col("doc_id").cast("string"))
    found = builders.parsed_cases(docs.select("doc_id", F.lit("").alias("사건명"), cells.alias("셀_데이터"), F.concat("doc_id", F.lit(".pdf")).alias("name"), F.col("legal").alias("text")))
    return found.select("doc_id", F.col("pdf_파일").alias("file"), F.col("전체_텍스트_길이").alias("n_chars"), *[F.size(c).cast("long").alias(n) for c, n in (("조항_원문", "n_clauses"), ("위반_유형", "n_violations"), ("근거_법령", "n_bases"), ("시정_내용", "n_corrections"))], "risk_level")


@query("""SELECT doc_id, min(page) AS page, arg_min(source, page * 1000000000 + k) AS source FROM (SELECT doc_id, doc_id % 7 AS page, 0 AS k, source FROM documents UNION ALL SELECT doc_id, quality AS page, 1 AS k, 'label' FROM labels) GROUP BY doc_id""".replace("page * 1000000000 + k", "k * 1000000000 + page").replace("min(page) AS page", "arg_min(page, k * 1000000000 + page) AS page"))
def keyed_store(spark, sf_dir):
    """A store of one row per id; what it holds stays, new ids are added."""
    there = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 7).alias("page"), "source")
    new = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("long").alias("page"), F.lit("label").alias("source"))
    return records.upsert(new, there, "doc_id", "page")


@query(f"SELECT 'collect' AS step, {_OUTCOME} AS outcome, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 2")
def run_metrics(spark, sf_dir):
    """Outcomes of a step as rows of a metrics table, observed while its rows are written."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    rows, seen = records.observed(rows.select("doc_id", F.expr(_OUTCOME).alias("outcome")), "collect", F.col("outcome"), ("no_pdf", "skipped", "failed", "success"))
    rows.write.parquet(new_folder(spark, "collected"))
    return records.observed_metrics(spark, seen, "collect")


def _decoded(c: str) -> str:
    return strip(f"regexp_replace(replace({c}, chr(9), chr(32)), chr(91) || chr(65536) || chr(45) || chr(1114111) || chr(93), chr(63) || chr(63), chr(103))")


@query(f"""WITH p AS (SELECT doc_id, i, {_decoded("substr(text, CAST(floor(i * length(text) / 11.0) AS BIGINT) + 1, CAST(floor((i + 1) * length(text) / 11.0) - floor(i * length(text) / 11.0) AS BIGINT))")} AS s FROM documents, (SELECT unnest(range(0, 11)) AS i) WHERE text <> '')
SELECT doc_id, sha256(coalesce(string_agg(s, chr(10) ORDER BY i) FILTER (s <> ''), '')) AS by_number, sha256(coalesce(string_agg(s, chr(10) ORDER BY CAST(i AS VARCHAR)) FILTER (s <> ''), '')) AS by_name FROM p GROUP BY doc_id""")
def ole_decode(spark, sf_dir):
    """Each document as a compound file of eleven sections, every other one packed, decoded in the order of the sections' names and of their numbers."""
    docs = table(spark, sf_dir, "documents").where("text <> ''").select("doc_id", F.translate("text", "\t", " ").alias("t"))
    at = lambda i: F.floor(i * F.length("t") / 11.0).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), F.lit(10)), lambda i: F.substring("t", at(i) + 1, at(i + 1) - at(i)))
    made = docs.select("doc_id", decode.to_container(pieces, F.col("doc_id") % 2 == 0).alias("c"))
    found = made.select("doc_id", decode.document_text("c").alias("a"), decode.document_text_by_number("c").alias("b"))
    return found.select("doc_id", F.sha2("b.text", 256).alias("by_number"), F.sha2("a.text", 256).alias("by_name"))


@query(f"""WITH c AS (SELECT doc_id, {_CATEGORY} AS category, concat(source, ' / ', doc_id) AS title, text FROM documents WHERE doc_id % 5 <> 4),
t AS (SELECT doc_id, category, title, CASE WHEN doc_id % 5 < 2 THEN '.hwp' WHEN doc_id % 5 = 2 THEN '.hwpx' END AS suffix, CASE WHEN doc_id % 5 < 2 THEN {_decoded('text')} ELSE {norm("regexp_replace(text, '<[^>]+>', '', 'g')")} END AS text FROM c WHERE doc_id % 5 < 3)
SELECT doc_id AS file_id, category, {safe("concat_ws('_', category, title, CAST(doc_id AS VARCHAR))")} || suffix AS name, sha256(text) AS digest, CAST(length(text) AS INT) AS n_chars FROM t WHERE text <> ''""")
def reparse_contracts(spark, sf_dir):
    """Documents as encoded files of a folder (compound files, archives, broken ones, some in two suffixes, some missing), found by the names of their items and parsed to records again."""
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_CATEGORY} AS category", "concat(source, ' / ', doc_id) AS title", "source", "lang", "coalesce(text, '') AS text")
    name = builders.file_name(F.col("category"), F.col("title"), F.col("doc_id").cast("string"))
    k = F.col("doc_id") % 5
    file = lambda suffix, content: F.struct(F.concat(name, F.lit(suffix)).alias("name"), content.alias("content"))
    ole = decode.to_container(F.array(F.translate("text", "\t", " ")), F.col("doc_id") % 2 == 0)
    encoded = docs.where("doc_id % 5 <> 4").withColumns({"ole": ole, "archive": decode.to_archive("text")})
    files = F.when(k == 0, F.array(file(".hwp", F.col("ole")))).when(k == 1, F.array(file(".pdf", F.lit(b"%PDF broken")), file(".hwp", F.col("ole")))).when(k == 2, F.array(file(".zip", F.lit(b"PK no")), file(".hwpx", F.col("archive")))).otherwise(F.array(file(".docx", F.lit(b"PK broken"))))
    folder = new_folder(spark, "reparse")
    boards.save_files(encoded.select(F.explode(files).alias("f")).select("f.*", F.lit("success").alias("outcome")), folder)
    link = F.concat(F.lit(f"/x/{builders.FILE_LINK}.do?atchmnflNo="), F.col("doc_id").cast("string"))
    items = builders.items(docs.select("category", F.array(F.col("doc_id").cast("string"), "title", "source", "lang", F.lit("")).alias("cells"), F.lit(None).cast("string").alias("title_link"), F.array(link).alias("hrefs")))
    wanted = items.select("카테고리", "제목", F.explode("첨부파일").alias("f")).select(F.col("f.file_id").alias("file_id"), builders.file_name(F.col("카테고리"), F.col("제목"), F.col("f.file_id")).alias("name"))
    found = builders.parsed_contracts(items, decode.reparse(spark, folder, wanted))
    return found.select(F.col("파일ID").cast("long").alias("file_id"), F.col("카테고리").alias("category"), F.col("원본_파일명").alias("name"), F.sha2("추출_텍스트", 256).alias("digest"), F.col("텍스트_길이").alias("n_chars"))


@query("SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'first' ELSE 'second' END AS batch FROM documents")
def bucketed_store(spark, sf_dir):
    """A store in buckets by key, filled by two batches (the labelled documents, then all of them); what it holds stays."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels")
    target = new_folder(spark, "store")
    first = records.found(docs, labels, "doc_id").withColumn("batch", F.lit("first"))
    for batch in (first, docs.withColumn("batch", F.lit("second"))):
        incremental.append_new(batch, target, "doc_id")
    return incremental.held(spark, target, first.schema).select("doc_id", "batch")


@query(f"SELECT doc_id AS file_id, {_CATEGORY} AS category, CASE WHEN {_CATEGORY} = '표준가맹계약서' AND doc_id IN (SELECT doc_id FROM labels) THEN 2 ELSE 1 END AS run FROM documents")
def merged_categories(spark, sf_dir):
    """K4, Q7: records by category, one category run again with some of its records: these are replaced, all others stay."""
    docs = table(spark, sf_dir, "documents").selectExpr("CAST(doc_id AS STRING) AS `파일ID`", f"{_CATEGORY} AS `카테고리`", "doc_id")
    path = new_folder(spark, "categories")
    again = records.found(docs.where("`카테고리` = '표준가맹계약서'"), table(spark, sf_dir, "labels"), "doc_id")
    for run, rows in ((1, docs), (2, again)):
        builders.merge_categories(rows.drop("doc_id").withColumn("run", F.lit(run)), path)
    back = spark.read.schema("`파일ID` string, `카테고리` string, run int, _folder string").json(path)
    return back.select(F.col("파일ID").cast("long").alias("file_id"), F.col("카테고리").alias("category"), "run")


@query("""WITH b AS (SELECT event_id, CASE event_id % 10 WHEN 0 THEN substr(props, 1, 3) WHEN 1 THEN '' ELSE props END AS body FROM events),
o AS (SELECT event_id, body, CASE WHEN body IS NULL OR trim(body) IN ('', 'null', '{}', '[]', '""') THEN 'empty' WHEN NOT json_valid(body) THEN 'malformed' ELSE 'found' END AS outcome FROM b)
SELECT event_id, outcome, k AS name, CAST(json_extract(body, '$."' || k || '"') AS DOUBLE) AS value FROM (SELECT event_id, body, outcome, unnest(json_keys(body)) AS k FROM o WHERE outcome = 'found')
UNION ALL SELECT event_id, outcome, NULL, NULL FROM o WHERE outcome <> 'found'""")
def event_variants(spark, sf_dir):
    """Bodies of no known schema (the properties of events; some cut off, some empty) as variants, their fields read when asked for."""
    body = F.expr("CASE event_id % 10 WHEN 0 THEN substr(props, 1, 3) WHEN 1 THEN '' ELSE props END")
    found = paged.variants(table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), body.alias("body")))
    fields = spark.sql("SELECT id, outcome, f.key AS name, try_variant_get(f.value, '$', 'double') AS value FROM {found}, LATERAL variant_explode_outer(document) AS f", found=found)
    return fields.select(F.col("id").alias("event_id"), "outcome", "name", "value")


@query("""SELECT doc_id, sha256(text) AS digest, 'record' AS outcome FROM documents WHERE doc_id % 11 <> 5 UNION ALL SELECT NULL, NULL, 'broken' FROM documents WHERE doc_id % 11 = 5""")
def large_envelopes(spark, sf_dir):
    """Documents as an envelope with line feeds and indents, a few broken, in files that several tasks can read; back to records."""
    field = lambda name, value, end=",": F.concat(F.lit(f'            "{name}": '), value, F.lit(f"{end}\n"))
    text = F.regexp_extract(F.to_json(F.struct(F.col("text").alias("x"))), r'(?s)\A\{"x":(.*)\}\z', 1)
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    bad = F.when(F.col("doc_id") % 11 == 5, " x").otherwise("")
    record = F.concat(F.lit('    "총_건수": 1,\n    "사례": [\n        {\n'), field("doc_id", F.concat(F.col("doc_id").cast("string"), bad)), field("text", text, ""), F.lit("        }\n    ]"))
    path = new_folder(spark, "envelopes")
    docs.select(F.concat(F.lit("{\n"), record, F.lit("\n}")).alias("value")).write.text(path)
    back = records.large_envelope(spark, path, "doc_id long, text string")
    return back.select("r.doc_id", F.sha2("r.text", 256).alias("digest"), "outcome")


@query("""WITH p AS (SELECT doc_id % 1000 AS key, CAST(floor(doc_id / 10.0) AS BIGINT) + 1 AS page, doc_id AS i, doc_id % 4 <> 0 AS has FROM documents),
c AS (SELECT page FROM (SELECT DISTINCT page FROM p) QUALIFY row_number() OVER (ORDER BY page) = page),
s AS (SELECT key, min(page) AS page, arg_min(has, i) AS has FROM p JOIN c USING (page) JOIN (SELECT DISTINCT doc_id AS key FROM labels) USING (key) GROUP BY key),
w AS (SELECT count(DISTINCT doc_id) AS n FROM labels),
g AS (SELECT page, count(*) FILTER (has) AS n_success, count(*) FILTER (NOT has) AS n_failed, count(*) AS n FROM s GROUP BY page)
SELECT page, n_success, n_failed, CAST(w.n - sum(g.n) OVER (ORDER BY page ROWS UNBOUNDED PRECEDING) AS BIGINT) AS n_left FROM g, w""")
def pending_walk(spark, sf_dir):
    """Labelled ids pending on a list of documents of ten to a page (an id shows wherever its last three digits do); what is left after each page."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    rows = docs.select((F.floor(F.col("doc_id") / 10.0) + 1).cast("long").alias("page"), F.col("doc_id").alias("pos"), (F.col("doc_id") % 1000).alias("key"), (F.col("doc_id") % 4 != 0).alias("has_file"))
    return walk.shrinking(walk.pending(rows, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"))))


@query(f"""WITH c AS (SELECT doc_id, {safe(f"coalesce(nullif(concat_ws(' | ', nullif({strip('case_no')}, ''), nullif({strip('decision_no')}, ''), nullif({strip('title')}, '')), ''), concat('case_', doc_id))", "concat('case_', doc_id)")} AS name FROM {d('case_no', 'decision_no', 'title')}),
f AS (SELECT name, arg_max(concat('/pdf/', doc_id), doc_id) AS path FROM c JOIN (SELECT DISTINCT doc_id FROM labels) USING (doc_id) GROUP BY name) SELECT doc_id, path FROM c JOIN f USING (name)""")
def case_files(spark, sf_dir):
    """S21, J2, X5, Q1 (default form): files (of the labelled cases) are found by the case's identifier, so cases of one title keep their own."""
    rows = derived(spark, sf_dir, "case_no", "decision_no", "title")
    cases = rows.select("doc_id", F.col("case_no").alias("사건번호"), F.col("decision_no").alias("의결번호"), F.col("title").alias("사건명"), F.col("doc_id").alias("ord"))
    named = cases.select("doc_id", text.case_identifier(F.col("사건번호"), F.col("의결번호"), F.col("사건명"), F.col("ord")).alias("name"), F.col("사건명").alias("title"), "ord")
    files = records.found(named, table(spark, sf_dir, "labels"), "doc_id").withColumn("path", F.concat(F.lit("/pdf/"), "doc_id")).drop("doc_id")
    return builders.case_files(cases, files).select("doc_id", "path")


@query("SELECT count(*) AS n_entries, count(DISTINCT k) AS n_ids, count(*) - count(DISTINCT k) AS n_again, CAST(0 AS BIGINT) AS n_failed FROM (SELECT doc_id // 3 AS k FROM documents)")
def list_report(spark, sf_dir):
    """A list that shows most ids several times; how many entries, ids, and repeats it has."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("doc_id") / 3).cast("string").alias("id"), F.col("lang").alias("name"))
    return paged.report(paged.entries(paged.settled(paged.serve(docs, total=1 << 60).withColumn("page", F.col("page") + 1).withColumn("error", F.lit(None).cast("string"))), json_.PRECEDENT))
