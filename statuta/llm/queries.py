"""The queries of this subpackage: each applies an operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.llm import chat, decontam, earlier, jaccard, lexical, mixing, mixture, neighbours, paragraphs, pii, quality, variants, wrappers
from statuta.llm.common import fold, read


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(read(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda i: lambda b: b["k"] == i
    counts = [F.size(F.filter("base", of(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii.digest(F.col("base")).cast("binary"), 256).alias("base_sha256"), pii.digest(F.col("spans")).alias("spans"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), ~quality.held_out())
    return out.select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(read(spark, sf_dir, "documents"))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.score(read(spark, sf_dir, "documents"), fold("doc_id") == 1)


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return chat.digests(chat.format_turns(turns.unionByName(probe)))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents").select("doc_id", "source", F.xxhash64("text").alias("text_hash")))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = earlier.remove(read(spark, sf_dir, "documents"), width=50)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.find(read(spark, sf_dir, "documents")).drop("h")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group(read(spark, sf_dir, "documents"))


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract(read(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_pii, op3_quality_classifier, op4_ngram_jaccard, op5_nearest_neighbours, op6_lm_score, op7_chat_format, op8_mix_sources, op9_suffix_array_dedup, op10_paragraph_dedup, op11_lexical_search, op12_spelling_variants, op13_html_extraction)}
ORACLE: dict[str, str] = {}
ORACLE["op7_chat_format"] = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, regexp_replace(replace(text, '\', '\\'), '(\[)(/?SYS\]|/?INST\]|/?TURN\]|TEXT\])|(<)(/?s>)', '\1\3\\\2\4', 'g') AS x,
  CASE role WHEN 'system' THEN 11 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 19 + length(regexp_replace(replace(role, '\', '\\'), '(\[)(/?SYS\]|/?INST\]|/?TURN\]|TEXT\])|(<)(/?s>)', '\1\3\\\2\4', 'g')) END AS marks,
  lag(role, 1, '') OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS was,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos FROM t),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos) AS whole,
  coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '') AS trained, CAST(sum(length(x) + marks) AS BIGINT) AS formatted_chars,
  CAST(min(pos) FILTER (NOT ((was = '' AND pos = 1 AND role IN ('system', 'user')) OR (was = 'system' AND role = 'user') OR (was = 'user' AND role = 'assistant') OR (was = 'assistant' AND role = 'user'))) AS INT) AS bad_turn,
  max_by(role, pos) AS last FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, CAST(length(trained) AS BIGINT) AS loss_chars, sha256(trained) AS loss_sha256, formatted_chars,
  bad_turn IS NULL AND last = 'assistant' AS valid, bad_turn FROM g
"""

_WORDS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_SHINGLES = "list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)"
ORACLE["op1_decontaminate"] = f"""
WITH d AS (SELECT doc_id, unnest(s) AS s FROM (SELECT doc_id, {_SHINGLES} AS s FROM (SELECT doc_id, {_WORDS} AS w FROM documents))),
b AS (SELECT item_id, len(s) AS n_item, unnest(s) AS s FROM (SELECT item_id, {_SHINGLES} AS s FROM (SELECT item_id, {_WORDS} AS w FROM benchmark)))
SELECT doc_id, item_id, n_item, count(*) AS n_shared, count(*) / n_item AS containment
FROM d JOIN b USING (s) GROUP BY doc_id, item_id, n_item HAVING 100 * count(*) >= 75 * n_item
"""
_TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
ORACLE["op11_lexical_search"] = f"""
WITH d AS (SELECT doc_id, len(t) AS n, t FROM (SELECT doc_id, {_TERMS} AS t FROM documents) WHERE len(t) > 0),
s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM d),
b AS (SELECT item_id, unnest(list_distinct({_TERMS})) AS term FROM benchmark),
o AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM b) GROUP BY ALL),
f AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM o, s GROUP BY term, docs),
r AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms)))) AS BIGINT) AS score
  FROM b JOIN o USING (term) JOIN f USING (term), s GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0) WHERE rank <= 50
"""
