"""Dedup, lookups, outcomes and envelopes over collected records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FAR_PAGE = 10**9


def dedup_lowest_page(rows: DataFrame, key: Column, page: str = "page", order: list[str] | None = None) -> DataFrame:
    """One row per non-empty key: the one of the lowest page, earlier rows first on ties; ord is the key's first place (A4, F8).

    min_by aggregates partially before the shuffle, so a frequent key costs one row per task. Rows without a key go after it: a filter on the
    key before it would work out the key's expression twice.
    """
    place = F.struct(*(order or ["page", "pos"]))
    ranked = rows.withColumns({"_key": key, "_place": place})
    record = F.struct(*rows.columns)
    best = F.min_by(record, F.struct(F.coalesce(F.col(page), F.lit(FAR_PAGE)).alias("p"), F.col("_place").alias("o")))
    grouped = ranked.groupBy("_key").agg(best.alias("_r"), F.min("_place").alias("_first"), F.max(F.length("_key")).alias("_size"))
    return grouped.where("_size > 0").select(F.col("_key").alias("dedup_key"), "_r.*", F.col("_first").alias("first_place"))


def dedup_report(rows: DataFrame, key: Column) -> DataFrame:
    """before, after, removed (A7), in one pass."""
    filled = F.nullif(key, F.lit(""))
    counted = rows.groupBy(filled.alias("k")).agg(F.count("*").alias("n"))
    return counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_before"), F.count("k").alias("n_after")).withColumn("n_removed", F.col("n_before") - F.col("n_after"))


def last_wins(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """key -> value of its last row (A10)."""
    return rows.groupBy(key).agg(F.max_by(value, order).alias(value))


def missing(wanted: DataFrame, there: DataFrame, key: str) -> DataFrame:
    """Wanted rows that are not there yet."""
    return wanted.join(there.select(key), key, "left_anti")


def found(wanted: DataFrame, there: DataFrame, key: str) -> DataFrame:
    """Wanted rows that are there already: skipped."""
    return wanted.join(there.select(key), key, "left_semi")


def best_extension(items: DataFrame, listing: DataFrame, key: str, extensions: tuple[str, ...]) -> DataFrame:
    """For each key the listed file of the first extension in order (J6); listing: (key, extension, path)."""
    rank = F.array_position(F.array(*[F.lit(x) for x in extensions]), F.col("extension"))
    ranked = listing.withColumn("_rank", rank).where("_rank > 0")
    return items.join(ranked.groupBy(key).agg(F.min_by("path", F.struct("_rank", "path")).alias("path")), key)


def outcomes(rows: DataFrame, outcome: Column) -> DataFrame:
    """How many rows had each outcome."""
    return rows.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def by_category(rows: DataFrame, category: Column, default: str = "기타") -> DataFrame:
    """Rows per category, those without one under the default (A2, A3)."""
    return rows.groupBy(F.coalesce(F.nullif(category, F.lit("")), F.lit(default)).alias("category")).agg(F.count("*").alias("n"))


def concatenated(parts: list[DataFrame]) -> DataFrame:
    """All rows of the parts, in their order by part."""
    out = None
    for i, part in enumerate(parts):
        part = part.withColumn("part", F.lit(i))
        out = part if out is None else out.unionByName(part)
    return out


def envelope_chunks(rows: DataFrame, order: Column, size: int, **metadata: Column) -> DataFrame:
    """chunk, count and JSON of at most size records each, in order within a chunk (K5). For whole files write the rows as JSON lines instead."""
    chunk = F.floor(order / size)
    grouped = rows.groupBy(chunk.alias("chunk")).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct(order.alias("o"), F.struct(*rows.columns).alias("r")))).alias("_rows"))
    body = F.struct(F.col("n").alias("총_건수"), *[v.alias(k) for k, v in metadata.items()], F.transform("_rows", lambda x: x["r"]).alias("사례"))
    return grouped.select("chunk", "n", F.to_json(body).alias("body"))


def load_envelope(spark: SparkSession, path: str, record: str) -> DataFrame:
    """The records of enveloped JSON files (S14, S15): one row each; a file without 사례 gives none. record: the records' fields as DDL."""
    return envelopes(spark, path, record).where("outcome = 'record'").select("r.*")


def envelopes(spark: SparkSession, path: str, record: str) -> DataFrame:
    """file, outcome, r of enveloped JSON files: a row for each record, and for a file that gives none a row that says why: "empty", or "broken" where it is no JSON."""
    fields = T.StructType([T.StructField("총_건수", T.LongType()), T.StructField("사례", T.ArrayType(T.StructType.fromDDL(record))), T.StructField("_broken", T.StringType())])
    files = spark.read.schema(fields).option("multiLine", True).option("columnNameOfCorruptRecord", "_broken").json(path)
    rows = files.select(F.input_file_name().alias("file"), F.col("_broken").isNotNull().alias("broken"), F.explode_outer("사례").alias("r"))
    return rows.select("file", F.when(F.col("r").isNotNull(), "record").when(F.col("broken"), "broken").otherwise("empty").alias("outcome"), "r")


def large_envelope(spark: SparkSession, path: str, record: str, indent: int = 4) -> DataFrame:
    """outcome ("record" or "broken") and r of the records of an envelope written with line feeds and an indent, however large: several tasks read one file.

    Within JSON a line feed stands between tokens only, so a line of two indents and a closing brace ends a record and nothing else does (the records are the
    only list of objects at that depth). The file is a text of which such lines are the separators.
    """
    step = " " * 2 * indent
    parts = spark.read.option("lineSep", f"\n{step}}}").text(path)
    body = F.concat(F.regexp_extract("value", rf"(?s)\n{step}(\{{\n.*)\z", 1), F.lit("}"))
    rows = parts.where(F.contains("value", F.lit(f"\n{step}{{\n"))).select(F.from_json(body, T.StructType.fromDDL(record).add("_broken", "string"), {"columnNameOfCorruptRecord": "_broken"}).alias("r"))
    return rows.select(F.when(F.col("r._broken").isNull(), "record").otherwise("broken").alias("outcome"), F.when(F.col("r._broken").isNull(), F.col("r").dropFields("_broken")).alias("r"))


def upsert(rows: DataFrame, there: DataFrame | None, key: str, order: str) -> DataFrame:
    """A store with one row per key (K3): the rows of smallest order, those there already before new ones."""
    every = rows.withColumn("_new", F.lit(1)) if there is None else there.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)))
    best = every.groupBy(key).agg(F.min_by(F.struct(*rows.columns), F.struct("_new", order)).alias("_r"))
    return best.where(F.col(key).isNotNull()).select("_r.*")


def metrics(rows: DataFrame, step: str, outcome: Column) -> DataFrame:
    """step, outcome, n of a run, to be appended to a table of metrics."""
    return outcomes(rows, outcome).select(F.lit(step).alias("step"), "outcome", "n")


def observed(rows: DataFrame, step: str, outcome: Column, kinds: tuple[str, ...]) -> tuple[DataFrame, Observation]:
    """rows, and what will be known of them once they have been written: how many had each outcome of kinds, or another one (K6, A6). No second scan."""
    seen = Observation(step)
    others = F.count_if(~F.coalesce(outcome.isin(*kinds), F.lit(False)))
    return rows.observe(seen, *[F.count_if(outcome == k).alias(k) for k in kinds], others.alias("other")), seen


def observed_metrics(spark: SparkSession, seen: Observation, step: str) -> DataFrame:
    """step, outcome, n of rows that have been written, from what was observed on the way."""
    return spark.createDataFrame([(step, k, n) for k, n in seen.get.items() if n], "step string, outcome string, n long")


def save(rows: DataFrame, path: str, partition_by: str | None = None) -> None:
    """JSON lines, one folder per category if asked for (K1, K4)."""
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).json(path)
