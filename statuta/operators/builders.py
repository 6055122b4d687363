"""Record builders: board rows become items, cases and parsed records (P1, P5, P6, P7), by category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.checkpoints import kept
from statuta.functions import rules
from statuta.functions.html import named_cells, with_title
from statuta.functions.text import case_identifier, or_empty, safe_name, strip
from statuta.operators.records import by_category, last_wins

# Categories of contract boards with their board numbers and keys.
CATEGORIES = {
    "표준약관": ("201", "202"),
    "표준하도급계약서": ("202", "203"),
    "표준가맹계약서": ("203", "204"),
    "표준유통거래계약서": ("204", "205"),
    "표준대리점거래계약서": ("205", "206"),
    "표준비밀유지계약서": ("206", "207"),
}
# Where files are loaded from, how a file's number shows in a link, and the constants of case records.
DOWNLOAD_URL = "https://www.ftc.go.kr/www/downloadBbsFile.do"
FILE_LINK, FILE_NUMBER = "downloadBbsFile", "atchmnflNo=([0-9]+)"
SOURCE, CASE_CATEGORY = "공정거래위원회 심결례", "불공정약관"
RISK, RISK_REASON = "High", "공정위 시정조치 대상 = 위반 확정"
OTHERS = "기타"


def registry(spark: SparkSession) -> DataFrame:
    """category, bordCd, key of every category."""
    return spark.createDataFrame([(k, board, key, i) for i, (k, (board, key)) in enumerate(CATEGORIES.items())], "category string, bordCd string, key string, place int")


def chosen(spark: SparkSession, category: str | None = None) -> DataFrame:
    """The registry, or its row of one category; an unknown one is an error that names those there are."""
    if category is not None and category not in CATEGORIES:
        raise ValueError(f"unknown category {category!r}; there are {', '.join(CATEGORIES)}")
    rows = registry(spark)
    return rows if category is None else rows.where(F.col("category") == category)


def items(rows: DataFrame) -> DataFrame:
    """An item for each board row of four cells or more: its texts, category and attachments (P1); other columns stay.

    rows: category, cells array<string>, title_link string (null: no link), hrefs array<string> of the attachment cell.
    """
    cell = lambda i: strip(or_empty(F.get("cells", F.lit(i))))
    number = lambda h: F.regexp_extract(h, FILE_NUMBER, 1)
    files = F.filter(F.transform(F.filter("hrefs", lambda h: h.contains(FILE_LINK)), number), lambda n: n != "")
    attached = F.when(F.size("cells") > 4, F.transform(files, lambda n: F.struct(n.alias("file_id"), F.concat(F.lit(f"{DOWNLOAD_URL}?atchmnflNo="), n).alias("download_url"))))
    rest = [c for c in rows.columns if c not in ("category", "cells", "title_link", "hrefs")]
    return rows.where(F.size("cells") >= 4).select(
        *rest, cell(0).alias("번호"), F.coalesce(strip(F.col("title_link")), cell(1)).alias("제목"), cell(2).alias("담당부서"), cell(3).alias("등록일"), F.col("category").alias("카테고리"),
        F.coalesce(attached, F.array().cast("array<struct<file_id:string,download_url:string>>")).alias("첨부파일"))


def file_name(item_category: Column, title: Column, file_id: Column) -> Column:
    """The safe name under which an attachment is kept, without suffix."""
    return safe_name(F.concat_ws("_", item_category, title, file_id))


def cases(rows: DataFrame) -> DataFrame:
    """A case record for each row of a decision list (P5); rows: page, header and cells array<string>, link string, pdf_info struct."""
    title = or_empty(F.col("link"))
    rest = [c for c in rows.columns if c not in ("page", "header", "cells", "link", "pdf_info")]
    return rows.select(*rest, title.alias("사건명"), with_title(named_cells(F.col("header"), F.col("cells")), title).alias("셀_데이터"), "pdf_info", F.lit(SOURCE).alias("출처"), F.lit(CASE_CATEGORY).alias("카테고리"), F.col("page").alias("수집_페이지"))


def case_files(cases: DataFrame, files: DataFrame, compat_title_key: bool = False) -> DataFrame:
    """cases with the path of their file (S21, J2, X5, Q1): files (name without suffix, path, title, ord) are found by the case's own identifier; cases without a file go.

    cases: 사건번호, 의결번호, 사건명, ord. compat_title_key: files are known by title alone, the last one registered for all cases of a title.
    """
    if compat_title_key:
        return cases.join(last_wins(files.withColumnRenamed("title", "사건명"), "사건명", "path", "ord"), "사건명")
    name = case_identifier(F.col("사건번호"), F.col("의결번호"), F.col("사건명"), F.col("ord"))
    return cases.withColumn("name", name).join(files.groupBy("name").agg(F.max_by("path", "ord").alias("path")), "name")


def parsed_contracts(listed: DataFrame, texts: DataFrame) -> DataFrame:
    """A record for each attachment whose file gave a text (P6, F7); listed: items; texts: file_id, name, text."""
    files = listed.select("제목", "카테고리", "담당부서", "등록일", F.explode("첨부파일").alias("f")).select("제목", "카테고리", "담당부서", "등록일", F.col("f.file_id").alias("file_id"))
    named = files.where("file_id <> ''").join(texts.where("text <> ''"), "file_id")
    return named.select("제목", "카테고리", "담당부서", "등록일", F.col("file_id").alias("파일ID"), F.col("name").alias("원본_파일명"), F.length("text").alias("텍스트_길이"), F.col("text").alias("추출_텍스트"))


def parsed_cases(texts: DataFrame) -> DataFrame:
    """A record for each decision that gave a text: its clauses, kinds of violation, legal bases and corrections (P7, E1 to E4, F7); other columns stay.

    texts: 사건명, 셀_데이터, name, text.
    """
    t = F.col("text")
    rest = [c for c in texts.columns if c not in ("사건명", "셀_데이터", "name", "text")]
    return texts.where("text <> ''").select(
        *rest, or_empty(F.col("사건명")).alias("사건명"), "셀_데이터", F.col("name").alias("pdf_파일"), F.length(t).alias("전체_텍스트_길이"), rules.clauses(t).alias("조항_원문"), rules.violations(t).alias("위반_유형"),
        rules.legal_bases(t).alias("근거_법령"), rules.corrections(t).alias("시정_내용"), F.lit(RISK).alias("risk_level"), F.lit(RISK_REASON).alias("risk_level_근거"))


def category_of(category: Column) -> Column:
    """The category, or the default one where there is none."""
    return F.coalesce(F.nullif(category, F.lit("")), F.lit(OTHERS))


def categorised(rows: DataFrame, category: str = "카테고리", size: int = 1000) -> DataFrame:
    """Envelopes of a category's records: category, part, 총_건수 (of the whole category) and 사례 of at most about ``size`` records (A2, K4).

    A category of any size is spread over parts by a hash of its records, so no task holds one whole.
    """
    rows = rows.withColumn(category, category_of(F.col(category)))
    totals = by_category(rows, F.col(category))
    record = F.struct(*rows.columns)
    dealt = rows.select(F.col(category).alias("category"), record.alias("r"), F.xxhash64(F.to_json(record)).alias("h")).join(F.broadcast(totals), "category")
    part = F.pmod("h", F.ceil(F.col("n") / size))
    return dealt.groupBy("category", F.col("n").alias("총_건수"), part.alias("part")).agg(F.collect_list("r").alias("사례"))


def save_categories(rows: DataFrame, path: str, category: str = "카테고리") -> None:
    """JSON lines of the records in a folder for each category, named by its safe name (K4)."""
    name = F.concat(F.lit("contracts_"), safe_name(category_of(F.col(category))))
    rows.withColumn("_folder", name).repartition("_folder", F.pmod(F.xxhash64(*rows.columns[:1]), F.lit(16))).write.mode("overwrite").partitionBy("_folder").json(path)


def merge_categories(rows: DataFrame, path: str, key: str = "파일ID", category: str = "카테고리") -> None:
    """Adds records to the folders of their categories (K4, Q7): of a key that is there already the new record stays; categories that rows lack are not touched.

    Only the folders of the categories in rows are read, and only these are replaced.
    """
    spark = rows.sparkSession
    new = rows.withColumn("_folder", F.concat(F.lit("contracts_"), safe_name(category_of(F.col(category)))))
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    every = new.withColumn("_new", F.lit(1))
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        touched = [r["_folder"] for r in new.select("_folder").distinct().toLocalIterator()]  # a category each
        every = every.unionByName(spark.read.schema(new.schema).json(path).where(F.col("_folder").isin(touched)).withColumn("_new", F.lit(0)))
    best = every.groupBy("_folder", key).agg(F.max_by(F.struct(*rows.columns), "_new").alias("_r")).select("_r.*", "_folder")
    kept(best).repartition("_folder", F.pmod(F.xxhash64(key), F.lit(16))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_folder").json(path)
