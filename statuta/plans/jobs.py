"""The three jobs from a service to parsed records, run again at any time: what is there already is left out, what failed is tried anew.

Folders are ones that the driver and all executors reach.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.checkpoints import kept
from statuta.functions.json_ import Envelope
from statuta.functions.text import case_identifier, composite_key, normalize
from statuta.operators import builders, records
from statuta.sources import boards, decode, paged
from statuta.streaming import incremental


@dataclass(frozen=True)
class Settings:
    """How a job calls services (S22, R1, R2): pause after each call, time to wait, attempts, calls at once to a host, pages of a list at most."""

    delay: float = paged.DELAY
    timeout: float = paged.TIMEOUT
    attempts: int = paged.ATTEMPTS
    concurrency: int = 1
    most_pages: int | None = None

    def __post_init__(self) -> None:
        if self.delay < 0 or self.timeout <= 0 or self.attempts < 1 or self.concurrency < 1 or self.most_pages is not None and self.most_pages < 1:
            raise ValueError(f"not usable: {self}")

    def calls(self) -> dict:
        return {"delay": self.delay, "timeout": self.timeout, "attempts": self.attempts, "concurrency": self.concurrency}


DETAIL = "id string, body string"


def documents(spark: SparkSession, list_url: str, detail_url: str, envelope: Envelope, folder: str, *, param: str = "ID", settings: Settings = Settings()) -> DataFrame:
    """A list and the details of its entries (S1 to S9, J3, K3): outcome, n of this run; the details are in incremental.held(folder/details).

    Outcomes are those of ids: skipped (stored by an earlier run, or listed again), success, failed (no answer, or an empty one); failed list pages count as failed_page.
    """
    found = kept(paged.resume(spark, list_url, envelope, f"{folder}/list", **settings.calls()))
    store = f"{folder}/details"
    ids = found.where("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("n"))
    there = incremental.held(spark, store, DETAIL).select("id")
    fetched = kept(paged.details(records.missing(ids, there, "id"), detail_url, param=param, **settings.calls()))
    told = paged.variants(fetched).select("id", "outcome")
    good = told.where("outcome = 'found'").select("id")
    incremental.append_new(fetched.join(good, "id", "left_semi").select("id", "body"), store, "id")
    one = lambda rows, outcome, n: rows.select(F.lit(outcome).alias("outcome"), n.alias("n"))
    again = ids.select(F.lit("skipped").alias("outcome"), (F.col("n") - 1).alias("n"))
    every = again.unionByName(one(records.found(ids, there.distinct(), "id"), "skipped", F.lit(1))).unionByName(one(told.where("outcome = 'found'"), "success", F.lit(1)))
    every = every.unionByName(one(told.where("outcome <> 'found'"), "failed", F.lit(1))).unionByName(one(found.where("id IS NULL"), "failed_page", F.lit(1)))
    return kept(every.groupBy("outcome").agg(F.sum("n").alias("n")).where("n > 0"))


def contracts(spark: SparkSession, pages: DataFrame, folder: str, *, category: str | None = None, skip_download: bool = False, settings: Settings = Settings()) -> DataFrame:
    """Contract boards to parsed contracts by category (S10, S12, S14, P6, K4, R4, Q5, Q7): outcome, n of the files of this run; records are in folder/parsed.

    pages: category, page, html. A category is honoured with and without download; the other categories' records stay. Files under any of the suffixes count as there.
    """
    asked = pages.join(F.broadcast(builders.chosen(spark, category).select("category")), "category")
    items = kept(boards.contract_items(asked, **({"most": settings.most_pages} if settings.most_pages else {})))
    attached = items.select("카테고리", "제목", F.explode("첨부파일").alias("f")).where("f.file_id <> ''")
    wanted = attached.select(F.col("f.file_id").alias("file_id"), builders.file_name(F.col("카테고리"), F.col("제목"), F.col("f.file_id")).alias("name"), F.col("f.download_url").alias("url")).dropDuplicates(["file_id"])
    files, told = f"{folder}/files", []
    if not skip_download:
        there = decode.stems(spark, files).select(F.concat("name", F.lit(".hwp")).alias("name")).distinct()
        got = kept(boards.downloads(wanted.select(F.col("file_id").alias("id"), "name", "url"), there, suffix=".hwp", delay=settings.delay, timeout=settings.timeout, concurrency=settings.concurrency))
        boards.save_files(got, files)
        told.append(got.select("outcome"))
    texts = kept(decode.reparse(spark, files, wanted.select("file_id", "name")))
    builders.merge_categories(builders.parsed_contracts(items, texts), f"{folder}/parsed")
    told.append(texts.select(F.when(F.col("text") != "", "parsed").otherwise("not_parsed").alias("outcome")))
    return kept(records.outcomes(records.concatenated(told), F.col("outcome")))


def decisions(spark: SparkSession, pages: DataFrame, folder: str, *, text_of: Callable[[DataFrame], DataFrame] | None = None, settings: Settings = Settings()) -> DataFrame:
    """Decision lists to parsed decisions (S11, A4, A7, S15, S21, P7): n_before, n_after, n_removed of the dedup; cases are in folder/cases, records in folder/parsed.

    pages: board, page, html. Cases of one number, decision and title are one, the one of the lowest page. Their files are in folder/files by case identifier; text_of gives
    name and text of them (file_id, name), by default as decode.reparse reads them.
    """
    rows = kept(boards.case_records(pages, **({"most": settings.most_pages} if settings.most_pages else {})))
    cell = lambda k: F.coalesce(F.col("셀_데이터")[k], F.lit(""))
    key = composite_key(normalize(cell("사건번호")), normalize(cell("의결번호")), F.col("사건명"))
    best = kept(records.dedup_lowest_page(rows, key, page="수집_페이지", order=["board", "수집_페이지", "pos"]).drop("first_place"))
    records.save(best.drop("dedup_key"), f"{folder}/cases")
    named = best.withColumn("name", case_identifier(cell("사건번호"), cell("의결번호"), F.col("사건명"), F.xxhash64("dedup_key")))
    wanted = named.select(F.col("dedup_key").alias("file_id"), "name")
    texts = text_of(wanted) if text_of else decode.reparse(spark, f"{folder}/files", wanted)
    parsed = named.select("dedup_key", "사건명", "셀_데이터").join(texts.select(F.col("file_id").alias("dedup_key"), "name", "text"), "dedup_key")
    records.save(builders.parsed_cases(parsed).drop("dedup_key"), f"{folder}/parsed")
    return records.dedup_report(rows, key)
