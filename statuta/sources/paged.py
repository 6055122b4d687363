"""Paged JSON services: a Python data source with pages as its partitions, in batches and as a stream, and the same pages made from a table.

Options of the format ``paged_json``: url, first and pages, or ranges ("3-3,7-9"): the pages read; query (JSON object of fixed parameters), page_param, timeout,
delay (pause after each call), attempts, concurrency (how many calls may run at once: the partitions, one unless said otherwise). Failed
calls are repeated with growing pauses; what still fails is a row with its error, and no page after it is lost. As a stream the offset is the next page;
root names where an answer tells how many entries there are, known the last page that is stored.
"""

from __future__ import annotations

import json
import time
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from statuta.checkpoints import kept
from statuta.functions.json_ import Envelope, counts, items, list_entries
from statuta.operators.walk import gaps, until_count
from statuta.sources.pacing import paced

# Timeout in seconds, attempts, and pause between calls.
TIMEOUT, ATTEMPTS, DELAY = 30.0, 3, 1.0
PAGE = "page long, body string, error string"


def fetch(url: str, *, timeout: float = TIMEOUT, attempts: int = ATTEMPTS, delay: float = DELAY) -> tuple[str | None, str | None]:
    """(body, error): malformed JSON and failed calls are tried again after delay times the attempt."""
    error = None
    for attempt in range(1, attempts + 1):
        try:
            with urllib.request.urlopen(url, timeout=timeout) as answer:
                body = answer.read().decode("utf-8")
            json.loads(body)
            return body, None
        except (OSError, ValueError) as e:
            error = f"{type(e).__name__}: {e}"
            if attempt < attempts:
                time.sleep(delay * attempt)
    return None, error


class PagedJson(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return PAGE

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options)


class _Pages:
    """Reading of pages, in batches and streams alike."""

    def __init__(self, options) -> None:
        self.options = dict(options)

    def call(self, page: int) -> tuple[str | None, str | None]:
        o = self.options
        query = json.loads(o.get("query", "{}")) | {o.get("page_param", "page"): page}
        delay = float(o.get("delay", DELAY))
        got = fetch(f"{o['url']}?{urllib.parse.urlencode(query)}", timeout=float(o.get("timeout", TIMEOUT)), attempts=int(o.get("attempts", ATTEMPTS)), delay=delay)
        time.sleep(delay)
        return got

    def dealt(self, pages: list[int]) -> list[InputPartition]:
        side = min(int(self.options.get("concurrency", 1)), len(pages))
        return [InputPartition(pages[i::side]) for i in range(side)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for page in partition.value:
            yield page, *self.call(page)


class _Reader(_Pages, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        o = self.options
        ranges = o.get("ranges") or f"{o.get('first', 1)}-{o.get('pages', 1)}"
        return self.dealt([page for part in ranges.split(",") for page in range(int(part.split("-")[0]), int(part.split("-")[1]) + 1)])


class _StreamReader(_Pages, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"next": 1}

    def latestOffset(self) -> dict:
        """The page after the last one that the first page tells of; where that fails, the first page is still read, so that its error is a row."""
        body, _ = self.call(1)
        told = json.loads(body).get(self.options.get("root", ""), {}) if body else {}
        last = -(-int(told.get("totalCnt", 0)) // max(int(told.get("numOfRows", 100)), 1))
        return {"next": max(last, int(self.options.get("known", 0)), 1) + 1}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return self.dealt(list(range(start["next"], end["next"])))


def details(ids: DataFrame, url: str, *, param: str = "ID", delay: float = DELAY, attempts: int = ATTEMPTS, timeout: float = TIMEOUT, concurrency: int = 1) -> DataFrame:
    """id, body, error of each id's detail document (S3, S6, S9); at most ``concurrency`` calls at once (R2). ids: id, and url where each has its own."""
    base = F.col("url") if "url" in ids.columns else F.lit(url)
    wanted = ids.select("id", F.concat(base, F.lit(f"?{param}="), F.url_encode(F.col("id").cast("string"))).alias("url"))
    return paced(wanted, lambda row: (row[0], *fetch(row[1], timeout=timeout, attempts=attempts, delay=delay)), "id string, body string, error string", delay=delay, in_flight=concurrency)


def variants(details: DataFrame) -> DataFrame:
    """id, outcome, document of detail bodies (id, body): each body as it is, read on demand (X17). outcome: found, empty (no body, or an empty one), malformed."""
    document = F.try_parse_json("body")
    empty = F.coalesce(F.trim("body"), F.lit("")).isin("", "null", "{}", "[]", '""')
    told = F.when(empty, "empty").when(document.isNull(), "malformed").otherwise("found")
    return details.select("id", told.alias("outcome"), F.when(~empty, document).alias("document"))


def read(spark: SparkSession, url: str, pages: int = 1, **options: object) -> DataFrame:
    spark.dataSource.register(PagedJson)
    return spark.read.format("paged_json").options(url=url, pages=pages, **{k: str(v) for k, v in options.items()}).load()


def settled(pages: DataFrame) -> DataFrame:
    """One row (page, body, error) for each page that was asked for, once or again: with its body if any call gave one, else with an error."""
    got = pages.groupBy("page").agg(F.min_by(F.struct("body", "error"), F.struct(F.col("body").isNull(), "error")).alias("r"))
    return got.select("page", "r.body", F.when(F.col("r.body").isNull(), F.col("r.error")).alias("error"))


def entries(pages: DataFrame, envelope: Envelope) -> DataFrame:
    """page, pos, id, name, error of a list (S2, S5, S8) from its settled pages: the entries of every page that was read, and for each failed page a row with its
    error alone. The list ends before its first empty page and after the page that reaches the total (W5); a failed page ends nothing."""
    good, body = F.col("body").isNotNull(), F.col("body")
    total, rows = counts(body, envelope)
    n = F.when(good, F.coalesce(F.size(items(body, envelope)), F.lit(0)))
    sized = pages.select("page", n.alias("n"), F.when(good, rows).alias("rows"), F.when(good, total).alias("total"), F.lit(1).alias("service"))
    sized = sized.withColumn("total", F.max("total").over(Window.partitionBy("service")))  # a list may have grown between runs
    within = pages.join(until_count(sized, ["service"]).select("page"), "page")
    failed = within.where(~good).select("page", F.lit(None).cast("int").alias("pos"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("name"), F.coalesce("error", F.lit("no answer")).alias("error"))
    return list_entries(within.where(good), envelope).withColumn("error", F.lit(None).cast("string")).unionByName(failed)


def walk(spark: SparkSession, url: str, envelope: Envelope, **options: object) -> DataFrame:
    """The entries of a whole list in one go: the first page tells how many there are, the others are planned from it. Nothing is left out silently: see entries()."""
    first = kept(read(spark, url, 1, **options))
    total, rows = first.select(*counts(F.col("body"), envelope)).first()
    last = -(-total // max(rows, 1))
    return entries(first.unionByName(kept(read(spark, url, last, first=2, **options))) if last > 1 else first, envelope)


def _there(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """The settled pages of a walk's store."""
    return settled(spark.read.schema(PAGE).parquet(f"{folder}/pages"))


def resume(spark: SparkSession, url: str, envelope: Envelope, folder: str, **options: object) -> DataFrame:
    """Starts or goes on with a walk that is stored in folder, and gives its entries.

    Pages that the store lacks, or has only errors of, are asked for first, by ranges; then a stream takes the pages that no run has reached. It
    ends where the service says that the list ends, and its offset is in the folder: a run that is broken off goes on at the page it had come to.
    Pages asked for twice settle to one row, so a batch that runs again does no harm.
    """
    spark.dataSource.register(PagedJson)
    options = {k: str(v) for k, v in options.items()}
    known = 0
    if _there(spark, f"{folder}/pages"):
        there = stored(spark, folder)
        known = there.agg(F.max("page")).first()[0] or 0
        missing = gaps(there.where("body IS NOT NULL"), [], last=F.lit(known))
        if ranges := ",".join(f"{r['first']}-{r['last']}" for r in missing.orderBy("first").toLocalIterator()):
            read(spark, url, ranges=ranges, **options).write.mode("append").parquet(f"{folder}/pages")
    fresh = spark.readStream.format("paged_json").options(url=url, root=envelope.root, known=known, **options).load()
    keep = lambda batch, _: batch.write.mode("append").parquet(f"{folder}/pages")
    fresh.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return entries(stored(spark, folder), envelope)


def serve(listed: DataFrame, size: int = 100, root: str = "PrecSearch", name: str = "prec", total: int | None = None) -> DataFrame:
    """page and body as a service would send records (id, name, doc_id in order), with the total that it would tell; a page of one item is an object."""
    entry = F.to_json(F.struct(F.col("id").alias("판례일련번호"), F.col("name").alias("사건명")))
    paged = listed.select(F.floor(F.col("doc_id") / size).alias("page"), F.struct("doc_id", entry.alias("e")).alias("e")).groupBy("page").agg(F.sort_array(F.collect_list("e")).alias("e"))
    listed = F.array_join(F.transform("e", lambda x: x["e"]), ",")
    inner = F.when(F.size("e") == 1, listed).otherwise(F.concat(F.lit("["), listed, F.lit("]")))
    return paged.select("page", F.concat(F.lit(f'{{"{root}":{{"{name}":'), inner, F.lit("}}" if total is None else f',"totalCnt":"{total}","numOfRows":"{size}"}}}}')).alias("body"))


def collect(pages: DataFrame, envelope: Envelope) -> DataFrame:
    """The entries of fetched pages, one per id, at its first place (Q12)."""
    return list_entries(pages, envelope).groupBy("id").agg(F.min_by("name", F.struct("page", "pos")).alias("name"))


def report(found: DataFrame) -> DataFrame:
    """n_entries, n_ids, n_again, n_failed of a list's entries (Q12): an id that is listed again counts as skipped; failed pages are told apart."""
    by = found.groupBy("id").agg(F.count("*").alias("n"))
    return by.agg(F.coalesce(F.sum(F.when(F.col("id").isNotNull(), F.col("n"))), F.lit(0)).alias("n_entries"), F.count("id").alias("n_ids"), F.coalesce(F.sum(F.when(F.col("id").isNotNull(), F.col("n") - 1)), F.lit(0)).alias("n_again"),
                  F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("n_failed"))
