"""Page walks: where a sequence of pages ends, and which rows count before it.

Windows run per source (a board or category), over pages, not over rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _before_first(pages: DataFrame, stop: Column, by: list[str], including: bool = False) -> DataFrame:
    w = Window.partitionBy(*by).orderBy("page").rowsBetween(Window.unboundedPreceding, -1 if including else 0)
    return pages.withColumn("_stop", stop.cast("int")).withColumn("_so_far", F.coalesce(F.sum("_stop").over(w), F.lit(0))).where("_so_far = 0").drop("_stop", "_so_far")


def signatures(rows: DataFrame, by: list[str], text: str, pos: str = "pos", prefix: int = 50) -> DataFrame:
    """by, page, n, signature: the first and last rows' starts and the count of a page."""
    edge = lambda f: f(F.substring(text, 1, prefix), pos)  # noqa: E731  only the starts are shuffled
    page = rows.groupBy(*by, "page").agg(F.count("*").alias("n"), edge(F.min_by).alias("first"), edge(F.max_by).alias("last"))
    return page.select(*by, "page", "n", F.concat_ws("||", "first", "last", F.col("n").cast("string")).alias("signature"))


def until_repeat(pages: DataFrame, by: list[str], most: int | None = None) -> DataFrame:
    """Pages before the first whose signature equals its predecessor's (W1), at most ``most`` (O2)."""
    w = Window.partitionBy(*by).orderBy("page")
    kept = pages if most is None else pages.where(F.col("page") <= most)
    kept = kept.withColumn("_was", F.lag("signature", 1, "").over(w))
    return _before_first(kept, F.col("signature") == F.col("_was"), by).drop("_was")


def until_count(pages: DataFrame, by: list[str]) -> DataFrame:
    """Pages up to the one that reaches the total, none from the first empty one on (W5); columns n, rows, total."""
    filled = _before_first(pages, F.col("n") == 0, by)
    return _before_first(filled, F.col("page") * F.col("rows") >= F.col("total"), by, including=True)


def until_sentinel(rows: DataFrame, by: list[str], cells: str = "cells", least: int = 4, words: tuple[str, ...] = ("없습니다", "데이터")) -> DataFrame:
    """Rows of enough cells before the first of their page whose first cell holds a sentinel word."""
    hit = F.lit(False)
    for word in words:
        hit = hit | F.get(cells, F.lit(0)).contains(word)
    w = Window.partitionBy(*by, "page").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.where(F.size(cells) >= least).withColumn("_hit", hit.cast("int")).withColumn("_hit", F.max("_hit").over(w)).where("_hit = 0").drop("_hit")


def without_sentinel(rows: DataFrame, cells: str = "cells", least: int = 2, words: tuple[str, ...] = ("없습니다", "데이터")) -> DataFrame:
    """Rows of enough cells, but for those whose first cell holds a sentinel word."""
    hit = F.lit(False)
    for word in words:
        hit = hit | F.get(cells, F.lit(0)).contains(word)
    return rows.where((F.size(cells) >= least) & ~hit)


def running_total(pages: DataFrame, by: list[str], n: str = "n") -> DataFrame:
    """The rows so far after each page."""
    return pages.withColumn("so_far", F.sum(n).over(Window.partitionBy(*by).orderBy("page").rowsBetween(Window.unboundedPreceding, 0)))


def ordinals(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Numbers from 1 within by."""
    return rows.withColumn("ordinal", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))


def gaps(pages: DataFrame, by: list[str], last: Column | None = None) -> DataFrame:
    """by, first, last of each run of page numbers from 1 that pages lack, up to ``last`` (a column of by; else to the largest page there is).

    Pages that follow one another form islands: page minus row number is the same for all of one. Windows run over islands' ends only.
    """
    ranked = pages.select(*by, F.col("page").cast("long").alias("page")).distinct()
    island = F.col("page") - F.row_number().over(Window.partitionBy(*by).orderBy("page"))
    islands = ranked.withColumn("_island", island).groupBy(*by, "_island").agg(F.min("page").alias("a"), F.max("page").alias("b"))
    w = Window.partitionBy(*by).orderBy("a")
    before = islands.select(*by, (F.coalesce(F.lag("b").over(w), F.lit(0)) + 1).alias("first"), (F.col("a") - 1).alias("last"))
    found = before.where(F.col("first") <= F.col("last"))
    if last is None:
        return found
    ends = pages.groupBy(*by).agg(F.coalesce(F.max("page"), F.lit(0)).cast("long").alias("b")) if by else pages.agg(F.coalesce(F.max("page"), F.lit(0)).cast("long").alias("b"))
    after = ends.select(*by, (F.col("b") + 1).alias("first"), last.cast("long").alias("last"))
    return found.unionByName(after.where(F.col("first") <= F.col("last")))


def pending(rows: DataFrame, wanted: DataFrame, key: str = "key", file: str = "has_file") -> DataFrame:
    """key, outcome, page of each wanted key (J4): a walk over the pages in order takes a key at the first row that shows it; it ends when none is pending, or before the first page without rows.

    rows: page (from 1), pos, key, has_file. outcome: success, failed (its row has no file), pending (the walk ended before). Every page up to there is walked, however many there are.
    """
    listed = rows.select("page").distinct()
    whole = listed.withColumn("_n", F.row_number().over(Window.orderBy("page"))).where("_n = page").select("page")
    shown = rows.join(wanted.select(key).distinct(), key, "left_semi").join(whole, "page", "left_semi")
    place = F.struct("page", "pos")
    first = shown.groupBy(key).agg(F.min_by(file, place).alias("_file"), F.min("page").alias("page"))
    told = F.when(F.col("page").isNull(), "pending").when(F.col("_file"), "success").otherwise("failed")
    return wanted.select(key).distinct().join(first, key, "left").select(key, told.alias("outcome"), "page")


def shrinking(outcomes: DataFrame) -> DataFrame:
    """page, n_success, n_failed, n_left: what is still pending after each page on which something was taken."""
    by_page = outcomes.groupBy("page").agg(F.count_if(F.col("outcome") == "success").alias("n_success"), F.count_if(F.col("outcome") == "failed").alias("n_failed"), F.count("*").alias("_n"))
    total = F.sum("_n").over(Window.partitionBy())
    taken = F.sum(F.when(F.col("page").isNotNull(), F.col("_n"))).over(Window.orderBy(F.col("page").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0))
    return by_page.select("page", "n_success", "n_failed", (total - taken).alias("n_left")).where("page IS NOT NULL")
