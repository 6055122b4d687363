"""Boards: stored or fetched pages of HTML lists become rows, up to where the list ends (S10, S11), and their files are fetched."""

from __future__ import annotations

import urllib.request
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import PurePath

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from statuta.checkpoints import kept
from statuta.functions.html import CONTRACTS, DECISIONS, ROW, board_table, file_of
from statuta.functions.text import normalize, or_empty, strip
from statuta.operators import builders, walk
from statuta.sources.decode import LEAST_BYTES, file_uri
from statuta.sources.paged import DELAY, TIMEOUT
from statuta.sources.pacing import paced

FOUND = "id string, name string, content binary, length long, outcome string, error string"


# What the two kinds of boards are read for.
OF_CONTRACTS, OF_DECISIONS = ("cells", "title_link", "hrefs"), ("cells", "link", "elements", "hidden", "html")


def _parsed(pages: DataFrame, selectors: tuple, by: list[str], fields: tuple[str, ...] = tuple(ROW.names)) -> DataFrame:
    """by, page, header and the rows of each page's table."""
    read = pages.select(*by, "page", board_table(selectors, fields)("html").alias("t"))
    return read.select(*by, "page", F.col("t.header").alias("header"), F.col("t.rows").alias("rows"))


def _rows(pages: DataFrame, selectors: tuple, by: list[str], fields: tuple[str, ...], change: Callable[[Column], Column] = lambda r: r) -> DataFrame:
    """A row for each body row of each page's table: by, page, pos, header and what the row holds, after ``change``. Pages are parsed once: a walk reads its rows twice, for where it ends and for what is on it."""
    read = _parsed(pages, selectors, by, fields).withColumn("rows", F.transform("rows", change))
    return kept(read).select(*by, "page", "header", F.posexplode("rows").alias("pos", "r")).select(*by, "page", "header", "pos", "r.*")


def _until_repeat(rows: DataFrame, by: list[str], text: Column, most: int, prefix: int = 50) -> DataFrame:
    """The rows of the pages before the first missing one or the first that repeats its predecessor, at most ``most`` pages."""
    signed = walk.signatures(rows.withColumn("_text", text), by, "_text", prefix=prefix)
    there = signed.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("page"))).where("_n = page")
    return rows.join(walk.until_repeat(there, by, most).select(*by, "page"), [*by, "page"])


def contract_items(pages: DataFrame, most: int = 50) -> DataFrame:
    """Items of contract boards (S10, P1) from pages: category, page (from 1), html."""
    rows = _rows(pages, CONTRACTS, ["category"], OF_CONTRACTS)
    first = strip(F.array_join("cells", "\t"))
    kept = walk.until_sentinel(_until_repeat(rows, ["category"], first, most), ["category"])
    return builders.items(kept.select("category", "page", "pos", F.transform("cells", strip).alias("cells"), strip(F.col("title_link")).alias("title_link"), "hrefs"))


def case_records(pages: DataFrame, most: int = 250) -> DataFrame:
    """Case records of decision lists (S11, P5) from pages: board, page (from 1), html."""
    rows = _rows(pages, DECISIONS, ["board"], OF_DECISIONS, lambda r: r.withField("cells", F.transform(r["cells"], normalize)).withField("link", normalize(or_empty(r["link"]))))
    kept = _until_repeat(walk.without_sentinel(rows), ["board"], F.col("link"), most, prefix=1 << 30)
    info = file_of(F.col("elements"), F.col("hidden"), F.col("html"))
    return builders.cases(kept.select("board", "pos", "page", "header", "cells", "link", info.alias("pdf_info")))


def fetch_file(url: str, *, timeout: float = TIMEOUT) -> tuple[bytes | None, str | None, str | None]:
    """(content, suggested suffix, error)."""
    try:
        with urllib.request.urlopen(url, timeout=timeout) as answer:
            name = answer.headers.get_filename()
            return answer.read(), PurePath(name).suffix.lower() if name else None, None
    except (OSError, ValueError) as e:
        return None, None, f"{type(e).__name__}: {e}"


def downloads(wanted: DataFrame, there: DataFrame, *, suffix: str, delay: float = DELAY, timeout: float = TIMEOUT, least: int = LEAST_BYTES, concurrency: int = 1) -> DataFrame:
    """Files of wanted (id, name without suffix, url; a null or empty url has none) that are not there (name with suffix): rows of FOUND.

    outcome: skipped (there already), no_file (no url), failed (an error, or under ``least`` bytes: the content goes, F6), success. A file that the
    server names with another suffix takes that. At most ``concurrency`` calls to a host run at once, with a pause after each (R2).
    """
    named = wanted.withColumn("name", F.concat("name", F.lit(suffix)))
    old, new = named.join(there.select("name"), "name", "left_semi"), named.join(there.select("name"), "name", "left_anti")
    none = F.coalesce(F.col("url"), F.lit("")) == ""
    told = lambda rows, outcome: rows.select("id", "name", F.lit(None).cast("binary").alias("content"), F.lit(None).cast("long").alias("length"), F.lit(outcome).alias("outcome"), F.lit(None).cast("string").alias("error"))

    def call(row: tuple) -> tuple:
        content, other, error = fetch_file(row[2], timeout=timeout)
        name = row[1] if not other or other == suffix else str(PurePath(row[1]).with_suffix(other))
        good = content is not None and len(content) >= least
        return row[0], name, content if good else None, len(content) if content is not None else -1, "success" if good else "failed", error

    fetched = paced(new.where(~none).select("id", "name", "url"), call, FOUND, delay=delay, in_flight=concurrency)
    fetched = fetched.withColumn("length", F.nullif("length", F.lit(-1)))
    return fetched.unionByName(told(old, "skipped")).unionByName(told(new.where(none), "no_file"))


class KeyedFiles(DataSource):
    """Sink ``keyed_files``: rows (name, content) as files of a folder, a file for each name.

    A task writes into a folder of its own attempt, and nothing under a file's name until the job commits: then each attempt that counts is moved into
    place, file by file, each replaced as a whole. An attempt that fails, or is not the one that counts, leaves nothing but a folder that abort or the next commit removes.
    """

    @classmethod
    def name(cls) -> str:
        return "keyed_files"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if {"name", "content"} - set(schema.names):
            raise ValueError("keyed_files writes rows with a name and a content")
        return _FilesWriter(self.options["path"])


@dataclass
class _Written(WriterCommitMessage):
    folder: str
    files: int


class _FilesWriter(DataSourceArrowWriter):
    def __init__(self, path: str) -> None:
        self.path, self.staging = file_uri(path), f"_staging-{uuid.uuid4().hex}"

    def _folder(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path)

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        system, path = self._folder()
        own, n = f"{path}/{self.staging}/{uuid.uuid4().hex}", 0
        system.create_dir(own, recursive=True)
        for batch in iterator:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content")):
                if not name or "/" in name or name[0] in "._":
                    raise ValueError(f"no name of a file: {name!r}")
                with system.open_output_stream(f"{own}/{name}") as out:
                    out.write(content.as_py() or b"")
                n += 1
        return _Written(own, n)

    def commit(self, messages: list) -> None:
        from pyarrow import fs

        system, path = self._folder()
        system.create_dir(path, recursive=True)
        for m in messages:
            for info in system.get_file_info(fs.FileSelector(m.folder)) if m is not None else []:
                system.move(info.path, f"{path}/{info.base_name}")
        self._clear(system, path)

    def abort(self, messages: list) -> None:
        self._clear(*self._folder())

    def _clear(self, system, path: str) -> None:
        from pyarrow import fs

        if system.get_file_info(f"{path}/{self.staging}").type != fs.FileType.NotFound:
            system.delete_dir(f"{path}/{self.staging}")


def save_files(found: DataFrame, folder: str) -> None:
    """Writes the contents under their names into a folder that the driver and all executors reach, whole files or none (K1)."""
    found.sparkSession.dataSource.register(KeyedFiles)
    found.where("outcome = 'success'").select("name", "content").write.format("keyed_files").mode("append").save(folder)
