"""Office documents from binary columns: record streams, archives of XML sections, compound files, PDF through an optional library; and from folders of them.

Decoders are plain UDFs over the binaryFile source; each gives struct<text, error> and never raises.
"""

from __future__ import annotations

import errno
import io
import os
import re
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statuta.checkpoints import kept

# Suffixes of attachments, in the order in which they are tried, and the least size of a file.
EXTENSIONS = (".hwp", ".hwpx", ".pdf", ".doc", ".docx", ".zip")
LEAST_BYTES = 100
#: Files that one scan may have, files of a task that opens them itself, and characters of text in the rows that such a task gives out at once.
SCANNED, FILES_EACH, GIVEN = 1000, 2000, 1 << 20
# Fixed values of paragraph text: the record tag, units that stand for characters, units followed by 12 bytes to skip.
PARAGRAPH_TAG = 67
UNIT_TEXT = {13: "\n", 30: " ", 31: "­"}
WITH_DATA = frozenset({1, 2, 3, 9, 10, 11, 12, *range(14, 24)})
#: Of each unit: whether it stays, whether data follows it, and what it becomes.
_KEPT, _LEADS, _SHOWN = np.arange(1 << 16) >= 32, np.zeros(1 << 16, bool), np.arange(1 << 16, dtype="<u2")
_KEPT[list(UNIT_TEXT)], _LEADS[list(WITH_DATA)] = True, True
for _unit, _text in UNIT_TEXT.items():
    _SHOWN[_unit] = ord(_text)
# Fixed values of compound files: the first bytes, and sector numbers that stand for an end and for none.
OLE_MAGIC, END, FREE = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", 0xFFFFFFFE, 0xFFFFFFFF
DECODED = T.StructType([T.StructField("text", T.StringType()), T.StructField("error", T.StringType())])


def file_uri(path: str) -> str:
    """A folder's address for tasks that open files themselves."""
    return re.sub(r"^file:/(?!/)", "file:///", path) if re.match(r"[a-z][a-z0-9+.-]*:/", path) else f"file://{os.path.abspath(path)}"


def listing(spark: SparkSession, path: str, glob: str = "*", least: int = LEAST_BYTES) -> DataFrame:
    """path and length of the files of at least ``least`` bytes; contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).where(F.col("length") >= least).select("path", "length")


def paragraph(data: bytes, compat: bool = True) -> str:
    """UTF-16 units with control units left out (X20); compat: each half of a surrogate pair is a question mark, else pairs are characters."""
    units = np.frombuffer(data, "<u2", len(data) // 2)
    kept = _KEPT[units]
    free = 0
    for at in np.flatnonzero(_LEADS[units]).tolist():
        if at >= free:  # not itself data of the one before
            kept[at : at + 7] = False
            free = at + 7
    units = _SHOWN[units[kept]]
    if compat:
        units[(units & 0xF800) == 0xD800] = ord("?")
    # single surrogates become a question mark
    return units.tobytes().decode("utf-16-le", "replace").replace("\ufffd", "?")


def stream_text(data: bytes, compat: bool = True) -> str:
    """Stripped paragraphs of a record stream; a truncated record ends it."""
    at, out = 0, []
    while at + 4 < len(data):
        (head,) = struct.unpack_from("<I", data, at)
        at, size = at + 4, head >> 20
        if size == 0xFFF:
            if at + 4 > len(data):
                break
            (size,) = struct.unpack_from("<I", data, at)
            at += 4
        if at + size > len(data):
            break
        if head & 0x3FF == PARAGRAPH_TAG and (text := paragraph(data[at : at + size], compat).strip()):
            out.append(text)
        at += size
    return "\n".join(out)


def unpacked(data: bytes) -> bytes | None:
    """Raw deflate, or with a header; null where it is neither."""
    for bits in (-15, 15):
        try:
            return zlib.decompress(data, bits)
        except zlib.error:
            continue
    return None


def inflated(data: bytes) -> bytes:
    """As unpacked, or the bytes as they are."""
    found = unpacked(data)
    return data if found is None else found


def sections_text(data: bytes) -> str:
    """The text of an archive's section files, by name."""
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for name in sorted(z.namelist()):
            if "section" in name.lower() and name.endswith(".xml"):
                text = " ".join(re.sub("<[^>]+>", "", z.read(name).decode("utf-8", "replace")).split())
                out += [text] if text else []
    return "\n".join(out)


def container_streams(data: bytes) -> dict[tuple[str, ...], bytes]:
    """The streams of a compound file by their paths: chains of sectors through the allocation table, small streams in sectors of their own kind within one stream."""
    at = lambda kind, place: struct.unpack_from("<" + kind, data, place)[0]
    if data[:8] != OLE_MAGIC:
        raise ValueError("not a compound file")
    size, small = 1 << at("H", 0x1E), 1 << at("H", 0x20)
    sector = lambda n: data[(n + 1) * size : (n + 2) * size]
    numbers = lambda raw: np.frombuffer(raw[: len(raw) // 4 * 4], "<u4")

    def chain(table: np.ndarray, n: int) -> list[int]:
        out: list[int] = []
        while n < len(table) and len(out) <= len(table):
            out.append(n)
            n = int(table[n])
        if len(out) > len(table):
            raise ValueError("a chain of sectors has no end")
        return out

    listed, more = [*numbers(data[0x4C:0x200])], at("I", 0x44)
    for _ in range(at("I", 0x48)):
        if more >= END:
            break
        part = numbers(sector(more))
        listed += [*part[:-1]]
        more = int(part[-1])
    table = numbers(b"".join(sector(int(n)) for n in listed if n < END))
    whole = lambda n: b"".join(sector(x) for x in chain(table, n))
    names, small_table = whole(at("I", 0x30)), numbers(whole(at("I", 0x3C))) if at("I", 0x40) else np.zeros(0, "<u4")
    entry = [names[i : i + 128] for i in range(0, len(names) - 127, 128)]
    of = lambda e, kind, place: struct.unpack_from("<" + kind, entry[e], place)[0]
    within = whole(of(0, "I", 0x74))[: of(0, "Q", 0x78) & 0xFFFFFFFF]
    found: dict[tuple[str, ...], bytes] = {}
    todo, seen = [(of(0, "I", 0x4C), ())], set()
    while todo:
        e, path = todo.pop()
        if e >= len(entry) or e in seen:
            continue
        seen.add(e)
        own = (*path, entry[e][: max(0, of(e, "H", 0x40) - 2)].decode("utf-16-le", "replace"))
        todo += [(of(e, "I", 0x44), path), (of(e, "I", 0x48), path)]
        if entry[e][0x42] == 1:
            todo.append((of(e, "I", 0x4C), own))
        elif entry[e][0x42] == 2:
            start, n = of(e, "I", 0x74), of(e, "Q", 0x78) if size > 512 else of(e, "I", 0x78)
            raw = whole(start) if n >= at("I", 0x38) else b"".join(within[x * small : (x + 1) * small] for x in chain(small_table, start))
            if len(raw) < n:
                raise ValueError(f"stream {'/'.join(own)} is cut off")
            found[own] = raw[:n]
    return found


def container_text(data: bytes, compat: bool = True) -> str:
    """A document by its first bytes: archive, compound file, or PDF through an optional library.

    compat: the sections of a compound file by name, else by number (Q13). A section that should be packed and can not be unpacked is left out (F11).
    """
    if data[:2] == b"PK":
        return sections_text(data)
    if data[:4] == b"%PDF":
        import pdfplumber

        with pdfplumber.open(io.BytesIO(data)) as pdf:
            return "\n".join(t for t in (page.extract_text() for page in pdf.pages) if t)
    if data[:8] != OLE_MAGIC:
        raise ValueError("unsupported")
    streams = container_streams(data)
    packed = bool(streams[("FileHeader",)][36] & 1)
    names = sorted((n for n in streams if n[0] == "BodyText" and len(n) > 1), key=lambda n: n if compat else (len(n[-1]), n[-1]))
    found = [stream_text(s, compat) for n in names if (s := unpacked(streams[n]) if packed else streams[n]) is not None]
    return "\n".join(x for x in found if x)


def container_of(streams: dict[tuple[str, ...], bytes]) -> bytes:
    """A compound file of these streams, for sinks and tests."""
    size = 512 if sum(map(len, streams.values())) < 4 << 20 else 4096
    sectors: list[bytes] = []
    links: list[int] = []

    def put(raw: bytes) -> int:
        """Adds a chain of sectors; gives its first."""
        if not raw:
            return END
        first, n = len(sectors), -(-len(raw) // size)
        sectors.extend(raw[i * size : (i + 1) * size].ljust(size, b"\0") for i in range(n))
        links.extend([*range(first + 1, first + n), END])
        return first

    within, small_links = b"", []
    entries: list[list] = [["Root Entry", 5, FREE, FREE, FREE, END, 0]]
    folders: dict[tuple[str, ...], list[int]] = {(): []}
    for path in sorted(streams, key=lambda p: (len(p), len(p[-1]), p[-1].upper())):
        for k in range(1, len(path)):
            if path[:k] not in folders:
                folders[path[:k]] = []
                folders[path[: k - 1]].append(len(entries))
                entries.append([path[k - 1], 1, FREE, FREE, FREE, 0, 0])
        raw = streams[path]
        if len(raw) >= 4096:
            start = put(raw)
        elif raw:
            start, n = len(small_links), -(-len(raw) // 64)
            small_links += [*range(start + 1, start + n), END]
            within += raw.ljust(n * 64, b"\0")
        else:
            start = END
        folders[path[:-1]].append(len(entries))
        entries.append([path[-1], 2, FREE, FREE, FREE, start, len(raw)])
    at_of = {p: 0 if not p else next(i for i in folders[p[:-1]] if entries[i][0] == p[-1] and entries[i][1] == 1) for p in folders}
    for path, kids in folders.items():
        kids = sorted(kids, key=lambda i: (len(entries[i][0]), entries[i][0].upper()))
        if kids:
            entries[at_of[path]][4] = kids[0]
        for a, b in zip(kids, kids[1:]):
            entries[a][3] = b
    entries[0][5], entries[0][6] = put(within), len(within)
    small_first = put(np.array(small_links, "<u4").tobytes().ljust(-(-len(small_links) * 4 // size) * size, b"\xff"))
    packed = b"".join(e[0].encode("utf-16-le").ljust(64, b"\0") + struct.pack("<HBBIII16sIQQIQ", 2 * len(e[0]) + 2, e[1], 1, e[2], e[3], e[4], b"", 0, 0, 0, e[5], e[6]) for e in entries)
    names_first, empty = put(packed), b"\0" * 64 + struct.pack("<HBBIII16sIQQIQ", 0, 0, 0, FREE, FREE, FREE, b"", 0, 0, 0, 0, 0)
    if rest := -len(packed) % size:
        sectors[-1] = sectors[-1][:-rest] + empty * (rest // 128)
    each, tables = size // 4, 1
    while tables * each < len(sectors) + tables:
        tables += 1
    if tables > 109:
        raise ValueError("too large for a table in the header")
    table = np.full(tables * each, FREE, "<u4")
    table[: len(links)] = links
    first = len(sectors)
    table[first : first + tables] = 0xFFFFFFFD
    head = OLE_MAGIC + b"\0" * 16 + struct.pack("<HHHHH6sIIIIIIIIII", 0x3E, 3 if size == 512 else 4, 0xFFFE, size.bit_length() - 1, 6, b"", 0 if size == 512 else -(-len(packed) // size), tables, names_first, 0, 4096, small_first, -(-len(small_links) * 4 // size), END, 0, 0)[:-4]
    listed = np.full(109, FREE, "<u4")
    listed[:tables] = range(first, first + tables)
    return (head + listed.tobytes()).ljust(size, b"\0") + b"".join(sectors) + table.tobytes()


def _safely(decode: Callable[[bytes], str], data: bytes | None) -> dict:
    try:
        return {"text": decode(bytes(data or b"")), "error": None}
    except Exception as e:  # a broken file is an outcome of its row
        return {"text": "", "error": f"{type(e).__name__}: {e}"[:200]}


# Plain UDFs: Spark hands them a hundred rows at a time, so what a worker holds does not grow with the partition.
@F.udf(DECODED, useArrow=False)
def body_text(stream: bytes | None) -> dict:
    return _safely(lambda b: stream_text(inflated(b)), stream)


@F.udf(DECODED, useArrow=False)
def archive_text(archive: bytes | None) -> dict:
    return _safely(sections_text, archive)


@F.udf(DECODED, useArrow=False)
def document_text(content: bytes | None) -> dict:
    return _safely(container_text, content)


@F.udf(DECODED, useArrow=False)
def document_text_by_number(content: bytes | None) -> dict:
    """As document_text, sections in the order of their numbers."""
    return _safely(lambda b: container_text(b, False), content)


def record(text: str) -> bytes:
    """A paragraph record, for sinks and tests."""
    data = text.replace("\n", "\r").encode("utf-16-le")
    size = len(data)
    return struct.pack("<I", PARAGRAPH_TAG | min(size, 0xFFF) << 20) + (struct.pack("<I", size) if size >= 0xFFF else b"") + data


@F.udf(T.BinaryType(), useArrow=False)
def to_records(text: str | None) -> bytes:
    """A compressed stream of one record."""
    return zlib.compress(record(text or "") + struct.pack("<I", 66 | 4 << 20) + b"\0" * 4)[2:-4]


@F.udf(T.BinaryType(), useArrow=False)
def to_archive(text: str | None) -> bytes:
    """An archive with the text as its only section."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("Contents/section0.xml", text or "")
        z.writestr("Contents/header.xml", "<x>no</x>")
    return out.getvalue()


@F.udf(T.BinaryType(), useArrow=False)
def to_container(sections: list[str | None], packed: bool | None) -> bytes:
    """A compound file with a section of one paragraph for each text."""
    head = (b"HWP Document File".ljust(36, b"\0") + bytes([1 if packed else 0])).ljust(256, b"\0")
    body = {("BodyText", f"Section{i}"): zlib.compress(record(x or ""))[2:-4] if packed else record(x or "") for i, x in enumerate(sections)}
    return container_of({("FileHeader",): head, ("DocInfo",): b"x" * 5000, **body})


def stems(spark: SparkSession, folder: str) -> DataFrame:
    """path, name without suffix, extension of a folder's files, not read; none where there is no folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], "path string, name string, extension string")
    there = spark.read.format("binaryFile").load(folder).select("path", F.regexp_extract("path", r"([^/]+)\z", 1).alias("file"))
    there = there.withColumn("extension", F.regexp_extract("file", r"(\.[^.]*)\z", 1))
    return there.select("path", F.expr("substr(file, 1, length(file) - length(extension))").alias("name"), "extension")


def _hidden(name: str) -> bool:
    """Names that Spark's file scans leave out."""
    return name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")


def _first_file(system, path: str, name: str, extensions: tuple[str, ...]) -> str | None:
    """The suffix of the first of the name's files that the folder has."""
    from pyarrow import fs

    try:
        there = system.get_file_info([f"{path}/{name}{x}" for x in extensions])
    except OSError as e:
        if e.errno != errno.ENAMETOOLONG:  # a name that the file system can not hold is of no file
            raise
        return None
    return next((x for x, info in zip(extensions, there) if info.type == fs.FileType.File), None)


def matched(folder: str, wanted: DataFrame, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """file_id, name with suffix of the files that folder has for wanted (file_id, name without suffix): of a file's suffixes the first in order.

    Tasks ask for the names they hold, so the folder is listed nowhere, however many files it has.
    """
    uri = file_uri(folder)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(uri)
        for batch in batches:
            ids, files = [], []
            for key, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if name and "/" not in name and not _hidden(name) and (suffix := _first_file(system, path, name, extensions)):
                    ids.append(key)
                    files.append(name + suffix)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(files, pa.string())], ["file_id", "name"])

    return wanted.select(F.col("file_id").cast("string").alias("file_id"), "name").mapInArrow(ask, "file_id string, name string")


def read_files(folder: str, found: DataFrame) -> DataFrame:
    """file_id, name, text, error of a folder's files (file_id, name with suffix): tasks open them one by one and give rows out by the megabyte."""
    uri = file_uri(folder)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(uri)
        told: list[tuple] = []
        give = lambda: pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*told)], ["file_id", "name", "text", "error"])
        size = 0
        for batch in batches:
            for key, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with system.open_input_file(f"{path}/{name}") as file:
                    t = _safely(container_text, file.read())
                told.append((key, name, t["text"], t["error"]))
                size += len(t["text"]) + 100
                if size >= GIVEN:
                    yield give()
                    told, size = [], 0
        if told:
            yield give()

    return found.select("file_id", "name").mapInArrow(read, "file_id string, name string, text string, error string")


def reparse(spark: SparkSession, folder: str, wanted: DataFrame, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """file_id, name, text, error of the files that folder has for wanted (file_id, name without suffix): parsing again without fetching.

    Of a file's suffixes the first in order counts. Only files that are matched are read. At most ``SCANNED`` of them go through a file scan, of which the
    driver holds the paths; more are opened by tasks, and no path passes the driver.
    """
    found = kept(matched(folder, wanted, extensions))
    n = found.count()
    if n > SCANNED:
        return read_files(folder, found.repartition(max(spark.sparkContext.defaultParallelism, n // FILES_EACH), F.xxhash64("name")))
    paths = sorted({r["name"] for r in found.select("name").collect()})
    if not paths:
        return found.select("file_id", "name", F.lit("").alias("text"), F.lit("").alias("error")).limit(0)
    literal = [f"{folder}/" + re.sub(r"([\[\]{}*?\\])", r"\\\1", x) for x in paths]  # a path of a scan is a pattern
    read = spark.read.format("binaryFile").load(literal).select(F.regexp_extract("path", r"([^/]+)\z", 1).alias("name"), document_text("content").alias("t"))
    return read.join(found, "name").select("file_id", "name", "t.text", "t.error")
