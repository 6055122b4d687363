"""Stores, merges, envelopes, observed metrics, paced calls, compound files and parsing again: what is read, what is left alone, what a failure gives."""

import json
import os
import random
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from statuta.functions import html
from statuta.operators import builders, records, walk
from statuta.sources import boards, decode, paged
from statuta.streaming import incremental


def size_of(frame):
    return sum(os.path.getsize(f.removeprefix("file://")) for f in frame.inputFiles())


def test_a_batch_reads_what_its_keys_touch(spark, tmp_path):
    """As the store grows tenfold, what a batch of the same size reads stays about the same."""
    target, rows = str(tmp_path / "store"), lambda a, b: spark.range(a, b).select("id", F.sha2(F.col("id").cast("string"), 256).alias("v")).coalesce(1)
    read = []
    for upto in (2_000, 20_000):
        there = incremental.held(spark, target, rows(0, 1).schema).count()
        incremental.append_new(rows(there // 2, upto), target, "id", bucket_rows=200)
        assert incremental.held(spark, target, rows(0, 1).schema).count() == upto
        n = incremental._generations(spark, target)
        batch = rows(5, 9).withColumn("_bucket", incremental.bucket_of("id", n[-1]))
        touched = [r[0] for r in batch.select("_bucket").distinct().collect()]
        there = incremental.held(spark, target, rows(0, 1).schema).where(F.col("_bucket").isin(touched))
        assert len(n) == 1 and "PartitionFilters: [" in there._jdf.queryExecution().executedPlan().toString()
        files = [f for f in there.inputFiles() if any(f"_bucket={b}/" in f for b in touched)]
        read.append(sum(os.path.getsize(f.removeprefix("file://")) for f in files))
    assert read[1] < 2 * read[0]
    incremental.append_new(rows(0, 20_000), target, "id", bucket_rows=200)
    assert incremental.held(spark, target, rows(0, 1).schema).agg(F.count("id"), F.countDistinct("id")).first()[:] == (20_000, 20_000)


def test_a_broken_off_generation_is_not_used(spark, tmp_path):
    target = str(tmp_path / "store")
    incremental.append_new(spark.range(10), target, "id")
    (tmp_path / "store" / "n=64" / "_bucket=0").mkdir(parents=True)  # a growth that did not end
    incremental.append_new(spark.range(20), target, "id")
    assert sorted(r["id"] for r in incremental.held(spark, target, "id long").collect()) == list(range(20))
    assert incremental.held(spark, str(tmp_path / "none"), "id long").count() == 0


def test_other_categories_are_left_alone(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = lambda run, *pairs: spark.createDataFrame([(k, c, run) for k, c in pairs], "`파일ID` string, `카테고리` string, run int")
    builders.merge_categories(rows(1, ("1", "가"), ("2", "가"), ("3", "나"), ("4", None)), path)
    before = {str(p): p.stat().st_mtime_ns for p in Path(path).rglob("*.json") if "가" not in str(p)}
    builders.merge_categories(rows(2, ("2", "가"), ("5", "가")), path)
    after = {str(p): p.stat().st_mtime_ns for p in Path(path).rglob("*.json") if "가" not in str(p)}
    assert before == after and before
    back = spark.read.schema("`파일ID` string, run int, _folder string").json(path).collect()
    assert sorted((r[0], r[1], r[2]) for r in back) == [("1", 1, "contracts_가"), ("2", 2, "contracts_가"), ("3", 1, "contracts_나"), ("4", 1, "contracts_기타"), ("5", 2, "contracts_가")]


def test_broken_envelopes_are_rows(spark, tmp_path):
    for name, body in (("a", '{"총_건수": 2, "사례": [{"x": 1}, {"x": 2}]}'), ("b", '{"사례": [{"x": 3}, '), ("c", '{"총_건수": 0}'), ("d", ""), ("e", '{"사례": []}')):
        (tmp_path / f"{name}.json").write_text(body, encoding="utf-8")
    got = sorted((r["file"][-6], r["outcome"], r["r"] and r["r"]["x"]) for r in records.envelopes(spark, str(tmp_path), "x int").collect())
    assert got == [("a", "record", 1), ("a", "record", 2), ("b", "broken", None), ("c", "empty", None), ("e", "empty", None)]


def test_one_large_envelope_is_read_by_several_tasks(spark, tmp_path):
    rng = random.Random(1)
    made = [{"x": i, "t": rng.choice(['{"a": [1]}', "}\n        },", "줄\n        {", "말" * 50]), "n": [{"y": 1}, {}], "m": {"k": None}} for i in range(5000)]
    (tmp_path / "e.json").write_text(json.dumps({"총_건수": len(made), "카테고리별_건수": {"가": 1}, "사례": made, "끝": {"z": 1}}, ensure_ascii=False, indent=4), encoding="utf-8")
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        frame = records.large_envelope(spark, str(tmp_path / "e.json"), "x int, t string")
        assert frame.select(F.spark_partition_id()).distinct().count() > 3
        got = frame.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert {r["outcome"] for r in got} == {"record"} and sorted((r["r"]["x"], r["r"]["t"]) for r in got) == sorted((m["x"], m["t"]) for m in made)


def test_metrics_come_from_the_write(spark, tmp_path):
    rows = spark.range(100).select("id", F.when(F.col("id") % 3 == 0, "failed").when(F.col("id") % 3 == 1, "success").when(F.col("id") < 50, "odd").alias("outcome"))
    seen_rows, seen = records.observed(rows, "s", F.col("outcome"), ("failed", "success", "no_pdf"))
    tracker, group = spark.sparkContext.statusTracker(), "observed"
    spark.sparkContext.setJobGroup(group, group)
    seen_rows.write.parquet(str(tmp_path / "o"))
    assert sorted(map(tuple, records.observed_metrics(spark, seen, "s").collect())) == [("s", "failed", 34), ("s", "other", 33), ("s", "success", 33)]
    # one job writes and counts; the other lists the few metrics
    assert len(tracker.getJobIdsForGroup(group)) == 2
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_hosts_are_paced_by_themselves(spark):
    """Calls to one host never overlap; two hosts take no longer than the slower one."""

    def server(seconds):
        seen = {"now": 0, "most": 0, "n": 0}

        class Slow(BaseHTTPRequestHandler):
            def do_GET(self):
                seen["now"] += 1
                seen["most"], seen["n"] = max(seen["most"], seen["now"]), seen["n"] + 1
                time.sleep(seconds)
                seen["now"] -= 1
                self.send_response(200)
                self.end_headers()
                self.wfile.write(b"z" * 200)

            def log_message(self, *_):
                pass

        made = ThreadingHTTPServer(("127.0.0.1", 0), Slow)
        threading.Thread(target=made.serve_forever, daemon=True).start()
        return made, seen

    (one, a), (two, b) = server(0.15), server(0.3)
    try:
        at = lambda s, i: f"http://127.0.0.1:{s.server_port}/{i}"
        rows = [(f"{k}{i}", f"n{k}{i}", at(s, i)) for i in range(10) for k, s in (("a", one), ("b", two))]
        wanted = spark.createDataFrame(rows, "id string, name string, url string")
        none = spark.createDataFrame([], "name string")
        boards.downloads(wanted.limit(1), none, suffix=".hwp", delay=0.0).collect()
        began = time.time()
        got = boards.downloads(wanted, none, suffix=".hwp", delay=0.0).collect()
        took = time.time() - began
        assert {r["outcome"] for r in got} == {"success"} and len(got) == 20
        assert a["most"] == b["most"] == 1 and took < 10 * 0.3 + 1.4
        boards.downloads(wanted, none, suffix=".hwp", delay=0.0, concurrency=3).collect()
        assert 2 <= b["most"] <= 3
    finally:
        one.shutdown()
        two.shutdown()


def test_variants_tell_outcomes(spark):
    rows = [("1", '{"a": {"b": [1, "x"]}}'), ("2", ""), ("3", None), ("4", "{"), ("5", "{}"), ("6", '"text"'), ("7", "null"), ("8", " [] ")]
    got = paged.variants(spark.createDataFrame(rows, "id string, body string")).select("id", "outcome", F.try_variant_get("document", "$.a.b[1]", "string").alias("x"), F.col("document").isNull().alias("none")).collect()
    assert {r["id"]: (r["outcome"], r["x"], r["none"]) for r in got} == {"1": ("found", "x", False), "2": ("empty", None, True), "3": ("empty", None, True), "4": ("malformed", None, True), "5": ("empty", None, True), "6": ("found", None, False), "7": ("empty", None, True), "8": ("empty", None, True)}


@pytest.mark.parametrize("sizes", [[10], [5000], [0, 1, 64, 65, 4095, 4096, 4097, 100_000], [3_000_000, 2_000_000, 9], [10] * 60])
def test_compound_files(sizes):
    rng = random.Random(1)
    streams = {("FileHeader",): bytes(256), ("A", "B", "C"): b"x" * 70, **{("BodyText", f"Section{i}"): rng.randbytes(n) for i, n in enumerate(sizes)}}
    made = decode.container_of(streams)
    assert decode.container_streams(made) == streams
    for _ in range(100):  # broken ones end, with a value or an error
        raw = bytearray(made[: rng.randrange(10, 20_000)])
        for _ in range(4):
            raw[rng.randrange(len(raw))] = rng.randrange(256)
        decode._safely(decode.container_text, bytes(raw))


def test_sections_by_name_and_number():
    part = lambda t: decode.zlib.compress(decode.record(t))[2:-4]
    head = bytes(36) + b"\1" + bytes(219)
    made = decode.container_of({("FileHeader",): head, **{("BodyText", f"Section{i}"): part(f"s{i}") for i in (0, 2, 10)}, ("BodyText", "Section3"): b"not packed", ("Other", "Section1"): part("no")})
    assert decode.container_text(made) == "s0\ns10\ns2" and decode.container_text(made, compat=False) == "s0\ns2\ns10"


def test_only_matched_files_are_read(spark, tmp_path):
    for name, data in (("a.pdf", b"%PDF"), ("a.hwp", b"no"), ("b.zip", decode.container_of({("x",): b""})), ("c.txt", b"z"), ("d.HWPX", b"z")):
        (tmp_path / name).write_bytes(data)
    wanted = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "c"), ("4", "e")], "file_id string, name string")
    found = decode.reparse(spark, str(tmp_path), wanted)
    assert sorted(Path(f).name for f in found.inputFiles() if Path(f.removeprefix("file://")).parent == tmp_path) == ["a.hwp", "b.zip"]
    assert {r["file_id"]: (r["name"], r["text"], bool(r["error"])) for r in found.collect()} == {"1": ("a.hwp", "", True), "2": ("b.zip", "", True)}
    assert decode.reparse(spark, str(tmp_path), wanted.limit(0)).count() == 0


def test_a_pending_walk_ends_at_a_missing_page(spark):
    rows = spark.createDataFrame([(1, 0, "a", True), (1, 1, "b", False), (2, 0, "a", False), (2, 1, "c", True), (4, 0, "d", True)], "page long, pos int, key string, has_file boolean")
    wanted = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("e",), ("a",)], "key string")
    found = walk.pending(rows, wanted)
    assert sorted(map(tuple, found.collect())) == [("a", "success", 1), ("b", "failed", 1), ("c", "success", 2), ("d", "pending", None), ("e", "pending", None)]
    assert [tuple(r) for r in walk.shrinking(found).orderBy("page").collect()] == [(1, 1, 1, 3), (2, 1, 0, 2)]
    assert walk.shrinking(walk.pending(rows.limit(0), wanted)).count() == 0


def test_cases_of_one_title_keep_their_files(spark):
    cases = spark.createDataFrame([("1", "", "같은 제목", 1), ("2", "", "같은 제목", 2), ("3", "", "다른", 3)], "`사건번호` string, `의결번호` string, `사건명` string, ord long")
    files = spark.createDataFrame([("1_|_같은_제목", "/1", "같은 제목", 1), ("1___같은_제목", "/1", "같은 제목", 1), ("2___같은_제목", "/2", "같은 제목", 2)], "name string, path string, title string, ord long")
    of = lambda compat: sorted((r["ord"], r["path"]) for r in builders.case_files(cases, files, compat).collect())
    assert of(False) == [(1, "/1"), (2, "/2")] and of(True) == [(1, "/2"), (2, "/2")]


def test_listing_gives_exact_sizes(spark, tmp_path):
    for n in (0, 99, 100, 5000):
        (tmp_path / f"f{n}.hwp").write_bytes(b"x" * n)
    (tmp_path / "f.txt").write_bytes(b"x" * 500)
    found = decode.listing(spark, str(tmp_path), "*.hwp")
    assert sorted((Path(r["path"]).name, r["length"]) for r in found.collect()) == [("f100.hwp", 100), ("f5000.hwp", 5000)]
    assert "content" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("scanned", [1000, 3])
def test_any_number_of_files_is_parsed_again(spark, tmp_path, monkeypatch, scanned):
    """More files than a scan may have are opened by tasks; names are no patterns, and no driver lists the folder."""
    text = lambda n: decode.container_of({("FileHeader",): bytes(256), ("BodyText", "Section0"): decode.record(n)})
    names = ["a [1]", "b{2}", "c*", "d?e", "f%20g", "h\\i", "가", "j.k"]
    for n in names:
        (tmp_path / f"{n}.hwp").write_bytes(text(n))
        (tmp_path / f"{n}.zip").write_bytes(b"PK")
    (tmp_path / "a b1.hwp").write_bytes(b"not wanted")
    (tmp_path / "broken.pdf").write_bytes(b"?")
    monkeypatch.setattr(decode, "SCANNED", scanned)
    monkeypatch.delattr(decode, "stems")
    wanted = spark.createDataFrame([(str(i), n) for i, n in enumerate([*names, names[0], "broken", "none", "가" * 140, "", None])], "file_id string, name string")
    found = decode.reparse(spark, str(tmp_path), wanted)
    assert {r["file_id"]: (r["name"], r["text"], bool(r["error"])) for r in found.collect()} == {**{str(i): (f"{n}.hwp", n, False) for i, n in enumerate([*names, names[0]])}, "9": ("broken.pdf", "", True)}
    assert (scanned > 3) == any(f.endswith("broken.pdf") for f in found.inputFiles())


def test_units_of_a_paragraph():
    """Every unit, each with data or none after it."""
    units = decode.np.arange(1, 1 << 16, dtype="<u2")
    plain = units[(units >= 32) & ((units < 0xD800) | (units > 0xDFFF)) & (units != 0xFFFD)]
    assert decode.paragraph(plain.tobytes()) == "".join(map(chr, plain))
    assert decode.paragraph(decode.np.array([13, 30, 31, 5, 9, *range(65, 71), 65, 66, 0xD83D, 0xDE00], "<u2").tobytes()) == "\n\xa0\xadAB??"
    assert decode.paragraph(decode.np.array([9, 1, 1, 1, 1, 1, 1, 65, 0xD83D, 0xDE00, 0xD83D], "<u2").tobytes(), compat=False) == "A😀?"


def test_decoders_take_rows_by_the_hundred(spark):
    """What a worker holds does not grow with its partition: no decoder is an Arrow UDF, of which a batch has ten thousand rows."""
    made = spark.range(3).select(decode.to_container(F.array(F.lit("a"), F.lit(None).cast("string")), F.lit(True)).alias("c"), decode.to_records(F.lit("b")).alias("s"), decode.to_archive(F.lit("d")).alias("z"))
    found = made.select(decode.document_text("c").alias("c"), decode.document_text_by_number("c").alias("n"), decode.body_text("s").alias("s"), decode.archive_text("z").alias("z"))
    assert found.select("c.text", "n.text", "s.text", "z.text").first()[:] == ("a", "a", "b", "d")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "Arrow" not in plan


def test_boards_give_rows_out_by_the_piece(spark):
    """What a worker makes of a batch of pages does not grow with the batch, and rows have only what their board is read for."""
    page = "<table><tr><td>1</td><td><a href=v>t</a></td></tr></table>"
    pages = decode.pa.array([*[page] * 40, None])
    found = [x.to_pylist() for x in html.board_table(html.CONTRACTS, boards.OF_CONTRACTS).func(iter([pages, pages[:0], pages[:1]]))]
    assert sum(map(len, found)) == 42 and max(map(len, found)) <= html.PAGES and found[-1][0]["rows"] == [{"cells": ["1", "t"], "title_link": "t", "hrefs": []}]
    rows = spark.range(0, 50, 1, 1).select(F.lit("a").alias("board"), F.col("id").alias("page"), F.concat(F.lit(page), "id").alias("html"))
    assert boards._parsed(rows, html.CONTRACTS, ["board"], boards.OF_CONTRACTS).where("size(rows) = 1").count() == 50
