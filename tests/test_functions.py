import io
import json
import random
import re
import struct
import threading
import time
import urllib.parse
import zipfile
import zlib
from collections import Counter
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from statuta.functions import html, json_, rules, text
from statuta.operators import builders, records, walk
from statuta.sources import boards, decode, paged


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return frame.select(column).first()[0]


def listed(spark, texts, extract):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[1] for r in frame.select("i", extract(F.col("t"))).orderBy("i").collect()]


def test_white_space_is_unicode(spark):
    raw = "　 a  b\x1c\n"
    assert one(spark, text.normalize(F.col("t")), t=raw) == "a b"
    assert one(spark, text.strip(F.col("t")), t=raw) == "a  b"
    assert one(spark, text.normalize(text.normalize(F.col("t"))), t=raw) == "a b"


@pytest.mark.parametrize("raw, name", [("a/b: c", "a_b__c"), ("...", "unknown"), ("", "unknown"), ("x" * 200, "x" * 140), ("._a_.", "a"), ("한 글?", "한_글")])
def test_safe_name(spark, raw, name):
    assert one(spark, text.safe_name(F.col("t")), t=raw) == name


def test_first_truthy_skips_empty(spark):
    assert one(spark, text.first_truthy(F.col("a"), F.col("b")), a="", b="7") == "7"
    assert one(spark, text.first_truthy(F.col("a"), F.col("b")), a="", b=None) is None


@pytest.mark.parametrize("value, want", [('"0"', "0"), ("0", None), ("0.0", None), ("-0", None), ("7", "7"), ("12345678901", "12345678901"), ('""', None), ("null", None), ("false", None), ("true", "True"), ("[]", None), ("{}", None), ('"x"', "x")])
def test_json_ids_keep_their_types(spark, value, want):
    """Only a number that is zero is no id; a quoted one is."""
    pages = spark.createDataFrame([(1, '{"PrecSearch":{"prec":[{"판례일련번호":%s}]}}' % value)], "page long, body string")
    assert [r["id"] for r in json_.list_entries(pages, json_.PRECEDENT).collect()] == ([] if want is None else [want])


def test_malformed_count_raises(spark):
    assert one(spark, text.to_count(F.col("t"), 9), t=None) == 9
    with pytest.raises(Exception):
        one(spark, text.to_count(F.col("t"), 9), t="x")


@pytest.mark.parametrize("law, want", [('[{"법령일련번호":"1"},{"법령일련번호":"","MST":"2"},{"MST":""}]', ["1", "2"]), ('{"MST":"3"}', ["3"]), (None, [])])
def test_envelope_of_array_object_or_nothing(spark, law, want):
    body = '{"LawSearch":{' + (f'"law":{law},' if law else "") + '"totalCnt":"3"}}'
    pages = spark.createDataFrame([(1, body)], "page long, body string")
    assert [r["id"] for r in json_.list_entries(pages, json_.LAW).orderBy("pos").collect()] == want
    assert pages.select(*json_.counts(F.col("body"), json_.LAW)).first()[:] == (3, 100)


def test_board_table(spark):
    page = "<table><thead><tr><th>번호</th><th>제목</th></tr></thead><tr><td>1</td><td><a href='x'>가 나</a> new</td></tr></table>"
    table = one(spark, html.board_table(html.DECISIONS)(F.col("t")), t=page)
    assert table["header"] == ["번호", "제목"] and [(r["cells"], r["link"], r["title_link"]) for r in table["rows"]] == [(["1", "가 나 new"], "가 나", "가 나")]


ROW = "<tr><td>{}</td><td>b</td></tr>"


@pytest.mark.parametrize("page, cells", [
    ("<table><tr><th>a</th></tr>" + ROW.format("plain") + "</table><table class='wide list'>" + ROW.format("list") + "</table>", "list"),
    ("<table class=list></table><table class=list>" + ROW.format("second list") + "</table><table class=boardList>" + ROW.format("board") + "</table>", "board"),
    ("<table class=boardList><thead>" + ROW.format("head") + "</thead></table><p id=contents><div><table>" + ROW.format("inside") + "</table></div></p>", "inside"),
    ("<table class=list><tfoot></tfoot></table><table>" + ROW.format("never tried") + "</table>", None),
    ("<p>no table", None), (None, None)])
def test_table_cascade(spark, page, cells):
    """The first place whose first table has body rows."""
    table = one(spark, html.board_table(html.DECISIONS)(F.col("t")), t=page)
    assert (table and table["rows"] and table["rows"][-1]["cells"][0]) == cells


def test_board_rows_hold_files_and_elements(spark):
    row = "<tr><td>1</td><td>t</td><td>d</td><td>2024</td><td><a href='/downloadBbsFile.do?atchmnflNo=55&amp;x=1'>f</a><a href='/downloadBbsFile.do'>none</a><a href='/view?atchmnflNo=9'>v</a></td></tr>"
    pages = spark.createDataFrame([("표준약관", 1, f"<table class=p-table><tbody>{row}</tbody></table>"), ("표준약관", 2, f"<table class=p-table><tbody>{row}</tbody></table>")], "category string, page long, html string")
    items = boards.contract_items(pages).collect()
    assert [(i["제목"], i["등록일"], [f["file_id"] for f in i["첨부파일"]]) for i in items] == [("t", "2024", ["55"])]  # page 2 repeats page 1
    assert items[0]["첨부파일"][0]["download_url"] == builders.DOWNLOAD_URL + "?atchmnflNo=55"
    assert [r["bordCd"] for r in builders.chosen(spark, "표준약관").collect()] == ["201"] and builders.registry(spark).count() == 6
    with pytest.raises(ValueError, match="표준비밀유지계약서"):
        builders.chosen(spark, "없는 분류")


def test_parsed_case_is_whole(spark):
    body = "피심인의 약관 제3조 고객은 언제나 비용을 전부 부담한다고 정한다\n2. 고객에게 부당하게 불리한 조항 약관법 민법 제5조\n시정내용\n이 조항을 모두 삭제하고 새로 정한다\n\n3. 끝"
    frame = spark.createDataFrame([("가", {"번호": "1"}, "a.pdf", body), (None, None, "b.pdf", ""), (None, None, "c.pdf", None)], "`사건명` string, `셀_데이터` map<string,string>, name string, text string")
    rows = builders.parsed_cases(frame).collect()
    assert len(rows) == 1 and rows[0]["pdf_파일"] == "a.pdf" and rows[0]["전체_텍스트_길이"] == len(body)
    assert rows[0]["조항_원문"] == [body.split("\n")[0]] and rows[0]["위반_유형"] == ["고객에게 부당하게 불리한 조항"] and rows[0]["근거_법령"] == ["민법 제5조"]
    assert rows[0]["시정_내용"] == ["이 조항을 모두 삭제하고 새로 정한다"] and rows[0]["risk_level"] == "High"


def test_envelopes_are_loaded(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"총_건수": 2,\n "사례": [{"사건명": "가"}, {"사건명": "나"}]}', encoding="utf-8")
    (tmp_path / "b.json").write_text('{"총_건수": 0}', encoding="utf-8")
    assert sorted(r[0] for r in records.load_envelope(spark, str(tmp_path), "`사건명` string").collect()) == ["가", "나"]


class Service(BaseHTTPRequestHandler):
    """A list of 25 entries in pages of ten, and files."""

    asked: list = []

    def do_GET(self):
        query = dict(urllib.parse.parse_qsl(urllib.parse.urlsplit(self.path).query))
        Service.asked.append(self.path)
        self.send_response(200)
        if self.path.startswith("/file"):
            if query["n"] == "2":
                self.send_header("Content-Disposition", 'attachment; filename="x.PDF"')
            data = b"z" * (50 if query["n"] == "3" else 200)
        else:
            page = int(query["page"])
            entries = [{"법령일련번호": str(i)} for i in range(10 * page - 9, min(10 * page, 25) + 1)]
            data = json.dumps({"LawSearch": {"law": entries[0] if len(entries) == 1 else entries, "totalCnt": "25", "numOfRows": "10"}}).encode()
        self.end_headers()
        self.wfile.write(data)

    def log_message(self, *_):
        pass


@pytest.fixture
def service():
    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    Service.asked.clear()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_walk_is_planned_from_the_first_page(spark, service):
    got = paged.walk(spark, service + "/list", json_.LAW, delay=0.0)
    assert sorted(int(r["id"]) for r in got.collect()) == list(range(1, 26))
    assert Counter(re.search("page=([0-9]+)", x)[1] for x in Service.asked) == {"1": 1, "2": 1, "3": 1}
    # one page after another unless the source says otherwise
    assert paged.read(spark, service + "/list", 3, delay=0.0).rdd.getNumPartitions() == 1
    assert paged.read(spark, service + "/list", 3, delay=0.0, concurrency=2).rdd.getNumPartitions() == 2


class Failing(BaseHTTPRequestHandler):
    """A list of 60 entries on six pages; pages in ``down`` answer with an error, so many times each."""

    down: dict = {}
    total = 60

    def do_GET(self):
        page = int(dict(urllib.parse.parse_qsl(urllib.parse.urlsplit(self.path).query))["page"])
        Failing.down[page] = Failing.down.get(page, 0) - 1
        self.send_response(500 if Failing.down[page] >= 0 else 200)
        self.end_headers()
        listed = [{"판례일련번호": i} for i in range(10 * page - 9, min(10 * page, Failing.total) + 1)]
        self.wfile.write(json.dumps({"PrecSearch": {"prec": listed, "totalCnt": str(Failing.total), "numOfRows": "10"}}).encode())

    def log_message(self, *_):
        pass


@pytest.fixture
def failing():
    server = HTTPServer(("127.0.0.1", 0), Failing)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    Failing.down, Failing.total = {}, 60
    yield f"http://127.0.0.1:{server.server_port}/list"
    server.shutdown()


def told(found):
    """How many entries, and the pages of error rows."""
    rows = found.collect()
    return len({r["id"] for r in rows if r["error"] is None}), sorted(r["page"] for r in rows if r["error"] is not None)


@pytest.mark.parametrize("down, want", [({3: 1}, (60, [])), ({3: 99}, (50, [3])), ({1: 99}, (0, [1])), ({6: 99, 2: 99}, (40, [2, 6]))])
def test_a_failed_page_ends_no_walk(spark, failing, down, want):
    Failing.down = dict(down)
    assert told(paged.walk(spark, failing, json_.PRECEDENT, delay=0.0, attempts=2)) == want


def test_an_empty_list_is_no_failure(spark, failing):
    Failing.total = 0
    assert told(paged.walk(spark, failing, json_.PRECEDENT, delay=0.0)) == (0, [])


def test_a_walk_is_resumed_at_what_failed(spark, failing, tmp_path):
    folder, run = str(tmp_path / "walk"), lambda: told(paged.resume(spark, failing, json_.PRECEDENT, str(tmp_path / "walk"), delay=0.0, attempts=1, concurrency=2))
    Failing.down = {3: 1, 5: 2}
    assert run() == (40, [3, 5])
    assert [tuple(r) for r in walk.gaps(paged.stored(spark, folder).where("body IS NOT NULL"), []).orderBy("first").collect()] == [(3, 3), (5, 5)]
    calls = dict(Failing.down)
    assert run() == (50, [5])
    # pages that were read are not asked for again, but for the first, which tells how long the list is
    assert {p for p, n in Failing.down.items() if n != calls.get(p)} == {1, 3, 5}
    Failing.total = 75
    assert run() == (75, [])


def test_a_resumed_walk_starts_with_a_failed_first_page(spark, failing, tmp_path):
    Failing.down = {1: 2}
    run = lambda: told(paged.resume(spark, failing, json_.PRECEDENT, str(tmp_path / "walk"), delay=0.0, attempts=1))
    assert run() == (0, [1])
    assert run() == (60, [])


def test_gaps(spark):
    pages = spark.createDataFrame([("a", 2), ("a", 3), ("a", 3), ("a", 7), ("b", 1)], "s string, page long")
    assert sorted(tuple(r) for r in walk.gaps(pages, ["s"]).collect()) == [("a", 1, 1), ("a", 4, 6)]
    assert sorted(tuple(r) for r in walk.gaps(pages, ["s"], last=F.lit(8)).collect()) == [("a", 1, 1), ("a", 4, 6), ("a", 8, 8), ("b", 2, 8)]
    assert [tuple(r) for r in walk.gaps(pages.limit(0), [], last=F.lit(2)).collect()] == [(1, 2)]


def test_downloads(spark, service, tmp_path):
    wanted = spark.createDataFrame([(str(n), f"name{n}", f"{service}/file?n={n}" if n != 4 else None) for n in range(6)], "id string, name string, url string")
    there = spark.createDataFrame([("name5.hwp",)], "name string")
    found = boards.downloads(wanted, there, suffix=".hwp", delay=0.0).persist()
    assert {r["id"]: (r["name"], r["outcome"]) for r in found.collect()} == {
        "0": ("name0.hwp", "success"), "1": ("name1.hwp", "success"), "2": ("name2.pdf", "success"), "3": ("name3.hwp", "failed"), "4": ("name4.hwp", "no_file"), "5": ("name5.hwp", "skipped")}
    boards.save_files(found, f"file://{tmp_path}/files")
    assert sorted(x.name for x in (tmp_path / "files").iterdir()) == ["name0.hwp", "name1.hwp", "name2.pdf"]
    assert not any("n=5" in x for x in Service.asked)


def test_files_are_whole_or_not_there(spark, tmp_path):
    """A task that breaks off aborts the job: nothing is there under a file's name; a job that runs again replaces whole files."""
    rows = spark.createDataFrame([(f"n{i}.bin", bytes([i]) * 1000) for i in range(20)], "name string, content binary").repartition(4)
    spark.dataSource.register(boards.KeyedFiles)
    save = lambda df: df.write.format("keyed_files").mode("append").save(f"{tmp_path}/files")
    with pytest.raises(Exception):
        save(rows.unionByName(spark.createDataFrame([("a/b", b"x")], "name string, content binary")))
    assert not [x for x in (tmp_path / "files").rglob("*") if x.is_file()]
    save(rows)
    save(rows.where("name < 'n12'"))
    back = spark.read.format("binaryFile").load(f"{tmp_path}/files").select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "content")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    assert not list((tmp_path / "files").glob("_staging*"))
    with pytest.raises(Exception):
        rows.select("name").write.format("keyed_files").mode("append").save(f"{tmp_path}/files")


def test_boards_are_parsed_once(spark):
    page = "<table class='p-table'><tbody><tr><td>1</td><td><a href=v>t</a></td><td>d</td><td>r</td><td></td></tr></tbody></table>"
    pages = spark.createDataFrame([("가", 1, page), ("가", 2, page.replace(">t<", ">u<"))], "category string, page long, html string")
    python = lambda df: str(df._jdf.queryExecution().executedPlan().toString()).count("ArrowEvalPython")
    assert python(boards._parsed(pages, html.CONTRACTS, ["category"]).select("*", F.posexplode("rows")).where(F.size("rows") > 0)) == 1
    found = boards.contract_items(pages)
    assert python(found) == 0 and found.count() == 2


E1 = "피심인의 약관 제3조 고객은 언제나 비용을 전부 부담한다고 정한다\n계속되는 줄\n2. 다음"


def test_clauses(spark):
    got = listed(spark, [E1, "제1조(가) 열두자를 넘는 조항의 내용이다 그렇다\n제2조(나) 짧다", None, "약관 제5조 면책(여러\n줄) 조항의 내용이 이어진다 정말로"], rules.clauses)
    assert got[0] == ["피심인의 약관 제3조 고객은 언제나 비용을 전부 부담한다고 정한다\n계속되는 줄"]
    assert got[1] == ["제1조(가) 열두자를 넘는 조항의 내용이다 그렇다"]
    assert got[2] == []
    assert got[3] == ["약관 제5조 면책(여러\n줄) 조항의 내용이 이어진다 정말로"]


def test_violations_and_bases(spark):
    t = "고객에게 부당하게 불리한 조항. 약관규제법 제6조 및 약관의규제에 관한법 제15조, 국가배상법 제2조 제1항"
    assert listed(spark, [t], rules.violations)[0] == ["고객에게 부당하게 불리한 조항", "약관규제법 제6조 - 일반원칙 위반"]
    assert listed(spark, [t], rules.legal_bases)[0] == ["약관규제법 제6조", "약관의규제에 관한법 제15조", "상법 제2조 제1항"]


def block_machine(t, heading):
    """A plain reading of the rule: scan for headings, take the lines that follow."""
    lines, out, i = t.split("\n"), [], 0
    while i < len(lines) - 1:
        if re.search(heading, lines[i]):
            rest = lines[i + 1 :]
            k = rest.index("") if "" in rest else len(rest)
            after = "\n".join(rest[k:])
            n = 0
            if k >= len(rest) - 1 or rest[k:] == ["", ""] or re.match(r"\s*\d+\.", after):
                n = k
            else:
                n = max((j for j in range(1, k) if re.match(r"\s*\d+\.", rest[j])), default=0)
            if n:
                out.append("\n".join(rest[:n]))
                i += n
        i += 1
    return out


def test_corrections_against_line_machine(spark):
    rng = random.Random(4)
    parts = ["시정내용", "가나다라", "2. 다음", "", " 3. 줄", "변경 후 내용", "마바", "", "  ", "4", "\u3000\t"]
    texts = ["\n".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    got = listed(spark, texts, lambda c: rules.corrections(c, longer_than=0))
    for t, g in zip(texts, got):
        want = block_machine(t, "시정[내명]용") + block_machine(t, r"(?:수정|개선|삭제|변경)\s*(?:전|후|내용)")
        assert g == list(dict.fromkeys(x.strip() for x in want if x.strip())), t
    assert listed(spark, ["「가」로 수정하고 다음과 같이 한다\n이 조항은 삭제하여야 한다는 뜻이다"], rules.corrections)[0] == ["「가」로 수정하고 다음과 같이 한다", "삭제하여야 한다는 뜻이다"]


def test_rules_are_linear(spark):
    started = time.time()
    long = "시정내용\n" + "가나\n" * 30_000
    for extract in (rules.clauses, rules.violations, rules.legal_bases, rules.corrections):
        listed(spark, ["피심인의 약관 제1조\n" + "줄\n" * 100_000, "\n" * 50_000, long], extract)
    assert time.time() - started < 60


def test_many_headings_are_linear(spark):
    lines = ["시정내용 %d" % i if i % 10 < 3 else "가나다라 %d" % i for i in range(100_000)]
    texts = ["\n".join(lines), "\n".join(x + "\n" * (i % 3 == 0) for i, x in enumerate(lines)), "\n\n".join(lines) + "\n\n\n", " \n\n" * 50_000 + "시정내용\n가\n" + " \n\n" * 50_000]
    listed(spark, texts[:1], rules.corrections)
    started = time.time()
    found = listed(spark, texts, rules.corrections)
    assert time.time() - started < 10
    assert found[0] == ["\n".join(lines[1:])] and found[2:] == [[], []]


def test_strip_is_linear(spark):
    started = time.time()
    raw = [" \n" * 200_000 + "가" + " 나" * 200_000 + "\n " * 200_000, " " * 400_000, "", None, "가"]
    assert listed(spark, raw, text.strip) == ["가" + " 나" * 200_000, "", "", None, "가"]
    assert time.time() - started < 10


def test_dedup_keeps_lowest_page_and_first_place(spark):
    rows = spark.createDataFrame([("k", 3, 0, "a"), ("k", 1, 1, "b"), ("k", 1, 2, "c"), ("", 1, 3, "d"), ("m", None, 4, "e")], "k string, page int, pos int, v string")
    got = {r["dedup_key"]: (r["v"], r["first_place"]["page"]) for r in records.dedup_lowest_page(rows, F.col("k")).collect()}
    assert got == {"k": ("b", 1), "m": ("e", None)}


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=400))
def test_record_scan_is_total(data):
    assert isinstance(decode.stream_text(decode.inflated(data)), str)


def test_paragraph_units():
    units = [0xAC00, 13, 0x41, 9, *[0] * 6, 0x42, 24, 30, 31, 0xD83D, 0xDE00, 0xD800]
    assert decode.paragraph(struct.pack(f"<{len(units)}H", *units) + b"x", compat=False) == "가\nAB ­😀?"
    long = "가" * 3000
    assert decode.stream_text(decode.record("a") + decode.record(long) + decode.record("cut")[:-2]) == f"a\n{long}"
    assert decode.inflated(zlib.compress(b"x")) == b"x"


def test_archive_sections_by_name(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in [("s/section2.xml", "<a>two</a>"), ("s/section10.xml", "<a>t<b>en</b></a>"), ("s/section1.XML", "no"), ("s/section0.xml", " ")]:
            z.writestr(name, body)
    frame = spark.createDataFrame([(out.getvalue(),), (b"not a zip",), (None,)], "b binary")
    got = [r[0] for r in frame.select(decode.document_text("b")).collect()]
    assert got[0]["text"] == "ten\ntwo" and got[1]["error"].startswith("ValueError") and got[2]["text"] == ""


class _Service(BaseHTTPRequestHandler):
    calls: dict = {}

    def do_GET(self):
        n = self.calls[self.path] = self.calls.get(self.path, 0) + 1
        self.send_response(500 if "page=2" in self.path and n == 1 else 200)
        self.end_headers()
        self.wfile.write(json.dumps({"Expc": {"expc": {"id": self.path[-1], "안건명": "a"}, "totalCnt": "3"}}).encode())

    def log_message(self, *_):
        pass


def test_paged_source_retries(spark):
    server = HTTPServer(("127.0.0.1", 0), _Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/list"
    pages = paged.read(spark, url, 3, delay=0.01).persist()
    assert sorted(r["id"] for r in json_.list_entries(pages, json_.INTERPRETATION).collect()) == ["1", "2", "3"]
    assert [r["error"] for r in paged.details(spark.createDataFrame([("1",)], "id string"), url, delay=0.0).collect()] == [None]
    server.shutdown()


def test_names_of_long_texts(spark):
    """What decides a name is looked at first; the name is that of the whole text."""
    PY_WHITE, rng = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]", random.Random(5)
    long = ["", " " * 700 + "a", "_" * 700 + "b.", "a" * 139 + "_" * 600, "a" * 139 + "_" * 600 + "z", "a" * 140 + "." * 900, "ab" + " " * 800 + "c" * 300, "가 " * 500, "😀" * 600, "x" * 138 + " ._", None, "./" * 400 + "n" * 200]
    long += ["".join(rng.choice("a _./|\n\u3000") * rng.choice((1, 1, 2, 150, 600)) for _ in range(rng.randrange(12))) for _ in range(400)]

    def name(t, default="unknown"):
        t = re.sub(rf"{PY_WHITE}+", "_", re.sub(r'[\\/:*?"<>|]', "_", t))
        return re.sub(r"\A[._]+|[._]+\Z", "", t)[:140] or default

    def case(number, title):
        key = " | ".join(x for x in (re.sub(rf"\A{PY_WHITE}+|{PY_WHITE}+\Z", "", p or "") for p in (number, title)) if x)
        return name(key or "case_7", "case_7")

    frame = spark.createDataFrame([(i, t, rng.choice(["", "  ", "3 호 ", None, "q" * 600])) for i, t in enumerate(long)], "i int, t string, n string")
    rows = frame.select("*", text.safe_name(F.col("t")).alias("a"), text.case_identifier(F.col("n"), F.lit(""), F.col("t"), F.lit(7)).alias("b")).collect()
    assert [(r["a"], r["b"]) for r in rows] == [(name(r["t"]) if r["t"] is not None else "unknown", case(r["n"], r["t"])) for r in rows]
    cut = frame.select(text._named(F.substring("t", 1, text.NAME_START), F.lit(None).cast("string")).alias("a")).where("a IS NOT NULL")
    assert cut.count() > 20  # those need no look at the rest


@pytest.mark.parametrize("rule", [rules.clauses, rules.violations, rules.legal_bases])
def test_a_rule_prepares_its_text_once(spark, rule):
    """Spark does not share what stands within its array functions: each mention would be worked out again."""
    plan = spark.createDataFrame([("a",)], "t string").select(rule(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("coalesce(t#") == 1
