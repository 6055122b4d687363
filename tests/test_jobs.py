"""The three jobs from services to records, and what a second run does."""

import json
import threading
import urllib.parse
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from statuta.functions import json_
from statuta.operators import builders
from statuta.plans.jobs import DETAIL, Settings, contracts, decisions, documents
from statuta.sources import decode
from statuta.streaming import incremental

FAST = Settings(delay=0.0, attempts=1)


class Office(BaseHTTPRequestHandler):
    """A list of 25 entries, their details, and files; what is in ``down`` fails so many times."""

    down: dict = {}
    asked: list = []

    def do_GET(self):
        url = urllib.parse.urlsplit(self.path)
        query = dict(urllib.parse.parse_qsl(url.query))
        what = next(iter(query.values()))
        Office.asked.append((url.path, what))
        Office.down[url.path, what] = Office.down.get((url.path, what), 0) - 1
        self.send_response(500 if Office.down[url.path, what] >= 0 else 200)
        self.end_headers()
        if url.path == "/list":
            page = int(query["page"])
            self.wfile.write(json.dumps({"LawSearch": {"law": [{"MST": i} for i in range(10 * page - 9, min(10 * page, 25) + 1)], "totalCnt": 25, "numOfRows": 10}}).encode())
        elif url.path == "/detail":
            self.wfile.write(b"{}" if what == "7" else json.dumps({"n": int(what)}).encode())
        else:
            self.wfile.write(decode.container_of({("FileHeader",): bytes(256), ("BodyText", "Section0"): decode.record(f"text of {what}")}))

    def log_message(self, *_):
        pass


@pytest.fixture
def office():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Office)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    Office.down, Office.asked = {}, []
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_documents(spark, office, tmp_path):
    Office.down = {("/list", "3"): 1, ("/detail", "4"): 1}
    run = lambda: {r["outcome"]: r["n"] for r in documents(spark, f"{office}/list", f"{office}/detail", json_.LAW, str(tmp_path / "law"), param="MST", settings=FAST).collect()}
    assert run() == {"success": 18, "failed": 2, "failed_page": 1}
    Office.asked.clear()
    assert run() == {"skipped": 18, "success": 6, "failed": 1}
    assert sorted(int(x) for p, x in Office.asked if p == "/detail") == [4, 7, 21, 22, 23, 24, 25]
    held = incremental.held(spark, str(tmp_path / "law" / "details"), DETAIL)
    assert {int(r["id"]): json.loads(r["body"])["n"] for r in held.collect()} == {i: i for i in range(1, 26) if i != 7}


def board(category, rows, office):
    cells = "".join(f"<tr><td>{n}</td><td><a href=v>{t}</a></td><td>d</td><td>r</td><td><a href='/{builders.FILE_LINK}.do?atchmnflNo={n}'>f</a></td></tr>" for n, t in rows)
    return (category, 1, f"<table class='p-table'><tbody>{cells}</tbody></table>")


def test_contracts(spark, office, tmp_path, monkeypatch):
    monkeypatch.setattr(builders, "DOWNLOAD_URL", f"{office}/file")
    first, second = list(builders.CATEGORIES)[:2]
    pages = spark.createDataFrame([board(first, [(1, "가"), (2, "나")], office), board(second, [(3, "다")], office), board("other", [(4, "라")], office)], "category string, page long, html string")
    folder = str(tmp_path / "contracts")
    told = lambda **k: {r["outcome"]: r["n"] for r in contracts(spark, pages, folder, settings=FAST, **k).collect()}
    parsed = lambda: sorted((r["파일ID"], r["추출_텍스트"], r["원본_파일명"]) for r in spark.read.json(f"{folder}/parsed").collect())
    Office.down = {("/file", "2"): 1}
    assert told() == {"success": 2, "failed": 1, "parsed": 2}
    assert parsed() == [("1", "text of 1", f"{first}_가_1.hwp"), ("3", "text of 3", f"{second}_다_3.hwp")]
    Office.asked.clear()
    assert told(category=first) == {"success": 1, "skipped": 1, "parsed": 2}
    assert [x for _, x in Office.asked] == ["2"] and [p[0] for p in parsed()] == ["1", "2", "3"]
    Office.asked.clear()
    assert told(skip_download=True, category=second) == {"parsed": 1}
    assert Office.asked == [] and [p[0] for p in parsed()] == ["1", "2", "3"]
    with pytest.raises(ValueError, match="unknown category"):
        told(category="other")


def test_decisions(spark, tmp_path):
    row = lambda n, d, t: f"<tr><td>{n}</td><td>{n}</td><td>{d}</td><td><a href=v>{t}</a></td></tr>"
    page = lambda *rows: "<div id=contents><table><thead><tr><th>번호</th><th>사건번호</th><th>의결번호</th><th>사건명</th></tr></thead><tbody>" + "".join(rows) + "</tbody></table></div>"
    pages = spark.createDataFrame([("b", 1, page(row(1, "의결 1", "같은 제목"), row(2, "의결 2", "같은 제목"))), ("b", 2, page(row(1, "의결 1", "같은 제목"), row(3, "", "다른")))], "board string, page long, html string")
    folder = str(tmp_path / "decisions")
    texts = lambda wanted: wanted.select("file_id", F.concat("name", F.lit(".pdf")).alias("name"), F.lit("피심인의 약관 제3조 고객은 언제나 비용을 전부 부담한다고 정한다\n2. 약관규제법 제6조").alias("text"))
    assert decisions(spark, pages, folder, text_of=texts, settings=FAST).first()[:] == (4, 3, 1)
    cases = spark.read.json(f"{folder}/cases").collect()
    assert sorted((r["사건명"], r["수집_페이지"]) for r in cases) == [("같은 제목", 1), ("같은 제목", 1), ("다른", 2)]
    parsed = spark.read.json(f"{folder}/parsed").collect()
    assert sorted(r["pdf_파일"] for r in parsed) == ["1___의결_1___같은_제목.pdf".replace("___", "_|_").replace("|", "_"), "2___의결_2___같은_제목.pdf", "3___다른.pdf"]
    assert all(len(r["조항_원문"]) == 1 and r["근거_법령"] == ["약관규제법 제6조"] for r in parsed)


@pytest.mark.parametrize("wrong", [{"delay": -1}, {"attempts": 0}, {"concurrency": 0}, {"timeout": 0}, {"most_pages": 0}])
def test_settings_are_checked(wrong):
    with pytest.raises(ValueError):
        Settings(**wrong)
