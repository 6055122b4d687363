"""Rows and cells of HTML tables, and identifiers hidden in their markup."""

from __future__ import annotations

import html.parser
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from statuta.functions.text import first_match, normalize, or_empty

# Where boards keep their table, in the order in which places are tried: (element, class) or the id of an element around it.
DECISIONS = (("#", "contents"), ("table", "boardList"), ("table", "list"), ("table", ""))
CONTRACTS = (("table", "p-table"), ("table", ""))
# The call that loads a decision's file, its arguments, and the two together in markup.
CALL, QUOTED = "fn_downloadFile", "['\"]([^'\"]+)['\"]"
CALL_MARKUP = rf"{CALL}\(\s*{QUOTED}\s*,\s*{QUOTED}"
#: The last column of a contract row that is text; links of the next one are attachments.
ATTACHMENTS = 4

#: Pages whose rows are held as objects at a time.
PAGES = 16
_STRING = T.StringType()
_ELEMENT = T.StructType([T.StructField(n, _STRING) for n in ("onclick", "doc_id", "doc_sn")])
ROW = T.StructType([T.StructField("cells", T.ArrayType(_STRING)), T.StructField("link", _STRING), T.StructField("title_link", _STRING), T.StructField("hrefs", T.ArrayType(_STRING)),
                    T.StructField("elements", T.ArrayType(_ELEMENT)), T.StructField("hidden", T.ArrayType(_STRING)), T.StructField("html", _STRING)])
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Tables(html.parser.HTMLParser):
    """The tables of a page in order: where they stand, headings, and the rows of their bodies."""

    def __init__(self) -> None:
        super().__init__()
        self.tables: list[dict] = []
        self.open: list[tuple[str, object]] = []  # elements, with what their text goes to

    def _nearest(self, tag: str) -> object | None:
        """What the innermost open element of that tag stands for, within the innermost table."""
        for name, what in reversed(self.open):
            if name == tag:
                return what
            if name == "table":
                return None
        return None

    def _table(self) -> dict | None:
        return next((what for name, what in reversed(self.open) if name == "table"), None)

    def handle_starttag(self, tag, attrs):
        a, table, row = {k: v or "" for k, v in attrs}, self._table(), self._nearest("tr")
        what: object | None = a.get("id", "")
        if row is not None and tag != "tr":
            row["html"] += self.get_starttag_text()
        if tag == "table":
            what = {"around": {x for _, x in self.open if isinstance(x, str)}, "class": a.get("class", "").split(), "header": [], "rows": [], "firsts": set()}
            self.tables.append(what)
        elif tag in ("thead", "tbody", "tfoot"):
            what = {"rows": 0}
        elif tag == "tr" and table is not None:
            section = next((x for n in ("thead", "tbody", "tfoot") if (x := self._nearest(n)) is not None), table)
            first = (section["rows"] == 0) if section is not table else not table["rows"]
            body = self._nearest("thead") is None and self._nearest("tfoot") is None
            what = {"cells": [], "link": None, "title_link": None, "hrefs": [], "elements": [], "hidden": [], "html": "", "first": first}
            if section is not table:
                section["rows"] += 1
            if body:
                table["rows"].append(what)
        elif tag == "td" and row is not None:
            row["cells"].append("")
            what = ("cell", row)
        elif tag == "th" and table is not None:
            if self._nearest("thead") is not None or (row is not None and row["first"]):
                table["header"].append("")
                what = ("head", table)
        elif row is not None and tag in ("a", "button") or row is not None and tag == "input" and a.get("type") == "hidden":
            row["elements"].append({"onclick": a.get("onclick", ""), "doc_id": a.get("data-doc-id") or a.get("docid", ""), "doc_sn": a.get("data-doc-sn") or a.get("docsn", "")})
            if tag == "input":
                row["hidden"].append(a.get("value", ""))
            elif tag == "a":
                at = len(row["cells"]) - 1
                what = ("link", row, row["link"] is None, at == 1 and row["title_link"] is None)
                row["link"] = row["link"] or ""
                row["title_link"] = (row["title_link"] or "") if at == 1 else row["title_link"]
                if at == ATTACHMENTS and "href" in a:
                    row["hrefs"].append(a["href"])
        if tag not in _VOID:
            self.open.append((tag, what))

    def handle_endtag(self, tag):
        row = self._nearest("tr")
        if row is not None and tag != "tr":
            row["html"] += f"</{tag}>"
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), None)
        if at is not None:
            del self.open[at:]

    def handle_data(self, data):
        row = self._nearest("tr")
        if row is not None:
            row["html"] += data
        for _, what in reversed(self.open):
            if not isinstance(what, tuple):
                continue
            if what[0] == "cell":
                what[1]["cells"][-1] += data
            elif what[0] == "head":
                what[1]["header"][-1] += data
            else:
                if what[2]:
                    what[1]["link"] += data
                if what[3]:
                    what[1]["title_link"] += data


def board_table(selectors: tuple[tuple[str, str], ...], fields: tuple[str, ...] = tuple(ROW.names)):
    """page -> struct<header, rows>: the table of the first place that has one with body rows; of each place only its first table is tried.

    No table gives null. A row has those of ``fields``: the texts of its cells, of its first link and of the first link in its second cell, the links of its fifth cell,
    its links, buttons and hidden inputs, and its markup. A worker holds a batch as bytes; of ``PAGES`` pages at a time it makes rows, and gives them out.
    """
    kind_of = T.StructType([T.StructField("header", T.ArrayType(_STRING)), T.StructField("rows", T.ArrayType(T.StructType([ROW[n] for n in fields])))])

    def at(table: dict, kind: str, name: str) -> bool:
        return name in table["around"] if kind == "#" else not name or name in table["class"]

    def parse(page: str | None) -> dict | None:
        reader = _Tables()
        reader.feed(page or "")
        reader.close()
        for kind, name in selectors:
            table = next((t for t in reader.tables if at(t, kind, name)), None)
            if table is not None and table["rows"]:
                return {"header": [" ".join(h.split()) for h in table["header"]], "rows": [{k: r[k] for k in fields} for r in table["rows"]]}
        return None

    kind_of_rows = to_arrow_type(kind_of)

    @F.arrow_udf(kind_of)
    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for at in range(0, len(batch), PAGES):
                yield pa.array([parse(p) or {"header": None, "rows": None} for p in batch[at : at + PAGES].to_pylist()], kind_of_rows)

    return read.asNondeterministic()  # else filters on what it gives would work it out again


def named_cells(header: Column, cells: Column) -> Column:
    """Cells by column name; cells beyond the header are col_<i>; the last of equal names wins (P3). Needs no session setting."""
    names = F.transform(cells, lambda _, i: F.coalesce(F.get(header, i), F.concat(F.lit("col_"), i.cast("string"))))
    pairs = F.arrays_zip(names.alias("n"), cells.alias("c"))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(names, i + 2, F.greatest(F.size(names) - i - 1, F.lit(0))), lambda n: n == p["n"]))
    return F.map_from_arrays(F.transform(last, lambda p: p["n"]), F.transform(last, lambda p: p["c"]))


def with_title(cells: Column, title: Column, key: str = "사건명") -> Column:
    """The map with a non-empty title in place of key's value."""
    rest = F.map_filter(cells, lambda k, _: k != key)
    return F.when(or_empty(title) != "", F.map_concat(rest, F.create_map(F.lit(key), title))).otherwise(cells)


def file_of(elements: Column, hidden: Column, markup: Column) -> Column:
    """struct<docId, docSn>: the first element with a download call or data attributes, else two hidden inputs, else the markup.

    elements: array<struct<onclick, doc_id, doc_sn>>; hidden: array<string>.
    """
    of = lambda a, b: F.struct(a.alias("docId"), b.alias("docSn"))

    def tried(x: Column) -> Column:
        quoted = F.regexp_extract_all(or_empty(x["onclick"]), F.lit(QUOTED), F.lit(1))
        call = or_empty(x["onclick"]).contains(CALL) & (F.size(quoted) >= 2)
        return F.when(call, of(F.get(quoted, F.lit(0)), F.get(quoted, F.lit(1)))).when(or_empty(x["doc_id"]) != "", of(x["doc_id"], or_empty(x["doc_sn"])))

    a = F.get(F.filter(F.transform(elements, tried), lambda x: x.isNotNull()), F.lit(0))
    filled = F.filter(hidden, lambda h: or_empty(h) != "")
    b = F.when(F.size(filled) >= 2, of(F.get(filled, F.lit(0)), F.get(filled, F.lit(1))))
    c = F.when(or_empty(markup).rlike(CALL_MARKUP), of(first_match(markup, CALL_MARKUP, 1), first_match(markup, CALL_MARKUP, 2)))
    return F.coalesce(a, b, c)


def links(page: Column, pattern: str) -> Column:
    """All hrefs that match pattern, its group."""
    return F.regexp_extract_all(page, F.lit(pattern), F.lit(1))


def cell_text(c: Column) -> Column:
    return normalize(or_empty(c))


