"""Extraction rules over legal text: clauses, kinds of violation, legal bases, corrective actions.

Each gives the stripped matches in rule order, each string once. Loops over lines use a marker (U+0001, removed from the text
first) before the lines that end a block, so every pattern is linear.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from statuta.functions.text import LINE_WHITE, WHITE, let, strip

# Article numbers of the Terms Act and their labels.
ARTICLES = {
    "6": "일반원칙 위반",
    "7": "면책조항 금지 위반",
    "8": "손해배상액 예정 위반",
    "9": "계약 해제·해지 제한 위반",
    "10": "채무이행 관련 위반",
    "11": "고객 권익 제한 위반",
    "12": "의사표시 의제 위반",
    "13": "대리인 책임 가중 위반",
    "14": "소제기 금지 위반",
}
# Patterns of a violation; _ stands for any white space.
WITHIN = r"[^\n.]*"
PHRASES = [
    "고객에게_부당하게_불리한_조항",
    f"상당한_이유_없이{WITHIN}불리한{WITHIN}",
    f"부당하게{WITHIN}면책{WITHIN}",
    f"손해배상{WITHIN}제한{WITHIN}",
    f"해제(?:[·,]|{WHITE})*해지{WITHIN}제한{WITHIN}",
    f"의사표시의_의제{WITHIN}",
    f"대리인의_책임{WITHIN}가중{WITHIN}",
    f"소제기의_금지{WITHIN}",
    f"불공정약관{WITHIN}해당{WITHIN}",
]
TERMS_ACT = "약관(?:의)?규제(?:에_관한)?법_"
# Statutes as cited, and whether item numbers may follow the paragraph.
STATUTES = [(TERMS_ACT, True), ("민법_", False), ("소비자기본법_", False), ("전자상거래(?:등에서의_소비자보호에_관한)?법?_", False), ("상법_", False)]
DIGITS = r"\p{Nd}+"


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern.replace("_", f"{WHITE}*")), F.lit(group))


def _listed(*found: Column, longer_than: int = -1) -> Column:
    return let(F.transform(F.concat(*found), strip), lambda every: F.array_distinct(F.filter(every, lambda x: F.length(x) > longer_than)))


def _plain(text: Column) -> Column:
    return F.replace(F.coalesce(text, F.lit("")), F.lit("\x01"), F.lit(""))


def _marked(text: Column, stop: str) -> Column:
    """A marker in place of the newline before each line that starts with stop."""
    return F.regexp_replace(text, rf"\n(?={stop})", "\x01")


def clauses(text: Column, longer_than: int = 20) -> Column:
    """Clause texts: up to a numbered line, or up to the next article heading."""
    # the first newline of the white space before an article heading; where blank lines may repeat, tried once for each run of white space
    heading = rf"(?=제{DIGITS}조)"
    back = lambda found: F.transform(found, lambda x: F.replace(x, F.lit("\x01"), F.lit("\n")))

    def article(t: Column) -> Column:
        once = F.regexp_replace(t, rf"(?<!{WHITE})({LINE_WHITE}*+)\n({WHITE}*+){heading}", "$1\x01$2")
        return F.when(t.rlike(rf"\n{LINE_WHITE}*+\n"), once).otherwise(F.regexp_replace(t, rf"\n({WHITE}*+){heading}", "\x01$1"))

    def found(t: Column) -> Column:
        of_numbered = lambda x: F.concat(_all(x, rf"피심인의_약관_제{DIGITS}조[^\x01]*"), _all(x, rf"약관_제{DIGITS}조(?:[가-힣]|{WHITE})*+\([^)]*\)[^\x01]*"))
        return F.concat(back(let(_marked(t, rf"{DIGITS}\."), of_numbered)), back(_all(article(t), rf"제{DIGITS}조_[(（][^)）]*[)）][^\x01]*")))

    return _listed(let(_plain(text), found), longer_than=longer_than)


def violations(text: Column) -> Column:
    """Phrases that name a kind of violation, then the labels of the Terms Act's articles 6 to 14 as cited."""
    labels = F.create_map(*[F.lit(x) for pair in ARTICLES.items() for x in pair])

    def found(t: Column) -> Column:
        numbers = F.filter(_all(t, rf"{TERMS_ACT}제({DIGITS})조", 1), lambda n: n.isin(*ARTICLES))
        named = F.transform(numbers, lambda n: F.concat(F.lit("약관규제법 제"), n, F.lit("조 - "), F.element_at(labels, n)))
        return F.concat(*[_all(t, p) for p in PHRASES], named)

    return _listed(let(_plain(text), found))


def legal_bases(text: Column) -> Column:
    """Citations of five statutes with article, paragraph and item."""
    paragraph, item = rf"(?:_제{DIGITS}항)?", rf"(?:_제{DIGITS}호)?"
    return _listed(let(_plain(text), lambda t: F.concat(*[_all(t, rf"{law}제{DIGITS}조{paragraph}{item if items else ''}") for law, items in STATUTES])))


# Headings of a block of corrections; _ stands for any white space within the line.
HEADINGS = ("시정[내명]용", "(?:수정|개선|삭제|변경)_(?:전|후|내용)")


def _sections(t: Column) -> Column:
    """Runs of non-empty lines. One that ends the text (at most two line feeds follow), or after whose blank lines a number follows, ends with U+0003.

    Every pattern consumes the white space that it looks at, so the work is linear in the text, however many blank lines or numbers it has.
    """
    ended = F.regexp_replace(t, r"([^\n])\n{1,2}\z", "$1")
    cut = F.regexp_replace(ended, rf"\n\n{WHITE}*+({DIGITS}\.)?", "\x02$1")
    return F.split(F.concat(F.regexp_replace(cut, rf"\x02({DIGITS}\.)", "\x03\x02$1"), F.lit("\x03")), "\x02", -1)


def _blocks(sections: Column, heading: str) -> Column:
    """The block after the first heading of each section: to its end where it is marked, else up to its last numbered line.

    A section has one block at most: its later headings lie in the block, or have nothing after them that could be one.
    """
    head = heading.replace("_", f"{LINE_WHITE}*")
    marked = lambda s: F.endswith(s, F.lit("\x03"))
    within = lambda s: F.when(marked(s), F.rtrim(s, F.lit("\x03"))).otherwise(F.regexp_extract(s, rf"(?s)\A(.*)\n{LINE_WHITE}*+{DIGITS}\.", 1))
    block = lambda s: F.regexp_extract(within(s), rf"(?s){head}[^\n]*+\n(.+)\z", 1)
    return F.filter(F.transform(F.filter(sections, lambda s: s.rlike(head)), block), lambda x: x != "")


def corrections(text: Column, longer_than: int = 10) -> Column:
    """Corrective actions: blocks after headings, amended wordings, deletions."""

    def found(t: Column) -> Column:
        some = t.rlike("|".join(HEADINGS).replace("_", f"{LINE_WHITE}*"))
        sections = F.when(some, _sections(t)).otherwise(F.array().cast("array<string>"))
        blocks = let(sections, lambda s: F.concat(*[_blocks(s, h) for h in HEADINGS]))
        return _listed(blocks, _all(t, r"「[^」]+」_(?:으로|로)_(?:수정|변경|개정)[^\n]*"), _all(t, r"삭제_(?:한다|하여야|하도록)[^\n]*"), longer_than=longer_than)

    return let(F.translate(_plain(text), "\x02\x03", ""), found)


# Rules as data for the documents of the driver: name and pattern.
GENERIC = {"license": r"(?i)licensed under [^\n]*", "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+", "phone": r"\+[0-9] \([0-9]{3}\) [0-9]{3}-[0-9]{4}", "token": r'token = "[^"]*"'}


def rule_hits(text: Column, rules: dict[str, str] = GENERIC) -> Column:
    """array<struct<rule, n>>: the matches of each rule that has some, behind a cheap test."""
    return F.filter(F.array(*[F.struct(F.lit(k).alias("rule"), F.regexp_count(text, F.lit(p)).cast("long").alias("n")) for k, p in rules.items()]), lambda x: x["n"] > 0)
