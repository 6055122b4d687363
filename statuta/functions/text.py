"""Scalar text functions, all JVM expressions: strings in code points, null treated as the empty string where the data has no nulls."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points that count as white space, as a regular expression class.
WHITE = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: The same without the line feed, and every other code point.
LINE_WHITE = WHITE.replace(r"\t-\r", r"\t\x{b}-\r")
NOT_WHITE = WHITE.replace("[", "[^", 1)
# Characters that file names may not hold.
FORBIDDEN = r'[\\/:*?"<>|]'
NAME_LENGTH = 140
#: Code points of a text that are looked at first for its name.
NAME_START = 4 * NAME_LENGTH


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def filled(value: Column, default: Column) -> Column:
    """value, or default where it is null or empty. F.nullif would work value out twice, and so 2^n times at n levels."""
    return let(value, lambda v: F.when(v != "", v).otherwise(default))


def normalize(c: Column) -> Column:
    """White space runs become one space; none at the ends."""
    return F.regexp_replace(F.regexp_replace(c, f"{WHITE}+", " "), "^ | $", "")


def strip(c: Column) -> Column:
    """No white space at the ends."""
    return F.regexp_extract(c, rf"(?s)\A{WHITE}*+(.*{NOT_WHITE})", 1)


def composite_key(*parts: Column) -> Column:
    """Non-empty parts joined by ' | ' (X3)."""
    return F.array_join(F.filter(F.array(*parts), lambda p: p != ""), " | ")


def _spaced(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, FORBIDDEN, "_"), f"{WHITE}+", "_")


def _named(start: Column, whole: Column) -> Column:
    """The name of a start of a text where it decides the name, else that of the whole text.

    A start's characters become a start of the text's; once one that no end loses stands at the last place of a name or after it, what follows changes nothing.
    """
    led = F.regexp_replace(_spaced(start), "^[._]+", "")
    decided = lambda x: F.substring(x, NAME_LENGTH, NAME_START).rlike("[^._]")
    full = F.substring(F.regexp_replace(_spaced(whole), r"^[._]+|[._]+\z", ""), 1, NAME_LENGTH)
    return let(led, lambda x: F.when(decided(x), F.substring(x, 1, NAME_LENGTH)).otherwise(full))


def safe_name(c: Column, default: Column | str = "unknown") -> Column:
    """A file name: forbidden characters and white space runs become underscores, none of '._' at the ends, then at most 140 characters."""
    return filled(_named(F.substring(c, 1, NAME_START), c), F.lit(default) if isinstance(default, str) else default)


def case_identifier(number: Column, decision: Column, title: Column, ordinal: Column) -> Column:
    """The stripped parts as a safe name; case_<ordinal> where all are empty or nothing is left."""
    fallback = F.concat(F.lit("case_"), ordinal.cast("string"))
    key = lambda t: filled(composite_key(*[strip(or_empty(p)) for p in (number, decision, t)]), fallback)
    # a title's start gives a start of the key, but for white space at its end
    return filled(_named(key(F.substring(title, 1, NAME_START)), key(title)), fallback)


def first_match(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null without one."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def strip_tags(c: Column) -> Column:
    """Tags go without a trace, then white space is normalised."""
    return normalize(F.regexp_replace(c, "<[^>]+>", ""))


def first_truthy(*values: Column) -> Column:
    """The first value that is neither null nor empty (P9); numbers of JSON, of which zero does not count, are told apart in functions.json_."""
    return F.coalesce(*[F.nullif(v.cast("string"), F.lit("")) for v in values])


def to_count(c: Column, default: int) -> Column:
    """A whole number with a default where it is missing; malformed text is an error."""
    return F.coalesce(c.cast("bigint"), F.lit(default).cast("bigint"))


def with_suffix(name: Column, suffix: Column) -> Column:
    """name with its last suffix replaced by the lower-cased one."""
    return F.concat(F.regexp_replace(name, r"\.[^.]*\z", ""), F.lower(suffix))


def url(base: str, **query: Column | str) -> Column:
    """base with an encoded query string."""
    parts = [F.concat(F.lit(f"{k}="), F.url_encode(F.lit(v) if isinstance(v, str) else v.cast("string"))) for k, v in query.items()]
    return F.concat(F.lit(f"{base}?"), F.concat_ws("&", *parts))


def distinct_in_order(c: Column) -> Column:
    """Each string once, at its first place."""
    return F.array_distinct(c)
