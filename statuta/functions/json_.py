"""Paged JSON envelopes whose list may be one object, an array, or missing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.functions.text import or_empty, to_count


@dataclass(frozen=True)
class Envelope:
    """Where a service keeps its list, ids and names."""

    root: str
    items: str
    ids: tuple[str, ...]
    name: str | None = None


# Envelopes of the three services.
LAW = Envelope("LawSearch", "law", ("법령일련번호", "MST"))
PRECEDENT = Envelope("PrecSearch", "prec", ("판례일련번호", "ID"), "사건명")
INTERPRETATION = Envelope("Expc", "expc", ("법령해석례일련번호", "id"), "안건명")


def truthy(value: Column) -> Column:
    """A variant as text, null where it is no value in the service's sense: null, an empty string, list or object, false, or the number zero. A quoted "0" is one."""
    kind, text = F.schema_of_variant(value), F.try_variant_get(value, "$", "string")
    number = F.try_variant_get(value, "$", "double")
    return F.when(kind == "STRING", F.nullif(text, F.lit(""))).when(kind == "BOOLEAN", F.when(text == "true", "True")).when(number.isNotNull(), F.when(number != 0, text)).when(~text.isin("[]", "{}"), text)


def items(body: Column, e: Envelope) -> Column:
    """array<struct>: an object counts as an array of one (P8). Ids keep their JSON types."""
    fields = ", ".join([*(f"`{f}` variant" for f in e.ids), *([f"`{e.name}` string"] if e.name else [])])
    return F.from_json(F.get_json_object(body, f"$.{e.root}.{e.items}"), f"array<struct<{fields}>>")


def counts(body: Column, e: Envelope, rows: int = 100) -> tuple[Column, Column]:
    """totalCnt and numOfRows with their defaults."""
    return to_count(F.get_json_object(body, f"$.{e.root}.totalCnt"), 0), to_count(F.get_json_object(body, f"$.{e.root}.numOfRows"), rows)


def list_entries(pages: DataFrame, e: Envelope) -> DataFrame:
    """page, pos, id and name of the entries with an id; pages: (page, body). Nothing is deduplicated."""
    rows = pages.select("page", F.posexplode(items(F.col("body"), e)).alias("pos", "x"))
    named = or_empty(F.col(f"x.`{e.name}`")) if e.name else F.lit("")
    return rows.select("page", "pos", F.coalesce(*[truthy(F.col(f"x.`{i}`")) for i in e.ids]).alias("id"), named.alias("name")).where("id IS NOT NULL")
