"""Chat formatting: a finite-state machine over roles, a declarative template, segments with loss flags.

Only DataFrame functions run here. A conversation becomes one row with

* ``segments`` array<struct<text string, loss boolean>>: marker and text segments in turn order; the
  texts of turns whose role has ``loss`` carry the flag, markers never do,
* ``valid`` boolean and ``bad_turn``: what the machine says of the order of roles,
* ``formatted``: the segments' texts joined.

Texts are escaped so that no control string of the template occurs in them; ``unescape`` undoes it.

Defined cases: a null text is an empty turn; a null role is the empty role; a role that the template
lacks is written with the generic marker and makes the conversation invalid; equal turns order by role
and text, repeated rows stay; rows with a null conv_id form one conversation of their own; an empty table gives no row; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Turn:
    """Markers around a role's text, and whether the text is trained on."""

    open: str
    close: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Roles with their markers; follow: which roles may come after a state (a role, or START); final: states to end in."""

    roles: Mapping[str, Turn]
    follow: Mapping[str, tuple[str, ...]]
    final: tuple[str, ...]
    other: tuple[str, str, str] = ("[TURN]", "[TEXT]", "[/TURN]")
    controls: tuple[str, ...] = field(default=())

    def strings(self) -> list[str]:
        marks = [m.strip() for t in self.roles.values() for m in (t.open, t.close)]
        return sorted({m for m in [*marks, *self.other, *self.controls] if m}, key=lambda m: (-len(m), m))


START = ""
INSTRUCT = Template(
    roles={"system": Turn("[SYS]", "[/SYS]"), "user": Turn("[INST]", "[/INST]"), "assistant": Turn("<s>", "</s>", loss=True)},
    follow={START: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)},
    final=("assistant",),
)


def _quoted(text: str) -> str:
    return "".join(f"\\{c}" if not c.isalnum() and c not in " <>" else c for c in text)


def escape(text: Column, template: Template) -> Column:
    """A backslash before each backslash, and one inside each control string."""
    inside = "|".join(f"{_quoted(m[0])}(?={_quoted(m[1:])})" for m in template.strings())
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), f"(?:{inside})", "$0\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _case(key: Column, values: Mapping[str, object], default: object) -> Column:
    found = F.lit(default)
    for k, v in values.items():
        found = F.when(key == k, F.lit(v)).otherwise(found)
    return found


def format_turns(turns: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """One row per conversation: conv_id, n_turns, valid, bad_turn (its first refused turn, from 1), segments, formatted."""
    roles = template.roles
    a, b, c = template.other
    role, text = F.coalesce("role", F.lit("")), escape(F.coalesce("text", F.lit("")), template)
    known = role.isin(*roles)
    opened = F.when(known, _case(role, {r: t.open for r, t in roles.items()}, "")).otherwise(F.concat(F.lit(a), escape(role, template), F.lit(b)))
    closed = F.when(known, _case(role, {r: t.close for r, t in roles.items()}, "")).otherwise(F.lit(c))
    rows = turns.select("conv_id", F.struct(F.col("turn"), role.alias("role"), F.coalesce("text", F.lit("")).alias("raw"), opened.alias("open"), text.alias("text"), closed.alias("close"), _case(role, {r: t.loss for r, t in roles.items()}, False).alias("loss")).alias("t"))
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))

    def step(state: Column, turn: Column) -> Column:
        allowed = F.lit(False)
        for before, after in template.follow.items():
            allowed = allowed | ((state["at"] == before) & turn["role"].isin(*after))
        return F.struct(turn["role"].alias("at"), (state["n"] + 1).alias("n"), F.when((state["bad"] == 0) & ~allowed, state["n"] + 1).otherwise(state["bad"]).alias("bad"))

    begin = F.struct(F.lit(START).alias("at"), F.lit(0).alias("n"), F.lit(0).alias("bad"))
    ends = F.aggregate("t", begin, step)
    parts = F.flatten(F.transform("t", lambda x: F.array(
        F.struct(x["open"].alias("text"), F.lit(False).alias("loss")), F.struct(x["text"].alias("text"), x["loss"].alias("loss")), F.struct(x["close"].alias("text"), F.lit(False).alias("loss")))))
    out = convs.select("conv_id", F.size("t").cast("long").alias("n_turns"), ends.alias("e"), parts.alias("segments"))
    return out.select(
        "conv_id", "n_turns", ((F.col("e.bad") == 0) & F.col("e.at").isin(*template.final)).alias("valid"), F.nullif("e.bad", F.lit(0)).alias("bad_turn"), "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"))


def read_back(formatted: Column, template: Template = INSTRUCT) -> Column:
    """array<struct<role, text>> parsed from a formatted conversation by its markers."""
    a, b, c = template.other
    one = "|".join([*(f"{_quoted(t.open)}.*?{_quoted(t.close)}" for t in template.roles.values()), f"{_quoted(a)}.*?{_quoted(b)}.*?{_quoted(c)}"])
    turns = F.regexp_extract_all(formatted, F.lit(f"(?s)(?:{one})"), F.lit(0))

    def parsed(turn: Column) -> Column:
        body = F.split(F.substring(turn, F.lit(len(a) + 1), F.length(turn) - len(a) - len(c)), _quoted(b), 2)
        found = F.struct(unescape(F.get(body, F.lit(0))).alias("role"), unescape(F.get(body, F.lit(1))).alias("text"))
        for role, t in template.roles.items():
            inner = F.substring(turn, F.lit(len(t.open) + 1), F.length(turn) - len(t.open) - len(t.close))
            found = F.when(turn.startswith(t.open), F.struct(F.lit(role).alias("role"), unescape(inner).alias("text"))).otherwise(found)
        return found

    return F.transform(turns, parsed)


def digests(formatted: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """What a reader of the output finds: turns parsed from the text, and the unescaped text under the loss flags."""
    trained = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    turns = formatted.select("conv_id", "valid", "bad_turn", read_back(F.col("formatted"), template).alias("turns"), trained.alias("trained"), F.length("formatted").cast("long").alias("formatted_chars"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole.cast("binary"), 256).alias("turns_sha256"), F.length("trained").cast("long").alias("loss_chars"),
        F.sha2(F.col("trained").cast("binary"), 256).alias("loss_sha256"), "formatted_chars", "valid", "bad_turn")
