"""Personal data by bootstrapped contextual extraction, with DataFrame functions only.

1. Base: regular expressions and arithmetic checks find e-mail addresses, IPv4 addresses, payment cards and phone
   numbers in every whole text. They are the seeds.
2. Candidates: at each token that holds a digit, an at sign or its spelling [at], the base span that starts there, else the longest run of up to
   ``MOST`` neighbouring tokens of a kind's loose shape, else the token; none within an earlier one. With it go the words before and after.
3. Bootstrapping over the graph of patterns and instances: a pattern is a context (one or two words before, the word after, or
   both sides) of a kind; an instance is a distinct candidate string. In each round a pattern scores the share of
   its instances that are known for its kind, damped by few instances, and unknown instances of a kind's
   loose shape are learned if a pattern of enough score and support names them. Rounds go on until none is learned (a known instance stays
   known, so they end); each aggregates edges with partial sums, so a frequent context or string meets no task in full.
4. Learned instances become further spans of the kind wherever a trusted pattern names them, unless they overlap a base span.

Sums over the matches of a text are taken in blocks of ``STEP``, so a text of many matches costs little more than one of few.

Positions are code points, end exclusive. Defined cases: a null or empty text has no span; equal rows get equal rows; rows that share
a doc_id but not the text are told apart; a match failing its check is dropped, not retried; an empty table gives no
row; extra columns pass through ``redact`` and are ignored by ``find``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.llm.common import cut

KINDS = ("email", "ip", "card", "phone")
#: (?:\G|(?<!..)) starts a match where a leftmost search would, without trying every place of a long run.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: Whole runs of digits with single separators, of 12 to 19 digits: other runs fail the check anyway.
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
TOKENS = r"(?<![^ \t-\r])(?=[^ \t-\r]*(?:[0-9@]|[\[(](?:at|dot)[\])]))[^ \t-\r]++"
#: Tokens of a candidate at most; matches of a text whose lengths are added up at once.
MOST, STEP = 6, 64
#: Code points of a piece of a text that is put together anew.
CHUNK = 4096
#: What a learned instance of a kind must look like.
SHAPES = {
    "email": r"^[A-Za-z0-9._%+-]{2,64} ?(?:@|\[at\]|\(at\)) ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|\[dot\]|\(dot\)) ?[A-Za-z0-9-]{2,63}){1,4}$",
    "ip": r"^(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:[.,:](?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})){3}$",
    "card": r"^[0-9](?:[ .-]?[0-9]){12,18}$",
    "phone": r"^(?:\+|00)?[(]?[0-9](?:[ ()./-]{0,2}[0-9]){6,14}$",
}


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, also where use has it inside a loop over an array."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def before(values: Column, zero: Column, both: Callable[[Column, Column], Column]) -> Column:
    """For each value of a filled array those before it put together by both, zero for the first."""
    part = lambda x, at, n: F.aggregate(F.slice(x, at + 1, n), zero, both)

    def blocked(x: Column) -> Column:
        sums = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / STEP).cast("int")), lambda b: part(x, b * STEP, F.lit(STEP)))
        starts = let(sums, lambda y: F.transform(y, lambda _, b: part(y, F.lit(0), b)))
        return let(starts, lambda y: F.transform(x, lambda _, i: both(F.get(y, F.floor(i / STEP).cast("int")), part(x, i - i % STEP, i % STEP))))

    return let(values, blocked)


def matches(text: Column, pattern: str, guard: Column, tail: bool = False) -> Column:
    """array<struct<s, e, v, gap>> of the matches, gap the text since the one before: the pieces between them give the places. With tail, an empty match ends it."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    every = F.zip_with(F.split(text, pattern, -1), found, lambda g, m: F.struct(F.length(g).alias("g"), F.coalesce(F.length(m), F.lit(0)).alias("m"), F.coalesce(m, F.lit("")).alias("v"), g.alias("gap"), m.isNull().alias("last")))
    paired = every if tail else F.filter(every, lambda x: ~x["last"])

    def placed(x: Column) -> Column:
        at = before(F.transform(x, lambda p: p["g"] + p["m"]), F.lit(0), lambda a, b: a + b)
        return F.zip_with(x, at, lambda p, a: F.struct((a + p["g"]).alias("s"), (a + p["g"] + p["m"]).alias("e"), p["v"].alias("v"), p["gap"].alias("gap")))

    empty = F.array().cast("array<struct<s:int,e:int,v:string,gap:string>>")
    return F.when(guard, let(paired, lambda x: F.when(F.size(x) > 0, placed(x)).otherwise(empty))).otherwise(empty)


def stretch(chunks: Column, start: Column, end: Column) -> Column:
    """Code points start to end of a text cut into chunks of CHUNK: only the chunks at its ends are counted through."""
    first, last = F.floor(start / CHUNK).cast("int"), F.floor(end / CHUNK).cast("int")
    head = F.substring(F.get(chunks, first), start % CHUNK + 1, F.when(first == last, end - start).otherwise(CHUNK))
    middle = F.array_join(F.slice(chunks, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
    tail = F.when(first < last, F.substring(F.get(chunks, last), F.lit(1), end % CHUNK))
    return F.concat(F.coalesce(head, F.lit("")), middle, F.coalesce(tail, F.lit("")))


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(v: Column) -> Column:
    d = F.transform(F.split(F.reverse(_digits(v)), ""), lambda c, i: (lambda n: F.when(i % 2 == 0, n).otherwise(n * 2 - F.when(n > 4, 9).otherwise(0)))(c.cast("int")))
    return F.aggregate(d, F.lit(0), lambda a, b: a + b) % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
    found = {
        "email": matches(text, EMAIL, text.contains("@")),
        "ip": F.filter(matches(text, IP, text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]")), lambda m: m["v"].rlike(rf"^{part}(?:\.{part}){{3}}$")),
        "card": F.filter(matches(text, CARD, text.rlike(r"[0-9](?:[ -]?[0-9]){11}")), lambda m: luhn(m["v"])),
        "phone": F.filter(matches(text, PHONE, text.rlike(r"\+[0-9]")), lambda m: F.length(_digits(m["v"])).between(9, 15)),
    }
    return found


def digest(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined; spans: array<struct<s, k, e, ..>> with k the kind's place."""
    name = lambda x: F.element_at(F.array(*[F.lit(k) for k in KINDS]), x["k"] + 1)
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", name(x), x["s"].cast("string"), x["e"].cast("string"))), ",")


def candidates(tokens: Column, base: Column) -> Column:
    """array<struct<s, e, v, seed, free (of base spans), l1, l2, r1>> of a text's tokens, in order; tokens end with the text's tail."""
    edge = lambda v: F.regexp_replace(v, r"^[^A-Za-z0-9+(\[]+|[^A-Za-z0-9\])]+$", "")
    lead = lambda v: F.length(F.regexp_extract(v, r"^[^A-Za-z0-9+(\[]*", 0))
    shaped = lambda v: v.rlike("|".join(f"(?:{x})" for x in SHAPES.values()))
    back = lambda t, pattern: F.lower(F.reverse(F.regexp_extract(t, pattern, 1)))

    def whole(t: Column, b: Column) -> Column:
        firsts = F.transform(F.filter(F.sequence(F.lit(0), F.size(b)), lambda i: (i % STEP == 0) & (i < F.size(b))), lambda i: F.get(b, i)["s"])
        ends = before(F.concat(F.transform(b, lambda x: x["e"]), F.array(F.lit(0))), F.lit(0), lambda a, e: F.greatest(a, e))
        return let(firsts, lambda f: let(ends, lambda r: placed(t, b, f, r)))

    def placed(t: Column, b: Column, firsts: Column, ends: Column) -> Column:
        at = lambda i: F.get(t, i)

        def index(pos: Column) -> Column:
            """How many base spans start before pos."""
            return let(F.size(F.filter(firsts, lambda x: x < pos)), lambda k: F.when(k == 0, 0).otherwise((k - 1) * STEP + F.size(F.filter(F.slice(b, (k - 1) * STEP + 1, F.lit(STEP)), lambda x: x["s"] < pos))))

        def run(i: Column, n: Column) -> Column:
            """The n tokens from i on, if one space parts each from the next, without marks at the ends."""
            part = F.slice(t, i + 1, n)
            joined = F.array_join(F.transform(part, lambda x: x["v"]), " ")
            apart = F.exists(F.slice(t, i + 2, n - 1), lambda x: x["gap"] != " ") | (i + n >= F.size(t))
            return F.when(~apart, joined)

        def one(i: Column) -> Column:
            s = at(i)["s"] + lead(at(i)["v"])
            seed = let(F.get(b, index(at(i)["s"])), lambda x: F.when(x["s"] < at(i)["e"], x))
            sizes = F.sequence(F.lit(MOST), F.lit(1), F.lit(-1))
            runs = F.filter(F.transform(sizes, lambda n: edge(run(i, n))), lambda v: v.isNotNull() & shaped(v))
            own = let(F.coalesce(F.get(runs, F.lit(0)), edge(at(i)["v"])), lambda v: F.struct(s.alias("s"), (s + F.length(v)).alias("e"), v.alias("v"), F.lit(None).cast("int").alias("seed")))
            return let(seed, lambda x: F.when(x.isNotNull(), F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(None).cast("string").alias("v"), x["k"].alias("seed"))).otherwise(own))

        def free(found: Column) -> Column:
            reach = before(F.transform(found, lambda c: c["e"]), F.lit(-1), lambda a, e: F.greatest(a, e))
            return F.filter(F.zip_with(F.zip_with(found, reach, lambda c, r: F.struct(c.alias("c"), r.alias("r"))), F.sequence(F.lit(0), F.size(found) - 1), lambda x, i: F.struct(x["c"].alias("c"), x["r"].alias("r"), i.alias("i"))), lambda x: (x["c"]["s"] >= x["r"]) & (x["c"]["e"] > x["c"]["s"]))

        def told(x: Column) -> Column:
            c, i = x["c"], x["i"]
            prior = F.concat(F.coalesce(at(i - 1)["gap"], F.lit("")), F.coalesce(at(i - 1)["v"], F.lit("")), at(i)["gap"])
            inside = F.size(F.filter(F.slice(t, i + 2, F.lit(MOST + 2)), lambda y: y["s"] < c["e"]))
            after = let(i + inside + 1, lambda j: F.concat(F.coalesce(at(j)["gap"], F.lit("")), F.coalesce(at(j)["v"], F.lit(""))))
            v = F.coalesce(c["v"], F.array_join(F.transform(F.slice(t, i + 1, inside + 1), lambda y: y["v"]), " "))
            alone = let(index(c["s"]), lambda j: (F.get(ends, j) <= c["s"]) & F.coalesce(F.get(b, j)["s"] >= c["e"], F.lit(True)))
            return F.struct(c["s"].alias("s"), c["e"].alias("e"), v.alias("v"), c["seed"].alias("seed"), alone.alias("free"),
                            back(F.reverse(prior), r"^[ \t-\r]+([^ \t-\r]+)").alias("l1"), back(F.reverse(prior), r"^[ \t-\r]+([^ \t-\r]+[ \t-\r]+[^ \t-\r]+)").alias("l2"),
                            F.lower(F.regexp_extract(after, r"^[ \t-\r]+([^ \t-\r]+)", 1)).alias("r1"))

        return let(F.transform(F.sequence(F.lit(0), F.size(t) - 2), one), lambda f: let(free(f), lambda y: F.transform(y, told)))

    none = F.array().cast("array<struct<s:int,e:int,v:string,seed:int,free:boolean,l1:string,l2:string,r1:string>>")
    return let(tokens, lambda t: let(base, lambda b: F.when(F.size(t) > 1, whole(t, b)).otherwise(none)))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, the text's hash, base spans and candidates with their contexts; texts themselves are left behind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), text.alias("t"))
    rows = rows.select("doc_id", "h", "t", *[m.alias(k) for k, m in base_spans(F.col("t")).items()])
    of = lambda i: lambda m: F.struct(m["s"].alias("s"), F.lit(i).alias("k"), m["e"].alias("e"))
    spans = F.concat(*[F.transform(k, of(i)) for i, k in enumerate(KINDS)])
    rows = rows.select("doc_id", "h", F.array_sort(spans).alias("base"), matches(F.col("t"), TOKENS, F.col("t").rlike(r"[0-9@]|[\[(](?:at|dot)[\])]"), tail=True).alias("tokens"))
    return rows.select("doc_id", "h", "base", candidates(F.col("tokens"), F.col("base")).alias("cand"))


def learn(scanned: DataFrame, *, min_support: int = 3, min_score: float = 0.7) -> DataFrame:
    """doc_id, h, s, k, e of the spans that trusted patterns add."""
    c = scanned.select("doc_id", "h", F.explode("cand").alias("c")).select("doc_id", "h", "c.*")
    shaped = F.array_compact(F.array(*[F.when(F.col("v").rlike(SHAPES[k]), F.lit(i)) for i, k in enumerate(KINDS)]))
    c = c.withColumn("kinds", F.when(F.col("seed").isNotNull(), F.array("seed")).when(F.col("free"), shaped).otherwise(F.array().cast("array<int>")))
    patterns = F.array_compact(F.array(
        F.when(F.col("l1") != "", F.concat(F.lit("1:"), "l1")), F.when(F.col("l2") != "", F.concat(F.lit("2:"), "l2")),
        F.when((F.col("l1") != "") & (F.col("r1") != ""), F.concat(F.lit("3:"), "l1", F.lit(" _ "), "r1"))))
    # texts' strings can be long: graphs hold their hashes
    places = cut(c.select("doc_id", "h", "s", "e", F.xxhash64("v").alias("v"), "seed", "free", "kinds", F.transform(patterns, lambda p: F.xxhash64(p)).alias("p")))
    edges = cut(places.select(F.explode("p").alias("p"), "v", F.coalesce("seed", F.lit(-1)).alias("seed"), F.col("kinds").alias("ks")).groupBy("p", "v").agg(F.max("seed").alias("seed"), F.max("ks").alias("ks")))
    totals = cut(edges.groupBy("p").agg(F.count("*").alias("n")))
    known = cut(edges.where("seed >= 0").select("v", F.col("seed").alias("k")).distinct().withColumn("score", F.lit(1.0)))
    while True:
        # a pattern's score for a kind: known instances over all, damped by their number
        hits = edges.join(known, "v").groupBy("p", "k").agg(F.sum("score").alias("got"), F.count("*").alias("m"))
        trusted = cut(hits.where(F.col("m") >= min_support).join(totals, "p").withColumn("w", F.col("got") / (F.col("n") + 0.5)).where(F.col("w") >= min_score).select("p", "k", "w"))
        found = edges.where("seed < 0").select("p", "v", F.explode("ks").alias("k")).join(trusted, ["p", "k"]).groupBy("v", "k").agg(F.max("w").alias("score"))
        fresh = cut(found.join(known.select("v", "k"), ["v", "k"], "left_anti"))
        if not fresh.limit(1).count():
            break
        known = cut(known.unionByName(fresh))
    named = places.where("free AND seed IS NULL").select("doc_id", "h", "s", "e", F.explode("p").alias("p"), "kinds").select("doc_id", "h", "s", "e", "p", F.explode("kinds").alias("k"))
    return named.join(trusted, ["p", "k"]).groupBy("doc_id", "h", "s", "e").agg(F.max_by("k", F.struct("w", -F.col("k"))).alias("k"))


def find(docs: DataFrame, **options) -> DataFrame:
    """doc_id, h (hash of the text), base and spans: array<struct<s, k, e>> in order, k the place in KINDS."""
    scanned = cut(scan(docs))
    more = learn(scanned, **options).groupBy("doc_id", "h").agg(F.collect_set(F.struct("s", "k", "e")).alias("more"))
    rows = scanned.select("doc_id", "h", "base")
    joined = rows.join(more.withColumnsRenamed({"doc_id": "_d", "h": "_h"}), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("h") == F.col("_h")), "left")
    return joined.select("doc_id", "h", "base", F.array_sort(F.concat("base", F.coalesce("more", F.array().cast("array<struct<s:int,k:int,e:int>>")))).alias("spans"))


def redact(docs: DataFrame, **options) -> DataFrame:
    """docs with each span of ``text`` replaced by its kind in brackets, and n_chars, where there is one, counted anew."""
    spans = find(docs, **options).where(F.size("spans") > 0).select(F.col("doc_id").alias("_d"), F.col("h").alias("_h"), F.col("spans").alias("_spans")).dropDuplicates(["_d", "_h"])
    rows = docs.select(F.struct("*").alias("r"))  # in a struct, no column of docs clashes with those added
    joined = rows.join(spans, F.col("r.doc_id").eqNullSafe(F.col("_d")) & (F.xxhash64("r.text") == F.col("_h")), "left")
    empty = F.array().cast("array<struct<s:int,k:int,e:int>>")

    def left(x: Column) -> Column:
        """The stretches of text before each span that none before it reaches, and where the last one ends."""
        return let(before(F.transform(x, lambda y: y["e"]), F.lit(0), lambda a, e: F.greatest(a, e)), lambda r: F.struct(
            F.filter(F.zip_with(x, r, lambda y, a: F.struct(a.alias("from"), y["s"].alias("to"), y["k"].alias("k"))), lambda y: y["to"] >= y["from"]).alias("out"), F.array_max(F.transform(x, lambda y: y["e"])).alias("at")))

    walked = let(F.coalesce("_spans", empty), lambda x: F.when(F.size(x) > 0, left(x)))
    name = lambda x: F.element_at(F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS]), x["k"] + 1)
    some = F.col("_w").isNotNull()

    def redacted(chunks: Column) -> Column:
        pieces = F.transform(F.col("_w.out"), lambda x: F.concat(stretch(chunks, x["from"], x["to"]), name(x)))
        return F.concat(F.array_join(pieces, ""), stretch(chunks, F.col("_w.at"), F.length("r.text")))

    text = F.when(some, let(F.regexp_extract_all("r.text", F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)), redacted)).otherwise(F.col("r.text"))
    out = joined.withColumn("_w", walked).withColumn("_t", text)
    new = {"text": F.col("_t")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(some, F.length("_t").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("r.n_chars"))
    return out.select(*[new.get(c, F.col(f"r.`{c}`")).alias(c) for c in docs.columns])
