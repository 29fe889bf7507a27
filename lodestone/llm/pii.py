"""Personal data: patterns, and terms that give protected values away.

Emails, IPv4 addresses, card and phone numbers are found by pattern and check; each distinct value is a protected
entity. How strongly a term reveals an entity is estimated from the whole corpus: with c(t) the occurrences of term
t, c(t, e) its occurrences that lie at least in part within `window` code points of entity e, N all term occurrences and P(e) the share of
them that lie near e, the pointwise mutual information log2(c(t, e) / c(t) / P(e)) is divided by the information
content -log2 P(e) of the entity. At 1 the term gives the entity away whole. A term that reaches `generalise` for any
entity is replaced by a placeholder, one that reaches `remove` goes, wherever in the corpus it is said. Every pair is judged, however seldom it
occurs: most personal values are said once or twice.

Defined results: null text counts as empty and has no spans. Positions are code points, ends exclusive. Equal texts
get equal spans; rows may repeat, and ids may be null. An empty table gives no rows. Columns of the input other than
the text don't matter, and sanitised() alone carries them; it adds `spans` and `sanitised`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import BROADCAST_ROWS, Workspace, small_enough, whole_rows

#: Fixed values. Possessive and anchored forms of the kinds' patterns: they match the same spans in linear time.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IP_VALID = r"\A0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}\z"
KINDS = ("email", "ip", "card", "phone")
PLACEHOLDER = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "generalised": "[TERM]", "removed": ""}
TERM = r"\p{L}+"
TERMS = "array<struct<action:string,s:int,e:int>>"
HIT = "array<struct<s:int,e:int,v:string>>"
#: Pieces of a text whose places are found together, and code points of the blocks that texts are cut in.
STRETCH, BLOCK = 256, 4096


def _located(text: Column, pattern: str, wanted: Callable[[Column], Column] | None = None) -> Column:
    """Matches of pattern with their places, or those that are wanted. The pieces between matches tell where each
    begins. Lengths are summed in stretches of STRETCH pieces, then within each, so that no list grows by one entry
    at a time through a whole text; only what is wanted is ever put in a list."""
    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    none = F.array().cast(HIT)
    width = lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["hit"]), F.lit(0))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["hit"]), F.lit(0))
        ok = x["hit"].isNotNull() & wanted(x["hit"]) if wanted else x["hit"].isNotNull()
        hit = F.array(F.struct(start.alias("s"), end.alias("e"), x["hit"].alias("v")))
        return F.struct(end.alias("at"), F.when(ok, F.concat(acc["out"], hit)).otherwise(acc["out"]).alias("out"))

    def stretch(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), lambda n, x: n + width(x))

    def within(part: Column, start: Column) -> Column:
        return F.aggregate(part, F.struct(start.alias("at"), none.alias("out")), add, lambda acc: acc["out"])

    def starts(parts: Column) -> Column:
        return F.aggregate(parts, F.array(F.lit(0)), lambda ends, p: F.concat(ends, F.array(F.element_at(ends, -1) + stretch(p))))

    def hits(parts: Column) -> Column:
        ends = starts(parts)
        return F.flatten(F.transform(F.arrays_zip(parts.alias("p"), F.slice(ends, F.lit(1), F.size(parts)).alias("at")), lambda x: within(x["p"], x["at"])))

    cut = lambda all_: F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / STRETCH).cast("int")), lambda k: F.slice(all_, k * STRETCH + 1, F.lit(STRETCH)))
    # Arrays of one: what a lambda names is computed once, what stands in it as an expression at every step.
    once = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)
    return F.coalesce(once(pieces, lambda all_: once(cut(all_), hits)), none)


def _luhn(value: Column) -> Column:
    digits = F.reverse(F.regexp_replace(value, "[ -]", ""))
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.when(n.between(13, 19), F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0).otherwise(False)


def base_spans(text: Column) -> dict[str, Column]:
    """The hits of each kind. A kind whose mark the text lacks isn't searched for."""
    none = F.array().cast(HIT)
    digits = lambda v: F.length(F.regexp_replace(v, "[^0-9]", ""))
    return {
        "email": F.when(F.contains(text, F.lit("@")), _located(text, EMAIL)).otherwise(none),
        "ip": F.when(F.contains(text, F.lit(".")), _located(text, IP, lambda v: v.rlike(IP_VALID))).otherwise(none),
        "card": F.when(text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), _located(text, CARD, _luhn)).otherwise(none),
        "phone": F.when(F.contains(text, F.lit("+")), _located(text, PHONE, lambda v: digits(v).between(9, 15))).otherwise(none),
    }


def _said(kind: str | Column, hits: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.transform(hits, lambda x: F.concat_ws(":", kind, x["s"], x["e"]))


def _masked(text: Column) -> Column:
    """text with emails, the one kind that has letters, as zeros of the same length."""
    pieces = F.arrays_zip(F.split(text, EMAIL, -1).alias("gap"), F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0)).alias("hit"))
    whole = F.array_join(F.transform(pieces, lambda x: F.concat(x["gap"], F.coalesce(F.repeat(F.lit("0"), F.length(x["hit"])), F.lit("")))), "")
    return F.when(F.contains(text, F.lit("@")), whole).otherwise(text)


def found(docs: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """id, key (of the text), the hits by kind, and near: for each hit its entity and the text on both sides."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("t"), F.unhex(F.sha2(text, 256)).alias("key"))
    rows = rows.select("id", "key", "t", *[hits.alias(k) for k, hits in base_spans(F.col("t")).items()])
    found = F.size("email") + F.size("ip") + F.size("card") + F.size("phone") > 0
    # Blocks of the text: what lies at a place is cut from one or two of them, not sought from the text's beginning.
    rows = rows.withColumn("m", F.when(found, _masked(F.col("t"))))
    rows = rows.withColumn("blocks", F.regexp_extract_all("m", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)))

    def around(begin: Column, end: Column) -> tuple[Column, Column]:
        """The blocks that touch the code points from begin to end, a block more on both sides, and where they begin."""
        first = F.greatest(F.floor(begin / BLOCK).cast("int") - 1, F.lit(0))
        last = F.floor(end / BLOCK).cast("int") + 1
        return F.array_join(F.slice("blocks", first + 1, last - first + 1), ""), first * BLOCK

    def run(part: Column, pattern: str) -> Column:
        return F.regexp_extract(part, pattern, 0)

    def near(kind: str) -> Column:
        value = F.lower if kind == "email" else lambda v: F.regexp_replace(v, "[^0-9.]" if kind == "ip" else "[^0-9]", "")

        def left_of(x: Column) -> Column:
            begin = F.greatest(x["s"] - window, F.lit(0))
            part, at = around(begin, x["s"])
            side, rest = F.substr(part, begin - at + 1, x["s"] - begin), F.substr(part, F.lit(1), begin - at)
            # A term that the window cuts is whole: the letters beyond the edge belong to it, were they more than blocks.
            beyond = run(rest, r"(?<!\p{L})\p{L}++\z")
            beyond = F.when((at > 0) & (F.length(beyond) == F.length(rest)), run(F.substr("m", F.lit(1), begin), r"(?<!\p{L})\p{L}++\z")).otherwise(beyond)
            return F.concat(F.when((begin > 0) & side.rlike(r"\A\p{L}"), beyond).otherwise(""), side)

        def right_of(x: Column) -> Column:
            end = x["e"] + window
            part, at = around(x["e"], end)
            side, rest = F.substr(part, x["e"] - at + 1, F.lit(window)), F.substr(part, end - at + 1, F.length(part))
            beyond = run(rest, r"\A\p{L}++")
            beyond = F.when((F.length(beyond) > 0) & (F.length(beyond) == F.length(rest)), run(F.substr("m", end + 1, F.length("m")), r"\A\p{L}++")).otherwise(beyond)
            return F.concat(side, F.when(side.rlike(r"\p{L}\z"), beyond).otherwise(""))

        return F.transform(kind, lambda x: F.struct(F.concat(F.lit(f"{kind}:"), value(x["v"])).alias("entity"), left_of(x).alias("left"), right_of(x).alias("right")))

    return rows.select("id", "key", *KINDS, F.concat(*map(near, KINDS)).alias("near"))


def _nearby(rows: DataFrame, shortest: int) -> DataFrame:
    """entity, term: each term on either side of each hit."""
    said = lambda side: F.regexp_extract_all(side, F.lit(rf"\p{{L}}{{{shortest},}}+"), F.lit(0))
    hits = rows.select(F.explode("near").alias("x")).select("x.entity", F.explode(F.concat(said("x.left"), said("x.right"))).alias("term"))
    return hits.select("entity", F.lower("term").alias("term"))


def disclosing(docs: DataFrame, nearby: DataFrame, text_col: str, space: Workspace, *, shortest: int, generalise: float, remove: float) -> DataFrame:
    """entity, term, action: the pairs whose disclosure reaches a threshold."""
    pairs = nearby.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("both"))
    pairs = space.table(pairs, "pairs")
    weight = pairs.groupBy("entity").agg(F.sum("both").alias("near"))
    wanted = pairs.select("term").distinct()
    said = docs.select(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(rf"\p{{L}}{{{shortest},}}+"), F.lit(0)).alias("terms"))
    total = said.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0)).cast("long").alias("total"))
    said = said.select(F.explode("terms").alias("term")).select(F.lower("term").alias("term"))
    if wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        said = said.join(F.broadcast(wanted), "term")
    counts = said.groupBy("term").agg(F.count(F.lit(1)).alias("alone"))
    n = total.first()["total"]
    rows = pairs.join(counts, "term").join(weight, "entity")
    content = -F.log2(F.col("near") / F.lit(float(max(n, 1))))
    share = F.least(F.col("both") / F.col("alone"), F.lit(1.0))
    disclosed = F.when(content > 0, 1 + F.log2(share) / content)
    action = F.when(disclosed >= remove, "removed").when(disclosed >= generalise, "generalised")
    return rows.select("entity", "term", action.alias("action")).where(F.col("action").isNotNull())


def _said_in(docs: DataFrame, pairs: DataFrame, text_col: str, space: Workspace, shortest: int) -> DataFrame:
    """key, terms: all places of disclosing terms, for each text that has any. Texts are joined to their terms by word
    first, and only those with a disclosing one are searched for places."""
    action = pairs.groupBy("term").agg(F.max("action").alias("action"))
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("t")).select("t", F.unhex(F.sha2("t", 256)).alias("key"))
    words = F.regexp_extract_all("t", F.lit(rf"\p{{L}}{{{shortest},}}+"), F.lit(0))
    words = texts.select("key", F.explode_outer(words).alias("term")).select("key", F.lower("term").alias("term"))
    found = words.join(small_enough(action), "term").groupBy("key").agg(F.collect_set(F.struct("term", "action")).alias("found"))
    found = space.table(found, "words")
    texts = texts.join(small_enough(found), "key").select("key", _masked(F.col("t")).alias("m"), F.map_from_entries("found").alias("found"))
    texts = texts.select("key", _located(F.col("m"), TERM, lambda v: F.map_contains_key("found", F.lower(v))).alias("hits"), "found")
    terms = F.transform("hits", lambda x: F.struct(F.element_at("found", F.lower(x["v"])).alias("action"), x["s"].alias("s"), x["e"].alias("e")))
    return texts.select("key", F.sort_array(terms).alias("terms")).groupBy("key").agg(F.first("terms").alias("terms"))


def detected(
    spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 48, shortest: int = 3,
    generalise: float = 0.9, remove: float = 0.95, space: Workspace | None = None,
) -> DataFrame:
    """One row per document: id, key, the hits by kind, terms (action, s, e)."""
    space = space or Workspace(spark, "pii")
    rows = space.table(found(docs, id_col, text_col, window), "found")
    nearby = _nearby(rows, shortest)
    pairs = space.table(disclosing(docs, nearby, text_col, space, shortest=shortest, generalise=generalise, remove=remove), "disclosing")
    said = space.table(_said_in(docs, pairs, text_col, space, shortest), "said")
    return rows.join(small_enough(said), "key", "left").select("id", "key", *KINDS, F.coalesce("terms", F.array().cast(TERMS)).alias("terms"))


def sanitised(spark: SparkSession, docs: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """docs with spans and sanitised; both replace columns of these names. Of overlapping spans the first counts."""
    rows = detected(spark, docs, id_col=text_col, text_col=text_col, **options)
    marked = lambda hits, kind: F.transform(hits, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), (F.lit(kind) if kind else x["action"]).alias("kind")))
    every = F.concat(*[marked(k, k) for k in KINDS], marked("terms", None))
    by_text = rows.select("key", F.sort_array(every).alias("_spans")).groupBy("key").agg(F.first("_spans").alias("_spans")).withColumnRenamed("key", "_key")
    text = F.coalesce("text", F.lit(""))
    put = F.create_map(*[F.lit(x) for pair in PLACEHOLDER.items() for x in pair])

    def add(acc: Column, x: Column) -> Column:
        more = F.struct(x["e"].alias("at"), F.concat(acc["out"], F.substr(text, acc["at"] + 1, x["s"] - acc["at"]), put[x["kind"]]).alias("out"))
        return F.when(x["s"] < acc["at"], acc).otherwise(more)

    rest = lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.length(text)))
    out = F.aggregate("_spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), add, rest)
    joined = whole_rows(docs, F.col(text_col).alias("text"), F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).alias("its")).join(by_text, F.col("its") == F.col("_key"))
    kept = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in ("spans", "sanitised")]
    return joined.select(*kept, F.col("_spans").alias("spans"), out.alias("sanitised"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = detected(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.concat(*[_said(k, F.col(k)) for k in KINDS])
    terms = F.transform("terms", lambda x: F.concat_ws(":", x["action"], x["s"], x["e"]))
    return rows.select(
        F.col("id").alias("doc_id"), *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(F.concat(base, terms), ",").alias("spans"),
    )
