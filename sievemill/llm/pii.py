"""Personal data: pattern spans, and terms that reveal what the patterns protect, in built-in SQL functions alone.

Base spans are emails, IP addresses, card and phone numbers. Each distinct value is a protected entity. How strongly a
term reveals an entity is estimated from the corpus's co-occurrence by document: p(e) is the share of documents that
mention an entity, and p(e|t) the share of a term's documents in which it stands beside the entity. The entity's
information is -log2 p(e); the pointwise mutual information of term and entity, log2 p(e|t)/p(e), is how much of it the
term gives away. Terms that do so in at least ``support`` different texts (exact copies of a text count once, since one
text says nothing about co-occurrence) and give away the part ``generalise`` of its information or more are generalised
wherever they stand in a document that mentions the entity; from the part ``remove`` on they are removed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemill.llm.common import checkpoint
from sievemill.llm.sketch import bound

#: The kinds in their order, and what each must match. Runs are possessive and begin where a run begins
#: (or where the last match ended), so that long runs are read once; the matches are those of the plain patterns.
PATTERNS = (
    ("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    ("card", r"[0-9](?:[ -]?[0-9])++"),
    ("phone", r"\+[0-9][ ().0-9-]+[0-9]"),
)
_NEEDS = {"email": "%@%.%", "ip": "%.%.%.%", "phone": "%+%"}
_TERM = r"\p{L}[\p{L}\p{M}\p{N}_]{2,39}"
_RANK = {kind: i for i, (kind, _) in enumerate(PATTERNS)} | {"term": len(PATTERNS)}
_SPANS = "array<struct<start:int,rank:int,end:int,kind:string,value:string,action:string>>"


@dataclass(frozen=True)
class Disclosure:
    """Thresholds. ``reach``: code points on either side of an entity that count as beside it."""

    reach: int = 80
    support: int = 2
    generalise: float = 0.9
    remove: float = 0.98


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check-sum."""
    n = F.length(digits)

    def part(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda s, i: s + part(i))
    return total % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.rlike(r"^0*+(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    digits = F.regexp_replace(value, r"[^0-9]", "")
    if kind == "card":
        return F.length(digits).between(14, 19) & bound(digits, lambda d: F.when(F.length(d).between(14, 19), _luhn(d)).otherwise(F.lit(False)))
    return F.length(digits).between(10, 15)


def _checker(kind: str) -> Callable[[Column], Column]:
    return lambda span: _valid(kind, span["value"])


def _placed(text: Column, pattern: str, kind: str) -> Column:
    """All matches as spans: what lies between the matches gives their places."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    empty = F.expr(f"cast(array() as {_SPANS})")

    def walk(pair: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), empty.alias("spans"))

        def step(state: Column, one: Column) -> Column:
            begin = state["at"] + F.length(one["gap"])
            end = begin + F.length(one["value"])
            span = F.struct(begin.alias("start"), F.lit(_RANK[kind]).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), one["value"].alias("value"), F.lit("mask").alias("action"))
            return F.struct(end.alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

        return F.aggregate(pair, start, step, lambda s: s["spans"])

    pairs = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, v: F.struct(g.alias("gap"), v.alias("value")))
    return walk(pairs)


def base_spans(text: Column) -> Column:
    """All base spans of a text, by start and then kind."""
    empty = F.expr(f"cast(array() as {_SPANS})")
    parts = []
    for kind, pattern in PATTERNS:
        likely = text.like(_NEEDS[kind]) & text.rlike(pattern) if kind in _NEEDS else text.rlike(pattern)
        kept = F.filter(_placed(text, pattern, kind), _checker(kind))
        parts.append(F.when(likely, kept).otherwise(empty))
    return F.sort_array(F.concat(*parts))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _entity(span: Column) -> Column:
    """A protected entity, whatever its value's case and punctuation."""
    return F.xxhash64(span["kind"], F.regexp_replace(F.lower(span["value"]), r"[^\p{L}\p{N}@.]", ""))


def terms_of(text: Column) -> Column:
    """The terms of a text, lower-cased, repeats included."""
    return F.regexp_extract_all(F.lower(text), F.lit(_TERM), F.lit(0))


def disclosures(docs: DataFrame, mentions: DataFrame, rule: Disclosure, broadcast_terms: int = 200_000) -> DataFrame:
    """entity, term, given (part of the entity's information): all pairs at or over the generalising threshold.

    ``docs``: doc_id, text; ``mentions``: row (a number for each document), entity, content (hash of its text), terms.
    The terms of the corpus are counted only if they stand beside an entity in ``support`` texts; these are broadcast up
    to ``broadcast_terms``, else joined by shuffle.
    """
    n_docs = docs.count()
    beside = mentions.select("entity", "row", "content", F.explode("terms").alias("term"))
    # a document's mentions of an entity count once; copies are told by their content
    once = beside.groupBy("entity", "term", "content", "row").agg(F.lit(1)).groupBy("entity", "term", "content").agg(F.count("*").alias("n"))
    pairs = once.groupBy("entity", "term").agg(F.count("*").alias("texts"), F.sum("n").alias("together"))
    entities = mentions.groupBy("entity", "row").agg(F.lit(1)).groupBy("entity").agg(F.count("*").alias("in_docs"))
    information = -F.log2(F.col("in_docs") / F.lit(float(max(n_docs, 1)) + 1))

    def given(seen: str) -> Column:
        return (F.log2(F.least(F.lit(1.0), F.col("together") / F.col(seen))) + information) / information

    # a term has at least the documents in which it stands beside any entity: this leaves out the common ones
    least = beside.groupBy("term", "row").agg(F.lit(1)).groupBy("term").agg(F.count("*").alias("least"))
    pairs = pairs.filter(F.col("texts") >= rule.support).join(least, "term").join(entities, "entity")
    pairs = checkpoint(docs.sparkSession, pairs.filter(given("least") >= rule.generalise))
    wanted = pairs.select(F.col("term").alias("wanted")).distinct()
    side = F.broadcast(wanted) if wanted.count() <= broadcast_terms else wanted
    every = docs.select(F.explode(F.array_distinct(terms_of(F.col("text")))).alias("term"))
    seen = every.join(side, every["term"] == side["wanted"], "left_semi").groupBy("term").agg(F.count("*").alias("seen"))
    known = pairs.join(seen, "term").withColumn("given", given("seen"))
    return known.filter(F.col("given") >= rule.generalise).select("entity", "term", "given")


def mentions_of(spotted: DataFrame, rule: Disclosure) -> DataFrame:
    """doc_id, row, content, entity, terms: what stands beside each base span."""
    one = spotted.select("doc_id", "text", F.monotonically_increasing_id().alias("row"), F.xxhash64("text").alias("content"), F.explode("base").alias("s"))
    left = F.substring(F.col("text"), F.greatest(F.col("s.start") - rule.reach, F.lit(0)) + 1, F.least(F.lit(rule.reach), F.col("s.start")))
    right = F.substring(F.col("text"), F.col("s.end") + 1, F.lit(rule.reach))
    # words that the window's edge cuts do not count
    left = F.when(F.col("s.start") > rule.reach, F.regexp_replace(left, r"^[\p{L}\p{M}\p{N}_]+", "")).otherwise(left)
    right = F.when(F.length(right) == rule.reach, F.regexp_replace(right, r"[\p{L}\p{M}\p{N}_]++$", "")).otherwise(right)
    near = one.select("doc_id", "row", "content", _entity(F.col("s")).alias("entity"), F.concat(left, F.lit(" \n "), right).alias("near"))
    return near.select("doc_id", "row", "content", "entity", F.array_distinct(terms_of(F.col("near"))).alias("terms"))


def find(spark: SparkSession, docs: DataFrame, rule: Disclosure | None = None, broadcast_terms: int = 200_000) -> DataFrame:
    """The rows of ``docs`` with base and spans: the base spans, and those and the disclosing terms' spans.

    Null texts count as empty; repeated rows are searched each, and rows of one doc_id (or of none) share their
    disclosing terms; an empty table gives no rows. All columns of ``docs`` are kept, but for columns named base or
    spans, which are replaced. The terms of documents are broadcast if they are at most ``broadcast_terms``, else joined
    by shuffle.
    """
    rule = rule or Disclosure()
    carried = [docs[c] for c in docs.columns if c not in ("text", "base", "spans")]
    docs = docs.select(F.struct(*carried).alias("carried"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    spotted = docs.withColumn("base", base_spans(F.col("text")))
    mentions = checkpoint(spark, mentions_of(spotted.filter(F.size("base") > 0), rule))
    told = checkpoint(spark, disclosures(docs, mentions, rule, broadcast_terms))
    mentioning = mentions.select("doc_id", "entity").distinct().join(told, "entity")
    strongest = mentioning.groupBy("doc_id", "term").agg(F.max("given").alias("given"))
    action = F.when(F.col("given") >= rule.remove, F.lit("remove")).otherwise(F.lit("generalise"))
    by_doc = strongest.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("term", action))).alias("actions"))
    by_doc = checkpoint(spark, by_doc.select(F.col("doc_id").alias("told_id"), "actions"))
    size = by_doc.agg(F.coalesce(F.sum(F.size("actions")), F.lit(0))).first()[0]
    side = F.broadcast(by_doc) if size <= broadcast_terms else by_doc
    told_actions = side["actions"]
    joined = spotted.join(side, spotted["doc_id"].eqNullSafe(side["told_id"]), "left")
    pattern = rf"(?<![\p{{L}}\p{{M}}\p{{N}}_]){_TERM}(?![\p{{L}}\p{{M}}\p{{N}}_])"

    def acted(span: Column) -> Column:
        what = F.element_at(told_actions, F.lower(span["value"]))
        return F.struct(span["start"].alias("start"), span["rank"].alias("rank"), span["end"].alias("end"), span["kind"].alias("kind"), span["value"].alias("value"), what.alias("action"))

    def clear(span: Column) -> Column:
        return ~F.exists(F.col("base"), lambda b: (b["start"] < span["end"]) & (span["start"] < b["end"]))

    terms = F.filter(F.transform(_placed(F.col("text"), pattern, "term"), acted), lambda s: s["action"].isNotNull() & clear(s))
    spans = F.when(told_actions.isNotNull(), F.sort_array(F.concat(F.col("base"), terms))).otherwise(F.col("base"))
    return joined.select("carried.*", "text", "base", spans.alias("spans"))


def _of_kind(kind: str) -> Callable[[Column], Column]:
    return lambda span: span["kind"] == kind


def digest(found: DataFrame) -> DataFrame:
    """doc_id, counts of each kind, base_sha256, spans and the number of disclosing terms' spans."""
    count = {kind: F.size(F.filter("base", _of_kind(kind))).cast("long").alias(f"n_{kind}") for kind, _ in PATTERNS}
    return found.select(
        "doc_id", *count.values(), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size("base")).cast("long").alias("n_term"),
    )


def sanitised(text: Column, spans: Column) -> Column:
    """The text with base spans masked by their kind, revealing terms generalised, or removed."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        gap = F.substring(text, state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
        mark = F.when(s["action"] == "mask", F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">"))).when(s["action"] == "generalise", F.lit("<TERM>")).otherwise(F.lit(""))
        begun = s["start"] >= state["at"]
        out = F.when(begun, F.concat(state["out"], gap, mark)).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), out.alias("out"))

    whole = F.aggregate(spans, start, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    return F.when(F.size(spans) == 0, text).otherwise(whole)
