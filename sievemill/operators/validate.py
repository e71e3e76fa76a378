"""Validation of report rows: every broken rule is a row of violations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievemill.functions import values as V
from sievemill.functions.paths import is_valid_path

ISO = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|[+-]\d{2}:?\d{2})?$"


@dataclass(frozen=True)
class Limits:
    max_failures: int = 1000
    max_passed: int = 10_000
    max_skipped: int = 10_000
    max_code_lines: int = 100
    max_code_bytes: int = 1 << 20
    max_string: int = 10_000
    max_section_bytes: int = 500 * 1024
    max_document_bytes: int = 1 << 20

    def __post_init__(self) -> None:
        for name, value in vars(self).items():
            if value <= 0:
                raise ValueError(f"{name} must be positive")


def is_iso8601(text: Column) -> Column:
    year = F.substring(text, F.lit(1), F.lit(4)).try_cast("int")
    parsed = F.try_to_timestamp(F.regexp_replace(F.substring(text, F.lit(1), F.lit(19)), "T", " "))
    return F.coalesce(F.length(text).between(19, 30) & text.rlike(ISO) & parsed.isNotNull() & year.between(1900, 2100), F.lit(False))


@dataclass(frozen=True)
class Rule:
    """What must hold (null: it does not), what was expected, and what is there instead."""

    ok: Column
    expected: str
    actual: Column | None = None


def said(path: str, rule: Rule) -> Column:
    """The sentence about a broken rule."""
    got = F.lit("undefined") if rule.actual is None else F.coalesce(rule.actual.cast("string"), F.lit("undefined"))
    return F.concat(F.lit(f"{path}: Expected {rule.expected}, got "), got)


def _violations(rows: DataFrame, key: str, rules: dict[str, Rule]) -> DataFrame:
    """row, path, message for each rule that a row breaks, in one pass."""
    told = [F.when(~F.coalesce(r.ok, F.lit(False)), F.struct(F.lit(path).alias("path"), said(path, r).alias("message"))) for path, r in rules.items()]
    return rows.select(F.col(key).cast("string").alias("row"), F.explode(F.array_compact(F.array(*told))).alias("v")).select("row", "v.*")


def _text_rule(name: str, limits: Limits) -> Rule:
    """A text of a bounded length."""
    known = F.col(name).isNotNull()
    actual = F.when(known, F.concat(F.lit("string length "), F.length(name).cast("string")))
    return Rule(known & (F.length(name) <= limits.max_string), f"string of length <= {limits.max_string}", actual)


def summary_violations(summaries: DataFrame, key: str = "row") -> DataFrame:
    """summaries: key, total, passed, failed, skipped, duration, timestamp."""
    counts = {f"summary.{n}": Rule(F.col(n).isNotNull() & (F.col(n) >= 0), "non-negative number", F.col(n)) for n in ("total", "passed", "failed", "skipped", "duration")}
    parts = F.col("passed") + F.col("failed") + F.col("skipped")
    known = F.col("total").isNotNull() & parts.isNotNull()
    total = Rule(~known | (F.col("total") == parts), "total equal to passed + failed + skipped", F.col("total"))
    return _violations(summaries, key, counts | {"summary.timestamp": Rule(is_iso8601(F.col("timestamp")), "valid ISO 8601 timestamp", F.col("timestamp")), "summary.total (sum)": total})


def base_violations(rows: DataFrame, key: str, limits: Limits | None = None) -> DataFrame:
    """rows: key, test, file, start_line, end_line, and suite (array of strings, or null)."""
    limits = limits or Limits()
    rules = {
        "test": _text_rule("test", limits),
        "fileRelative": Rule(F.col("file").isNotNull() & (F.length("file") <= limits.max_string) & is_valid_path(F.col("file")), "valid file path", F.col("file")),
        "startLine": Rule(F.col("start_line") >= 1, "value >= 1", F.col("start_line")),
        "endLine": Rule(F.col("end_line") >= F.col("start_line"), "value >= startLine", F.col("end_line")),
        "suite": Rule(F.col("suite").isNull() | F.forall("suite", lambda s: s.isNotNull()), "array of strings", F.lit("an array with null")),
    }
    return _violations(rows, key, rules)


def error_violations(rows: DataFrame, key: str, order: str, limits: Limits | None = None, group: str | None = None) -> DataFrame:
    """rows: key, message, type, code (array or null). Code bytes add up over a document (``group``, else all rows)."""
    limits = limits or Limits()
    size = F.coalesce(F.aggregate("code", F.lit(0).cast("long"), lambda s, c: s + F.octet_length(c)), F.lit(0))
    lines = Rule(F.col("code").isNull() | (F.size("code") <= limits.max_code_lines), f"code lines <= {limits.max_code_lines}", F.size("code"))
    plain = _violations(rows, key, {"error.message": _text_rule("message", limits), "error.type": Rule(F.col("type").isNotNull(), "string"), "error.context.code": lines})
    told = lambda used: said("code size", Rule(F.lit(False), f"memory usage <= {limits.max_code_bytes}", used)).alias("message")
    if group is None:
        # the whole table is one document: only its total matters for whether any row is beyond the limit
        total = rows.agg(F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).filter(F.col("bytes") > limits.max_code_bytes)
        return plain.unionByName(total.select(F.lit("document").alias("row"), F.lit("code size").alias("path"), told(F.col("bytes"))))
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    over = rows.withColumn("running", F.sum(size).over(w)).filter(F.col("running") > limits.max_code_bytes)
    return plain.unionByName(over.select(F.col(key).cast("string").alias("row"), F.lit("code size").alias("path"), told(F.col("running"))))


def result_violations(rows: DataFrame, key: str) -> DataFrame:
    return _violations(rows, key, {"status": Rule(F.col("status").isin("passed", "skipped"), '"passed" or "skipped"', F.col("status")), "duration": Rule(F.col("duration") >= 0, "non-negative number", F.col("duration"))})


def size_violations(rows: DataFrame, limits: Limits | None = None) -> DataFrame:
    """Sections with too many rows."""
    limits = limits or Limits()
    most = {"failed": limits.max_failures, "passed": limits.max_passed, "skipped": limits.max_skipped}
    allowed = F.element_at(F.create_map(*[F.lit(x) for kv in most.items() for x in kv]), F.col("status"))
    counted = rows.groupBy("status").agg(F.count("*").alias("n")).withColumn("most", allowed).filter("n > most")
    return counted.select(F.col("status").alias("row"), F.lit("section size").alias("path"), F.format_string("%s: Expected value <= %d, got %d", "status", "most", "n").alias("message"))


#: The sections that a report may have.
SECTIONS = ("failures", "passed", "skipped")


def structure_violations(documents: DataFrame, key: str, document: str = "document", limits: Limits | None = None) -> DataFrame:
    """Report documents (JSON) that are no objects, lack a summary, or have sections that are no arrays, hold too many
    rows or bytes, or more bytes than a document may hold together. Bytes are those of the sections as compact JSON.

    A document that is no object breaks that rule alone; a section that is no array is not measured.
    """
    limits = limits or Limits()
    doc = F.col(document)
    whole = V.kind_of(doc) == "object"
    most = dict(zip(SECTIONS, (limits.max_failures, limits.max_passed, limits.max_skipped)))
    measured = documents
    for n in SECTIONS:
        got = F.try_variant_get(F.try_parse_json(doc), f"$.{n}", "variant")
        kind = V.kind_of(F.to_json(got))
        items = F.when(kind == "array", F.size(F.try_variant_get(F.try_parse_json(doc), f"$.{n}", "array<variant>")))
        measured = measured.withColumn(f"_{n}", F.struct(kind.alias("kind"), items.alias("items"), F.when(kind == "array", F.octet_length(F.to_json(got))).alias("bytes")))
    rules = {"root": Rule(whole, "object", F.coalesce(V.kind_of(doc), F.lit("undefined")))}
    not_whole = ~F.coalesce(whole, F.lit(False))
    rules["summary"] = Rule(not_whole | V.has_property(doc, "summary") & (V.kind_of(F.to_json(F.try_variant_get(F.try_parse_json(doc), "$.summary", "variant"))) == "object"), "object")
    for n in SECTIONS:
        kind, items, size = (F.col(f"_{n}.{f}") for f in ("kind", "items", "bytes"))
        rules[n] = Rule(kind.isNull() | (kind == "array"), "array", kind)
        rules[f"{n} (rows)"] = Rule(items.isNull() | (items <= most[n]), f"value <= {most[n]}", items)
        rules[f"{n} (bytes)"] = Rule(size.isNull() | (size <= limits.max_section_bytes), f"memory usage <= {limits.max_section_bytes}", size)
    together = sum((F.coalesce(f"_{n}.bytes", F.lit(0)) for n in SECTIONS), F.lit(0))
    rules["document (bytes)"] = Rule(together <= limits.max_document_bytes, f"memory usage <= {limits.max_document_bytes}", together)
    return _violations(measured, key, rules)


def json_bytes(rows: DataFrame, *columns: str) -> DataFrame:
    """JSON bytes of all rows together."""
    return rows.agg(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*columns)))), F.lit(0)).alias("bytes"))


def environment_violations(rows: DataFrame, key: str) -> DataFrame:
    """rows: key, environment (JSON text or null). Known sections must be objects, and their fields of their types."""
    doc = F.try_parse_json("environment")

    def typed(path: str, kind: str) -> Rule:
        value = F.try_variant_get(doc, path, "variant")
        return Rule(value.isNull() | F.schema_of_variant(value).isin(*kind.split("|")), kind.lower(), V.kind_of(F.to_json(value)))

    known = {"environment": Rule(F.col("environment").isNull() | F.schema_of_variant(doc).startswith("OBJECT"), "object", V.kind_of(F.col("environment")))}
    for path, kind in {"$.os.platform": "STRING", "$.os.release": "STRING", "$.os.arch": "STRING", "$.node.version": "STRING", "$.ci": "BOOLEAN", "$.packageManager": "STRING"}.items():
        known[path.replace("$", "environment")] = typed(path, kind)
    return _violations(rows, key, known)


def assertion_violations(rows: DataFrame, key: str) -> DataFrame:
    """rows: key, expected, actual as JSON text: each must parse."""
    return _violations(rows, key, {f"assertion.{n}": Rule(F.col(n).isNull() | F.try_parse_json(n).isNotNull(), "JSON value", F.col(n)) for n in ("expected", "actual")})


def messages(violations: DataFrame) -> DataFrame:
    """Violations with a sentence for people that says which row it is about."""
    return violations.withColumn("message", F.concat_ws(": ", "row", "message"))
