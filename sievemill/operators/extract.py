"""From raw errors and tests to the rows of a report: extraction, end lines, errors outside tests, result entries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemill.functions import errors as E
from sievemill.functions import values as V
from sievemill.functions.paths import process_path
from sievemill.sources.events import frame_context

#: The properties in which errors may say where they come from.
FILE_NAMES = ("file", "fileName", "filename", "filepath", "path")
LINE_NAMES = ("line", "lineNumber", "lineno", "lineNo")
COLUMN_NAMES = ("column", "columnNumber", "col", "colno", "columnNo")


def extracted_error(properties: Column, frames: Column) -> Column:
    """struct<message, type, stack, expected, actual, line> of ``values.error_properties`` and the stack's frames.

    The line is the error's own, else that of the stack's first frame or first number between colons, else, for errors
    without a stack, that of its context.
    """
    p, first = properties, E.first_frame(frames)
    plain = F.when(p["constructor_name"] != "Object", p["constructor_name"])
    in_stack = F.nullif(F.regexp_extract(p["stack"], r":(\d+):", 1), F.lit("")).cast("long")
    line = F.when(F.length(p["stack"]) > 0, F.coalesce(first["line"].cast("long"), in_stack)).otherwise(p["context"]["line"])
    return F.struct(
        F.coalesce(p["message"], F.lit("Unknown error")).alias("message"),
        F.coalesce(E.first_text(p["name"], p["type"], plain), F.lit("Error")).alias("type"),
        p["stack"].alias("stack"), p["expected"].alias("expected"), p["actual"].alias("actual"),
        F.coalesce(p["line"], line).alias("line"),
    )


def assertion_of(properties: Column) -> Column:
    """struct<expected, expected_type, actual, actual_type> (values as JSON), null for errors that compare nothing."""
    e, a = E.assertion_value(properties["expected"]), E.assertion_value(properties["actual"])
    known = lambda n, v: F.when(properties[n].isNotNull(), v)
    fields = [known(n, v[f]).alias(n + suffix) for n, v in (("expected", e), ("actual", a)) for f, suffix in (("value", ""), ("type", "_type"))]
    return F.when(properties["expected"].isNotNull() | properties["actual"].isNotNull(), F.struct(*fields))


def extracted_errors(rows: DataFrame, root: str, error: str = "error") -> DataFrame:
    """Rows (``error`` as JSON) with ``properties``, ``frames``, ``extracted``, ``assertion`` and ``place`` (file, line,
    column): what the error says of its place, if it names a file and a line, else its first frame."""
    known = rows.withColumn("properties", V.error_properties(F.col(error)))
    known = known.withColumn("frames", E.stack_frames(F.col("properties.stack"), root, absolute=True))
    first = E.first_frame(F.col("frames"))
    file, line, column = V.text_at(F.col(error), *FILE_NAMES), *[V.number_at(F.col(error), *n) for n in (LINE_NAMES, COLUMN_NAMES)]
    named = (F.length(file) > 0) & (line > 0)
    from_frame = F.struct(F.coalesce(first["file_absolute"], first["file_relative"]).alias("file"), first["line"].cast("long").alias("line"), first["col"].cast("long").alias("column"))
    own = F.struct(file.alias("file"), line.alias("line"), F.when(column >= 0, column).alias("column"))
    return known.withColumns({
        "extracted": extracted_error(F.col("properties"), F.col("frames")), "assertion": assertion_of(F.col("properties")),
        "place": F.when(F.coalesce(named, F.lit(False)), own).when(first.isNotNull(), from_frame),
    })


def with_code(rows: DataFrame, lines: DataFrame, key: str, around: int = 3) -> DataFrame:
    """Extracted rows with ``code``: the numbered source lines (file, line, text) around their place, else the code that
    the error itself carries. One equi-join on file and line; ``key`` must be unique."""
    wanted = rows.filter("place.file IS NOT NULL AND place.line IS NOT NULL").select(F.col(key).alias("frame_id"), "place.file", F.col("place.line").alias("line"))
    found = frame_context(wanted, lines, around).select(F.col("frame_id").alias(key), F.col("code").alias("found_code"))
    own = F.when(F.length("properties.context.code") > 0, F.array("properties.context.code"))
    return rows.join(found, key, "left").withColumn("code", F.coalesce("found_code", own)).drop("found_code")


def with_end_lines(tests: DataFrame, spans: DataFrame) -> DataFrame:
    """Tests (file, start_line, end_line) that end where a span (file, start_line, end_line) that starts with them does,
    if that is later. Spans are folded before the join, so a test stays one row."""
    ends = spans.groupBy("file", "start_line").agg(F.max("end_line").alias("span_end"))
    return tests.join(ends, ["file", "start_line"], "left").withColumn("end_line", F.greatest("end_line", "span_end")).drop("span_end")


def stray_errors(errors: DataFrame, error: str = "error") -> DataFrame:
    """message, stack, type of errors outside any test, given as JSON: objects by their properties, texts as messages."""
    plain = F.when(V.kind_of(F.col(error)) == "string", F.try_variant_get(F.try_parse_json(error), "$", "string"))
    return errors.withColumns({
        "message": F.coalesce(V.text_at(F.col(error), "message"), plain, F.lit("Unhandled error")),
        "stack": V.text_at(F.col(error), "stack"), "type": F.coalesce(F.nullif(V.text_at(F.col(error), "name"), F.lit("")), F.lit("Error")),
    })


def with_teardown(failures: DataFrame, summary: DataFrame, errors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Failures (name, file, start_line, end_line, suite, message, type) with errors (message, type) of the teardown, and
    the summary with these among failed and total. Without any summary row it begins at zero."""
    rows = errors.select(
        F.lit("Teardown Error").alias("name"), F.lit("").alias("file"), F.lit(0).alias("start_line"), F.lit(0).alias("end_line"),
        F.array(F.lit("AfterAll Hook")).alias("suite"), "message", "type",
    )
    added = errors.agg(F.count("*").alias("late"))
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in summary.columns if c not in ("failed", "total")]
    more = [(F.coalesce(c, F.lit(0)) + F.col("late")).alias(c) for c in ("total", "failed")]
    # one row each
    return failures.unionByName(rows, allowMissingColumns=True), F.broadcast(added).join(summary, F.lit(True), "left").select(*more, *counts)


@dataclass(frozen=True)
class Building:
    """What the entries of a report hold."""

    root: str = ""
    suite: bool = True
    duration: bool = True
    stacks: bool = False
    absolute: bool = False


def entries(rows: DataFrame, rule: Building | None = None) -> DataFrame:
    """Rows (name, file, start_line, end_line, suite, status, duration, message, type, stack; others stay) with ``section``
    and ``entry``. Failures carry their error, ``Test failed`` if none is known; unknown states count as skipped."""
    rule = rule or Building()
    path = process_path(F.col("file"), rule.root, rule.absolute)
    failed = F.col("status") == "failed"
    error = F.struct(
        F.coalesce("message", F.lit("Test failed")).alias("message"), F.coalesce("type", F.when(F.col("message").isNull(), "TestFailure"), F.lit("Error")).alias("type"),
        *([F.nullif("stack", F.lit("")).alias("stack")] if rule.stacks else []),
    )
    fields = [F.col("name").alias("test"), path["file_relative"].alias("fileRelative")]
    fields += [path["file_absolute"].alias("fileAbsolute")] * rule.absolute
    fields += [F.col("start_line").alias("startLine"), F.col("end_line").alias("endLine")] + [F.col("suite")] * rule.suite
    fields += [F.when(~failed, F.when(F.col("status") == "passed", "passed").otherwise("skipped")).alias("status")]
    fields += [F.when(~failed, F.col("duration")).alias("duration")] * rule.duration
    known = rows.withColumn("status", F.coalesce("status", F.lit("unknown")))
    section = F.when(failed, "failures").when(F.col("status") == "passed", "passed").otherwise("skipped")
    return known.withColumns({"section": section, "entry": F.struct(*fields, F.when(failed, error).alias("error"))})


def success_entries(rows: DataFrame, rule: Building | None = None) -> DataFrame:
    """``report.success_logs`` rows as ``entry``, with their console and, if any line was seen, what was suppressed."""
    made = entries(rows.withColumns({"message": F.lit(None).cast("string"), "type": F.lit(None).cast("string"), "stack": F.lit(None).cast("string")}), rule)
    seen = (F.col("suppressed.total_lines") > 0) | (F.col("suppressed.suppressed_lines") > 0)
    console = F.when(F.size("console") > 0, F.transform("console", lambda e: e.dropFields("seq"))).alias("consoleEvents")
    return made.withColumn("entry", F.struct("entry.*", console, F.when(seen, F.col("suppressed")).alias("suppressed")).dropFields("error"))
