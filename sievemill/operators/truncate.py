"""Fitting a report to a token budget, phase by phase, until it fits.

A row's tokens are estimated once for each plan; the driver only sees sums.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemill.functions import errors as E
from sievemill.functions.text import safe_trim
from sievemill.operators.buffers import CAPS, level_capped, pass_caps


@dataclass(frozen=True)
class Budget:
    """``late``: also needed for anything to happen, as ``enabled`` alone only records the wish."""

    enabled: bool = False
    late: bool = False
    max_tokens: int = 100_000


def pretty_length(rows: DataFrame, depth: int = 2, indent: int = 2) -> Column:
    """Characters of a row as a JSON object laid out with an indent, at a depth of a document: what compact JSON has, and
    for each field and each item of an array a line break, its indent, and for fields a blank after the colon."""
    line = lambda d: 1 + indent * d
    extra = F.lit(2 * line(depth))  # the row's own line and that of its closing brace
    for f in rows.schema:
        many = F.size(f.name) > 0 if f.dataType.typeName() == "array" else F.lit(False)
        items = F.when(many, F.size(f.name) * line(depth + 2) + line(depth + 1)).otherwise(0) if f.dataType.typeName() == "array" else F.lit(0)
        extra = extra + F.when(F.col(f.name).isNotNull(), line(depth + 1) + 1 + items).otherwise(0)
    return F.length(F.to_json(F.struct("*"))) + extra + 1  # and the comma after it


def row_tokens(rows: DataFrame) -> DataFrame:
    """One row: estimated tokens of all rows as parts of an indented JSON document."""
    return rows.agg(F.coalesce(F.ceil(F.sum(pretty_length(rows)) / 4), F.lit(0)).alias("tokens"))


def _tokens(*parts: DataFrame) -> int:
    return sum(p and row_tokens(p).first()["tokens"] for p in parts)


def trimmed_errors(failures: DataFrame) -> DataFrame:
    """Phase 2: ten frames, code around the failing line, assertion values of at most 200 characters, by their kinds."""
    kind = {n: E.assertion_value(F.col(n))["type"] for n in ("expected", "actual")}
    return failures.withColumns({
        "stack": E.truncated_stack(F.col("stack"), 10), "code": E.truncated_code(F.col("code"), F.col("line")),
        "expected": E.truncated_assertion(F.col("expected"), kind["expected"]), "actual": E.truncated_assertion(F.col("actual"), kind["actual"]),
        "expected_type": kind["expected"], "actual_type": kind["actual"],
    })


def tightened(failures: DataFrame, i: int) -> DataFrame:
    """Phase 3, pass i: fewer frames, shorter messages and no code from pass 2 on, five failures from pass 4 on."""
    out = failures
    if i >= 2:
        message: Column = F.when(F.length("message") > 512, F.concat(safe_trim(F.col("message"), 512 - 100 * i), F.lit("..."))).otherwise(F.col("message"))
        code = F.when(F.size("code") > 0, F.array(F.lit("[Code context removed]"))).otherwise(F.col("code"))
        out = out.withColumns({"stack": E.truncated_stack(F.col("stack"), max(3, 10 - 2 * i)), "message": message, "code": code})
    return out.orderBy("seq").limit(5) if i >= 4 else out


def fit(failures: DataFrame, others: DataFrame, console: DataFrame, budget: Budget) -> tuple[DataFrame, DataFrame | None, DataFrame, list[str]]:
    """(failures, others, console, phases applied). ``failures``: entity, seq, message, stack, code, line, expected,
    actual; ``others``: passed and skipped rows; ``console``: entity, seq, level, message of failures."""
    phases: list[str] = []
    if not (budget.enabled and budget.late) or _tokens(failures, others, console) <= budget.max_tokens:
        return failures, others, console, phases
    phases.append("remove-low-value-sections")
    if _tokens(failures, console) <= budget.max_tokens:
        return failures, None, console, phases
    phases.append("trim-failures")
    failures, console = trimmed_errors(failures), level_capped(console, CAPS)
    for i in range(1, 6):
        if _tokens(failures, console) <= budget.max_tokens:
            break
        phases.append(f"tighten-{i}")
        failures, console = tightened(failures, i), level_capped(console, pass_caps(i))
        console = console.join(failures.select("entity").distinct(), "entity", "left_semi")
    return failures, None, console, phases
