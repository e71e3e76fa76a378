"""Bounded buffers per entity: byte and line limits, caps per level, the first n."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MARKER = "[Console output truncated]"


def bounded(messages: DataFrame, max_bytes: int = 50_000, max_lines: int = 100, marker: bool = False) -> DataFrame:
    """Each entity's messages until one would exceed a limit; from that on none. ``marker``: a row that says so."""
    order = Window.partitionBy("entity").orderBy("seq")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    sized = messages.withColumns({"used": F.sum(F.octet_length("message")).over(running), "n": F.row_number().over(order)})
    fits = (F.col("used") <= max_bytes) & (F.col("n") <= max_lines)
    kept = sized.filter(fits).drop("used", "n")
    if not marker:
        return kept
    over = sized.filter(~fits).groupBy("entity").agg(F.min("seq").alias("seq"))
    note = over.select("entity", "seq", F.lit("warn").alias("level"), F.lit(MARKER).alias("message"))
    return kept.unionByName(note, allowMissingColumns=True)


#: Levels that share a cap; what neither is named nor here counts as ``log``.
CAPS = {"debug": 0, "info": 10, "warn": 10, "log": 20, "error": 40, "total": 80}
#: Caps of the five tightening passes: info, warn, log, error, total.
PASSES = ((4, 4, 8, 16, 32), (3, 3, 6, 12, 24), (1, 1, 3, 7, 15), (0, 0, 1, 3, 7), (0, 0, 0, 0, 0))


def pass_caps(i: int) -> dict[str, int]:
    info, warn, log, error, total = PASSES[i - 1]
    return {"debug": 0, "info": info, "warn": warn, "log": log, "error": error, "total": total}


def level_capped(messages: DataFrame, caps: dict[str, int] | None = None, order: str = "seq") -> DataFrame:
    """At most so many messages of each level and in all, by entity, in order; trace counts as debug."""
    caps = caps or CAPS
    level = F.when(F.col("level") == "trace", "debug").otherwise(F.col("level"))
    known = F.create_map(*[F.lit(x) for k, v in caps.items() if k != "total" for x in (k, v)])
    per_level = messages.withColumn("capped_level", level).withColumn("n", F.row_number().over(Window.partitionBy("entity", "capped_level").orderBy(order)))
    kept = per_level.filter(F.col("n") <= F.coalesce(F.element_at(known, F.col("capped_level")), F.lit(caps["log"]))).drop("n", "capped_level")
    ranked = kept.withColumn("n", F.row_number().over(Window.partitionBy("entity").orderBy(order)))
    return ranked.filter(F.col("n") <= caps["total"]).drop("n")


def first_n(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows in a total order."""
    return rows.orderBy(*order).limit(n)


def recent_n(rows: DataFrame, n: int, by: str, *ties: str) -> DataFrame:
    """The n latest rows."""
    return rows.orderBy(F.col(by).desc(), *ties).limit(n)
