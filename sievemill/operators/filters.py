"""Line filters, presets and their detection."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Presets in their order, and the lines each suppresses.
PRESETS: dict[str, tuple[str, ...]] = {
    "nest": (r"^\[Nest\]\s", r"^\[RoutesResolver\]", r"^\[InstanceLoader\]"),
    "next": (r"^(?:info|ready|event|wait|warn|error)\s+-\s", r"^Creating an optimized production build\.\.\.", r"^Compiled (?:successfully|with warnings)"),
    "nuxt": (r"^[ℹ✔✖❯]\s", r"(?i)^Nuxt\s", r"(?i)^Nitro\s"),
    "angular": (r"^[✔✖⚠ℹ]\s", r"^[⠋⠙⠹⠸⠼⠴⠦⠧⠇⠏]\s"),
    "vite": (r"(?i)^\s*VITE v\d", r"^➜\s", r"^✓\s", r"^✗\s"),
    "fastify": (r'^\{"level":\d+,"time":\d+,"pid":\d+,"hostname":.+?,"msg":"(?:Server listening|Routes ready|Plugins ready)', r"(?i)Fastify server listening on"),
    "express": (r"(?i)(?:Express|Server) listening (?:on|at)",),
    "strapi": (r"^\[\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}.*\]\s(?:info|warn|error|debug):",),
    "remix": (r"^Remix App Server", r"^💿"),
    "sveltekit": (r"(?i)^\s*SvelteKit v\d", r"(?i)^\s*(?:local|network):\shttps?:\/\/"),
}
#: Packages (a star ends a prefix) and environment variables that tell a preset is in use.
PACKAGES: dict[str, tuple[str, ...]] = {
    "nest": ("@nestjs/core", "@nestjs/*"), "next": ("next",), "nuxt": ("nuxt", "nuxt3", "@nuxt/*"), "angular": ("@angular/core", "@angular/cli"),
    "vite": ("vite",), "fastify": ("fastify", "@fastify/*"), "express": ("express",), "strapi": ("@strapi/strapi", "@strapi/*"),
    "remix": ("@remix-run/node", "@remix-run/dev", "@remix-run/serve", "remix"), "sveltekit": ("@sveltejs/kit",),
}
ENVIRONMENT = {"next": ("NEXT_TELEMETRY_DISABLED", "NEXT_RUNTIME", "NEXT_PHASE"), "nuxt": ("NUXT_TELEMETRY_DISABLED", "NUXT_HOST", "NUXT_PORT")}


def preset_patterns(names: Iterable[str]) -> list[str]:
    return [p for n in names for p in PRESETS.get(n, ())]


def suppressed(line: Column, patterns: list[str] | None) -> Column:
    """Whether a line is suppressed: None suppresses all, an empty list none. Patterns that don't compile are left out."""
    if patterns is None:
        return line.isNotNull()
    sound = []
    for p in dict.fromkeys(patterns):
        try:
            re.compile(p)
            sound.append(p)
        except re.error:
            continue
    if not sound:
        return F.lit(False)
    return F.coalesce(line.rlike("|".join(f"(?:{p})" for p in sound)), F.lit(False))


def detected_presets(dependencies: DataFrame, environment: Iterable[str] = ()) -> DataFrame:
    """preset, in the presets' order, of a table of dependency names (``name``) and environment variables."""
    hints = [(i, p, h[:-1] + "%" if h.endswith("*") else h, h.endswith("*")) for i, p in enumerate(PRESETS) for h in PACKAGES[p]]
    spark = dependencies.sparkSession
    table = F.broadcast(spark.createDataFrame(hints, "ordinal int, preset string, hint string, prefix boolean"))
    match = F.when(table["prefix"], F.like(dependencies["name"], table["hint"])).otherwise(dependencies["name"] == table["hint"])
    found = dependencies.join(table, match).select("ordinal", "preset")
    by_env = [(i, p) for i, p in enumerate(PRESETS) if set(ENVIRONMENT.get(p, ())) & set(environment)]
    if by_env:
        found = found.unionByName(spark.createDataFrame(by_env, "ordinal int, preset string"))
    return found.distinct().orderBy("ordinal").select("preset")


def success_lines(message: Column, patterns: list[str] | None) -> Column:
    """struct<message, total_lines, suppressed_lines>: what is left of a message's lines; null message if nothing."""
    lines = F.filter(F.transform(F.split(message, "\n"), lambda x: F.regexp_replace(x, "\r$", "")), lambda x: x != "")
    kept = F.filter(lines, lambda x: ~suppressed(x, patterns))
    text = F.concat(F.array_join(kept, "\n"), F.when(F.endswith(message, F.lit("\n")), "\n").otherwise(""))
    return F.struct(
        F.when(F.size(kept) > 0, text).alias("message"), F.size(lines).alias("total_lines"), (F.size(lines) - F.size(kept)).alias("suppressed_lines")
    )


def suppression_totals(messages: DataFrame, key: str, patterns: list[str] | None) -> DataFrame:
    """Lines and suppressed lines by key; zero where no filter is active."""
    if patterns == []:
        return messages.groupBy(key).agg(F.lit(0).cast("long").alias("total_lines"), F.lit(0).cast("long").alias("suppressed_lines"))
    one = messages.select(key, success_lines(F.col("message"), patterns).alias("s"))
    return one.groupBy(key).agg(F.sum("s.total_lines").alias("total_lines"), F.sum("s.suppressed_lines").alias("suppressed_lines"))


#: What kinds of log entries mean; unknown ones are plain logs.
LEVELS = {"stdout": "log", "log": "log", "stderr": "error", "error": "error", "warn": "warn", "warning": "warn", "info": "info", "debug": "debug", "trace": "trace"}


def level_of(kind: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv]), F.lower(kind)), F.lit("log"))


def without_debug(messages: DataFrame, include: bool = False) -> DataFrame:
    """Debug and trace messages go, except those that were intercepted."""
    if include:
        return messages
    return messages.filter(~F.col("level").isin("debug", "trace") | (F.coalesce(F.col("origin"), F.lit("")) == "intercepted"))
