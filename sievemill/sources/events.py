"""Readers of event, log, document and source tables, and the environment they run in."""

from __future__ import annotations

import os
import platform
import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemill.operators.filters import level_of, without_debug


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_events(spark: SparkSession, path: str, schema: str, form: str = "json") -> DataFrame:
    """Events of a declared schema; lines that don't parse are kept aside as ``_corrupt_record``, not fatal."""
    reader = spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE")
    return reader.format(form).load(path)


def stream_events(spark: SparkSession, path: str, schema: str, form: str = "json", files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(form).load(path)


def status_of_event(kind: Column) -> Column:
    """What the events of the sample tables mean: errors fail, purchases pass, sign-ups are skipped, others are logs."""
    return F.when(kind == "error", "failed").when(kind == "purchase", "passed").when(kind == "signup", "skipped")


def attempts_of_events(events: DataFrame) -> DataFrame:
    """entity, seq, status, duration, at: one attempt for each event that has a status."""
    rows = events.select(F.col("user_id").alias("entity"), F.col("event_id").alias("seq"), status_of_event(F.col("event_type")).alias("status"), F.coalesce("value", F.lit(0.0)).alias("duration"), F.col("ts").alias("at"))
    return rows.filter("status IS NOT NULL")


def runner_logs(logs: DataFrame) -> DataFrame:
    """Runner logs (task_id, type, content, time) as messages; those without a task are left out."""
    return logs.filter("task_id IS NOT NULL").select(
        F.col("task_id").alias("entity"), F.when(F.col("type") == "stderr", "error").otherwise("log").alias("level"),
        F.col("content").alias("message"), F.col("time").alias("ts"), F.lit("task").alias("origin"),
    )


def task_logs(tasks: DataFrame, include_debug: bool = False) -> DataFrame:
    """Log entries of tasks (entity, logs array<struct<type, content, time>>) as messages in their order."""
    one = tasks.select("entity", F.posexplode("logs").alias("seq", "l")).filter("l.content IS NOT NULL AND l.type IS NOT NULL")
    rows = one.select("entity", "seq", level_of(F.col("l.type")).alias("level"), F.col("l.content").alias("message"), F.col("l.time").alias("ts"), F.lit("task").alias("origin"))
    return without_debug(rows, include_debug)


def ingested(messages: DataFrame, include_debug: bool = False) -> DataFrame:
    """Explicit messages (entity, level, message, at, start_at, elapsed_ms): their time, else the start's plus what elapsed, else now."""
    shifted = F.timestamp_millis(F.unix_millis("start_at") + F.col("elapsed_ms"))
    rows = messages.withColumns({"at": F.coalesce("at", shifted, F.current_timestamp()), "origin": F.lit("task")})
    return without_debug(rows, include_debug)


def module_children(modules: DataFrame) -> DataFrame:
    """One row for each child of each module (module_id, children array<struct<id,name,mode,file>>); null without any."""
    return modules.select("module_id", F.explode_outer("children").alias("c")).select("module_id", "c.*")


def source_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1), text of source files."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n")).alias("n", "text"))
    return whole.select("file", (F.col("n") + 1).alias("line"), "text")


def frame_context(frames: DataFrame, lines: DataFrame, around: int = 3) -> DataFrame:
    """frame_id, code: numbered lines around each frame (frame_id, file, line), joined by file and nearby line.

    Frames look up their few lines by equality, so the join is an equi-join on file and line.
    """
    wanted = frames.select("frame_id", "file", F.col("line").alias("at"), F.explode(F.sequence(F.greatest(F.lit(1), F.col("line") - around), F.col("line") + around)).alias("line"))
    found = wanted.join(lines, ["file", "line"])
    mark = F.when(F.col("line") == F.col("at"), F.lit(" // <- failure")).otherwise(F.lit(""))
    text = F.concat(F.lpad(F.col("line").cast("string"), F.greatest(F.length(F.col("line").cast("string")), F.lit(3)), F.lit(" ")), F.lit(": "), F.col("text"), mark)
    return found.groupBy("frame_id").agg(F.sort_array(F.collect_list(F.struct("line", text.alias("text")))).alias("c")).select("frame_id", F.col("c.text").alias("code"))


def package_dependencies(spark: SparkSession, path: str) -> DataFrame:
    """name of every dependency that a package.json lists in any section."""
    raw = spark.read.text(path, wholetext=True)
    parts = F.from_json("value", "dependencies map<string,string>, devDependencies map<string,string>, optionalDependencies map<string,string>, peerDependencies map<string,string>").alias("p")
    doc = raw.select(parts)
    names = F.concat(*[F.coalesce(F.map_keys(f"p.{s}"), F.expr("cast(array() as array<string>)")) for s in ("dependencies", "devDependencies", "optionalDependencies", "peerDependencies")])
    return doc.select(F.explode(names).alias("name")).distinct()


def environment(spark: SparkSession, os_info: bool = True, runtime: bool = True, ci: bool = True, packages: bool = True) -> DataFrame:
    """One row about where this runs."""
    fields = []
    if os_info:
        fields.append(F.struct(F.lit(platform.system().lower()).alias("platform"), F.lit(platform.release()).alias("release"), F.lit(platform.machine()).alias("arch")).alias("os"))
    if runtime:
        fields.append(F.struct(F.lit(spark.version).alias("spark"), F.lit(sys.version.split()[0]).alias("python")).alias("runtime"))
    agent = os.environ.get("npm_config_user_agent", "").split("/")[0]
    if packages and agent:  # only where one started this
        fields.append(F.lit(agent).alias("packageManager"))
    if ci:
        fields.append(F.lit(bool(os.environ.get("CI"))).alias("ci"))
    return spark.range(1).select(*fields)
