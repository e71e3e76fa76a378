"""Streaming forms: one line for each result, deduplication, line splitting with what is carried over, and counts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sievemill.functions.text import normalize_message
from sievemill.operators.filters import suppressed


def result_lines(rows: DataFrame) -> DataFrame:
    """``line``: an icon by raw state, the name, and the duration in ms."""
    icon = F.when(F.col("state") == "pass", "✓").when(F.col("state") == "fail", "✗").when(F.col("state") == "skip", "○").otherwise("?")
    return rows.select(F.concat(F.lit("  "), icon, F.lit(" "), "name", F.lit(" ("), F.coalesce(F.round("duration"), F.lit(0)).cast("long").cast("string"), F.lit("ms)")).alias("line"))


def first_messages(messages: DataFrame, at: str = "at", within: str = "10 minutes", per_entity: bool = False) -> DataFrame:
    """The first message of each key within the watermark; state is dropped once it can't be matched any more."""
    keyed = messages.withColumn("norm", normalize_message(F.col("message"))).withWatermark(at, within)
    return keyed.dropDuplicatesWithinWatermark(["level", "norm", *(["entity"] if per_entity else [])]).drop("norm")


def message_counts(messages: DataFrame, at: str = "at", every: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Copies of each key in each window of time."""
    keyed = messages.withColumn("norm", normalize_message(F.col("message"))).withWatermark(at, late)
    return keyed.groupBy(F.window(at, every), "level", "norm").agg(F.count("*").alias("copies"))


def complete_lines(chunks: DataFrame, idle_ms: int = 60_000) -> DataFrame:
    """stream, line of chunks (stream, seq, text): a chunk's unfinished line waits for the stream's next chunk, and is
    given out as it is once the stream was idle."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        carried = state.get[0] if state.exists else ""
        if state.hasTimedOut:
            state.remove()
            if carried:
                yield pd.DataFrame({"stream": [key[0]], "line": [carried]})
            return
        rows = pd.concat(list(batches)).sort_values("seq")
        *lines, carried = (carried + "".join(rows["text"].fillna(""))).split("\n")
        state.update((carried,))
        state.setTimeoutDuration(idle_ms)
        if lines:
            yield pd.DataFrame({"stream": [key[0]] * len(lines), "line": lines})

    return chunks.groupBy("stream").applyInPandasWithState(step, "stream string, line string", "carried string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def passing_lines(lines: DataFrame, patterns: list[str] | None) -> DataFrame:
    """Lines that no pattern suppresses."""
    return lines.filter(~suppressed(F.col("line"), patterns))
