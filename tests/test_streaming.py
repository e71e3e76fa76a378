"""Streaming forms over files, driven to completion."""

import json

from pyspark.sql import functions as F

from sievemill.streaming import live


def run(query, name, mode="append"):
    q = query.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return q


def files(path, rows):
    for i, row in enumerate(rows):
        (path / f"{i}.json").write_text("\n".join(json.dumps(r) for r in (row if isinstance(row, list) else [row])))


def test_result_lines(spark, tmp_path):
    files(tmp_path, [{"state": s, "name": "n", "duration": 1.6} for s in ("pass", "fail", "skip", "passed")])
    stream = spark.readStream.schema("state string, name string, duration double").json(str(tmp_path))
    run(live.result_lines(stream), "lines")
    assert sorted(r[0] for r in spark.table("lines").collect()) == sorted(["  ✓ n (2ms)", "  ✗ n (2ms)", "  ○ n (2ms)", "  ? n (2ms)"])


def test_first_messages(spark, tmp_path):
    files(tmp_path, [{"level": "log", "message": m, "at": "2024-01-01T00:00:00"} for m in ("Hi  x", "hi x", "other")])
    stream = spark.readStream.schema("level string, message string, at timestamp").json(str(tmp_path))
    run(live.first_messages(stream), "firsts")
    assert spark.table("firsts").count() == 2
    run(live.message_counts(stream), "counts", "update")
    assert sum(r["copies"] for r in spark.table("counts").groupBy("norm").agg(F.max("copies").alias("copies")).collect()) == 3


def test_lines_are_carried_over_chunks(spark, tmp_path):
    files(tmp_path, [[{"stream": "out", "seq": 1, "text": "ab"}, {"stream": "out", "seq": 2, "text": "c\nde\nf"}, {"stream": "err", "seq": 1, "text": "x\n"}]])
    stream = spark.readStream.schema("stream string, seq long, text string").json(str(tmp_path))
    run(live.passing_lines(live.complete_lines(stream), ["^de"]), "carried", "append")
    found = {(r["stream"], r["line"]) for r in spark.table("carried").collect()}
    # the unfinished line is only given out if the run took longer than the idle time
    assert found - {("out", "f")} == {("err", "x"), ("out", "abc")}
