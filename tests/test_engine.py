"""The engine's operators on small literal tables."""

import json

import pytest
from pyspark.sql import functions as F

from sievemill.functions import errors as E
from sievemill.functions import paths as P
from sievemill.functions import text as T
from sievemill.functions import values as V
from sievemill.operators import attempts, buffers, dedup, extract, filters, report, sanitize, truncate, validate
from sievemill.sources import events as S
from sievemill.sources import sinks


def value(spark, column, **columns):
    names = list(columns) or ["x"]
    rows = [tuple(columns.get(n) for n in names)]
    schema = ", ".join(f"{n} {'array<string>' if isinstance(columns.get(n), list) else 'int' if isinstance(columns.get(n), int) else 'string'}" for n in names)
    return spark.createDataFrame(rows, schema).select(column.alias("v")).first()["v"]


def attempts_table(spark, **runs):
    names = {"F": "failed", "P": "passed", "S": "skipped"}
    rows, seq = [], 0
    for entity, run in runs.items():
        for c in run:
            seq += 1
            rows.append((entity, seq, names[c], 1.0))
    return spark.createDataFrame(rows, "entity string, seq long, status string, duration double")


def test_flakiness_and_retries(spark):
    found = {r["entity"]: r for r in attempts.flakiness(attempts_table(spark, t1="FFP", t2="P", t3="FF")).collect()}
    assert (found["t1"]["is_flaky"], found["t1"]["total_attempts"], found["t1"]["failed_attempts"], found["t1"]["success_attempt"]) == (True, 3, 2, 3)
    assert not found["t3"]["is_flaky"] and found["t3"]["success_attempt"] is None
    assert {r["entity"] for r in attempts.retry_info(attempts_table(spark, t1="FFP", t2="P", t3="FF")).collect()} == {"t1", "t3"}


def test_superseded_both_ways(spark):
    rows = attempts_table(spark, t1="FFP")
    assert sorted(r["status"] for r in attempts.superseded(rows).collect()) == ["failed", "passed"]
    assert [r["status"] for r in attempts.superseded(rows, clean=True).collect()] == ["passed"]


def test_status(spark):
    rows = spark.createDataFrame([("pass", None), ("fail", None), ("skip", None), ("todo", "skip"), ("odd", "run"), (None, None)], "state string, mode string")
    assert [r[0] for r in rows.select(attempts.status_of(F.col("state"), F.col("mode"))).collect()] == ["passed", "failed", "skipped", "skipped", None, None]


def test_summary_counts_unhandled(spark):
    r = report.summary(attempts_table(spark, t1="FFP", t2="P", t3="S"), unhandled=2).first()
    assert (r["total"], r["passed"], r["failed"], r["skipped"], r["flaky"], r["retried"]) == (7, 2, 4, 1, 1, 1)


@pytest.mark.parametrize("text, want", [("a\n", "a\n"), ("a  b", "a b"), ("A\x1b[31mB", "ab"), ("at 2024-01-02T03:04:05.678Z done", "at done"), ("time: 1700000000 x", "time: x"), ("[1700000000123] y", "[] y"), (" x \n\n y ", "x y"), (None, None)])
def test_normalize_message(spark, text, want):
    assert value(spark, T.normalize_message(F.col("x")), x=text) == want


def test_hash_tokens_and_trim(spark):
    assert value(spark, T.djb2(F.col("x")), x="hello world") == "eslcxt" and value(spark, T.djb2(F.col("x")), x="") == "45h"
    assert [value(spark, T.estimate_tokens(F.col("x")), x="a" * n) for n in (0, 1, 4, 5)] == [0, 1, 1, 2]
    assert value(spark, T.utf16_length(F.col("x")), x="😀") == 2
    assert value(spark, T.safe_trim(F.col("x"), 50), x="b" * 80) == "b" * 45
    words = "word " * 100
    assert value(spark, T.safe_trim(F.col("x"), 200), x=words) == "word " * 36
    with pytest.raises(ValueError):
        T.estimate_tokens(F.lit("x"), 0)


def test_json_escape_and_home(spark):
    text = 'a"b\\c\n\t\x01\x7f'
    assert value(spark, T.json_escape(F.col("x")), x=text) == json.dumps(text, ensure_ascii=False)[1:-1]
    assert value(spark, T.mask_home(F.col("x")), x="/home/ann/home/bob") == "/Users/***/home/bob"


def test_text_helpers(spark):
    assert value(spark, T.join_with_ellipsis(F.col("x")), x=["a", " ", "b"]) == "a...b"
    assert value(spark, T.head_and_tail(F.col("x")), x="1\n2\n3\n4\n5").asDict() == {"head": "1\n2", "tail": "4\n5"}
    assert value(spark, T.tiny_limit(F.col("x"), 6), x="hi\nTypeError: very long message indeed").startswith("TypeError: very")
    assert value(spark, T.fair_caps(F.col("x"), 300), x=["a" * 50, "b" * 500, "c" * 500])[0] == "a" * 50
    assert value(spark, T.lines_with_context(F.lit(10), F.array(F.lit(0), F.lit(5))), x="") == [0, 1, 4, 5, 6]
    assert value(spark, T.is_user_path(F.col("x")), x="at node:internal") in (True, False)


def test_paths(spark):
    assert value(spark, P.normalize_path(F.col("x")), x="file:///a//b") == "/a/b"
    assert value(spark, P.repo_relative(F.col("x"), "/r/a"), x="/r/ab/c") == "/r/ab/c"
    assert value(spark, P.repo_relative(F.col("x"), "/r/a"), x="/r/a/") == "."
    got = value(spark, P.process_path(F.col("x"), "/r"), x="file:///r/node_modules/y.js")
    assert (got["file_relative"], got["in_project"], got["in_node_modules"]) == ("node_modules/y.js", False, True)
    for path, ok in (("src/a.ts", True), ("", False), ("a/../b", False), ("a%2e%2e/b", False), ("javascript:x", False), ("a%zz", False), ("a+b", True), ("x\0y", False)):
        assert value(spark, P.is_valid_path(F.col("x")), x=path) is ok, path


def test_path_validator(tmp_path):
    (tmp_path / "f").write_text("x")
    v = P.PathValidator(str(tmp_path))
    assert v.validate(str(tmp_path / "f")) and v.validate(str(tmp_path / "f")) and v.validate("/etc/passwd") is None
    assert (v.hits, v.misses) == (1, 2)


STACK = "TypeError: no\n    at run (/r/src/a.ts:5:7)\n    at async f (file:///r/node_modules/x.js?v=1:1:2)\n    at node:internal/x:1:1\n    at /other/y.js:3:4\n    at z (<anonymous>:1:1)"


def test_stack_frames(spark):
    got = value(spark, E.stack_frames(F.col("x"), "/r"), x=STACK)
    assert [(f["file_relative"], f["line"], f["col"], f["function"], f["in_project"], f["in_node_modules"]) for f in got] == [
        ("src/a.ts", 5, 7, "run", True, False), ("node_modules/x.js", 1, 2, "f", False, True), ("/other/y.js", 3, 4, None, False, False),
    ]
    assert len(value(spark, E.stack_frames(F.col("x"), "/r", drop_node_modules=True), x=STACK)) == 2
    cut = value(spark, E.truncated_stack(F.col("x"), 1), x=STACK).split("\n")
    assert cut[0] == "TypeError: no" and "a.ts" in cut[1] and cut[2] == "    ... 4 frames omitted"


def test_code_and_assertions(spark):
    assert value(spark, E.code_window(F.col("x"), F.lit(2), F.lit(9), 1), x="a\nb\nc\nd") == ["  1: a", "  2: b // <- failure at column 9", "  3: c"]
    assert value(spark, E.code_window(F.col("x"), F.lit(9)), x="a") is None
    lines = [f"l{i}" for i in range(11)]
    assert value(spark, E.limited_code(F.col("x")), x=lines) == [*lines[:5], "...", *lines[-5:]]
    assert value(spark, E.truncated_code(F.col("x"), F.lit(40)), x=lines) == ["..."]
    assert value(spark, E.truncated_code(F.col("x"), F.lit(40), rebase=True), x=lines) == ["...", *lines[3:8], "..."]
    for raw, kind in (("5", "number"), ("-1.5", "number"), ("true", "boolean"), ("null", "null"), (None, "null"), ("[1]", "array"), ('{"a":1}', "Record<string, unknown>"), ("x", "string")):
        assert value(spark, E.assertion_value(F.col("x")), x=raw)["type"] == kind
    assert value(spark, E.first_number(F.col("x")), x=" 12px") == 12 and value(spark, E.first_number(F.col("x")), x="px") is None
    assert value(spark, E.formatted_error(F.lit("E"), F.lit("m"), F.lit(3), F.col("x"), F.lit("2")), x=None) == "E: m\n  at line 3\n  Actual: 2"


def messages(spark, *rows):
    return spark.createDataFrame(rows, "entity string, seq long, level string, message string")


def test_dedup(spark):
    df = messages(spark, ("a", 1, "log", "Hi"), ("b", 2, "log", "hi"), ("a", 3, "warn", "hi"), ("a", 4, "log", "hi "), (None, 5, "log", "HI"))
    first = {r["seq"]: r for r in dedup.first_of_each(df).collect()}
    assert set(first) == {1, 3, 4} and first[1]["copies"] == 3 and first[1]["last_seq"] == 5
    per = dedup.first_of_each(df, dedup.Dedup(scope="per-test"))
    assert per.count() == 5
    assert dedup.statistics(df).first().asDict() == {"total_logs": 5, "unique_logs": 3, "duplicates_removed": 2}
    assert dedup.first_of_each(df, dedup.Dedup.of(False)).count() == 5
    with pytest.raises(ValueError):
        dedup.Dedup(max_entries=0)
    with pytest.raises(ValueError):
        dedup.Dedup(scope="other")


def test_lru_cache_forgets(spark):
    rows = [("e", i, "log", m) for i, m in enumerate("abcabacda")]
    for size in (1, 2, 3, 10):
        cache, want = [], []
        for i, m in enumerate("abcabacda"):
            if m in cache:
                cache.remove(m)
            else:
                want.append(i)
                cache = cache[1:] if len(cache) >= size else cache
            cache.append(m)
        assert sorted(r["seq"] for r in dedup.first_of_each(messages(spark, *rows), dedup.Dedup(max_entries=size)).collect()) == want


def test_adjacent_and_merge(spark):
    ev = lambda *t: [(0, i, "log", "x", ts) for i, ts in enumerate(t)]
    df = spark.createDataFrame([(ev(0, 4, 8),)], "e array<struct<src:int,seq:int,level:string,message:string,ts:long>>")
    assert [e["ts"] for e in df.select(dedup.without_adjacent(F.col("e")).alias("e")).first()["e"]] == [0, 8]
    schema = "k string, seq long, level string, message string, ts long"
    a = spark.createDataFrame([("k", 1, "log", "one", 10), ("only", 1, "log", "s", None), ("only", 2, "log", "s", None)], schema)
    b = spark.createDataFrame([("k", 1, "log", "zero", 5), ("k", 2, "log", "one", 12)], schema)
    got = {r["k"]: [e["message"] for e in r["events"]] for r in dedup.merged_sources(a, b, "k").collect()}
    assert got == {"k": ["zero", "one"], "only": ["s", "s"]}


def test_buffers(spark):
    df = messages(spark, *[("a", i, "log", "x" * 10) for i in range(10)], ("b", 0, "warn", "é" * 30), ("b", 1, "log", "y"))
    assert sorted((r["entity"], r["seq"]) for r in buffers.bounded(df, 45, 100).collect()) == [("a", 0), ("a", 1), ("a", 2), ("a", 3)]
    assert [r["message"] for r in buffers.bounded(df, 45, 100, marker=True).filter("level = 'warn'").collect()] == [buffers.MARKER] * 2
    assert buffers.bounded(df, 10**6, 3).filter("entity = 'a'").count() == 3
    mixed = messages(spark, *[("a", i, lv, "m") for i, lv in enumerate(["debug", "trace", "info", "info", "error", "log"] * 3)])
    kept = [r["level"] for r in buffers.level_capped(mixed, buffers.pass_caps(3)).orderBy("seq").collect()]
    assert sorted(kept) == ["error"] * 3 + ["info"] + ["log"] * 3
    assert [tuple(buffers.pass_caps(i).values())[1:] for i in (1, 4)] == [(4, 4, 8, 16, 32), (0, 0, 1, 3, 7)]


def test_filters(spark):
    assert value(spark, filters.suppressed(F.col("x"), None), x="a") is True and value(spark, filters.suppressed(F.col("x"), []), x="a") is False
    assert value(spark, filters.suppressed(F.col("x"), ["(", "^a"]), x="abc") is True
    banners = ["[Nest] 1 - start", "VITE v5 ready", "Server listening on 3000", "CI: yes", "real output"]
    rules = filters.preset_patterns(["nest", "vite", "express"]) + [r"(?i)^CI\s?:"]
    assert [b for b in banners if not value(spark, filters.suppressed(F.col("x"), rules), x=b)] == ["real output"]
    deps = spark.createDataFrame([("vite",), ("@nestjs/common",), ("left-pad",)], "name string")
    assert [r["preset"] for r in filters.detected_presets(deps, ["NUXT_PORT"]).collect()] == ["nest", "nuxt", "vite"]
    got = value(spark, filters.success_lines(F.col("x"), ["^b"]), x="a\r\n\nb\nc\n")
    assert (got["message"], got["total_lines"], got["suppressed_lines"]) == ("a\nc\n", 3, 1)
    assert value(spark, filters.success_lines(F.col("x"), ["^b"]), x="b\n")["message"] is None
    assert value(spark, filters.level_of(F.col("x")), x="stderr") == "error" and value(spark, filters.level_of(F.col("x")), x="odd") == "log"


def test_validation(spark):
    rows = spark.createDataFrame([("1", 3, 1, 1, 1, 5.0, "2024-01-02T03:04:05Z"), ("2", 4, 1, 1, 1, 5.0, "yesterday"), ("3", -1, 0, 0, 0, None, "2024-13-02T03:04:05Z")], "row string, total long, passed long, failed long, skipped long, duration double, timestamp string")
    got = {(r["row"], r["path"]) for r in validate.summary_violations(rows).collect()}
    assert got == {("2", "summary.total (sum)"), ("2", "summary.timestamp"), ("3", "summary.total"), ("3", "summary.duration"), ("3", "summary.timestamp"), ("3", "summary.total (sum)")}
    base = spark.createDataFrame([("a", "t", "src/x.ts", 1, 2, ["s"]), ("b", None, "../x", 0, -1, [None])], "k string, test string, file string, start_line int, end_line int, suite array<string>")
    assert {r["path"] for r in validate.base_violations(base, "k").filter("row = 'b'").collect()} == {"test", "fileRelative", "startLine", "endLine", "suite"}
    assert validate.base_violations(base, "k").filter("row = 'a'").count() == 0
    errors = spark.createDataFrame([("a", 1, "m", "T", ["x" * 60]), ("b", 2, None, "T", ["y" * 60])], "k string, seq int, message string, type string, code array<string>").withColumn("doc", F.lit(1))
    got = {(r["row"], r["path"]) for r in validate.error_violations(errors, "k", "seq", validate.Limits(max_code_bytes=100), group="doc").collect()}
    assert got == {("b", "error.message"), ("b", "code size")}
    with pytest.raises(ValueError):
        validate.Limits(max_string=0)


def test_sanitizing(spark):
    df = spark.createDataFrame([("/home/x/a", {"__proto__": "1", "k": 'v"'}, [("q\n",)])], "p string, m map<string,string>, s array<struct<t:string>>")
    r = sanitize.sanitized(df, paths=("p",)).first()
    assert r["p"] == "/Users/***/a" and r["m"] == {"k": 'v\\"'} and r["s"][0]["t"] == "q\\n"
    got = spark.createDataFrame([('{"constructor": 1, "a": ["x\\"y"]}',), ("nope",), (None,)], "j string").select(sanitize.safe_json("j").alias("v")).collect()
    assert json.loads(got[0]["v"]) == {"a": ['x\\"y']} and got[1]["v"] is None and got[2]["v"] is None


def test_truncation_runs_until_it_fits(spark):
    failures = spark.createDataFrame([(f"e{i}", i, "m" * 900, "Error: x\n" + "    at f (/a.ts:1:2)\n" * 30, ["c"] * 9, 4, "1", "2") for i in range(20)], "entity string, seq long, message string, stack string, code array<string>, line int, expected string, actual string")
    others = spark.createDataFrame([("o", 1)], "entity string, seq long")
    console = messages(spark, *[(f"e{i}", j, "log", "line " * 20) for i in range(20) for j in range(30)])
    same = truncate.fit(failures, others, console, truncate.Budget(enabled=True))
    assert same[3] == [] and same[0] is failures
    out, rest, logs, phases = truncate.fit(failures, others, console, truncate.Budget(True, True, 2000))
    assert rest is None and phases[:2] == ["remove-low-value-sections", "trim-failures"] and len(phases) > 3
    assert out.count() <= 5 and truncate._tokens(out, logs) <= 2000


def test_sources(spark, tmp_path):
    (tmp_path / "e.json").write_text('{"id": 1}\nnot json\n')
    got = S.read_events(spark, str(tmp_path / "e.json"), "id int").collect()
    assert sorted((r["id"], r["_corrupt_record"]) for r in got if r["id"]) == [(1, None)] and len(got) == 2
    logs = spark.createDataFrame([("t", "stderr", "x", 1), (None, "stdout", "y", 2)], "task_id string, type string, content string, time long")
    assert [(r["level"], r["origin"]) for r in S.runner_logs(logs).collect()] == [("error", "task")]
    tasks = spark.createDataFrame([("t", [("debug", "d", 1), ("warning", "w", 2), (None, "n", 3), ("weird", "z", 4)])], "entity string, logs array<struct<type:string,content:string,time:long>>")
    assert [(r["level"], r["message"]) for r in S.task_logs(tasks).collect()] == [("warn", "w"), ("log", "z")]
    (tmp_path / "package.json").write_text('{"dependencies": {"vite": "1"}, "devDependencies": {"next": "2"}}')
    assert {r["name"] for r in S.package_dependencies(spark, str(tmp_path / "package.json")).collect()} == {"vite", "next"}
    (tmp_path / "src.ts").write_text("a\nb\nc")
    assert S.source_lines(spark, str(tmp_path / "src.ts")).count() == 3
    assert S.environment(spark).first()["runtime"]["spark"] == spark.version


def test_report_and_sinks(spark, tmp_path, capsys):
    rows = attempts_table(spark, t1="F", t2="P").withColumns({"name": F.concat(F.lit("n"), F.col("entity")), "file": F.lit("a.ts")})
    doc = report.document(rows, report.summary(rows), report.View(verbose=True))
    body = json.loads(doc.first()["document"])
    assert body["summary"]["total"] == 2 and [f["test"] for f in body["failures"]] == ["nt1"] and "skipped" not in body
    assert sinks.print_document(doc, frame=True) and "=" * 80 in capsys.readouterr().out
    path = sinks.write_json(doc, str(tmp_path / "out"))
    assert json.loads(spark.read.text(path).first()[0]) == body
    nodes = spark.createDataFrame([(1, None, "root"), (2, 1, "mid"), (3, 2, "leaf")], "id long, parent long, name string")
    assert {r["id"]: r["path"] for r in report.suite_paths(nodes).collect()}[3] == ["root", "mid", "leaf"]
    errors = spark.createDataFrame([("m.ts", None, None, "i", [("boom", None)])], "filepath string, module_id string, relative_id string, id string, errors array<struct<message:string,stack:string>>")
    assert report.module_errors(errors).first()["stack"] == "boom\n    at m.ts:1:1"
    assert report.unhandled_rows(spark.createDataFrame([("",)], "message string")).first()["message"] == "Unhandled Error"


def test_report_numbers(spark):
    cases = {
        12345678.9: "12345678.9", 1e7: "10000000.0", -1.79126566812e10: "-17912656681.2", 1e16: "10000000000000000.0", 1.5e20: "150000000000000000000.0", 1e21: "1e21", 1e23: "1e23", 4.9e-324: "5e-324",
        9.99e-4: "0.000999", 1e-6: "0.000001", -9.9e-7: "-9.9e-7", 0.0: "0.0", 0.25: "0.25", 9999999.5: "9999999.5", float("inf"): '"Infinity"', float("nan"): '"NaN"', None: None,
    }
    rows = spark.createDataFrame([(v,) for v in cases], "x double").select(V.json_number(F.col("x"))).collect()
    assert [r[0] for r in rows] == list(cases.values())
    rows = attempts_table(spark, t1="FP", t2="F").withColumns({"name": F.when(F.col("seq") < 3, 'say ",\n"'), "file": F.lit("é.ts"), "duration": F.col("duration") * 6e6})
    totals = report.summary(rows).select("total", F.lit(None).cast("string").alias("none"), F.col("duration").alias('all "ms"'))
    first = '{"test":"say \\",\\n\\"","fileRelative":"é.ts","status":"%s","duration":6000000.0}'
    third = '{"fileRelative":"é.ts","status":"failed","duration":6000000.0}'
    text = '{"summary":{"total":3,"all \\"ms\\"":18000000.0},"failures":[' + first % "failed" + "," + third + "]%s}"
    assert report.document(rows, totals).first()["document"] == text % ""
    assert report.document(rows, totals, report.View(verbose=True)).first()["document"] == text % (',"passed":[' + first % "passed" + "]")
    assert report.document(rows.filter("false"), totals).first()["document"] == '{"summary":{"total":3,"all \\"ms\\"":18000000.0}}'


def test_report_in_ranges(spark):
    """Entries of many ranges stand in their order, whichever range lacks a section."""
    rows = attempts_table(spark, **{f"t{i}": "F" if i < 40 else "PSF"[i % 3] for i in range(90)}).withColumns({"name": F.col("entity"), "file": F.lit("a.ts")})
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        body = json.loads(report.document(rows.orderBy("entity"), report.summary(rows), report.View(verbose=True)).first()["document"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {n: [f"t{i}" for i in range(90) if ("F" if i < 40 else "PSF"[i % 3]) == c] for c, n in (("F", "failures"), ("P", "passed"), ("S", "skipped"))}
    assert list(body) == ["summary", *want] and {n: [e["test"] for e in body[n]] for n in want} == want


def test_smaller_parts(spark, tmp_path):
    assert value(spark, T.truncated_logs(F.col("x"), 100), x=["a"] * 3) == ["a"] * 3
    assert value(spark, T.truncated_logs(F.col("x"), 100), x=["word"] * 90)[0].endswith("\n...[truncated]")
    rows = spark.createDataFrame([("1", '{"os": {"platform": "x"}, "ci": true}', "1", "nope"), ("2", '{"os": {"platform": 5}}', None, "{}"), ("3", None, "[1]", None)], "k string, environment string, expected string, actual string")
    assert {(r["row"], r["path"]) for r in validate.environment_violations(rows, "k").collect()} == {("2", "environment.os.platform")}
    assert {(r["row"], r["path"]) for r in validate.assertion_violations(rows, "k").collect()} == {("1", "assertion.actual")}
    assert validate.messages(validate.assertion_violations(rows, "k")).first()["message"].startswith("1: assertion.actual")
    a, b = messages(spark, ("e", 1, "log", "x")), messages(spark, ("e", 2, "log", "X"), ("e", 3, "log", "y"))
    assert sorted((r["seq"], r["origin"]) for r in dedup.captured(a, b).collect()) == [(1, "intercepted"), (3, "task")]
    table = attempts_table(spark, t1="FP", t2="P")
    got = {r["entity"]: r["retry_info"] for r in report.with_retry_info(table.filter("status = 'passed'"), attempts.retry_info(table)).collect()}
    assert got["t2"] is None and got["t1"]["is_flaky"]
    totals = spark.createDataFrame([("t1", 3, 1)], "entity string, total_lines int, suppressed_lines int")
    logs = report.success_logs(table, messages(spark, ("t1", 1, "log", "hello")), totals).collect()
    assert [(r["entity"], r["suppressed"]["total_lines"]) for r in logs] == [("t1", 3)]
    assert set(sanitize.environment(S.environment(spark)).columns) == {"os", "runtime", "ci"}
    assert sinks.write_json_later(spark.createDataFrame([("{}",)], "document string"), str(tmp_path / "later")).result(60)


def test_console_values(spark):
    shown = {
        '"it"': "it", "5": "5", "true": "true", "null": "null", "nope": "[Failed to serialize]", "{}": "{}", "[]": "[]", '{"b": "it\'s", "a-b": [1]}': "{ 'a-b': [ 1 ], b: \"it's\" }",
        json.dumps(list(range(12))): "[ 0, 1, 2, 3, 4, 5, 6, 7, 8, 9, ... 2 more items ]", '{"a": {"b": {"c": {"d": {}, "e": [1]}}}}': "{ a: { b: { c: { d: {}, e: [Array] } } } }",
        json.dumps(["x" * 201]): "[ '" + "x" * 200 + "'... 1 more character ]",
    }
    rows = spark.createDataFrame([(k,) for k in shown] + [(None,)], "j string").select("j", V.console_value(F.col("j")).alias("v")).collect()
    assert {r["j"]: r["v"] for r in rows} == shown | {None: "undefined"}
    calls = spark.createDataFrame([(1, ["1", '"a"']), (2, ['{"k":1}']), (3, ['"a"']), (4, []), (5, None)], "id int, arguments array<string>")
    got = {r["id"]: (r["message"], r["args"]) for r in V.console_calls(calls, "id").collect()}
    assert got == {1: ("1 a", ["1", "a"]), 2: ("{ k: 1 }", ["{ k: 1 }"]), 3: ("a", None), 4: ("", None), 5: ("", None)}


def test_value_guards(spark):
    cases = ['{"id": "x", "expected": null}', '{"id": 1}', '["a", "b"]', '["a", 1]', "[]", '"id"', "nope", None]
    rows = spark.createDataFrame([(c,) for c in cases], "j string")
    j = F.col("j")
    got = [tuple(r) for r in rows.select(V.has_id(j), V.has_property(j, "id"), V.is_string_array(j), V.is_assertion(j)).collect()]
    no = (False, False, False, False)
    assert got == [(True, True, False, True), (False, True, False, False), (False, False, True, False), no, (False, False, True, False), no, no, no]


def test_errors_with_code(spark):
    error = '{"message": "m", "stack": "Error: m\\n    at f (/srv/app/a.ts:2:3)"}'
    rows = spark.createDataFrame([(1, error), (2, '{"context": {"code": "own()", "line": 3}}'), (3, None)], "id int, error string")
    lines = spark.createDataFrame([("/srv/app/a.ts", i, f"l{i}") for i in (1, 2, 3)], "file string, line int, text string")
    got = {r["id"]: r for r in extract.with_code(extract.extracted_errors(rows, "/srv/app"), lines, "id", around=1).collect()}
    assert got[1]["code"] == ["  1: l1", "  2: l2 // <- failure", "  3: l3"] and got[1]["extracted"]["line"] == 2
    assert got[2]["code"] == ["own()"] and got[2]["extracted"]["line"] == 3 and got[3]["code"] is None and got[3]["assertion"] is None


def test_teardown_without_a_report(spark):
    none = spark.createDataFrame([], "name string, file string, start_line int, end_line int, suite array<string>, message string, type string")
    summary = spark.createDataFrame([], "total long, passed long, failed long")
    late = extract.stray_errors(spark.createDataFrame([('"gone"',), ('{"message": "x", "name": "E"}',)], "error string"))
    failures, totals = extract.with_teardown(none, summary, late)
    assert {(r["name"], r["message"], r["type"]) for r in failures.collect()} == {("Teardown Error", "gone", "Error"), ("Teardown Error", "x", "E")}
    assert totals.first().asDict() == {"total": 2, "failed": 2, "passed": 0}


def test_success_entries(spark):
    table = attempts_table(spark, t1="P").select("*", F.lit("n").alias("name"), F.lit("a.ts").alias("file"), F.lit(1).alias("start_line"), F.lit(2).alias("end_line"), F.array(F.lit("s")).alias("suite"))
    totals = spark.createDataFrame([("t1", 0, 0)], "entity string, total_lines int, suppressed_lines int")
    logs = report.success_logs(table, messages(spark, ("t1", 1, "log", "hello")), totals)
    entry = json.loads(extract.success_entries(logs).select(F.to_json("entry").alias("e")).first()["e"])
    assert entry["status"] == "passed" and entry["consoleEvents"] == [{"level": "log", "message": "hello"}] and "suppressed" not in entry and "error" not in entry


def test_suite_paths_of_any_depth(spark):
    chain = spark.createDataFrame([(i, i - 1 if i else None, str(i)) for i in range(40)] + [(99, 77, "stray")], "id int, parent int, name string")
    got = {r["id"]: r["path"] for r in report.suite_paths(chain).collect()}
    assert got[39] == [str(i) for i in range(40)] and got[0] == ["0"] and got[99] == ["stray"]
    with pytest.raises(ValueError):
        report.suite_paths(spark.createDataFrame([(1, 2, "a"), (2, 1, "b")], "id int, parent int, name string"))


def test_pretty_length(spark):
    rows = spark.createDataFrame([("m", ["a", "b"], None, 3), ("n", [], "x", 4)], "message string, code array<string>, gone string, line int")
    texts = [json.dumps({"failures": [{k: v for k, v in r.asDict().items() if v is not None}]}, indent=2) for r in rows.collect()]
    frame = len(json.dumps({"failures": [1]}, indent=2)) - len("\n    1")
    # Spark writes a row's own line; an empty array stays on its line
    assert [r[0] for r in rows.select(truncate.pretty_length(rows)).collect()] == [len(t) - frame + 1 for t in texts]


def test_one_file_and_layout(spark, tmp_path, capsys):
    doc = spark.createDataFrame([('{"summary":{"total":0},"failures":[{"test":"é"}]}',)], "document string")
    path = sinks.write_file(doc, str(tmp_path / "deep" / "report.json"), spacing=2)
    assert open(path, encoding="utf-8").read().startswith('{\n  "summary": {') and json.load(open(path, encoding="utf-8"))["failures"][0]["test"] == "é"
    assert sinks.print_document(doc) and '\n  "failures"' in capsys.readouterr().out
    with pytest.raises(sinks.OutputError):
        sinks.write_file(doc, "/proc/none/report.json")
