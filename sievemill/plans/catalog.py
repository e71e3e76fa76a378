"""Every registered query of the engine's own operators, with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemill.functions import errors as E
from sievemill.functions import paths as P
from sievemill.functions import text as T
from sievemill.functions import values as V
from sievemill.operators import attempts, buffers, dedup, extract, filters, report, sanitize, truncate, validate
from sievemill.sources import events as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function as a query under its name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.attempts_of_events(S.table(spark, sf_dir, "events"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "documents").select(F.col("source").alias("entity"), F.col("doc_id").alias("seq"), F.col("lang").alias("level"), F.col("text").alias("message"))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.when(F.col("role") == "system", "info").when(F.col("role") == "user", "warn").otherwise("log")
    return S.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("entity"), F.col("turn").alias("seq"), level.alias("level"), F.col("text").alias("message"))


_STATUS = "CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'passed' WHEN 'signup' THEN 'skipped' END"
_ATTEMPTS = f"WITH a AS (SELECT user_id entity, event_id seq, {_STATUS} status, coalesce(value, 0) duration, ts AS at FROM events WHERE event_type IN ('error','purchase','signup')), f AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY seq) attempt FROM a WHERE status <> 'skipped'), k AS (SELECT entity, count(*) total_attempts, count(*) FILTER (status = 'failed') failed_attempts, count(*) FILTER (status = 'failed') > 0 AND max_by(status, seq) = 'passed' is_flaky, min(attempt) FILTER (status = 'passed') success_attempt FROM f GROUP BY entity) "


# -- attempts and summaries --------------------------------------------------------------------------------------------


@query(_ATTEMPTS + "SELECT (SELECT count(*) FROM a) total, (SELECT count(*) FROM a WHERE status='passed') passed, (SELECT count(*) FROM a WHERE status='failed') failed, (SELECT count(*) FROM a WHERE status='skipped') skipped, (SELECT round(sum(duration), 3) FROM a) duration, (SELECT count(*) FROM k WHERE is_flaky) flaky, (SELECT count(*) FROM k WHERE total_attempts > 1) retried")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.summary(_attempts(spark, sf_dir)).withColumn("duration", F.round("duration", 3))


@query(_ATTEMPTS + "SELECT status, count(*) n, round(sum(duration), 3) duration FROM a GROUP BY status")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _attempts(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"), F.round(F.sum("duration"), 3).alias("duration"))


@query(_ATTEMPTS + "SELECT entity, seq, status, attempt, min(seq) OVER (PARTITION BY entity) first_seq FROM f")
def attempt_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attempts.numbered(_attempts(spark, sf_dir)).select("entity", "seq", "status", F.col("attempt").cast("long"), "first_seq")


@query(_ATTEMPTS + "SELECT entity, count(*) attempts, string_agg(status, ',' ORDER BY seq) statuses FROM f GROUP BY entity")
def attempt_history_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attempts.histories(_attempts(spark, sf_dir)).select("entity", F.size("attempts").cast("long").alias("attempts"), F.array_join(F.col("attempts.status"), ",").alias("statuses"))


@query(_ATTEMPTS + "SELECT * FROM k WHERE total_attempts > 1")
def flaky_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attempts.retry_info(_attempts(spark, sf_dir)).withColumn("success_attempt", F.col("success_attempt").cast("long"))


@query(_ATTEMPTS + "SELECT entity, seq, status FROM (SELECT *, lead(status) OVER (PARTITION BY entity ORDER BY seq) nxt FROM f) WHERE NOT (status = 'failed' AND coalesce(nxt, '') = 'passed')")
def supersede_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attempts.superseded(_attempts(spark, sf_dir)).select("entity", "seq", "status")


@query(_ATTEMPTS + "SELECT entity, seq, status FROM f WHERE status = 'passed' OR NOT EXISTS (SELECT 1 FROM f g WHERE g.entity = f.entity AND g.status = 'passed' AND g.seq > f.seq)")
def supersede_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attempts.superseded(_attempts(spark, sf_dir), clean=True).select("entity", "seq", "status")


@query("SELECT user_id, min(ts) start_time, max(ts) end_time, epoch_us(max(ts)) // 1000 - epoch_us(min(ts)) // 1000 duration_ms FROM events GROUP BY user_id")
def module_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attempts.spans(S.table(spark, sf_dir, "events"), "user_id", "ts")


@query("SELECT state, count(*) n FROM (SELECT user_id, max_by(event_type, event_id) state FROM events GROUP BY user_id) GROUP BY state")
def module_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attempts.snapshot(S.table(spark, sf_dir, "events").withColumnRenamed("event_type", "state"), "user_id", "state", "event_id")


@query(_ATTEMPTS + "SELECT 'attempt' AS section, entity, seq FROM a WHERE status = 'failed' UNION ALL SELECT 'unhandled', user_id, event_id FROM events WHERE event_type = 'view' AND value > 400 UNION ALL SELECT 'module', NULL, o_orderkey FROM orders WHERE o_totalprice > 400000")
def union_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = _attempts(spark, sf_dir).filter("status = 'failed'").select(F.lit("attempt").alias("section"), "entity", "seq")
    unhandled = S.table(spark, sf_dir, "events").filter("event_type = 'view' AND value > 400").select(F.lit("unhandled").alias("section"), F.col("user_id").alias("entity"), F.col("event_id").alias("seq"))
    module = S.table(spark, sf_dir, "orders").filter("o_totalprice > 400000").select(F.lit("module").alias("section"), F.lit(None).cast("long").alias("entity"), F.col("o_orderkey").alias("seq"))
    return failed.unionByName(unhandled).unionByName(module)


@query(_ATTEMPTS + "SELECT entity, seq, duration FROM a WHERE status = 'failed' ORDER BY seq LIMIT 5")
def first_n_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return buffers.first_n(_attempts(spark, sf_dir).filter("status = 'failed'").select("entity", "seq", "duration"), 5, "seq")


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 100")
def recent_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return buffers.recent_n(S.table(spark, sf_dir, "events").select("event_id", "ts"), 100, "ts", "event_id")


@query("SELECT event_type, count(*) n, round(avg(value), 6) average, round(count(*) FILTER (value > 50) * 1.0 / count(*), 6) hit_rate FROM events GROUP BY event_type")
def monitoring_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = S.table(spark, sf_dir, "events").groupBy("event_type")
    return e.agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("average"), F.round(F.try_divide(F.count_if(F.col("value") > 50), F.count("*")), 6).alias("hit_rate"))


@query("SELECT n_nationkey, r_name || ' > ' || n_name AS path FROM nation JOIN region ON n_regionkey = r_regionkey")
def suite_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = S.table(spark, sf_dir, "region").select((F.col("r_regionkey") + 1000).cast("long").alias("id"), F.lit(None).cast("long").alias("parent"), F.col("r_name").alias("name"))
    nation = S.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), (F.col("n_regionkey") + 1000).cast("long").alias("parent"), F.col("n_name").alias("name"))
    paths = report.suite_paths(region.unionByName(nation)).filter("id < 1000")
    return paths.select(F.col("id").cast("int").alias("n_nationkey"), F.array_join("path", " > ").alias("path"))


@query(_ATTEMPTS + """, e AS (SELECT status, list(struct_pack(test := 'test ' || CAST(entity AS VARCHAR), fileRelative := 'src/app.test.ts', status := status, duration := duration) ORDER BY seq) rows FROM a WHERE status <> 'skipped' GROUP BY status)
SELECT to_json(struct_pack(summary := struct_pack(total := (SELECT count(*) FROM a), passed := (SELECT count(*) FROM a WHERE status = 'passed'), failed := (SELECT count(*) FROM a WHERE status = 'failed'), skipped := (SELECT count(*) FROM a WHERE status = 'skipped'),
 duration := (SELECT round(sum(duration), 3) FROM a), flaky := (SELECT count(*) FROM k WHERE is_flaky), retried := (SELECT count(*) FROM k WHERE total_attempts > 1)),
 failures := (SELECT rows FROM e WHERE status = 'failed'), passed := (SELECT rows FROM e WHERE status = 'passed')))::VARCHAR AS document""")
def report_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _attempts(spark, sf_dir)
    named = rows.select("entity", "seq", "status", "duration", F.concat(F.lit("test "), F.col("entity").cast("string")).alias("name"), F.lit("src/app.test.ts").alias("file"))
    totals = report.summary(rows).withColumn("duration", F.round("duration", 3))
    return report.document(named, totals, report.View(passed=True))


# -- text --------------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) tokens FROM documents")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "documents").select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


@query("SELECT source, CAST(sum(ceil(length(text) / 4.0)) AS BIGINT) tokens, count(*) texts FROM documents GROUP BY source")
def token_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "documents").groupBy("source").agg(F.sum(T.estimate_tokens(F.col("text"))).alias("tokens"), F.count("*").alias("texts"))


@query("SELECT doc_id FROM documents WHERE ceil(length(text) / 4.0) > 1000")
def over_token_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "documents").filter(T.exceeds_tokens(F.col("text"), 1000)).select("doc_id")


_SQL_NORM = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '\x1B\[[0-9;]*m', '', 'g'), '\d{{4}}-\d{{2}}-\d{{2}}T\d{{2}}:\d{{2}}:\d{{2}}(\.\d{{3}})?Z?', '', 'g'), '\d{{4}}-\d{{2}}-\d{{2}}\s+\d{{2}}:\d{{2}}:\d{{2}}', '', 'g'), '(\b(?:timestamp|time(?:stamp)?|epoch|unix(?:_timestamp)?)[:=]?\s*)\d{{10}}(?:\d{{3}})?\b', '\1', 'gi'), '\[\s*\d{{10}}(?:\d{{3}})?\s*\]', '[]', 'g'), '\(\s*\d{{10}}(?:\d{{3}})?\s*\)', '()', 'g')"""


#: White space as the engine sees it, in DuckDB's expressions.
_SQL_BLANK = r"[\t-\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def _sql_normal(column: str) -> str:
    inner = _SQL_NORM.format(column)
    whole = rf"lower(CASE WHEN regexp_matches({inner}, '\s{{2}}') THEN trim(regexp_replace({inner}, '\s+', ' ', 'g')) ELSE {inner} END)"
    return whole.replace(r"\s", _SQL_BLANK)


@query(f"SELECT doc_id, md5({_sql_normal('text')}) norm FROM documents")
def normalize_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "documents").select("doc_id", F.md5(T.normalize_message(F.col("text"))).alias("norm"))


@query("SELECT conv_id, turn, lower(to_base(list_reduce(list_prepend(CAST(5381 AS BIGINT), list_transform(string_split(text, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda h, c: (h * 33 + c) & 4294967295), 36)) AS hash FROM conversations WHERE text <> '' UNION ALL SELECT conv_id, turn, '45h' FROM conversations WHERE text = ''")
def djb2_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "conversations").filter("text IS NOT NULL").select("conv_id", "turn", T.djb2(F.col("text")).alias("hash"))


_SQL_CUT = "substr(text, 1, 270)"
_SQL_EDGE = f"greatest(CASE WHEN instr(reverse({_SQL_CUT}), ' ') = 0 THEN -1 ELSE 270 - instr(reverse({_SQL_CUT}), ' ') END, CASE WHEN instr(reverse({_SQL_CUT}), chr(10)) = 0 THEN -1 ELSE 270 - instr(reverse({_SQL_CUT}), chr(10)) END, CASE WHEN instr(reverse({_SQL_CUT}), '.') = 0 THEN -1 ELSE 270 - instr(reverse({_SQL_CUT}), '.') END, CASE WHEN instr(reverse({_SQL_CUT}), ',') = 0 THEN -1 ELSE 270 - instr(reverse({_SQL_CUT}), ',') END)"


@query(f"SELECT doc_id, CASE WHEN length(text) <= 300 THEN text WHEN {_SQL_EDGE} > 216 THEN substr(text, 1, {_SQL_EDGE} + 1) ELSE {_SQL_CUT} END trimmed FROM documents")
def safe_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "documents").select("doc_id", T.safe_trim(F.col("text"), 300).alias("trimmed"))


@query(r"""SELECT page_id, replace(replace(replace(replace(replace(replace(replace(html, '\', '\\'), '"', '\"'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t'), chr(12), '\f'), chr(8), '\b') AS escaped FROM pages""")
def json_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "pages").select("page_id", T.json_escape(F.col("html")).alias("escaped"))


@query("SELECT conv_id, turn, CASE WHEN length(text) > 1000 THEN substr(text, 1, 1000) || '... [truncated]' ELSE text END AS shown FROM conversations")
def console_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "conversations").select("conv_id", "turn", T.console_argument(F.col("text")).alias("shown"))


@query(r"SELECT doc_id, count(*) FILTER (regexp_matches(line, '^(FAIL|FAILED|✖|✗|×)|^\s*(Expected|Received|Actual|Assert)|^[A-Z]\w*Error:|^(Error|TypeError|ReferenceError|SyntaxError|RangeError|AssertionError):')) error_lines, count(*) FILTER (contains(lower(line), 'error') OR contains(lower(line), 'test') OR contains(lower(line), 'it(') OR contains(lower(line), 'must') OR contains(lower(line), 'bug') OR contains(lower(line), 'fail') OR contains(lower(line), 'failure') OR contains(lower(line), 'exception') OR contains(lower(line), 'throw') OR contains(lower(line), 'crash') OR contains(lower(line), 'fatal') OR contains(lower(line), 'assert') OR contains(lower(line), 'expect') OR contains(lower(line), 'should') OR contains(lower(line), 'require') OR contains(lower(line), 'describe') OR contains(lower(line), 'spec') OR contains(lower(line), 'scenario') OR contains(lower(line), 'warning') OR contains(lower(line), 'critical') OR contains(lower(line), 'important') OR contains(lower(line), 'issue') OR contains(lower(line), 'problem')) key_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) line FROM documents) GROUP BY doc_id")
def line_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = S.table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count_if(T.is_error_line(F.col("line"))).alias("error_lines"), F.count_if(T.has_keyword(F.col("line"))).alias("key_lines"))


#: An item cut to a share less ten characters, at a boundary in its last fifth.
_SQL_SHARE = r"""WITH RECURSIVE c AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) n, text, greatest(100, 600 // count(*) OVER (PARTITION BY conv_id)) share FROM conversations WHERE text IS NOT NULL),
w AS (SELECT conv_id, 0::BIGINT n, 600::BIGINT room, '' AS capped FROM c GROUP BY conv_id
 UNION ALL SELECT w.conv_id, c.n, room - length(item), CASE WHEN c.n = 1 THEN item ELSE capped || '|' || item END
 FROM w JOIN c ON c.conv_id = w.conv_id AND c.n = w.n + 1 AND room > 0,
 LATERAL (SELECT CAST(least(share, room) AS BIGINT) r) a, LATERAL (SELECT CAST(floor((r - 10) * 0.9::DOUBLE) AS BIGINT) keep) b, LATERAL (SELECT substr(text, 1, greatest(keep, 0)) cut, reverse(cut) back) d,
 LATERAL (SELECT list_max(list_transform([' ', chr(10), '.', ','], lambda m: CASE WHEN instr(back, m) = 0 THEN -1 ELSE length(cut) - instr(back, m) END)) edge) e,
 LATERAL (SELECT CASE WHEN length(text) <= r THEN text ELSE CASE WHEN keep > 100 AND edge > keep * 0.8 THEN substr(text, 1, edge + 1) ELSE cut END || chr(10) || '...[cut]' END item) f)
SELECT conv_id, max_by(capped, n) capped FROM w GROUP BY conv_id"""


@query(_SQL_SHARE)
def fair_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = S.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return turns.select("conv_id", F.array_join(T.fair_caps(F.col("t.text"), 600), "|").alias("capped"))


# -- deduplication -----------------------------------------------------------------------------------------------------

_KEYED = f"WITH m AS (SELECT source entity, doc_id seq, lang AS level, text AS message, {_sql_normal('text')} norm FROM documents) "


@query(_KEYED + "SELECT min(seq) seq, count(*) copies, max(seq) last_seq, count(*) > 1 deduplicated FROM m GROUP BY level, norm")
def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.first_of_each(_documents(spark, sf_dir)).select("seq", "copies", "last_seq", "deduplicated")


@query(_KEYED + "SELECT level, md5(norm) norm, min(seq) first_seq, max(seq) last_seq, count(*) copies, count(DISTINCT entity) n_sources FROM m GROUP BY level, norm")
def dedup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.groups(_documents(spark, sf_dir)).select("level", "norm", "first_seq", "last_seq", "copies", F.size("sources").cast("long").alias("n_sources"))


@query(_KEYED + "SELECT CAST(sum(c) AS BIGINT) total_logs, count(*) unique_logs, CAST(sum(c) AS BIGINT) - count(*) duplicates_removed FROM (SELECT count(*) c FROM m GROUP BY level, norm)")
def dedup_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.statistics(_documents(spark, sf_dir))


@query(_KEYED + "SELECT entity, level, md5(norm) norm, min(seq) first_seq, count(*) copies FROM m GROUP BY entity, level, norm")
def dedup_per_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup.groups(_documents(spark, sf_dir), dedup.Dedup(scope="per-test"))
    return found.select(F.col("scope_key").alias("entity"), "level", "norm", "first_seq", "copies")


@query(_KEYED + "SELECT seq, count(*) OVER (PARTITION BY level, norm) copies, min(seq) OVER (PARTITION BY level, norm) first_seq, seq = min(seq) OVER (PARTITION BY level, norm) is_first FROM m")
def dedup_annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.annotated(_documents(spark, sf_dir)).select("seq", "copies", "first_seq", "is_first")


@query("SELECT count(*) logs, count(DISTINCT l_returnflag || '/' || CAST(l_partkey AS VARCHAR)) unique_logs, count(*) - count(DISTINCT l_returnflag || '/' || CAST(l_partkey AS VARCHAR)) duplicates_removed FROM lineitem")
def dedup_many_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Throughput: one log line for each line item, as many distinct ones as parts and flags."""
    line = F.concat(F.lit("[INFO] 2024-01-02 03:04:05 shipped part  "), F.col("l_partkey").cast("string"))
    logs = S.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("entity"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"), F.col("l_returnflag").alias("level"), line.alias("message")
    )
    return dedup.statistics(logs, dedup.Dedup(sources=False)).withColumnRenamed("total_logs", "logs")


@query(_KEYED + """, n AS (SELECT level, norm, seq, row_number() OVER (ORDER BY seq) i FROM m), p AS (SELECT *, lag(i) OVER (PARTITION BY level, norm ORDER BY i) prev FROM n),
d AS (SELECT x.i, count(y.i) others FROM p x LEFT JOIN p y ON y.i > x.prev AND y.i < x.i AND coalesce(y.prev, 0) <= x.prev WHERE x.prev IS NOT NULL GROUP BY x.i),
g AS (SELECT p.*, sum(CASE WHEN prev IS NULL OR others >= 100 THEN 1 ELSE 0 END) OVER (PARTITION BY level, norm ORDER BY p.i) run FROM p LEFT JOIN d ON d.i = p.i)
SELECT min(seq) seq, count(*) copies, max(seq) last_seq FROM g GROUP BY level, norm, run""")
def lru_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.first_of_each(_documents(spark, sf_dir), dedup.Dedup(max_entries=100)).select("seq", "copies", "last_seq")


_ADJACENT_SQL = r"""WITH RECURSIVE m AS (
 SELECT o_custkey AS entity, o_orderkey AS seq, o_orderstatus AS level, o_orderkey % 3 = 0 AS second, CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE (o_orderkey * 7) % 40 END AS ts,
  CASE o_orderkey % 4 WHEN 0 THEN '[12ms] part ' WHEN 1 THEN 'part  ' WHEN 2 THEN '2024-01-02T03:04:05.678Z part ' ELSE ' 1700000000000 part ' END || left(o_orderpriority, 1) AS message FROM orders),
k AS (SELECT entity, seq, level, ts, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(message, '^\[\d+(?:ms)?\]\s*', ''), '\b\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z\b', '', 'g'), '\b\d{13}\b', '', 'g'), '\s+', ' ', 'g')) AS txt,
  count(DISTINCT second) OVER (PARTITION BY entity) AS sides,
  row_number() OVER (PARTITION BY entity ORDER BY ts NULLS LAST, second, seq) AS n FROM m),
walk AS (SELECT entity, n, level, ts, txt, 1 AS kept FROM k WHERE n = 1
 UNION ALL SELECT k.entity, k.n, CASE WHEN same THEN w.level ELSE k.level END, CASE WHEN same THEN w.ts ELSE k.ts END, CASE WHEN same THEN w.txt ELSE k.txt END, w.kept + CASE WHEN same THEN 0 ELSE 1 END
 FROM walk w JOIN k ON k.entity = w.entity AND k.n = w.n + 1, LATERAL (SELECT k.sides = 2 AND w.level = k.level AND w.txt = k.txt AND coalesce(abs(w.ts - k.ts) <= 5, true) AS same) j)
SELECT entity, max(kept)::BIGINT AS n_events FROM walk GROUP BY entity"""


@query(_ADJACENT_SQL)
def merge_adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources of a customer's orders as events, some without times, with prefixes that comparing leaves out."""
    kind, key = F.col("o_orderkey") % 4, F.left("o_orderpriority", F.lit(1))
    prefix = F.when(kind == 0, "[12ms] part ").when(kind == 1, "part  ").when(kind == 2, "2024-01-02T03:04:05.678Z part ").otherwise(" 1700000000000 part ")
    ts = F.when(F.col("o_custkey") % 4 != 0, (F.col("o_orderkey") * 7) % 40)
    events = S.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("entity"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("level"), F.concat(prefix, key).alias("message"), ts.cast("long").alias("ts")
    )
    merged = dedup.merged_sources(events.filter("seq % 3 <> 0"), events.filter("seq % 3 = 0"), "entity")
    return merged.select("entity", F.size("events").cast("long").alias("n_events"))


# -- buffers and filters -----------------------------------------------------------------------------------------------


@query("SELECT entity, seq FROM (SELECT conv_id entity, turn seq, sum(octet_length(encode(text))) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) used, row_number() OVER (PARTITION BY conv_id ORDER BY turn) n FROM conversations) WHERE used <= 800 AND n <= 4")
def buffer_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return buffers.bounded(_turns(spark, sf_dir), max_bytes=800, max_lines=4).select("entity", "seq")


_LEVELED = "WITH m AS (SELECT conv_id entity, turn seq, CASE role WHEN 'system' THEN 'info' WHEN 'user' THEN 'warn' ELSE 'log' END AS level FROM conversations) "


@query(_LEVELED + "SELECT entity, seq, level FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY seq) k FROM (SELECT *, row_number() OVER (PARTITION BY entity, level ORDER BY seq) n FROM m) WHERE n <= CASE level WHEN 'info' THEN 1 WHEN 'warn' THEN 1 ELSE 3 END) WHERE k <= 15")
def level_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return buffers.level_capped(_turns(spark, sf_dir), buffers.pass_caps(3)).select("entity", "seq", "level")


@query("SELECT doc_id, count(*) n_lines, count(*) FILTER (regexp_matches(line, '(?i)^licensed under|all rights reserved')) n_suppressed FROM (SELECT doc_id, unnest(string_split(text, chr(10))) line FROM documents) GROUP BY doc_id")
def line_suppress(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = S.table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    hit = filters.suppressed(F.col("line"), [r"(?i)^licensed under", r"(?i)all rights reserved", "(broken"])
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(hit).alias("n_suppressed"))


@query(r"SELECT page_id, count(*) FILTER (NOT regexp_matches(line, '(?i)(?:Express|Server) listening (?:on|at)') AND NOT regexp_matches(line, '^Remix App Server|^💿')) AS kept FROM (SELECT page_id, unnest(string_split(html, chr(10))) line FROM pages) GROUP BY page_id")
def preset_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = S.table(spark, sf_dir, "pages").select("page_id", F.explode(F.split("html", "\n")).alias("line"))
    return lines.groupBy("page_id").agg(F.count_if(~filters.suppressed(F.col("line"), filters.preset_patterns(["express", "remix"]))).alias("kept"))


@query("SELECT source, count(*) total_lines, count(*) FILTER (contains(line, ' the ')) suppressed_lines FROM (SELECT source, unnest(string_split(text, chr(10))) line FROM documents) WHERE line <> '' AND line <> chr(13) GROUP BY source")
def suppression_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = S.table(spark, sf_dir, "documents").select("source", F.col("text").alias("message"))
    return filters.suppression_totals(docs, "source", [" the "])


# -- paths, validation, sanitising -------------------------------------------------------------------------------------


@query("SELECT page_id, CASE WHEN p = '/srv/app' THEN '.' WHEN starts_with(p, '/srv/app/') THEN regexp_replace(substr(p, 10), '/+$', '') ELSE p END AS relative FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '/srv/app/' ELSE '/srv/apple/' END || regexp_replace(regexp_replace(url, '^https?:', ''), '/+', '/', 'g') q, regexp_replace(q, '/+', '/', 'g') p FROM pages)")
def path_relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = F.regexp_replace(F.regexp_replace("url", "^https?:", ""), "/+", "/")
    path = F.concat(F.when(F.col("page_id") % 2 == 0, "/srv/app/").otherwise("/srv/apple/"), rest)
    return S.table(spark, sf_dir, "pages").select("page_id", P.process_path(path, "/srv/app")["file_relative"].alias("relative"))


_FILES = "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN '/srv/app/src/' WHEN 1 THEN '/srv/app/node_modules/x/' WHEN 2 THEN '/usr/lib/' ELSE '/srv/app/node_modules_not/' END || replace(p_brand, '#', '') || '.js' AS path FROM part"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_size") % 4
    root = F.when(k == 0, "/srv/app/src/").when(k == 1, "/srv/app/node_modules/x/").when(k == 2, "/usr/lib/").otherwise("/srv/app/node_modules_not/")
    return S.table(spark, sf_dir, "part").select("p_partkey", F.concat(root, F.replace("p_brand", F.lit("#"), F.lit("")), F.lit(".js")).alias("path"))


@query(f"SELECT p_partkey, starts_with(path, '/srv/app/') AND NOT contains(path, '/node_modules/') in_project, contains(path, '/node_modules/') in_node_modules FROM ({_FILES})")
def path_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).select("p_partkey", P.in_project(F.col("path"), "/srv/app").alias("in_project"), P.in_node_modules(F.col("path")).alias("in_node_modules"))


@query("SELECT page_id, NOT (contains(url, '..') OR contains(lower(url), 'javascript:') OR contains(lower(url), 'data:') OR contains(lower(url), 'file://') OR regexp_matches(url, '%([^0-9A-Fa-f]|.[^0-9A-Fa-f]|.?$)') OR length(url) > 4096 OR url = '' OR regexp_matches(lower(url), '%2e(%2e|\\.)|\\.%2e|%00')) AS valid FROM pages")
def path_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "pages").select("page_id", P.is_valid_path(F.col("url")).alias("valid"))


@query("SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS row, path FROM (SELECT *, unnest([CASE WHEN NOT l_linenumber > 1 THEN 'startLine' END, CASE WHEN NOT l_quantity >= l_linenumber * 8 THEN 'endLine' END]) path FROM lineitem) WHERE path IS NOT NULL")
def validation_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("key"), F.lit("t").alias("test"), F.lit("src/a.ts").alias("file"),
        F.when(F.col("l_linenumber") > 1, F.col("l_linenumber") * 8).otherwise(F.lit(0)).alias("start_line"),
        F.when(F.col("l_quantity") >= F.col("l_linenumber") * 8, F.lit(1_000)).otherwise(F.lit(-1)).alias("end_line"), F.lit(None).cast("array<string>").alias("suite"),
    )
    return validate.base_violations(rows, "key").select("row", "path")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS row, 'summary.total (sum)' AS path FROM orders WHERE o_orderkey % 7 = 3")
def summary_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = S.table(spark, sf_dir, "orders").select(
        k.alias("key"), (k % 5 + k % 3 + k % 2 + (k % 7 == 3).cast("int")).alias("total"), (k % 5).alias("passed"), (k % 3).alias("failed"), (k % 2).alias("skipped"),
        F.col("o_totalprice").alias("duration"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
    )
    return validate.summary_violations(rows, "key").select("row", "path")


@query("SELECT status AS row, 'section size' AS path FROM (SELECT CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'passed' ELSE 'skipped' END AS status, count(*) n FROM orders GROUP BY 1) WHERE n > CASE status WHEN 'failed' THEN 1000 ELSE 10000 END")
def section_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "passed").otherwise("skipped")
    return validate.size_violations(S.table(spark, sf_dir, "orders").select(status.alias("status"))).select("row", "path")


_HOMES = ("/home/u#/app/home/x", "home/u#/x", "/srv/my-home/u#/app", "/mnt/Users/u#", "/srv/app/u#", "/srv/home", "/Users/u#/a b/home/c", "myhome/u#/home/v/w", "/a//home//u#")
_HOMES_SQL = ", ".join(f"('{p}')" for p in _HOMES)


@query(f"""WITH p AS (SELECT page_id, replace(form, '#', CAST(page_id AS VARCHAR)) AS raw FROM pages, (VALUES {_HOMES_SQL}) forms(form)),
s AS (SELECT *, string_split(raw, '/') AS parts FROM p),
h AS (SELECT *, list_position(list_transform(list_zip(parts, list_slice(parts, 2, len(parts))), lambda z: z[1] IN ('Users', 'home') AND coalesce(z[2], '') <> ''), true) AS pos FROM s)
SELECT page_id, raw, CASE WHEN coalesce(pos, 0) = 0 THEN raw ELSE array_to_string(list_slice(parts, 1, pos - 1) || ['Users', '***'] || list_slice(parts, pos + 2, len(parts)), '/') END AS path FROM h""")
def mask_home(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = F.explode(F.array(*map(F.lit, _HOMES)))
    paths = S.table(spark, sf_dir, "pages").select("page_id", forms.alias("form")).select("page_id", F.replace("form", F.lit("#"), F.col("page_id").cast("string")).alias("raw"))
    return paths.select("page_id", "raw", T.mask_home(F.col("raw")).alias("path"))


@query(r"""SELECT event_id, event_type AS kind, replace(props, '"', '\"') AS props, '/Users/***/' || CAST(user_id AS VARCHAR) || '\t' || replace(props, '"', '\"') AS line FROM events""")
def sanitize_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("/home/me/"), F.col("user_id").cast("string"), F.lit("\t"), F.col("props"))
    events = S.table(spark, sf_dir, "events").select("event_id", F.struct("event_type", "props").alias("payload"), F.array("props").alias("lines"), line.alias("line"))
    return sanitize.sanitized(events, paths=("line",)).select("event_id", F.col("payload.event_type").alias("kind"), F.col("lines")[0].alias("props"), "line")


@query(r"""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE '{"kept": ' || props || ', "said": ["' || event_type || '\\\"", ' || CAST(user_id AS VARCHAR) || ']}' END AS props FROM events""")
def sanitize_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as objects with unsafe keys and quotes to escape; every fifth is no JSON."""
    said = F.concat(F.lit('{"__proto__": {"x": 1}, "kept": '), F.col("props"), F.lit(', "said": ["'), F.col("event_type"), F.lit('\\"", '), F.col("user_id").cast("string"), F.lit("]"))
    raw = F.concat(said, F.when(F.col("event_id") % 5 != 0, "}").otherwise(""))
    return S.table(spark, sf_dir, "events").select("event_id", sanitize.safe_json(raw).alias("props"))


# -- errors ------------------------------------------------------------------------------------------------------------


def _stacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.concat(F.lit("TypeError: part "), F.col("p_partkey").cast("string"))
    row = F.col("p_size").cast("string")
    lines = [
        F.concat(F.lit("    at run (/srv/app/src/a.ts:"), row, F.lit(":7)")), F.concat(F.lit("    at async step (file:///srv/app/node_modules/x/i.js:"), row, F.lit(":1)")),
        F.lit("    at node:internal/timers:5:9"), F.lit("    at /usr/lib/q.js:3:4"),
    ]
    return S.table(spark, sf_dir, "part").select("p_partkey", "p_size", F.concat_ws("\n", head, *lines).alias("stack"))


@query("SELECT p_partkey, 3::BIGINT n_frames, 'src/a.ts' AS file, p_size AS line, 'run' AS function, 1::BIGINT in_project, 1::BIGINT in_node_modules FROM part")
def stack_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _stacks(spark, sf_dir).select("p_partkey", E.stack_frames(F.col("stack"), "/srv/app").alias("f"))
    first = E.first_frame(F.col("f"))
    count = lambda name: F.size(F.filter("f", lambda x: x[name])).cast("long").alias(name)
    return rows.select("p_partkey", F.size("f").cast("long").alias("n_frames"), first["file_relative"].alias("file"), first["line"].alias("line"), first["function"].alias("function"), count("in_project"), count("in_node_modules"))


@query("SELECT p_partkey, 'TypeError: part ' || CAST(p_partkey AS VARCHAR) || chr(10) || '    at run (/srv/app/src/a.ts:' || CAST(p_size AS VARCHAR) || ':7)' || chr(10) || '    at /usr/lib/q.js:3:4' || chr(10) || '    ... 2 frames omitted' AS stack FROM part")
def truncated_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stacks(spark, sf_dir).select("p_partkey", E.truncated_stack(F.col("stack"), 2).alias("stack"))


@query("WITH l AS (SELECT doc_id, string_split(text, chr(10)) lines FROM documents) SELECT doc_id, CASE WHEN len(lines) >= 2 THEN array_to_string(list_transform(range(1, least(len(lines), 5) + 1), lambda i: lpad(CAST(i AS VARCHAR), 3, ' ') || ': ' || lines[i] || CASE WHEN i = 2 THEN ' // <- failure' ELSE '' END), chr(10)) END AS code FROM l")
def code_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "documents").select("doc_id", F.array_join(E.code_window(F.col("text"), F.lit(2)), "\n").alias("code"))


@query("WITH s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents) SELECT doc_id, string_agg(lpad(CAST(line AS VARCHAR), 3, ' ') || ': ' || text || CASE WHEN line = 2 THEN ' // <- failure' ELSE '' END, chr(10) ORDER BY line) AS code FROM s WHERE line BETWEEN 1 AND 4 GROUP BY doc_id")
def code_window_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = S.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), F.posexplode(F.split("text", "\n")).alias("n", "text"))
    frames = S.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("frame_id"), F.col("doc_id").alias("file"), F.lit(2).alias("line"))
    found = S.frame_context(frames, docs.select("file", (F.col("n") + 1).alias("line"), "text"), around=2)
    return found.select(F.col("frame_id").alias("doc_id"), F.array_join("code", "\n").alias("code"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN CAST(p_size AS VARCHAR) WHEN p_size % 3 = 1 THEN 'true' ELSE '\"' || p_type || '\"' END AS value, CASE p_size % 3 WHEN 0 THEN 'number' WHEN 1 THEN 'boolean' ELSE 'string' END AS kind FROM part")
def assertion_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("p_size") % 3 == 0, F.col("p_size").cast("string")).when(F.col("p_size") % 3 == 1, "true").otherwise(F.col("p_type"))
    v = E.assertion_value(raw)
    return S.table(spark, sf_dir, "part").select("p_partkey", v["value"].alias("value"), v["type"].alias("kind"))


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_name ELSE 'Unknown error' END AS message, CASE WHEN p_size % 2 = 0 THEN 'RangeError' ELSE 'Error' END AS kind, CAST(p_size AS BIGINT) AS line FROM part")
def normalized_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    null = F.lit(None).cast("string")
    e = E.normalized_error(
        F.when(F.col("p_size") % 3 == 0, F.col("p_name")).otherwise(F.lit("")), F.when(F.col("p_size") % 2 == 0, "RangeError"), null, F.lit("Object"),
        F.concat(F.lit("x.ts:"), F.col("p_size").cast("string"), F.lit(":1")), null, null,
    )
    return S.table(spark, sf_dir, "part").select("p_partkey", e["message"].alias("message"), e["type"].alias("kind"), e["line"].alias("line"))


_ERRORS_SQL = r"""WITH r AS (SELECT event_id, event_type, user_id, event_id % 6 AS k FROM events), e AS (SELECT *, CASE k WHEN 0 THEN NULL WHEN 1 THEN event_type WHEN 2 THEN 'Unknown error' ELSE event_type || ' failed' END AS message FROM r) """


def _raw_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as errors of six forms: no JSON, a text, numbers for texts, a stack, a matcher's result, a context."""
    k, kind, user = F.col("event_id") % 6, F.col("event_type"), F.col("user_id").cast("string")
    message = F.concat(F.lit('{"message":"'), kind, F.lit(' failed"'))
    stack = F.concat(message, F.lit(',"name":"TypeError","stack":"TypeError: x\\n    at node:internal/a:1:2\\n    at f (/srv/app/src/u'), user, F.lit(".ts:"), user, F.lit(':7)"}'))
    matched = F.concat(message, F.lit(',"type":"AssertionError","expected":"other","matcherResult":{"expected":"'), user, F.lit('","actual":['), user, F.lit(']},"lineNumber":'), user, F.lit("}"))
    context = F.concat(message, F.lit(',"constructor":{"name":"Special"},"actual":null,"file":"/srv/app/x.ts","line":'), user, F.lit(',"context":{"code":"x()","line":'), user, F.lit(',"column":"no"}}'))
    raw = F.when(k == 0, F.concat(F.lit("{"), kind)).when(k == 1, F.concat(F.lit('"'), kind, F.lit('"'))).when(k == 2, F.concat(F.lit('{"message":'), user, F.lit(',"name":""}')))
    return S.table(spark, sf_dir, "events").select("event_id", raw.when(k == 3, stack).when(k == 4, matched).otherwise(context).alias("error"))


@query(_ERRORS_SQL + """SELECT event_id, CASE WHEN k < 3 THEN 'Unknown error' ELSE message END AS message, CASE k WHEN 3 THEN 'TypeError' WHEN 4 THEN 'AssertionError' WHEN 5 THEN 'Special' ELSE 'Error' END AS kind,
 CASE WHEN k >= 3 THEN user_id END AS line, CASE WHEN k = 4 THEN CAST(user_id AS VARCHAR) END AS expected, CASE WHEN k = 4 THEN 'number' END AS expected_type, CASE k WHEN 4 THEN '[' || CAST(user_id AS VARCHAR) || ']' WHEN 5 THEN 'null' END AS actual,
 CASE k WHEN 4 THEN 'array' WHEN 5 THEN 'null' END AS actual_type, CASE WHEN k = 3 THEN '/srv/app/src/u' || CAST(user_id AS VARCHAR) || '.ts' WHEN k = 5 AND user_id > 0 THEN '/srv/app/x.ts' END AS file, CASE WHEN k = 3 THEN 7 END AS col FROM e""")
def extracted_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = extract.extracted_errors(_raw_errors(spark, sf_dir), "/srv/app")
    return e.select("event_id", "extracted.message", F.col("extracted.type").alias("kind"), "extracted.line", "assertion.expected", "assertion.expected_type", "assertion.actual", "assertion.actual_type", "place.file", F.col("place.column").cast("int").alias("col"))


@query(_ERRORS_SQL + "SELECT event_id, CASE WHEN k = 1 THEN event_type WHEN k IN (0, 2) THEN 'Unhandled error' ELSE message END AS message, CASE k WHEN 3 THEN 'TypeError' ELSE 'Error' END AS kind FROM e")
def stray_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.stray_errors(_raw_errors(spark, sf_dir)).select("event_id", "message", F.col("type").alias("kind"))


@query("SELECT event_id, CASE k WHEN 1 THEN 'string' WHEN 0 THEN NULL ELSE 'object' END AS kind, k >= 2 AS has_message, k = 5 AS assertion FROM (SELECT event_id, event_id % 6 AS k FROM events) WHERE k <> 4 UNION ALL SELECT event_id, 'object', true, true FROM events WHERE event_id % 6 = 4")
def value_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("error")
    return _raw_errors(spark, sf_dir).select("event_id", V.kind_of(e).alias("kind"), V.has_property(e, "message").alias("has_message"), V.is_assertion(e).alias("assertion"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type || ' ' || CAST(user_id AS VARCHAR) WHEN 1 THEN '{ k: ' || json_extract_string(props, '$.k') || ' }' WHEN 2 THEN event_type ELSE '[ 1, ''' || event_type || ''', { ''a b'': { b: { c: [Object] } } } ] null' END AS message, event_id % 4 <> 2 AS has_args FROM events""")
def console_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Console calls of four forms: a text and a number, one object, one text, a nested array and null."""
    kind, k = F.concat(F.lit('"'), F.col("event_type"), F.lit('"')), F.col("event_id") % 4
    nested = F.concat(F.lit("[1, "), kind, F.lit(', {"a b": {"b": {"c": {"d": 1}}}}]'))
    raw = F.when(k == 0, F.array(kind, F.col("user_id").cast("string"))).when(k == 1, F.array("props")).when(k == 2, F.array(kind)).otherwise(F.array(nested, F.lit("null")))
    return V.console_calls(S.table(spark, sf_dir, "events").select("event_id", raw.alias("arguments")), "event_id").select("event_id", "message", F.col("args").isNotNull().alias("has_args"))


@query("SELECT p_partkey, p_size + greatest(coalesce(e, 0), 3) AS end_line FROM part LEFT JOIN (SELECT p_brand b, p_size s, max(p_partkey % 9) e FROM part WHERE p_partkey % 3 = 0 GROUP BY ALL) ON b = p_brand AND s = p_size")
def end_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = S.table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("file"), F.col("p_size").cast("long").alias("start_line"))
    spans = part.filter("p_partkey % 3 = 0").select("file", "start_line", (F.col("start_line") + F.col("p_partkey") % 9).alias("end_line"))
    return extract.with_end_lines(part.withColumn("end_line", F.col("start_line") + 3), spans).select("p_partkey", "end_line")


def _named_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts as tests of a file each, some failures without a message."""
    failed, k = F.col("status") == "failed", F.col("seq") % 3
    return _attempts(spark, sf_dir).select(
        "entity", "seq", "status", "duration", F.concat(F.lit("test "), F.col("entity").cast("string")).alias("name"), F.concat(F.lit("/srv/app/src/"), F.col("entity").cast("string"), F.lit(".ts")).alias("file"),
        F.col("entity").alias("start_line"), (F.col("entity") + 2).alias("end_line"), F.array(F.lit("suite")).alias("suite"), F.when(failed & (k != 0), "boom").alias("message"),
        F.when(failed & (k == 1), "RangeError").alias("type"), F.lit("x").alias("stack"),
    )


@query(_ATTEMPTS + """SELECT seq, CASE status WHEN 'failed' THEN 'failures' ELSE status END AS section, 'test ' || CAST(entity AS VARCHAR) AS test, 'src/' || CAST(entity AS VARCHAR) || '.ts' AS file, CASE WHEN status <> 'failed' THEN status END AS status,
 CASE WHEN status <> 'failed' THEN duration END AS duration, CASE WHEN status = 'failed' THEN CASE seq % 3 WHEN 0 THEN 'Test failed' ELSE 'boom' END END AS message, CASE WHEN status = 'failed' THEN CASE seq % 3 WHEN 0 THEN 'TestFailure' WHEN 1 THEN 'RangeError' ELSE 'Error' END END AS kind FROM a""")
def result_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = extract.entries(_named_attempts(spark, sf_dir), extract.Building(root="/srv/app"))
    return built.select("seq", "section", "entry.test", F.col("entry.fileRelative").alias("file"), "entry.status", "entry.duration", "entry.error.message", F.col("entry.error.type").alias("kind"))


@query(_ATTEMPTS + "SELECT (SELECT count(*) FROM a) + late total, (SELECT count(*) FROM a WHERE status = 'failed') + late failed, (SELECT count(*) FROM a WHERE status = 'failed') + late n_failures, late n_teardown FROM (SELECT count(*) late FROM events WHERE event_id % 6 = 3)")
def teardown_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _attempts(spark, sf_dir)
    late = extract.stray_errors(_raw_errors(spark, sf_dir).filter("event_id % 6 = 3"))
    failures, totals = extract.with_teardown(_named_attempts(spark, sf_dir).filter("status = 'failed'"), report.summary(rows), late)
    counted = failures.agg(F.count("*").alias("n_failures"), F.count_if(F.col("name") == "Teardown Error").alias("n_teardown"))
    return totals.select("total", "failed").join(F.broadcast(counted), F.lit(True), "inner")  # one row each


@query("""SELECT CAST(p_partkey AS VARCHAR) AS row, v[1] AS path, v[1] || ': Expected ' || v[2] AS message FROM (SELECT p_partkey, unnest(CASE p_partkey % 4 WHEN 0 THEN [['root', 'object, got array']] WHEN 1 THEN [['summary', 'object, got undefined'], ['passed', 'array, got string']]
 WHEN 2 THEN CASE WHEN p_size > 40 THEN [['failures (rows)', 'value <= 40, got ' || CAST(p_size AS VARCHAR)]] ELSE [] END || CASE WHEN 2 * p_size + 1 > 100 THEN [['failures (bytes)', 'memory usage <= 100, got ' || CAST(2 * p_size + 1 AS VARCHAR)]] ELSE [] END ELSE CASE WHEN p_size > 30 THEN [['skipped (bytes)', 'memory usage <= 100, got ' || CAST(40 + 2 * p_size AS VARCHAR)]] ELSE [] END END) v FROM part)""")
def structure_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of four forms: an array, one without a summary, one of many failures, one of many bytes."""
    k, n = F.col("p_partkey") % 4, F.col("p_size")
    many = F.concat(F.lit('{"summary":{},"failures":['), F.array_join(F.array_repeat(F.lit("1"), n), ","), F.lit("]}"))
    large = F.concat(F.lit('{"summary":{},"skipped":["'), F.repeat(F.lit("x"), 36 + 2 * n), F.lit('"]}'))
    doc = F.when(k == 0, "[]").when(k == 1, '{"passed":"x"}').when(k == 2, many).otherwise(large)
    rows = S.table(spark, sf_dir, "part").select("p_partkey", doc.alias("document"))
    return validate.structure_violations(rows, "p_partkey", limits=validate.Limits(max_failures=40, max_section_bytes=100))


@query()
def truncate_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = _attempts(spark, sf_dir).filter("status = 'failed'")
    rows = failed.select(
        "entity", "seq", F.repeat(F.lit("expected value did not match. "), 30).alias("message"), F.concat(F.lit("Error: x\n"), F.repeat(F.lit("    at f (/srv/a.ts:1:2)\n"), 20)).alias("stack"),
        F.array_repeat(F.lit("code line"), 9).alias("code"), F.lit(4).alias("line"), F.lit("1").alias("expected"), F.lit("2").alias("actual"),
    )
    others = _attempts(spark, sf_dir).filter("status <> 'failed'")
    failures, _, _, phases = truncate.fit(rows, others, _turns(spark, sf_dir), truncate.Budget(True, True, 20_000))
    return failures.withColumn("phases", F.lit(",".join(phases)))
