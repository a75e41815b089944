"""Registered queries: each applies operators to the given tables, with the SQL that must give the same rows.

The tables hold no log lines, so log operators run on ``logs``, which is derived
from ``events`` by the same rule in Spark and in SQL.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsframe.functions import classify, redact, timestamps
from opsframe.functions.match import Match, extract_status_code, term_filter
from opsframe.functions.ranges import bin_start
from opsframe.operators import alarms, findings, logs, metrics, series, timeline, urls

# Message templates of the derived log table, by event_id % 20; those of PLAIN carry no time.
TEMPLATES = (
    "container web OOMKilled by kernel", "back-off CrashLoopBackOff restarting", "Readiness probe failed: HTTP 503", "0/3 nodes: Insufficient cpu FailedScheduling",
    "redis connection timeout after 2000 ms", "SolrServerException: search failed for core 12345", "java.sql.SQLException: ORA-00060", "login failed for user 77 status=401",
    "Connection refused by db:50000", "request timed out after 30000 ms", "upstream service unavailable", 'GET /cart " 502 12ms', 'GET /img " 404 3ms',
    "  at com.shop.Cart.add(Cart.java:42)", "java.lang.OutOfMemoryError: heap", "com.shop.CartException: empty cart", "ERROR something odd happened",
    "INFO all good", "INFO order 123456 placed password=hunter2", "   ",
)
PLAIN = (13, 19)
ERRORS = Match(preset="errors")
CODES = (401, 404, 502, 503)
HOUR = 3600

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _q(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = f"with {LOGS_SQL}\n{sql}" if re.search(r"\b(from|join) logs\b", sql) and LOGS_SQL not in sql else sql
        return f

    return add


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


LOGS_SQL = f"""logs as (
  select e.event_id, e.ts, e.event_type as log_group, concat('user-', cast(e.user_id as varchar)) as log_stream,
         case when t.id in {PLAIN} then t.tpl else concat(cast(date_trunc('second', e.ts) as varchar), ' ', t.tpl) end as message
  from events e join (values {", ".join(f"({i}, {_text(t)})" for i, t in enumerate(TEMPLATES))}) as t(id, tpl) on e.event_id % 20 = t.id)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame) -> DataFrame:
    """Rows dealt evenly over four tasks for each core: a file of few row groups, whatever its rows, is read by as few tasks."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


def log_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    template = F.element_at(F.array(*map(F.lit, TEMPLATES)), (F.col("event_id") % 20 + 1).cast("int"))
    timed = F.concat(F.date_trunc("second", "ts").cast("timestamp_ntz").cast("string"), F.lit(" "), template)
    message = F.when((F.col("event_id") % 20).isin(*PLAIN), template).otherwise(timed)
    return e.select("event_id", "ts", F.col("event_type").alias("log_group"), F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("log_stream"), message.alias("message"))


def line_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_table(spark, sf_dir).select(F.col("log_group").alias("component"), F.col("log_stream").alias("pod"), F.col("event_id").alias("line_no"), F.col("message").alias("line"), "ts")


def point_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.lit("shop").alias("namespace"), F.col("event_type").alias("metric_name"), F.create_map(F.lit("user"), F.col("user_id").cast("string")).alias("dimensions"), "ts", "value", "event_id")


_HIT = "regexp_matches(message, '(?i)(error|exception|fatal|severe)')"
_BIN = "cast(epoch_us(ts) // 3600000000 * 3600 as bigint)"


@_q(f"select {_BIN} as bin, count(*) as matches from logs where {_HIT} group by 1")
def count_over_time(spark, sf_dir):
    return logs.count_over_time(log_table(spark, sf_dir), ERRORS, HOUR)


@_q("select log_group, count(*) as matches from logs where (regexp_matches(message, '(?i)(timeout|timed out|deadline exceeded)') or contains(message, 'refused')) and not contains(message, 'redis') group by 1")
def count_by_group(spark, sf_dir):
    return logs.count_by(log_table(spark, sf_dir), Match(preset="timeouts", contains=("refused",), exclude=("redis",)), "log_group", None)


@_q("select regexp_extract(message, '\\b(401|404|502|503)\\b', 1) as status_code, count(*) as matches from logs where regexp_matches(message, '\\b(401|404|502|503)\\b') group by 1")
def count_by_status(spark, sf_dir):
    return logs.count_by(log_table(spark, sf_dir), Match(status_codes=CODES), "status_code", None)


@_q(f"select log_group, n as matches, round_even(100.0 * n / sum(n) over (), 1) as share_pct from (select log_group, count(*) as n from logs where {_HIT} group by 1)")
def group_shares(spark, sf_dir):
    return logs.shares(logs.count_by(log_table(spark, sf_dir), ERRORS, "log_group", None), "log_group", "matches")


def _span(spark, sf_dir):
    lo, hi = table(spark, sf_dir, "events").agg(F.min(bin_start(F.col("ts"), HOUR)), F.max(bin_start(F.col("ts"), HOUR))).first()
    return lo, hi


_GRID = f"""points as (select log_group, {_BIN} as bin, count(*) as matches from logs where {_HIT} group by 1, 2),
grid as (select g.log_group, b.bin from (select distinct log_group from points) g,
  (select unnest(generate_series((select min({_BIN}) from logs), (select max({_BIN}) from logs), 3600)) as bin) b),
full_ as (select grid.log_group, grid.bin, coalesce(p.matches, 0) as matches, p.matches as given from grid left join points p using (log_group, bin))"""


@_q(f"select * from (with logs2 as (select 1), {_GRID} select log_group, bin, matches from full_)")
def zero_filled_bins(spark, sf_dir):
    lo, hi = _span(spark, sf_dir)
    points = logs.count_over_time(log_table(spark, sf_dir), ERRORS, HOUR, ("log_group",))
    return series.zero_fill_bins(points, lo, hi, HOUR, ("log_group",))


@_q(f"""select * from (with logs2 as (select 1), {_GRID} select log_group, cast(sum(matches) as bigint) as total, count(*) as expected_bins, count(given) as returned_bins,
  count(*) filter (where matches = 0) as empty_bins, median(matches) as median, max(given) as peak, arg_max(bin, struct_pack(m := given, b := -bin)) filter (where given is not null) as peak_bin,
  min(bin) filter (where matches > 0) as first_bin, max(bin) filter (where matches > 0) as last_bin from full_ group by 1)""")
def series_stats(spark, sf_dir):
    lo, hi = _span(spark, sf_dir)
    points = logs.count_over_time(log_table(spark, sf_dir), ERRORS, HOUR, ("log_group",))
    return series.series_stats(points, lo, hi, HOUR, ("log_group",))


@_q(f"select bin, cast(sum(n) as bigint) as matches from (select {_BIN} as bin, count(*) as n from logs where {_HIT} group by 1, log_group) group by 1")
def merged_series(spark, sf_dir):
    """Bins that come as text cells are read back, aligned and added."""
    cells = logs.count_over_time(log_table(spark, sf_dir), ERRORS, 60, ("log_group",))
    cells = cells.select(F.date_format(F.timestamp_seconds("bin"), "yyyy-MM-dd HH:mm:ss.SSS").alias("label"), F.col("matches").cast("string").alias("count"))
    return series.merge_series(cells, "label", "count", HOUR)[0]


@_q(f"select event_id, ts, log_group, log_stream, message from logs where {_HIT} order by ts desc, event_id limit 20")
def sample_events(spark, sf_dir):
    return logs.sample_events(log_table(spark, sf_dir), ERRORS, 20)


@_q("select event_id, ts, log_group, log_stream, message from logs qualify row_number() over (partition by log_group order by ts, event_id) <= 40")
def fair_limit(spark, sf_dir):
    return logs.fair_limit(log_table(spark, sf_dir), 200, 5)


@_q("""select event_id, log_group from (select *, sum(length(message) + 80) over (order by ts, event_id rows unbounded preceding) as s from
  (select * from logs qualify row_number() over (partition by log_group order by ts, event_id) <= 40)) where s <= 9000""")
def size_budget(spark, sf_dir):
    few = logs.fair_limit(log_table(spark, sf_dir), 200, 5)
    return logs.size_budget(few, F.length("message") + 80, 9000, ["ts", "event_id"]).select("event_id", "log_group")


@_q("select log_group, least(count(*), 40) as returned, count(*) > 40 as more_available from logs group by 1")
def search_coverage(spark, sf_dir):
    events = log_table(spark, sf_dir)
    return logs.search_coverage(events, logs.fair_limit(events, 200, 5))


@_q("select log_stream, min(ts) as first_event, max(ts) as last_event, cast(sum(strlen(message)) as bigint) as stored_bytes from logs where log_group = 'click' group by 1 order by last_event desc, log_stream limit 25")
def list_log_streams(spark, sf_dir):
    return logs.list_log_streams(log_table(spark, sf_dir), "click")


@_q("select conv_id, turn, role, text from conversations qualify row_number() over (partition by conv_id order by turn desc) <= 3")
def stream_tails(spark, sf_dir):
    d = table(spark, sf_dir, "conversations")
    return findings.tail_per_pod(d.withColumn("line_no", F.col("turn")), 3, ("conv_id",)).select("conv_id", "turn", "role", "text")


@_q("select log_group, cast(sum(strlen(message)) as bigint) as bytes, case when sum(strlen(message)) > 100000 then 'too_large' else 'ok' end as verdict, round(sum(strlen(message)) / 1e9 * 0.0053, 6) as price from logs group by 1")
def estimate_scan(spark, sf_dir):
    return logs.estimate_scan(log_table(spark, sf_dir), None, None, 100_000, 0.0053)


@_q("select event_id, message from logs where contains(message, 'timeout') or contains(message, 'refused')")
def term_search(spark, sf_dir):
    d = log_table(spark, sf_dir)
    return d.where(term_filter(F.col("message"), "?timeout ?refused")).select("event_id", "message")


@_q("select event_id, regexp_extract(message, '\\b(401|404|502|503)\\b', 1) as status_code from logs where regexp_matches(message, '\\b(401|404|502|503)\\b')")
def status_codes(spark, sf_dir):
    d = log_table(spark, sf_dir).select("event_id", extract_status_code(F.col("message"), CODES).alias("status_code"))
    return d.where("status_code is not null")


# What category, severity and normalised text each template's line should get, as the SQL states it.
KINDS_SQL = """kinds as (select * from (values
  (0, 'oom_killed', 'high', '<TS> container web OOMKilled by kernel'), (1, 'crash_loop', 'high', '<TS> back-off CrashLoopBackOff restarting'), (2, 'readiness_liveness_failure', 'high', '<TS> Readiness probe failed: HTTP 503'),
  (3, 'scheduling_failure', 'high', '<TS> 0/3 nodes: Insufficient cpu FailedScheduling'), (4, 'redis_error', 'high', '<TS> redis connection timeout after <NUM> ms'), (5, 'search_error', 'high', '<TS> SolrServerException: search failed for core <NUM>'),
  (6, 'database_error', 'high', '<TS> java.sql.SQLException: ORA-<NUM>'), (7, 'authentication_failure', 'medium', '<TS> login failed for user 77 status=401'), (8, 'connection_failure', 'high', '<TS> Connection refused by db:<NUM>'),
  (9, 'timeout', 'medium', '<TS> request timed out after <NUM> ms'), (10, 'upstream_downstream_failure', 'medium', '<TS> upstream service unavailable'), (11, 'http_5xx', 'medium', '<TS> GET /cart " 502 12ms'),
  (12, 'http_4xx', 'low', '<TS> GET /img " 404 3ms'), (13, 'stack_trace', 'medium', 'at com.shop.Cart.add(Cart.java:42)'), (14, 'jvm_application_error', 'medium', '<TS> java.lang.OutOfMemoryError: heap'),
  (15, 'exception', 'medium', '<TS> com.shop.CartException: empty cart'), (16, 'generic_error', 'low', '<TS> ERROR something odd happened'), (17, 'unclassified', 'medium', '<TS> INFO all good'),
  (18, 'unclassified', 'medium', '<TS> INFO order <NUM> placed password=hunter2'), (19, null, 'medium', '')) as t(id, category, severity, normal))"""
_LINES = f"{KINDS_SQL}, lines as (select log_group as component, log_stream as pod, event_id, regexp_replace(message, '^\\s+|\\s+$', '', 'g') as line, normal, category, severity from logs join kinds on id = event_id % 20)"


@_q(f"select * from (with l2 as (select 1), {_LINES} select category, severity, count(*) as n from lines where category is not null group by 1, 2)")
def line_categories(spark, sf_dir):
    d = findings.classified_lines(line_table(spark, sf_dir))
    return d.groupBy("category", classify.severity_of(F.col("category")).alias("severity")).agg(F.count(F.lit(1)).alias("n"))


@_q(f"select * from (with l2 as (select 1), {_LINES} select component, category, count(*) as occurrences, count(distinct normal) as distinct_messages, min(event_id) as first_line, min(severity) as severity from lines where category <> 'unclassified' group by 1, 2)")
def classify_logs(spark, sf_dir):
    d = findings.classify_logs(line_table(spark, sf_dir), ("component",))
    return d.select("component", "category", "occurrences", "distinct_messages", "first_line", "severity")


@_q(f"""select * from (with l2 as (select 1), {_LINES} select component, category, count(*) as occurrence_count, case when category = 'stack_trace' then count(*) else 0 end as frame_count,
  substr(sha256(case category when 'stack_trace' then 'stack_trace|at com.shop.Cart.add' else concat_ws('|', category, case category when 'exception' then 'com.shop.CartException' when 'database_error' then 'java.sql.SQLException'
  when 'search_error' then 'SolrServerException' when 'jvm_application_error' then 'java.lang.OutOfMemoryError' else '' end, min(normal)) end), 1, 16) as stack_fingerprint from lines where category <> 'unclassified' group by 1, 2)""")
def log_evidence(spark, sf_dir):
    d = findings.log_evidence(findings.classify_logs(line_table(spark, sf_dir), ("component",)), ("component",), None)
    return d.select("component", "category", "occurrence_count", "frame_count", "stack_fingerprint")


@_q(f"select * from (with l2 as (select 1), {_LINES} select component, category, min(cast(regexp_extract(line, '^\\d+-\\d+-\\d+ \\d+:\\d+:\\d+') as timestamp)) as first_seen, regexp_extract(min_by(line, event_id), '([\\w.$]*(?:Exception|Error))\\b', 1) as exception_class from (select * from lines where category in ('exception', 'database_error') qualify row_number() over (partition by component, category order by event_id) <= 1) group by 1, 2)")
def first_exceptions(spark, sf_dir):
    d = findings.log_evidence(findings.classify_logs(line_table(spark, sf_dir), ("component",), 1), ("component",), None)
    return d.where(F.col("category").isin("exception", "database_error")).select("component", "category", F.col("first_seen_local").alias("first_seen"), "exception_class")


@_q(f"select * from (with l2 as (select 1), {_LINES} select category, string_agg(distinct component, ',' order by component) as components from lines where category <> 'unclassified' group by 1 having count(distinct component) > 1)")
def co_occurring(spark, sf_dir):
    d = findings.co_occurring_categories(findings.classify_logs(line_table(spark, sf_dir), ("component",)))
    return d.select("category", F.array_join("components", ",").alias("components"))


@_q(f"select * from (with l2 as (select 1), {_LINES} select normal, count(*) as n from lines where line <> '' group by 1)")
def normalized_messages(spark, sf_dir):
    d = findings.classified_lines(line_table(spark, sf_dir)).select(classify.normalize_message(F.col("line")).alias("normal"))
    return d.groupBy("normal").agg(F.count(F.lit(1)).alias("n"))


def _chain(column: str, rules) -> str:
    for p, r in rules:
        column = f"regexp_replace({column}, {_text(p)}, {_text(r)}, 'g')"
    return column


# The patterns of secrets, as the SQL states them.
_SECRETS = (
    r"(?i)\b(password|passwd|pwd)\b\s*[:=]\s*\S+", r"(?i)\b(api[_-]?key|apikey)\b\s*[:=]\s*\S+", r"(?i)\b(secret|token|access[_-]?key|client[_-]?secret)\b\s*[:=]\s*\S+",
    r"(?i)authorization:\s*bearer\s+\S+", r"AKIA[0-9A-Z]{16}", r"(?i)jdbc:\S*password=\S+",
)
_WITHHELD = (
    *_SECRETS, r"(?i)\b(aws[_-]?secret[_-]?access[_-]?key)\b\s*[:=]\s*\S+", r"(?i)\b(aws[_-]?session[_-]?token)\b\s*[:=]\s*\S+", r"\bhvs\.[A-Za-z0-9]{20,}\b", r"\b[sb]\.[A-Za-z0-9]{24,}\b",
    r"(?i)authorization:\s*basic\s+\S+", r"(?i)\b(postgres|postgresql|redis|amqp|mongodb|mysql)://[^\s:@/]*:[^\s@]+@\S+", r"-----BEGIN(?:\s+\S+)?\s+PRIVATE KEY-----[\s\S]*?-----END(?:\s+\S+)?\s+PRIVATE KEY-----",
)


@_q(f"select doc_id, md5({_chain('text', [(p, '<redacted>') for p in _SECRETS])}) as redacted from documents")
def redact_secrets(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(redact.redact_secrets(F.col("text"))).alias("redacted"))


@_q("select event_id, replace(message, 'password=hunter2', 'password=[REDACTED]') as message from logs")
def sanitize_messages(spark, sf_dir):
    return log_table(spark, sf_dir).select("event_id", redact.sanitize_text(F.col("message")).alias("message"))


_SECRET_SQL = " or ".join(f"regexp_matches(text, {_text(p)})" for p in _WITHHELD)


@_q(f"""select doc_id, ({_SECRET_SQL}) as has_secret, len([t for t in regexp_extract_all(text, '[A-Za-z0-9+/_=-]{{32,}}') if regexp_matches(t, '[a-z]')::int + regexp_matches(t, '[A-Z]')::int
  + regexp_matches(t, '[0-9]')::int + regexp_matches(t, '[^A-Za-z0-9]')::int >= 3]) > 0 as high_entropy from documents""")
def withheld_documents(spark, sf_dir):
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", redact.has_secret(text).alias("has_secret"), redact.looks_high_entropy(text).alias("high_entropy"))


@_q("""select event_type as metric_name, count(value) as n, min(value) as min, max(value) as max, round(avg(value), 6) as avg, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.9), 6) as p90,
  round(quantile_cont(value, 0.95), 6) as p95, round(quantile_cont(value, 0.99), 6) as p99, arg_max(value, struct_pack(t := ts, v := value)) as latest, min(ts) as first_at, max(ts) as last_at from events where value is not null group by 1""")
def metric_summary(spark, sf_dir):
    d = metrics.metric_summary(point_table(spark, sf_dir), exact=True).drop("max_at")
    return d.select("metric_name", "n", "min", "max", *[F.round(c, 6).alias(c) for c in ("avg", "p50", "p90", "p95", "p99")], "latest", "first_at", "last_at")


@_q(f"select event_type as metric_name, {_BIN} as period_start, round(quantile_cont(value, 0.9), 6) as value from events group by 1, 2")
def metric_p90(spark, sf_dir):
    d = metrics.metric_statistic(point_table(spark, sf_dir), "p90", HOUR, exact=True)
    return d.select("metric_name", "period_start", F.round("value", 6).alias("value"))


@_q("""select l_returnflag as metric_name, round(avg(l_quantity), 6) as value from (select *, quantile_cont(l_quantity, 0.25) over (partition by l_returnflag) as a,
  quantile_cont(l_quantity, 0.75) over (partition by l_returnflag) as b from lineitem) where l_quantity between a and b group by 1""")
def interquartile_mean(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("metric_name"), F.to_timestamp(F.lit("2000-01-01")).alias("ts"), F.col("l_quantity").alias("value"))
    return metrics.metric_statistic(d, "IQM", HOUR, exact=True).select("metric_name", F.round("value", 6).alias("value"))


@_q("""select event_type as metric_name, event_id, ts, value from (select *, row_number() over (partition by event_type order by ts, event_id) - 1 as i,
  cast(ceil(count(*) over (partition by event_type) / 200.0) as bigint) as k from events) where i % k = 0""")
def downsample(spark, sf_dir):
    return metrics.downsample(point_table(spark, sf_dir), 200, order=("ts", "event_id")).select("metric_name", "event_id", "ts", "value")


@_q("select event_type as metric_name, cast(user_id as varchar) as \"user\", count(*) as points from events where event_type = 'click' group by 1, 2")
def list_metrics(spark, sf_dir):
    d = metrics.list_metrics(point_table(spark, sf_dir), metric_name="click", limit=None)
    return d.select("metric_name", F.col("dimensions")["user"].alias("user"), "points")


@_q("select n_name as metric_name from nation where n_name not in (select event_type from events)")
def empty_series(spark, sf_dir):
    return metrics.empty_series_report(table(spark, sf_dir, "nation").select(F.col("n_name").alias("metric_name")), point_table(spark, sf_dir))


def _states(spark, sf_dir):
    state = F.when(F.col("value") > 100, "ALARM").otherwise("OK")
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("string").alias("alarm_name"), "ts", "event_id", state.alias("state"), F.lit("StateUpdate").alias("type"), F.to_json(F.struct(F.struct(state.alias("stateValue")).alias("newState"))).alias("history_data"))


@_q("select cast(user_id as varchar) as alarm_name, count(*) filter (where value > 100) as to_alarm, count(*) filter (where value > 100) >= 5 as flapping from events group by 1")
def alarm_transitions(spark, sf_dir):
    return alarms.alarm_transitions(alarms.read_alarm_history(_states(spark, sf_dir)))


@_q("""with last_ as (select cast(user_id as varchar) as name, case when arg_max(coalesce(value, 0), struct_pack(t := ts, e := event_id)) > 100 then 'ALARM' else 'OK' end as state from events group by user_id)
  select state, count(*) as n, case when state = 'ALARM' then array_to_string(list_sort(list(name))[1:20], ',') end as names from last_ group by 1""")
def alarm_state_counts(spark, sf_dir):
    last = _states(spark, sf_dir).groupBy(F.col("alarm_name").alias("name")).agg(F.max_by("state", F.struct("ts", "event_id")).alias("state"))
    return alarms.alarm_state_counts(alarms.read_alarms(last)).select("state", "n", F.array_join("names", ",").alias("names"))


@_q("select event_id, cast(date_trunc('second', ts) as timestamp) as ts_local, 1 as tier from logs where event_id % 20 not in (13, 19)")
def parsed_times(spark, sf_dir):
    d = log_table(spark, sf_dir).withColumn("p", timestamps.parse_log_timestamp(F.col("message")))
    return d.where("p is not null").select("event_id", F.col("p.ts_local").alias("ts_local"), F.col("p.tier").alias("tier"))


def _timeline(spark, sf_dir):
    e = log_table(spark, sf_dir)
    none = F.lit(None).cast("timestamp")
    return e.select(
        F.lit(1).alias("tier"), none.alias("ts_utc"), F.col("ts").alias("ts_local"), F.lit(None).cast("double").alias("time_of_day"), F.col("event_id").alias("seq"),
        F.col("ts").cast("string").alias("timestamp"), F.col("log_group").alias("component"), F.col("log_stream").alias("pod"), F.lit("r1").alias("release"),
        classify.classify_line(F.col("message")).alias("category"), F.lit("medium").alias("severity"), F.lit("log").alias("source"), F.col("message").alias("summary"),
    )


_ISLANDS = "islands as (select event_id, ts, log_group, cast(substr(log_stream, 6) as bigint) as user_id, sum(b) over (order by ts, event_id rows unbounded preceding) as island from (select *, case when ts - lag(ts) over (order by ts, event_id) > interval 600 second then 1 else 0 end as b from logs))"


@_q(f"select * from (with l2 as (select 1), {_ISLANDS} select event_id as seq, cast(island as bigint) as island from islands)")
def correlate_timeline(spark, sf_dir):
    return timeline.correlate_timeline(_timeline(spark, sf_dir), 600)[0].select("seq", "island")


@_q(f"select * from (with l2 as (select 1), {_ISLANDS} select cast(island as bigint) as island, count(*) as evidence_count, cast(epoch_us(max(ts)) - epoch_us(min(ts)) as double) / 1e6 as duration_seconds, string_agg(distinct log_group, ',' order by log_group) as components, count(distinct user_id) as n_pods, list_sort(list(distinct concat('user-', cast(user_id as varchar))))[5] as fifth_pod from islands group by 1)")
def timeline_groups(spark, sf_dir):
    g = timeline.roll_up_groups(timeline.correlate_timeline(_timeline(spark, sf_dir), 600)[0])
    return g.select("island", "evidence_count", "duration_seconds", F.array_join("components", ",").alias("components"), "n_pods", F.get("pods", F.lit(4)).alias("fifth_pod"))


@_q("select page_id, regexp_matches(url, '^(?i:https?)://[^/?#\\s]+') as valid from pages")
def valid_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.valid_url(F.col("url")).alias("valid"))


def _url_table(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.concat(F.lit("c"), F.col("page_id").cast("string")).alias("short_code"), F.col("url").alias("original_url"), F.lit(1).cast("long").alias("clicks"))


def _clicks(spark, sf_dir):
    return table(spark, sf_dir, "events").where("event_type = 'click'").select("event_id", F.concat(F.lit("c"), (F.col("event_id") % 60).cast("string")).alias("short_code"))


_CLICK = "(select event_id, concat('c', cast(event_id % 60 as varchar)) as short_code from events where event_type = 'click')"


@_q(f"select p.page_id as id, 1 + coalesce(c.n, 0) as clicks from pages p left join (select short_code, count(*) as n from {_CLICK} group by 1) c on c.short_code = concat('c', cast(p.page_id as varchar))")
def click_counts(spark, sf_dir):
    return urls.click_counts(_url_table(spark, sf_dir), _clicks(spark, sf_dir)).select("id", "clicks")


@_q(f"select c.event_id, p.url as original_url from {_CLICK} c join pages p on c.short_code = concat('c', cast(p.page_id as varchar))")
def resolve_short_codes(spark, sf_dir):
    return urls.resolve_short_codes(_clicks(spark, sf_dir), _url_table(spark, sf_dir))[0].select("event_id", "original_url")


@_q("select count(distinct url) as urls, count(distinct url) as codes from pages where regexp_matches(url, '^(?i:https?)://[^/?#\\s]+')")
def unique_codes(spark, sf_dir):
    new = table(spark, sf_dir, "pages").select(F.col("url").alias("original_url"))
    coded = urls.assign_unique_codes(new, new.sparkSession.createDataFrame([], "short_code string"))
    return coded.agg(F.countDistinct("original_url").alias("urls"), F.countDistinct("short_code").alias("codes"))


# The name hints of the categories, as the SQL states them.
_HINTS = """(values ('hcl_commerce', 'commerce'), ('hcl_commerce', 'ts-app'), ('hcl_commerce', 'ts-web'), ('hcl_commerce', 'ts-utils'), ('hcl_commerce', 'search-app'), ('hcl_commerce', 'query-app'), ('hcl_commerce', 'crs-app'),
  ('hcl_commerce', 'xc-app'), ('hcl_commerce', 'hcl'), ('hcl_commerce', 'websphere'), ('hcl_commerce', 'liberty'), ('hcl_commerce', 'wcs'), ('solr', 'solr'), ('solr', 'search-app'), ('redis', 'redis'), ('redis', 'elasticache'), ('redis', 'valkey'),
  ('nginx', 'nginx'), ('nginx', 'ingress'), ('eks', '/aws/eks'), ('eks', 'eks'), ('eks', 'containerinsights'), ('eks', 'kubernetes'), ('eks', 'k8s'), ('ec2', '/aws/ec2'), ('ec2', 'ec2'), ('ec2', 'cloudwatch-agent'), ('ec2', '/var/log'),
  ('alb_nlb', 'elb'), ('alb_nlb', 'alb'), ('alb_nlb', 'nlb'), ('alb_nlb', 'loadbalancer'), ('alb_nlb', 'load-balancer'), ('cloudfront', 'cloudfront'), ('cloudfront', 'cdn'), ('waf', 'waf'), ('waf', 'aws-waf-logs'), ('lambda', '/aws/lambda'),
  ('rds', '/aws/rds'), ('rds', 'rds'), ('rds', 'db2'), ('rds', 'postgres'), ('rds', 'mysql'), ('vpc_flow', 'vpc'), ('vpc_flow', 'flowlog'), ('vpc_flow', 'flow-log'), ('route53', 'route53'), ('sns_ses', 'sns'), ('sns_ses', 'ses')) as h(category, hint)"""


_GROUPS = """(select concat('/', lower(n_name), '/', word, '-', cast(s_suppkey as varchar)) as name from supplier join nation on s_nationkey = n_nationkey join (values (0, 'ts-app'), (1, 'Search-App-slave'), (2, 'redis-cache'), (3, 'aws/rds/main'), (4, 'eks-k8s'),
  (5, 'plain'), (6, 'aws-waf-logs'), (7, 'nginx-ingress'), (8, 'vpc-flowlog'), (9, 'cdn'), (10, 'sesns')) as w(id, word) on w.id = s_suppkey % 11)"""


@_q(f"select distinct name, category from {_GROUPS} join {_HINTS} on contains(lower(name), hint)")
def group_categories(spark, sf_dir):
    words = ("ts-app", "Search-App-slave", "redis-cache", "aws/rds/main", "eks-k8s", "plain", "aws-waf-logs", "nginx-ingress", "vpc-flowlog", "cdn", "sesns")
    d = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    word = F.element_at(F.array(*map(F.lit, words)), (F.col("s_suppkey") % 11 + 1).cast("int"))
    return logs.group_categories(d.select(F.concat(F.lit("/"), F.lower("n_name"), F.lit("/"), word, F.lit("-"), F.col("s_suppkey").cast("string")).alias("name")))


@_q(f"select category, min(doc_id) as first_doc, count(distinct doc_id) as n from documents join {_HINTS} on contains(lower(text), hint) group by 1")
def text_categories(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.concat_ws(" ", "doc_id", "text").alias("name"))
    tags = logs.group_categories(d).select("category", F.substring_index("name", " ", 1).cast("long").alias("doc_id"))
    return tags.groupBy("category").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_over_time(spark, sf_dir)

from opsframe import fleet_queries, store_queries  # noqa: E402, F401  register their queries
