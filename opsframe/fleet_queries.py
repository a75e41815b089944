"""Registered queries on cluster, host and catalogue tables.

The given tables hold no snapshots, so these are derived from ``customer``,
``supplier``, ``part`` and ``events``: Spark writes them in the text form that
the operators read, while the SQL states what should come out of the operators.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsframe.functions import classify, redact, timestamps
from opsframe.functions.ranges import TimeRange
from opsframe.operators import alarms, findings, hosts, logs, metrics, pods, timeline, urls
from opsframe.operators.ordered import numbered
from opsframe.queries import LOGS_SQL, _q, _states, _url_table, dealt, log_table, point_table, table
from opsframe.sources import results, snapshots

# Fixed values of the derived pods, by customer key.
CONTAINERS = ("ts-app", "crs-app", "sidecar,ts-web", "nginx-main", "redis", "search-app-slave", "utils", "other")
SPACES = ("commerce", "commerce", "commerce", "nginx", "redis", "commerce", "commerce", "commerce")
WITHIN = TimeRange(datetime(2024, 1, 5), datetime(2024, 1, 12, 12))

_K = "(c_custkey % 8)"
#: The derived pods as SQL; null where the snapshot says that there is none.
PODS_SQL = f"""pods as (select c_custkey as k, c_custkey // 50 as snapshot_id, concat('pod-', cast(c_custkey as varchar)) as pod,
  case when c_custkey % 10 = 0 then 'elsewhere' when {_K} = 3 then 'nginx' when {_K} = 4 then 'redis' else 'commerce' end as namespace,
  case c_custkey % 5 when 4 then null when 3 then 'Pending' else 'Running' end as phase,
  case when c_custkey % 7 = 6 then null else concat('r', cast(c_custkey % 7 as varchar)) end as release,
  greatest(case when c_custkey % 17 = 0 then 0 else c_custkey % 3 end, c_custkey % 4) as restart_count,
  case when c_custkey % 11 = 0 then 'CrashLoopBackOff' when c_custkey % 13 = 0 then 'ImagePullBackOff' end as waiting_reason,
  case {_K} when 0 then 'ts-app' when 1 then 'crs-app' when 2 then 'sidecar,ts-web' when 3 then 'nginx-main' when 4 then 'redis' when 5 then 'search-app-slave' when 6 then 'utils' else 'other' end as containers
  from customer)"""
#: Pods of each leaf component, by the names that the component table gives.
MATCHED_SQL = f"""{PODS_SQL}, matched as (select pods.*, leaf, container from pods join (values (0, 'ts-app', 'ts-app'), (1, 'crs-app', 'crs-app'), (2, 'ts-web', 'ts-web'), (3, 'nginx', 'nginx-main'),
  (4, 'redis', 'redis'), (5, 'search-app-slave', 'search-app-slave'), (6, 'utils', 'utils')) as m(turn, leaf, container) on k % 8 = turn where k % 10 <> 0 and k % 19 <> 0),
stated as (select *, case when waiting_reason = 'CrashLoopBackOff' then 'crash_looping' when waiting_reason = 'ImagePullBackOff' then 'image_pull_backoff' end as state from matched),
status as (select leaf, count(*) as total, count(*) filter (where phase = 'Running') as running, count(*) filter (where state = 'crash_looping') as crash_looping,
  count(*) filter (where state = 'image_pull_backoff') as image_pull_backoff, count(*) filter (where restart_count > 0) as pods_with_restarts from stated group by leaf),
components as (select * from (values ('ts-app', 'ts-app', false), ('crs-app', 'crs-app', false), ('ts-web', 'ts-web', false), ('store-web', 'store-web', false), ('cache-app', 'cache-app', false), ('tooling-web', 'tooling-web', true),
  ('search-app', 'search-app-repeater', false), ('search-app', 'search-app-slave', false), ('search-app-repeater', 'search-app-repeater', false), ('search-app-slave', 'search-app-slave', false),
  ('nginx', 'nginx', false), ('redis', 'redis', false), ('wcbd', 'wcbd', true), ('utils', 'utils', true)) as c(component, leaf, known_optional))"""


def _pick(values: tuple, at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))


def _pod_columns() -> dict[str, Column]:
    k = F.col("c_custkey")
    none = lambda c: F.coalesce(c, F.lit("<none>"))
    number = lambda n: (k % n).cast("string")
    return {
        "name": F.concat(F.lit("pod-"), k.cast("string")), "namespace": F.when(k % 10 == 0, "elsewhere").otherwise(_pick(SPACES, k % 8)),
        "phase": _pick(("Running", "Running", "Running", "Pending", "<none>"), k % 5), "release": none(F.when(k % 7 != 6, F.concat(F.lit("r"), number(7)))), "group": F.lit("<none>"),
        "restarts": F.concat(F.when(k % 17 == 0, "x").otherwise(number(3)), F.lit(","), number(4)),
        "waiting": none(F.when(k % 11 == 0, "CrashLoopBackOff").when(k % 13 == 0, "ImagePullBackOff")), "containers": _pick(CONTAINERS, k % 8),
    }


def _pods(spark, sf_dir) -> DataFrame:
    """Pods as read from lines of eight columns; every nineteenth line is cut short."""
    c = list(_pod_columns().values())
    line = F.when(F.col("c_custkey") % 19 == 0, F.concat_ws("  ", *c[:3])).otherwise(F.concat_ws("  ", *c))
    return snapshots.parse_pods_lenient(dealt(table(spark, sf_dir, "customer").select("c_custkey")).select(line.alias("value")))


def _matched(spark, sf_dir) -> DataFrame:
    return pods.match_pods(_pods(spark, sf_dir), pods.component_table(spark), "commerce")


@_q(f"with {PODS_SQL} select pod, namespace, phase, release, restart_count, waiting_reason, containers from pods where k % 19 <> 0")
def pods_lenient(spark, sf_dir):
    return _pods(spark, sf_dir).select("pod", "namespace", "phase", "release", "restart_count", "waiting_reason", F.array_join("containers", ",").alias("containers"))


def _strict(spark, sf_dir):
    """Snapshots of nine columns and fifty pods; a flag that cannot be read, at every 397th key, withholds its snapshot."""
    k, p = F.col("c_custkey"), _pod_columns()
    n = F.size(F.split(p["containers"], ","))
    ready = F.when(k % 397 == 5, F.array_repeat(F.lit("maybe"), n)).otherwise(F.array_repeat(F.when(k % 2 == 0, "true").otherwise("false"), n))
    fields = [p["name"], p["namespace"], F.lit("Running"), F.lit("10.0.0.1"), F.concat(F.lit("node-"), (k % 9).cast("string")), p["containers"], F.regexp_replace(p["containers"], "[a-z-]+", "img:1"), F.array_join(ready, ","), F.array_join(F.array_repeat((k % 4).cast("string"), n), ",")]
    lines = table(spark, sf_dir, "customer").select(F.floor(k / 50).alias("snapshot_id"), F.struct("c_custkey", F.concat_ws("\t", *fields).alias("line")).alias("at"))
    text = lines.groupBy("snapshot_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("at")), lambda x: x["line"]), "\n").alias("text"))  # a snapshot is one listing
    return snapshots.parse_pods_strict(text, 9)


@_q(f"""with {PODS_SQL} select snapshot_id, pod, namespace, concat('node-', cast(k % 9 as varchar)) as node, len(string_split(containers, ',')) as total_count,
  case when k % 2 = 0 then len(string_split(containers, ',')) else 0 end as ready_count, k % 4 as restart_count from pods where snapshot_id not in (select snapshot_id from pods where k % 397 = 5)""")
def pods_strict(spark, sf_dir):
    return _strict(spark, sf_dir)[0].select("snapshot_id", "pod", "namespace", "node", "ready.total_count", "ready.ready_count", "restart_count")


@_q("select c_custkey // 50 as snapshot_id, count(*) as bad_rows from customer where c_custkey % 397 = 5 group by 1")
def withheld_snapshots(spark, sf_dir):
    return _strict(spark, sf_dir)[1].select("snapshot_id", "bad_rows")


@_q("""select s_suppkey // 10 as snapshot_id, s_name as name, s_suppkey % 5 as desired, case when s_suppkey % 3 = 0 then 0 else s_suppkey % 4 end as ready, case when s_suppkey % 6 <> 1 then s_suppkey % 4 end as available, 2 as images
  from supplier where s_suppkey // 10 not in (select s_suppkey // 10 from supplier where s_suppkey % 61 = 7)""")
def workloads(spark, sf_dir):
    """Deployments in listings of ten; a count that is no number, at every 61st key, withholds it."""
    k = F.col("s_suppkey")
    text = lambda c: c.cast("string")
    fields = [F.col("s_name"), F.lit("commerce"), F.when(k % 61 == 7, "many").otherwise(text(k % 5)), F.when(k % 3 == 0, "<none>").otherwise(text(k % 4)), F.when(k % 6 == 1, "<none>").otherwise(text(k % 4)), F.lit("1"), F.lit("a,b"), F.lit("img:1,img:2")]
    d = table(spark, sf_dir, "supplier").select(F.floor(k / 10).alias("snapshot_id"), F.struct("s_suppkey", F.concat_ws(" ", *fields).alias("line")).alias("at"))
    listing = d.groupBy("snapshot_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("at")), lambda x: x["line"]), "\n").alias("text"))
    return snapshots.parse_workloads(listing, "deployment")[0].select("snapshot_id", "name", "desired", "ready", "available", F.size("containers").alias("images"))


@_q("select c_custkey as k, concat(cast((c_custkey % 2) + (c_custkey % 3 > 0)::int as varchar), '/2') as ready, greatest(c_custkey % 4, c_custkey % 6) as restarts, case when c_custkey % 7 = 0 then 'CrashLoopBackOff' end as waiting from customer")
def pod_summaries(spark, sf_dir):
    k = F.col("c_custkey")
    one = lambda ready, restarts, why: F.struct(ready.alias("ready"), restarts.alias("restartCount"), F.struct(F.struct(why.alias("reason")).alias("waiting")).alias("state"))
    status = F.array(one(k % 2 == 1, k % 4, F.lit(None).cast("string")), one(k % 3 > 0, k % 6, F.when(k % 7 == 0, "CrashLoopBackOff")))
    return snapshots.pod_summary(table(spark, sf_dir, "customer").select(k.alias("k"), status.alias("containerStatuses"))).select("k", "ready", "restarts", "waiting")


@_q(f"with {MATCHED_SQL} select pod, namespace, leaf, container, restart_count from matched")
def matched_pods(spark, sf_dir):
    return _matched(spark, sf_dir).select("pod", "namespace", "leaf", "container", "restart_count")


@_q(f"""with {MATCHED_SQL} select s.*, phases from status s join (select leaf, string_agg(concat(phase, '=', cast(n as varchar)), ',' order by phase) as phases
  from (select leaf, coalesce(phase, 'Unknown') as phase, count(*) as n from matched group by 1, 2) group by leaf) p on p.leaf = s.leaf""")
def pod_status(spark, sf_dir):
    d = pods.pod_status_summary(_matched(spark, sf_dir))
    phases = F.array_join(F.transform(F.map_entries("phases"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return d.withColumn("phases", phases)


@_q(f"with {MATCHED_SQL} select leaf, string_agg(distinct release, ',' order by release) as releases, case when count(distinct release) = 1 then min(release) end as release_single from matched group by leaf")
def component_releases(spark, sf_dir):
    return pods.releases(_matched(spark, sf_dir)).withColumn("releases", F.array_join("releases", ","))


@_q(f"""with {MATCHED_SQL} select component, leaf, coalesce(total, 0) as n_pods, case when total is not null then 'found' when known_optional then 'not_deployed' else 'no_matching_pods' end as status
  from components left join status using (leaf)""")
def component_inventory(spark, sf_dir):
    return pods.component_inventory(pods.component_table(spark), _matched(spark, sf_dir)).select("component", "leaf", "n_pods", "status")


@_q(f"""with {MATCHED_SQL} select component, leaf, total, running, case when total is null and known_optional then 'not_deployed' when total is null then 'no_matching_pods'
  when running = total and crash_looping = 0 and image_pull_backoff = 0 then 'healthy' else 'attention_needed' end as health from components left join status using (leaf)""")
def component_health(spark, sf_dir):
    return pods.component_health(pods.component_table(spark), _matched(spark, sf_dir)).select("component", "leaf", "total", "running", "health")


@_q(f"""with {MATCHED_SQL}, found as (select event_type, count(distinct case when event_id % 20 < 14 then event_id % 20 end) as n from events group by 1)
  select leaf, event_type, case when running = 0 then 'low - no pods currently Running; only cluster-state evidence available, no live logs' when n = 0 then 'low - pods running, no error patterns matched in the scanned log window'
  when n >= 2 then 'medium - multiple error categories observed' else 'low' end as confidence from status, found""")
def component_confidence(spark, sf_dir):
    n = table(spark, sf_dir, "events").groupBy("event_type").agg(F.countDistinct(F.when(F.col("event_id") % 20 < 14, F.col("event_id") % 20)).alias("n"))
    both = pods.pod_status_summary(_matched(spark, sf_dir)).join(n, F.lit(True))  # seven components and five types
    return both.select("leaf", "event_type", classify.confidence(F.col("total"), F.col("running"), F.col("n")).alias("confidence"))


@_q(f"with {MATCHED_SQL} select leaf, pod from (select *, row_number() over (partition by leaf order by namespace, pod) as r from matched) where r <= 3")
def first_pods(spark, sf_dir):
    return pods.first_pods(_matched(spark, sf_dir), 3).select("leaf", "pod")


@_q(f"with {PODS_SQL} select pod, phase from pods where namespace = 'nginx' and k % 19 <> 0")
def namespace_pods(spark, sf_dir):
    return pods.scope_namespace(_pods(spark, sf_dir), "nginx").select("pod", "phase")


def _pod_lines(spark, sf_dir):
    """Log lines by pod: a quarter of them from before a restart."""
    e = F.col("event_id")
    d = log_table(spark, sf_dir).select("event_id", F.concat(F.lit("pod-"), (e % 150).cast("string")).alias("pod"), F.when(e % 4 == 3, "previous").otherwise("current").alias("log_source"), F.col("event_id").alias("line_no"), F.col("message").alias("line"))
    matched = _matched(spark, sf_dir)
    return pods.attach_pod_context(d.join(matched.select("namespace", "pod").hint("merge"), "pod"), matched)


@_q(f"""with {MATCHED_SQL} select event_id, leaf, container, release, case when event_id % 4 = 3 then 'previous' else 'current' end as log_source from events e join matched on k = event_id % 150
  where event_id % 4 <> 3 or restart_count > 0""")
def pod_log_context(spark, sf_dir):
    return pods.pair_previous_logs(_pod_lines(spark, sf_dir)).select("event_id", "leaf", "container", "release", "log_source")


_EACH = f"with {MATCHED_SQL}, each_ as (select pod, count(*) as lines_returned, count(*) >= 40 as tail_cap_hit from events e join matched on k = event_id % 150 group by 1)"


@_q(f"{_EACH} select * from each_")
def log_coverage(spark, sf_dir):
    return findings.log_coverage(_pod_lines(spark, sf_dir), 40)[0]


@_q(f"{_EACH} select cast(sum(lines_returned) as bigint) as lines_returned, count(*) as pods_sampled, bool_or(tail_cap_hit) as any_pod_cap_hit, sum(lines_returned) >= 40 as total_cap_hit from each_")
def log_coverage_total(spark, sf_dir):
    return findings.log_coverage(_pod_lines(spark, sf_dir), 40)[1]


@_q("select n_name as name from nation union all select 'no-such' where exists (select 1 from nation)")
def unknown_components(spark, sf_dir):
    names = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"))
    given = names.unionByName(names.limit(1).select(F.explode(F.array(F.lit(" TS-App "), F.lit("no-such"), F.lit("redis"))).alias("name")))
    return pods.unknown_components(given, pods.component_table(spark)).select("name")


# The hints of the components, in table order, as the SQL states them.
_HINTS_SQL = """(values (1, 'ts-app', 'ts-app'), (1, 'ts-app', 'transaction server'), (1, 'ts-app', 'transaction'), (2, 'crs-app', 'crs-app'), (2, 'crs-app', 'crs'), (2, 'crs-app', 'store server'), (2, 'crs-app', 'rest api'), (3, 'ts-web', 'ts-web'),
  (4, 'store-web', 'store-web'), (4, 'store-web', 'storefront'), (4, 'store-web', 'store front'), (5, 'search-app', 'search'), (5, 'search-app', 'solr'), (5, 'search-app', 'elastic'), (6, 'cache-app', 'cache-app'), (6, 'cache-app', 'dynacache'),
  (7, 'nginx', 'nginx'), (7, 'nginx', 'ingress'), (7, 'nginx', '4xx'), (7, 'nginx', '5xx'), (7, 'nginx', ' http '), (8, 'redis', 'redis'), (8, 'redis', 'session store'), (9, 'tooling-web', 'tooling'), (10, 'wcbd', 'wcbd'), (11, 'utils', ' utils')) as h(place, component, hint)"""


@_q(f"""with {LOGS_SQL}, texts as (select doc_id as id, concat(' ', lower(coalesce(text, '')), ' ') as t from documents union all select -1 - page_id, concat(' ', lower(url), ' ') from pages union all select -1000000 - event_id, concat(' ', lower(message), ' ') from logs),
  hits as (select distinct id, place, component from texts join {_HINTS_SQL} on contains(t, hint))
  select t.id, coalesce(string_agg(component, ',' order by place), 'ts-app,crs-app,ts-web,store-web') as components from texts t left join hits h on h.id = t.id group by t.id""")
def inferred_components(spark, sf_dir):
    """Texts, URLs and messages."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("t"))
    d = d.unionByName(table(spark, sf_dir, "pages").select((-1 - F.col("page_id")).alias("id"), F.col("url").alias("t")))
    d = d.unionByName(log_table(spark, sf_dir).select((-1_000_000 - F.col("event_id")).alias("id"), F.col("message").alias("t")))
    return d.select("id", F.array_join(classify.infer_components(F.col("t")), ",").alias("components"))


@_q("""select event_id, case when event_id % 20 = 7 then 'authentication_failure' when event_id % 20 = 17 then 'unclassified' end as category, event_type as count_of from events where event_id % 20 in (7, 17) and event_type <> 'view'""")
def warning_categories(spark, sf_dir):
    d = log_table(spark, sf_dir).select("event_id", F.when(F.col("log_group") == "view", "Normal").otherwise("Warning").alias("type"), "message", F.col("event_id").alias("count"), F.col("log_group").alias("count_of"))
    return findings.classify_warning_events(d, None).where("event_id % 20 in (7, 17)").select("event_id", "category", "count_of")


@_q("select event_id, event_type from events where event_type in ('click', 'error') and ts between timestamp '2024-01-05' and timestamp '2024-01-12 12:00:00' and cast(user_id as varchar) like '1%' and event_id % 20 in (4, 9)")
def filtered_log_events(spark, sf_dir):
    d = logs.read_log_events(log_table(spark, sf_dir), ["click", "error", "click"], WITHIN, "user-1", "?timeout ?timed")
    return d.select("event_id", F.col("log_group").alias("event_type"))


@_q("select event_id, ts from (select * from events where event_type = 'click' and user_id = 7 order by ts desc, event_id desc limit 5)")
def newest_stream_events(spark, sf_dir):
    return logs.read_stream_events(log_table(spark, sf_dir), "click", "user-7", 5).select("event_id", "ts")


@_q("select event_id, ts from (select * from events where event_type = 'click' and user_id = 7 and ts between timestamp '2024-01-05' and timestamp '2024-01-12 12:00:00' order by ts, event_id limit 5)")
def oldest_stream_events(spark, sf_dir):
    return logs.read_stream_events(log_table(spark, sf_dir), "click", "user-7", 5, True, WITHIN).select("event_id", "ts")


def _catalog(spark, sf_dir):
    """Log groups with the days that they are kept; clicks for ever."""
    name = F.col("event_type")
    return table(spark, sf_dir, "events").select(name.alias("name")).distinct().withColumn("retention_days", F.when(F.col("name") != "click", 10 * F.length("name")))


@_q("select distinct event_type as name, 10 * len(event_type) as retention_days from events where event_type <> 'click'")
def checked_groups(spark, sf_dir):
    asked = table(spark, sf_dir, "events").select(F.col("event_type").alias("name")).where("name <> 'click'").unionByName(table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")))
    return logs.check_groups(asked, _catalog(spark, sf_dir))[0]


@_q("select distinct n_name as name from nation")
def absent_groups(spark, sf_dir):
    asked = table(spark, sf_dir, "events").select(F.col("event_type").alias("name")).unionByName(table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")))
    return logs.check_groups(asked, _catalog(spark, sf_dir))[1].select("name")


@_q("select distinct event_type as name from events where event_type = 'click'")
def never_expiring_groups(spark, sf_dir):
    return logs.never_expire_report(_catalog(spark, sf_dir)).select("name")


def _url_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(F.col("url").alias("name")).distinct()


@_q("select distinct url as name from pages where (contains(lower(url), 'sns') or contains(lower(url), 'ses') or contains(lower(url), 'ref')) and starts_with(url, 'http:') and regexp_matches(url, '\\.example\\.(com|net)/')")
def discovered_groups(spark, sf_dir):
    return logs.discover_log_groups(_url_names(spark, sf_dir), "REF", "SNS-SES", "http:", None, ("*.example.com/*", "*.example.net/*")).select("name")


@_q("""select event_id, q.query from events join (select distinct user_id, concat('q', cast(user_id as varchar)) as query from events where user_id < 10) q using (user_id)
  where event_type = 'purchase' and ts between timestamp '2024-01-05' and timestamp '2024-01-12 12:00:00'""")
def asked_metric_points(spark, sf_dir):
    users = table(spark, sf_dir, "events").where("user_id < 10").select(F.col("user_id").cast("string").alias("user")).distinct()
    wanted = users.select(F.concat(F.lit("q"), "user").alias("query"), F.lit("shop").alias("namespace"), F.lit("purchase").alias("metric_name"), F.create_map(F.lit("user"), F.col("user")).alias("dimensions"))
    return metrics.read_metric_points(point_table(spark, sf_dir), wanted, WITHIN).select("event_id", "query")


@_q("select event_type as metric_name, count(*) as points from events where user_id = 3 group by 1")
def dimension_metrics(spark, sf_dir):
    return metrics.list_metrics(point_table(spark, sf_dir), dimensions={"user": "3"}, limit=None).select("metric_name", "points")


@_q("select event_type as metric_name, max_by(ts, struct_pack(v := value, t := -epoch_us(ts))) as max_at from events where value is not null group by 1")
def metric_maxima(spark, sf_dir):
    return metrics.metric_summary(point_table(spark, sf_dir), exact=True).select("metric_name", "max_at")


@_q("""select name, type from (select concat('alarm-', cast(user_id as varchar)) as name, 'metric' as type, arg_max(coalesce(value, 0), struct_pack(t := ts, e := event_id)) as v from events group by user_id) where v > 100 and starts_with(name, 'alarm-1')
  union all select concat('alarm-1', n_name), 'composite' from nation where n_nationkey % 2 = 0""")
def read_alarms(spark, sf_dir):
    last = _states(spark, sf_dir).groupBy(F.concat(F.lit("alarm-"), "alarm_name").alias("name")).agg(F.max_by("state", F.struct("ts", "event_id")).alias("state")).withColumn("ok_actions", F.lit("mail"))
    both = table(spark, sf_dir, "nation").select(F.concat(F.lit("alarm-1"), "n_name").alias("name"), F.when(F.col("n_nationkey") % 2 == 0, "ALARM").otherwise("OK").alias("state"))
    return alarms.read_alarms(last, both, "ALARM", "alarm-1").select("name", "type")


@_q("select event_id, case when value > 100 then 'ALARM' else 'OK' end as new_state from events where user_id = 5 and ts between timestamp '2024-01-05' and timestamp '2024-01-12 12:00:00'")
def alarm_history(spark, sf_dir):
    return alarms.read_alarm_history(_states(spark, sf_dir), "5", WITHIN, "StateUpdate").select("event_id", "new_state")


@_q("""select cast(user_id as varchar) as alarm_name, event_id, state from (select *, lag(state) over (partition by user_id order by ts, event_id) as last from (select *, case when value > 100 then 'ALARM' else 'OK' end as state from events))
  where last is null or last <> state""")
def alarm_changes(spark, sf_dir):
    return alarms.state_changes(_states(spark, sf_dir)).select("alarm_name", "event_id", "state")


@_q("""select event_id, event_id % 3 as kind, case event_id % 3 when 0 then date_trunc('second', ts) - interval 2 hour end as ts_utc, case event_id % 3 when 1 then date_trunc('second', ts) end as ts_local,
  case event_id % 3 when 2 then cast(epoch(date_trunc('second', ts)) as bigint) % 86400 * 1.0::double end as time_of_day, cast(event_id % 3 as int) as tier from events""")
def time_tiers(spark, sf_dir):
    """Times with a known offset, without one, and times of day: three tiers that are never compared."""
    e, ts = F.col("event_id"), F.date_trunc("second", "ts")
    line = F.when(e % 3 == 0, F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00 started"))).when(e % 3 == 1, F.concat(F.date_format(ts, "yyyy/MM/dd HH:mm:ss"), F.lit(" started"))).otherwise(F.concat(F.lit("["), F.date_format(ts, "HH:mm:ss"), F.lit("] started")))
    p = table(spark, sf_dir, "events").select("event_id", (e % 3).alias("kind"), timestamps.parse_log_timestamp(line).alias("p"))
    return p.select("event_id", "kind", F.col("p.ts_utc").cast("timestamp_ntz").alias("ts_utc"), "p.ts_local", "p.time_of_day", "p.tier")


@_q("""select row_number() over (order by tier, t, seq) as place, seq, tier from (
  select event_id as seq, 1 as tier, epoch_us(date_trunc('second', ts)) as t from events where event_type = 'error'
  union all select event_id, 0, epoch_us(date_trunc('second', ts)) from events where event_type = 'signup'
  union all select event_id, 3, 0 from events where event_type = 'view' and event_id % 2 = 1)""")
def ordered_timeline(spark, sf_dir):
    """Log lines, cluster events with times, and cluster events without, in one order."""
    d = log_table(spark, sf_dir)
    text = lambda pattern: F.date_format(F.date_trunc("second", "ts"), pattern)
    lines = d.where("log_group = 'error'").select(F.col("event_id").alias("seq"), text("yyyy-MM-dd HH:mm:ss").alias("raw"))
    none = F.lit(None).cast("string")
    cluster = d.where("log_group = 'signup' or log_group = 'view' and event_id % 2 = 1").select(F.col("event_id").alias("seq"), F.when(F.col("log_group") == "signup", text("yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("event_time"), none.alias("first_timestamp"), none.alias("last_timestamp"))
    return timeline.number_timeline(timeline.timeline_union(lines, cluster)).select("place", "seq", "tier")


@_q("select event_id, case event_id % 20 when 17 then 'INFO all good' else 'INFO order 123456 placed password=[REDACTED]' end as shown, 7 as n from events where event_id % 20 in (17, 18)")
def nested_messages(spark, sf_dir):
    """Strings inside structs, arrays and maps are sanitised; all else stays."""
    d = log_table(spark, sf_dir).where("event_id % 20 in (17, 18)").withColumn("message", F.regexp_extract("message", "INFO.*", 0))
    d = d.select("event_id", F.struct(F.array(F.create_map(F.lit("k"), F.col("message"))).alias("inner"), F.lit(7).alias("n")).alias("value"))
    clean = d.select("event_id", redact.sanitize_nested(F.col("value"), d.schema["value"].dataType).alias("v"))
    return clean.select("event_id", F.col("v.inner")[0]["k"].alias("shown"), "v.n")


@_q("select c_custkey as k, '[REDACTED]' as password, c_name as home, '<redacted>' as secret, '[REDACTED]' as env, 'img' as image from customer")
def hidden_values(spark, sf_dir):
    """Map values by the name of their key, environments of containers, and data of secrets."""
    name = F.col("c_name")
    d = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("k"), redact.redact_by_name(F.create_map(F.lit("db_password"), name, F.lit("home"), name)).alias("named"), redact.redact_secret_data(F.create_map(F.lit("x"), name)).alias("data"),
        redact.redact_env(F.array(F.struct(F.lit("img").alias("image"), name.alias("env"), name.alias("envFrom")))).alias("boxes"),
    )
    return d.select("k", F.col("named")["db_password"].alias("password"), F.col("named")["home"].alias("home"), F.col("data")["x"].alias("secret"), F.col("boxes")[0]["env"].alias("env"), F.col("boxes")[0]["image"].alias("image"))


@_q("select doc_id, case when n_chars * 37 < 1024 then printf('%d B', n_chars * 37) when n_chars * 37 < 1048576 then printf('%.2f KiB', n_chars * 37 / 1024.0::double) else printf('%.2f MiB', n_chars * 37 / 1048576.0::double) end as size from documents where n_chars * 37 < 1073741824")
def readable_sizes(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("n_chars * 37 < 1073741824").select("doc_id", classify.fmt_bytes(F.col("n_chars") * 37).alias("size"))


@_q("select p.page_id as id, row_number() over (order by page_id % 7 desc, page_id desc) as place from pages p")
def listed_urls(spark, sf_dir):
    d = _url_table(spark, sf_dir).withColumn("created_at", F.col("id") % 7)
    return numbered(d, ("created_at", "id"), descending=True).select("id", "place")


@_q("select event_id from events where event_type = 'click' and event_id % 5000 not in (select page_id from pages)")
def unknown_codes(spark, sf_dir):
    clicks = table(spark, sf_dir, "events").where("event_type = 'click'").select("event_id", F.concat(F.lit("c"), (F.col("event_id") % 5000).cast("string")).alias("short_code"))
    return urls.resolve_short_codes(clicks, _url_table(spark, sf_dir))[1].select("event_id")


def _hosts(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.concat(F.lit("host-"), (F.col("user_id") % 20).cast("string")).alias("host"), F.col("event_id").alias("pid"), F.col("event_type").alias("name"), F.col("value").alias("memory_percent"), "ts", F.col("event_id"))


@_q("select host, pid, rank from (select concat('host-', cast(user_id % 20 as varchar)) as host, event_id as pid, row_number() over (partition by user_id % 20 order by coalesce(value, 0) desc, event_id) as rank from events) where rank <= 5")
def top_processes(spark, sf_dir):
    return hosts.top_processes(_hosts(spark, sf_dir), limit=5).select("host", "pid", "rank")


@_q("select event_id as pid from events where contains(event_type, 'ig')")
def found_processes(spark, sf_dir):
    return hosts.find_process(_hosts(spark, sf_dir), "IG").select("pid")


@_q("select s_name as name from supplier where s_suppkey % 3 = 0 and contains(s_name, '7')")
def stopped_services(spark, sf_dir):
    d = table(spark, sf_dir, "supplier").select(F.lit("h").alias("host"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 3 == 0, "Stopped").otherwise("Running").alias("status"))
    return hosts.list_services(d, "stopped", "7").select("name")


@_q("""select host, record_id, level, rank from (select concat('host-', cast(user_id % 20 as varchar)) as host, event_id as record_id, case event_id % 5 when 1 then 'Error' when 2 then 'Warning' when 4 then 'Information' else cast(event_id % 5 as varchar) end as level,
  row_number() over (partition by user_id % 20 order by ts desc, event_id desc) as rank from events where event_id % 2 = 0) where rank <= 4""")
def host_events(spark, sf_dir):
    e = F.col("event_id")
    d = _hosts(spark, sf_dir).select("host", "ts", e.alias("record_id"), (e % 5).alias("event_type"), F.when(e % 2 == 0, "System").otherwise("Application").alias("log"), F.col("name").alias("message"))
    return hosts.recent_host_events(d, "System", 4).select("host", "record_id", "level", "rank")


@_q("select p_partkey as disk, p_size * 10 - p_partkey % 10 as free, round(case when p_size > 0 then 100.0::double * (p_partkey % 10) / (p_size * 10) else 0 end, 9) as percent from part")
def disk_usage(spark, sf_dir):
    d = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("disk"), (F.col("p_size") * 10).alias("total"), (F.col("p_partkey") % 10).alias("used"))
    return hosts.disk_usage(d).select("disk", "free", F.round("percent", 9).alias("percent"))


@_q("""select s_suppkey as host, concat_ws(',', case when s_suppkey % 101 >= 90 then 'High cpu usage' end, case when s_suppkey % 97 >= 90 then 'High memory usage' end, case when s_suppkey % 50 >= 45 then 'High disk usage' end) as warnings,
  case when s_suppkey % 101 >= 90 or s_suppkey % 97 >= 90 or s_suppkey % 50 >= 45 then 'Warning' else 'Healthy' end as status from supplier""")
def host_health(spark, sf_dir):
    k = F.col("s_suppkey")
    d = table(spark, sf_dir, "supplier").select(k.alias("host"), (k % 101).cast("double").alias("cpu_percent"), (k % 97).cast("double").alias("memory_percent"), F.lit(50).alias("disk_total"), (k % 50).alias("disk_used"))
    return hosts.health_flags(d).select("host", F.array_join("warnings", ",").alias("warnings"), "status")


@_q("select event_id, case when event_id % 3 = 0 then null else concat('v', cast(user_id as varchar)) end as user, event_type as kind from events")
def query_cells(spark, sf_dir):
    """Result rows that come as lists of field and value."""
    cell = lambda f, v: F.struct(F.lit(f).alias("field"), v.alias("value"))
    user = F.concat(F.lit("v"), F.col("user_id").cast("string"))
    cells = F.array(cell("@ptr", F.lit("p")), cell("kind", F.lit("old")), cell("kind", F.col("event_type")), cell("", F.lit("x")))
    d = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, cells).otherwise(F.concat(cells, F.array(cell("user", user)))).alias("cells"))
    return snapshots.cells_to_rows(d, ("user", "kind"))


@_q("select case when count(*) = 0 then 'empty' else 'partial' end as status, count(*) as rows, 'cut at 10' as warnings from events where event_type = 'error'")
def result_coverage(spark, sf_dir):
    facts = log_table(spark, sf_dir).where("log_group = 'error'")
    return results.coverage(facts, warnings=("cut at 10", "cut at 10")).withColumn("warnings", F.array_join("warnings", ","))
