import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from opsframe import streaming
from opsframe.functions.match import Match
from opsframe.operators import alarms, findings, hosts, logs, metrics, pods, series, timeline, urls
from opsframe.plans.diagnose import diagnose
from opsframe.plans.knowledge import knowledge_table
from opsframe.sources import files, results, snapshots

T0 = datetime(2026, 9, 5, 12)


def test_series_stats_observed_case(spark):
    start = 1788800100 - 1788800100 % 60
    points = spark.createDataFrame([(start + 60 * k, 500) for k in (2, 5, 7, 9)], "bin long, matches long")
    r = series.series_stats(points, start, start + 900, 60).first()
    assert (r.total, r.expected_bins, r.returned_bins, r.empty_bins, r.peak, r.peak_bin, r.median) == (2000, 16, 4, 12, 500, start + 120, 0.0)


def test_metric_downsampling(spark):
    p = spark.createDataFrame([("m", T0 + timedelta(minutes=k), float(k)) for k in range(60)], "metric_name string, ts timestamp, value double")
    assert metrics.downsample(p, 200).count() == 60
    assert [r.value for r in metrics.downsample(p, 20).orderBy("ts").collect()] == [3.0 * k for k in range(20)]


def test_alarm_history(spark):
    rows = [("a", T0 + timedelta(minutes=k), "StateUpdate", '{"newState":{"stateValue":"ALARM"}}') for k in range(6)] + [("a", T0, "StateUpdate", "{not json"), ("b", T0, "Action", '{"newState":{"stateValue":"ALARM"}}')]
    h = alarms.read_alarm_history(spark.createDataFrame(rows, "alarm_name string, ts timestamp, type string, history_data string"))
    got = {r.alarm_name: (r.to_alarm, r.flapping) for r in alarms.alarm_transitions(h).collect()}
    assert got == {"a": (6, True), "b": (0, False)}


def timeline_rows(spark, seconds):
    rows = [(1, None, T0 + timedelta(seconds=s), None, i, str(s), "c", "p", "r", "k", "high", "log", "s") for i, s in enumerate(seconds)]
    return spark.createDataFrame(rows, "tier int, ts_utc timestamp, ts_local timestamp_ntz, time_of_day double, seq long, timestamp string, component string, pod string, release string, category string, severity string, source string, summary string")


def test_chaining_compares_with_the_row_before(spark):
    rows, aside = timeline.correlate_timeline(timeline_rows(spark, [0, 50, 100, 150, 300]), 60)
    assert [r.island for r in rows.orderBy("seq").collect()] == [0, 0, 0, 0, 1] and aside.count() == 0
    g = timeline.roll_up_groups(rows).orderBy("island").collect()
    assert g[0].evidence_count == 4 and g[0].duration_seconds == 150 and g[0].group_id == timeline.roll_up_groups(rows).orderBy("island").first().group_id


@pytest.mark.parametrize("range_rows", [20, 10**6])
def test_chaining_equals_a_loop(spark, range_rows):
    rng = random.Random(range_rows)
    seconds = sorted(rng.randrange(40_000) for _ in range(300))
    want, n = [], 0
    for i, s in enumerate(seconds):
        n += i > 0 and s - seconds[i - 1] > 120
        want.append(n)
    rows, _ = timeline.correlate_timeline(timeline_rows(spark, seconds), 120, range_rows=range_rows)
    assert [r.island for r in rows.orderBy("seq").collect()] == want


def test_event_times_are_kept_apart(spark):
    e = spark.createDataFrame([(1, "2026-09-05T10:00:00Z", None, "2026-09-05T11:00:00Z"), (2, None, "", None)], "seq long, event_time string, first_timestamp string, last_timestamp string")
    r = timeline.event_rows(e).orderBy("seq", "timestamp_source").collect()
    assert [(x.seq, x.timestamp_source) for x in r] == [(1, "eventTime"), (1, "event_lastTimestamp"), (2, None)]


PODS8 = ["ts-1 commerce Running rel grp 0,2 <none> ts-app", "ts-2 commerce Running rel grp 5 CrashLoopBackOff ts-app", "ng-1 nginx Pending <none> <none> <none> <none> dev-nginx-nginx-ingress", "short row"]


def pod_matches(spark):
    p = snapshots.parse_pods_lenient(spark.createDataFrame([(x,) for x in PODS8], "value string"))
    return pods.match_pods(p, pods.component_table(spark), "commerce")


def test_pods_components_and_health(spark):
    m = pod_matches(spark)
    assert sorted((r.leaf, r.pod, r.restart_count) for r in m.collect()) == [("nginx", "ng-1", 0), ("ts-app", "ts-1", 2), ("ts-app", "ts-2", 5)]
    h = {r.leaf: (r.health, r.total, r.release_single) for r in pods.component_health(pods.component_table(spark), m).collect()}
    assert h["ts-app"] == ("attention_needed", 2, "rel") and h["wcbd"][0] == "not_deployed" and h["redis"][0] == "no_matching_pods" and h["nginx"][0] == "attention_needed"
    assert "search-app" not in h and "search-app-slave" in h


def test_strict_snapshots_withhold_whole_snapshots(spark):
    good = "a commerce Running 10.0.0.1 n1 x,y i1,i2 true,false 0,3\n"
    s = spark.createDataFrame([("s1", good), ("s2", good + "b commerce Running 10.0.0.1 n1 x i1,i2 true 0"), ("s3", "No resources found"), ("s4", good + "\n" + good)], "snapshot_id string, text string")
    rows, bad = snapshots.parse_pods_strict(s)
    r = rows.collect()
    assert [x.snapshot_id for x in r] == ["s1"] and r[0].ready.ready_count == 1 and r[0].restart_count == 3 and sorted(x.snapshot_id for x in bad.collect()) == ["s2", "s4"]
    rows8, bad8 = snapshots.parse_pods_strict(spark.createDataFrame([("s", PODS8[0])], "snapshot_id string, text string"), 8)
    assert rows8.count() == 1 and bad8.count() == 0


def test_workloads(spark):
    s = spark.createDataFrame([("s1", "w commerce 2 1 <none> 2 c i"), ("s2", "w commerce x 1 1 2 c i")], "snapshot_id string, text string")
    rows, bad = snapshots.parse_workloads(s, "deployment")
    r = rows.first()
    assert (r.desired, r.ready, r.available, r.updated) == (2, 1, None, 2) and bad.count() == 1


def test_cells(spark):
    d = spark.createDataFrame([(1, [("bin(1m)", "x"), ("@ptr", "p"), ("matches", "1"), ("matches", "2")])], "id int, cells array<struct<field:string,value:string>>")
    r = snapshots.cells_to_rows(d, ("bin(1m)", "matches", "none")).first()
    assert r["bin(1m)"] == "x" and r.matches == "2" and r.none is None


def log_lines(spark):
    rows = [("commerce", "ts-1", "current", i, x) for i, x in enumerate(["2026-09-08T10:00:00Z a.FooException: id 12345", "2026-09-08T10:01:00Z a.FooException: id 99999", "ok", "connection refused", "password=abc ERROR"])]
    rows += [("commerce", "ts-1", "previous", 0, "OOMKilled"), ("nginx", "ng-1", "previous", 0, "OOMKilled"), ("nginx", "ng-1", "current", 0, "connection refused")]
    return spark.createDataFrame(rows, "namespace string, pod string, log_source string, line_no long, line string")


def test_component_errors_take_all_whole_lines(spark):
    from opsframe.plans.diagnose import component_errors

    rows = [("nginx", "ng-1", "current", i, "OOMKilled" if i == 0 else "x" * 600 + " connection refused" if i == 1 else "ok") for i in range(1500)]
    lines = spark.createDataFrame(rows, "namespace string, pod string, log_source string, line_no long, line string")
    found = {r.category for r in component_errors(lines, pod_matches(spark)).collect()}
    assert {"oom_killed", "connection_failure"} <= found


def test_findings_and_diagnosis(spark):
    f = {r.category: r for r in findings.classify_logs(log_lines(spark), ("pod",)).where("pod = 'ts-1'").collect()}
    assert f["exception"].occurrences == 2 and f["exception"].distinct_messages == 1 and "abc" not in f["generic_error"].samples[0].sample
    e = {r.category: r for r in findings.log_evidence(findings.classify_logs(log_lines(spark), ("pod",)), ("pod",), None).where("pod = 'ts-1'").collect()}
    assert e["exception"].exception_class == "a.FooException" and e["exception"].first_seen_utc == datetime(2026, 9, 8, 10) and len(e["exception"].stack_fingerprint) == 16
    events = spark.createDataFrame([("Warning", "Back-off CrashLoopBackOff", 3), ("Normal", "ok", 1), ("Warning", "hm", 9)], "type string, message string, count int")
    health, warned, guidance = diagnose(pods.component_table(spark), pod_matches(spark), log_lines(spark), events, knowledge_table(spark))
    h = {r.leaf: r for r in health.collect()}
    assert h["ts-app"].categories == ["connection_failure", "exception", "generic_error", "oom_killed"] and h["nginx"].categories == ["connection_failure"] and h["nginx"].none_running
    assert [r.category for r in warned.collect()] == ["crash_loop", "unclassified"]
    g = {r.category: r for r in guidance.collect()}
    assert g["connection_failure"].components == ["nginx", "ts-app"] and g["crash_loop"].components is None and g["crash_loop"].guidance


def test_codes_are_unique(spark):
    new = spark.createDataFrame([(f"https://x.example/{i}",) for i in range(300)] + [("ftp://no",), ("https://x.example/1",), (None,)], "original_url string")
    existing = spark.createDataFrame([("A",), ("B",)], "short_code string")
    got = urls.assign_unique_codes(new, existing, length=2, rounds=12).collect()
    codes = {r.short_code for r in got}
    assert len(got) == len(codes) == 300 and not codes & {"A", "B"}
    u = spark.createDataFrame([(1, "a", "u", 2), (2, "b", "v", None)], "id int, short_code string, original_url string, clicks long")
    c = spark.createDataFrame([("a",), ("a",), ("z",)], "short_code string")
    assert {r.id: r.clicks for r in urls.click_counts(u, c).collect()} == {1: 4, 2: 0} and urls.resolve_short_codes(c, u)[1].count() == 1


def test_files(spark, tmp_path):
    for name, text in (("a/x.log", "one\nTwo ERROR \n"), ("a/b/y.txt", "error here"), ("node_modules/z.log", "error")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    inv = files.file_inventory(spark, str(tmp_path))
    assert inv.count() == 2 and files.search_files(inv, "*.LOG").count() == 1 and files.find_large_files(inv, 11).count() == 1
    sizes = {r.folder: (r.n_files, r.n_folders) for r in files.folder_sizes(inv, str(tmp_path)).collect()}
    assert sizes == {"": (2, 2), "a": (2, 1), "a/b": (1, 0)}
    hits = files.grep_files(spark, str(tmp_path / "a"), "ERROR", (".log", ".txt"))[0].collect()
    assert sorted((h.line_no, h.line) for h in hits) == [(1, "error here"), (2, "Two ERROR")]


def test_hosts(spark):
    p = spark.createDataFrame([("h", 1, "a", None), ("h", 2, "Bee", 5.0), ("g", 3, "c", 1.0)], "host string, pid int, name string, memory_percent double")
    assert {(r.host, r.pid) for r in hosts.top_processes(p, limit=1).collect()} == {("h", 2), ("g", 3)} and hosts.find_process(p, "bee").count() == 1
    h = spark.createDataFrame([("h", 95.0, 10.0, 0, 0), ("g", 1.0, 1.0, 5, 10)], "host string, cpu_percent double, memory_percent double, disk_used long, disk_total long")
    assert {r.host: r.status for r in hosts.health_flags(h).collect()} == {"h": "Warning", "g": "Healthy"}
    e = spark.createDataFrame([("h", "System", 1, T0, 1, "m" * 400), ("h", "System", 77, T0, 2, "x")], "host string, log string, event_type int, ts timestamp, record_id int, message string")
    assert sorted(r.level for r in hosts.recent_host_events(e, "System").collect()) == ["77", "Error"]


def test_groups_and_coverage(spark):
    g = spark.createDataFrame([("/aws/eks/a", None), ("shop-redis", 7)], "name string, retention_days int")
    assert logs.discover_log_groups(g, category="eks").count() == 1 and logs.never_expire_report(g).count() == 1
    found, missing = logs.check_groups(spark.createDataFrame([("shop-redis",), ("zz",)], "name string"), g)
    assert found.first().retention_days == 7 and missing.first().name == "zz"
    assert results.coverage(g.limit(0)).first().status == "empty" and results.coverage(g, truncated=True).first().status == "partial"


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(T0 + timedelta(minutes=k), "ERROR x" if k % 2 else "fine") for k in range(60)], "ts timestamp, message string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = streaming.count_stream(stream, Match(preset="errors"), 600).writeStream.outputMode("append").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.matches for r in spark.table("counts").collect()} == {5}
    s = streaming.session_stream(stream.withColumn("k", F.lit(1)), 90, ("k",)).writeStream.outputMode("append").format("memory").queryName("sessions").trigger(availableNow=True).start()
    s.awaitTermination()
    assert spark.table("sessions").count() <= 1
