"""Ordered ranges, lines of split files, listings, sketches, the registry and keyed streams against plain forms."""

import json
import random
from collections import Counter
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from opsframe.functions import classify, match
from opsframe.operators import alarms, findings, logs, metrics, ordered, pods, timeline, urls
from opsframe.sources import files, lines, snapshots
from opsframe.streaming import state_change_stream


# places and running sums


@pytest.mark.parametrize("descending", [False, True])
def test_places_over_many_ranges(spark, descending):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), rng.choice([None, 1, 5, 5, 5, 5, rng.randrange(100)]), i, i * 10) for i in range(700)]
    rng.shuffle(rows)
    d = spark.createDataFrame(rows, "k string, x int, seq int, place_ int").repartition(5)
    got = {r.seq: r.place for r in ordered.numbered(d, ("x", "seq"), range_rows=40, descending=descending).collect()}
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2]), reverse=descending)
    assert got == {r[2]: i for i, r in enumerate(order, 1)}
    by_key = ordered.running_sums(d, ("x", "seq"), F.col("place_"), "upto", ("k",), 50, descending)
    sums, want = Counter(), {}
    for k, _, seq, v in order:
        sums[k] += v
        want[seq] = sums[k]
    assert {r.seq: r.upto for r in by_key.collect()} == want
    assert by_key.columns == [*d.columns, "upto"]


def test_ranges_stay_small_on_a_hot_value(spark):
    d = spark.range(0, 5000, 1, 4).select(F.when(F.col("id") % 10 > 0, 7).otherwise(F.col("id")).alias("x"), "id")
    sizes = [r["count"] for r in ordered.with_range(d, ("x", "id"), 250).groupBy("_range").count().collect()]
    assert len(sizes) >= 15 and max(sizes) < 600
    assert ordered.numbered(d.limit(0), ("x",)).count() == 0


def test_budget_runs_over_ranges(spark):
    d = spark.createDataFrame([(i, 1 + i % 7) for i in range(300)], "i int, size int").repartition(3)
    total, want = 0, set()
    for i in range(300):
        total += 1 + i % 7
        want |= {i} if total <= 500 else set()
    assert {r.i for r in logs.size_budget(d, F.col("size"), 500, ["i"], range_rows=30).collect()} == want


# chains


def events_with_a_busy_hour(rng, n=1500):
    at = [rng.randrange(0, 30 * 86400) for _ in range(n // 10)] + [86400 * 3 + rng.randrange(3600) for _ in range(n - n // 10)]
    return [(rng.choice([0, 0, 0, 1, 2, 3]), t, i, f"c{i % 3}", f"pod-{i % 400}") for i, t in enumerate(at)]


def timeline_of(spark, rows):
    d = spark.createDataFrame(rows, "tier int, t long, seq long, component string, pod string")
    at = F.timestamp_seconds("t")
    return d.select(
        "tier", F.when(F.col("tier") == 0, at).alias("ts_utc"), F.when(F.col("tier") == 1, at).alias("ts_local"), F.when(F.col("tier") == 2, F.col("t").cast("double")).alias("time_of_day"), "seq",
        F.col("t").cast("string").alias("timestamp"), "component", "pod", F.lit("r").alias("release"), F.lit("c").alias("category"), F.lit("low").alias("severity"), F.lit("log").alias("source"), F.lit("s").alias("summary"),
    ).repartition(6)


@pytest.mark.parametrize("range_rows", [60, 10**6])
def test_chains_of_a_busy_hour_equal_a_loop(spark, range_rows):
    rows = events_with_a_busy_hour(random.Random(4))
    islands, last, number = {}, {}, {}
    for tier, t, seq, *_ in sorted(r for r in rows if r[0] < 3):
        number[tier] = number.get(tier, 0) + (tier in last and t - last[tier] > 5)
        last[tier] = t
        islands[seq] = (tier, number[tier])
    found, aside = timeline.correlate_timeline(timeline_of(spark, rows), 5, range_rows=range_rows)
    assert {r.seq: (r.tier, r.island) for r in found.collect()} == islands
    assert aside.count() == sum(r[0] == 3 for r in rows)
    groups = timeline.roll_up_groups(found, max_observations=4, max_values=10, range_rows=range_rows).collect()
    by_chain = {}
    for tier, t, seq, c, pod in rows:
        if tier < 3:
            by_chain.setdefault(islands[seq], []).append((t, seq, c, pod))
    assert len(groups) == len(by_chain)
    for g in groups:
        own = sorted(by_chain[g.tier, g.island])
        distinct = sorted({x[3] for x in own})
        assert (g.pods, g.n_pods, g.n_components, g.evidence_count) == (distinct[:10], len(distinct), len({x[2] for x in own}), len(own))
        assert [o.timestamp for o in g.observations] == [str(x[0]) for x in own[:4]]


# lines of files


@pytest.fixture()
def small_splits(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    own = {k: spark.conf.get(k) for k in keys}
    spark.conf.set(keys[0], "600")
    spark.conf.set(keys[1], "0")
    yield
    for k, v in own.items():
        spark.conf.set(k, v)


def test_lines_of_a_log_of_many_splits(spark, tmp_path, small_splits):
    folder = tmp_path / "shop" / "web-1"
    folder.mkdir(parents=True)
    begin = datetime(2024, 1, 1)
    text = [f"{begin + timedelta(minutes=i)} token=abc{i}" if i % 3 else f"  at frame {i}" for i in range(300)]
    (folder / "current.log").write_text("\r\n".join(text) + "\n")
    (folder / "previous.log").write_text("one\n\ntwo")
    (tmp_path / "shop" / "empty").mkdir()
    (tmp_path / "shop" / "empty" / "current.log").write_text("")
    numbered = lines.numbered_lines(spark, str(tmp_path))
    got = pods.read_pod_logs(spark, str(tmp_path))
    assert {(r.log_source, r.line_no, r.line) for r in got.collect()} == {("current", i, t) for i, t in enumerate(text)} | {("previous", 0, "one"), ("previous", 1, ""), ("previous", 2, "two")}
    assert spark.read.option("recursiveFileLookup", True).text(str(tmp_path)).rdd.getNumPartitions() > 5
    assert {r.n_lines for r in numbered.collect()} == {300, 3}
    cut = pods.read_pod_logs(spark, str(tmp_path), since=begin + timedelta(minutes=99, seconds=30), log_source="current", redactor=lambda c: F.regexp_replace(c, "token=\\S+", "<hidden>"))
    rows = sorted((r.line_no, r.line) for r in cut.collect())
    assert rows[0] == (100, f"{begin + timedelta(minutes=100)} <hidden>") and len(rows) == 200 and rows[2] == (102, text[102])
    tail = pods.read_pod_logs(spark, str(tmp_path), tail=2)
    assert sorted((r.log_source, r.line_no) for r in tail.collect()) == [("current", 298), ("current", 299), ("previous", 1), ("previous", 2)]


def test_grep_splits_large_files_and_reports_what_it_skips(spark, tmp_path, small_splits):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "big.log").write_text("\n".join(f"line {i} " + ("NEEDLE" if i % 50 == 7 else "") for i in range(400)))
    (tmp_path / "b.txt").write_text("needle\n  a Needle \n")
    (tmp_path / "c.bin").write_text("needle")
    found, skipped = files.grep_files(spark, str(tmp_path), "needle", (".log", ".TXT"), limit=None)
    assert [(r.path.rsplit("/", 1)[1], r.line_no, r.line) for r in found.collect()] == [("big.log", i + 1, f"line {i} NEEDLE") for i in range(7, 400, 50)] + [("b.txt", 1, "needle"), ("b.txt", 2, "a Needle")]
    assert [(r.path.rsplit("/", 1)[1], r.reason) for r in skipped.collect()] == [("c.bin", "extension")]
    found, skipped = files.grep_files(spark, str(tmp_path), "needle", (".log", ".txt"), limit=1, max_bytes=100)
    assert [r.line_no for r in found.collect()] == [1] and {r.reason for r in skipped.collect()} == {"extension", "size"}


@pytest.mark.parametrize("at_once", [1, 3, 200])
def test_listing_does_not_enter_excluded_folders(spark, tmp_path, at_once):
    for name in ("src/deep/deeper", ".git/objects/aa", "src/Node_Modules/x/y", "docs", ".hidden"):
        (tmp_path / name).mkdir(parents=True)
    for name in ("src/a.py", "src/deep/deeper/b.py", ".git/objects/aa/blob", "src/Node_Modules/x/y/z.js", "docs/.c", ".hidden/d", "e"):
        (tmp_path / name).write_text(name)
    entries = files.tree_entries(spark, str(tmp_path), folders_at_once=at_once)
    listed = {r.path[len(str(tmp_path)) :] for r in entries.where("listed").collect()}
    assert listed == {"", "/src", "/src/deep", "/src/deep/deeper", "/docs", "/.hidden"}  # six folders were listed, none of the excluded
    assert entries.where("is_folder").count() == 6
    inventory = files.file_inventory(spark, str(tmp_path))
    assert {(r.name, r.length) for r in inventory.collect()} == {("a.py", 8), ("b.py", 20), (".c", 7), ("d", 9), ("e", 1)}
    assert [(r.name, r.kind) for r in files.list_folder(entries, f"{tmp_path}/src").collect()] == [("deep", "folder"), ("a.py", "file")]
    asked = spark.createDataFrame([(f"{tmp_path}/src/a.py",), (f"{tmp_path}/docs",), ("/nowhere",)], "path string")
    assert sorted((r.name, r.kind, r.extension) for r in files.file_metadata(entries, asked).collect()) == [("a.py", "file", ".py"), ("docs", "folder", None)]
    assert files.tree_entries(spark, f"{tmp_path}/none").select("error").first()[0]
    assert {r.name for r in files.file_inventory(spark, str(tmp_path), glob="*.PY").collect()} == {"a.py", "b.py"}


# listings of a cluster


def test_listings_of_any_kind(spark, tmp_path):
    pod = {"kind": "Pod", "metadata": {"name": "p", "namespace": "shop"}, "status": {"phase": "Running", "restarts": 3}}
    docs = [
        {"kind": "PodList", "items": [pod, {"metadata": {"name": "q", "namespace": "other"}, "status": {"phase": 5}}]},
        {"kind": "List", "items": [{"kind": "Secret", "metadata": {"name": "s", "namespace": "shop"}, "data": {"b": "eA==", "a": "eQ=="}}, {"kind": "Node", "metadata": {"name": "n"}}]},
        {"kind": "RoleList", "items": []}, {"no": "items"},
    ]
    for i, d in enumerate(docs):
        (tmp_path / f"{i}.json").write_text(json.dumps(d, indent=1))
    fields = {"phase": ("$.status.phase", "string"), "restarts": ("$.status.restarts", "int"), "data": ("$.data", "string")}
    got = snapshots.read_k8s_list(spark, str(tmp_path), fields=fields)
    rows = {r.name: (r.kind, r.namespace, r.phase, r.restarts, r.data, r.secret_keys) for r in got.where("kind is not null").collect()}
    assert rows == {"p": ("Pod", "shop", "Running", 3, None, None), "q": ("Pod", "other", "5", None, None, None), "s": ("Secret", "shop", None, None, None, ["a", "b"]), "n": ("Node", None, None, None, None, None)}
    assert {r.name for r in snapshots.read_k8s_list(spark, str(tmp_path), namespace="shop").collect()} == {"p", "s", "n"}
    assert [r.name for r in snapshots.read_k8s_list(spark, str(tmp_path), "Pod", "all").orderBy("name").collect()] == ["p", "q"]
    assert got.where("kind = 'Secret'").select("item").first()[0] is None and len(snapshots.KINDS) == 27
    with pytest.raises(ValueError):
        snapshots.read_k8s_list(spark, str(tmp_path), "Pods")


# sketches


def test_merged_sketches_keep_their_rank_error(spark):
    rng = random.Random(9)
    rows = [(f"m{i % 2}", datetime(2024, 1, 1, tzinfo=timezone.utc) + timedelta(minutes=i), rng.lognormvariate(0, 2) if i % 3 else 1.5) for i in range(20_000)]
    d = spark.createDataFrame(rows, "metric_name string, ts timestamp, value double")
    bins = metrics.sketch_bins(d, 3600, k=1000)
    first, last = (int(datetime(2024, 1, day, tzinfo=timezone.utc).timestamp()) for day in (3, 9))
    for r in metrics.merge_bins(bins, first=first, last=last).collect():
        own = sorted(v for m, t, v in rows if m == r.metric_name and first <= t.timestamp() < last + 3600)
        assert (r.n, r.min, r.max, round(r.avg, 6)) == (len(own), own[0], own[-1], round(sum(own) / len(own), 6))
        for name, level in metrics.LEVELS.items():
            low, high = sum(v < r[name] for v in own) / len(own), sum(v <= r[name] for v in own) / len(own)
            assert low - 0.01 <= level <= high + 0.01
    days = metrics.merge_bins(bins, period=86400)
    assert days.groupBy("metric_name").agg(F.sum("n")).collect() == [("m0", 10_000), ("m1", 10_000)] or days.agg(F.sum("n")).first()[0] == 20_000
    exact, near = ({r.metric_name: r for r in metrics.metric_summary(d, exact=e).collect()} for e in (True, False))
    assert all(abs(near[m].p50 - exact[m].p50) < 0.05 and near[m].latest == exact[m].latest for m in exact)


# one pass for many terms


def test_terms_in_one_pass_equal_single_searches(spark):
    rng = random.Random(7)
    for terms in (logs.CATEGORIES, classify.COMPONENT_HINTS, {"a": ("ab", "abc", "b"), "z": ("bc", "abcd")}):
        words = [t for own in terms.values() for t in own]
        texts = ["".join(rng.choice([*words, "x", " "]) for _ in range(rng.randrange(6))) for _ in range(200)] + ["sesns", "abcd", None]
        d = spark.createDataFrame([(t,) for t in texts], "t string").select("t", match.term_keys(F.col("t"), terms).alias("keys"))
        assert all(r["keys"] == [k for k, own in terms.items() if any(x in (r.t or "") for x in own)] for r in d.collect())


# the registry of short URLs


def registered(spark, path):
    return {r.original_url: r.short_code for r in urls.read_registry(spark, path).collect()}


def test_registration_is_idempotent(spark, tmp_path):
    path = str(tmp_path)
    new = lambda *names: spark.createDataFrame([(f"http://{n}.example",) for n in names], "original_url string")
    first = urls.register_urls(new("a", "b", "b"), path, "one")
    assert first.count() == 2
    again = urls.register_urls(new("a", "c"), path, "one")  # the same batch: what was committed
    assert {r.original_url for r in again.collect()} == {"http://a.example", "http://b.example"}
    before = registered(spark, path)
    urls.register_urls(new("b", "c"), path, "two")
    assert registered(spark, path).items() >= before.items() and len(registered(spark, path)) == 3
    assert urls.read_registry(spark, f"{path}/none").count() == 0


def test_two_writers_never_share_a_code(spark, tmp_path, monkeypatch):
    path, real, raced = str(tmp_path), urls._commit, []
    mine = spark.createDataFrame([(f"http://m{i}.example",) for i in range(40)], "original_url string")
    theirs = spark.createDataFrame([(f"http://t{i}.example",) for i in range(40)] + [("http://m1.example",)], "original_url string")
    monkeypatch.setattr(urls, "short_code", lambda url, salt, length=6: F.pmod(F.xxhash64(url, salt), F.lit(150)).cast("string"))  # so few codes that writers clash

    def commit(s, p, number, text):
        if text.startswith("mine") and not raced:  # the other writer commits between our claim and our commit
            raced.append(number)
            urls.register_urls(theirs, path, "theirs")
        return real(s, p, number, text)

    monkeypatch.setattr(urls, "_commit", commit)
    urls.register_urls(mine, path, "mine")
    rows = urls.read_registry(spark, path).collect()
    assert raced == [0] and len(rows) == 80 == len({r.short_code for r in rows}) == len({r.original_url for r in rows})


def test_an_unfinished_commit_stops_others(spark, tmp_path):
    (tmp_path / "_commits").mkdir()
    (tmp_path / "_commits" / "0000000000").write_text("")
    with pytest.raises(RuntimeError):
        urls.register_urls(spark.createDataFrame([("http://a.b",)], "original_url string"), str(tmp_path), "x", tries=2, wait_seconds=0)


# changes of state in a stream


def test_changes_across_micro_batches_equal_the_table(spark, tmp_path):
    rng = random.Random(6)
    begin = datetime(2024, 1, 1)
    rows = [(f"a{i % 3}", begin + timedelta(minutes=i // 2), i, rng.choice(["OK", "ALARM"])) for i in range(240)]
    schema = "alarm_name string, ts timestamp, event_id long, state string"
    late = rows[:]
    for i in range(0, 230, 7):  # some rows come in a later file than newer ones
        late[i], late[i + 9] = late[i + 9], late[i]
    end = [("end", begin + timedelta(days=2), 999, "OK")]
    parts = [late[:80], late[80:160], late[160:], end, [("end", begin + timedelta(days=3), 1000, "OK")]]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/f{k}")
    out = []
    for k in range(len(parts)):  # a file at a time, in order
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/f[0-{k}]")
        q = state_change_stream(stream, "30 minutes").writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/ck")
        q.foreachBatch(lambda b, _: out.extend(b.collect())).start().awaitTermination()
    got = sorted((r.alarm_name, r.event_id, r.state) for r in out if r.alarm_name != "end")
    want = alarms.state_changes(spark.createDataFrame(rows, schema)).collect()
    assert got == sorted((r.alarm_name, r.event_id, r.state) for r in want) and len(got) < 240


# findings in one reading


def test_findings_of_a_hot_category(spark):
    rows = [("p", i, f"Exception number {chr(97 + i % 26)}{chr(97 + i // 26 % 26)} failed") for i in range(600)] + [("q", 1, "request timed out"), ("q", 2, "request timed out")]
    got = {(r.pod, r.category): r for r in findings.classify_logs(spark.createDataFrame(rows, "pod string, line_no int, line string"), max_samples=5).collect()}
    hot = got["p", next(c for p, c in got if p == "p")]
    assert (hot.occurrences, hot.distinct_messages, hot.first_line, [s.first_line for s in hot.samples]) == (600, 600, 0, [0, 1, 2, 3, 4])
    assert sum(r.occurrences for k, r in got.items() if k[0] == "q") == 2


def test_sizes_round_exact_halves_to_even(spark):
    d = spark.createDataFrame([(42_624,), (23_680,), (1023,), (1024,), (1 << 40,)], "n long").select("n", classify.fmt_bytes(F.col("n")).alias("s"))
    assert {r.n: r.s for r in d.collect()} == {42_624: "41.62 KiB", 23_680: "23.12 KiB", 1023: "1023 B", 1024: "1.00 KiB", 1 << 40: "1.00 TiB"}
