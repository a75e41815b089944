"""Faults found in round 3: each test fails on the code of that round."""

import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from opsframe import queries as Q
from opsframe.functions import classify, match
from opsframe.llm import quality
from opsframe.operators import findings
from opsframe.sources import files, lines
from tests.conftest import SF

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def mixed(spark, tmp_path_factory):
    """The smallest tables, with events in no order and in several files."""
    path = str(tmp_path_factory.mktemp("mixed"))
    for name in os.listdir(SF):
        if name != "events.parquet":
            os.symlink(f"{SF}/{name}", f"{path}/{name}")
    spark.read.parquet(f"{SF}/events.parquet").repartition(6, F.xxhash64("event_id")).sortWithinPartitions(F.xxhash64("ts")).write.parquet(f"{path}/events.parquet")
    return path


def oracle(sf_dir, name, columns):
    c = duckdb.connect()
    for t in os.listdir(sf_dir):
        c.execute(f"create view {t[:-8]} as select * from '{sf_dir}/{t}{'/*.parquet' if os.path.isdir(f'{sf_dir}/{t}') else ''}'")
    want = c.sql(Q.ORACLE_SQL[name])
    at = [want.columns.index(x) for x in columns]
    return sorted(tuple(str(r[i]) for i in at) for r in want.fetchall())


def same_as_sql(spark, sf_dir, name):
    d = Q.QUERIES[name](spark, sf_dir)
    got = sorted(tuple(str(v) for v in r) for r in d.collect())
    assert got and got == oracle(sf_dir, name, d.columns)


def test_f1_lines_are_numbered_by_time_whatever_the_order_of_events(spark, mixed):
    same_as_sql(spark, mixed, "grepped_lines")


def test_f2_tails_are_the_last_lines_by_time(spark, mixed):
    same_as_sql(spark, mixed, "pod_log_tails")


def test_f2_a_file_for_each_folder_in_order_over_many_batches(spark, tmp_path):
    rows = spark.range(0, 6000, 1, 6).select(F.concat(F.lit("a="), F.col("id") % 3).alias("f"), (6000 - F.col("id")).alias("at"), F.when(F.col("id") % 7 > 0, F.col("id").cast("string")).alias("text"))
    rows_key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = spark.conf.get(rows_key)
    spark.conf.set(rows_key, "70")
    try:
        lines.write_lines(rows, f"{tmp_path}/root", F.when(F.col("f") != "a=2", F.col("f")), ("at",), "text")
    finally:
        spark.conf.set(rows_key, own)
    for place, wanted in (("a=0/", 0), ("a=1/", 1), ("", 2)):
        found = (tmp_path / "root" / f"{place}part-0.txt").read_text().split("\n")
        assert found == [str(i) if i % 7 else "" for i in range(5999, -1, -1) if i % 3 == wanted] + [""]
    assert sorted(os.listdir(tmp_path)) == ["root"]


def test_f2_folders_are_listed_by_few_tasks(spark, tmp_path):
    for i in range(200):
        (tmp_path / f"f{i}" / "g").mkdir(parents=True)
        (tmp_path / f"f{i}" / "g" / "a.txt").write_text(f"{i}\n")
    group, own, at = "f2-listing", spark.conf.get(lines.LISTING), spark.sparkContext
    at.setJobGroup(group, group)
    try:
        d = lines._read(spark, str(tmp_path))
        jobs = at.statusTracker().getJobIdsForGroup(group)
    finally:
        at.setLocalProperty("spark.jobGroup.id", None)
    stages = [at.statusTracker().getStageInfo(s) for j in jobs for s in at.statusTracker().getJobInfo(j).stageIds]
    assert stages and max(s.numTasks for s in stages) <= 4 * at.defaultParallelism
    assert spark.conf.get(lines.LISTING) == own and d.count() == 200


def test_f3_scores_do_not_depend_on_the_ngrams_that_tasks_hold(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    docs = docs.unionByName(spark.createDataFrame([(None, "some odd text 12", None), (None, "some odd text 12", ""), (1, "abc", "xx"), (2, None, "en")], docs.schema))
    rows = lambda held: sorted(map(str, quality.quality_rules(docs, held=held).collect()))
    whole = rows(quality.HELD)
    assert len(whole) == docs.count() and whole == rows(3000) == rows(0)


def test_f4_f6_a_flat_folder_is_handed_out_in_batches(tmp_path, monkeypatch):
    monkeypatch.setattr(files, "AT_ONCE", 10, raising=False)
    for i in range(50):
        (tmp_path / f"f{i}").mkdir()
    sizes = [b.num_rows for b in files._walk(frozenset(), 5)([pa.RecordBatch.from_pydict({"path": [str(tmp_path)]})])]
    assert max(sizes) == 10 and sum(sizes) == 51


def test_f6_a_listing_task_gathers_the_entries_of_many_folders(tmp_path, monkeypatch):
    for i in range(30):
        (tmp_path / f"f{i}" / "g").mkdir(parents=True)
        (tmp_path / f"f{i}" / "g" / "a.txt").write_text(f"{i}\n")
    asked = lambda some: pa.RecordBatch.from_pydict({"path": pa.array([f"{tmp_path}/f{i}" for i in some], pa.string())})
    walked = lambda: [b.num_rows for b in files._walk(frozenset(), 5)([asked(range(20)), asked(range(20, 30)), asked([])])]
    assert walked() == [90]
    monkeypatch.setattr(files, "AT_ONCE", 25)
    assert sum(walked()) == 90 and 3 <= len(walked()) <= 4


def test_f6_a_writing_task_gathers_the_outcome_of_many_files(tmp_path):
    names = [f"f{i // 4}" for i in range(100)]
    batch = lambda a, b: pa.RecordBatch.from_pydict({"folder": names[a:b], "line": [None if i % 5 == 0 else f"{i}" for i in range(a, b)]})
    told = list(lines._write(f"{tmp_path}/root", f"{tmp_path}/aside", "a.txt")([batch(0, 50), batch(50, 100)]))
    assert len(told) == 3 and sorted((r["folder"], r["lines"]) for b in told for r in b.to_pylist()) == sorted((f"f{i}", 4) for i in range(25))
    for i in range(25):
        assert (tmp_path / "root" / f"f{i}" / "a.txt").read_text() == "".join(f"{j if j % 5 else ''}\n" for j in range(4 * i, 4 * i + 4))


def test_f6_folders_are_dealt_over_all_cores_to_be_written(spark, tmp_path):
    group, at = "f6-writing", spark.sparkContext
    at.setJobGroup(group, group)
    try:
        lines.write_lines(spark.range(100).select("id", F.col("id").cast("string").alias("line")), f"{tmp_path}/root", F.concat(F.lit("f"), F.col("id") % 50), ("id",))
    finally:
        at.setLocalProperty("spark.jobGroup.id", None)
    stages = [at.statusTracker().getStageInfo(s) for j in at.statusTracker().getJobIdsForGroup(group) for s in at.statusTracker().getJobInfo(j).stageIds]
    assert max(s.numTasks for s in stages if s) >= 4 * at.defaultParallelism and len(os.listdir(tmp_path / "root")) == 50


def test_f5_a_text_is_computed_once_for_its_components(spark):
    text = F.when(F.rand(3) < 0.4, "redis").when(F.rand(4) < 0.5, "nginx").otherwise("plain")
    found = {tuple(r.c) for r in spark.range(300).select(classify.infer_components(text).alias("c")).collect()}
    assert found == {("redis",), ("nginx",), classify.DEFAULT_COMPONENTS}


def test_f7_a_text_is_computed_once_for_its_keys(spark):
    text = F.when(F.rand(3) < 0.5, "one").otherwise("two")
    found = {tuple(r.k) for r in spark.range(300).select(match.term_keys(text, {"a": ("one",), "b": ("two", "deux"), "c": ("one", "x")}).alias("k")).collect()}
    assert found == {("a", "c"), ("b",)}


@pytest.mark.parametrize("name", ["pod_log_context", "diagnosed_components", "guided_categories", "pod_status", "component_health", "log_coverage", "log_coverage_total"])
def test_f8_to_f15_pods_are_parsed_and_matched_once(spark, name):
    plan = Q.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and "row_number" not in plan


def test_f12_to_f15_lines_of_pods_are_dealt_before_they_are_read(spark):
    from opsframe.fleet_queries import _pods  # after the queries, which import it

    pods = _pods(spark, SF)
    assert pods.select(F.spark_partition_id()).distinct().count() == 4 * spark.sparkContext.defaultParallelism  # one row group
    plan = pods._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"^\s+") == 1 and "Filter" not in plan


@pytest.mark.parametrize("name", ["pod_log_context", "log_coverage", "log_coverage_total"])
def test_f14_f15_matches_are_not_sent_whole(spark, name):
    assert "Broadcast" not in Q.QUERIES[name](spark, SF)._jdf.queryExecution().sparkPlan().toString()


def test_f11_times_are_parsed_once_for_a_numbered_timeline(spark):
    assert "RLIKE" not in (plan := Q.QUERIES["ordered_timeline"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()) and "regexp_extract" not in plan


def test_f10_lines_and_events_are_classified_once(spark):
    lines = Q.line_table(spark, SF)
    for d in (findings.classify_logs(lines, ("component",)), findings.classify_warning_events(lines.select(F.lit("Warning").alias("type"), F.col("line").alias("message"), F.lit(1).alias("count")), None).where("category <> 'unclassified'")):
        assert d._jdf.queryExecution().optimizedPlan().toString().count(r"\bOOMKilled\b") == 1
