"""Findings and evidence from log lines: ``entity`` columns, ``line_no`` (order) and ``line``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from opsframe.functions.classify import EXCEPTION_LIKE, UNCLASSIFIED, classify_line, exception_class, frame_signature, normalize_message, severity_of, severity_rank, stack_fingerprint, strip
from opsframe.functions.redact import cap_text, redact_secrets, withhold_if_secret
from opsframe.functions.timestamps import parse_log_timestamp

#: Parts into which a category's messages are dealt before they meet.
SPREAD = 16


def _once(value: Column) -> Column:
    """``value`` as a row's only element: conditions on it would otherwise compute it once more each, before the rows they keep."""
    return F.explode(F.array(value))


def classified_lines(lines: DataFrame) -> DataFrame:
    """Non-blank lines, stripped, with ``category``."""
    return lines.withColumn("line", _once(strip(F.col("line")))).where("line <> ''").withColumn("category", _once(classify_line(F.col("line"))))


def distinct_messages(lines: DataFrame, entity: tuple[str, ...], max_chars: int = 500) -> DataFrame:
    """Per entity, category and normalised message: occurrences, first line and its redacted, then cut, text.

    The key is built of the unredacted line and never leaves; a hash stands for it.
    """
    hit = classified_lines(lines).where(F.col("category") != UNCLASSIFIED)
    key = F.xxhash64(normalize_message(F.col("line")))
    out = hit.groupBy(*entity, "category", key.alias("message_key")).agg(
        F.count(F.lit(1)).alias("n"), F.min("line_no").alias("first_line"), F.min_by("line", "line_no").alias("_line")
    )
    return out.withColumn("sample", cap_text(redact_secrets(F.col("_line")), max_chars, "")).withColumn("time", parse_log_timestamp(F.col("_line"))).drop("_line")


def classify_logs(lines: DataFrame, entity: tuple[str, ...] = ("pod",), max_samples: int = 8) -> DataFrame:
    """Per entity and category: severity, occurrences, distinct messages and the first samples in order of first sight.

    One reading in three groupings: messages, then parts of a category with their
    first samples each, then categories; so neither raw lines nor messages of a
    hot entity are gathered.
    """
    by = [*entity, "category"]
    part = F.pmod(F.xxhash64("message_key"), F.lit(SPREAD)).alias("_part")
    messages = distinct_messages(lines, entity).select("*", part)
    w = W.partitionBy(*by, "_part").orderBy("first_line")
    ranked = messages.withColumn("_r", F.row_number().over(w))
    sample = F.when(F.col("_r") <= max_samples, F.struct("first_line", "sample", "time"))
    parts = ranked.groupBy(*by, "_part").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("m"), F.min("first_line").alias("first_line"), F.collect_list(sample).alias("some"))
    out = parts.groupBy(*by).agg(
        F.sum("n").alias("occurrences"), F.sum("m").alias("distinct_messages"), F.min("first_line").alias("first_line"),
        F.slice(F.array_sort(F.flatten(F.collect_list("some"))), 1, max_samples).alias("samples"),
    )
    return out.withColumns({"severity": severity_of(F.col("category")), "severity_rank": severity_rank(F.col("category"))})


def lines_scanned(lines: DataFrame, entity: tuple[str, ...] = ("pod",)) -> DataFrame:
    return lines.where(strip(F.col("line")) != "").groupBy(*entity).agg(F.count(F.lit(1)).alias("lines_scanned"))


def top_categories(findings: DataFrame) -> DataFrame:
    """Most severe first, then most frequent, then first seen."""
    return findings.orderBy("severity_rank", F.desc("occurrences"), "first_line")


def log_evidence(findings: DataFrame, entity: tuple[str, ...] = ("pod",), max_rows: int | None = 20) -> DataFrame:
    """Structured evidence without log text: exception class, withheld-if-secret message, fingerprint, counts, times.

    Times come from the kept samples; those with a known offset are preferred and
    never mixed with others.
    """
    texts = F.transform("samples", lambda s: s["sample"])
    first = F.get(texts, F.lit(0))
    classes = F.filter(F.transform(texts, exception_class), lambda c: c.isNotNull())
    exception = F.when(F.col("category").isin(*EXCEPTION_LIKE), withhold_if_secret(F.get(classes, F.lit(0))))
    trace = F.col("category") == "stack_trace"
    message = F.when(~trace, withhold_if_secret(strip(normalize_message(first))))
    utc = F.array_compact(F.transform("samples", lambda s: s["time"]["ts_utc"]))
    local = F.array_compact(F.transform("samples", lambda s: s["time"]["ts_local"]))
    known = F.size(utc) > 0
    out = findings.withColumns({"exception_class": exception, "normalized_message": message, "_signature": F.when(trace, frame_signature(first))})
    out = out.select(
        *entity, "category", "severity", "severity_rank", "exception_class", "normalized_message",
        stack_fingerprint(F.col("category"), F.col("exception_class"), F.col("normalized_message"), F.col("_signature")).alias("stack_fingerprint"),
        F.when(trace, F.col("occurrences")).otherwise(0).alias("frame_count"), F.col("occurrences").alias("occurrence_count"), "first_line",
        F.when(known, F.array_min(utc)).alias("first_seen_utc"), F.when(known, F.array_max(utc)).alias("last_seen_utc"),
        F.when(~known, F.array_min(local)).alias("first_seen_local"), F.when(~known, F.array_max(local)).alias("last_seen_local"),
        ((F.size(utc) > 0) | (F.size(local) > 0)).alias("timestamp_known"),
    )
    if not max_rows:
        return out
    return out.orderBy("severity_rank", F.desc("occurrence_count"), "first_line").limit(max_rows)


def co_occurring_categories(findings: DataFrame, component: str = "component") -> DataFrame:
    """Categories that more than one component shows."""
    return findings.groupBy("category").agg(F.array_sort(F.collect_set(component)).alias("components")).where(F.size("components") > 1)


def tail_per_pod(lines: DataFrame, n: int, keys: tuple[str, ...] = ("pod", "log_source")) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(F.desc("line_no"))
    return lines.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def log_coverage(lines: DataFrame, tail: int | None, keys: tuple[str, ...] = ("pod",)) -> tuple[DataFrame, DataFrame]:
    """Per pod: lines returned and whether the asked tail was reached (never without one); and the same over all pods."""
    reached = lambda n: F.col(n) >= tail if tail is not None else F.lit(False)
    each = lines.groupBy(*keys).agg(F.count(F.lit(1)).alias("lines_returned")).withColumn("tail_cap_hit", reached("lines_returned"))
    total = each.agg(F.coalesce(F.sum("lines_returned"), F.lit(0)).alias("lines_returned"), F.count(F.lit(1)).alias("pods_sampled"), F.coalesce(F.bool_or("tail_cap_hit"), F.lit(False)).alias("any_pod_cap_hit"))
    return each, total.withColumn("total_cap_hit", reached("lines_returned"))


def classify_warning_events(events: DataFrame, limit: int | None = 30) -> DataFrame:
    """Warning events with the category of their message's top finding, or ``unclassified``.

    A message's findings are ranked by severity, then number of lines, then first line.
    """
    warn = events.where("type = 'Warning'").withColumn("_event", F.monotonically_increasing_id()) if "event_key" not in events.columns else events.where("type = 'Warning'").withColumn("_event", F.col("event_key"))
    parts = F.split(F.coalesce("message", F.lit("")), r"\r\n|[\n\r]")
    found = F.filter(F.transform(parts, lambda x: classify_line(x)), lambda c: c.isNotNull() & (c != UNCLASSIFIED))

    def top(found: Column) -> Column:
        count = lambda c: F.size(F.filter(found, lambda y: y == c))
        ranked = F.transform(F.array_distinct(found), lambda c: F.struct(severity_rank(c).alias("rank"), (-count(c)).alias("less"), F.array_position(found, c).alias("at"), c.alias("category")))
        return F.coalesce(F.array_min(ranked)["category"], F.lit(UNCLASSIFIED))

    category = F.get(F.transform(F.array(found), top), F.lit(0))  # what was found is bound once
    out = warn.withColumn("category", _once(category)).withColumns({"severity": severity_of(F.col("category")), "severity_rank": severity_rank(F.col("category")), "message": F.substring(redact_secrets(F.col("message")), 1, 300)})
    out = out.orderBy("severity_rank", F.desc_nulls_last("count")).drop("_event")
    return out.limit(limit) if limit else out
