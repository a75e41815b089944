"""Timelines of evidence: union, order, and chaining by time gaps within comparable times."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from opsframe.functions.timestamps import parse_log_timestamp
from opsframe.operators.ordered import RANGE_ROWS, numbered, with_range
from opsframe.scratch import written

TIERS = ("absolute_tz_known", "absolute_tz_unknown", "time_only")
SETS = {"components": "component", "pods": "pod", "releases": "release", "categories": "category", "severities": "severity", "sources": "source"}
EVENT_TIMES = (("event_time", "eventTime"), ("first_timestamp", "event_firstTimestamp"), ("last_timestamp", "event_lastTimestamp"))
ORDER = ("tier", "ts_utc", "ts_local", "time_of_day", "seq")


def event_rows(events: DataFrame) -> DataFrame:
    """A row for each time that a cluster event carries (up to three), or one without; the times are never merged."""
    times = F.array(*[F.struct(F.col(c).alias("raw"), F.lit(source).alias("timestamp_source")) for c, source in EVENT_TIMES])
    given = F.filter(times, lambda t: t["raw"].isNotNull() & (t["raw"] != ""))
    return events.withColumn("_t", F.explode_outer(given)).withColumns({"raw": F.col("_t.raw"), "timestamp_source": F.col("_t.timestamp_source")}).drop("_t", *[c for c, _ in EVENT_TIMES])


def timeline_union(log_rows: DataFrame, events: DataFrame) -> DataFrame:
    """Log samples and events as rows with tiers; both need ``raw``, the text that holds the time, or event times."""
    both = log_rows.unionByName(event_rows(events), allowMissingColumns=True)
    return both.withColumn("_p", parse_log_timestamp(F.col("raw"))).withColumns({
        "tier": F.coalesce("_p.tier", F.lit(3)), "ts_utc": F.col("_p.ts_utc"), "ts_local": F.col("_p.ts_local"),
        "time_of_day": F.col("_p.time_of_day"), "timestamp": F.col("_p.raw"),
    }).drop("_p", "raw")


def order_timeline(timeline: DataFrame, max_entries: int | None = None) -> DataFrame:
    """By tier, then time inside the tier, then ``seq``, the order of encounter."""
    out = timeline.orderBy(*ORDER)
    return out.limit(max_entries) if max_entries else out


def number_timeline(timeline: DataFrame, name: str = "place", range_rows: int = RANGE_ROWS) -> DataFrame:
    """Rows with their places in that order, numbered in ranges of it; their times are parsed once, as the rows are written."""
    return numbered(written(timeline, "timeline"), ORDER, name, range_rows=range_rows)


def _seconds(timeline: DataFrame) -> DataFrame:
    micro = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    at = F.when(F.col("tier") == 0, micro("ts_utc")).when(F.col("tier") == 1, micro("ts_local")).when(F.col("tier") == 2, F.round(F.col("time_of_day") * 1_000_000).cast("long"))
    return timeline.withColumn("_at", at)


def correlate_timeline(timeline: DataFrame, window_seconds: int = 60, partition_cols: tuple[str, ...] = (), range_rows: int = RANGE_ROWS) -> tuple[DataFrame, DataFrame]:
    """Rows with ``island``, the 0-based number of their chain in the tier, and the rows without a time.

    A row joins the chain of the row before it in its tier if it is at most
    ``window_seconds`` later; days do not wrap.  Chains are found in two levels:
    breaks inside ranges of the order, then, over one row for each range, the
    breaks between ranges.  Ranges are cut at sampled quantiles, so a busy hour,
    or a busy moment, is several of them and no window holds all rows of a tier.
    """
    if not 1 <= window_seconds <= 3600:
        raise ValueError("the window is 1 to 3600 seconds")
    gap = window_seconds * 1_000_000
    t = _seconds(timeline)
    keys = [*partition_cols, "tier"]
    placed = with_range(t.where("tier < 3"), (*keys, "_at", "seq"), range_rows)
    inside = W.partitionBy(*keys, "_range").orderBy("_at", "seq")
    far = (F.col("_at") - F.lag("_at").over(inside)) > gap
    placed = placed.withColumn("_break", F.coalesce(far, F.lit(False)).cast("long"))
    placed = placed.withColumn("_local", F.sum("_break").over(inside.rowsBetween(W.unboundedPreceding, W.currentRow)))
    ranges = placed.groupBy(*keys, "_range").agg(F.min("_at").alias("lo"), F.max("_at").alias("hi"), F.sum("_break").alias("n"))
    across = W.partitionBy(*keys).orderBy("_range")
    edge = F.coalesce((F.col("lo") - F.lag("hi").over(across)) > gap, F.lit(False)).cast("long")
    upto = across.rowsBetween(W.unboundedPreceding, W.currentRow)
    offset = F.sum(F.col("_edge") + F.col("n")).over(upto) - F.col("n")
    ranges = ranges.withColumn("_edge", edge).withColumn("_offset", offset).select(*[F.col(k).alias(f"_{k}_of") for k in (*keys, "_range")], "_offset")
    rows = placed.join(ranges, [F.col(k).eqNullSafe(F.col(f"_{k}_of")) for k in (*keys, "_range")])
    rows = rows.withColumn("island", F.col("_offset") + F.col("_local")).select(*t.columns, "island")
    return rows, t.where("tier = 3").drop("_at")


def _value_sets(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """For each chain and each of ``SETS``: its first ``most`` values by name, and how many there are.

    Values are made distinct before they are counted and before the first are
    taken, so a chain with any number of pods needs ``most`` of them in memory.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(name).alias("set"), F.col(c).alias("value")) for name, c in SETS.items()])).alias("pair")
    distinct = rows.select(*keys, pairs).select(*keys, "pair.*").where("value is not null").distinct()
    first = distinct.withColumn("_r", F.row_number().over(W.partitionBy(*keys, "set").orderBy("value"))).where(F.col("_r") <= most)
    values = first.groupBy(*keys, "set").agg(F.array_sort(F.collect_list("value")).alias("values"))
    counts = distinct.groupBy(*keys, "set").agg(F.count(F.lit(1)).alias("n")).select(*[F.col(k).alias(f"_{k}_of") for k in keys], F.col("set").alias("_set_of"), "n")
    both = values.join(counts, [F.col(k).eqNullSafe(F.col(f"_{k}_of")) for k in keys] + [F.col("set") == F.col("_set_of")])
    none = F.array().cast("array<string>")
    own = lambda name, c: F.max(F.when(F.col("set") == name, F.col(c)))
    return both.groupBy(*[F.col(k).alias(f"_{k}_in") for k in keys]).agg(
        *[F.coalesce(own(name, "values"), none).alias(name) for name in SETS], *[F.coalesce(own(name, "n"), F.lit(0)).alias(f"n_{name}") for name in SETS]
    )


def roll_up_groups(rows: DataFrame, partition_cols: tuple[str, ...] = (), max_observations: int = 20, max_values: int = 1000, range_rows: int = RANGE_ROWS) -> DataFrame:
    """One row for each chain: ends, duration, true count, sets, first observations and a deterministic id.

    Each of the six sets comes as its first ``max_values`` values by name and as
    ``n_<set>``, the true number of its values; a set without a value is empty.
    The id hashes tier, number, ends, count and an order-free sum over all rows,
    so equal input gives equal ids.  The first observations are picked inside
    ranges of the order before they are ranked over a chain, so no task holds a
    chain.
    """
    keys = [*partition_cols, "tier", "island"]
    text = F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("None")) for c in ("component", "pod", "category", "timestamp", "summary")])
    d = rows.withColumn("_h", F.xxhash64(text).cast("decimal(38,0)"))
    order = ("_at", "seq")
    some = with_range(d, (*keys, *order), range_rows)
    some = some.withColumn("_n", F.row_number().over(W.partitionBy(*keys, "_range").orderBy(*order))).where(F.col("_n") <= max_observations)
    some = some.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= max_observations)
    observation = F.struct("_n", "timestamp", "component", "pod", "category", "severity", "source", "summary")
    shown = some.groupBy(*[F.col(k).alias(f"_{k}_of") for k in keys]).agg(F.array_sort(F.collect_list(observation)).alias("observations"))
    out = d.groupBy(*keys).agg(
        F.min_by("timestamp", F.struct("_at", "seq")).alias("start_timestamp"), F.max_by("timestamp", F.struct("_at", "seq")).alias("end_timestamp"),
        ((F.max("_at") - F.min("_at")) / 1e6).alias("duration_seconds"), F.count(F.lit(1)).alias("evidence_count"), F.sum("_h").alias("_sum"),
    )
    out = out.join(_value_sets(d, keys, max_values), [F.col(k).eqNullSafe(F.col(f"_{k}_in")) for k in keys], "left").drop(*[f"_{k}_in" for k in keys])
    none, zero = F.array().cast("array<string>"), F.lit(0).cast("long")
    out = out.withColumns({name: F.coalesce(name, none) for name in SETS} | {f"n_{name}": F.coalesce(f"n_{name}", zero) for name in SETS})
    out = out.join(shown, [F.col(k).eqNullSafe(F.col(f"_{k}_of")) for k in keys], "left").drop(*[f"_{k}_of" for k in keys])
    tier = F.element_at(F.array(*map(F.lit, TIERS)), F.col("tier") + 1)
    seed = F.concat_ws("|", tier, F.col("start_timestamp"), F.col("end_timestamp"), F.col("evidence_count"), F.col("_sum").cast("string"))
    group_id = F.concat_ws("-", tier, F.col("island").cast("string"), F.substring(F.sha2(seed, 256), 1, 12))
    return out.withColumn("temporal_comparability", tier).withColumn("group_id", group_id).drop("_sum")
