"""Metric series in long form: ``namespace, metric_name, dimensions MAP, ts, value``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from opsframe.functions.ranges import TimeRange, bin_start

SERIES = ("namespace", "metric_name", "dimensions")
LEVELS = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}


def dimension_subset(dimensions: Column, wanted: dict[str, str]) -> Column:
    """All wanted pairs are among a series' dimensions."""
    out = F.lit(True)
    for k, v in wanted.items():
        out = out & F.coalesce(F.try_element_at(dimensions, F.lit(k)) == v, F.lit(False))
    return out


def list_metrics(points: DataFrame, namespace: str | None = None, metric_name: str | None = None, dimensions: dict[str, str] | None = None, limit: int | None = 100) -> DataFrame:
    """Distinct series that fit the filters, of which one is needed."""
    if not (namespace or metric_name or dimensions):
        raise ValueError("at least one filter is needed")
    if namespace:
        points = points.where(F.col("namespace") == namespace)
    if metric_name:
        points = points.where(F.col("metric_name") == metric_name)
    if dimensions:
        points = points.where(dimension_subset(F.col("dimensions"), dimensions))
    out = points.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("points"))
    return out.orderBy("namespace", "metric_name", F.to_json("dimensions")).limit(limit) if limit else out


def read_metric_points(points: DataFrame, wanted: DataFrame, within: TimeRange | None = None) -> DataFrame:
    """Points of the asked series.  ``wanted``: one short row for each query (``query, namespace, metric_name, dimensions``)."""
    if within:
        points = points.where(within.holds(F.col("ts")))
    # maps cannot be join keys; their sorted entries can
    key = lambda d: d.withColumn("_dims", F.to_json(F.map_from_entries(F.array_sort(F.map_entries("dimensions")))))
    w = key(wanted).select("query", "namespace", "metric_name", "_dims")
    return key(points).join(w, ["namespace", "metric_name", "_dims"]).drop("_dims")


def statistic(stat: str, value: str = "value", exact: bool = False, k: int | None = None) -> Column:
    """Average, Sum, Minimum, Maximum, SampleCount or pNN.N as an aggregate, percentiles from a sketch unless ``exact``.  IQM is ``interquartile_mean``."""
    plain = {"Average": F.avg, "Sum": F.sum, "Minimum": F.min, "Maximum": F.max, "SampleCount": F.count}
    if stat in plain:
        return plain[stat](value)
    if stat.startswith("p") and 0 <= float(stat[1:]) <= 100:
        level = F.lit(float(stat[1:]) / 100)
        return F.percentile(value, level) if exact else F.kll_sketch_get_quantile_double(F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k or SKETCH)), level)
    raise ValueError(f"unknown statistic {stat!r}")


def metric_statistic(points: DataFrame, stat: str, period: int, keys: tuple[str, ...] = ("metric_name",), exact: bool = False) -> DataFrame:
    """One value for each series and period: ``*keys, period_start, value``; quartiles and percentiles from sketches unless ``exact``."""
    binned = points.withColumn("period_start", bin_start(F.col("ts"), period))
    if stat != "IQM":
        return binned.groupBy(*keys, "period_start").agg(statistic(stat, exact=exact).cast("double").alias("value"))
    # mean of the values between the quartiles, both included
    levels = F.array(F.lit(0.25), F.lit(0.75))
    quartiles = F.percentile("value", levels) if exact else F.kll_sketch_get_quantile_double(F.kll_sketch_agg_double(F.col("value").cast("double"), F.lit(SKETCH)), levels)
    q = binned.groupBy(*keys, "period_start").agg(quartiles.alias("q"))
    inside = binned.join(q, [*keys, "period_start"]).where(F.col("value").between(F.col("q")[0], F.col("q")[1]))
    return inside.groupBy(*keys, "period_start").agg(F.avg("value").alias("value"))


#: Items of a quantile sketch; its rank error is about ``2.3 / k ** 0.9``: 0.5 % at 1,000, 0.25 % at 2,000.
SKETCH = 2_000


def metric_summary(points: DataFrame, keys: tuple[str, ...] = ("metric_name",), exact: bool = False, k: int = SKETCH) -> DataFrame:
    """Count, extremes, mean, percentiles, latest value, first time of the maximum, first and last time.

    Percentiles come from a sketch of bounded size for each series: values whose
    rank is near the level.  ``exact`` interpolates between the two values around
    the level; it keeps a count for each different value of a series in memory.
    """
    levels = F.array(*[F.lit(x) for x in LEVELS.values()])
    p = F.percentile("value", levels) if exact else F.kll_sketch_get_quantile_double(F.kll_sketch_agg_double(F.col("value").cast("double"), F.lit(k)), levels)
    out = points.where(F.col("value").isNotNull()).groupBy(*keys).agg(
        F.count("value").alias("n"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("avg"), p.alias("p"),
        F.max_by("value", F.struct("ts", "value")).alias("latest"), F.max_by("ts", F.struct("value", -F.unix_micros(F.col("ts").cast("timestamp")))).alias("max_at"),
        F.min("ts").alias("first_at"), F.max("ts").alias("last_at"),
    )
    return out.select(*keys, "n", "min", "max", "avg", *[F.col("p")[i].alias(x) for i, x in enumerate(LEVELS)], "latest", "max_at", "first_at", "last_at")


def sketch_bins(points: DataFrame, period: int, keys: tuple[str, ...] = ("metric_name",), k: int = SKETCH) -> DataFrame:
    """Mergeable summaries of each series and period: ``*keys, period_start, n, min, max, total, sketch``.

    Written once, they answer for any range of periods without the points; a
    summary's size is bounded, however many points it stands for.
    """
    value = F.col("value").cast("double")
    d = points.where(F.col("value").isNotNull()).groupBy(*keys, bin_start(F.col("ts"), period).alias("period_start"))
    return d.agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.sum(value).alias("total"), F.kll_sketch_agg_double(value, F.lit(k)).alias("sketch"))


def merge_bins(bins: DataFrame, keys: tuple[str, ...] = ("metric_name",), first: int | None = None, last: int | None = None, levels: dict[str, float] | None = None, period: int | None = None) -> DataFrame:
    """Count, extremes, mean and percentiles of each series over the periods that start from ``first`` to ``last``, from ``sketch_bins``.

    ``period`` gives a row for each longer period instead of one for the range.
    The rank error stays that of one sketch, however many are merged.
    """
    levels = levels or LEVELS
    if first is not None:
        bins = bins.where(F.col("period_start") >= first)
    if last is not None:
        bins = bins.where(F.col("period_start") <= last)
    by = list(keys)
    if period:
        bins = bins.withColumn("period_start", F.floor(F.col("period_start") / period) * period)
        by.append("period_start")
    out = bins.groupBy(*by).agg(F.sum("n").alias("n"), F.min("min").alias("min"), F.max("max").alias("max"), (F.sum("total") / F.sum("n")).alias("avg"), F.kll_merge_agg_double("sketch").alias("_sketch"))
    p = F.kll_sketch_get_quantile_double("_sketch", F.array(*map(F.lit, levels.values())))
    return out.withColumn("_p", p).select(*by, "n", "min", "max", "avg", *[F.col("_p")[i].alias(x) for i, x in enumerate(levels)])


def empty_series_report(wanted: DataFrame, points: DataFrame, keys: tuple[str, ...] = ("metric_name",)) -> DataFrame:
    """Asked series without any point."""
    return wanted.join(points.select(*keys).distinct(), list(keys), "left_anti")


def downsample(points: DataFrame, max_points: int = 200, keys: tuple[str, ...] = ("metric_name",), order: tuple[str, ...] = ("ts",), bucket_seconds: int = 3600) -> DataFrame:
    """Every k-th point of a series, from its first, with k so that no more than ``max_points`` are left.

    Points are numbered in two levels, inside buckets of time and over one row
    for each bucket, so that no task sorts a whole series.  ``order`` begins
    with ``ts``; points without a time come first.
    """
    d = points.withColumn("_bucket", F.coalesce(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (bucket_seconds * 1_000_000)), F.lit(-(1 << 62))))
    counts = d.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    series = W.partitionBy(*keys)
    before = F.coalesce(F.sum("_n").over(series.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*[F.col(c).alias(f"_{c}_of") for c in keys], F.col("_bucket").alias("_bucket_of"), before.alias("_before"), F.ceil(F.sum("_n").over(series) / max_points).alias("_k"))
    ranked = d.withColumn("_i", F.row_number().over(W.partitionBy(*keys, "_bucket").orderBy(*order)) - 1)
    same = [F.col(c).eqNullSafe(F.col(f"_{c}_of")) for c in keys] + [F.col("_bucket") == F.col("_bucket_of")]
    return ranked.join(counts, same).where((F.col("_i") + F.col("_before")) % F.col("_k") == 0).select(*points.columns)
