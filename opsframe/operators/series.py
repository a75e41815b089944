"""Bin series: merging, zero filling and statistics, for any number of series at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsframe.functions.ranges import parse_bin_timestamp, to_int


def merge_series(rows: DataFrame, label: str, count: str, bin_seconds: int, keys: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Rows of text cells as ``bin, matches`` (bins aligned, repeated ones added), and the number of rows that cannot be read."""
    r = rows.withColumn("_t", parse_bin_timestamp(F.col(label))).withColumn("_n", to_int(F.col(count)))
    bad = F.col("_t").isNull() | F.col("_n").isNull()
    series = r.where(~bad).groupBy(*keys, (F.col("_t") - F.pmod("_t", F.lit(bin_seconds))).alias("bin")).agg(F.sum("_n").alias("matches"))
    return series, r.agg(F.count_if(bad).alias("unparsable"))


def _grid(points: DataFrame, start_s: int, end_s: int, bin_seconds: int, keys: tuple[str, ...]) -> DataFrame:
    """All bins from the one of ``start_s`` to the one of ``end_s`` (included), absent ones with null."""
    first, last = start_s - start_s % bin_seconds, end_s - end_s % bin_seconds
    grid = F.explode(F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long"), F.lit(bin_seconds).cast("long"))).alias("bin")
    names = points.select(*keys).distinct() if keys else points.sparkSession.range(1).drop("id").select(F.lit(0).alias("_one"))
    return names.select(*keys, grid).join(points.select(*keys, "bin", "matches"), [*keys, "bin"], "left")


def zero_fill_bins(points: DataFrame, start_s: int, end_s: int, bin_seconds: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """All bins from the one of ``start_s`` to the one of ``end_s`` (included), absent ones with 0."""
    return _grid(points, start_s, end_s, bin_seconds, keys).select(*keys, "bin", F.coalesce("matches", F.lit(0)).alias("matches"))


def series_stats(points: DataFrame, start_s: int, end_s: int, bin_seconds: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Total, bins, median over the whole grid, peak (the earliest of equals), first and last bin with events; one join, which knows what bins were given."""
    grid = _grid(points, start_s, end_s, bin_seconds, keys).withColumn("_given", F.col("matches").isNotNull()).fillna(0, ["matches"])
    full, given = F.when(F.col("matches") > 0, F.col("bin")), F.col("_given")
    agg = [
        F.sum("matches").alias("total"), F.count(F.lit(1)).alias("expected_bins"), F.count_if(given).alias("returned_bins"),
        F.count_if(F.col("matches") == 0).alias("empty_bins"), F.percentile("matches", F.lit(0.5)).alias("median"),
        F.max(F.when(given, F.struct("matches", (-F.col("bin")).alias("at")))).alias("peak"), F.min(full).alias("first_bin"), F.max(full).alias("last_bin"),
    ]
    out = grid.groupBy(*keys).agg(*agg)
    return out.select(*keys, "total", "expected_bins", "returned_bins", "empty_bins", "median", F.col("peak.matches").alias("peak"), (-F.col("peak.at")).alias("peak_bin"), "first_bin", "last_bin")
