"""Numbers and running sums over a whole order, without a window that holds all rows.

The order is cut into ranges at sampled quantiles, so that a busy stretch of it
is several ranges.  Rows are numbered or summed inside their range, and one row
for each range carries what lies before it.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Rows of a range that are aimed at, the most ranges, and rows of the sample for each range.
RANGE_ROWS, MOST_RANGES, SAMPLED = 200_000, 2_000, 50


def range_bounds(rows: DataFrame, order: Sequence[str], range_rows: int = RANGE_ROWS) -> list[tuple]:
    """Values of the order columns at which ranges begin, from a sample of at most some ``MOST_RANGES * SAMPLED`` rows.

    One column of a row is read, then the order columns of the sample.  Which
    rows fall into the sample changes only how even the ranges are.
    """
    n = rows.count()
    parts = min(MOST_RANGES, ceil(n / range_rows))
    if parts < 2:
        return []
    share = min(1.0, parts * SAMPLED / n)
    own = rows.select(*order)
    ordered = [tuple(r) for r in (own if share == 1.0 else own.sample(share, 17)).orderBy(*order).collect()]
    return list(dict.fromkeys(ordered[len(ordered) * k // parts] for k in range(1, parts))) if ordered else []


def in_range(rows: DataFrame, order: Sequence[str], bounds: list[tuple]) -> Column:
    """Number of a row's range: how many bounds are not above it, found by halving."""
    if not bounds:
        return F.lit(0)
    kinds = [rows.schema[c].dataType for c in order]
    at = F.struct(*[F.col(c) for c in order])
    edges = F.array(*[F.struct(*[F.lit(v).cast(k).alias(c) for v, k, c in zip(b, kinds, order, strict=True)]) for b in bounds])
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    fits = lambda low, step: (low + step <= len(bounds)) & (F.get(edges, low + step - 1) <= at)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda low, step: F.when(fits(low, step), low + step).otherwise(low))


def with_range(rows: DataFrame, order: Sequence[str], range_rows: int = RANGE_ROWS, name: str = "_range") -> DataFrame:
    return rows.withColumn(name, in_range(rows, order, range_bounds(rows, order, range_rows)))


def running_sums(rows: DataFrame, order: Sequence[str], value: Column, name: str, keys: Sequence[str] = (), range_rows: int = RANGE_ROWS, descending: bool = False) -> DataFrame:
    """``rows`` with the sum of ``value`` over all rows up to and with it, in the order and inside equal ``keys``.

    Nulls of order columns come first, or last if ``descending``, which turns the
    whole order round.  Rows that are equal in all order columns are taken in
    either order.
    """
    d = with_range(rows.withColumn("_value", value), (*keys, *order), range_rows)
    step = (lambda c: F.desc(c)) if descending else F.asc
    sums = d.groupBy(*keys, "_range").agg(F.sum("_value").alias("_sum"))
    before = W.partitionBy(*keys).orderBy(step("_range")).rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*[F.col(k).alias(f"_{k}_of") for k in keys], F.col("_range").alias("_range_of"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = W.partitionBy(*keys, "_range").orderBy(*map(step, order)).rowsBetween(W.unboundedPreceding, W.currentRow)
    d = d.withColumn("_inside", F.sum("_value").over(inside))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}_of")) for k in keys] + [F.col("_range") == F.col("_range_of")]
    return d.join(sums, same).withColumn(name, F.col("_before") + F.col("_inside")).select(*rows.columns, name)


def numbered(rows: DataFrame, order: Sequence[str], name: str = "place", keys: Sequence[str] = (), range_rows: int = RANGE_ROWS, descending: bool = False) -> DataFrame:
    """``rows`` with their places, from 1, in the order and inside equal ``keys``."""
    return running_sums(rows, order, F.lit(1).cast("long"), name, keys, range_rows, descending)
