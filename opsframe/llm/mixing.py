"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from opsframe.llm.stages import written

WORD = r"[^\x20\x09-\x0D]+"
#: Uses that are few enough to be put in order by one task.
FEW = 20_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3) -> DataFrame:
    """Words that the mix should take from each source.

    ``sizes`` has one row for each source (``source``, ``source_size``), so the
    ordered windows here see as many rows as there are sources, never documents.
    All targets are min(most * size, level * weight): the level at which they
    use up the total is found by one ordered pass over the sources' caps.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    s = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size").cast("double") * most)
    fills = W.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = fills.rowsBetween(W.unboundedPreceding, -1)
    rest = fills.rowsBetween(W.currentRow, W.unboundedFollowing)
    s = s.withColumn("total", F.sum("source_size").over(W.partitionBy()).cast("double"))
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    # The level belongs to the first source that it does not fill; the caps before it are full.
    open_level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source", "level"))).over(W.partitionBy())["level"]
    target = F.least(F.col("cap"), F.coalesce(open_level * F.col("weight"), F.col("cap")))
    return s.select("source", "source_size", target.alias("target"))


def fair_mix(
    docs: DataFrame,
    weights: Sequence[int] = (1, 2, 3),
    most: int = 3,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Words that a mix of the sources takes of each document.

    Documents of a source are put in the order of a hash of id and text (60 bits).  The e-th
    use of a document has the virtual finish time (e * source_size + words of
    the source up to and with it) / target; all uses are ordered by that time
    over all sources and the order is cut where the budget, the words of all
    documents, is used up.  Sources weigh ``weights``, repeating in code point
    order with null last; a target above ``most`` times the source is cut there
    and the excess goes to the others by weight.

    Running sums have two levels, so that no source is ever in one task: sums
    over hash buckets, as many as the square root of the row count, then inside
    buckets.

    Returns ``doc_id, size, source_size, target, taken``, one row for each input
    row.  Null text: size 0 and taken 0.  Null source: a source of its own, the
    last.  Rows with a null or repeated id keep their places by size; equal rows
    are interchangeable.  No words at all: all targets 0.  Other columns of the
    input are not looked at.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.col(text_col).alias("text"))
    place = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f"#{seed}#"), F.md5(F.coalesce(F.col("text"), F.lit(""))))), 1, 15), 16, 10)
    d = written(d.withColumn("place", place.cast("long")).drop("text"), "mix-sizes")
    sizes = d.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, most)

    n_rows, budget = d.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    n_buckets = 1 + math.isqrt(n_rows)  # as many buckets as rows in each: neither level gets large
    d = d.withColumn("bucket", F.shiftright(F.shiftright("place", 30) * F.lit(n_buckets), 30))  # in the order of places
    key = ["source", "bucket"]
    sums = d.groupBy(*key).agg(F.sum("size").alias("bucket_size"))
    ahead = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("bucket_size").over(ahead), F.lit(0)).alias("ahead"))
    inside = W.partitionBy(*key).orderBy("place", "doc_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    d = d.withColumn("cum", F.sum("size").over(inside))
    d = d.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")), "left").drop("s", "b")
    d = d.withColumn("cum", F.col("cum") + F.col("ahead"))
    t = F.broadcast(targets.withColumnRenamed("source", "s"))  # a row for each source
    d = d.join(t, F.col("source").eqNullSafe(F.col("s")), "left")
    d = written(d.select("doc_id", "source_size", "size", "target", "cum", "place"), "mix-times")

    live = (F.col("size") > 0) & (F.col("target") > 0)
    times = [(F.lit(e) * F.col("source_size") + F.col("cum")) / F.col("target") for e in range(most)]
    order = lambda finish: F.struct(finish.alias("finish"), "place", "doc_id", "size")
    uses = d.where(live).select(F.explode(F.array(*[order(x) for x in times])).alias("use")).select("use.*")
    cut = _cut(uses, float(budget))
    taken = F.lit(0).cast("long")
    for x in times if cut else ():
        last = F.struct(*[F.lit(v).cast(kind).alias(name) for (name, kind), v in zip(uses.dtypes, cut, strict=True)])
        taken = taken + F.when(F.coalesce(live & (order(x) <= last), F.lit(False)), F.col("size")).otherwise(0)
    return d.select("doc_id", "size", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"), taken.alias("taken"))


def _cut(uses: DataFrame, budget: float, slots: int = 4096) -> tuple | None:
    """The last use (finish, place, doc_id, size) whose words still fit the budget, in the order of those columns.

    Sums over equal steps of virtual time find the step in which the budget runs
    out; it is split again until few uses are left, and only these are ordered.
    The driver sees at most ``slots`` sums at a time.
    """
    low, step, base = 0.0, 4.0 / slots, 0.0  # times are near 1 where the budget ends; later ones share the last slot
    order = W.orderBy("finish", "place", "doc_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    for _ in range(6):
        slot = F.least(F.floor((F.col("finish") - low) / step), F.lit(slots - 1)).cast("int")
        sums = uses.groupBy(slot.alias("slot")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")).orderBy("slot").collect()
        if not sums:
            return None
        for at, words, n in sums:  # noqa: B007
            if base + words > budget:
                break
            base += words
        else:
            return uses.agg(F.max(F.struct(*uses.columns))).first()[0]
        uses = uses.where(slot == at)
        low, step = low + at * step, step / slots
        if n <= FEW:
            break
    kept = uses.withColumn("upto", base + F.sum("size").over(order)).where(F.col("upto") <= budget)
    last = kept.agg(F.max(F.struct(*uses.columns))).first()[0]
    return tuple(last) if last else (low, -(1 << 63), None, 0)
