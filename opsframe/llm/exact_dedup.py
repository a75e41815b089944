"""Exact duplicates: frequent digests by Misra-Gries, removed map-side; the others by an ordinary shuffle."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from opsframe.llm.stages import unused, written

#: Counters of a Misra-Gries summary: each task holds so many digests, and so many winners are broadcast at most.
COUNTERS = 16_384


def reduce_counters(held: dict[str, int], counters: int) -> dict[str, int]:
    """At most ``counters`` entries: all counts less the largest that must go, as Misra and Gries decrement."""
    if len(held) <= counters:
        return held
    counts = np.fromiter(held.values(), np.int64, len(held))
    cut = int(np.partition(counts, -counters - 1)[-counters - 1])
    return {d: n - cut for d, n in held.items() if n > cut}


def frequent_digests(rows: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Digests that may be frequent: ``digest``, at most ``counters + 1`` rows.

    Every task keeps a summary of its rows; summaries add up.  A digest's summed
    count is at most its true count and short of it by n / (counters + 1) at
    most, so each digest in 2 n / (counters + 1) rows or more is among those
    whose summed count reaches n / (counters + 1), and no more than counters + 1
    digests can reach that.
    """

    def summaries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        for batch in batches:
            seen = pc.value_counts(batch.column(0))
            for digest, n in zip(seen.field("values").to_pylist(), seen.field("counts").to_pylist(), strict=True):
                held[digest] = held.get(digest, 0) + n
            held = reduce_counters(held, counters)
        yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["digest", "least"])

    least = max(2.0, rows.count() / (counters + 1))
    found = rows.select("digest").mapInArrow(summaries, "digest string, least long").where(F.col("least") > 1)
    return found.groupBy("digest").agg(F.sum("least").alias("least")).where(F.col("least") >= least).select("digest")


def copy_groups(docs: DataFrame, counters: int = COUNTERS, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Every row with its group of equal texts: ``doc_id, keep_id, group_size, kept, text_sha256``, then the columns ``keep``.

    The text is read once, to write ids and digests.  Rows of frequent digests
    (``frequent_digests``) meet their winner, exact count and largest id over all
    rows, in a broadcast of at most ``counters + 1`` rows and are never shuffled;
    the rest is shuffled by digest, where no group holds more than
    2 n / (counters + 1) rows.

    Null text: equal to the empty text.  The row with the largest id stays; ids
    of null count as the smallest, and of rows with the same id and text one
    stays.  Empty input: empty result.  Columns of ``docs`` other than those
    named are not read.
    """
    d = docs.select(
        F.col(id_col).alias("doc_id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256).alias("digest"),
        F.monotonically_increasing_id().alias("row"), F.struct(F.lit(0).alias("none"), *[F.col(c) for c in keep]).alias("kept_columns"),
    )
    rows = written(d, "exact-digests")
    best = F.max(F.struct("doc_id", "row")).alias("best")
    frequent = written(frequent_digests(rows, counters), "exact-frequent")
    winners = written(rows.join(F.broadcast(frequent), "digest").groupBy("digest").agg(best, F.count(F.lit(1)).alias("group_size")), "exact-winners")
    met = rows.join(F.broadcast(winners), "digest", "left")
    group = W.partitionBy("digest")
    rest = met.where(F.col("group_size").isNull()).withColumn("best", F.max(F.struct("doc_id", "row")).over(group)).withColumn("group_size", F.count(F.lit(1)).over(group))
    every = met.where(F.col("group_size").isNotNull()).unionByName(rest)
    return every.select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("best.row") == F.col("row")).alias("kept"), F.col("digest").alias("text_sha256"), "kept_columns.*"
    ).drop("none")


def drop_copies(docs: DataFrame, counters: int = COUNTERS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one for each text, with all their columns; defined as ``copy_groups`` is."""
    row = unused(docs, "whole")
    whole = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.struct(*docs.columns).alias(row))
    return copy_groups(whole, counters, keep=(row,)).where("kept").select(f"{row}.*")
