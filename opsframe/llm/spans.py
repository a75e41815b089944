"""Character spans of regular-expression matches, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,rank:int,end:int,kind:string,text:string,group:string>>"


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0), lambda a, x: a + x)


def with_spans(d: DataFrame, text_col: str, pattern: str, kind: str, rank: int, group: int = 0) -> DataFrame:
    """Adds ``kind``: all leftmost non-overlapping matches with their code point offsets, end exclusive.

    The pieces between matches (``split``) and the matches themselves
    (``regexp_extract_all``) alternate, so their lengths add up to the offsets.
    Matches are found once and kept as columns.  Running sums have two levels,
    groups of as many matches as the square root of their number, so a text with
    n matches takes n ** 1.5 steps.  Texts without a match cost one search.
    """
    text, lit = F.col(text_col), F.lit(pattern)
    hit = text.rlike(pattern)
    none = F.array().cast("array<string>")
    found, step, k, sums = (F.col(c) for c in ("_found", "_step", "_k", "_sums"))
    d = _bound(d, {"_found": F.when(hit, F.regexp_extract_all(text, lit, F.lit(0))).otherwise(none), "_gaps": F.when(hit, F.split(text, pattern, -1)).otherwise(none), "_groups": F.when(hit & F.lit(group > 0), F.regexp_extract_all(text, lit, F.lit(group))).otherwise(none)})
    ahead = F.zip_with(F.slice("_gaps", 1, F.size(found)), found, lambda g, m: F.length(g) + F.length(m))
    d = _bound(d, {"_step": ahead, "_k": F.greatest(F.lit(1), F.sqrt(F.size(found)).cast("int"))})
    d = _bound(d, {"_sums": F.transform(F.sequence(F.lit(0), (F.size(step) / k).cast("int")), lambda j: _sum(F.slice(step, 1, j * k)))})

    def span(m: Column, i: Column) -> Column:
        j = (i / k).cast("int")
        end = F.get(sums, j) + _sum(F.slice(step, j * k + 1, i - j * k + 1))
        return F.struct(end.alias("end"), m.alias("text"), F.get(F.col("_groups"), i).alias("group"))

    whole = lambda s: F.struct((s["end"] - F.length(s["text"])).alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["text"].alias("text"), s["group"].alias("group"))
    d = _bound(d, {kind: F.transform(F.transform(found, span), whole).cast(SPAN)})
    return d.drop("_found", "_gaps", "_groups", "_step", "_k", "_sums", "_bar")


def _bound(d: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``d`` with ``columns``, which are evaluated once for each row.

    The optimiser would merge such steps, and evaluate a column anew for each
    element of an array whose lambda refers to it.  It leaves steps apart that
    refer to a row number of the step before.
    """
    if "_bar" in d.columns:
        columns = {name: F.when(F.col("_bar") >= 0, c) for name, c in columns.items()}
    return d.withColumns({**columns, "_bar": F.monotonically_increasing_id()})


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span by start, then rank, comma-joined."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(F.array_sort(spans), one), ",")
