"""Secret scanning with a battery of randomness tests, in native expressions only."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from opsframe.llm.spans import joined, with_spans
from opsframe.llm.stages import written

# The base patterns (kind, pattern, group whose length counts, least length).
BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"

# Encodings in the order in which they are tried (name, pattern, alphabet; of words and numbers written
# in it: excess of the sum of squared letter shares over the uniform one, times alphabet size, and share of neighbours
# of different kinds, capital, small letter, digit or sign).
ENCODINGS = (
    ("hex", r"^[0-9a-f]+$", "0123456789abcdef", 0.6, 0.2),
    ("HEX", r"^[0-9A-F]+$", "0123456789ABCDEF", 0.6, 0.2),
    ("base32", r"^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 1.1, 0.15),
    ("lower36", r"^[0-9a-z]+$", "0123456789abcdefghijklmnopqrstuvwxyz", 1.3, 0.15),
    ("upper36", r"^[0-9A-Z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1.3, 0.15),
    ("base62", r"^[0-9A-Za-z]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", 2.6, 0.3),
    ("base64", r"^[0-9A-Za-z+/]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 2.7, 0.33),
    ("base64url", r"", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_+/", 2.7, 0.33),
)


def _long_enough(kind: str, least: int) -> Callable[[Column], Column]:
    return lambda span: F.length(span["group" if kind == "assign" else "text"]) >= least


# Coefficients of the published rational fit to the complementary error function (relative error under 1.2e-7).
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def _log_upper(z: Column) -> Column:
    """Natural logarithm of the normal law's upper tail at ``z``, right in relative terms as far out as doubles reach."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + x / 2)
    fit = F.lit(0.0)
    for c in reversed(ERFC):
        fit = fit * t + c
    tail = F.log(t) - x * x + fit - F.log(F.lit(2.0))
    return F.when(z >= 0, tail).otherwise(F.log1p(-F.exp(tail)))


def randomness(tokens: DataFrame) -> DataFrame:
    """The battery for each row's ``token``, of 20 or more characters; adds three columns.

    ``text_log``: logarithm of the p-value of a chi-squared statistic as small as
    this, and of as many runs of characters of one kind, for words or numbers
    written in the inferred encoding (both as normal deviates, summed).  ``random_log``:
    logarithm of the Bonferroni combination of the p-values of the three tests
    (uniformity over the alphabet, runs above and below its middle, lag-one
    serial correlation) under the hypothesis that the characters are independent
    and uniform.  ``stratum``: the base-2 logarithm of the length.  Logarithms
    keep tails apart that a double would round to 0.
    """
    token = F.col("token")
    pick = lambda of: F.coalesce(*[F.when(token.rlike(p), F.lit(v)) for (_, p, *_), v in zip(ENCODINGS, of, strict=True)])
    kept = tokens.columns
    d = tokens.withColumns({"alphabet": pick([a for _, _, a, *_ in ENCODINGS]), "excess": pick([e for *_, e, _ in ENCODINGS]), "rate": pick([r for *_, r in ENCODINGS])})
    place = lambda c: F.call_function("instr", F.col("alphabet"), c).cast("double")
    d = d.withColumns({"x": F.transform(F.split(token, "(?<=.)(?=.)"), place), "k": F.length("alphabet").cast("double"), "n": F.length(token).cast("double")})
    x, k, n = F.col("x"), F.col("k"), F.col("n")
    # neighbours as pairs, so that each statistic is a plain sum
    d = d.withColumn("pairs", F.arrays_zip(F.slice(x, 1, F.size(x) - 1).alias("u"), F.slice(x, 2, F.size(x) - 1).alias("v")))
    total = lambda xs, f: F.aggregate(F.transform(xs, f), F.lit(0.0), lambda a, y: a + y)
    d = d.withColumns({
        "squares": total(F.array_distinct(x), lambda v: F.pow(F.size(F.filter(x, lambda y: y == v)).cast("double"), F.lit(2.0))),
        "runs": 1 + total(F.col("pairs"), lambda p: ((p["u"] > k / 2) != (p["v"] > k / 2)).cast("double")),
        "n1": total(x, lambda v: (v > k / 2).cast("double")),
        "mean": total(x, lambda v: v) / n,
    })
    mean = F.col("mean")
    d = d.withColumns({
        "chi": k / n * F.col("squares") - n, "df": k - 1, "mu": 2 * F.col("n1") * (n - F.col("n1")) / n + 1,
        "spread": total(x, lambda v: (v - mean) * (v - mean)), "lagged": total(F.col("pairs"), lambda p: (p["u"] - mean) * (p["v"] - mean)),
    })
    chi, df, mu, excess = F.col("chi"), F.col("df"), F.col("mu"), F.col("excess")
    var = (mu - 1) * (mu - 2) / (n - 1)
    d = d.withColumns({
        "z_chi": (F.cbrt(chi / df) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)),
        "z_runs": F.when(var > 0, (F.col("runs") - mu) / F.sqrt(var)).otherwise(F.lit(12.0)),
        "z_serial": F.when(F.col("spread") > 0, (F.try_divide("lagged", "spread") + 1 / n) * F.sqrt(n)).otherwise(F.lit(12.0)),
        "z_text": (chi - df - n * excess) / F.sqrt(2 * df + 4 * n * excess),
    })
    steps, rate = n - 1, F.col("rate")
    kinds = F.regexp_count(token, F.lit("[A-Z]+|[a-z]+|[0-9]+|[^A-Za-z0-9]+")).cast("double") - 1
    d = d.withColumn("z_kinds", (kinds - steps * rate) / F.sqrt(steps * rate * (1 - rate)))
    tail = lambda z: F.log(F.lit(2.0)) + _log_upper(F.abs(z))
    three = F.least(_log_upper(F.col("z_chi")), tail(F.col("z_runs")), tail(F.col("z_serial")))
    d = d.withColumns({"random_log": F.least(F.lit(0.0), F.log(F.lit(3.0)) + three), "text_log": _log_upper((F.col("z_kinds") - F.col("z_text")) / F.sqrt(F.lit(2.0))), "stratum": F.floor(F.log2(n)).cast("int")})
    return d.select(*kept, "text_log", "random_log", "stratum")


def length_aware_levels(tokens: DataFrame, p_log: str, q: float, bins: int = 3000) -> DataFrame:
    """``stratum, level``: natural logarithm of the Benjamini-Hochberg level of each length stratum, from a histogram of p-values.

    P-values are rounded up to one of ``bins`` steps of 0.1 in their base-10
    logarithm, which can only lower a level.  The ordered window sees at most
    ``bins`` rows for each of about 20 strata.  Strata without a discovery have
    no row.
    """
    tenth = math.log(10.0) / 10
    step = F.least(F.lit(bins), F.greatest(F.lit(0), F.floor(-F.col(p_log) / tenth))).cast("int")
    counts = tokens.groupBy("stratum", step.alias("step")).agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("stratum").orderBy(F.desc("step")).rowsBetween(W.unboundedPreceding, W.currentRow)
    counts = counts.withColumn("upto", F.sum("n").over(w)).withColumn("m", F.sum("n").over(W.partitionBy("stratum")))
    edge = -F.col("step") * tenth
    return counts.where(edge + F.log("m") <= math.log(q) + F.log("upto")).groupBy("stratum").agg(F.max(edge).alias("level"))


def _apart(passed: DataFrame, base: DataFrame) -> DataFrame:
    """``passed`` tokens (row, start, end) that overlap no base span of their text, by one ordered pass over the spans of each text."""
    spans = passed.select("row", "start", "end", F.lit(False).alias("is_base")).unionByName(base.select("row", "start", "end", F.lit(True).alias("is_base")))
    order = W.partitionBy("row").orderBy("start", F.desc("is_base"))
    before = F.max(F.when(F.col("is_base"), F.col("end"))).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    after = F.min(F.when(F.col("is_base"), F.col("start"))).over(order.rowsBetween(W.currentRow, W.unboundedFollowing))
    spans = spans.withColumns({"before": F.coalesce(before, F.col("start")), "after": F.coalesce(after, F.col("end"))})
    return spans.where("not is_base and before <= start and after >= end").select("row", "start", "end")


def scan_secrets(docs: DataFrame, q: float = 0.01, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets of every text: the base kinds, and tokens that pass the randomness battery.

    A token (20 or more of ``[A-Za-z0-9+/_-]``, outside the base spans) is a
    ``random`` span if two rounds of Benjamini-Hochberg control at rate ``q``,
    each among all candidate tokens of like length, agree: its battery p-value,
    combined from the three tests, is no discovery of something that is not
    random, and its p-value as written text is a discovery.

    Returns ``doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans``, a
    row for each input row; null and empty texts have no span.  Matches are taken
    from whole texts of any length.  Repeated rows count as rows.  Other input
    columns are not looked at.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    for rank, (kind, pattern, group, least) in enumerate(BASE):
        d = with_spans(d, "text", pattern, kind, rank, group).withColumn(kind, F.filter(kind, _long_enough(kind, least)))
    d = with_spans(d, "text", CANDIDATE, "random", len(BASE))
    slim = lambda c: F.transform(c, lambda s: F.struct(s["start"], s["rank"], s["end"], s["kind"]))
    d = d.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k, *_ in BASE], slim(F.concat(*[k for k, *_ in BASE])).alias("base"), F.col("random").alias("tokens"))
    d = written(d.withColumn("row", F.monotonically_increasing_id()), "secret-spans")

    one = d.where(F.size("tokens") > 0).select("row", F.explode("tokens").alias("span")).select("row", F.col("span.start").alias("start"), F.col("span.end").alias("end"), F.col("span.text").alias("token"))
    one = written(randomness(one).drop("token"), "secret-tests")
    levels = length_aware_levels(one, "text_log", q).join(length_aware_levels(one, "random_log", q).withColumnRenamed("level", "reject"), "stratum", "left")
    levels = F.broadcast(levels)  # a row for each binary order of length
    passed = one.join(levels, "stratum").where((F.col("text_log") <= F.col("level")) & (F.col("reject").isNull() | (F.col("random_log") > F.col("reject"))))
    passed = written(passed.select("row", "start", "end"), "secret-tokens")
    base = d.join(passed.select("row").distinct(), "row", "left_semi").select("row", F.explode("base").alias("span")).select("row", "span.start", "span.end")
    found = _apart(passed, base).groupBy("row").agg(F.collect_list(F.struct("start", F.lit(len(BASE)).alias("rank"), "end", F.lit("random").alias("kind"))).alias("found"))
    d = d.join(found, "row", "left").withColumn("random", F.coalesce("found", F.array()))  # both sides are short rows; only rows with tokens have a partner
    return d.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.size("random").cast("long").alias("n_random"),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "random")).alias("spans"),
    )
