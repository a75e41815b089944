"""Log events, groups and streams.  Events: ``ts, log_group, log_stream, message`` and a key ``event_id`` that settles ties."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from opsframe.functions.match import Match, extract_status_code, name_allowlist, term_filter, term_keys
from opsframe.functions.ranges import TimeRange, bin_start
from opsframe.functions.redact import sanitize_text
from opsframe.operators.ordered import RANGE_ROWS, running_sums

# Name hints of log group categories.
CATEGORIES = {
    "hcl_commerce": ("commerce", "ts-app", "ts-web", "ts-utils", "search-app", "query-app", "crs-app", "xc-app", "hcl", "websphere", "liberty", "wcs"),
    "solr": ("solr", "search-app"), "redis": ("redis", "elasticache", "valkey"), "nginx": ("nginx", "ingress"),
    "eks": ("/aws/eks", "eks", "containerinsights", "kubernetes", "k8s"), "ec2": ("/aws/ec2", "ec2", "cloudwatch-agent", "/var/log"),
    "alb_nlb": ("elb", "alb", "nlb", "loadbalancer", "load-balancer"), "cloudfront": ("cloudfront", "cdn"), "waf": ("waf", "aws-waf-logs"),
    "lambda": ("/aws/lambda",), "rds": ("/aws/rds", "rds", "db2", "postgres", "mysql"), "vpc_flow": ("vpc", "flowlog", "flow-log"),
    "route53": ("route53",), "sns_ses": ("sns", "ses"),
}


def read_log_events(events: DataFrame, groups: list[str] | None = None, within: TimeRange | None = None, stream_prefix: str | None = None, pattern: str | None = None, redactor: Callable[[Column], Column] | None = None) -> DataFrame:
    """Events of the groups (each asked once) in the range; only the range, groups and prefix reach the scan.

    ``redactor`` is applied to whole messages, after the pattern has seen them.
    """
    if groups:
        events = events.where(F.col("log_group").isin(*dict.fromkeys(groups)))
    if within:
        events = events.where(within.holds(F.col("ts")))
    if stream_prefix:
        events = events.where(F.col("log_stream").startswith(stream_prefix))
    events = events.where(term_filter(F.col("message"), pattern)) if pattern else events
    return events.withColumn("message", redactor(F.col("message"))) if redactor else events


def read_log_groups(catalog: DataFrame, prefix: str | None = None, globs: tuple[str, ...] = ()) -> DataFrame:
    if prefix:
        catalog = catalog.where(F.col("name").startswith(prefix))
    return catalog.where(name_allowlist(F.col("name"), globs))


def discover_log_groups(catalog: DataFrame, keyword: str | None = None, category: str | None = None, prefix: str | None = None, limit: int | None = 100, globs: tuple[str, ...] = ()) -> DataFrame:
    """Groups whose name holds the keyword or a hint of the category, by name."""
    terms = [keyword.lower()] if keyword else []
    if category:
        key = category.strip().lower().replace("-", "_").replace(" ", "_")
        if key not in CATEGORIES:
            raise ValueError(f"unknown category {category!r}")
        terms += CATEGORIES[key]
    found = read_log_groups(catalog, prefix, globs)
    if terms:
        found = found.where(F.lower("name").rlike("|".join(map(re.escape, terms))))
    found = found.orderBy("name")
    return found.limit(limit) if limit else found


def group_categories(catalog: DataFrame) -> DataFrame:
    """All categories of all groups: ``name, category``, a row for each that applies."""
    return catalog.select("name", F.explode(term_keys(F.lower("name"), CATEGORIES)).alias("category"))


def never_expire_report(catalog: DataFrame) -> DataFrame:
    return catalog.where(F.col("retention_days").isNull())


def check_groups(requested: DataFrame, catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requested names (``name``) with the catalog's retention, and those that the catalog lacks."""
    names = requested.select("name").distinct()
    return names.join(catalog.select("name", "retention_days"), "name"), names.join(catalog, "name", "left_anti")


def list_log_streams(events: DataFrame, group: str, prefix: str | None = None, limit: int | None = 25) -> DataFrame:
    """Streams of a group: by name with a prefix, else those with the newest event first."""
    own = events.where(F.col("log_group") == group)
    if prefix:
        own = own.where(F.col("log_stream").startswith(prefix))
    out = own.groupBy("log_stream").agg(F.min("ts").alias("first_event"), F.max("ts").alias("last_event"), F.sum(F.octet_length("message")).alias("stored_bytes"))
    out = out.orderBy("log_stream") if prefix else out.orderBy(F.desc("last_event"), "log_stream")
    return out.limit(limit) if limit else out


def read_stream_events(events: DataFrame, group: str, stream: str, limit: int, from_head: bool = False, within: TimeRange | None = None) -> DataFrame:
    """The newest, or from the head the oldest, events of one stream, in ascending order."""
    own = read_log_events(events, [group], within).where(F.col("log_stream") == stream)
    order = [F.asc("ts"), F.asc("event_id")] if from_head else [F.desc("ts"), F.desc("event_id")]
    return own.orderBy(*order).limit(limit).orderBy("ts", "event_id")


def count_over_time(events: DataFrame, match: Match, bin_seconds: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Matching events in each bin (epoch second of its start), and by further keys."""
    hit = events.where(match.on(F.col("message")))
    return hit.groupBy(*keys, bin_start(F.col("ts"), bin_seconds).alias("bin")).agg(F.count(F.lit(1)).alias("matches"))


def count_by(events: DataFrame, match: Match, dimension: str, top_n: int | None = 10) -> DataFrame:
    """Matching events by ``log_group``, ``log_stream`` or ``status_code``, largest first."""
    if dimension not in ("log_group", "log_stream", "status_code"):
        raise ValueError(f"unknown dimension {dimension!r}")
    if dimension == "status_code" and not match.status_codes:
        raise ValueError("counting by status code needs status codes")
    hit = events.where(match.on(F.col("message")))
    key = extract_status_code(F.col("message"), match.status_codes) if dimension == "status_code" else F.col(dimension)
    out = hit.groupBy(key.alias(dimension)).agg(F.count(F.lit(1)).alias("matches")).where(F.col(dimension).isNotNull())
    out = out.orderBy(F.desc("matches"), dimension)
    return out.limit(top_n) if top_n else out


def shares(counts: DataFrame, label: str, count: str) -> DataFrame:
    """Share in percent of the total of the rows given (few: they are a report)."""
    total = F.sum(count).over(W.partitionBy())
    return counts.select(label, count, F.when(total > 0, F.bround(100 * F.col(count) / total, 1)).otherwise(0.0).alias("share_pct"))


def sample_events(events: DataFrame, match: Match, limit: int = 20, max_chars: int = 500, redactor: Callable[[Column], Column] | None = None) -> DataFrame:
    """Newest matching events; messages are redacted, then cut, after the limit."""
    newest = events.where(match.on(F.col("message"))).orderBy(F.desc("ts"), "event_id").limit(limit)
    message = redactor(F.col("message")) if redactor else F.col("message")
    return newest.withColumn("message", sanitize_text(message, max_chars))


def fair_limit(events: DataFrame, limit: int, n_groups: int) -> DataFrame:
    """The first max(1, limit // groups) events of each group; the ranking window stops at that number."""
    w = W.partitionBy("log_group").orderBy("ts", "event_id")
    return events.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= max(1, limit // max(n_groups, 1))).drop("_rank")


def size_budget(rows: DataFrame, size: Column, budget: int, order: list[str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """Rows up to the first whose running size exceeds the budget; sizes run in ranges of the order."""
    return running_sums(rows, order, size, "_upto", range_rows=range_rows).where(F.col("_upto") <= budget).drop("_upto")


def search_coverage(found: DataFrame, returned: DataFrame) -> DataFrame:
    """Per group: rows returned, and whether more were found than that."""
    a = found.groupBy("log_group").agg(F.count(F.lit(1)).alias("found"))
    b = returned.groupBy("log_group").agg(F.count(F.lit(1)).alias("returned"))
    n = F.coalesce("returned", F.lit(0))
    return a.join(b, "log_group", "left").select("log_group", n.alias("returned"), (F.col("found") > n).alias("more_available"))


def estimate_scan(events: DataFrame, groups: list[str] | None, within: TimeRange | None, query_cap: int, per_gb: float, catalog: DataFrame | None = None) -> DataFrame:
    """Bytes that a search would read in each group, before any match, with verdict and price; two columns are read."""
    scope = read_log_events(events, groups, within)
    out = scope.groupBy("log_group").agg(F.sum(F.octet_length("message")).cast("long").alias("bytes"))
    out = out.withColumn("verdict", F.when(F.col("bytes") > query_cap, "too_large").otherwise("ok")).withColumn("price", F.round(F.col("bytes") / 1e9 * per_gb, 6))
    if catalog is not None and within is not None:
        days = within.seconds / 86400
        out = out.join(catalog.select(F.col("name").alias("log_group"), (F.col("retention_days") < days).alias("retention_shorter")), "log_group", "left")
    return out
