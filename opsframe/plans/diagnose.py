"""Component logs, error correlation and diagnosis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsframe.functions.classify import confidence
from opsframe.functions.redact import cap_text, redact_secrets
from opsframe.operators.findings import classify_logs, classify_warning_events, co_occurring_categories, lines_scanned, log_coverage, tail_per_pod
from opsframe.operators.pods import attach_pod_context, component_health, first_pods, pair_previous_logs
from opsframe.plans.knowledge import attach_knowledge
from opsframe.scratch import written


def _component_lines(lines: DataFrame, matches: DataFrame, max_pods: int | None = None) -> DataFrame:
    """All lines of the components' pods with context, whole."""
    return pair_previous_logs(attach_pod_context(lines, first_pods(matches, max_pods)))


def component_logs(lines: DataFrame, matches: DataFrame, tail: int | None = 1000, max_pods: int | None = None, max_chars: int = 500) -> tuple[DataFrame, DataFrame]:
    """Redacted, then cut, lines of the components' pods with context, and their coverage.  ``tail`` None: all lines."""
    own = _component_lines(lines, matches, max_pods)
    own = tail_per_pod(own, tail, ("namespace", "pod", "log_source")) if tail is not None else own
    return own.withColumn("line", cap_text(redact_secrets(F.col("line")), max_chars, "")), log_coverage(own, tail, ("namespace", "pod"))[0]


def component_errors(lines: DataFrame, matches: DataFrame, tail: int | None = None) -> DataFrame:
    """Findings by leaf component over all its pods' whole lines; line order is by pod, then line.  ``tail``: last lines only of each pod and source."""
    own = _component_lines(lines, matches)
    own = tail_per_pod(own, tail, ("namespace", "pod", "log_source")) if tail is not None else own
    order = F.xxhash64("namespace", "pod", "log_source")
    return classify_logs(own.withColumn("line_no", F.struct(order.alias("source"), "line_no")), ("leaf",))


def diagnose(components: DataFrame, matches: DataFrame, lines: DataFrame, events: DataFrame, knowledge: DataFrame, wanted: list[str] | None = None, tail: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three tables: components (health, findings, confidence), classified warning events, guidance by category.

    Confidence is given for each component by itself.  Events do not add
    components to the categories that several components share.  All warning
    events are classified and all their categories have guidance; a report may
    limit the second table.
    """
    if wanted:
        components = components.where(F.col("component").isin(*wanted) | F.exists(F.array(*map(F.lit, wanted)), lambda w: F.array_contains("roles", w)))
    errors = written(component_errors(lines, matches, tail), "errors")  # a row for each component and category
    found = errors.groupBy("leaf").agg(F.count(F.lit(1)).alias("n_categories"), F.array_sort(F.collect_set("category")).alias("categories"))
    scanned = lines_scanned(attach_pod_context(lines, matches), ("leaf",))
    health = component_health(components, matches).join(found, "leaf", "left").join(scanned, "leaf", "left").fillna(0, ["n_categories", "lines_scanned"])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    health = health.withColumns({"confidence": confidence(zero("total"), zero("running"), F.col("n_categories")), "none_running": (zero("total") > 0) & (zero("running") == 0)})
    warned = classify_warning_events(events, None)
    shared = co_occurring_categories(errors, "leaf")
    seen = errors.select("category").unionByName(warned.select("category")).where("category <> 'unclassified'").distinct()
    guidance = attach_knowledge(seen, knowledge).join(shared, "category", "left")
    return health, warned, guidance
