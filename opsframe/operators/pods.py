"""Components, their pods, health and logs."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from opsframe.functions.classify import pod_state
from opsframe.functions.timestamps import parse_log_timestamp
from opsframe.scratch import written
from opsframe.sources.lines import numbered_lines

# Component, exact container names, patterns, namespace, roles, whether it is often absent.
COMPONENTS = (
    ("ts-app", ("ts-app",), (), None, (), False), ("crs-app", ("crs-app",), (), None, (), False), ("ts-web", ("ts-web",), (), None, (), False),
    ("store-web", ("store-web",), (), None, (), False), ("cache-app", ("cache-app",), (), None, (), False), ("tooling-web", ("tooling-web",), (), None, (), True),
    ("search-app", (), (), None, ("search-app-repeater", "search-app-slave"), False), ("search-app-repeater", ("search-app-repeater",), (), None, (), False),
    ("search-app-slave", ("search-app-slave",), (), None, (), False), ("nginx", (), ("nginx",), "nginx", (), False), ("redis", ("redis",), (), "redis", (), False),
    ("wcbd", (), ("wcbd",), None, (), True), ("utils", (), ("^utils?$",), None, (), True),
)
COMPONENT_SCHEMA = "component string, containers array<string>, patterns array<string>, namespace string, roles array<string>, known_optional boolean"


def component_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, list(a), list(p), n, list(r), o) for c, a, p, n, r, o in COMPONENTS], COMPONENT_SCHEMA)


def normalize_component(name: str) -> str:
    """Trimmed and lower-cased; an unknown name is refused."""
    key = name.strip().lower()
    if key not in {c[0] for c in COMPONENTS}:
        raise ValueError(f"unknown component {name!r}")
    return key


def unknown_components(names: DataFrame, components: DataFrame) -> DataFrame:
    key = F.lower(F.trim("name"))
    return names.withColumn("component", key).join(components.select("component"), "component", "left_anti")


def validate_container(component: str, container: str | None) -> str | None:
    """A container to filter by has to belong to the component."""
    if container is None:
        return None
    own = next(c for c in COMPONENTS if c[0] == normalize_component(component))
    leaves = [c for c in COMPONENTS if c[0] in own[4]] or [own]
    import re

    if not any(container in c[1] or any(re.search(p, container, re.I) for p in c[2]) for c in leaves):
        raise ValueError(f"{container!r} is no container of {component!r}")
    return container


def scope_namespace(rows: DataFrame, namespace: str | None) -> DataFrame:
    """One namespace, or all for null, empty or ``all``."""
    return rows.where(F.col("namespace") == namespace) if namespace and namespace != "all" else rows


def expand_roles(components: DataFrame) -> DataFrame:
    """``component, leaf``: role groups become their leaves, others themselves."""
    leaves = F.when(F.size("roles") > 0, F.col("roles")).otherwise(F.array("component"))
    return components.select("component", F.explode(leaves).alias("leaf"))


def match_pods(pods: DataFrame, components: DataFrame, default_namespace: str) -> DataFrame:
    """Pods of each leaf component, with the container that matched.

    Exact container names come first; a component's patterns count only if no pod
    has an exact name of it.  In a pod the first matching container wins.  The
    component table is small and is sent to the pods.  Pods, as they are read from
    texts, and the matches, which several tables are joined to, are written once.
    """
    own = components.where(F.size("roles") == 0).withColumn("_ns", F.coalesce("namespace", F.lit(default_namespace))).drop("namespace")
    boxes = written(pods, "pods").select("*", F.posexplode("containers").alias("_at", "container"))
    exact = boxes.join(F.broadcast(own.select(F.col("component").alias("leaf"), "_ns", F.explode("containers").alias("_name"))), (F.col("namespace") == F.col("_ns")) & (F.col("container") == F.col("_name"))).drop("_name", "_ns")
    rest = own.join(exact.select(F.col("leaf").alias("component")).distinct(), "component", "left_anti")
    rest = rest.select(F.col("component").alias("leaf"), "_ns", F.explode("patterns").alias("_pattern"))
    fuzzy = boxes.join(F.broadcast(rest), (F.col("namespace") == F.col("_ns")) & F.call_function("rlike", F.col("container"), F.concat(F.lit("(?i)"), F.col("_pattern")))).drop("_pattern", "_ns")
    w = W.partitionBy("leaf", "namespace", "pod").orderBy("_at")
    both = exact.unionByName(fuzzy)
    return written(both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_at", "containers"), "matches")


def pod_status_summary(matches: DataFrame, key: str = "leaf") -> DataFrame:
    """Total, pods of each phase, crash-looping, image pull and restarted pods."""
    d = matches.withColumn("_state", pod_state(F.col("phase"), F.col("waiting_reason"), F.col("restart_count")))
    phases = d.groupBy(key, F.coalesce("phase", F.lit("Unknown")).alias("_phase")).agg(F.count(F.lit(1)).alias("_n")).groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_phase", "_n")))).alias("phases"))
    out = d.groupBy(key).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("phase") == "Running").alias("running"), F.count_if(F.col("_state") == "crash_looping").alias("crash_looping"),
        F.count_if(F.col("_state") == "image_pull_backoff").alias("image_pull_backoff"), F.count_if(F.col("restart_count") > 0).alias("pods_with_restarts"),
    )
    return out.join(phases, key)


def releases(matches: DataFrame, key: str = "leaf") -> DataFrame:
    """Distinct releases of each component, and the one there is if it is the only one."""
    r = F.array_sort(F.collect_set("release"))
    return matches.groupBy(key).agg(r.alias("releases")).withColumn("release_single", F.when(F.size("releases") == 1, F.col("releases")[0]))


def component_inventory(components: DataFrame, matches: DataFrame) -> DataFrame:
    """All leaf components, also those without pods: found, not_deployed (often absent) or no_matching_pods."""
    counts = matches.groupBy("leaf").agg(F.count(F.lit(1)).alias("n_pods"))
    own = expand_roles(components).join(components.select(F.col("component").alias("leaf"), "known_optional"), "leaf")
    out = own.join(counts, "leaf", "left").fillna(0, ["n_pods"])
    return out.withColumn("status", F.when(F.col("n_pods") > 0, "found").when(F.col("known_optional"), "not_deployed").otherwise("no_matching_pods"))


def component_health(components: DataFrame, matches: DataFrame) -> DataFrame:
    """not_deployed, no_matching_pods, attention_needed, or healthy: all pods running and none looping or failing to pull."""
    out = component_inventory(components, matches).join(pod_status_summary(matches), "leaf", "left").join(releases(matches), "leaf", "left")
    well = (F.col("running") == F.col("total")) & (F.col("crash_looping") == 0) & (F.col("image_pull_backoff") == 0)
    return out.withColumn("health", F.when(F.col("status") != "found", F.col("status")).when(well, "healthy").otherwise("attention_needed"))


def attach_pod_context(lines: DataFrame, matches: DataFrame) -> DataFrame:
    """Log lines with their pod's component, release, container and restarts; matches are sorted and merged, as their compressed files look small enough to send."""
    return lines.join(matches.select("namespace", "pod", "leaf", "release", "container", "restart_count").hint("merge"), ["namespace", "pod"])


def pair_previous_logs(lines: DataFrame) -> DataFrame:
    """Previous logs count only for pods that restarted."""
    return lines.where((F.col("log_source") == "current") | (F.col("restart_count") > 0))


def first_pods(matches: DataFrame, n: int | None = None) -> DataFrame:
    """Optionally the first n pods of each component, by name."""
    if n is None:
        return matches
    return matches.withColumn("_r", F.row_number().over(W.partitionBy("leaf").orderBy("namespace", "pod"))).where(F.col("_r") <= n).drop("_r")


#: Namespace, pod and log source in a log file's path.
LAYOUT = r"([^/]+)/([^/]+)/([^/]+)\.log$"


def read_pod_logs(
    spark: SparkSession, path: str, since: datetime | None = None, tail: int | None = None, log_source: str | None = None, redactor: Callable[[Column], Column] | None = None, layout: str = LAYOUT
) -> DataFrame:
    """``namespace, pod, log_source, line_no, line`` of log files ``<namespace>/<pod>/<current|previous>.log``, of any size.

    ``since`` keeps a file from its first line whose own time is at or after it:
    lines without a time, as of stack traces, belong to the lines before them.
    A time without an offset is taken as UTC; a file without such a line gives
    none.  ``tail`` then keeps the last lines of each file.  Both know a file's
    line count, so no window sorts its lines.  ``redactor`` is applied to whole
    lines, before anything can cut them.
    """
    d = numbered_lines(spark, path)
    d = d.select("*", *[F.regexp_extract("path", layout, i + 1).alias(c) for i, c in enumerate(("namespace", "pod", "log_source"))])
    if log_source:
        d = d.where(F.col("log_source") == log_source)
    if since is not None:
        p = parse_log_timestamp(F.col("line"))
        at = F.coalesce(p["ts_utc"].cast("timestamp"), p["ts_local"].cast("timestamp"))
        first = d.where(at >= F.lit(since).cast("timestamp")).groupBy("path").agg(F.min("line_no").alias("_first"))
        d = d.join(first, "path").where(F.col("line_no") >= F.col("_first"))
    if tail is not None:
        d = d.where(F.col("line_no") >= F.col("n_lines") - tail)
    return d.select("namespace", "pod", "log_source", "line_no", (redactor(F.col("line")) if redactor else F.col("line")).alias("line"))
