"""Cluster snapshots in text columns, and JSON listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsframe.functions.classify import strip

NONE = "<none>"
# Column order of the workload snapshots.
WORKLOADS = {
    "deployment": ("desired", "ready", "available", "updated"),
    "replicaset": ("desired", "ready", "available"),
    "statefulset": ("desired", "ready", "available", "updated"),
    "daemonset": ("desired", "ready", "available", "updated"),
}


def _cells(lines: DataFrame) -> Column:
    return F.split(strip(F.col("value")), r"\s+")


def _optional(cell: Column) -> Column:
    return F.when(~cell.isin(NONE, ""), cell)


def _list(cell: Column) -> Column:
    return F.when(cell.isin(NONE, ""), F.array().cast("array<string>")).otherwise(F.split(cell, ","))


def parse_pods_lenient(lines: DataFrame) -> DataFrame:
    """Eight columns of white-space separated text; shorter rows are skipped.

    ``value`` is a line.  Restarts are the largest of the numbers that can be
    read (0 without any), the waiting reason is the first that is given.
    """
    whole = F.filter(F.array(_cells(lines)), lambda c: F.size(c) >= 8)  # not a condition, which Spark computes once more and before the lines are dealt
    d = lines.withColumn("_c", F.explode(whole))
    c = [F.get("_c", F.lit(i)) for i in range(8)]
    restarts = F.array_compact(F.transform(_list(c[5]), lambda x: x.try_cast("int")))
    waiting = F.filter(_list(c[6]), lambda x: ~x.isin(NONE, ""))
    return d.select(
        *[x for x in lines.columns if x != "value"], c[0].alias("pod"), c[1].alias("namespace"), _optional(c[2]).alias("phase"), _optional(c[3]).alias("release"),
        _optional(c[4]).alias("release_group"), F.coalesce(F.array_max(restarts), F.lit(0)).alias("restart_count"), F.get(waiting, F.lit(0)).alias("waiting_reason"), _list(c[7]).alias("containers"),
    )


def withhold_on_bad_row(rows: DataFrame, valid: Column, key: str = "snapshot_id") -> tuple[DataFrame, DataFrame]:
    """Rows of the snapshots in which all rows are valid, and the withheld snapshots; nothing is dropped row by row."""
    marked = rows.withColumn("_ok", F.coalesce(valid, F.lit(False)))
    bad = marked.groupBy(key).agg(F.bool_and("_ok").alias("_all"), F.count_if(~F.col("_ok")).alias("bad_rows")).where(~F.col("_all")).select(key, "bad_rows")
    return marked.join(bad, key, "left_anti").drop("_ok"), bad.withColumn("error", F.lit("malformed row: snapshot withheld"))


def _lines(snapshots: DataFrame, key: str) -> DataFrame:
    """Lines of whole snapshot texts (``key, text``); a text that only says that nothing was found has none."""
    text = F.when(strip(F.col("text")).rlike("^No resources found"), F.lit(None)).otherwise(F.regexp_replace("text", r"\r?\n\z", ""))
    return snapshots.select(key, F.posexplode(F.split(text, r"\r?\n")).alias("line_no", "value")).where("value is not null")


def parse_pods_strict(snapshots: DataFrame, columns: int = 9, key: str = "snapshot_id") -> tuple[DataFrame, DataFrame]:
    """Pods of whole snapshots of eight or nine columns; a malformed row withholds its snapshot.

    Nine columns: name, namespace, phase, ip, node, containers, images, ready,
    restarts; containers go with images and flags by place.
    """
    d = _lines(snapshots, key)
    d = d.withColumn("_c", _cells(d))
    c = [F.get("_c", F.lit(i)) for i in range(columns)]
    required = F.lit(True)
    for x in c[:3]:
        required = required & ~x.isin(NONE, "")
    number = lambda xs: F.transform(xs, lambda x: x.try_cast("int"))
    whole = lambda xs: ~F.exists(number(xs), lambda x: x.isNull() | (x < 0))
    if columns == 8:
        restarts = _list(c[5])
        valid = (F.size("_c") == 8) & required & whole(restarts) & (F.size(_list(c[7])) > 0)
        waiting = F.filter(_list(c[6]), lambda x: ~x.isin(NONE, ""))
        fields = [_optional(c[3]).alias("release"), _optional(c[4]).alias("release_group"), F.get(waiting, F.lit(0)).alias("waiting_reason"), _list(c[7]).alias("containers")]
    else:
        names, images, ready, restarts = (_list(x) for x in c[5:9])
        flags = ~F.exists(ready, lambda x: ~x.isin("true", "false"))
        same = (F.size(names) == F.size(images)) & F.when(F.size(ready) > 0, F.size(ready) == F.size(names)).otherwise(True) & (F.size(restarts) == F.size(ready))
        valid = (F.size("_c") == 9) & required & (F.size(names) > 0) & flags & whole(restarts) & same
        pairs = F.transform(F.arrays_zip(names.alias("name"), images.alias("image")), lambda p: F.struct(p["name"].alias("name"), p["image"].alias("image")))
        count = F.struct(F.size(F.filter(ready, lambda x: x == "true")).alias("ready_count"), F.size(names).alias("total_count"))
        fields = [_optional(c[3]).alias("pod_ip"), _optional(c[4]).alias("node"), pairs.alias("containers"), count.alias("ready")]
    rows = d.select(key, "line_no", valid.alias("_valid"), c[0].alias("pod"), c[1].alias("namespace"), c[2].alias("phase"), *fields, F.coalesce(F.array_max(number(restarts)), F.lit(0)).alias("restart_count"))
    good, bad = withhold_on_bad_row(rows, F.col("_valid"), key)
    return good.drop("_valid"), bad


def parse_workloads(snapshots: DataFrame, kind: str, key: str = "snapshot_id") -> tuple[DataFrame, DataFrame]:
    """Workloads of one kind; counts that are not given are null, not 0.  A malformed row withholds its snapshot."""
    counts = WORKLOADS[kind]
    d = _lines(snapshots, key)
    d = d.withColumn("_c", _cells(d))
    n = 2 + len(counts) + 2
    c = [F.get("_c", F.lit(i)) for i in range(n)]
    number = {name: _optional(c[2 + i]).try_cast("int") for i, name in enumerate(counts)}
    readable = F.lit(True)
    for i, name in enumerate(counts):
        given = c[2 + i] != NONE
        readable = readable & F.when(given, number[name].isNotNull() & (number[name] >= 0)).otherwise(name not in ("desired",))
    names, images = _list(c[n - 2]), _list(c[n - 1])
    valid = (F.size("_c") == n) & ~c[0].isin(NONE, "") & ~c[1].isin(NONE, "") & readable & (F.size(names) == F.size(images)) & (F.size(names) > 0)
    pairs = F.transform(F.arrays_zip(names.alias("name"), images.alias("image")), lambda p: F.struct(p["name"].alias("name"), p["image"].alias("image")))
    given = {name: (F.coalesce(number[name], F.lit(0)) if name == "ready" else number[name]) for name in counts}
    extra = [] if "updated" in counts else [F.lit(None).cast("int").alias("updated")]
    rows = d.select(key, "line_no", valid.alias("_valid"), F.lit(kind).alias("kind"), c[0].alias("name"), c[1].alias("namespace"), *[v.alias(k) for k, v in given.items()], *extra, pairs.alias("containers"))
    good, bad = withhold_on_bad_row(rows, F.col("_valid"), key)
    return good.drop("_valid"), bad


# Kinds of listings, and those of the whole cluster, which have no namespace.
KINDS = (
    "Namespace", "Node", "Pod", "Deployment", "Service", "Ingress", "HorizontalPodAutoscaler", "Event", "ReplicaSet", "StatefulSet", "DaemonSet", "Job", "CronJob", "Endpoints", "EndpointSlice",
    "NetworkPolicy", "PodDisruptionBudget", "ConfigMap", "Secret", "PersistentVolume", "PersistentVolumeClaim", "StorageClass", "ServiceAccount", "Role", "RoleBinding", "ClusterRole", "ClusterRoleBinding",
)
CLUSTER_KINDS = ("Namespace", "Node", "PersistentVolume", "StorageClass", "ClusterRole", "ClusterRoleBinding")


def read_k8s_list(spark: SparkSession, path: str, kind: str | None = None, namespace: str | None = None, fields: dict[str, tuple[str, str]] | None = None, multi_line: bool = True) -> DataFrame:
    """A row for each item of JSON listings of any kind: ``kind, name, namespace, created, item`` and the asked fields.

    A listing is read into one VARIANT, whatever its kind, and its items are
    exploded from there; no schema is inferred and no list of items is built.
    ``fields`` maps a column to a path in the item and a type; a path that is
    missing, or of another type, gives null.  ``kind`` keeps items of one kind,
    an item's own or else its list's; ``namespace`` keeps one namespace, or all for
    ``all``; kinds of the whole cluster have none and are always kept.  Of secrets
    only names and the keys of their data leave: ``item`` and all fields are null,
    ``secret_keys`` has the keys.  A file that is no JSON has no items.
    ``multi_line`` False: one listing in each line of a file.
    """
    if kind is not None and kind not in KINDS:
        raise ValueError(f"unknown kind {kind!r}")
    listing = spark.read.option("singleVariantColumn", "doc").option("multiLine", multi_line).json(path)
    get = lambda c, at, to: F.try_variant_get(F.col(c), at, to)
    d = listing.select(get("doc", "$.items", "variant").alias("items"), F.regexp_replace(get("doc", "$.kind", "string"), "List$", "").alias("list_kind"))
    d = d.lateralJoin(spark.tvf.variant_explode(F.col("items").outer())).select("list_kind", F.col("value").alias("item"))
    d = d.withColumn("kind", F.coalesce(get("item", "$.kind", "string"), F.nullif(F.col("list_kind"), F.lit(""))))
    d = d.withColumns({"name": get("item", "$.metadata.name", "string"), "namespace": get("item", "$.metadata.namespace", "string"), "created": get("item", "$.metadata.creationTimestamp", "string")})
    if kind is not None:
        d = d.where(F.col("kind") == kind)
    if namespace and namespace != "all":
        d = d.where((F.col("namespace") == namespace) | F.col("kind").isin(*CLUSTER_KINDS))
    hidden = F.coalesce(F.col("kind") == "Secret", F.lit(False))
    keys = F.map_keys(F.from_json(F.to_json(get("item", "$.data", "variant")), "map<string,string>"))
    shown = {c: F.when(~hidden, get("item", at, to)) for c, (at, to) in (fields or {}).items()}
    return d.select("kind", "name", "namespace", "created", *[v.alias(c) for c, v in shown.items()], F.when(hidden, F.array_sort(keys)).alias("secret_keys"), F.when(~hidden, F.col("item")).alias("item"))


def pod_summary(pods: DataFrame) -> DataFrame:
    """``ready`` as r/n, most restarts and first waiting reason, from ``containerStatuses``."""
    s = F.coalesce("containerStatuses", F.array())
    waiting = F.filter(F.transform(s, lambda x: x["state"]["waiting"]["reason"]), lambda x: x.isNotNull() & (x != ""))
    ready = F.concat_ws("/", F.size(F.filter(s, lambda x: F.coalesce(x["ready"], F.lit(False)))).cast("string"), F.size(s).cast("string"))
    return pods.withColumns({"ready": ready, "restarts": F.coalesce(F.array_max(F.transform(s, lambda x: F.coalesce(x["restartCount"], F.lit(0)))), F.lit(0)), "waiting": F.get(waiting, F.lit(0))})


def cells_to_rows(results: DataFrame, fields: tuple[str, ...], cells: str = "cells") -> DataFrame:
    """A column for each field of ``cells``, a list of (field, value); pointers and empty names are dropped, the last of equal names counts."""
    kept = F.filter(cells, lambda c: c["field"].isNotNull() & ~c["field"].isin("@ptr", ""))
    last = lambda name: F.element_at(F.filter(kept, lambda c: c["field"] == name), -1)["value"]
    some = lambda name: F.exists(kept, lambda c: c["field"] == name)
    return results.select(*[c for c in results.columns if c != cells], *[F.when(some(f), last(f)).alias(f) for f in fields])
