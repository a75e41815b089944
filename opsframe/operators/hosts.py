"""Host snapshots: processes, services, event logs, disks and health, for a whole fleet (``host`` column)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from opsframe.functions.classify import event_type_name


def top_processes(processes: DataFrame, by: str = "memory_percent", limit: int = 10) -> DataFrame:
    """Per host the ``limit`` processes with the largest share; null counts as 0."""
    w = W.partitionBy("host").orderBy(F.desc(F.coalesce(F.col(by), F.lit(0.0))), "pid")
    return processes.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max(1, limit))


def find_process(processes: DataFrame, text: str) -> DataFrame:
    return processes.where(F.contains(F.lower("name"), F.lit(text.lower()))).orderBy("host", "pid")


def list_services(services: DataFrame, status: str | None = None, text: str | None = None) -> DataFrame:
    if status:
        services = services.where(F.lower("status") == status.lower())
    if text:
        services = services.where(F.contains(F.lower("name"), F.lit(text.lower())))
    return services.orderBy("host", F.lower("name"))


def recent_host_events(events: DataFrame, log: str, limit: int = 20, level: str | None = None) -> DataFrame:
    """Per host the newest events of a log, with the level's name and messages cut at 300 characters."""
    if log not in ("System", "Application"):
        raise ValueError(f"unknown log {log!r}")
    d = events.where(F.col("log") == log).withColumn("level", event_type_name(F.col("event_type")))
    if level:
        d = d.where(F.lower("level") == level.lower())
    w = W.partitionBy("host").orderBy(F.desc("ts"), F.desc("record_id"))
    return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).withColumn("message", F.substring("message", 1, 300))


def disk_usage(disks: DataFrame) -> DataFrame:
    return disks.withColumns({"free": F.col("total") - F.col("used"), "percent": F.when(F.col("total") > 0, 100.0 * F.col("used") / F.col("total")).otherwise(0.0)})


def health_flags(hosts: DataFrame, limit: float = 90.0) -> DataFrame:
    """``warnings`` for cpu, memory and disk shares at the limit or over, and Healthy or Warning."""
    disk = F.when(F.col("disk_total") > 0, 100.0 * F.col("disk_used") / F.col("disk_total")).otherwise(0.0)
    shares = {"cpu": F.col("cpu_percent"), "memory": F.col("memory_percent"), "disk": disk}
    flags = F.array_compact(F.array(*[F.when(v >= limit, F.lit(f"High {k} usage")) for k, v in shares.items()]))
    return hosts.withColumns({"disk_percent": disk, "warnings": flags}).withColumn("status", F.when(F.size("warnings") > 0, "Warning").otherwise("Healthy"))
