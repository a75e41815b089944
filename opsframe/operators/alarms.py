"""Alarms, their states and their history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from opsframe.functions.ranges import TimeRange

STATES = ("OK", "ALARM", "INSUFFICIENT_DATA")
HISTORY_TYPES = ("StateUpdate", "Action", "ConfigurationUpdate")
ACTION_COLUMNS = ("alarm_actions", "ok_actions", "insufficient_data_actions")


def read_alarms(metric: DataFrame, composite: DataFrame | None = None, state: str | None = None, name_prefix: str | None = None, limit: int | None = None) -> DataFrame:
    """Metric and composite alarms in one table; targets of actions are left out."""
    out = metric.withColumn("type", F.lit("metric"))
    if composite is not None:
        out = out.unionByName(composite.withColumn("type", F.lit("composite")), allowMissingColumns=True)
    if state is not None:
        if state not in STATES:
            raise ValueError(f"unknown state {state!r}")
        out = out.where(F.col("state") == state)
    if name_prefix:
        out = out.where(F.col("name").startswith(name_prefix))
    out = out.drop(*ACTION_COLUMNS)
    return out.orderBy("name").limit(limit) if limit else out


def read_alarm_history(history: DataFrame, alarm: str | None = None, within: TimeRange | None = None, history_type: str | None = None, limit: int | None = None) -> DataFrame:
    """Rows newest first; ``new_state`` comes from the JSON of state updates and is null for other rows or bad JSON."""
    if history_type is not None and history_type not in HISTORY_TYPES:
        raise ValueError(f"unknown history type {history_type!r}")
    if alarm is not None:
        history = history.where(F.col("alarm_name") == alarm)
    if within:
        history = history.where(within.holds(F.col("ts")))
    if history_type:
        history = history.where(F.col("type") == history_type)
    out = history.withColumn("new_state", F.when(F.col("type") == "StateUpdate", F.get_json_object("history_data", "$.newState.stateValue")))
    out = out.orderBy(F.desc("ts"), "alarm_name", "type", "history_data")  # equal times by content, so that a limit gives the same rows again
    return out.limit(limit) if limit else out


def alarm_state_counts(alarms: DataFrame, shown: int = 20) -> DataFrame:
    """``state, n, names``: alarms of each state, and the first names of those in ALARM."""
    counts = alarms.groupBy("state").agg(F.count(F.lit(1)).alias("n"))
    first = alarms.where("state = 'ALARM'").orderBy("name").limit(shown).groupBy("state").agg(F.array_sort(F.collect_list("name")).alias("names"))
    return counts.join(first, "state", "left")


def alarm_transitions(history: DataFrame, flapping_at: int = 5) -> DataFrame:
    """For all alarms at once: rows that go into ALARM, and whether they are so many that the alarm flaps."""
    n = F.count_if(F.col("new_state") == "ALARM")
    return history.groupBy("alarm_name").agg(n.alias("to_alarm"), (n >= flapping_at).alias("flapping"))


def state_changes(states: DataFrame) -> DataFrame:
    """Rows of ``alarm_name, ts, state`` at which an alarm's state differs from the one before."""
    w = W.partitionBy("alarm_name").orderBy("ts", "event_id")
    return states.withColumn("_last", F.lag("state").over(w)).where(F.col("_last").isNull() | (F.col("_last") != F.col("state"))).drop("_last")
