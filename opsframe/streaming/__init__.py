"""Stream forms of operators: event-time windows, stateless matching and redaction, state changes, sessions."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from opsframe.functions.match import Match
from opsframe.functions.redact import sanitize_text


def count_stream(events: DataFrame, match: Match, bin_seconds: int, late: str = "10 minutes", keys: tuple[str, ...] = ()) -> DataFrame:
    """Matching events in each bin of a stream; a bin is given out once it can no longer change."""
    hit = events.withWatermark("ts", late).where(match.on(F.col("message")))
    out = hit.groupBy(F.window("ts", f"{bin_seconds} seconds"), *keys).agg(F.count(F.lit(1)).alias("matches"))
    return out.select(*keys, F.unix_seconds("window.start").alias("bin"), "matches")


def sample_stream(events: DataFrame, match: Match, max_chars: int = 500) -> DataFrame:
    """Matching events with sanitised messages, without state."""
    return events.where(match.on(F.col("message"))).withColumn("message", sanitize_text(F.col("message"), max_chars))


#: An alarm's last state before what waits, and the rows that wait for the watermark.
_WAITING = "last string, ts array<long>, event_id array<long>, state array<string>"
_CHANGES = "alarm_name string, event_id long, micros long, state string"


def _changes(key: tuple, arrivals: Iterable[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
    """Rows up to the watermark in their order; those whose state differs from the one before go out, later ones wait."""
    last, *waiting = group.get if group.exists else (None, [], [], [])
    rows = list(zip(*waiting, strict=True))
    for pdf in arrivals:
        rows += zip(pdf["micros"].tolist(), pdf["event_id"].tolist(), pdf["state"].tolist(), strict=True)
    upto = group.getCurrentWatermarkMs() * 1000
    rows.sort()
    ready = [r for r in rows if r[0] <= upto]
    rows = rows[len(ready) :]
    out = []
    for micros, event_id, state in ready:
        if state != last:
            out.append((key[0], event_id, micros, state))
        last = state
    group.update((last, *map(list, zip(*rows, strict=True))) if rows else (last, [], [], []))
    if rows:  # called again when the watermark has passed the first row that waits
        group.setTimeoutTimestamp(rows[0][0] // 1000 + 1)
    yield pd.DataFrame(out, columns=["alarm_name", "event_id", "micros", "state"]).astype({"event_id": "int64", "micros": "int64"})


def state_change_stream(states: DataFrame, late: str = "1 hour") -> DataFrame:
    """``alarm_name, event_id, ts, state``: rows at which an alarm's state differs from the one before, across micro-batches.

    Keyed state holds an alarm's last state and the rows that are newer than the
    watermark; they are put in order of ``ts`` and ``event_id`` once nothing older
    can come, so rows that are late by less than ``late`` take their places.
    Later ones are dropped.  An alarm's first row is a change.
    """
    s = states.withWatermark("ts", late).withColumn("micros", F.unix_micros("ts")).select("alarm_name", "ts", "event_id", "micros", "state")
    out = s.groupBy("alarm_name").applyInPandasWithState(_changes, _CHANGES, _WAITING, "append", GroupStateTimeout.EventTimeTimeout)
    return out.select("alarm_name", "event_id", F.timestamp_micros("micros").alias("ts"), "state")


def transition_stream(states: DataFrame, late: str = "1 hour") -> DataFrame:
    """The changes into ALARM of ``state_change_stream``: an alarm that stays in ALARM does not go into it again."""
    return state_change_stream(states, late).where("state = 'ALARM'")


def session_stream(rows: DataFrame, gap_seconds: int, keys: tuple[str, ...], late: str = "10 minutes") -> DataFrame:
    """Chains of rows of a key with gaps of at most ``gap_seconds``."""
    s = rows.withWatermark("ts", late).groupBy(F.session_window("ts", f"{gap_seconds} seconds"), *keys)
    return s.agg(F.count(F.lit(1)).alias("evidence_count"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at")).drop("session_window")
