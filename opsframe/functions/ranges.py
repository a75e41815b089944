"""Time ranges, bins and periods.  Ranges are fixed by arguments; only bins are computed per row."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}
_LOOKBACK = re.compile(r"\s*(?:last\s+)?(\d+)\s*([smhdw])[a-z]*\s*", re.I)
PERIODS = (60, 300, 900, 3600, 21600, 86400)


@dataclass(frozen=True)
class TimeRange:
    start: datetime
    end: datetime
    relative: bool = False

    @property
    def seconds(self) -> float:
        return (self.end - self.start).total_seconds()

    def holds(self, ts: Column) -> Column:
        """Both ends included; literals, so that the scan can prune by them."""
        return ts.between(F.lit(self.start), F.lit(self.end))


def parse_lookback(text: str) -> timedelta:
    m = _LOOKBACK.fullmatch(text)
    if not m or int(m[1]) == 0:
        raise ValueError(f"not a lookback: {text!r}")
    return timedelta(seconds=int(m[1]) * _UNITS[m[2].lower()])


def _instant(text: str | datetime) -> datetime:
    t = text if isinstance(text, datetime) else datetime.fromisoformat(text.strip().replace("Z", "+00:00"))
    return t if t.tzinfo else t.replace(tzinfo=timezone.utc)


def resolve_range(lookback: str | None = None, start: str | datetime | None = None, end: str | datetime | None = None, *, now: datetime, default_minutes: int = 60, max_hours: float = 24) -> TimeRange:
    """A range from a lookback ("15m", "last 6h", "7d") or from explicit ends.

    ``end`` alone is refused, as are empty ranges and those over ``max_hours``; an
    end after ``now`` is cut there.
    """
    now = _instant(now)
    if end is not None and start is None:
        raise ValueError("an end needs a start")
    if start is not None:
        found = TimeRange(_instant(start), min(_instant(end), now) if end is not None else now)
    else:
        found = TimeRange(now - (parse_lookback(lookback) if lookback else timedelta(minutes=default_minutes)), now, True)
    if found.seconds <= 0:
        raise ValueError("the range is empty")
    if found.seconds > max_hours * 3600:
        raise ValueError(f"the range is longer than {max_hours} hours")
    return found


def align_range(r: TimeRange) -> TimeRange:
    """Relative ranges start and end on a full minute; their length stays."""
    if not r.relative:
        return r
    end = r.end.replace(second=0, microsecond=0)
    return TimeRange(end - (r.end - r.start), end, True)


def default_bin_seconds(range_seconds: float) -> int:
    return 60 if range_seconds <= 3600 else 300 if range_seconds <= 21600 else 900 if range_seconds <= 86400 else 3600


def bucket_count(range_seconds: int, bin_seconds: int) -> int:
    """Bins of a half-open range."""
    return max(1, -(-range_seconds // bin_seconds))


def expected_bin_count(start_s: int, end_s: int, bin_seconds: int) -> int:
    """Bins of a range that includes its end: one that ends on a bin's edge touches one bin more."""
    return end_s // bin_seconds - start_s // bin_seconds + 1


def choose_period(range_seconds: float, requested: int | None = None, max_points: int = 1000) -> int:
    if requested is not None:
        if requested <= 0 or requested % 60:
            raise ValueError("a period is a multiple of 60 seconds")
        return requested
    return next((p for p in PERIODS if range_seconds / p <= max_points), PERIODS[-1])


def bin_start(ts: Column, bin_seconds: int) -> Column:
    """Epoch second at which a timestamp's bin begins."""
    s = F.unix_seconds(ts.cast("timestamp"))
    return s - F.pmod(s, F.lit(bin_seconds))


def parse_bin_timestamp(text: Column) -> Column:
    """Epoch second of a bin label; without a zone it is UTC, and what cannot be read is null."""
    zoned = F.when(text.rlike(r"(?:Z|[+-]\d\d:?\d\d)$"), text).otherwise(F.concat(text, F.lit("Z")))
    return F.unix_seconds(F.try_to_timestamp(F.regexp_replace(F.trim(zoned), "^(\\S+) ", "$1T")))


def to_int(value: Column) -> Column:
    """Whole part of a number in text; null if it is none."""
    v = value.try_cast("double")
    return F.when(v >= 0, F.floor(v)).otherwise(F.ceil(v)).cast("long")
