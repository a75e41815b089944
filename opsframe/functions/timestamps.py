"""Timestamps inside log lines, in tiers that are never compared with each other.

Tier 0: absolute with a known offset (``ts_utc``).  Tier 1: absolute without one
(``ts_local``).  Tier 2: a time of day (``time_of_day``, seconds).  Tier 3: none.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accepted formats in the order in which they are tried; groups are named by the tuples beside.
ISO = r"(\d{4})-(\d{2})-(\d{2})[T ](\d{2}):(\d{2}):(\d{2})(?:[.,](\d+))?(?:(Z|[+-]\d{2}:?\d{2})|\s([A-Z]{2,5}))?"
BRACKETED = r"\[(\d{1,2})/(\d{1,2})/(\d{2})\s(\d{2}):(\d{2}):(\d{2}):(\d+)(?:\s([A-Z]{2,5}))?\]"
ACCESS = r"\[(\d{2})/([A-Za-z]{3})/(\d{4}):(\d{2}):(\d{2}):(\d{2})\s([+-]\d{2}:?\d{2})\]"
SLASHED = r"(\d{4})/(\d{2})/(\d{2})\s(\d{2}):(\d{2}):(\d{2})"
NAMED = r"\b(\d{2})\s([A-Za-z]{3})\s(\d{4})\s(\d{2}):(\d{2}):(\d{2})(?:\.(\d+))?"
TIME_ONLY = r"\[(\d{2}):(\d{2}):(\d{2})(?:[.,](\d+))?\]"
FORMATS = (
    ("iso", ISO, ("year", "month", "day", "hour", "minute", "second", "frac", "tz", "zone")),
    ("bracketed", BRACKETED, ("month", "day", "year2", "hour", "minute", "second", "frac", "zone")),
    ("slashed", SLASHED, ("year", "month", "day", "hour", "minute", "second")),
    ("access", ACCESS, ("day", "name", "year", "hour", "minute", "second", "tz")),
    ("named", NAMED, ("day", "name", "year", "hour", "minute", "second", "frac")),
)
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
ZONES = {"AEST": 600, "AEDT": 660}


def offset_minutes(tz: Column, zone: Column) -> Column:
    """Minutes east of UTC of ``Z``, ``+10:00``, ``+1000`` or a known zone name; null if unknown or a day or more."""
    digits = F.regexp_replace(tz, ":", "")
    hours, minutes = F.substring(digits, 2, 2).try_cast("int"), F.substring(digits, 4, 2).try_cast("int")
    signed = F.when(F.substring(digits, 1, 1) == "-", -(hours * 60 + minutes)).otherwise(hours * 60 + minutes)
    out = F.when(tz == "Z", 0).when((tz != "") & (F.abs(signed) < 1440) & (minutes < 60), signed)
    for name, value in ZONES.items():
        out = out.when((tz == "") & (zone == name), value)
    return out


def _moment(line: Column, kind: str, pattern: str, names: tuple[str, ...]) -> Column:
    """Struct of one format's reading; null if it does not match or is no valid time, so that the next one is tried.

    The match is taken apart once, into a list of its groups that the reading is
    bound to; so each format costs two searches, however many parts it has.
    """
    whole = F.regexp_extract(line, pattern, 0)
    parts = F.split(F.regexp_replace(whole, pattern, "|".join(f"${i + 1}" for i in range(len(names)))), r"\|")

    def read(cells: Column) -> Column:
        g = {n: F.get(cells, F.lit(i)) for i, n in enumerate(names)}
        number = lambda n: g[n].try_cast("int")
        year = number("year") if "year" in g else number("year2") + F.when(number("year2") <= 68, 2000).otherwise(1900)
        month = number("month") if "month" in g else F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(g["name"])).cast("int"), F.lit(0))
        # six digits of the fraction count; more are cut
        micros = F.lit(0)
        if "frac" in g:
            micros = F.coalesce(F.when(g["frac"] != "", F.rpad(F.substring(g["frac"], 1, 6), 6, "0").try_cast("int")), F.lit(0))
        valid = (number("hour") < 24) & (number("minute") < 60) & (number("second") < 60)
        local = F.when(valid, F.try_make_timestamp_ntz(year, month, number("day"), number("hour"), number("minute"), number("second") + micros / F.lit(1000000)))
        minutes = offset_minutes(g.get("tz", F.lit("")), g.get("zone", F.lit("")))
        bad_zone = (g["tz"] != "") & minutes.isNull() if "tz" in g else F.lit(False)
        return F.struct(local.alias("local"), minutes.alias("minutes"), bad_zone.alias("bad"))

    def told(t: Column) -> Column:
        found = F.struct(
            whole.alias("raw"), F.lit(kind).alias("kind"), F.lit(None).cast("double").alias("time_of_day"),
            F.when(t["minutes"].isNotNull(), _shift(t["local"], t["minutes"])).alias("ts_utc"),
            F.when(t["minutes"].isNull(), t["local"]).alias("ts_local"), F.when(t["minutes"].isNull(), 1).otherwise(0).alias("tier"),
        )
        return F.when(t["local"].isNotNull() & ~t["bad"], found)

    bind = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))
    return F.when(whole != "", bind(bind(parts, read), told))


def _shift(local: Column, minutes: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(local.cast("timestamp")) - minutes.cast("long") * F.lit(60_000_000))


def parse_log_timestamp(line: Column) -> Column:
    """Struct ``raw, kind, time_of_day, ts_utc, ts_local, tier`` of the first format that gives a valid time; null if none does.

    Two-digit years 00-68 are 20xx.  A zone name that is not known leaves the
    time without an offset.  Needs a session time zone of UTC, as all of this
    library does, to keep local times free of gaps.
    """
    g = [F.regexp_extract(line, TIME_ONLY, i) for i in range(5)]
    h, m, s = (x.try_cast("int") for x in g[1:4])
    seconds = h * 3600 + m * 60 + s + F.when(g[4] != "", F.concat(F.lit("0."), g[4]).try_cast("double")).otherwise(0.0)
    partial = F.when((g[0] != "") & (h < 24) & (m < 60) & (s < 60), F.struct(
        g[0].alias("raw"), F.lit("time_only").alias("kind"), seconds.cast("double").alias("time_of_day"),
        F.lit(None).cast("timestamp").alias("ts_utc"), F.lit(None).cast("timestamp_ntz").alias("ts_local"), F.lit(2).alias("tier"),
    ))
    return F.coalesce(*[_moment(line, *f) for f in FORMATS], partial)
