"""Time formatting and local calendar days (E14, E15, the day rule of H1-H4)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
DEFAULT_FORMAT = "yyyy-MM-dd"
DEFAULT_FORMAT_UTC = "yyyy-MM-dd HH:mm:ss"
WEEKDAYS = ["Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday"]
# ---------------------------------------------------------------------------


def _clock(ms: Column) -> Column:
    """Epoch milliseconds as a zone-free timestamp in UTC."""
    return F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'") + F.make_dt_interval(secs=ms / F.lit(1000).cast("decimal(18,0)"))


def _render(local: Column, ms: Column, fmt: str, upper: bool) -> Column:
    """Concatenate the fields a pattern names; other characters stay as written."""
    letters = "yMdHhmsSEa" + ("YD" if upper else "")

    def padded(value: Column, width: int) -> Column:
        text = value.cast("string")
        return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))

    day_name = F.element_at(F.array(*[F.lit(d) for d in WEEKDAYS]), F.dayofweek(local))
    parts = []
    for token in re.findall("|".join(f"{x}+" for x in letters) + "|.|\n", fmt):
        n, kind = len(token), token[0]
        if kind in "yY":
            parts.append(padded(F.year(local), n))
        elif kind == "M":
            parts.append(padded(F.month(local), n))
        elif kind in "dD" and kind in letters:
            parts.append(padded(F.dayofmonth(local), n))
        elif kind == "H":
            parts.append(padded(F.hour(local), n))
        elif kind == "h":
            parts.append(padded((F.hour(local) + 11) % 12 + 1, n))
        elif kind == "m":
            parts.append(padded(F.minute(local), n))
        elif kind == "s":
            parts.append(padded(F.second(local), n))
        elif kind == "S":
            parts.append(padded(F.pmod(ms, F.lit(1000)), n))
        elif kind == "E":
            parts.append(day_name if n >= 4 else F.substring(day_name, 1, 3))
        elif kind == "a":
            parts.append(F.when(F.hour(local) < 12, F.lit("AM")).otherwise(F.lit("PM")))
        else:
            parts.append(F.lit(token))
    return F.concat(*parts)


def format_time(ms: Column, fmt: str | None = None, tz: str = "UTC") -> Column:
    """Epoch milliseconds in the reader's zone; no number gives ``''``."""
    fmt = DEFAULT_FORMAT if fmt is None else fmt
    if not fmt:
        return F.lit("")
    millis = ms.try_cast("bigint")
    local = F.convert_timezone(F.lit("UTC"), F.lit(tz), _clock(millis))
    return F.coalesce(_render(local, millis, fmt, upper=False), F.lit(""))


def format_time_utc(ms: Column, fmt: str | None = None, hours: Column | float = 0) -> Column:
    """The same at an explicit offset in hours, fractions allowed."""
    fmt = DEFAULT_FORMAT_UTC if fmt is None else fmt
    if not fmt:
        return F.lit("")
    shift = hours if isinstance(hours, Column) else F.lit(hours)
    shift = F.coalesce(shift.try_cast("double"), F.lit(0.0))
    millis = ms.try_cast("bigint") + F.round(shift * 3600000).cast("bigint")
    return F.coalesce(_render(_clock(millis), millis, fmt, upper=True), F.lit(""))


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a zone-free time read as UTC.

    Taken from the difference of two zone-free times: functions that go through
    zoned timestamps would shift by the session zone's clock changes.
    """
    gap = ts.cast("timestamp_ntz") - F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'")
    part = lambda name: F.date_part(F.lit(name), gap)
    minutes = (part("DAY").cast("bigint") * 24 + part("HOUR")) * 60 + part("MINUTE")
    return minutes * 60_000_000 + (part("SECOND") * 1_000_000).cast("bigint")


def local_time(ts: Column, tz: str) -> Column:
    """Wall-clock time of the reader for an instant held in UTC (zone-free)."""
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), ts.cast("timestamp_ntz"))


def local_day(ts: Column, tz: str) -> Column:
    """The local calendar day an instant falls on."""
    return F.to_date(local_time(ts, tz))
