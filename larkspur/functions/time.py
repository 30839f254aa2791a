"""Times, offsets and schedules."""

from __future__ import annotations

import datetime as dt
import re
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def absolute(text: Column) -> Column:
    """Digits are epoch milliseconds; dates and times without a zone are UTC (the session's zone); else null."""
    t = F.trim(text)
    iso = F.regexp_replace(t, "T", " ")
    return F.when(t.rlike("^[0-9]+$"), F.timestamp_millis(t.try_cast("long"))).when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(iso))


def next_every(now: Column, every: Column, anchor: Column) -> Column:
    """The first time after now (or the anchor, if ahead) of a schedule every so many milliseconds."""
    steps = F.greatest(F.lit(1), F.ceil((now - anchor) / every))
    return F.when(every > 0, F.when(now < anchor, anchor).otherwise(anchor + F.greatest(steps, F.floor((now - anchor) / every) + 1) * every))


def remaining(seconds: Column) -> Column:
    """now, Nm, Hh Mm, Dd Hh."""
    m = F.floor(seconds / 60)
    h = F.floor(m / 60)
    return (
        F.when(seconds <= 0, "now").when(h < 1, F.concat(m.cast("string"), F.lit("m")))
        .when(h < 24, F.concat(h.cast("string"), F.lit("h"), F.when(m % 60 > 0, F.concat(F.lit(" "), (m % 60).cast("string"), F.lit("m"))).otherwise("")))
        .otherwise(F.concat(F.floor(h / 24).cast("string"), F.lit("d "), (h % 24).cast("string"), F.lit("h")))
    )


def utc_offset(text: str) -> int | None:
    """Minutes of UTC+h[:mm]; null beyond 14 hours."""
    m = re.fullmatch(r"UTC([+-])(\d{1,2})(?::([0-5]\d))?", text.strip(), re.I)
    minutes = int(m[2]) * 60 + int(m[3] or 0) if m else 999
    return None if minutes > 14 * 60 else minutes if m[1] == "+" else -minutes


def offset_minutes(text: Column) -> Column:
    """utc_offset() of a column: minutes of UTC+h[:mm] in any case, spaces around it aside; null for all else and beyond 14 hours."""
    part = lambda k: F.regexp_extract(F.trim(text), r"^(?i:UTC)([+-])([0-9]{1,2})(?::([0-5][0-9]))?$", k)
    minutes = F.nullif(part(2), F.lit("")).cast("int") * 60 + F.coalesce(F.nullif(part(3), F.lit("")).cast("int"), F.lit(0))
    return F.when(minutes <= 14 * 60, F.when(part(1) == "-", -minutes).otherwise(minutes))


def offset_text(minutes: Column) -> Column:
    """UTC+h or UTC+h:mm of minutes, the inverse of offset_minutes()."""
    m = F.abs(minutes)
    rest = F.when(m % 60 > 0, F.concat(F.lit(":"), F.lpad((m % 60).cast("string"), 2, "0"))).otherwise("")
    return F.concat(F.lit("UTC"), F.when(minutes < 0, "-").otherwise("+"), F.floor(m / 60).cast("string"), rest)


def in_dates(ts: Column, start: Column, end: Column, offset: Column | None = None) -> Column:
    """Whether a time lies on the dates start to end (text, both included) as people at an offset see them; an offset that cannot
    be read is none, as is one that is not given."""
    minutes = F.lit(0) if offset is None else F.coalesce(offset_minutes(offset), F.lit(0))
    local = ts.cast("timestamp_ntz") + F.make_dt_interval(mins=minutes)
    return local.cast("date").between(F.try_to_date(start, "yyyy-MM-dd"), F.try_to_date(end, "yyyy-MM-dd"))


def date_range(start: str | None, end: str | None, days: int | None, today: dt.date, offset_minutes: int = 0) -> tuple[dt.datetime, dt.datetime]:
    """First and last moment (inclusive, to the millisecond) of dates as people at an offset see them; 30 days by default."""
    parse = lambda s: dt.date.fromisoformat(s) if s and re.fullmatch(r"\d{4}-\d{2}-\d{2}", s) else None
    first, last = parse(start), parse(end)
    if not first or not last:
        last = today
        first = today - dt.timedelta(days=max(1, 30 if days is None else days) - 1)
    shift = dt.timedelta(minutes=offset_minutes)
    return dt.datetime.combine(first, dt.time()) - shift, dt.datetime.combine(last, dt.time()) + dt.timedelta(days=1, milliseconds=-1) - shift


def _field(spec: str, low: int, high: int) -> set[int]:
    out: set[int] = set()
    for part in spec.split(","):
        span, _, step = part.partition("/")
        a, _, b = span.partition("-")
        first, last = (low, high) if span == "*" else (int(a), int(b) if b else high if step else int(a))
        out |= set(range(first, last + 1, int(step or 1)))
    return out


def _steps(fits_day, hours: list[int], minutes: list[int], start: dt.datetime, back: bool):
    """Times that fit from start on (or back from it), to the minute, within four years."""
    day, order = start.date(), -1 if back else 1
    for _ in range(1462):
        if fits_day(day):
            for h in hours[::order]:
                for m in minutes[::order]:
                    t = dt.datetime(day.year, day.month, day.day, h, m)
                    if (t <= start) if back else (t >= start):
                        yield t
        day += dt.timedelta(days=order)


def cron_run(expression: str, at: dt.datetime, zone: str = "UTC", back: bool = False) -> dt.datetime | None:
    """The first run after `at` of a five-field cron expression, or the last before it, as UTC; null if none in four years.

    The fields tell the zone's own clock. A time that the clock skips does not come; one that it shows twice comes at its
    first.
    """
    tz = ZoneInfo(zone)
    minute, hour, day, month, weekday = expression.split()
    minutes, hours, days, months = (sorted(_field(*x)) for x in ((minute, 0, 59), (hour, 0, 23), (day, 1, 31), (month, 1, 12)))
    weekdays, either = {x % 7 for x in _field(weekday, 0, 7)}, "*" not in (day, weekday)

    def fits_day(d: dt.date) -> bool:
        a, b = d.day in days, d.isoweekday() % 7 in weekdays
        return d.month in months and ((a or b) if either else (a and b))

    local = at.replace(tzinfo=dt.UTC).astimezone(tz).replace(tzinfo=None)
    for t in _steps(fits_day, hours, minutes, local + dt.timedelta(hours=-1 if not back else 1), back):
        utc = t.replace(tzinfo=tz).astimezone(dt.UTC)
        if utc.astimezone(tz).replace(tzinfo=None) == t and (utc.replace(tzinfo=None) < at if back else utc.replace(tzinfo=None) > at):
            return utc.replace(tzinfo=None)
    return None


def next_cron(expression: str, after: dt.datetime, zone: str = "UTC") -> dt.datetime | None:
    return cron_run(expression, after, zone)


def previous_cron(expression: str, before: dt.datetime, zone: str = "UTC") -> dt.datetime | None:
    return cron_run(expression, before, zone, back=True)


def cron(expression: Column, at: Column, zone: Column | None = None, back: bool = False) -> Column:
    """cron_run() of columns, a time without a zone for times in UTC. Search by calendar: Python, in batches."""

    @F.pandas_udf("timestamp_ntz")
    def run(e: pd.Series, t: pd.Series, z: pd.Series) -> pd.Series:
        told = [None if pd.isna(b) or a is None else cron_run(a, b.to_pydatetime(), c or "UTC", back) for a, b, c in zip(e, t, z, strict=True)]
        return pd.Series(told, dtype="datetime64[us]")

    return run(expression, at.cast("timestamp_ntz"), F.lit("UTC") if zone is None else zone)


def archive_stamp(at: Column) -> Column:
    """A time as it stands in archived files' names: ISO to the millisecond, dashes for colons."""
    return F.date_format(at, "yyyy-MM-dd'T'HH-mm-ss.SSS'Z'")


def archived_at(name: Column, reason: str) -> Column:
    """The time in an archived file's name after the last `.reason.`; null where there is none, or no time."""
    raw = F.regexp_extract(name, rf"^.*\.{re.escape(reason)}\.(\d{{4}}-\d{{2}}-\d{{2}}T\d{{2}}-\d{{2}}-\d{{2}}(?:\.\d{{3}})?)Z$", 1)
    parts = F.split(raw, "T")
    return F.try_to_timestamp(F.concat(F.get(parts, F.lit(0)), F.lit(" "), F.replace(F.get(parts, F.lit(1)), F.lit("-"), F.lit(":"))))


def boundary(ts: Column, previous: Column, idle_minutes: int | None, at_hour: int | None) -> Column:
    """Why an event begins a new session: `first`, `daily` (the reset hour lies between it and the one before), `idle`; else null."""
    day = lambda t: F.to_date(t - F.expr(f"INTERVAL {at_hour} HOURS"))
    gap = F.unix_micros(ts.cast("timestamp")) - F.unix_micros(previous.cast("timestamp"))
    why = F.when(previous.isNull(), "first")
    if at_hour is not None:
        why = why.when(day(ts) > day(previous), "daily")
    return why if idle_minutes is None else why.when(gap > idle_minutes * 60_000_000, "idle")


def top_of_hour(expression: Column) -> Column:
    """Whether a cron expression fires at minute (and second) zero of every or every so many hours."""
    return expression.rlike(r"^(0 )?0 (\*|\*/\d+) \S+ \S+ \S+$")


def stagger(key: Column, most_ms: int = 300_000) -> Column:
    """A steady offset of a job within most_ms, by its name's hash."""
    return F.pmod(F.conv(F.substring(F.sha2(key, 256), 1, 12), 16, 10).cast("long"), F.lit(most_ms))
