"""Dates named in texts, and schedules (O-221..O-225, O-270)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, TimestampType

#: Days by which a phrase lies off the session's day.
OFFSETS = {"today": 0, "yesterday": -1, "tomorrow": 1, "last week": -7, "next week": 7}


def relative_date(phrase: Column, at: Column) -> Column:
    """O-222: midnight of the day that a phrase names, seen from a session's day; null for other phrases."""
    rule = None
    for name, days in OFFSETS.items():
        value = F.date_trunc("day", at) + F.expr(f"INTERVAL {days} DAYS")
        rule = F.when(F.lower(phrase) == name, value) if rule is None else rule.when(F.lower(phrase) == name, value)
    return rule


def granularity(text: Column) -> Column:
    """O-223: how exact a date is."""
    return F.when(text.rlike(r"^\d{4}$"), "year").when(text.rlike(r"^\d{4}-\d{2}$"), "month").when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), "day").otherwise("unknown")


def missed_jobs(jobs: DataFrame, as_of: Column, window_seconds: int) -> DataFrame:
    """O-225, O-270: jobs whose run lies further back than the window."""
    return jobs.withColumn("missed", F.col("next_run") < as_of - F.expr(f"INTERVAL {window_seconds} SECONDS"))


#: Fields of a schedule in their order with their least and greatest numbers, and names of months and days.
CRON_FIELDS = [("second", 0, 59), ("minute", 0, 59), ("hour", 0, 23), ("day", 1, 31), ("month", 1, 12), ("weekday", 1, 7)]
MONTH_NAMES = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
DAY_NAMES = ["sun", "mon", "tue", "wed", "thu", "fri", "sat"]


def cron_field(text: str, least: int, most: int, names: list[str] = ()) -> list[int]:
    """Numbers that a field of a schedule allows: ``*``, lists, ranges, steps, and names."""
    number = lambda x: names.index(x.lower()[:3]) + least if x.lower()[:3] in names else int(x)
    out: set[int] = set()
    for part in text.split(","):
        span, _, step = part.partition("/")
        first, _, last = span.partition("-")
        low = least if first in ("*", "?") else number(first)
        high = number(last) if last else most if first in ("*", "?") or step else low
        if not least <= low <= high <= most:
            raise ValueError(f"out of range: {part}")
        out.update(range(low, high + 1, int(step or 1)))
    return sorted(out)


def next_run(schedule: str, after):
    """O-225: the first time after ``after`` that a schedule of six fields (seconds first, days of the week from Sunday = 1) names, or None.

    Five fields mean second 0. Looks five years ahead.
    """
    from datetime import timedelta

    fields = schedule.split()
    fields = fields if len(fields) != 5 else ["0", *fields]
    if len(fields) != 6:
        return None
    try:
        seconds, minutes, hours, days, months, weekdays = (cron_field(t, a, b, MONTH_NAMES if n == "month" else DAY_NAMES if n == "weekday" else ()) for t, (n, a, b) in zip(fields, CRON_FIELDS, strict=True))
    except ValueError:
        return None
    at = after.replace(microsecond=0) + timedelta(seconds=1)
    for ahead in range(5 * 366):
        day = (at + timedelta(days=ahead)).replace(hour=0, minute=0, second=0) if ahead else at.replace(hour=0, minute=0, second=0)
        if day.month in months and day.day in days and day.isoweekday() % 7 + 1 in weekdays:
            for h in hours:
                for m in minutes:
                    for s in seconds:
                        found = day.replace(hour=h, minute=m, second=s)
                        if found >= at:
                            return found
    return None


def with_next_run(jobs: DataFrame) -> DataFrame:
    """O-225: ``next_run`` of rows with ``schedule`` and ``last_run``; null for schedules that cannot be read. One small step for each row, in Arrow batches."""
    import pandas as pd

    schema = StructType([*jobs.schema.fields, StructField("next_run", TimestampType())])

    def run(frames):
        for frame in frames:
            known = frame["schedule"].notna() & frame["last_run"].notna()
            found = [next_run(s, t.to_pydatetime()) if ok else None for s, t, ok in zip(frame["schedule"], frame["last_run"], known, strict=True)]
            yield frame.assign(next_run=pd.to_datetime(pd.Series(found, index=frame.index, dtype=object)))

    return jobs.mapInPandas(run, schema)
