"""Newest rows of a table stored by day: days are asked for newest first, older ones only while rows are missing.

Which days a table has is known from the names of its folders, which Spark lists anyhow.
A walk asks the newest day, then twice as many days before it, and so on; the query itself
then has the oldest day asked for as a bound on the partition column.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from datetime import date, datetime

from pyspark.sql import DataFrame, functions as F

from timelens.functions.timing import moment

DAY = "date"

_FOLDER = re.compile(rf"/{DAY}=(\d{{4}}-\d\d-\d\d)/")


def stored_days(df: DataFrame, at: datetime | date | str | None = None, ts: str = "ts") -> list[date]:
    """The days a table has folders of, newest first, none after the day of ``at``; empty for other tables."""
    if DAY not in df.columns or df.schema[DAY].dataType.typeName() != "date":
        return []
    days = {date.fromisoformat(found[1]) for path in df.inputFiles() if (found := _FOLDER.search(path))}
    if days and at is not None:
        last = df.sparkSession.range(1).select(F.to_date(moment(df, ts, at))).first()[0]
        days = {d for d in days if d <= last}
    return sorted(days, reverse=True)


def _spans(days: Sequence[date]) -> Iterator[tuple[date, date]]:
    """(oldest, newest) day of each step of a walk."""
    at, wide = 0, 1
    while at < len(days):
        step = days[at:at + wide]
        yield step[-1], step[0]
        at, wide = at + wide, 2 * wide


def from_day(df: DataFrame, days: Sequence[date], enough: Callable[[DataFrame], bool]) -> DataFrame:
    """Rows from the newest day on from which on there are ``enough``; all rows if no day is old enough."""
    for oldest, _ in _spans(days):
        recent = df.filter(F.col(DAY) >= F.lit(oldest))
        if enough(recent):
            return recent
    return df


def newest_rows(df: DataFrame, limit: int, days: Sequence[date]) -> DataFrame:
    """Rows of the newest days that hold ``limit`` rows between them."""
    found = 0
    for oldest, newest in _spans(days):
        step = df.filter((F.col(DAY) >= F.lit(oldest)) & (F.col(DAY) <= F.lit(newest)))
        found += step.limit(limit - found).count()
        if found >= limit:
            return df.filter(F.col(DAY) >= F.lit(oldest))
    return df


def newest_of_all(df: DataFrame, series: DataFrame, by: Sequence[str], days: Sequence[date]) -> DataFrame:
    """Rows of the newest days that hold a row of each of the ``series``."""
    wanted = series.select(*by).distinct()
    return from_day(df, days, lambda recent: wanted.join(recent.select(*by), list(by), "left_anti").isEmpty())
