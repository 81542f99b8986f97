"""Queries over the sample and process tables.

Lookups without a series key answer for one machine. With ``by`` they answer
for every series in one job.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from timelens.functions.timing import moment, within
from timelens.operators.days import newest_of_all, newest_rows, stored_days
from timelens.operators.topk import check_limit, top_per_group

METRICS = {"cpu": "cpu_pct", "mem": "mem_rss"}


def metric_order(metric: str) -> list[Column]:
    """Highest first by memory for ``"mem"``, by CPU for anything else; ties by pid."""
    column = METRICS.get(metric, METRICS["cpu"])
    return [F.desc_nulls_last(column), F.asc("pid")]


def upto(df: DataFrame, at: datetime | None) -> DataFrame:
    return df if at is None else within(df, "ts", last=moment(df, "ts", at))


def latest_rows(
    df: DataFrame, by: Sequence[str] = (), at: datetime | None = None, series: DataFrame | None = None
) -> DataFrame:
    """All rows at the newest time, or at the newest time not after ``at``.

    The time is found on the time column alone. Without a key it then bounds
    the scan of the wide rows; with one it is joined to them. Of a table
    stored by day only the newest days with rows are read; with a key that
    takes the known ``series``, of which those without rows cost a walk over
    all days, and those not named have no rows.
    """
    past = upto(df, at)
    days = stored_days(df, at) if not by or series is not None else []
    if not by:
        past = newest_rows(past, 1, days)
        return past.filter(F.col("ts") == past.agg(F.max("ts")).scalar())
    if series is not None:
        past = newest_of_all(past, series, by, days).join(series.select(*by).distinct(), list(by), "left_semi")
    last = past.groupBy(*by).agg(F.max("ts").alias("ts"))
    return past.join(last, [*by, "ts"], "left_semi")


def latest_sample(samples: DataFrame, by: Sequence[str] = (), series: DataFrame | None = None) -> DataFrame:
    """The newest sample (per series); no row if there is none."""
    return latest_rows(samples, by, series=series)


def sample_at(
    samples: DataFrame, at: datetime, by: Sequence[str] = (), series: DataFrame | None = None
) -> DataFrame:
    """The newest sample at or before ``at`` (per series); no row if there is none."""
    return latest_rows(samples, by, at, series)


def samples_in_range(samples: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Samples in ``[start, end]``, both included, oldest first."""
    order = [c for c in ("ts", "host") if c in samples.columns]
    return within(samples, "ts", moment(samples, "ts", start), moment(samples, "ts", end)).orderBy(*order)


def time_bounds(samples: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """First and last sample time (per series); no row for an empty table."""
    return (
        samples.groupBy(*by)
        .agg(F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"))
        .filter(F.col("min_ts").isNotNull())
    )


def top_processes(
    processes: DataFrame,
    metric: str = "cpu",
    limit: int = 10,
    at: datetime | None = None,
    by: Sequence[str] = (),
    series: DataFrame | None = None,
) -> DataFrame:
    """The ``limit`` heaviest processes of the newest batch (not after ``at``)."""
    check_limit(limit)
    batch = latest_rows(processes, by, at, series)
    if by:
        return top_per_group(batch, by, metric_order(metric), limit)
    return batch.orderBy(*metric_order(metric)).limit(limit)
