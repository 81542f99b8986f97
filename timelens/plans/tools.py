"""The named queries with their parameters, defaults and checks.

``now`` is always an argument, so that a query gives the same answer whenever
it is run. Bad values raise ``ValueError``, wrong types ``TypeError``.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, functions as F

from timelens.functions.timing import rfc3339
from timelens.operators import events as ev
from timelens.operators import semantic
from timelens.operators import system as sy
from timelens.operators.embedding import Embedder, embed_query


def _number(name: str, value: int) -> int:
    if isinstance(value, bool) or not isinstance(value, int):
        raise TypeError(f"{name} must be an integer")
    return value


def _query(value: str) -> str:
    if not isinstance(value, str):
        raise TypeError("query must be a string")
    if value == "":
        raise ValueError("an empty query finds nothing")
    return value


def _ago(now: datetime, name: str, seconds: int) -> datetime:
    return now - timedelta(seconds=_number(name, seconds))


def system_current_metrics(samples: DataFrame) -> DataFrame:
    """The newest sample; no row while there are none."""
    return sy.latest_sample(samples)


def system_metrics_history(
    samples: DataFrame, now: datetime, start_seconds_ago: int = 300, end_seconds_ago: int = 0
) -> DataFrame:
    if _number("start_seconds_ago", start_seconds_ago) <= _number("end_seconds_ago", end_seconds_ago):
        raise ValueError("the range must begin before it ends")
    return sy.samples_in_range(
        samples, now - timedelta(seconds=start_seconds_ago), now - timedelta(seconds=end_seconds_ago)
    )


def system_top_processes(processes: DataFrame, metric: str = "cpu", limit: int = 10) -> DataFrame:
    """Heaviest processes of the newest batch, among those stored per tick."""
    if not isinstance(metric, str):
        raise TypeError("metric must be a string")
    return sy.top_processes(processes, metric, limit)


def events_search(
    events: DataFrame, now: datetime, query: str, limit: int = 20, since_seconds_ago: int = 3600,
    wildcards: bool = False,
) -> DataFrame:
    start = _ago(now, "since_seconds_ago", since_seconds_ago)
    return ev.search_events(events, _query(query), start, limit, wildcards)


def events_latest(events: DataFrame, limit: int = 20) -> DataFrame:
    return ev.latest_events(events, limit)


def events_near_time(
    events: DataFrame, now: datetime, seconds_ago: int, window_seconds: int = 60, limit: int = 50
) -> DataFrame:
    if _number("seconds_ago", seconds_ago) <= 0:
        raise ValueError("the anchor must lie in the past")
    at = _ago(now, "seconds_ago", seconds_ago)
    return ev.events_near(events, at, _number("window_seconds", window_seconds), limit)


def events_semantic_search(
    events: DataFrame, now: datetime, query: str, embedder: Embedder, limit: int = 10,
    since_seconds_ago: int = 86400,
) -> DataFrame:
    """Events nearest in meaning to ``query``, which is embedded as it stands."""
    start = _ago(now, "since_seconds_ago", since_seconds_ago)
    vector = embed_query(events.sparkSession, embedder, _query(query))
    return semantic.semantic_search(events, vector, start, limit)


TOOLS: dict[str, Callable[..., DataFrame]] = {
    "system_current_metrics": system_current_metrics,
    "system_metrics_history": system_metrics_history,
    "system_top_processes": system_top_processes,
    "events_search": events_search,
    "events_latest": events_latest,
    "events_near_time": events_near_time,
    "events_semantic_search": events_semantic_search,
}


def as_json(rows: DataFrame) -> DataFrame:
    """Rows as JSON objects in column ``value``, their time as RFC 3339 text ``at``."""
    fields = [rfc3339(F.col("ts")).alias("at")] + [F.col(c) for c in rows.columns if c != "ts"]
    return rows.select(F.to_json(F.struct(*fields)).alias("value"))
