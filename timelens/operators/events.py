"""Queries over the events table."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from timelens.functions.timing import Duration, moment, shifted, within
from timelens.operators.days import newest_rows, stored_days
from timelens.operators.topk import check_limit, newest

SHOWN = ["event_id", "ts", "priority", "unit", "source", "pid", "message"]


def shown(events: DataFrame) -> DataFrame:
    """The event columns of a result, with absent unit, source and pid filled."""
    columns = [c for c in ["host", *SHOWN] if c in events.columns]
    return events.select(*columns).na.fill({"unit": "", "source": "", "pid": 0})


def since(events: DataFrame, start: datetime) -> DataFrame:
    return within(events, "ts", moment(events, "ts", start))


def latest_events(events: DataFrame, limit: int = 20) -> DataFrame:
    """The newest events, newest first; equal times by ``event_id``.

    Of a table stored by day only the newest days that hold them are read.
    """
    return newest(shown(newest_rows(events, check_limit(limit), stored_days(events))), limit)


def search_events(
    events: DataFrame, query: str, start: datetime, limit: int | None = 20, wildcards: bool = False
) -> DataFrame:
    """Events from ``start`` on whose message or unit contains ``query``, newest first.

    Case does not matter. The query is plain text; with ``wildcards`` a ``%``
    in it stands for any text and a ``_`` for any character. Without a limit
    all hits come back, in no order.
    """
    wanted = F.lower(F.lit(query))
    if wildcards:
        pattern = f"%{query}%".lower().replace("\\", "\\\\")
        hit = F.lower("message").like(pattern) | F.lower("unit").like(pattern)
    else:
        hit = F.contains(F.lower("message"), wanted) | F.contains(F.lower("unit"), wanted)
    hits = shown(since(events, start).filter(hit))
    if limit is None:
        return hits
    return hits.orderBy(F.desc("ts"), F.asc("event_id")).limit(check_limit(limit))


def events_near(events: DataFrame, at: datetime, width: Duration = 60, limit: int = 50) -> DataFrame:
    """The earliest ``limit`` events within ``width`` of ``at``, oldest first, ends included."""
    check_limit(limit)
    middle = moment(events, "ts", at)
    return (
        shown(within(events, "ts", shifted(middle, -width), shifted(middle, width)))
        .orderBy("ts", "event_id")
        .limit(limit)
    )


def pending_events(
    events: DataFrame, embeddings: DataFrame | None = None, limit: int | None = None
) -> DataFrame:
    """Events still without an embedding: ``event_id``, ``ts``, ``unit``, ``message``.

    Newest first when a ``limit`` is given. Embeddings are looked for in the
    table's own column and in the side table of ``event_id, embedding``.
    """
    rows = events.filter(F.col("embedding").isNull()) if "embedding" in events.columns else events
    if embeddings is not None:
        rows = rows.join(embeddings.select("event_id"), "event_id", "left_anti")
    rows = rows.select("event_id", "ts", F.coalesce("unit", F.lit("")).alias("unit"), "message")
    if limit is None:
        return rows
    check_limit(limit)
    return rows.orderBy(F.desc("ts"), F.asc("event_id")).limit(limit)
