"""Joins by time: the row as of a moment, the batch as of a moment, the rows around it.

All of them work on the distinct ``(key, moment)`` pairs, resolve those on
narrow rows of keys and times, and attach wide rows last by equality. A moment
or key that many cursors share is thus resolved once, and the attaching joins
are plain equi-joins that adaptive execution can broadcast or split.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window, functions as F

from timelens.functions.timing import (
    Duration, bucket_start, buckets_between, elapsed_seconds, shifted, to_micros,
)
from timelens.operators.running import WIDTH, before_buckets, bucketed, inside_buckets, join_buckets
from timelens.operators.topk import check_limit, top_per_group

# Band joins count events per microsecond, so a bucket of a minute holds at
# most 60 million rows to sort.
BAND_WIDTH = 60  # seconds


def resolve_times(
    points: DataFrame,
    series: Mapping[str, DataFrame],
    by: Sequence[str],
    at: str = "at",
    ts: str = "ts",
    strict: bool = False,
    width: Duration = WIDTH,
) -> DataFrame:
    """For each distinct ``(by, at)`` the latest ``ts`` at or before it of every series, under the series' name.

    Points and rows of all series are stacked as marks of a bucket, equal ones once, and one
    sweep over each bucket carries all the latest times along; one row per bucket carries them on to
    the next. Points with no earlier row of a series get NULL there. ``strict`` leaves out
    an equal ``ts``.
    """
    names, keys = list(series), [*by, "_bucket"]
    no_time = {n: F.lit(None).cast(rows.schema[ts].dataType) for n, rows in series.items()}
    marks = points.select(*by, F.col(at).alias("_t"), F.lit(True).alias("_point"), *[c.alias(n) for n, c in no_time.items()])
    for name, rows in series.items():
        marks = marks.unionByName(rows.select(
            *by, F.col(ts).alias("_t"), F.lit(False).alias("_point"),
            *[(F.col(ts) if n == name else c).alias(n) for n, c in no_time.items()]))
    once = bucketed(marks, "_t", width).groupBy(*keys, "_t", "_point").agg(*[F.max(n).alias(n) for n in names])
    # At equal times the series row comes first, unless it must not count.
    side = F.col("_point") if not strict else ~F.col("_point")
    sweep = inside_buckets(by, ["_t", "_side"])
    swept = once.withColumn("_side", side).select(
        *keys, "_t", "_point", *names, *[F.max(n).over(sweep).alias(f"_in_{n}") for n in names])
    totals = swept.groupBy(*keys).agg(*[F.max(n).alias(n) for n in names])
    earlier = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*keys, *[F.max(n).over(earlier).alias(f"_before_{n}") for n in names])
    return join_buckets(swept.filter("_point").drop(*names), before, by).select(
        *by, F.col("_t").alias(at), *[F.coalesce(f"_in_{n}", f"_before_{n}").alias(n) for n in names])


def as_of_times(
    points: DataFrame,
    series: DataFrame,
    by: Sequence[str],
    at: str = "at",
    ts: str = "ts",
    strict: bool = False,
    width: Duration = WIDTH,
    into: str = "as_of",
) -> DataFrame:
    """For each distinct ``(by, at)`` the latest ``ts`` at or before it, as ``into``."""
    return resolve_times(points, {into: series}, by, at, ts, strict, width)


def as_of_join(
    cursors: DataFrame,
    series: DataFrame,
    by: Sequence[str],
    at: str = "at",
    ts: str = "ts",
    how: str = "left",
    tolerance: Duration | None = None,
    strict: bool = False,
    width: Duration = WIDTH,
    tie: Sequence[str] = (),
) -> DataFrame:
    """Each cursor with the series row as of its moment; that row's time is ``as_of``.

    Of series rows with one ``(by, ts)`` a cursor gets the last by ``tie`` (by all that can
    be compared, if not given). Cursors without a row have NULLs (``how="left"``) or are
    dropped (``how="inner"``). With a ``tolerance``, rows older than that before the cursor
    do not count.
    """
    if how not in ("left", "inner"):
        raise ValueError("how must be 'left' or 'inner'")
    clash = (set(cursors.columns) & set(series.columns)) - {*by, ts}
    if clash or "as_of" in cursors.columns:
        raise ValueError(f"columns on both sides: {sorted(clash) or ['as_of']}")
    resolved = as_of_times(cursors, series, by, at, ts, strict, width).filter(
        F.col("as_of").isNotNull()
    )
    if tolerance is not None:
        resolved = resolved.filter(
            elapsed_seconds(F.col(at), F.col("as_of")) <= to_micros(tolerance) / 1e6
        )
    return cursors.join(resolved, [*by, at], how).join(
        _last_of_moment(series, by, ts, tie).withColumnRenamed(ts, "as_of"), [*by, "as_of"], how
    )


def _last_of_moment(series: DataFrame, by: Sequence[str], ts: str, tie: Sequence[str]) -> DataFrame:
    """One row per ``(by, ts)``; the sort that finds it is the one of the merge join behind."""
    order = list(tie) or [
        f.name for f in series.schema.fields
        if f.name not in (*by, ts) and f.dataType.typeName() not in ("map", "variant")]
    if not order:
        return series.dropDuplicates([*by, ts])
    return top_per_group(series, [*by, ts], [F.desc(c) for c in order], 1, rank="_nth").drop("_nth")


def top_as_of(
    cursors: DataFrame,
    batches: DataFrame,
    by: Sequence[str],
    order: Sequence,
    limit: int,
    at: str = "at",
    ts: str = "ts",
    width: Duration = WIDTH,
) -> DataFrame:
    """Each cursor with the first ``limit`` rows of the batch as of its moment.

    A batch is all rows of one ``(by, ts)``. It is ranked once, however many
    cursors fall on it. Cursors before the first batch have no rows.
    """
    resolved = as_of_times(cursors, batches, by, at, ts, width=width).filter(
        F.col("as_of").isNotNull()
    )
    wanted = resolved.select(*by, F.col("as_of").alias(ts)).distinct()
    ranked = top_per_group(
        batches.join(wanted, [*by, ts], "left_semi"), [*by, ts], order, limit
    ).withColumnRenamed(ts, "as_of")
    return cursors.join(resolved, [*by, at]).join(ranked, [*by, "as_of"])


def band_join(
    anchors: DataFrame,
    events: DataFrame,
    by: Sequence[str],
    width: Duration,
    limit: int,
    at: str = "at",
    ts: str = "ts",
    event_id: str = "event_id",
    bucket_width: Duration = BAND_WIDTH,
) -> DataFrame:
    """Each anchor with the earliest ``limit`` events within ``width`` of it, both ends included.

    Events are numbered along each series in order of ``(ts, event_id)``; an
    anchor then needs only the ``limit`` numbers from its window's start on,
    which is an equi-join on blocks of numbers. The work is one pass over the
    events near any anchor plus ``limit`` rows per distinct anchor, never the
    product of a crowded window's anchors and events.
    """
    check_limit(limit)
    carried = [c for c in events.columns if c not in by]
    clash = set(anchors.columns) & set(carried)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    if to_micros(width) < 0:
        raise ValueError("width must not be negative")
    keep, limit = limit, max(limit, 1)

    points = (
        anchors.select(*by, F.col(at).alias("_at")).distinct()
        .withColumn("_start", shifted(F.col("_at"), -_seconds(width)))
        .withColumn("_end", shifted(F.col("_at"), _seconds(width)))
    )

    # Events in a coarse bucket that no window touches take no further part.
    coarse = max(2 * _seconds(width), _seconds(bucket_width))
    touched = points.select(
        *by, F.explode(buckets_between(F.col("_start"), F.col("_end"), coarse)).alias("_near")
    ).distinct()
    near = (
        events.select(*by, F.col(ts).alias("_t"), F.col(event_id).alias("_id"))
        .withColumn("_near", bucket_start(F.col("_t"), coarse))
        .join(touched, [*by, "_near"], "left_semi")
        .drop("_near")
    )

    # Of events at one and the same moment at most the first `limit` can ever
    # be in an answer, so a moment shared by very many is cut down here.
    firsts = top_per_group(near, [*by, "_t"], [F.col("_id")], limit, rank="_nth")
    moments = firsts.groupBy(*by, "_t").agg(F.count("*").alias("_n"))

    # Number of events before each moment, and before each window's start.
    marks = bucketed(
        moments.select(*by, "_t", "_n", F.lit(False).alias("_point")).unionByName(
            points.select(
                *by, F.col("_start").alias("_t"), F.lit(0).cast("long").alias("_n"),
                F.lit(True).alias("_point"),
            ).distinct()
        ),
        "_t", bucket_width,
    )
    totals = marks.groupBy(*by, "_bucket").agg(F.sum("_n").alias("_total"))
    earlier = (
        Window.partitionBy(*by, "_bucket")
        .orderBy("_t", F.desc("_point"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    counted = (
        join_buckets(
            marks.withColumn("_inside", F.sum("_n").over(earlier)),
            before_buckets(totals, by, "_total", F.sum), by,
        ).select(
            *by, "_t", "_point",
            (F.coalesce("_inside", F.lit(0)) + F.coalesce("_before", F.lit(0))).alias("_base"),
        )
    )
    numbered = firsts.join(
        counted.filter(~F.col("_point")).select(*by, "_t", "_base"), [*by, "_t"]
    ).select(
        *by, "_t", "_id", (F.col("_base") + F.col("_nth") - 1).alias("_number")
    ).withColumn("_block", F.floor(F.col("_number") / limit))
    windows = points.join(
        counted.filter("_point").select(*by, F.col("_t").alias("_start"), F.col("_base").alias("_first")),
        [*by, "_start"],
    ).select(
        *by, "_at", "_end", "_first",
        F.explode(F.sequence(
            F.floor(F.col("_first") / limit), F.floor((F.col("_first") + limit - 1) / limit)
        )).alias("_block"),
    )
    pairs = (
        windows.join(numbered, [*by, "_block"])
        .filter(F.col("_number").between(F.col("_first"), F.col("_first") + limit - 1))
        .filter(F.col("_t") <= F.col("_end"))
        .select(
            *by, F.col("_at").alias(at), F.col("_t").alias(ts), F.col("_id").alias(event_id),
            (F.col("_number") - F.col("_first") + 1).cast("int").alias("rank"),
        )
        .filter(F.col("rank") <= keep)
    )
    return anchors.join(pairs, [*by, at]).join(events, [*by, ts, event_id])


def _seconds(span: Duration) -> float:
    return to_micros(span) / 1e6
