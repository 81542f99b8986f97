"""Running values along a series without sorting a whole series in one task.

A window ordered by time with no more than the series key as its partition
puts a whole series into one task. Here time is cut into buckets of fixed
width: the window runs inside each bucket, one row per bucket is summed up and
run over the buckets, and both are combined. A task then sees either

* one bucket: at most one row per microsecond of it, as rows are unique by
  (key, time) or were reduced to that before, or
* one series' bucket totals: as many as the calendar has buckets, about a
  million for ten years of the default width,

whichever series or moment holds most of the data.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from timelens.functions.timing import Duration, bucket_start, micros, to_micros

WIDTH = 300  # seconds


def bucketed(df: DataFrame, ts: str, width: Duration = WIDTH) -> DataFrame:
    return df.withColumn("_bucket", bucket_start(F.col(ts), width))


def before_buckets(
    totals: DataFrame, by: Sequence[str], total: str, fn: Callable[[str], Column]
) -> DataFrame:
    """Per bucket, ``fn`` over ``total`` of all earlier buckets of the series, as ``_before``."""
    earlier = (
        Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    return totals.select(*by, "_bucket", fn(total).over(earlier).alias("_before"))


def join_buckets(rows: DataFrame, per_bucket: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows with the one row of their bucket.

    The rows are already spread and sorted by bucket and stay there. A merge
    can spill, where the bucket rows are nearly as many as the rows. Left
    alone, Spark may broadcast the rows to the bucket side, which for a series
    without key is one task.
    """
    return rows.join(per_bucket.hint("merge"), [*by, "_bucket"])


def inside_buckets(by: Sequence[str], order: Sequence[str]) -> Window:
    return (
        Window.partitionBy(*by, "_bucket")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )


def with_window_ends(
    rows: DataFrame,
    by: Sequence[str],
    ts: str,
    span: Duration,
    ends: Sequence[str],
    peaks: Sequence[str],
    since: str | None = None,
    known: Column | None = None,
) -> DataFrame:
    """Adds what a window ``[ts - span, ts]`` holds at its ends, without its rows.

    ``_n`` is their number, ``_first_<c>`` and ``_last_<c>`` the ``ends`` of its oldest and newest
    row, ``_peak_<c>`` the highest of ``peaks``. A row lies in a window if its ``ts`` does, and if
    ``since``, the ``ts`` of the row before it, does too, where that is given; rows that are not
    ``known`` lie in none.

    A window touches two buckets as wide as itself. In its own bucket it grows with ``ts``, in the
    one before it shrinks; a row is copied, narrow, to where its ``since`` drops out of windows.
    So two running values over a bucket and the copies in it, one from either end, make any window,
    and the work does not grow with the windows' rows.
    """
    width = to_micros(span)
    since = since or ts
    item = F.struct(*dict.fromkeys([*ends, *peaks]))
    if known is not None:
        item = F.when(known, item)
    shown = F.struct(*rows.columns)
    own, begun = bucket_start(F.col(ts), span), bucket_start(F.col(since), span)
    fields = ["_bucket", "_at", "_row", "_in", "_out"]
    marks = rows.select(*by, micros(F.col(ts)).alias("_at"), micros(F.col(since)).alias("_since"),
                        own.alias("_own"), begun.alias("_begun"), shown.alias("_row"), item.alias("_item"))
    no_row, no_item = (F.lit(None).cast(marks.schema[c].dataType) for c in ("_row", "_item"))

    def mark(*values: Column) -> Column:
        return F.struct(*[v.alias(f) for v, f in zip(values, fields, strict=True)])

    entering = mark(F.col("_own"), F.col("_at"), F.col("_row"),
                    F.when(F.col("_begun") == F.col("_own"), F.col("_item")), no_item)
    leaving = mark(F.col("_begun") + width, F.col("_since") + width, no_row, no_item, F.col("_item"))
    leaves = (F.col("_at") - F.col("_since") <= width) & F.col("_item").isNotNull()
    marks = marks.select(*by, F.inline(F.when(leaves, F.array(entering, leaving)).otherwise(F.array(entering))))
    bounds = (Window.unboundedPreceding, Window.currentRow)
    up = Window.partitionBy(*by, "_bucket").orderBy("_at").rangeBetween(*bounds)
    down = Window.partitionBy(*by, "_bucket").orderBy(F.desc("_at")).rangeBetween(*bounds)
    highest = [F.greatest(F.max(f"_in.{c}").over(up), F.max(f"_out.{c}").over(down)).alias(f"_peak_{c}") for c in peaks]
    swept = marks.select(
        "_row", (F.count("_in").over(up) + F.count("_out").over(down)).alias("_n"),
        F.coalesce(F.last("_out", ignorenulls=True).over(down), F.first("_in", ignorenulls=True).over(up)).alias("_first"),
        F.coalesce(F.last("_in", ignorenulls=True).over(up), F.first("_out", ignorenulls=True).over(down)).alias("_last"),
        *highest)
    return swept.filter(F.col("_row").isNotNull()).select(
        "_row.*", "_n", *[F.col(f"{side}.{c}").alias(f"{side}_{c}") for side in ("_first", "_last") for c in ends],
        *[f"_peak_{c}" for c in peaks])


def running_sum(
    df: DataFrame,
    by: Sequence[str],
    ts: str,
    value: str,
    into: str,
    order: Sequence[str] = (),
    width: Duration = WIDTH,
) -> DataFrame:
    """Adds the sum of ``value`` up to and including each row, in order of ``ts`` then ``order``."""
    rows = bucketed(df, ts, width)
    totals = rows.groupBy(*by, "_bucket").agg(F.sum(value).alias("_total"))
    inside = rows.withColumn("_inside", F.sum(value).over(inside_buckets(by, [ts, *order])))
    return (
        join_buckets(inside, before_buckets(totals, by, "_total", F.sum), by)
        .withColumn(into, F.col("_inside") + F.coalesce("_before", F.lit(0)))
        .drop("_bucket", "_inside", "_before")
    )


def with_previous(
    df: DataFrame, by: Sequence[str], ts: str, columns: Sequence[str], width: Duration = WIDTH
) -> DataFrame:
    """Adds ``prev_<c>`` of the row just before each row, for ``ts`` and ``columns``.

    The first row of a bucket takes them from the last row of the nearest
    earlier bucket that has any. ``(by, ts)`` must be unique.
    """
    wanted = [ts, *columns]
    rows = bucketed(df, ts, width)
    inside = Window.partitionBy(*by, "_bucket").orderBy(ts)
    lagged = rows.select("*", *[F.lag(c).over(inside).alias(f"_lag_{c}") for c in wanted])
    last_rows = rows.groupBy(*by, "_bucket").agg(
        F.max(ts).alias(ts), *[F.max_by(c, ts).alias(c) for c in columns]
    )
    buckets = Window.partitionBy(*by).orderBy("_bucket")
    carried = last_rows.select(
        *by, "_bucket", *[F.lag(c).over(buckets).alias(f"_carry_{c}") for c in wanted]
    )
    starts_bucket = F.col(f"_lag_{ts}").isNull()
    return join_buckets(lagged, carried, by).select(
        *df.columns,
        *[
            F.when(starts_bucket, F.col(f"_carry_{c}")).otherwise(F.col(f"_lag_{c}")).alias(f"prev_{c}")
            for c in wanted
        ],
    )
