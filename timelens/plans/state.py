"""Composed views: the state of a machine at past moments, and now."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from timelens.functions.columns import mem_pct, percent_band
from timelens.functions.timing import Duration, shifted, to_micros
from timelens.operators import events as ev
from timelens.operators.rates import (
    HISTORY_GAP, HISTORY_SECONDS, TREND_SECONDS, near_windows, peak_of, rates, scaled,
    window_rows, within_gap,
)
from timelens.operators.running import with_window_ends
from timelens.operators.system import metric_order
from timelens.operators.temporal_joins import as_of_times, resolve_times
from timelens.operators.topk import top_per_group
from timelens.schemas import COUNTERS

TOP_SHOWN = 5
EVENTS_SHOWN = 10
EVENTS_AROUND = 30  # seconds
RATE_NAMES = [f"{c}_rate" for c in COUNTERS]


def sample_views(
    points: DataFrame,
    samples: DataFrame,
    by: Sequence[str],
    max_gap: Duration | None = HISTORY_GAP,
    history_seconds: Duration = HISTORY_SECONDS,
    trend_seconds: Duration = TREND_SECONDS,
    previous: DataFrame | None = None,
) -> DataFrame:
    """Everything shown of the samples at ``(by, as_of)``: one row each.

    The sample's own values and rates; ``history``, the CPU values up to it;
    ``trends``, its trend window with ``disk`` and ``net`` scaled to
    ``disk_peak`` and ``net_peak`` (empty below two samples). One join brings
    each point the samples of its window, one aggregate makes all of it.
    Without ``max_gap`` rates reach back to the sample before, however old;
    ``previous`` has the times of those, where they are known.
    """
    reach = max(to_micros(history_seconds), to_micros(trend_seconds), to_micros(max_gap or 0)) / 1e6
    near = near_windows(samples, points, by, "as_of", reach)
    if max_gap is None:
        before = previous
        if before is None:
            before = as_of_times(points, samples, by, "as_of", strict=True, into="ts").select(*by, "ts")
        near = near.unionByName(samples.join(before.distinct(), [*by, "ts"], "left_semi")).distinct()
    rows = window_rows(points, rates(near, by), by, "as_of", reach)

    at, ts = F.col("as_of"), F.col("ts")
    trend_start = shifted(at, -to_micros(trend_seconds) / 1e6)
    in_trend = ts >= trend_start
    restarted = F.coalesce(F.col("prev_ts") >= trend_start, F.lit(False))
    disk = F.when(restarted, F.col("disk_rate")).otherwise(F.lit(0)).cast("double")
    net = F.when(restarted, F.col("net_rate")).otherwise(F.lit(0)).cast("double")
    own_columns = [c for c in samples.columns if c not in (*by, "ts")]

    def own_rate(name: str) -> Column:
        return F.col(name) if max_gap is None else within_gap(name, max_gap)

    own = F.when(
        ts == at, F.struct(*[F.col(c) for c in own_columns], *[own_rate(c).alias(c) for c in RATE_NAMES])
    )
    point = F.struct(
        "ts", F.col("cpu_pct").alias("cpu"), mem_pct(F.col("mem_used"), F.col("mem_total")).alias("mem"),
        disk.alias("disk"), net.alias("net"),
    )
    collected = (
        rows.select(*by, "as_of", own.alias("_own"), point.alias("_point"), in_trend.alias("_in_trend"))
        .groupBy(*by, "as_of")
        .agg(
            F.first("_own", ignorenulls=True).alias("_own"),
            F.sort_array(F.collect_list("_point")).alias("_points"),
            peak_of(F.when(F.col("_in_trend"), F.col("_point.disk"))).alias("_disk_peak"),
            peak_of(F.when(F.col("_in_trend"), F.col("_point.net"))).alias("_net_peak"),
        )
    )
    history_start = shifted(at, -to_micros(history_seconds) / 1e6)
    windows = collected.select(
        *by, "as_of", "_own.*", "_disk_peak", "_net_peak",
        F.filter("_points", lambda p: p["ts"] >= history_start).alias("_history"),
        F.filter("_points", lambda p: p["ts"] >= trend_start).alias("_trend"),
    )
    enough = F.size("_trend") >= 2
    return windows.select(
        *by, "as_of", *own_columns, *RATE_NAMES,
        mem_pct(F.col("mem_used"), F.col("mem_total")).alias("mem_pct"),
        percent_band(F.col("cpu_pct")).alias("cpu_band"),
        F.transform("_history", lambda p: p["cpu"]).alias("history"),
        F.transform(
            F.when(enough, F.col("_trend")).otherwise(F.slice("_trend", 1, 0)),
            lambda p: F.struct(
                p["ts"].alias("ts"), p["cpu"].alias("cpu"), p["mem"].alias("mem"),
                scaled(p["disk"], F.col("_disk_peak")).alias("disk"),
                scaled(p["net"], F.col("_net_peak")).alias("net"),
            ),
        ).alias("trends"),
        F.when(enough, F.col("_disk_peak")).otherwise(F.lit(0.0)).alias("disk_peak"),
        F.when(enough, F.col("_net_peak")).otherwise(F.lit(0.0)).alias("net_peak"),
    )


WINDOW_ENDS = ["history_n", "history_first", "trend_n", "trend_from", "disk_last", "net_last"]


def sample_ends(
    points: DataFrame,
    samples: DataFrame,
    by: Sequence[str],
    max_gap: Duration = HISTORY_GAP,
    history_seconds: Duration = HISTORY_SECONDS,
    trend_seconds: Duration = TREND_SECONDS,
) -> DataFrame:
    """`sample_views` with sizes and ends (`WINDOW_ENDS`) in place of the arrays ``history`` and ``trends``.

    Both windows are made for every sample near a point by running values, so the work grows with
    samples and points, and not with their product. A window's samples but its oldest are those
    whose predecessor lies in it too.
    """
    reach = max(to_micros(history_seconds), to_micros(trend_seconds), to_micros(max_gap)) / 1e6
    own_columns = [c for c in samples.columns if c not in (*by, "ts")]
    rated = rates(near_windows(samples, points, by, "as_of", reach), by)
    known = with_window_ends(rated, by, "ts", history_seconds, ["cpu_pct"], []).select(
        *rated.columns, F.col("_n").alias("history_n"), F.col("_first_cpu_pct").alias("history_first"))
    known = with_window_ends(known, by, "ts", trend_seconds, ["prev_ts"], ["disk_rate", "net_rate"], since="prev_ts")
    at_points = known.withColumnRenamed("ts", "as_of").join(points, [*by, "as_of"], "left_semi")
    one = top_per_group(at_points, [*by, "as_of"], [F.desc(c) for c in own_columns], 1, rank="_nth")
    enough, restarted = F.col("_n") >= 1, F.col("prev_ts") >= shifted(F.col("as_of"), -to_micros(trend_seconds) / 1e6)

    def peak(rate: str) -> Column:
        return F.greatest(F.col(f"_peak_{rate}").cast("double"), F.lit(0.0))

    def last(rate: str) -> Column:
        value = F.when(restarted, F.col(rate)).otherwise(F.lit(0)).cast("double")
        return F.when(enough, scaled(value, peak(rate)))

    return one.select(
        *by, "as_of", *own_columns, *[within_gap(c, max_gap, "as_of").alias(c) for c in RATE_NAMES],
        mem_pct(F.col("mem_used"), F.col("mem_total")).alias("mem_pct"),
        percent_band(F.col("cpu_pct")).alias("cpu_band"),
        F.col("history_n").cast("int").alias("history_n"), "history_first",
        F.when(enough, F.col("_n") + 1).otherwise(F.lit(0)).cast("int").alias("trend_n"),
        F.col("_first_prev_ts").alias("trend_from"),
        last("disk_rate").alias("disk_last"), last("net_rate").alias("net_last"),
        F.when(enough, peak("disk_rate")).otherwise(F.lit(0.0)).alias("disk_peak"),
        F.when(enough, peak("net_rate")).otherwise(F.lit(0.0)).alias("net_peak"),
    )


def batch_views(points: DataFrame, processes: DataFrame, by: Sequence[str], limit: int) -> DataFrame:
    """Per ``(by, batch_ts)`` the top processes by CPU, as one array in rank order."""
    wanted = points.select(*by, F.col("batch_ts").alias("ts")).distinct()
    ranked = top_per_group(
        processes.join(wanted, [*by, "ts"], "left_semi"), [*by, "ts"], metric_order("cpu"), limit
    )
    entry = F.struct("rank", "pid", "name", "cpu_pct", "mem_rss")
    return (
        ranked.groupBy(*by, F.col("ts").alias("batch_ts"))
        .agg(F.sort_array(F.collect_list(entry)).alias("top"))
    )


def state_at(
    cursors: DataFrame,
    samples: DataFrame,
    processes: DataFrame,
    by: Sequence[str] = (),
    at: str = "at",
    max_gap: Duration | None = HISTORY_GAP,
    history_seconds: Duration = HISTORY_SECONDS,
    trend_seconds: Duration = TREND_SECONDS,
    top: int = TOP_SHOWN,
    whole: bool = True,
) -> DataFrame:
    """The state of the system at every cursor; cursors before the first sample have none.

    Without ``whole`` it has `WINDOW_ENDS`, which take no more work for wider windows, in
    place of the arrays ``history`` and ``trends``; ``max_gap`` is then not None.

    Cursors are reduced to distinct moments, those to distinct samples and
    distinct process batches; windows, trends and tops are made once for each
    of these, and joined back last. One sweep over cursors, samples and
    batches finds which sample and which batch a moment falls on; no job runs
    before the result is asked for.
    """
    moments = resolve_times(cursors, {"as_of": samples, "batch_ts": processes}, by, at).filter(
        F.col("as_of").isNotNull()).persist(StorageLevel.DISK_ONLY)
    view = sample_views if whole else sample_ends
    sampled = view(
        moments.select(*by, "as_of").distinct(), samples, by, max_gap, history_seconds, trend_seconds
    )
    topped = batch_views(moments.filter(F.col("batch_ts").isNotNull()), processes, by, top)
    return (
        cursors.join(moments, [*by, at])
        .join(sampled, [*by, "as_of"])
        .join(topped, [*by, "batch_ts"], "left")
        .withColumnRenamed("as_of", "sample_ts")
    )


def live_snapshot(
    samples: DataFrame,
    processes: DataFrame,
    by: Sequence[str] = (),
    trend_seconds: Duration = TREND_SECONDS,
    top: int = TOP_SHOWN,
) -> DataFrame:
    """The newest state (per series): rates against the sample before it, however old,
    and the top of the newest process batch, whatever its time."""
    two = top_per_group(samples.filter(F.col("ts").isNotNull()).select(*by, "ts"), by, [F.desc("ts")], 2)
    newest = two.filter("rank = 1").select(*by, F.col("ts").alias("as_of"))
    before = two.filter("rank = 2").select(*by, "ts")
    view = sample_views(newest, samples, by, max_gap=None, trend_seconds=trend_seconds, previous=before)
    batch = processes.groupBy(*by).agg(F.max("ts").alias("batch_ts")).filter(F.col("batch_ts").isNotNull())
    topped = batch_views(batch, processes, by, top)
    if by:
        joined = view.join(topped, list(by), "left")
    else:
        joined = view.withColumns({c: topped.select(c).scalar() for c in ("batch_ts", "top")})
    return joined.withColumnRenamed("as_of", "sample_ts")


def events_at(events: DataFrame, at: datetime | None = None) -> DataFrame:
    """Events around a past moment, oldest first; without one the newest events."""
    if at is None:
        return ev.latest_events(events, EVENTS_SHOWN)
    return ev.events_near(events, at, EVENTS_AROUND, EVENTS_SHOWN)
