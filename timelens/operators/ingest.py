"""From raw readings to table rows: samples per tick, top processes, first-wins keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from timelens.operators.topk import top_per_group
from timelens.schemas import COUNTERS

# Fixed value: processes kept per tick.
KEPT_PER_TICK = 10


GAUGES = ["cpu_pct", "mem_used", "mem_total"]


def tick_sums(devices: DataFrame, gauges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per tick the gauges and the counters summed over disks and network devices; NULL without a reading.

    Both inputs are stacked and summed in one shuffle, with partial sums before it.
    """
    kind_columns = [
        F.when(F.col("kind") == kind, F.col(column)).alias(name)
        for kind, column, name in [
            ("disk", "in_bytes", "disk_read"), ("disk", "out_bytes", "disk_write"),
            ("net", "in_bytes", "net_rx"), ("net", "out_bytes", "net_tx"),
        ]
    ]
    readings = devices.select(*by, "ts", *kind_columns).unionByName(
        gauges.select(*by, "ts", *GAUGES), allowMissingColumns=True
    )
    return _summed(readings, by)


def _summed(parts: DataFrame, by: Sequence[str]) -> DataFrame:
    return parts.groupBy(*by, "ts").agg(
        *[F.max(c).alias(c) for c in GAUGES], *[F.try_sum(c).cast("long").alias(c) for c in COUNTERS])


def add_tick_sums(parts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One sample per tick from parts of it; whatever a tick has no reading for is 0."""
    whole = _summed(parts, by)
    return whole.select(
        *by, "ts", *[F.coalesce(c, F.lit(0)).cast(whole.schema[c].dataType).alias(c) for c in [*GAUGES, *COUNTERS]])


def build_samples(devices: DataFrame, gauges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One sample per tick from device counters and gauges.

    Counters are summed over the disks and over the network devices of a
    tick; whatever a tick has no reading for is 0.
    """
    sums = tick_sums(devices, gauges, by)
    return sums.select(
        *by, "ts", *[F.coalesce(c, F.lit(0)).cast(sums.schema[c].dataType).alias(c) for c in [*GAUGES, *COUNTERS]])


def top_per_tick(
    processes: DataFrame, by: Sequence[str] = (), limit: int = KEPT_PER_TICK
) -> DataFrame:
    """The ``limit`` processes with most CPU of every tick.

    Processes without a name are left out; unread CPU or memory counts as 0.
    """
    named = processes.filter(F.col("name").isNotNull()).na.fill({"cpu_pct": 0.0, "mem_rss": 0})
    # two readings of one pid: the one that arrived first
    order = [F.desc("cpu_pct"), F.asc("pid"), *([F.asc("ingest_seq")] if "ingest_seq" in named.columns else [])]
    return top_per_group(named, [*by, "ts"], order, limit, rank="_rank").drop("_rank")


def first_wins(
    arrived: DataFrame,
    key: Sequence[str],
    arrival: str = "ingest_seq",
    stored: DataFrame | None = None,
) -> DataFrame:
    """Of rows with the same key the one that arrived first, unless the key is already stored.

    ``arrival`` must be an explicit arrival number; row order is not one.
    """
    first = top_per_group(arrived, key, [F.asc(arrival)], 1, rank="_rank").drop("_rank")
    if stored is None:
        return first
    return first.join(stored.select(*key), list(key), "left_anti")
