"""The live view: per host the newest sample, rates against the one shown before, CPU
history, and the processes with most CPU of the newest tick."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from timelens.operators.rates import ROLLING_ROWS, per_second
from timelens.schemas import COUNTERS

_FIELDS = ["cpu_pct", "mem_used", "mem_total", *COUNTERS]
_TYPES = {"cpu_pct": "double"}

_STATE = "ts timestamp, " + ", ".join(f"{c} long" for c in COUNTERS) + ", recent array<double>"
_VIEW = (
    "host string, ts timestamp, "
    + ", ".join(f"{c} {_TYPES.get(c, 'long')}" for c in _FIELDS)
    + ", prev_ts timestamp, "
    + ", ".join(f"prev_{c} long" for c in COUNTERS)
    + ", recent array<double>"
)


def _newest(frames: Iterable[pd.DataFrame]) -> pd.DataFrame | None:
    """Newest row per host of all frames, or None."""
    kept = None
    for frame in frames:
        if len(frame):
            both = frame if kept is None else pd.concat([kept, frame])
            kept = both.sort_values("ts").drop_duplicates("host", keep="last")
    return kept


def _newest_of_task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    kept = _newest(frames)
    if kept is not None:
        yield kept


def _refresh(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    row = _newest(frames)
    if row is None:
        return
    now = row.iloc[0]
    if state.exists:
        ts, *counters, recent = state.get
        if now["ts"] <= pd.Timestamp(ts):
            return  # late: it is stored, but the view has moved on
    else:
        ts, counters, recent = None, [None] * len(COUNTERS), []
    recent = [*recent, float(now["cpu_pct"])][-ROLLING_ROWS:]
    state.update((now["ts"].to_pydatetime(), *[int(now[c]) for c in COUNTERS], recent))
    shown = {"host": key[0], "ts": now["ts"], **{c: now[c] for c in _FIELDS}, "prev_ts": ts}
    shown.update({f"prev_{c}": v for c, v in zip(COUNTERS, counters)})
    view = pd.DataFrame([{**shown, "recent": recent}])
    for c in COUNTERS:
        view[f"prev_{c}"] = view[f"prev_{c}"].astype("Int64")
    view["prev_ts"] = pd.to_datetime(view["prev_ts"])
    yield view


def live_view(samples: DataFrame) -> DataFrame:
    """A stream of views, one per host and micro-batch that brought it a newer sample.

    A micro-batch is one refresh: its newest sample is compared with the
    newest of the refresh before. ``recent`` holds the last 60 refreshed CPU
    values. Only the newest row per host leaves a task, so a host that sends
    most of the rows costs no more than another. Counters that could not be
    read count as 0; samples without ``host`` are of one machine.
    """
    by_host = "host" in samples.columns
    host = F.col("host") if by_host else F.lit("")
    # a failed probe counts as 0
    spark_rows = samples.select(
        host.alias("host"), F.col("ts").cast("timestamp").alias("ts"),
        *[F.coalesce(F.col(c).cast(_TYPES.get(c, "long")), F.lit(0).cast(_TYPES.get(c, "long"))).alias(c) for c in _FIELDS])
    reduced = spark_rows.mapInPandas(_newest_of_task, spark_rows.schema)
    views = reduced.groupBy("host").applyInPandasWithState(
        _refresh, _VIEW, _STATE, "append", GroupStateTimeout.NoTimeout
    )
    seconds = (F.unix_micros("ts") - F.unix_micros("prev_ts")) / F.lit(1e6)
    return views.select(
        *(["host"] if by_host else []), "ts", *_FIELDS, "prev_ts",
        *[per_second(F.col(c), F.col(f"prev_{c}"), seconds).alias(f"{c}_rate") for c in COUNTERS],
        "recent",
    )


# Fixed value: processes shown.
SHOWN_PROCESSES = 5

_TOP = "host string, ts timestamp, pid int, name string, cpu_pct double, mem_rss long, revision int"
_OPEN = "ts timestamp, revision int, pids array<int>, names array<string>, cpus array<double>, rss array<long>"


def _heaviest(frames: Iterable[pd.DataFrame], limit: int) -> pd.DataFrame | None:
    """The first ``limit`` processes of each host's newest tick, or None; of a pid the row with most CPU."""
    kept = None
    for frame in frames:
        if len(frame):
            both = frame if kept is None else pd.concat([kept, frame])
            newest = both[both["ts"] == both.groupby("host")["ts"].transform("max")]
            order = newest.sort_values(["cpu_pct", "pid", "mem_rss", "name"], ascending=[False, True, False, True])
            kept = order.drop_duplicates(["host", "pid"]).groupby("host").head(limit)
    return kept


def _refresh_top(limit: int, key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The open tick with what has come of it since; shown anew if that changes it."""
    found = _heaviest(frames, limit)
    if found is None:
        return
    columns = ["pid", "name", "cpu_pct", "mem_rss"]
    revision = 0
    if state.exists:
        ts, revision, *held = state.get
        shown = pd.DataFrame(dict(zip(columns, map(list, held), strict=True)))
        if found["ts"].iloc[0] < pd.Timestamp(ts):
            return  # of a tick that another has followed
        if found["ts"].iloc[0] == pd.Timestamp(ts):
            shown["host"], shown["ts"] = key[0], found["ts"].iloc[0]
            found = _heaviest([shown, found[shown.columns]], limit)
            if found[columns].reset_index(drop=True).astype(object).equals(shown[columns].astype(object)):
                return
            revision += 1
        else:
            revision = 0
    state.update((found["ts"].iloc[0].to_pydatetime(), revision, *[found[c].tolist() for c in columns]))
    yield found.assign(revision=revision)[["host", "ts", *columns, "revision"]]


def live_processes(processes: DataFrame, limit: int = SHOWN_PROCESSES) -> DataFrame:
    """A stream of the ``limit`` processes with most CPU of each host's newest tick.

    The state holds the processes shown of the open tick. Rows of it that a later
    micro-batch brings are merged with them, and if that changes what is
    shown, the whole tick comes out again as the next ``revision`` (0 is the first). A
    newer tick closes it. A process that comes twice in a tick counts by its row with most CPU. Only
    ``limit`` rows per host leave a task, and as many are kept.
    """
    by_host = "host" in processes.columns
    rows = processes.filter(F.col("name").isNotNull()).select(
        (F.col("host") if by_host else F.lit("")).alias("host"), F.col("ts").cast("timestamp").alias("ts"),
        F.col("pid").cast("int").alias("pid"), "name", F.coalesce(F.col("cpu_pct"), F.lit(0.0)).cast("double").alias("cpu_pct"),
        F.coalesce(F.col("mem_rss").cast("long"), F.lit(0).cast("long")).alias("mem_rss"))

    def of_task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = _heaviest(frames, limit)
        if found is not None:
            yield found

    def show(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        return _refresh_top(limit, key, frames, state)

    top = rows.mapInPandas(of_task, rows.schema).groupBy("host").applyInPandasWithState(
        show, _TOP, _OPEN, "append", GroupStateTimeout.NoTimeout)
    return top if by_host else top.drop("host")


def newest_revisions(views: DataFrame) -> DataFrame:
    """Of written views of ticks the last revision of each."""
    by = [c for c in ("host", "ts") if c in views.columns]
    last = views.groupBy(*by).agg(F.max("revision").alias("revision"))
    return views.join(last, [*by, "revision"], "left_semi")
