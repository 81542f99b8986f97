from __future__ import annotations

from conftest import T0, at, processes, samples
from pyspark.sql import functions as F

from timelens.operators import system as sy
from timelens.schemas import EVENTS, conform


def cpus(df):
    return [r.cpu_pct for r in df.collect()]


def test_no_rows_rather_than_nulls(spark):
    none = samples(spark, [])
    assert cpus(sy.latest_sample(none)) == []
    assert sy.time_bounds(none).count() == 0
    assert cpus(sy.sample_at(none, T0)) == []


def test_latest_sample(spark):
    assert cpus(sy.latest_sample(samples(spark, [(-1, 10), (0, 50)]))) == [50.0]


def test_range_includes_both_ends(spark):
    df = samples(spark, [(0, 1), (1, 2), (2, 3), (3, 4)])
    assert cpus(sy.samples_in_range(df, at(1), at(2))) == [2.0, 3.0]
    assert cpus(sy.samples_in_range(df, at(2), at(1))) == []


def test_as_of(spark):
    df = samples(spark, [(0, 10), (1, 20), (2, 30)])
    assert cpus(sy.sample_at(df, at(0.5))) == [10.0]
    assert cpus(sy.sample_at(df, at(1))) == [20.0]
    assert cpus(sy.sample_at(df, at(-3600))) == []


def test_bounds(spark):
    row = sy.time_bounds(samples(spark, [(1, 1), (0, 1), (2, 1)])).first()
    assert (row.min_ts, row.max_ts) == (T0, at(2))


TOP = [(0, 1, "alpha", 5, 100), (0, 2, "beta", 50, 50), (0, 3, "gamma", 25, 200)]


def names(df):
    return [r.name for r in df.collect()]


def test_top_by_metric_and_limit(spark):
    df = processes(spark, TOP)
    assert names(sy.top_processes(df, "cpu", 10)) == ["beta", "gamma", "alpha"]
    assert names(sy.top_processes(df, "mem", 10)) == ["gamma", "alpha", "beta"]
    assert names(sy.top_processes(df, "anything", 1)) == ["beta"]


def test_top_of_latest_batch_only(spark):
    df = processes(spark, [(-60, 99, "gone", 95, 1), (0, 1, "current", 5, 50)])
    assert names(sy.top_processes(df)) == ["current"]


def test_top_batch_as_of(spark):
    df = processes(spark, [(0, 1, "a", 10, 100), (0, 2, "b", 20, 200), (2, 3, "c", 99, 50)])
    assert names(sy.top_processes(df, at=at(1))) == ["b", "a"]
    assert names(sy.top_processes(df, at=at(5))) == ["c"]
    assert names(sy.top_processes(df, at=at(-1))) == []


def test_nulls_rank_last_and_ties_by_pid(spark):
    df = processes(spark, [(0, 3, "x", None, 1), (0, 2, "y", 1, 1), (0, 1, "z", 1, 1)])
    assert names(sy.top_processes(df)) == ["z", "y", "x"]


def test_per_host(spark):
    df = processes(spark, TOP).withColumn("host", F.lit("h1")).unionByName(
        processes(spark, [(9, 7, "other", 1, 1)]).withColumn("host", F.lit("h2"))
    )
    got = {(r.host, r.rank): r.name for r in sy.top_processes(df, "cpu", 2, by=["host"]).collect()}
    assert got == {("h1", 1): "beta", ("h1", 2): "gamma", ("h2", 1): "other"}
    assert sy.latest_rows(df, ["host"]).count() == 4


def test_conform_adds_and_is_idempotent(spark):
    old = spark.createDataFrame([("h", 1, "m")], "host string, event_id int, message string")
    once = conform(old, EVENTS)
    assert once.columns == ["host", *EVENTS.names]
    assert [f.dataType for f in once.schema.fields[1:]] == [f.dataType for f in EVENTS.fields]
    assert conform(once, EVENTS).collect() == once.collect()
    assert once.first().embedding is None


def test_moments_are_utc_whatever_the_zone_of_the_driver(spark, tmp_path):
    import os
    import subprocess
    import sys
    from pathlib import Path

    code = (
        "from datetime import datetime\n"
        "from pyspark.sql import functions as F\n"
        "from timelens.session import build_session\n"
        "from timelens.operators import system as sy, events as ev\n"
        "s = build_session('zone', 'local[1]', **{'spark.ui.enabled': 'false', 'spark.sql.shuffle.partitions': '1'})\n"
        "df = s.range(24).select(F.timestamp_seconds(F.lit(1705276800) + F.col('id') * 3600).alias('ts'), F.col('id').alias('cpu_pct'))\n"
        "row = sy.sample_at(df, datetime(2024, 1, 15, 12)).first()\n"
        "span = sy.samples_in_range(df, datetime(2024, 1, 15, 3), datetime(2024, 1, 15, 5)).collect()\n"
        "print('GOT', row.cpu_pct, [r.cpu_pct for r in span])\n"
    )
    root = str(Path(__file__).resolve().parents[1])
    for zone in ("America/New_York", "Asia/Kolkata"):
        done = subprocess.run([sys.executable, "-c", code], env={**os.environ, "TZ": zone, "PYTHONPATH": root},
                              capture_output=True, text=True, timeout=300)
        assert "GOT 12 [3, 4, 5]" in done.stdout, done.stdout + done.stderr[-2000:]
