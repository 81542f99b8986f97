"""Named queries, composed views, and what the optimizer makes of them."""

from __future__ import annotations

import json
import random
from datetime import timedelta

import pytest
from conftest import T0, at, events, processes, samples
from pyspark.sql import functions as F

from timelens.operators import events as ev, rates as ra, system as sy
from timelens.operators.embedding import embed_pending, hashing_embedder, with_embeddings
from timelens.plans import catalog, state, tools


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_defaults_and_checks(spark):
    df = events(spark, [(-3600, "u", "edge"), (-3601, "u", "before"), (0, "u", "now")])
    assert [r.message for r in tools.events_search(df, T0, "e").collect()] == ["edge"]
    assert tools.events_latest(df).count() == 3
    assert [r.message for r in tools.events_near_time(df, T0, 3600).collect()] == ["before", "edge"]
    for bad in (
        lambda: tools.events_search(df, T0, ""),
        lambda: tools.events_near_time(df, T0, 0),
        lambda: tools.events_near_time(df, T0, -5),
        lambda: tools.system_metrics_history(df, T0, 0, 0),
        lambda: tools.system_metrics_history(df, T0, 10, 20),
        lambda: tools.events_latest(df, -1),
        lambda: tools.events_semantic_search(df, T0, "", hashing_embedder()),
    ):
        with pytest.raises(ValueError):
            bad()
    for bad in (
        lambda: tools.events_search(df, T0, 7),
        lambda: tools.events_search(df, T0, "x", since_seconds_ago="60"),
        lambda: tools.events_latest(df, "20"),
        lambda: tools.events_latest(df, True),
        lambda: tools.system_top_processes(df, 3),
    ):
        with pytest.raises(TypeError):
            bad()
    assert len(tools.TOOLS) == 7


def test_history_window(spark):
    df = samples(spark, [(-301, 1), (-300, 2), (0, 3), (1, 4)])
    assert [r.cpu_pct for r in tools.system_metrics_history(df, T0).collect()] == [2.0, 3.0]
    assert [r.cpu_pct for r in tools.system_current_metrics(df).collect()] == [4.0]


def test_text_query(spark):
    embedder = hashing_embedder(256)
    df = events(spark, [(-10, "", "disk failure"), (-20, "", "all is well"), (-90000, "", "disk failure long ago")])
    df = with_embeddings(df, embed_pending(df, embedder))
    got = tools.events_semantic_search(df, T0, "disk failure", embedder, limit=5).collect()
    assert [r.message for r in got] == ["disk failure", "all is well"]


def test_json_rows(spark):
    df = events(spark, [(0.5, "u", "m")])
    row = json.loads(tools.as_json(ev.latest_events(df)).first().value)
    assert row == {
        "at": "2024-01-15T12:00:00.5Z", "event_id": 1, "priority": 6, "unit": "u", "source": "", "pid": 0, "message": "m"}


def test_state_at_a_past_moment(spark):
    sampled = samples(spark, [
        (0, 10, 0, 0, 0, 0), (1, 20, 100, 0, 7, 0), (2, 30, 150, 0, 7, 0), (100, 90, 10150, 0, 7, 0)])
    procs = processes(spark, [(0, p, f"p{p}", p, 1) for p in range(1, 9)] + [(50, 1, "late", 1, 1)])
    asked = spark.createDataFrame([(i, at(t)) for i, t in enumerate((-1, 0, 1.5, 1.5, 2.9, 500))], "id long, at timestamp")
    got = {r.id: r for r in state.state_at(asked, sampled, procs).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5]
    assert got[1].history == [10.0] and got[1].trends == [] and got[1].disk_read_rate == 0
    assert got[2].sample_ts == at(1) and got[2].disk_read_rate == 100 and got[2].net_rx_rate == 7
    assert got[2].asDict() | {"id": 3} == got[3].asDict()
    assert got[4].history == [10.0, 20.0, 30.0]
    assert [(p.cpu, p.disk, p.net) for p in got[4].trends] == [(10.0, 0.0, 0.0), (20.0, 100.0, 100.0), (30.0, 50.0, 0.0)]
    assert (got[4].disk_peak, got[4].net_peak, got[4].mem_pct) == (100.0, 7.0, 50.0)
    assert [p.pid for p in got[4].top] == [8, 7, 6, 5, 4]
    # the sample before is 98 s old: no rate of its own, but a point of the trend
    assert got[5].disk_read_rate == 0 and got[5].disk_peak == 102.0 and got[5].history == [90.0]
    assert [p.name for p in got[5].top] == ["late"]


def test_state_without_processes(spark):
    asked = spark.createDataFrame([(at(0),)], "at timestamp")
    row = state.state_at(asked, samples(spark, [(0, 1)]), processes(spark, [])).first()
    assert row.top is None and row.batch_ts is None and row.cpu_pct == 1.0


def test_live_snapshot_takes_rates_however_old(spark):
    sampled = samples(spark, [(0, 1, 0, 0, 0, 0), (1000, 2, 5000, 0, 0, 0)])
    procs = processes(spark, [(2000, 1, "p", 1, 1)])
    row = state.live_snapshot(sampled, procs).first()
    assert (row.disk_read_rate, row.trends, row.top[0]["name"]) == (5, [], "p")
    both = [df.withColumn("host", F.lit("a")) for df in (sampled, procs)]
    keyed = state.live_snapshot(*both, by=["host"]).first()
    assert (keyed.host, keyed.disk_read_rate, keyed.top[0]["name"]) == ("a", 5, "p")
    assert state.live_snapshot(samples(spark, []), procs).count() == 0


def test_events_at(spark):
    df = events(spark, [(s, "u", f"m{s}") for s in range(-40, 41, 5)])
    assert [r.message for r in state.events_at(df, T0).collect()] == [f"m{s}" for s in range(-30, 20, 5)]
    assert state.events_at(df).first().message == "m40"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stored"))
    events(spark, [(s, "u", f"m{s}") for s in range(200)]).write.parquet(path + "/events")
    samples(spark, [(s, s) for s in range(200)]).write.parquet(path + "/samples")
    return spark.read.parquet(path + "/events"), spark.read.parquet(path + "/samples")


def test_time_filters_reach_the_scan(stored):
    stored_events, stored_samples = stored
    for df in (
        ev.search_events(stored_events, "m", at(10)),
        ev.events_near(stored_events, at(10), timedelta(seconds=5)),
        sy.samples_in_range(stored_samples, at(1), at(2)),
        sy.sample_at(stored_samples, at(5)),
        ev.latest_events(stored_events),
    ):
        assert "GreaterThanOrEqual(ts" in plan(df) or "LessThanOrEqual(ts" in plan(df) or "ScalarSubquery" in plan(df)
    assert "EqualTo(ts,ScalarSubquery" in plan(sy.latest_sample(stored_samples))


def test_only_needed_columns_are_read(stored):
    stored_events, stored_samples = stored
    assert "ReadSchema: struct<ts:timestamp>" in plan(sy.time_bounds(stored_samples))
    assert "embedding" not in plan(ev.latest_events(stored_events)).split("ReadSchema")[1]


def test_top_k_does_not_sort_everything(stored):
    assert "TakeOrderedAndProject" in plan(ev.latest_events(stored[0]))
    rows = stored[1].select("ts", "cpu_pct", F.col("mem_used").alias("pid"), F.col("cpu_pct").cast("string").alias("host"))
    top = sy.top_processes(rows, by=["host"])
    assert "WindowGroupLimit" in plan(top)


def test_rates_stay_in_the_jvm_and_off_single_tasks(stored):
    text = plan(ra.rates(stored[1].withColumn("host", F.col("cpu_pct").cast("string")), ["host"]))
    assert "Python" not in text and "SinglePartition" not in text and "NestedLoop" not in text


def test_state_at_runs_no_job_before_it_is_asked(spark):
    cursors = spark.createDataFrame([(at(5),), (at(65),)], "at timestamp")
    rows = samples(spark, [(0, 1.0), (60, 2.0)])
    found = processes(spark, [(0, 1, "a", 1.0, 1), (60, 2, "b", 2.0, 1)])
    spark.sparkContext.setJobGroup("asked", "state_at")
    try:
        view = state.state_at(cursors, rows, found)
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("asked")
        assert [r.cpu_pct for r in view.orderBy("at").collect()] == [1.0, 2.0]
    finally:
        spark.sparkContext.setJobGroup("tests", "")


def test_state_ends_are_those_of_the_whole_windows(spark):
    rng = random.Random(3)
    times = sorted({rng.choice([rng.randrange(0, 300), rng.randrange(0, 3000)]) for _ in range(120)})
    rows = samples(spark, [(t, rng.randrange(100), *[rng.randrange(10**6) for _ in range(4)]) for t in times])
    asked = spark.createDataFrame([(i, at(rng.randrange(-5, 3200))) for i in range(200)], "id long, at timestamp")
    procs = processes(spark, [(0, 1, "a", 1, 1)])
    whole = state.state_at(asked, rows, procs, max_gap=20, history_seconds=40, trend_seconds=90)
    ends = state.state_at(asked, rows, procs, max_gap=20, history_seconds=40, trend_seconds=90, whole=False)
    key = lambda view: sorted(tuple(map(str, r)) for r in catalog._flat(view, "id", "at").collect())
    assert key(ends) == key(whole)
    assert "collect_list(_point" not in ends._jdf.queryExecution().toString()
