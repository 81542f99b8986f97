"""Bulk joins against row-by-row answers, with crowded moments and empty buckets."""

from __future__ import annotations

import random

import pytest
from conftest import at
from pyspark.sql import functions as F

from timelens.operators import temporal_joins as tj
from timelens.operators.system import metric_order, sample_at
from conftest import processes, samples


def series(spark, rows):
    return spark.createDataFrame([(h, at(t), v) for h, t, v in rows], "host string, ts timestamp, v long")


def cursors(spark, rows):
    return spark.createDataFrame([(i, h, at(t)) for i, (h, t) in enumerate(rows)], "id long, host string, at timestamp")


def test_as_of_gives_a_cursor_one_of_several_rows_of_a_moment(spark):
    rows = series(spark, [("a", 0, 7), ("a", 0, 9), ("a", 0, 8), ("b", 0, 1)])
    asked = cursors(spark, [("a", 1), ("b", 1), ("a", 0)])
    got = tj.as_of_join(asked, rows.withColumn("w", -F.col("v")), ["host"], how="inner")
    assert sorted((r.id, r.v) for r in got.collect()) == [(0, 9), (1, 1), (2, 9)]
    got = tj.as_of_join(asked, rows.withColumn("w", -F.col("v")), ["host"], tie=["w"])
    assert sorted((r.id, r.v) for r in got.collect()) == [(0, 7), (1, 1), (2, 7)]


def random_case(seed):
    rng = random.Random(seed)
    times = {(rng.choice("ab"), rng.choice([rng.randrange(0, 40), rng.randrange(0, 20000)])) for _ in range(80)}
    rows = [(h, t, i) for i, (h, t) in enumerate(sorted(times))]
    asked = [(rng.choice("abc"), rng.choice([rng.randrange(-5, 60), rng.randrange(-5, 30000)])) for _ in range(60)]
    asked += [("a", 30)] * 40  # many cursors at one moment
    return rows, asked


@pytest.mark.parametrize("seed, width, strict, tolerance", [
    (1, 5, False, None), (2, 300, False, None), (3, 86400, True, None), (4, 60, False, 15), (5, 7, True, 10),
])
def test_as_of_equals_search(spark, seed, width, strict, tolerance):
    rows, asked = random_case(seed)
    got = tj.as_of_join(
        cursors(spark, asked), series(spark, rows), ["host"], width=width, strict=strict, tolerance=tolerance
    ).collect()
    assert len(got) == len(asked)
    for r in got:
        h, t = asked[r.id]
        past = [(rt, v) for rh, rt, v in rows if rh == h and (rt < t or (rt == t and not strict))]
        past = [p for p in past if tolerance is None or t - p[0] <= tolerance]
        expected = max(past) if past else (None, None)
        assert (r.v, r.as_of) == (expected[1], None if expected[0] is None else at(expected[0]))


def test_inner_drops_cursors_without_a_row(spark):
    got = tj.as_of_join(cursors(spark, [("a", -1), ("a", 1)]), series(spark, [("a", 0, 7)]), ["host"], how="inner")
    assert [(r.id, r.v) for r in got.collect()] == [(1, 7)]


def test_bulk_equals_point(spark):
    df = samples(spark, [(t, t) for t in (0, 1, 2, 700, 5000)])
    moments = [-3600, 0, 0.5, 1, 650, 4999.999999, 9999]
    bulk = spark.createDataFrame([(i, at(m)) for i, m in enumerate(moments)], "id long, at timestamp")
    got = {r.id: r.cpu_pct for r in tj.as_of_join(bulk, df, [], how="inner").collect()}
    for i, m in enumerate(moments):
        point = sample_at(df, at(m)).collect()
        assert got.get(i) == (point[0].cpu_pct if point else None)


def test_same_column_on_both_sides_is_refused(spark):
    one = cursors(spark, [("a", 0)])
    with pytest.raises(ValueError):
        tj.as_of_join(one, series(spark, []).withColumnRenamed("v", "id"), ["host"])


def test_process_at(spark):
    procs = processes(spark, [(0, 1, "old", 1, 1), (10, 1, "new", 1, 1), (10, 2, "other", 1, 1)])
    asked = spark.createDataFrame([(1, at(5)), (1, at(10)), (2, at(9)), (3, at(99))], "pid int, at timestamp")
    got = {(r.pid, r.at): r["name"] for r in tj.as_of_join(asked, procs, ["pid"]).collect()}
    assert got == {(1, at(5)): "old", (1, at(10)): "new", (2, at(9)): None, (3, at(99)): None}


def test_top_as_of(spark):
    procs = processes(spark, [(0, 1, "a", 10, 100), (0, 2, "b", 20, 200), (2, 3, "c", 99, 50)])
    asked = spark.createDataFrame([(i, at(t)) for i, t in enumerate((-1, 1, 1, 5))], "id long, at timestamp")
    got = tj.top_as_of(asked, procs, [], metric_order("cpu"), 1).collect()
    assert sorted((r.id, r["name"], r["rank"]) for r in got) == [(1, "b", 1), (2, "b", 1), (3, "c", 1)]


@pytest.mark.parametrize("seed, width, limit, bucket", [
    (1, 10, 3, 60), (2, 200, 5, 60), (3, 3000, 1, 10), (4, 0, 2, 1), (5, 10, 1500, 60),
])
def test_band_join_equals_search(spark, seed, width, limit, bucket):
    rng = random.Random(seed)
    found = [(rng.choice("ab"), rng.choice([30, rng.randrange(0, 100), rng.randrange(0, 9000)]), i) for i in range(150)]
    found += [("a", 30, i) for i in range(150, 200)]  # many events at one moment
    _, asked = random_case(seed)
    events = spark.createDataFrame([(h, at(t), i) for h, t, i in found], "host string, ts timestamp, event_id long")
    got: dict = {}
    pairs = tj.band_join(cursors(spark, asked), events, ["host"], width, limit, bucket_width=bucket)
    for r in pairs.collect():
        got.setdefault(r.id, []).append((r["rank"], r.event_id))
    for i, (h, t) in enumerate(asked):
        near = sorted((et, e) for eh, et, e in found if eh == h and t - width <= et <= t + width)[:limit]
        assert sorted(got.get(i, [])) == [(n, e) for n, (_, e) in enumerate(near, start=1)]


def test_band_join_limits(spark):
    events = spark.createDataFrame([(at(0), 1)], "ts timestamp, event_id long")
    anchors = spark.createDataFrame([(at(0),)], "at timestamp")
    assert tj.band_join(anchors, events, [], 60, 0).count() == 0
    assert tj.band_join(anchors, events, [], 60, 1).count() == 1
    with pytest.raises(ValueError):
        tj.band_join(anchors, events, [], -1, 5)
    with pytest.raises(ValueError):
        tj.band_join(anchors, events, [], 1, -5)


def test_no_pair_join_and_no_broken_plans(spark):
    """The joins by time are planned as equi-joins."""
    rows, asked = random_case(9)
    events = series(spark, rows).withColumn("event_id", F.col("v")).drop("v")
    for df in (
        tj.as_of_join(cursors(spark, asked), series(spark, rows), ["host"]),
        tj.band_join(cursors(spark, asked), events, ["host"], 60, 5),
    ):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("strict", [False, True])
def test_one_sweep_resolves_several_series(spark, strict):
    rng = random.Random(4)
    times = {n: [(h, rng.choice([0, 1, 299, 300, 301, 4000, 90_000]) + rng.randint(0, 5)) for h in "abc" for _ in range(9)] for n in ("s", "p")}
    times["p"] = [t for t in times["p"] if t[0] != "c"] * 2  # none of one host, all rows twice
    asked = [(h, rng.randint(-5, 5) + rng.choice([0, 300, 4000, 90_000, 200_000])) for h in "abcd" for _ in range(12)] * 2
    frame = lambda rows, c: spark.createDataFrame([(h, at(t)) for h, t in rows], f"host string, {c} timestamp").repartition(3)
    got = tj.resolve_times(frame(asked, "at"), {n: frame(t, "ts") for n, t in times.items()}, ["host"], strict=strict).collect()
    assert len(got) == len(set(asked))
    want = lambda n, h, t: max((x for k, x in times[n] if k == h and (x < t if strict else x <= t)), default=None)
    shown = lambda t: None if t is None else at(t)
    assert {(r.host, r.at): (r.s, r.p) for r in got} == {
        (h, at(t)): (shown(want("s", h, t)), shown(want("p", h, t))) for h, t in asked}
