"""Newest rows of stored tables: which days are read, and that sparse days change nothing."""

from __future__ import annotations

import re
from datetime import timedelta
from pathlib import Path

import pytest
from conftest import T0, at, events, processes, samples
from pyspark.sql import functions as F

from timelens.operators import days, events as ev, system as sy
from timelens.schemas import EVENTS, PROCESSES, SAMPLES, conform, with_host
from timelens.sources.tables import append_load, read_table

DAY = 86400


def stored(spark, folder, rows, schema):
    append_load(conform(rows, schema), str(folder), 0)
    return read_table(spark, str(folder), with_host(schema) if "host" in rows.columns else schema)


def spoil(folder, before):
    """Files of days before the given one can no longer be read."""
    spoilt = 0
    for path in Path(folder).rglob("*.parquet"):
        if re.search(r"date=([\d-]+)", str(path))[1] < before:
            path.write_bytes(b"no parquet")
            (path.parent / f".{path.name}.crc").unlink(missing_ok=True)
            spoilt += 1
    return spoilt


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def filters(df):
    return re.findall(r"PartitionFilters: \[(.*?)\], PushedFilters", plan(df))


@pytest.fixture
def forty_days(spark, tmp_path):
    return stored(spark, tmp_path / "e", events(spark, [(-DAY * d - k, "u", f"{d}.{k}") for d in range(40) for k in range(5)]), EVENTS)


def test_latest_events_read_one_day(spark, tmp_path, forty_days):
    assert len(days.stored_days(forty_days)) == 40
    assert spoil(tmp_path / "e", "2024-01-15") == 39
    got = ev.latest_events(forty_days, 4)
    assert [r.message for r in got.collect()] == ["0.0", "0.1", "0.2", "0.3"]
    assert filters(got) and all("date" in f for f in filters(got))
    assert "date" not in got.columns
    with pytest.raises(Exception, match="(?i)parquet"):
        ev.latest_events(forty_days, 6).collect()


@pytest.mark.parametrize("limit", [0, 1, 5, 6, 17, 199, 200, 500])
def test_latest_events_are_those_of_all_days(forty_days, limit):
    whole = ev.latest_events(forty_days.drop("date"), limit).collect()
    assert ev.latest_events(forty_days, limit).collect() == whole and len(whole) == min(limit, 200)


def test_sparse_days_and_moments(spark, tmp_path):
    rows = [(0, 1.0), (-3 * DAY, 2.0), (-3 * DAY - 60, 3.0), (-39 * DAY, 4.0)]
    table = stored(spark, tmp_path / "s", samples(spark, rows), SAMPLES)
    assert [r.cpu_pct for r in sy.latest_sample(table).collect()] == [1.0]
    for seconds, cpu in ((-1, 2.0), (-DAY, 2.0), (-3 * DAY - 1, 3.0), (-3 * DAY - 61, 4.0), (-10 * DAY, 4.0)):
        for moment in (at(seconds), str(at(seconds))):
            found = sy.sample_at(table, moment)
            assert [r.cpu_pct for r in found.collect()] == [cpu], seconds
            assert filters(found) and all("date" in f for f in filters(found))
    assert sy.sample_at(table, at(-40 * DAY)).collect() == []


def test_a_moment_does_not_read_days_around_it(spark, tmp_path):
    table = stored(spark, tmp_path / "s", samples(spark, [(-DAY * d, float(d)) for d in range(40)]), SAMPLES)
    folder = tmp_path / "s"
    spoil(folder, "2024-01-10")
    for path in folder.rglob("*.parquet"):
        if re.search(r"date=([\d-]+)", str(path))[1] > "2024-01-10":
            path.write_bytes(b"no parquet")
            (path.parent / f".{path.name}.crc").unlink(missing_ok=True)
    assert [r.cpu_pct for r in sy.sample_at(table, T0 - timedelta(days=5)).collect()] == [5.0]


def test_newest_batch_of_processes(spark, tmp_path):
    table = stored(spark, tmp_path / "p", processes(spark, [
        (-2 * DAY, 1, "old", 99.0, 1), (0, 2, "a", 1.0, 9), (0, 3, "b", 5.0, 1), (-1, 4, "c", 50.0, 1)]), PROCESSES)
    assert spoil(tmp_path / "p", "2024-01-15") == 1
    assert [r.name for r in sy.top_processes(table).collect()] == ["b", "a"]


def test_known_series_bound_the_walk(spark, tmp_path):
    rows = samples(spark, [(-DAY * d, float(d)) for d in range(40)]).withColumn(
        "host", F.when(F.col("cpu_pct") % 3 == 0, "a").when(F.col("cpu_pct") == 5, "b").otherwise("c"))
    table = stored(spark, tmp_path / "f", rows, SAMPLES)
    known = spark.createDataFrame([("a",), ("b",), ("c",)], "host string")
    want = {("a", 0.0), ("b", 5.0), ("c", 1.0)}
    assert {(r.host, r.cpu_pct) for r in sy.latest_sample(table, ["host"]).collect()} == want
    spoil(tmp_path / "f", "2024-01-09")
    found = sy.latest_sample(table, ["host"], known)
    assert {(r.host, r.cpu_pct) for r in found.collect()} == want
    assert any("date" in f for f in filters(found))
    assert {(r.host, r.cpu_pct) for r in sy.sample_at(table, at(-DAY), ["host"], known.filter("host <> 'b'")).collect()} == {("a", 3.0), ("c", 1.0)}


def test_series_without_rows(spark, tmp_path):
    table = stored(spark, tmp_path / "f", samples(spark, [(-DAY * d, float(d)) for d in range(9)]).withColumn("host", F.lit("a")), SAMPLES)
    known = spark.createDataFrame([("a",), ("never",)], "host string")
    assert [r.cpu_pct for r in sy.latest_sample(table, ["host"], known).collect()] == [0.0]
