from __future__ import annotations

from datetime import date

import pytest
from conftest import T0, at, events, processes, samples
from pyspark.sql import functions as F

from timelens.operators import ingest
from timelens.operators.topk import top_per_group
from timelens.schemas import EVENTS, PROCESS_KEY, PROCESSES, SAMPLE_KEY, SAMPLES, conform
from timelens.sources.tables import append_events, append_first_wins, number_rows, read_table, spread_by_time


def numbered(df):
    return df.withColumn("ingest_seq", F.monotonically_increasing_id())


def test_samples_sum_devices_and_zero_failed_probes(spark):
    devices = spark.createDataFrame(
        [(at(0), "disk", "sda", 5, 1), (at(0), "disk", "sdb", 7, 2), (at(0), "net", "eth0", 11, 12), (at(1), "disk", "sda", 6, 1)],
        "ts timestamp, kind string, device string, in_bytes long, out_bytes long",
    )
    gauges = spark.createDataFrame(
        [(at(0), 12.5, 3, 4), (at(2), 1.0, None, None)], "ts timestamp, cpu_pct double, mem_used long, mem_total long"
    )
    got = ingest.build_samples(devices, gauges)
    assert got.columns == SAMPLES.names
    assert [tuple(r)[1:] for r in got.orderBy("ts").collect()] == [
        (12.5, 3, 4, 12, 3, 11, 12), (0.0, 0, 0, 6, 1, 0, 0), (1.0, 0, 0, 0, 0, 0, 0)]


@pytest.mark.parametrize("count", [3, 10, 25])
def test_top_per_tick(spark, count):
    rows = [(0, pid, f"p{pid}", pid // 2, 1) for pid in range(count)]
    rows += [(0, 900, None, 99, 1), (1, 5, "alone", None, None)]
    got = ingest.top_per_tick(processes(spark, rows)).collect()
    first = [r.pid for r in got if r.ts == T0]
    assert sorted(first) == sorted(sorted(range(count), key=lambda p: (-(p // 2), p))[:10])
    assert [(r.cpu_pct, r.mem_rss) for r in got if r.ts != T0] == [(0.0, 0)]


def test_large_limits_keep_whole_groups(spark):
    df = spark.range(5000).withColumn("g", F.lit(1))
    assert top_per_group(df, ["g"], [F.asc("id")], 3000).agg(F.max("id"), F.count("*")).first()[:] == (2999, 3000)


def test_first_wins_in_batch_and_against_the_table(spark):
    rows = samples(spark, [(0, 1), (0, 99), (1, 5)])
    seq = F.when(F.col("cpu_pct") == 99, 0).otherwise(1)
    got = ingest.first_wins(rows.withColumn("ingest_seq", seq), SAMPLE_KEY)
    assert sorted(r.cpu_pct for r in got.collect()) == [5.0, 99.0]
    got = ingest.first_wins(numbered(rows.coalesce(1)), SAMPLE_KEY, stored=samples(spark, [(1, 7)]))
    assert [r.cpu_pct for r in got.collect()] == [1.0]


def test_sample_table_keeps_the_first(spark, tmp_path):
    path = str(tmp_path / "samples")
    append_first_wins(numbered(samples(spark, [(0, 1), (0, 99)]).coalesce(1)), path, SAMPLE_KEY, SAMPLES)
    append_first_wins(numbered(samples(spark, [(0, 50), (-86400, 2)])), path, SAMPLE_KEY, SAMPLES)
    append_first_wins(numbered(samples(spark, [])), path, SAMPLE_KEY, SAMPLES)
    got = read_table(spark, path, SAMPLES).orderBy("ts").collect()
    assert [(r.cpu_pct, r.date) for r in got] == [(2.0, date(2024, 1, 14)), (1.0, date(2024, 1, 15))]


def test_process_table_keeps_the_first_pid(spark, tmp_path):
    path = str(tmp_path / "processes")
    rows = processes(spark, [(0, 1, "first", 1, 1), (0, 1, "second", 2, 2)]).coalesce(1)
    append_first_wins(numbered(rows), path, PROCESS_KEY, PROCESSES)
    assert [r["name"] for r in read_table(spark, path, PROCESSES).collect()] == ["first"]


def test_hosts_do_not_share_keys(spark, tmp_path):
    path = str(tmp_path / "hosts")
    rows = samples(spark, [(0, 1)])
    both = rows.withColumn("host", F.lit("a")).unionByName(rows.withColumn("host", F.lit("b")))
    append_first_wins(numbered(both), path, SAMPLE_KEY, SAMPLES)
    append_first_wins(numbered(both), path, SAMPLE_KEY, SAMPLES)
    assert spark.read.parquet(path).count() == 2


def test_event_loads_keep_duplicates_and_replace_themselves(spark, tmp_path):
    path = str(tmp_path / "events")
    rows = events(spark, [(0, "u", "same"), (0, "u", "same"), (86400, "u", "next day")])
    append_events(rows, path, 0)
    append_events(rows.filter("event_id = 1"), path, 1)
    append_events(rows, path, 0)
    append_events(rows.limit(0), path, 2)
    assert read_table(spark, path, EVENTS).count() == 4
    day = read_table(spark, path, EVENTS).filter(F.col("date") == date(2024, 1, 16))
    assert day.count() == 1
    assert "PartitionFilters: [isnotnull(date" in day._jdf.queryExecution().executedPlan().toString()


def test_old_files_get_new_columns(spark, tmp_path):
    path = str(tmp_path / "old")
    events(spark, [(0, "u", "m")]).drop("embedding").write.parquet(path)
    again = read_table(spark, path, EVENTS, days=False)
    assert again.first().embedding is None
    assert conform(again, EVENTS).collect() == again.collect()
    assert read_table(spark, str(tmp_path / "missing"), EVENTS).count() == 0


def test_row_numbers_are_dense_over_loads_and_the_same_when_replayed(spark, tmp_path):
    path = str(tmp_path / "t")
    made = {}
    for load in (0, 1, 5, 1, 2**40):
        df = spark.range(100).repartition(7).persist()
        ids = {r.id: r.n for r in number_rows(df, path, load, "n").collect()}
        assert made.setdefault(load, ids) == ids
        df.unpersist()
    assert sorted(n for ids in made.values() for n in ids.values()) == list(range(400))
    assert max(made[0].values()) < min(made[1].values())


def test_a_load_of_many_tasks_is_numbered(spark, tmp_path):
    df = spark.range(0, 20_000, 1, 20_000)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    counts = number_rows(df.coalesce(40), str(tmp_path / "t"), 0, "n")
    assert counts.agg(F.count_distinct("n")).first()[0] == 20_000


def test_spread_by_time_splits_a_crowded_moment(spark):
    df = spark.range(4000).select(F.lit(T0).alias("ts"), F.col("id").alias("event_id"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the test rows are few
    try:
        sizes = spread_by_time(df, ["event_id"]).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(r["count"] for r in sizes) < 2000
