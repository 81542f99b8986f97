from __future__ import annotations

import json
import os

import pytest
from conftest import T0, at, samples
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timelens.operators.rates import rates
from timelens.operators.embedding import hashing_embedder, with_embeddings
from timelens.schemas import EVENTS, SAMPLES, with_host
from timelens.sources.tables import append_events, append_load, number_rows, read_table
from timelens.streaming import enrich, feeds, live


def put(folder, name, lines, age):
    """A file with a modification time of its own, as close ones are read in any order."""
    folder.mkdir(exist_ok=True)
    path = folder / name
    path.write_text("\n".join(lines) + "\n")
    os.utime(path, (1_700_000_000 - age, 1_700_000_000 - age))


def test_journal_feed_survives_restart(spark, tmp_path):
    folder = tmp_path / "lines"
    table, rejects, checkpoint = (str(tmp_path / n) for n in ("events", "rejects", "cp"))

    def run():
        stream = feeds.line_stream(spark, str(folder), max_files=1)
        feeds.ingest_journal(stream, table, checkpoint, rejects, once=True).awaitTermination()

    put(folder, "a", ['{"MESSAGE":"one"}', "broken", '{"MESSAGE":"one"}'], 200)
    put(folder, "b", ['{"MESSAGE":"two","__REALTIME_TIMESTAMP":"1705320000000000"}'], 100)
    run()
    put(folder, "c", ['{"MESSAGE":"three"}'], 50)
    run()
    run()
    rows = read_table(spark, table, EVENTS).collect()
    assert sorted(r.message for r in rows) == ["one", "one", "three", "two"]
    assert len({r.event_id for r in rows}) == 4
    assert [r.value for r in spark.read.parquet(rejects).collect()] == ["broken"]
    # without a time of its own an event gets the time its file arrived
    assert {str(r.ts) for r in rows if r.message == "one"} == {"2023-11-14 22:10:00"}


def test_a_replayed_batch_leaves_one_copy(spark, tmp_path):
    folder, table = tmp_path / "lines", str(tmp_path / "events")
    put(folder, "a", ['{"MESSAGE":"one"}', '{"MESSAGE":"two"}'], 10)
    for checkpoint in ("first", "second"):  # a lost checkpoint replays batch 0
        stream = feeds.line_stream(spark, str(folder))
        feeds.ingest_journal(stream, table, str(tmp_path / checkpoint), once=True).awaitTermination()
    assert read_table(spark, table, EVENTS).count() == 2


def sample_line(host, seconds, cpu, seq, disk=0):
    return json.dumps({
        "host": host, "ts": str(at(seconds)), "cpu_pct": cpu, "mem_used": 1, "mem_total": 2, "disk_read": disk,
        "disk_write": 0, "net_rx": 0, "net_tx": 0, "ingest_seq": seq,
    })


SCHEMA = T.StructType([
    T.StructField("host", T.StringType()), *SAMPLES.fields, T.StructField("ingest_seq", T.LongType()),
])


def sample_stream(spark, folder, max_files=1):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", max_files).json(str(folder))


def test_sample_feed_keeps_the_first_over_batches(spark, tmp_path):
    folder, table = tmp_path / "in", str(tmp_path / "samples")
    put(folder, "1", [sample_line("a", 0, 1.0, 2), sample_line("a", 0, 2.0, 1), sample_line("b", 0, 3.0, 3)], 300)
    put(folder, "2", [sample_line("a", 0, 4.0, 0), sample_line("a", -5, 5.0, 4)], 200)
    feeds.ingest_samples(sample_stream(spark, folder), table, str(tmp_path / "cp"), once=True).awaitTermination()
    got = spark.read.parquet(table).collect()
    assert sorted((r.host, r.ts, r.cpu_pct) for r in got) == [
        ("a", at(-5), 5.0), ("a", T0, 2.0), ("b", T0, 3.0)]


def live_rows(spark, folder, tmp_path, name, max_files=1):
    out = str(tmp_path / name)
    query = (
        live.live_view(sample_stream(spark, folder, max_files)).writeStream.format("parquet")
        .option("path", out).option("checkpointLocation", out + "-cp").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.parquet(out).orderBy("host", "ts").collect()


def test_live_view_equals_batch_rates(spark, tmp_path):
    folder = tmp_path / "in"
    disks = [0, 100, 50, 650]
    for i, disk in enumerate(disks):
        put(folder, f"{i}", [sample_line("a", 2 * i, float(i), i, disk)], 1000 - 100 * i)
    got = live_rows(spark, folder, tmp_path, "live")
    batch = samples(spark, [(2 * i, i, d, 0, 0, 0) for i, d in enumerate(disks)])
    expected = [r.disk_read_rate for r in rates(batch, []).orderBy("ts").collect()]
    assert [r.disk_read_rate for r in got] == expected == [0, 50, 0, 300]
    assert [r.recent for r in got] == [[0.0], [0.0, 1.0], [0.0, 1.0, 2.0], [0.0, 1.0, 2.0, 3.0]]


def test_live_view_ignores_late_rows_and_takes_the_newest_of_a_refresh(spark, tmp_path):
    folder = tmp_path / "in"
    put(folder, "a", [sample_line("a", 10, 1.0, 0, 100), sample_line("a", 20, 2.0, 1, 200), sample_line("b", 5, 9.0, 2)], 300)
    put(folder, "b", [sample_line("a", 30, 3.0, 3, 400)], 200)
    put(folder, "c", [sample_line("a", 0, 4.0, 4, 0)], 100)  # the oldest sample comes last
    got = [(r.host, r.ts, r.recent, r.disk_read_rate) for r in live_rows(spark, folder, tmp_path, "live")]
    assert got == [("a", at(20), [2.0], 0), ("a", at(30), [2.0, 3.0], 20), ("b", at(5), [9.0], 0)]


def test_live_history_is_bounded(spark, tmp_path):
    state = None

    class State:
        exists = property(lambda self: state is not None)
        get = property(lambda self: state)

        def update(self, value):
            nonlocal state
            state = value

    import pandas as pd

    for i in range(100):
        row = {"host": "a", "ts": pd.Timestamp(at(i)), "cpu_pct": float(i), "mem_used": 1, "mem_total": 2,
               "disk_read": i, "disk_write": 0, "net_rx": 0, "net_tx": 0}
        view = list(live._refresh(("a",), iter([pd.DataFrame([row])]), State()))[0]
    assert view["recent"].iloc[0] == [float(x) for x in range(40, 100)]


def test_embedding_feed_and_catch_up(spark, tmp_path):
    events_path, side, checkpoint = (str(tmp_path / n) for n in ("events", "side", "cp"))
    lines = tmp_path / "lines"
    put(lines, "a", ['{"MESSAGE":"disk failure","UNIT":"kernel"}', '{"MESSAGE":"fine"}'], 100)
    feeds.ingest_journal(
        feeds.line_stream(spark, str(lines)), events_path, str(tmp_path / "jcp"), once=True
    ).awaitTermination()

    def broken(texts):
        return hashing_embedder(8)(texts).withColumn(
            "embedding", F.when(~F.col("text").contains("fine"), F.col("embedding"))
        )

    stream = spark.readStream.schema(EVENTS).parquet(events_path)
    enrich.embed_stream(stream, side, broken, checkpoint, once=True).awaitTermination()
    assert enrich.read_embeddings(spark, side).count() == 1
    enrich.embed_stored(spark, events_path, side, hashing_embedder(8))
    enrich.embed_stored(spark, events_path, side, hashing_embedder(8))
    got = enrich.read_embeddings(spark, side).collect()
    assert len(got) == len({r.event_id for r in got}) == 2
    assert {len(r.embedding) for r in got} == {8}


def test_shared_folder_is_the_configured_one(spark):
    from timelens.session import shared_dir

    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_a_tick_cut_over_batches_is_added_up(spark, tmp_path):
    schema = "ts timestamp, kind string, device string, in_bytes long, out_bytes long, cpu_pct double, mem_used long, mem_total long"
    folder = tmp_path / "in"
    put(folder, "1", [json.dumps({"ts": str(T0), "kind": "disk", "device": "sda", "in_bytes": 100, "out_bytes": 1})], 300)
    put(folder, "2", [json.dumps({"ts": str(T0), "kind": "disk", "device": "sdb", "in_bytes": 200, "out_bytes": 1}),
                      json.dumps({"ts": str(T0), "cpu_pct": 50.0, "mem_used": 1, "mem_total": 2})], 200)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))
    feeds.ingest_readings(stream, str(tmp_path / "t"), str(tmp_path / "cp"), once=True).awaitTermination()
    (row,) = feeds.read_built_samples(spark, str(tmp_path / "t")).collect()
    assert (row.ts, row.disk_read, row.disk_write, row.cpu_pct, row.net_rx) == (T0, 300, 2, 50.0, 0)


def test_a_tick_in_parts_keeps_its_ten(spark, tmp_path):
    folder = tmp_path / "in"
    for part in range(3):
        put(folder, str(part), [json.dumps({"ts": str(T0), "pid": pid, "name": f"p{pid}", "cpu_pct": float(pid + part), "mem_rss": 1})
                                for pid in range(part * 5, part * 5 + 8)], 300 - 100 * part)
    stream = spark.readStream.schema("ts timestamp, pid int, name string, cpu_pct double, mem_rss long").option(
        "maxFilesPerTrigger", 1).json(str(folder))
    feeds.ingest_processes(stream, str(tmp_path / "t"), str(tmp_path / "cp"), once=True).awaitTermination()
    rows = feeds.read_processes(spark, str(tmp_path / "t")).collect()
    first = {pid: float(pid + part) for part in (2, 1, 0) for pid in range(part * 5, part * 5 + 8)}
    assert sorted((r.pid, r.cpu_pct) for r in rows) == sorted(sorted(first.items(), key=lambda p: (-p[1], p[0]))[:10])


def test_reads_between_two_ticks_open_their_days_only(spark, tmp_path):
    table, day = str(tmp_path / "t"), 86400
    rows = [(at(day * d + s), pid, "p", float(pid), 1, 0) for d in range(4) for s in (0, 5) for pid in range(12)]
    schema = "ts timestamp, pid int, name string, cpu_pct double, mem_rss long, ingest_seq long"
    append_load(spark.createDataFrame(rows, schema), table, 0)
    found = feeds.read_processes(spark, table, start=at(day + 5), end=at(2 * day))
    assert sorted({r.ts for r in found.collect()}) == [at(day + 5), at(2 * day)] and found.count() == 20
    assert "PartitionFilters: [isnotnull(date" in found._jdf.queryExecution().toString()
    assert feeds.read_processes(spark, table, end=at(0)).count() == 10
    assert feeds.read_built_samples(spark, str(tmp_path / "none"), start=at(0)).count() == 0


def test_a_failed_feed_starts_again_where_it_stopped(spark, tmp_path):
    folder, seen, fails = tmp_path / "in", [], [1, 1]
    put(folder, "1", [sample_line("a", 0, 1.0, 1)], 300)
    put(folder, "2", [sample_line("a", 5, 2.0, 2)], 200)

    def write(batch, batch_id):
        if batch_id == 1 and fails:
            fails.pop()
            raise OSError("disk full")
        seen.append((batch_id, batch.count()))

    feeds.run_forever(
        lambda: feeds.start(sample_stream(spark, folder), "again", write, str(tmp_path / "cp"), once=True), pause=0.01)
    assert seen == [(0, 1), (1, 1)] and not fails


def test_failed_embeddings_are_tried_with_the_next_batch(spark, tmp_path):
    side, table = str(tmp_path / "side"), str(tmp_path / "events")
    failing = [True]

    def moody(texts):
        keep = F.lit(not failing[0]) | ~F.col("text").contains("hard")
        return hashing_embedder(8)(texts).withColumn("embedding", F.when(keep, F.col("embedding")))

    def load(number, *messages):
        rows = [(10 * number + i, at(number), 6, "", "", 0, m, None) for i, m in enumerate(messages)]
        append_events(spark.createDataFrame(rows, EVENTS), table, number)
        stream = spark.readStream.schema(EVENTS).parquet(table)
        enrich.embed_stream(stream, side, moody, str(tmp_path / "cp"), once=True).awaitTermination()
        return sorted(r.event_id for r in enrich.read_embeddings(spark, side).collect())

    assert load(0, "easy", "hard") == [0]
    failing[0] = False
    assert load(1, "more") == [0, 1, 10]


def test_the_queue_drains_and_waits(spark, tmp_path, monkeypatch):
    side, table = str(tmp_path / "side"), str(tmp_path / "events")
    now, failing, seen = [1_700_000_000], [True], []
    monkeypatch.setattr(enrich.time, "time_ns", lambda: now[0] * 10**9)

    def moody(texts):
        seen.append(sorted(r.text for r in texts.collect()))
        keep = F.lit(not failing[0]) | ~F.col("text").contains("hard")
        return hashing_embedder(8)(texts).withColumn("embedding", F.when(keep, F.col("embedding")))

    def load(number):
        append_events(spark.createDataFrame([(10 + number, at(number), 6, "", "", 0, f"m{number}", None)], EVENTS)
                      if number else spark.createDataFrame([(1, T0, 6, "", "", 0, "hard", None)], EVENTS), table, number)
        stream = spark.readStream.schema(EVENTS).parquet(table)
        enrich.embed_stream(stream, side, moody, str(tmp_path / "cp"), once=True, retry=10).awaitTermination()
        return [(r.event_id, r.attempts, r.next_at.timestamp() - now[0]) for r in enrich.read_queue(spark, side, number).collect()]

    assert load(0) == [(1, 1, 10)]
    now[0] += 4
    assert load(1) == [(1, 1, 6)]  # not due yet
    now[0] += 6
    assert load(2) == [(1, 2, 20)]
    now[0], failing[0] = now[0] + 20, False
    assert load(3) == []
    assert load(4) == []
    assert seen == [["hard"], ["m1"], ["hard", "m2"], ["hard", "m3"], ["m4"]]
    assert enrich.read_embeddings(spark, side).count() == 5


def test_numbers_go_on_and_the_ledger_stays_small(spark, tmp_path):
    table = str(tmp_path / "events")

    def numbers(load, rows):
        return sorted(r.event_id for r in number_rows(spark.range(rows).repartition(2).persist(), table, load).collect())

    firsts = [numbers(load, 3)[0] for load in range(7)]
    assert firsts == [0, 3, 6, 9, 12, 15, 18]
    assert numbers(6, 3) == [18, 19, 20]  # the last load, replayed
    assert numbers(7, 2) == [21, 22]
    assert len(list((tmp_path / "events-numbers").glob("slot=*"))) == 3


def test_bounded_state_forgets_old_ticks(spark, tmp_path):
    folder, table = tmp_path / "in", str(tmp_path / "samples")
    for i in range(6):
        lines = [sample_line("a", 3600 * i + s, 1.0, 0) for s in range(10)]
        again = [sample_line("a", 3600 * (i - 1), 1.0, 0)] if i else []
        late = [sample_line("b", 60, 1.0, 0)] if i in (1, 5) else []  # inside the bound, and far behind it
        put(folder, str(i), lines + again + late, 900 - 100 * i)
    query = feeds.ingest_samples(sample_stream(spark, folder), table, str(tmp_path / "cp"), once=True, within="90 minutes")
    query.awaitTermination()
    progress = [json.loads(p.json)["stateOperators"][0] for p in query.recentProgress if p["stateOperators"]]
    # ten ticks of each of the four hours that the newest is at most three hours ahead of, and the late one
    assert max(p["numRowsTotal"] for p in progress) <= 41
    assert sum(p["numRowsDroppedByWatermark"] for p in progress) == 1
    rows = [(r.host, r.ts) for r in read_table(spark, table, with_host(SAMPLES)).collect()]
    assert len(rows) == len(set(rows)) == 61 and ("b", at(60)) in rows


def test_the_latest_embedding_counts(spark):
    events = spark.createDataFrame([(1, T0, 6, "", "", 0, "m", None)], EVENTS)
    side = spark.createDataFrame([(1, [9.0], 1), (1, [2.0], 3), (1, [5.0], -7)], enrich.SIDE_TABLE.fieldNames())
    assert [r.embedding for r in with_embeddings(events, side).collect()] == [[2.0]]


def test_live_view_without_host_and_with_missing_counters(spark, tmp_path):
    folder = tmp_path / "in"
    big = 9007199254740993
    for i, disk in enumerate((None, big, big + 4)):
        row = {"ts": str(at(2 * i)), "cpu_pct": None, "mem_used": big, "mem_total": None, "disk_read": disk, "disk_write": 0, "net_rx": 0, "net_tx": 0}
        put(folder, f"{i}", [json.dumps(row)], 1000 - 100 * i)
    out = str(tmp_path / "out")
    stream = spark.readStream.schema(SAMPLES).option("maxFilesPerTrigger", 1).json(str(folder))
    live.live_view(stream).writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", out + "-cp").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(out).orderBy("ts").collect()
    assert "host" not in rows[0].asDict()
    assert [(r.disk_read, r.mem_used) for r in rows] == [(0, big), (big, big), (big + 4, big)]
    assert [r.disk_read_rate for r in rows][2] == 2


def process_line(host, seconds, pid, cpu):
    return json.dumps({"host": host, "ts": str(at(seconds)), "pid": pid, "name": f"p{pid}", "cpu_pct": cpu, "mem_rss": pid * 10})


def test_a_tick_cut_over_batches_is_shown_whole_in_the_end(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "views")
    put(folder, "1", [process_line("a", 0, 1, 5.0), process_line("a", 0, 2, 4.0), process_line("b", 0, 7, 1.0)], 500)
    put(folder, "2", [process_line("a", 0, 3, 9.0), process_line("a", -60, 8, 99.0), process_line("b", 0, 7, 1.0)], 400)
    put(folder, "3", [process_line("a", 0, 4, 0.5)], 300)  # not among the first three
    put(folder, "4", [process_line("a", 60, 5, 1.0), process_line("a", 0, 6, 50.0)], 200)
    put(folder, "5", [process_line("a", 0, 9, 70.0), process_line("a", 60, 1, 2.0)], 100)
    schema = "host string, ts timestamp, pid int, name string, cpu_pct double, mem_rss long"
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))

    def run():
        (live.live_processes(rows, 3).writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination())

    run()
    views = spark.read.parquet(out)
    got = {}
    for r in views.collect():
        got.setdefault((r.host, r.ts, r.revision), []).append((r.cpu_pct, r.pid))
    assert {k: [p for _, p in sorted(v, reverse=True)] for k, v in got.items()} == {
        ("a", T0, 0): [1, 2], ("a", T0, 1): [3, 1, 2], ("b", T0, 0): [7], ("a", at(60), 0): [5], ("a", at(60), 1): [1, 5]}
    last = live.newest_revisions(views)
    assert {(r.host, r.ts, r.pid) for r in last.collect()} == {
        ("a", T0, 1), ("a", T0, 2), ("a", T0, 3), ("b", T0, 7), ("a", at(60), 1), ("a", at(60), 5)}
    put(folder, "6", [process_line("a", 60, 2, 3.0)], 50)  # the state outlives a restart
    run()
    assert {(r.pid, r.revision) for r in spark.read.parquet(out).filter("revision = 2").collect()} == {(2, 2), (1, 2), (5, 2)}


def test_parts_of_several_files_are_one_batch_each(spark, tmp_path):
    from timelens.plans import catalog

    rows = spark.range(0, 1000, numPartitions=5).withColumnRenamed("id", "event_id")
    few = spark.createDataFrame([(i,) for i in (0, 1, 9)], "event_id long").repartition(5)
    for name, given in (("many", rows), ("few", few)):
        files = catalog._written(spark, str(tmp_path / name), given, "event_id", "parquet")
        assert files == 5
        assert len(list((tmp_path / name).glob("part-*"))) == 4 * files
        stream = catalog._stream(spark, str(tmp_path / f"{name}-stream"), given)
        seen = {}
        stream.writeStream.option("checkpointLocation", str(tmp_path / f"{name}-cp")).trigger(availableNow=True).foreachBatch(
            lambda batch, n: seen.update({n: sorted(r[0] for r in batch.collect())})).start().awaitTermination()
        ids = sorted(r[0] for r in given.collect())
        last = ids[-1] + 1
        assert seen == {k: [i for i in ids if i * 4 // last == k] for k in range(4)}
