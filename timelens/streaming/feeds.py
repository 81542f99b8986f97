"""Continuous ingest: journal lines, samples and process snapshots.

Every feed writes through ``foreachBatch`` with a checkpoint, and every write
can be repeated without effect, so that a batch replayed after a crash leaves
one copy. There is no watermark: a row is stored under its own time whenever
it arrives, and order is made at query time.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from timelens.operators.ingest import add_tick_sums, first_wins, tick_sums, top_per_tick
from timelens.schemas import EVENTS, PROCESS_KEY, PROCESSES, SAMPLE_KEY, SAMPLES, conform, series_key, with_host
from timelens.sources.follow import follow_lines
from timelens.sources.journal import typed_lines
from timelens.sources.tables import DAY, append_events, append_first_wins, append_load, append_loads, number_rows, read_table

# Seconds between flushes, rows that are flushed at once, seconds before a failed feed starts again.
FLUSH_SECONDS = 2
FLUSH_ROWS = 200
RESTART_SECONDS = 5

FLUSHES = 256
"""Flushes of each file that one micro-batch takes of what has piled up, each a load of its own."""

POLL_SECONDS = 0.2
"""How often a feed that flushes by rows or time looks for new lines."""


LOADED_EVENTS = T.StructType([*EVENTS.fields, T.StructField("load_id", T.LongType())])


def line_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Journal export files appearing in a folder: ``value`` and ``arrived``."""
    reader = spark.readStream
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.text(path).select("value", F.col("_metadata.file_modification_time").alias("arrived"))


def kafka_line_stream(spark: SparkSession, servers: str, topic: str, max_offsets: int | None = None) -> DataFrame:
    """Journal lines from a topic; needs Spark's Kafka connector on the class path."""
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
    )
    if max_offsets:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets)
    return reader.load().select(F.col("value").cast("string").alias("value"), F.col("timestamp").alias("arrived"))


def start(
    stream: DataFrame,
    name: str,
    write: Callable[[DataFrame, int], None],
    checkpoint: str,
    once: bool = False,
    every: float = FLUSH_SECONDS,
) -> StreamingQuery:
    """Run ``write`` on every micro-batch, ``every`` so many seconds; ``once`` takes what is there and stops.

    ``checkpoint`` is the feed's own folder, the same at every start, where it
    goes on after a stop or a failure.
    """
    writer = stream.writeStream.queryName(name).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if once else {"processingTime": f"{round(every * 1000)} milliseconds"}
    return writer.foreachBatch(write).trigger(**trigger).start()


def run_forever(begin: Callable[[], StreamingQuery], pause: float = RESTART_SECONDS, tries: int | None = None) -> None:
    """Keep a feed running: start it again ``pause`` seconds after a failure.

    Ends when the query is stopped, or fails for the ``tries``-th time.
    """
    failed = 0
    while True:
        try:
            begin().awaitTermination()
            return
        except StreamingQueryException:
            failed += 1
            if tries is not None and failed >= tries:
                raise
            time.sleep(pause)


def ingest_journal(
    lines: DataFrame, events_path: str, checkpoint: str, rejects_path: str | None = None, once: bool = False,
    every: float = FLUSH_SECONDS, flushes: int = 1,
) -> StreamingQuery:
    """Lines to typed events, appended; rejected lines go to their own folder.

    Lines are numbered in the order of arrival, without gaps or limits.
    Duplicates are kept, as equal lines are separate events. A replayed batch
    gets the same numbers and overwrites itself. With ``flushes`` above 1 a batch is that
    many loads, told apart by the lines' ``flush``.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        lines_of_batch = batch.persist()
        try:
            typed = typed_lines(number_rows(lines_of_batch, events_path, batch_id)).persist()
            load = F.lit(batch_id) if flushes == 1 else F.lit(batch_id * flushes) + F.col("flush")
            if flushes == 1:
                append_events(conform(typed.filter("accepted"), EVENTS), events_path, batch_id)
            else:
                append_loads(conform(typed.filter("accepted").withColumn("load_id", load), LOADED_EVENTS), events_path)
            if rejects_path:
                (
                    typed.filter(~F.col("accepted")).select("value", "arrived", load.alias("load_id"))
                    .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
                    .partitionBy("load_id").parquet(rejects_path)
                )
            typed.unpersist()
        finally:
            lines_of_batch.unpersist()

    return start(lines, "journal", write, checkpoint, once, every)


def ingest_flushed(
    spark: SparkSession, path: str, events_path: str, checkpoint: str, rejects_path: str | None = None,
    rows: int = FLUSH_ROWS, wait: float = FLUSH_SECONDS, **options,
) -> StreamingQuery:
    """Growing journal files to events, a load as soon as ``rows`` lines wait in a file, or the first for ``wait`` seconds.

    A load holds at most ``rows`` lines of each file, as each machine's collector flushes
    by itself. What has piled up in a file is written `FLUSHES` loads at a time. ``options``
    are those of `follow_lines`.
    """
    lines = follow_lines(spark, path, rows=rows, wait=wait, flushes=FLUSHES, **options)
    return ingest_journal(lines, events_path, checkpoint, rejects_path, every=POLL_SECONDS, flushes=FLUSHES)


def drain(query: StreamingQuery, wait: float = FLUSH_SECONDS) -> None:
    """Stop a feed once it has written all that is there, also lines that still wait for more."""
    try:
        query.processAllAvailable()
        time.sleep(wait + POLL_SECONDS)
        query.processAllAvailable()
    finally:
        query.stop()


def _numbered(batch: DataFrame) -> DataFrame:
    """With an arrival number within the batch, if the feed has none."""
    if "ingest_seq" in batch.columns:
        return batch
    return batch.withColumn("ingest_seq", F.monotonically_increasing_id())


def ingest_samples(
    samples: DataFrame, path: str, checkpoint: str, once: bool = False, within: str | None = None
) -> StreamingQuery:
    """Samples to the table; of two for one tick the first stays.

    An ``ingest_seq`` column of the feed decides which came first; without one
    it is the order of batch, task and row.

    ``within``, an interval such as ``"1 hour"``, is for feeds that may deliver a sample
    again, but no later than that behind the newest. Ticks seen are then kept in the
    query's state until the newest is twice that ahead, and the stored table is never
    read. A row that comes later than ``within`` behind the batches before the last one is
    dropped and counted in the query's progress; of different rows for one tick in
    one micro-batch any may stay.
    """
    if within is not None:
        return _ingest_bounded(samples, path, checkpoint, once, within)

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = _numbered(batch).persist()
        try:
            append_first_wins(rows, path, SAMPLE_KEY, SAMPLES)
        finally:
            rows.unpersist()

    return start(samples, "samples", write, checkpoint, once)


def _ingest_bounded(samples: DataFrame, path: str, checkpoint: str, once: bool, within: str) -> StreamingQuery:
    key = [*series_key(samples), *SAMPLE_KEY]
    timed = samples.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", within)

    def write(batch: DataFrame, batch_id: int) -> None:
        append_load(conform(batch, SAMPLES), path, batch_id, key)

    return start(timed.dropDuplicatesWithinWatermark(key), "samples", write, checkpoint, once)


ARRIVAL = ["load_id", "ingest_seq"]


def ingest_processes(processes: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Process readings to a table of readings, from which `read_processes` makes the ticks.

    A tick may come in any number of micro-batches: which processes are its top
    is known only with all of them.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        by = series_key(batch)
        rows = first_wins(_numbered(batch), [*by, *PROCESS_KEY])
        arrived = conform(rows, T.StructType([*PROCESSES.fields, T.StructField("ingest_seq", T.LongType())]))
        append_load(arrived, path, batch_id, [*by, *PROCESS_KEY])

    return start(processes, "processes", write, checkpoint, once)


def _between(rows: DataFrame, start: datetime | None, end: datetime | None) -> DataFrame:
    """Stored rows of the ticks from ``start`` to ``end``; other days' folders are not read."""
    for bound, within in ((start, "__ge__"), (end, "__le__")):
        if bound is not None:
            at = F.lit(bound).cast("timestamp")
            rows = rows.filter(getattr(F.col(DAY), within)(F.to_date(at)) & getattr(F.col("ts"), within)(at))
    return rows


def read_processes(
    spark: SparkSession, path: str, by: Sequence[str] = (), start: datetime | None = None, end: datetime | None = None
) -> DataFrame:
    """The top processes of every tick, or of those from ``start`` to ``end``; of several readings of a pid the first counts."""
    schema = T.StructType([*PROCESSES.fields, T.StructField("ingest_seq", T.LongType())])
    rows = _between(read_table(spark, path, with_host(schema) if by else schema), start, end)
    if "load_id" not in rows.columns:
        rows = rows.withColumn("load_id", F.lit(0).cast("long"))
    arrived = F.struct(*ARRIVAL).alias("arrived")
    firsts = first_wins(rows.select(*by, *PROCESSES.names, arrived), [*by, *PROCESS_KEY], "arrived")
    return top_per_tick(firsts, by).select(*by, *PROCESSES.names)


def ingest_readings(readings: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Raw device and gauge readings to sums per tick and batch, which `read_built_samples` adds up.

    The stream holds both: device rows with ``kind, device, in_bytes,
    out_bytes``, gauge rows with NULL ``kind`` and ``cpu_pct, mem_used,
    mem_total``. A tick may come in any number of micro-batches.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        by = series_key(batch)
        device, gauge = F.col("kind").isNotNull(), F.col("kind").isNull()
        parts = tick_sums(batch.filter(device), batch.filter(gauge), by)
        append_load(conform(parts, SAMPLES), path, batch_id, [*by, *SAMPLE_KEY])

    return start(readings, "readings", write, checkpoint, once)


def read_built_samples(
    spark: SparkSession, path: str, by: Sequence[str] = (), start: datetime | None = None, end: datetime | None = None
) -> DataFrame:
    """One sample per tick, or per tick from ``start`` to ``end``, from the sums of all batches."""
    parts = _between(read_table(spark, path, with_host(SAMPLES) if by else SAMPLES), start, end)
    return add_tick_sums(parts, by).select(*by, *SAMPLES.names)
