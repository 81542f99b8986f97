"""Background embedding: a query of its own over the stored events."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from timelens.operators.embedding import Embedder, embed_pending
from timelens.schemas import EVENTS
from timelens.sources.tables import read_table
from timelens.streaming.feeds import start

SIDE_TABLE = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("load_id", T.LongType()),
])
WAITING = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()),
    T.StructField("unit", T.StringType()), T.StructField("message", T.StringType()),
    T.StructField("attempts", T.IntegerType()), T.StructField("next_at", T.TimestampType()),
])

# Fixed value: seconds before events are tried again that could not be embedded.
RETRY_SECONDS = 15

LONGEST_WAIT = 3600
"""Seconds between two tries of an event, at most."""


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """One embedding per event, that of the latest load."""
    rows = read_table(spark, path, SIDE_TABLE, days=False)
    return rows.groupBy("event_id").agg(F.max_by("embedding", "load_id").alias("embedding"))


def append_embeddings(embeddings: DataFrame, path: str, load_id: int) -> None:
    """A load of the side table; writing it again replaces it."""
    (
        embeddings.select("event_id", "embedding", F.lit(load_id).cast("long").alias("load_id"))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("load_id").parquet(path)
    )


def embed_stored(
    spark: SparkSession, events_path: str, embeddings_path: str, embedder: Embedder, limit: int | None = None
) -> None:
    """One catch-up run over everything still pending, newest first under a ``limit``.

    What the embedder fails on stays pending for the next run. Catch-up loads
    are numbered below zero, away from those of a feed, later ones higher.
    """
    events = read_table(spark, events_path, EVENTS)
    done = read_embeddings(spark, embeddings_path)
    append_embeddings(embed_pending(events, embedder, done, limit), embeddings_path, time.time_ns() - 2**62)


def _queue(embeddings_path: str, batch_id: int) -> str:
    return f"{embeddings_path.rstrip('/')}-queue/slot={batch_id % 2}"


def embed_stream(
    events: DataFrame, embeddings_path: str, embedder: Embedder, checkpoint: str, once: bool = False,
    retry: float = 0.0,
) -> StreamingQuery:
    """Embed events as they are appended, without holding up their ingest.

    Joined to ingest only through the stored tables. Events the embedder fails
    on wait in a queue next to the embeddings, with the number of tries and the
    time of the next: ``retry`` seconds after the first failure, twice as long
    after each further one. A micro-batch takes those that are due, and writes
    the queue anew without the ones that succeeded; it reads neither the side
    table nor any other batch's queue than that of its predecessor. A replayed
    batch replaces what it wrote.
    """
    spark = events.sparkSession
    columns = ["event_id", "ts", "unit", "message"]

    def write(batch: DataFrame, batch_id: int) -> None:
        now = F.timestamp_micros(F.lit(time.time_ns() // 1000))
        waiting = read_queue(spark, embeddings_path, batch_id - 1)
        due = waiting.filter(F.col("next_at") <= now).select(*columns, "attempts")
        rows = batch.select(*columns, F.lit(0).alias("attempts")).unionByName(due).persist()
        new = embed_pending(rows, embedder).persist()
        try:
            append_embeddings(new, embeddings_path, batch_id)
            pause = F.least(F.lit(retry) * F.pow(F.lit(2.0), F.least("attempts", F.lit(30))), F.lit(float(LONGEST_WAIT)))
            failed = rows.join(new.select("event_id"), "event_id", "left_anti").select(
                *columns, (F.col("attempts") + 1).alias("attempts"),
                (now + F.make_dt_interval(secs=pause.cast("decimal(18,6)"))).alias("next_at"))
            failed.unionByName(waiting.filter(F.col("next_at") > now)).write.mode("overwrite").parquet(_queue(embeddings_path, batch_id))
        finally:
            new.unpersist()
            rows.unpersist()

    return start(events.select(*columns), "embeddings", write, checkpoint, once)


def read_queue(spark: SparkSession, embeddings_path: str, batch_id: int) -> DataFrame:
    """The events that wait for another try after a micro-batch: one of the last two."""
    return read_table(spark, _queue(embeddings_path, batch_id), WAITING, days=False)


def embed_until(
    spark: SparkSession, events_path: str, embeddings_path: str, embedder: Embedder,
    stop: Callable[[], bool], pause: float = RETRY_SECONDS,
) -> None:
    """Catch-up runs one after the other, ``pause`` seconds apart, until ``stop()``."""
    while not stop():
        embed_stored(spark, events_path, embeddings_path, embedder)
        time.sleep(pause)
