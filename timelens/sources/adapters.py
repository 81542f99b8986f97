"""The given warehouse tables seen as telemetry.

`events` rows become journal events, metric samples, process snapshots, device
counters and raw journal lines; `embeddings` gives the vectors. The counters
are wrapped by a modulus, so they go back now and then as after a restart.
``fleet=True`` makes the event type the host.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _host(fleet: bool) -> list:
    return [F.col("event_type").alias("host")] if fleet else []


def journal_events(spark: SparkSession, sf_dir: str, fleet: bool = False) -> DataFrame:
    priority = (
        F.when(F.col("event_type") == "error", 3).when(F.col("event_type") == "signup", 4)
        .when(F.col("event_type") == "purchase", 5).when(F.col("event_type") == "view", 6)
        .otherwise(7)
    )
    return table(spark, sf_dir, "events").select(
        *_host(fleet), "event_id", "ts", priority.alias("priority"), F.col("event_type").alias("unit"),
        F.col("event_type").alias("source"), F.col("user_id").cast("int").alias("pid"),
        F.col("props").alias("message"),
    )


def samples(spark: SparkSession, sf_dir: str, fleet: bool = False) -> DataFrame:
    def wrapped(factor: int, size: int):
        return F.pmod(F.col("event_id") * factor, F.lit(1000003)) * size

    return table(spark, sf_dir, "events").select(
        *_host(fleet), "ts",
        F.least("value", F.lit(100.0)).alias("cpu_pct"),
        F.floor(F.col("value") * 1000000).cast("long").alias("mem_used"),
        F.lit(500000000).cast("long").alias("mem_total"),
        wrapped(7919, 4096).alias("disk_read"),
        wrapped(104729, 512).alias("disk_write"),
        wrapped(15485863, 1500).alias("net_rx"),
        (F.col("event_id") * 1024).alias("net_tx"),
    )


def processes(spark: SparkSession, sf_dir: str, fleet: bool = False) -> DataFrame:
    keys = [*_host(fleet), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"), F.col("user_id")]
    return (
        table(spark, sf_dir, "events").groupBy(*keys)
        .agg(
            F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("cpu_pct"),
            (F.count("*") * 1048576).alias("mem_rss"),
        )
        .select(
            *(["host"] if fleet else []), "ts", F.col("user_id").cast("int").alias("pid"),
            F.concat(F.lit("user_"), "user_id").alias("name"), "cpu_pct", "mem_rss",
        )
    )


def devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per hour one disk for each of four event types, and one network device for the fifth."""
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"), "event_type")
        .agg((F.sum("event_id") * 7).alias("in_bytes"), (F.sum("event_id") * 3).alias("out_bytes"))
        .select(
            "ts", F.when(F.col("event_type") == "view", "net").otherwise("disk").alias("kind"),
            F.col("event_type").alias("device"), "in_bytes", "out_bytes",
        )
    )


def gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per hour with purchases: their highest value as CPU, their number as memory."""
    return (
        table(spark, sf_dir, "events").filter(F.col("event_type") == "purchase")
        .groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"))
        .agg(
            F.least(F.max("value"), F.lit(100.0)).alias("cpu_pct"),
            (F.count("*") * 1048576).alias("mem_used"),
        )
        .withColumn("mem_total", F.lit(500000000).cast("long"))
    )


def raw_lines(events: DataFrame, *carried: str) -> DataFrame:
    """Journal lines of `events` rows, in the shapes a journal really has; ``carried`` columns stay with them.

    Errors carry a list as message, views numbers instead of digit strings,
    purchases only the second-choice fields, clicks a priority that is no
    number; sign-ups are cut short where their value is below 10.
    """
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    kind = F.col("event_type")

    def record(*fields):
        return F.to_json(F.struct(*fields))

    text = F.lit
    message = F.col("props").alias("MESSAGE")
    pid = F.col("user_id").cast("string")
    plain = [
        message, text("4").alias("PRIORITY"), kind.alias("_SYSTEMD_UNIT"),
        kind.alias("SYSLOG_IDENTIFIER"), pid.alias("_PID"),
        us.cast("string").alias("__REALTIME_TIMESTAMP"),
    ]
    signup = record(*plain)
    line = (
        F.when(kind == "error", record(
            F.array("props", text("more")).alias("MESSAGE"), text("3").alias("PRIORITY"), *plain[2:]))
        .when(kind == "view", record(
            message, text(6).alias("PRIORITY"), *plain[2:4], F.col("user_id").alias("_PID"),
            us.alias("__REALTIME_TIMESTAMP")))
        .when(kind == "purchase", record(
            message, text("5").alias("PRIORITY"), text(" ").alias("_SYSTEMD_UNIT"), kind.alias("UNIT"),
            kind.alias("_COMM"), pid.alias("SYSLOG_PID"), plain[5]))
        .when(kind == "click", record(message, text("low").alias("PRIORITY"), *plain[2:]))
        .when(F.col("value") < 10, F.expr("left({0}, length({0}) - 1)".format("_signup")))
        .otherwise(F.col("_signup"))
    )
    return events.withColumn("_signup", signup).select(
        "event_id", line.alias("value"), F.col("ts").alias("arrived"), *carried
    )


def vector_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`embeddings` as events that have their vectors."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("event_id"),
        F.timestamp_seconds(F.col("vec_id")).cast("timestamp_ntz").alias("ts"),
        F.lit(6).alias("priority"), F.concat(F.lit("label"), "label").alias("unit"),
        F.lit(None).cast("string").alias("source"), F.lit(None).cast("int").alias("pid"),
        F.concat(F.lit("vector "), "vec_id").alias("message"), "embedding",
    )


def text_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` as events; the document number stands in for the time."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("event_id"),
        F.timestamp_seconds(F.col("doc_id")).cast("timestamp_ntz").alias("ts"),
        F.lit(6).alias("priority"), F.col("source").alias("unit"), F.col("lang").alias("source"),
        F.lit(None).cast("int").alias("pid"), F.col("text").alias("message"),
    )
