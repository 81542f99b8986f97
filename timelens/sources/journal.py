"""Journal lines, one JSON record each, to typed events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from timelens.functions.records import fields, first_filled, integer, is_record, parsed

# The record fields an event is made of.
MESSAGE = "MESSAGE"
PRIORITY = "PRIORITY"
UNIT_FIELDS = ["_SYSTEMD_UNIT", "UNIT"]
SOURCE_FIELDS = ["SYSLOG_IDENTIFIER", "_COMM"]
PID_FIELDS = ["_PID", "SYSLOG_PID"]
TIME = "__REALTIME_TIMESTAMP"

EVENT_COLUMNS = ["ts", "priority", "unit", "source", "pid", "message"]


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of journal export files: ``value``, and the file's time as ``arrived``."""
    return spark.read.text(path).select("value", F.col("_metadata.file_modification_time").alias("arrived"))


def typed_lines(lines: DataFrame, arrived: Column | None = None) -> DataFrame:
    """Adds the event columns, and ``accepted``: false for lines that are no event.

    A line is rejected unless it is exactly one JSON object with a non-empty
    message. Unreadable priority and pid are 0. Without a readable time the
    event gets the arrival time: column ``arrived``, if not given otherwise.
    """
    arrived = F.col("arrived") if arrived is None else arrived
    names = [MESSAGE, PRIORITY, *UNIT_FIELDS, *SOURCE_FIELDS, *PID_FIELDS, TIME]
    document = F.col("_document")
    documents = lines.withColumn("_document", parsed(F.col("value"))).select(
        *lines.columns,
        is_record(F.col("value"), document).alias("_is_record"),
        fields(document, names).alias("_fields"),
    )
    # A generator of one row: filters on what was read stay above it, so that
    # a line is read once and not again for each filter.
    documents = documents.select(
        *lines.columns,
        F.inline(F.array(F.struct(
            F.col("_is_record").alias("_record"), F.col("_fields").alias("_texts")
        ))),
    )

    def text(name: str) -> Column:
        return F.col("_texts")[names.index(name)]

    texts = documents.select(
        *lines.columns,
        "_record",
        text(MESSAGE).alias("message"),
        text(PRIORITY).alias("_priority"),
        first_filled(*[text(f) for f in UNIT_FIELDS]).alias("unit"),
        first_filled(*[text(f) for f in SOURCE_FIELDS]).alias("source"),
        first_filled(*[text(f) for f in PID_FIELDS]).alias("_pid"),
        text(TIME).alias("_time"),
    )
    zero = F.lit(0)
    return texts.select(
        *lines.columns,
        F.coalesce(
            F.timestamp_micros(integer(F.col("_time"), "bigint")), arrived.cast("timestamp")
        ).alias("ts"),
        F.coalesce(integer(F.col("_priority"), "int"), zero).alias("priority"),
        "unit",
        "source",
        F.coalesce(integer(F.col("_pid"), "int"), zero).alias("pid"),
        "message",
        (F.col("_record") & (F.col("message") != "")).alias("accepted"),
    )


def parse_journal(lines: DataFrame, arrived: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Events, and the rejected lines as they came."""
    typed = typed_lines(lines, arrived)
    carried = [c for c in lines.columns if c not in ("value", "arrived")]
    return (
        typed.filter("accepted").select(*carried, *EVENT_COLUMNS),
        typed.filter(~F.col("accepted")).select(*lines.columns),
    )
