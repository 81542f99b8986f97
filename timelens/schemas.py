"""The data model: three stored tables, two raw feeds, and `conform`.

Every table may carry a leading ``host`` column, the key of one machine's
series. Without it the operators treat the table as one machine's history.
Series keys and timestamps are never NULL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("priority", T.IntegerType()),
    T.StructField("unit", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("pid", T.IntegerType()),
    T.StructField("message", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
])

SAMPLES = T.StructType([
    T.StructField("ts", T.TimestampType()),
    T.StructField("cpu_pct", T.DoubleType()),
    T.StructField("mem_used", T.LongType()),
    T.StructField("mem_total", T.LongType()),
    T.StructField("disk_read", T.LongType()),
    T.StructField("disk_write", T.LongType()),
    T.StructField("net_rx", T.LongType()),
    T.StructField("net_tx", T.LongType()),
])

PROCESSES = T.StructType([
    T.StructField("ts", T.TimestampType()),
    T.StructField("pid", T.IntegerType()),
    T.StructField("name", T.StringType()),
    T.StructField("cpu_pct", T.DoubleType()),
    T.StructField("mem_rss", T.LongType()),
])

RAW_LINES = T.StructType([T.StructField("value", T.StringType())])

DEVICES = T.StructType([
    T.StructField("ts", T.TimestampType()),
    T.StructField("kind", T.StringType()),
    T.StructField("device", T.StringType()),
    T.StructField("in_bytes", T.LongType()),
    T.StructField("out_bytes", T.LongType()),
])

GAUGES = T.StructType([
    T.StructField("ts", T.TimestampType()),
    T.StructField("cpu_pct", T.DoubleType()),
    T.StructField("mem_used", T.LongType()),
    T.StructField("mem_total", T.LongType()),
])

SAMPLE_KEY = ["ts"]
PROCESS_KEY = ["ts", "pid"]

COUNTERS = ["disk_read", "disk_write", "net_rx", "net_tx"]


def with_host(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField("host", T.StringType()), *schema.fields])


def series_key(df: DataFrame) -> list[str]:
    """The columns that separate one series from another in this table."""
    return ["host"] if "host" in df.columns else []


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Bring an older or narrower table to ``schema``.

    Missing columns become typed NULLs, present ones are cast and put in
    order. A ``host`` column is kept. Conforming twice changes nothing.
    """
    kept = [F.col(c) for c in series_key(df) if c not in schema.names]
    typed = [
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ]
    return df.select(*kept, *typed)
