"""Stored tables: Parquet, one folder per day, sorted by time within files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql import types as T

from timelens.operators.ingest import first_wins
from timelens.schemas import conform, series_key, with_host

DAY = "date"
LOAD = "load_id"


def read_table(spark: SparkSession, path: str, schema: T.StructType, days: bool = True) -> DataFrame:
    """A stored table in the given schema, with its ``date`` where it is kept by ``days``.

    Columns that older files lack come back as NULL. The schema is given to
    the reader, so no file is opened to find it. A table not yet written is
    empty.
    """
    full = T.StructType([*schema.fields, T.StructField(DAY, T.DateType())]) if days else schema
    try:
        return spark.read.schema(full).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], full)


LEDGER_SLOTS = 3
LEDGER = T.StructType([T.StructField("base", T.LongType()), T.StructField("rows", T.LongType()), T.StructField(LOAD, T.LongType())])


def _replace_load(rows: DataFrame, path: str, load_id: int | Column, by: Sequence[str]) -> None:
    (
        rows.withColumn(LOAD, F.lit(load_id).cast("long")).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    )


def number_rows(rows: DataFrame, path: str, load_id: int, into: str = "event_id") -> DataFrame:
    """Rows of a load with dense numbers behind those of the loads before.

    Rows are counted per task and the counts summed up, one row per task. The
    load's first number is kept in a ledger next to the table, so that a
    replayed load gets the same numbers. Only the last load is ever replayed:
    the ledger holds the last ``LEDGER_SLOTS`` loads, each in place of an older
    one. The rows must not change between the count and the use: persist them.
    """
    spark = rows.sparkSession
    ledger = f"{path.rstrip('/')}-numbers"
    task = F.spark_partition_id().alias("_task")
    counts = rows.groupBy(task).agg(F.count("*").alias("_rows"))
    total = counts.agg(F.coalesce(F.sum("_rows"), F.lit(0))).first()[0]
    loads = read_table(spark, ledger, LEDGER, days=False).filter(F.col(LOAD) <= load_id).collect()
    known = [load.base for load in loads if load[LOAD] == load_id]
    base = known[0] if known else max((load.base + load.rows for load in loads), default=0)
    slot = F.lit(load_id % LEDGER_SLOTS).alias("slot")
    _replace_load(spark.createDataFrame([(base, total)], "base long, rows long").select("*", slot), ledger, load_id, ["slot"])
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_task", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    place = F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1))
    return (
        rows.select("*", task, place.alias("_place")).join(starts, "_task")
        .withColumn(into, F.lit(base) + F.col("_start") + F.col("_place")).drop("_task", "_start", "_place")
    )


def _by_day(df: DataFrame, key: Sequence[str]) -> DataFrame:
    dated = df.withColumn(DAY, F.to_date("ts"))
    return dated.sortWithinPartitions(DAY, *key)


def spread_by_time(df: DataFrame, tie: Sequence[str]) -> DataFrame:
    """Rows range-partitioned by time, for large one-off loads.

    Ranges are cut by row counts, so a crowded day or second is spread over as
    many tasks as it needs; ``tie`` separates rows of one moment.
    """
    return df.repartitionByRange("ts", *tie)


def append_load(rows: DataFrame, path: str, load_id: int, key: Sequence[str] = ("ts",)) -> None:
    """Append one load; writing the same load again replaces it.

    Nothing is deduplicated. An empty load writes nothing.
    """
    _replace_load(_by_day(rows, key), path, load_id, [DAY, LOAD])


def append_loads(rows: DataFrame, path: str, key: Sequence[str] = ("ts",)) -> None:
    """Append the loads that a column ``load_id`` names, each a file a day; writing them again replaces them."""
    dealt = rows.withColumn(DAY, F.to_date("ts")).repartition(LOAD)
    _replace_load(dealt.sortWithinPartitions(DAY, LOAD, *key), path, F.col(LOAD), [DAY, LOAD])


def append_events(events: DataFrame, path: str, load_id: int) -> None:
    append_load(events, path, load_id)


def merge_loads(spark: SparkSession, path: str, schema: T.StructType, day: str, into: str) -> None:
    """One day's loads of a table as files of another table kept by day alone.

    For days that get no more loads: many small loads become few files, sorted
    by time. The old folder may go once readers use the new one.
    """
    rows = read_table(spark, path, schema).filter(F.col(DAY) == F.lit(day).cast("date")).drop(LOAD, DAY)
    merged = _by_day(spread_by_time(rows, [c for c in ("event_id", "pid") if c in rows.columns]), ["ts"])
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(into)


def append_first_wins(
    rows: DataFrame, path: str, key: Sequence[str], schema: T.StructType, arrival: str = "ingest_seq"
) -> None:
    """Append rows whose key the table does not hold yet, the first arrival of each.

    Of the stored rows only the days that the new rows touch are looked at, and
    there only the times between the first and the last of them: files are
    sorted by time. A repeated load finds its keys stored and adds nothing.
    """
    spark = rows.sparkSession
    full_key = [*series_key(rows), *key]
    target = with_host(schema) if series_key(rows) else schema
    seen = rows.agg(F.collect_set(F.to_date("ts")).alias("days"), F.min(F.unix_micros("ts")).alias("first"),
                    F.max(F.unix_micros("ts")).alias("last")).first()
    if not seen['days']:
        return
    first, last = (F.timestamp_micros(F.lit(us)) for us in (seen['first'], seen['last']))
    stored = read_table(spark, path, target).filter(F.col(DAY).isin(seen['days']) & F.col("ts").between(first, last))
    new = first_wins(rows, full_key, arrival, stored)
    _by_day(conform(new, schema), full_key).write.mode("append").partitionBy(DAY).parquet(path)
