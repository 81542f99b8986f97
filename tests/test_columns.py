from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from timelens.functions import columns as fc
from timelens.functions import timing as ft


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("n, text", [
    (0, "0 B"), (-5, "-5 B"), (1023, "1023 B"), (1024, "1.00 KB"), (1152, "1.12 KB"), (1408, "1.38 KB"),
    (1024**2, "1.00 MB"), (1024**3, "1.00 GB"), (1024**4, "1.00 TB"), (5 * 1024**5, "5120.00 TB"),
    (1024**2 - 1, "1024.00 KB"),
])
def test_human_bytes(spark, n, text):
    assert one(spark, fc.human_bytes(F.lit(n).cast("long"))) == text


def test_bands_classes_levels(spark):
    assert [one(spark, fc.percent_band(F.lit(v))) for v in (0.0, 49.9, 50.0, 79.9, 80.0)] == [
        "ok", "ok", "warn", "warn", "high"]
    assert [one(spark, fc.priority_class(F.lit(v))) for v in (-1, 0, 3, 4, 5, 6, 7, 42)] == [
        "bad", "bad", "bad", "warn", "notice", "info", "debug", "debug"]
    assert [one(spark, fc.level(F.lit(v))) for v in (-3.0, 0.0, 12.4, 12.5, 99.9, 100.0, 250.0)] == [
        0, 0, 0, 1, 7, 8, 8]


def test_mem_pct(spark):
    assert one(spark, fc.mem_pct(F.lit(1), F.lit(4))) == 25.0
    assert one(spark, fc.mem_pct(F.lit(1), F.lit(0))) == 0.0


def test_embedding_text(spark):
    assert one(spark, fc.embedding_text(F.lit("u"), F.lit("m"))) == "u: m"
    assert one(spark, fc.embedding_text(F.lit(""), F.lit("m"))) == "m"
    assert one(spark, fc.embedding_text(F.lit(None).cast("string"), F.lit("m"))) == "m"


@pytest.mark.parametrize("micro, text", [
    (0, "2024-01-15T12:00:00Z"), (500000, "2024-01-15T12:00:00.5Z"), (123456, "2024-01-15T12:00:00.123456Z"),
    (100, "2024-01-15T12:00:00.0001Z"),
])
def test_rfc3339(spark, micro, text):
    ts = F.lit(datetime(2024, 1, 15, 12) + timedelta(microseconds=micro))
    assert one(spark, ft.rfc3339(ts)) == text
    assert one(spark, ft.rfc3339_seconds(ts)) == "2024-01-15T12:00:00Z"


@pytest.mark.parametrize("span", [timedelta(minutes=5), timedelta(0), timedelta(hours=-1), timedelta(milliseconds=250)])
def test_time_range(spark, span):
    start = datetime(2024, 1, 15, 12)
    assert one(spark, ft.span_micros(F.lit(start), F.lit(start + span))) == span // timedelta(microseconds=1)
