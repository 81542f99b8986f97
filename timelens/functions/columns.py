"""Derived display columns: percentages, bands, levels and byte texts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Percentage bands, the name of each syslog priority class with
# the highest priority number in it, the number of trend levels, byte units.
BANDS = [(50.0, "ok"), (80.0, "warn")]
BAND_ABOVE = "high"
PRIORITY_CLASSES = [(3, "bad"), (4, "warn"), (5, "notice"), (6, "info")]
PRIORITY_OTHER = "debug"
LEVELS = 8
BYTE_UNITS = ["KB", "MB", "GB", "TB"]


def mem_pct(used: Column, total: Column) -> Column:
    return F.when(total > 0, used / total * 100).otherwise(F.lit(0.0))


def percent_band(pct: Column) -> Column:
    band = F.lit(BAND_ABOVE)
    for below, name in reversed(BANDS):
        band = F.when(pct < below, name).otherwise(band)
    return band


def priority_class(priority: Column) -> Column:
    name = F.lit(PRIORITY_OTHER)
    for upto, cls in reversed(PRIORITY_CLASSES):
        name = F.when(priority <= upto, cls).otherwise(name)
    return name


def level(pct: Column) -> Column:
    """Height 0..8 of one trend point; values outside 0..100 are clamped."""
    clamped = F.greatest(F.least(pct, F.lit(100.0)), F.lit(0.0))
    return (clamped / 100 * LEVELS).cast("int")


def human_bytes(n: Column) -> Column:
    """Binary units with two decimals; below 1024 (and negative) plain bytes.

    Exact halves go to the even digit, which the formatter alone would not do.
    """
    text = F.format_string("%d B", n)
    for power, unit in enumerate(BYTE_UNITS, start=1):
        size = 1024**power
        rounded = F.bround(n / F.lit(float(size)), 2)
        text = F.when(n >= size, F.format_string(f"%.2f {unit}", rounded)).otherwise(text)
    return text


def embedding_text(unit: Column, message: Column) -> Column:
    """What gets embedded for an event: the unit, when there is one, then the message."""
    return F.when(
        F.coalesce(unit, F.lit("")) != "", F.concat(unit, F.lit(": "), message)
    ).otherwise(message)
