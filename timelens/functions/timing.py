"""Time helpers shared by the operators. All work in whole microseconds."""

from __future__ import annotations

from datetime import date, datetime, time, timedelta, timezone

from pyspark.sql import Column, DataFrame, functions as F

Duration = int | float | timedelta


def to_micros(span: Duration) -> int:
    """A span given in seconds or as a timedelta, in microseconds."""
    if isinstance(span, timedelta):
        return span // timedelta(microseconds=1)
    return round(span * 1_000_000)


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def bucket_start(ts: Column, width: Duration) -> Column:
    """Start of the fixed-width time bucket holding ``ts``, as epoch microseconds."""
    at = micros(ts)
    return at - F.pmod(at, F.lit(to_micros(width)))


def buckets_between(first: Column, last: Column, width: Duration) -> Column:
    """Array of the starts of all buckets touched by ``[first, last]``."""
    return F.sequence(
        bucket_start(first, width), bucket_start(last, width), F.lit(to_micros(width))
    )


def shifted(ts: Column, span: Duration) -> Column:
    """``ts`` moved by ``span`` (negative: into the past)."""
    return ts + F.make_dt_interval(secs=F.lit(to_micros(span) / 1e6).cast("decimal(18,6)"))


def moment(df: DataFrame, column: str, value: datetime | date | str) -> Column:
    """``value`` as a literal of the column's own type.

    A literal of another timestamp type would put a cast around the column and
    keep the comparison out of the Parquet scan. A value without a zone is in
    UTC, whatever zone the driver runs in.
    """
    if isinstance(value, date):
        if not isinstance(value, datetime):
            value = datetime.combine(value, time())
        aware = value if value.tzinfo else value.replace(tzinfo=timezone.utc)
        since_epoch = (aware - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)
        literal = F.timestamp_micros(F.lit(since_epoch))
    else:
        literal = F.lit(value)
    return literal.cast(df.schema[column].dataType)


def within(df: DataFrame, column: str, first: Column | None = None, last: Column | None = None) -> DataFrame:
    """Rows with ``first <= column <= last``; a table kept by day drops other days' folders too.

    The bounds are literals of the column's type. The day of a folder is that
    of its rows' times, in UTC.
    """
    stored_by_day = "date" in df.columns and df.schema["date"].dataType.typeName() == "date"
    for bound, keep in ((first, Column.__ge__), (last, Column.__le__)):
        if bound is not None:
            df = df.filter(keep(F.col(column), bound))
            if stored_by_day:
                df = df.filter(keep(F.col("date"), F.to_date(bound)))
    return df


def elapsed_seconds(later: Column, earlier: Column) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(1e6)


def span_micros(start: Column, end: Column) -> Column:
    """Length of a time range; negative when it ends before it starts."""
    return micros(end) - micros(start)


def rfc3339(ts: Column) -> Column:
    """RFC 3339 text in UTC, with trailing zeros of the fraction left out."""
    fraction = F.rtrim(F.date_format(ts, "SSSSSS"), F.lit("0"))
    seconds = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    return F.concat(
        seconds, F.when(fraction == "", "").otherwise(F.concat(F.lit("."), fraction)), F.lit("Z")
    )


def rfc3339_seconds(ts: Column) -> Column:
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
