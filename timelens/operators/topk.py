"""First n rows, of a whole table or of every group, by an explicit order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

# Up to this n Spark itself drops rows beyond the n-th of a group before the shuffle.
PRE_SHUFFLE_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"


def check_limit(limit: int) -> int:
    if isinstance(limit, bool) or not isinstance(limit, int):
        raise TypeError("limit must be an integer")
    if limit < 0:
        raise ValueError("limit must not be negative")
    return limit


def top_per_group(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], limit: int, rank: str = "rank"
) -> DataFrame:
    """The first ``limit`` rows of each group, numbered from 1 in ``rank``.

    ``order`` must be total within a group. No task ever sorts a whole hot
    group: Spark limits each group per input partition before the shuffle,
    and for an n too large for that the group is first cut down in parts, one for
    each input partition, which keep their own first n rows.
    """
    check_limit(limit)
    if limit > int(df.sparkSession.conf.get(PRE_SHUFFLE_LIMIT)):
        parts = Window.partitionBy(*group, "_salt").orderBy(*order)
        df = (
            df.withColumn("_salt", F.spark_partition_id())
            .withColumn("_part_rank", F.row_number().over(parts))
            .filter(F.col("_part_rank") <= limit)
            .drop("_salt", "_part_rank")
        )
    whole = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(whole)).filter(F.col(rank) <= limit)


def newest(df: DataFrame, limit: int, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """The ``limit`` newest rows, newest first, ties by ``tie`` ascending.

    A first pass over the time column alone finds how far back the answer
    reaches; the second reads the wide rows with that bound pushed into the
    scan, so row groups older than it are skipped.
    """
    check_limit(limit)
    if limit == 0:
        return df.limit(0)
    reach = df.select(ts).orderBy(F.desc(ts)).limit(limit).agg(F.min(ts)).scalar()
    return df.filter(F.col(ts) >= reach).orderBy(F.desc(ts), F.asc(tie)).limit(limit)
