"""Tables kept in the folder all executors share."""

from __future__ import annotations

import sys
import types
import uuid

from pyspark.sql import DataFrame

from timelens.session import shared_dir


def kept(df: DataFrame) -> DataFrame:
    """The result computed once, written as Parquet and read again.

    What follows reads the files, also after the loss of executors, and plans with
    their sizes, however many steps came before. They lie in folders named
    `timelens-kept-*` and may go once the results built on them are written.
    """
    path = f"{shared_dir(df.sparkSession)}/timelens-kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def worker_cache() -> dict:
    """What a Python worker keeps between tasks, also where this package reaches it by value."""
    return sys.modules.setdefault("timelens_worker_cache", types.ModuleType("timelens_worker_cache")).__dict__
