from __future__ import annotations

import sys
from datetime import datetime, timedelta
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from timelens.session import build_session  # noqa: E402

T0 = datetime(2024, 1, 15, 12)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests", "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


def at(seconds: float) -> datetime:
    return T0 + timedelta(seconds=seconds)


def events(spark, rows):
    """Rows of (offset seconds, unit, message) or with an embedding as fourth."""
    data = [
        (i, at(r[0]), 6, r[1], None, None, r[2], r[3] if len(r) > 3 else None)
        for i, r in enumerate(rows, start=1)
    ]
    return spark.createDataFrame(
        data,
        "event_id long, ts timestamp, priority int, unit string, source string, pid int, "
        "message string, embedding array<float>",
    )


def samples(spark, rows):
    """Rows of (offset, cpu) or (offset, cpu, disk_read, disk_write, net_rx, net_tx)."""
    data = [(at(r[0]), float(r[1]), 1, 2, *(r[2:] if len(r) > 2 else (0, 0, 0, 0))) for r in rows]
    return spark.createDataFrame(
        data,
        "ts timestamp, cpu_pct double, mem_used long, mem_total long, disk_read long, disk_write long, "
        "net_rx long, net_tx long",
    )


def processes(spark, rows):
    """Rows of (offset, pid, name, cpu, rss)."""
    return spark.createDataFrame(
        [(at(r[0]), r[1], r[2], None if r[3] is None else float(r[3]), r[4]) for r in rows],
        "ts timestamp, pid int, name string, cpu_pct double, mem_rss long",
    )
