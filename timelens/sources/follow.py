"""Journal files that grow, followed by byte position.

A stream reader for folders of newline-delimited records. Its offset holds, for every
file, the position up to which the file was read; after a stop, a crash or a long gap
the next batch goes on from there. The driver looks at file sizes, at the last bytes of
files that grew, and with ``rows`` at that many lines of each; tasks read the lines.

What counts as a line, and who reads it:

* A line ends with a line feed (a carriage return before it goes too). The end of a file
  without one is still being written and waits for the rest.
* A range of bytes owns the lines that begin in it, so that ranges may be cut anywhere
  before the last line end, and a batch read again gives the same lines.
* A line longer than 1 MiB with its line feed is not held in memory: it comes out with a
  NULL value, for the rejects, and the lines behind it are read (``long_lines="skip"``); or
  the query ends with an error that names its place (``"fail"``).
* A file that became shorter was begun anew and is read from its start. A file that is
  gone is forgotten. A renamed file is a new one: keep names, and keep files until their
  batches are done.
* Bytes that are no UTF-8 become U+FFFD, as a JSON reader would make of them.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

# Fixed value: bytes of the longest line, with its line feed.
LONGEST_LINE = 1 << 20

BLOCK = 4 << 20
SPLIT = 32 << 20
"""Bytes a task reads at a time, and at most in all."""

FOLLOWED = T.StructType([
    T.StructField("value", T.StringType()),
    T.StructField("arrived", T.TimestampType()),
    T.StructField("file", T.StringType()),
    T.StructField("position", T.LongType()),
    T.StructField("flush", T.LongType()),
])


@dataclass
class Range(InputPartition):
    """Bytes of one file whose lines one task reads."""
    file: str
    start: int
    end: int
    seen: int  # microseconds
    alone: bool = True  # all that the batch has of the file


def _located(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder and its path there; paths without a scheme are local."""
    if path.startswith("file:"):
        path = "/" + path[len("file:"):].lstrip("/")
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def whole_lines(source, start: int, end: int) -> Iterator[tuple[np.ndarray, list[bytes | None]]]:
    """Positions and texts of the lines that begin in ``[start, end)``, a block at a time.

    A line that is too long is None. No more than a block and a longest line is held.
    """
    read_to = begin = max(start - 1, 0)
    source.seek(begin)
    foreign = start > 0  # the line that holds the byte before the range is not of it
    head, dropped = b"", 0  # of the unfinished line: its bytes, or how many were dropped
    while begin < end:
        block = source.read(BLOCK)
        if not block:
            return
        read_to += len(block)
        lines: list[bytes | None] = (head + block).split(b"\n")
        head = lines.pop()
        if lines:
            lengths = np.fromiter(map(len, lines), np.int64, len(lines))
            lengths[0] += dropped
            begins = begin + np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths + 1)])
            begin, dropped = int(begins[-1]), 0
            for i in np.flatnonzero(lengths >= LONGEST_LINE):
                lines[i] = None
            first, last = int(foreign), int(np.searchsorted(begins[:-1], end))
            foreign = False
            if first < last:
                yield begins[first:last], lines[first:last]
        if len(head) + dropped >= LONGEST_LINE:
            head, dropped = b"", len(head) + dropped
        if foreign and read_to >= end:
            return


def _texts(lines: list[bytes | None]) -> pa.Array:
    lines = [line and line.removesuffix(b"\r") for line in lines]
    try:
        return pa.array(lines, pa.binary()).cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([line if line is None else line.decode("utf-8", "replace") for line in lines], pa.string())


def last_line_end(source, start: int, size: int) -> int:
    """The position behind the last line feed of ``[start, size)``, or ``start`` without one."""
    upper = size
    while upper > start:
        lower = max(start, upper - (1 << 16))
        source.seek(lower)
        found = source.read(upper - lower).rfind(b"\n")
        if found >= 0:
            return lower + found + 1
        upper = lower
    return start


def behind_lines(source, start: int, size: int, rows: int) -> tuple[int, int]:
    """The position behind the next ``rows`` line ends of ``[start, size)``, or as many as there are, and their number."""
    source.seek(start)
    at, end, found = start, start, 0
    while at < size and found < rows:
        block = source.read(min(1 << 18, size - at))
        if not block:
            break
        ends = block.count(b"\n")
        if found + ends <= rows:
            found, end = found + ends, at + block.rfind(b"\n") + 1 if ends else end
            at += len(block)
            continue
        place = -1
        while found < rows and (place := block.find(b"\n", place + 1)) >= 0:
            found, end = found + 1, at + place + 1
        at += len(block)
    return end, found


class FollowReader(DataSourceStreamReader):
    """Offsets are ``{"seen": microseconds, "files": {name: position}}``.

    Spark plans the last known range once more when a query starts again, which tells
    the reader where it stopped.
    """

    def __init__(self, options: dict) -> None:
        self.path = options["path"].rstrip("/")
        self.begin = options.get("begin", "start")
        self.rows = int(options.get("rows", 0))
        self.flushes = int(options.get("flushes", 1))
        self.wait = float(options.get("wait", 0))
        self.bytes = int(options.get("bytes", 1 << 30))
        self.long_lines = options.get("long_lines", "skip")
        if self.begin not in ("start", "now") or self.long_lines not in ("skip", "fail"):
            raise ValueError("begin is 'start' or 'now', long_lines 'skip' or 'fail'")
        if self.rows < 0 or self.wait < 0 or self.bytes < 1 or self.flushes < 1:
            raise ValueError("rows and wait are not negative, bytes and flushes 1 or more")
        self.at: dict | None = None
        self.waiting: dict[str, float] = {}

    def _sizes(self) -> dict[str, int]:
        """Bytes of every file below the folder; hidden ones are none of them."""
        system, folder = _located(self.path)
        found = system.get_file_info(pafs.FileSelector(folder, recursive=True, allow_not_found=True))
        names = ((info.path[len(folder):].lstrip("/"), info) for info in found if info.is_file)
        return {name: info.size for name, info in sorted(names, key=lambda named: named[0])
                if not any(part.startswith((".", "_")) for part in name.split("/"))}

    def _end(self, name: str, start: int, size: int) -> int:
        """Up to where the next batch reads a file: as its lines end, or in full with enough of them."""
        system, folder = _located(self.path)
        with system.open_input_file(f"{folder}/{name}") as source:
            if not self.rows:
                return min(last_line_end(source, start, size), start + self.bytes)
            near = min(size, start + SPLIT)
            end, found = behind_lines(source, start, near, self.rows * self.flushes)
            if found > self.rows:
                if found % self.rows:
                    end, _ = behind_lines(source, start, near, found - found % self.rows)
                found = self.rows
            elif found < self.rows and near < size:
                end, found = behind_lines(source, start, size, self.rows)
        if found == self.rows or not found:
            self.waiting.pop(name, None)
            return end
        since = self.waiting.setdefault(name, time.monotonic())
        if time.monotonic() - since < self.wait:
            return start
        del self.waiting[name]
        return end

    def _now(self, files: dict[str, int]) -> dict:
        return {"seen": time.time_ns() // 1000, "files": files}

    def initialOffset(self) -> dict:
        if self.begin == "start":
            return self._now({})
        system, folder = _located(self.path)
        files = {}
        for name, size in self._sizes().items():
            with system.open_input_file(f"{folder}/{name}") as source:
                files[name] = last_line_end(source, 0, size)
        return self._now(files)

    def latestOffset(self) -> dict:
        if self.at is None:
            self.at = self.initialOffset()
        old, new = self.at["files"], {}
        for name, size in self._sizes().items():
            start = old.get(name, 0)
            start = 0 if size < start else start
            new[name] = self._end(name, start, size) if size > start else start
        new = {name: end for name, end in new.items() if end or name in old}
        return self.at if new == old else self._now(new)

    def partitions(self, start: dict, end: dict) -> list[Range]:
        self.at = end
        ranges = []
        for name, stop in end["files"].items():
            begin = start["files"].get(name, 0)
            begin = 0 if stop < begin else begin
            ranges += [Range(name, at, min(at + SPLIT, stop), end["seen"], stop - begin <= SPLIT) for at in range(begin, stop, SPLIT)]
        return ranges

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        system, folder = _located(self.path)
        schema = pa.schema([("value", pa.string()), ("arrived", pa.timestamp("us", "UTC")),
                            ("file", pa.string()), ("position", pa.int64()), ("flush", pa.int64())])
        before = 0
        with system.open_input_file(f"{folder}/{partition.file}") as source:
            for begins, lines in whole_lines(source, partition.start, partition.end):
                if self.long_lines == "fail" and None in lines:
                    place = begins[lines.index(None)]
                    raise ValueError(f"line above {LONGEST_LINE} bytes at byte {place} of {partition.file}")
                # a batch that takes more than one range of a file takes one flush of it
                flush = (before + np.arange(len(lines))) // self.rows if self.rows and partition.alone else np.zeros(len(lines), np.int64)
                before += len(lines)
                yield pa.record_batch([
                    _texts(lines), pa.array(np.full(len(lines), partition.seen), pa.timestamp("us", "UTC")),
                    pa.array([partition.file] * len(lines)), pa.array(begins, pa.int64()),
                    pa.array(flush, pa.int64())], schema)


class FollowSource(DataSource):
    """Format ``journal_follow``; its options are those of `follow_lines`."""

    @classmethod
    def name(cls) -> str:
        return "journal_follow"

    def schema(self) -> T.StructType:
        return FOLLOWED

    def streamReader(self, schema: T.StructType) -> FollowReader:
        return FollowReader(self.options)


def follow_lines(
    spark: SparkSession, path: str, begin: str = "start", rows: int = 0, wait: float = 0.0,
    most_bytes: int = 1 << 30, long_lines: str = "skip", flushes: int = 1,
) -> DataFrame:
    """Lines of the growing files below a folder: ``value, arrived, file, position, flush``.

    ``arrived`` is when the batch of the line was planned. ``begin="now"`` passes over what
    the files hold when the query is first started. With ``rows`` a batch takes at most so
    many lines of each file, and fewer only once the first of them has waited ``wait``
    seconds; else it takes what there is, at most ``most_bytes`` of each file. Of a file that
    has more waiting, a batch takes up to ``flushes`` times ``rows`` lines, in full flushes and
    at most 32 MB of more than one; ``flush`` numbers them from 0 in each file and batch. A query that
    runs once and stops sees one batch: give it no ``wait`` and no ``rows``.
    """
    spark.dataSource.register(FollowSource)
    return (
        spark.readStream.format("journal_follow").option("path", path).option("begin", begin)
        .option("rows", str(rows)).option("wait", str(wait)).option("bytes", str(most_bytes))
        .option("long_lines", long_lines).option("flushes", str(flushes)).load()
    )
