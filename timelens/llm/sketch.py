"""Corpus-wide counts of hashed terms in a table of fixed size.

Terms share a counter if their hashes share it, so a count is never too low, and too
high by the mean load of the counters, a fixed share of the corpus. The table's size
is a parameter: what is sent to the driver and to the tasks does not grow.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

PART = 1 << 16
"""Counters that travel together."""

HELD = 1 << 20
"""Hits a task holds before it hands them on."""


def counter_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def _partial(hashes_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int,
             batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << bits, np.uint16)
    size, room = min(PART, 1 << bits), 65535

    def hand_on() -> Iterator[pa.RecordBatch]:
        for k in range(0, 1 << bits, size):
            part = counts[k:k + size]
            if part.any():
                yield pa.RecordBatch.from_pydict(
                    {"part": pa.array([k // size], pa.int32())}
                    | {n: pa.array([c], pa.binary()) for n, c in zip(("places", "several", "counts"), _packed(part), strict=True)})
        counts[:] = 0

    for batch in batches:
        for hashes in hashes_of(batch):
            # no counter can be hit more often than there are hashes
            for low in range(0, len(hashes), 4096):
                some = hashes[low:low + 4096]
                if len(some) > room:
                    room = 65535 - int(counts.max())
                    if len(some) > room:
                        yield from hand_on()
                        room = 65535
                np.add.at(counts, counter_of(some, bits), np.uint16(1))
                room -= len(some)
    yield from hand_on()


def _packed(part: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Where counters are set (a bit each, or their places where these are shorter), which of
    them count more than 1 (a bit each), and the counts of those."""
    held = np.flatnonzero(part)
    places = held.astype(np.uint16) if 2 * len(held) < -(-len(part) // 8) else np.packbits(part > 0)
    some = part[held]
    many = some[some > 1]
    return places.tobytes(), np.packbits(some > 1).tobytes(), many.astype(np.min_scalar_type(many.max(initial=1))).tobytes()


def _read(places: pa.Scalar, several: pa.Scalar, counts: pa.Scalar, size: int) -> np.ndarray:
    where, many = places.as_buffer(), np.frombuffer(several.as_buffer(), np.uint8)
    held = (np.flatnonzero(np.unpackbits(np.frombuffer(where, np.uint8), count=size)) if where.size == -(-size // 8)
            else np.frombuffer(where, np.uint16))
    more = held[np.unpackbits(many, count=len(held)).astype(bool)]
    out = np.zeros(size, np.uint64)
    out[held] = 1
    if len(more):
        out[more] = np.frombuffer(counts.as_buffer(), f"u{counts.as_buffer().size // len(more)}")
    return out


def _total(size: int, finish: Callable[[np.ndarray], np.ndarray], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, *packed in zip(batch.column(0).to_pylist(), *(batch.column(i) for i in (1, 2, 3)), strict=True):
            new = _read(*packed, size)
            held[part] = held[part] + new if part in held else new
    for part, counts in held.items():
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([part], pa.int32()), "counts": pa.array([finish(counts).tobytes()], pa.binary())})


def hashed_counts(df: DataFrame, hashes_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int,
                  finish: Callable[[np.ndarray], np.ndarray], kind: type) -> np.ndarray:
    """`finish` of how often each of 2^bits counters is hit by the hashes of all rows, as `kind`.

    `finish` works on parts of the table, and keeps 0 as 0; the driver gets its results only.
    """
    schema = "part int, counts binary"
    size = min(PART, 1 << bits)
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = (df.mapInArrow(lambda b: _partial(hashes_of, bits, b), "part int, places binary, several binary, counts binary")
             .repartition(tasks, "part").mapInArrow(lambda b: _total(size, finish, b), schema).toArrow())
    out = np.zeros(1 << bits, kind)
    for part, counts in zip(parts["part"].to_pylist(), parts["counts"], strict=True):
        out[part * size:(part + 1) * size] = np.frombuffer(counts.as_buffer(), kind)
    return out


def _places(hashes_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int,
            batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counters hit, by part; one that is hit more than once is sent twice."""
    held: list[np.ndarray] = []

    def hand_on() -> Iterator[pa.RecordBatch]:
        places = np.sort(np.concatenate(held))
        wanted = np.ones(len(places), bool)
        wanted[2:] = places[2:] != places[:-2]
        places = places[wanted]
        parts, starts = np.unique(places // PART, return_index=True)
        ends = np.append(starts[1:], len(places))
        low = (places % PART).astype(np.uint16)
        yield pa.RecordBatch.from_pydict({
            "part": pa.array(parts, pa.int32()),
            "places": pa.array([low[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary())})
        held.clear()

    for batch in batches:
        for hashes in hashes_of(batch):
            held.append(counter_of(hashes, bits))
            if sum(len(h) for h in held) > HELD:
                yield from hand_on()
    if sum(len(h) for h in held):
        yield from hand_on()


def _several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, places in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            hits = held.setdefault(part, np.zeros(PART, np.uint8))
            hits[:] = np.minimum(hits + np.bincount(np.frombuffer(places.as_buffer(), np.uint16), minlength=PART), 2)
    for part, hits in held.items():
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([part], pa.int32()), "counts": pa.array([np.packbits(hits > 1).tobytes()], pa.binary())})


def several_hits(df: DataFrame, hashes_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int) -> np.ndarray:
    """A bit for each of 2^bits counters (16 bits at least): whether the hashes of all rows hit it more than once.

    What travels grows with the hashes, not with the table.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = (df.mapInArrow(lambda b: _places(hashes_of, bits, b), "part int, places binary")
             .repartition(tasks, "part").mapInArrow(_several, "part int, counts binary").toArrow())
    out = np.zeros((1 << bits) // 8, np.uint8)
    for part, counts in zip(parts["part"].to_pylist(), parts["counts"], strict=True):
        out[part * (PART // 8):(part + 1) * (PART // 8)] = np.frombuffer(counts.as_buffer(), np.uint8)
    return out


def hit_severally(hashes: np.ndarray, table: np.ndarray) -> np.ndarray:
    place = counter_of(hashes, (8 * len(table)).bit_length() - 1)
    return (table[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1).astype(bool)


def distinct_pairs(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hash) pairs in the order of rows; rows below 2^22 each, hashes told apart by 42 bits in a row."""
    keys = np.sort((rows.astype(np.uint64) << np.uint64(42)) | (hashes >> np.uint64(22)))
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    keys = keys[new]
    return (keys >> np.uint64(42)).astype(np.int64), keys << np.uint64(22)
