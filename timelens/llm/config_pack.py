"""Best-fit packing: whole documents into as few sequences as can be, by a configuration program.

A document's ids end with an end id. Only documents above the capacity are cut, into
pieces of a full sequence behind a first piece of what is left over; so what has to be
packed is a histogram of lengths, which has at most as many entries as the capacity,
however many pieces there are. A configuration is a multiset of lengths that fits one
sequence. The linear program that covers the histogram by as few configurations as it can
is solved by multiplicative weights: lengths carry prices, first their size; a knapsack
dynamic program over the capacity finds the configuration of the highest price that holds
a length least covered so far; it is taken for a fraction of the demand, and the prices of
its lengths fall by a factor, until all are covered. The prices bound the number of
sequences from below.

Rounding takes configurations, those of the longest lengths first, as often as the cover
and the lengths left over allow, carries fractions on, and solves the program anew for
what is left; the few pieces that no round takes go, longest first, where they fit best.

How it runs: tasks cut and count, the driver works on the histogram alone, and the
configurations, whose number follows from the capacity, go back to the tasks. A piece's
number among those of its length, counted per task and summed over tasks, says which
place of which configuration is its own. No piece meets another, so a
length that a third of all pieces have is no trouble.

Defined results: a NULL or empty text is the end id alone. Repeated documents are
packed as often as they come. Sequence numbers are dense from 0. No documents give
no pieces. Extra columns are left out. Ids of documents are whole numbers (long).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timelens.llm.pack import UnitEncoder
from timelens.llm.store import kept, worker_cache

CAPACITY = 2048

STEP = 0.25
"""The share of its demand by which a configuration covers a length at most, at a time."""

RATE, AHEAD = 0.2, 1.0
"""How fast the price of a length falls that is covered more than others, and how far it may get ahead of them."""

MOST_PRICINGS = 2000
"""Knapsacks of a program; lengths it has not covered by then are left to the next one."""

ROUNDINGS = 3
"""Times the program is solved for what rounding left over."""

FEW = 4096
"""Pieces left over that are not worth another program."""

PIECES = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("piece", T.IntegerType()),
    T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()),
    T.StructField("ids", T.BinaryType()),
    T.StructField("ids_crc32", T.LongType()),
    T.StructField("task", T.IntegerType()),
    T.StructField("number", T.LongType()),
])

FLUSH_BYTES = 8 << 20


def knapsack(prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Highest total price within every room, and a length that begins it (0: none), of equal ones the longest; a price of 0 is no offer."""
    lengths = np.flatnonzero(prices > 0)[::-1]
    paid = prices[lengths]
    best, first = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    above = len(lengths) - np.searchsorted(lengths[::-1], np.arange(capacity + 1), "right")
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        if above[room] < len(lengths):
            totals = paid[above[room]:] + best[room - lengths[above[room]:]]
            k = int(totals.argmax())
            if totals[k] > best[room] + 1e-12:
                best[room], first[room] = totals[k], lengths[above[room] + k]
    return best, first


def _fill(first: list[int], room: int) -> list[int]:
    """The lengths of the best filling of a room."""
    out = []
    while room > 0:
        length = first[room]
        if length:
            out.append(length)
        room -= length or 1
    return out


def fractional(demand: np.ndarray, capacity: int) -> tuple[dict[tuple, float], float]:
    """A fractional cover of the lengths by configurations, and a lower bound of what any cover takes."""
    there = np.flatnonzero(demand)[::-1]
    covered = np.zeros(capacity + 1)
    out: dict[tuple, float] = {}
    bound = float(demand[capacity // 2 + 1:].sum())
    for _ in range(MOST_PRICINGS):
        least = float(covered[there].min(initial=1.0))
        if least > 1 - 1e-9:
            break
        prices = np.zeros(capacity + 1)
        ahead = covered[there] - least
        prices[there] = there / capacity * np.exp(-RATE * ahead)
        open_ = prices * 0
        open_[there] = np.where(ahead < AHEAD, prices[there], 0)
        best, first = knapsack(open_, capacity)
        if not ahead.max() >= AHEAD:
            bound = max(bound, float(prices @ demand) / best[capacity])
        begins, gained = first.tolist(), np.zeros(capacity + 1)
        for length in there[ahead < STEP].tolist():
            if gained[length] >= STEP:
                continue
            held = [length, *_fill(begins, capacity - length)]
            kinds = list(dict.fromkeys(held))
            if any(gained[x] >= 2 * STEP for x in kinds):
                continue
            counts = [held.count(x) for x in kinds]
            times = STEP * min(demand[x] / n for x, n in zip(kinds, counts, strict=True))
            for x, n in zip(kinds, counts, strict=True):
                gained[x] += times * n / demand[x]
            key = tuple(sorted(held, reverse=True))
            out[key] = out.get(key, 0.0) + times
        covered += gained
    return out, bound


def _topped(held: tuple, copies: int, left: np.ndarray, capacity: int) -> Iterator[tuple[tuple, int]]:
    """Copies of a configuration, their free room filled with the longest lengths left over; takes these out of `left`."""
    while copies:
        more: list[int] = []
        room, times = capacity - sum(held), copies
        while room:
            fits = np.flatnonzero(left[:room + 1])
            while len(fits) and left[fits[-1]] <= more.count(fits[-1]):
                fits = fits[:-1]
            if not len(fits):
                break
            more.append(int(fits[-1]))
            times = min(times, int(left[fits[-1]]) // more.count(fits[-1]))
            room -= more[-1]
        for x in more:
            left[x] -= times
        yield tuple(sorted((*held, *more), reverse=True)), times
        copies -= times


def _round(cover: dict[tuple, float], left: np.ndarray, capacity: int) -> Iterator[tuple[tuple, int]]:
    """Configurations a whole number of times: as the cover says, then as often as the lengths allow; empties `left` of theirs.

    Only what leaves no more room free than the fullest ones do takes part.
    """
    order = sorted(cover, key=lambda held: (-held[0], -sum(held), -cover[held], held))
    least = max(map(sum, order)) - capacity // 256
    for wholly in (False, True):
        carry = 0.0
        for held in order:
            if wholly and sum(held) < least:
                continue
            kinds, counts = np.unique(held, return_counts=True)
            most = int((left[kinds] // counts).min())
            wanted = most if wholly else cover[held] + carry
            copies = min(int(wanted), most)
            carry = min(wanted - copies, 1.0)
            if copies:
                left[kinds] -= counts * copies
                yield from _topped(held, copies, left, capacity)


def best_fit(lengths: np.ndarray, capacity: int) -> list[tuple]:
    """Sequences of the given lengths, longest first, each where it leaves the least room."""
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    held: list[list[int]] = []
    open_ = np.zeros(capacity + 1, bool)
    for length in sorted(lengths.tolist(), reverse=True):
        room = length + int(open_[length:].argmax())
        if open_[room]:
            k = rooms[room].pop()
            open_[room] = bool(rooms[room])
        else:
            room, k = capacity, len(held)
            held.append([])
        held[k].append(length)
        rooms[room - length].append(k)
        open_[room - length] = True
    return [tuple(h) for h in held]


def plan_sequences(histogram: np.ndarray, capacity: int = CAPACITY) -> tuple[list[tuple[tuple, int]], int]:
    """Configurations (lengths, longest first) with their copies, which hold the histogram exactly, and a lower bound."""
    left = np.asarray(histogram, np.int64).copy()
    out: list[tuple[tuple, int]] = []
    if left[capacity]:
        out.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    whole = sum(n for _, n in out)
    bound = 0.0
    for k in range(ROUNDINGS):
        if not left.any():
            break
        cover, at_least = fractional(left, capacity)
        bound = max(bound, at_least if k == 0 else 0)
        before = int(left.sum())
        out += _round(cover, left, capacity)
        if int(left.sum()) > before * 0.9 or left.sum() < FEW:
            break
    merged: dict[tuple, int] = {}
    for held, copies in [*out, *((h, 1) for h in best_fit(np.repeat(np.arange(capacity + 1), left), capacity))]:
        merged[held] = merged.get(held, 0) + copies
    return list(merged.items()), whole + int(np.ceil(bound - 1e-6))


def encoder_of(tokenizer_path: str) -> UnitEncoder:
    """The encoder of a file, kept as long as the worker."""
    held = worker_cache()
    if ("units", tokenizer_path) not in held:
        held["units", tokenizer_path] = UnitEncoder(tokenizer_path)
    return held["units", tokenizer_path]


def _cut(path: str, end_id: int, capacity: int, with_ids: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces of every document, numbered among those of their length in this task."""
    encoder = encoder_of(path)
    end = np.asarray([end_id], "<u4").tobytes()
    schema = pa.schema([(f.name, pa.binary() if f.name == "ids" else pa.int32() if f.name in ("piece", "task") else pa.int64()) for f in PIECES])
    task = TaskContext.get().partitionId()
    numbers = [0] * (capacity + 1)
    rows: list[tuple] = []
    held = 0
    for batch in batches:
        texts = batch.column(1)
        for low in range(0, len(texts), 256):
            for doc_id, text in zip(batch.column(0).slice(low, 256).to_pylist(), texts.slice(low, 256).to_pylist(), strict=True):
                ids = encoder.encode(text or "") + end
                total = len(ids) // 4
                start, stop = 0, total % capacity or capacity
                for piece in range(-(-total // capacity)):
                    part, length = ids[4 * start:4 * stop], stop - start
                    rows.append((doc_id, piece, start, length, part if with_ids else None, zlib.crc32(part), task, numbers[length]))
                    numbers[length] += 1
                    held += 64 + 4 * length * with_ids
                    start, stop = stop, stop + capacity
            if held >= FLUSH_BYTES:
                yield _batch(rows, schema)
                held = 0
    if rows:
        yield _batch(rows, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
    rows.clear()
    return out


def cut_documents(documents: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = CAPACITY,
                  with_ids: bool = True) -> DataFrame:
    """One row per piece: its place in its document, its ids (little-endian 32 bits) and their checksum, and its
    number among the pieces of its length in its task."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda batches: _cut(tokenizer_path, end_id, capacity, with_ids, batches), PIECES)


def places(plan: list[tuple[tuple, int]]) -> tuple[np.ndarray, ...]:
    """Where the pieces of a length go, in order of their numbers: (length << 44 | first number), pieces a
    sequence, first sequence, and offset of the first of them."""
    given: dict[int, int] = {}
    rows = []
    sequence = 0
    for held, copies in plan:
        offset = 0
        for length, per in sorted(((x, held.count(x)) for x in set(held)), reverse=True):
            first = given.get(length, 0)
            rows.append((length << 44 | first, per, sequence, offset))
            given[length] = first + per * copies
            offset += length * per
        sequence += copies
    rows.sort()
    return tuple(np.asarray(c, np.int64) for c in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 4


def _place(sent, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codes, pers, sequences, offsets = sent.value
    for batch in batches:
        lengths, numbers = (batch.column(batch.schema.get_field_index(n)).to_numpy() for n in ("length", "place"))
        run = np.searchsorted(codes, lengths << 44 | numbers, "right") - 1
        at = numbers - (codes[run] & ((1 << 44) - 1))
        kept_columns = [(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != "place"]
        yield pa.RecordBatch.from_arrays(
            [*[c for _, c in kept_columns], pa.array(sequences[run] + at // pers[run]), pa.array(offsets[run] + at % pers[run] * lengths)],
            [*[n for n, _ in kept_columns], "sequence_id", "offset"])


def place_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with their sequence and their offset in it; they must be kept, as they are read twice."""
    spark = pieces.sparkSession
    counts = pieces.groupBy("length", "task").agg(F.count("*").alias("rows"))
    found = counts.groupBy("length").agg(F.sum("rows").alias("rows")).toArrow()
    histogram = np.zeros(capacity + 1, np.int64)
    histogram[found["length"].to_numpy()] = found["rows"].to_numpy()
    sent = spark.sparkContext.broadcast(places(plan_sequences(histogram, capacity)[0]))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "task", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"))
    numbered = pieces.join(starts, ["length", "task"]).withColumn("place", F.col("number") + F.col("before"))
    rows = numbered.select(*[c for c in pieces.columns if c not in ("task", "number")], "place")
    schema = T.StructType([*[f for f in rows.schema if f.name != "place"], T.StructField("sequence_id", T.LongType()),
                           T.StructField("offset", T.LongType())])
    return rows.mapInArrow(lambda batches: _place(sent, batches), schema)


def pack_documents(documents: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = CAPACITY,
                   with_ids: bool = True) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence, its ids and their checksum."""
    pieces = cut_documents(documents, tokenizer_path, end_id, capacity, with_ids)
    packed = place_pieces(kept(pieces if with_ids else pieces.drop("ids")), capacity)
    names = ["doc_id", "piece", "start", "length", *["ids"] * with_ids, "ids_crc32", "sequence_id", "offset"]
    return packed.select(*names)
