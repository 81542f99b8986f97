"""Packing of token documents into windows of equal capacity.

A document's ids end with an end id. Pieces of a whole window go out as windows of
their own. What is left of each document is cut into halves, the second half again, and
so on down to `grain` ids: parts of all sizes can be levelled out. Groups of parts
are spread over as few windows as can hold them by Karmarkar-Karp multiway differencing: each part starts as a partial partition (the
part in one window, the others empty); the two partitions with the widest spread
are merged, fullest window upon emptiest, until one is left. If its fullest window
is over capacity, the group is partitioned anew over one window more.

Groups never leave their task: nothing is shuffled, and each task has one group
that is not full. Within a window, parts of one document that follow each other
are one piece.

Defined results: a NULL or empty text is the end id alone. Repeated documents are
packed as often as they come. No documents give no pieces.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CAPACITY = 1024
GRAIN = 24
GROUP_WINDOWS = 24
SPARE = 8
"""Ids per window that a group leaves free, room for the parts' unequal sizes."""

CACHED_UNITS, KEPT_UNIT = 500_000, 64
"""Units a worker keeps at once, and the characters of the longest of them."""

PIECES = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()),
    T.StructField("ids", T.BinaryType()),
    T.StructField("doc_tokens", T.LongType()),
    T.StructField("sequence_id", T.LongType()),
    T.StructField("offset", T.LongType()),
])

# A single space or line end between two characters that are none begins a
# pre-token, whatever stands around it; other texts are encoded whole.
_UNSAFE = re.compile(r"\s\s|\A\s|\s\Z|[^\S \n]")

_UNIT = re.compile(r" ?[^ \n]+|\n")

# Fixed value: how the byte-level tokenizer cuts a text into pre-tokens.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable bytes are their own."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}


class UnitEncoder(dict):
    """Token ids, as little-endian 32-bit bytes, of a space-separated unit of text; kept for reuse.

    Reads the vocabulary of a byte-level BPE file whose ids follow its merges, as
    ranks for the faster of the two libraries. The ids are those of the file's own.
    """

    def __init__(self, tokenizer_path: str):
        super().__init__()
        import tiktoken

        model = json.loads(Path(tokenizer_path).read_text())["model"]
        vocabulary, letters = model["vocab"], byte_letters()
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        if any(vocabulary[a + b] != 256 + k for k, (a, b) in enumerate(pairs)):
            raise ValueError("the ids of this vocabulary do not follow its merges")
        ranks = {bytes(letters[c] for c in t): i for t, i in vocabulary.items() if i < 256 + len(pairs)}
        self.encode_ordinary = tiktoken.Encoding(
            "file", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __missing__(self, unit: str) -> bytes:
        ids = array("I", self.encode_ordinary(unit)).tobytes()
        if len(unit) <= KEPT_UNIT:
            if len(self) >= CACHED_UNITS:
                self.clear()
            self[unit] = ids
        return ids

    def encode(self, text: str) -> bytes:
        return b"".join([self[u] for u in text_units(text)])


@lru_cache(1)
def unit_encoder(tokenizer_path: str) -> UnitEncoder:
    return UnitEncoder(tokenizer_path)


def text_units(text: str) -> list[str]:
    """Parts of a text that can be encoded each by itself."""
    if not text:
        return []
    if _UNSAFE.search(text):
        return [text]
    return _UNIT.findall(text)


def difference(sizes: list[int], windows: int) -> list[list[int]]:
    """Karmarkar-Karp: the indices of `sizes` in each of `windows` near-equal sets."""
    heap = []
    for i, size in enumerate(sizes):
        sums = [0] * (windows - 1) + [size]
        heap.append((-size, i, sums, [None] * (windows - 1) + [(i, None, None)]))
    heapq.heapify(heap)
    order = len(sizes)
    while len(heap) > 1:
        _, _, a, in_a = heapq.heappop(heap)
        _, _, b, in_b = heapq.heappop(heap)
        merged = [(x + y, (None, p, q) if p and q else p or q)
                  for x, y, p, q in zip(a, reversed(b), in_a, reversed(in_b), strict=True)]
        merged.sort(key=lambda pair: pair[0])
        sums = [m[0] for m in merged]
        heapq.heappush(heap, (sums[0] - sums[-1], order, sums, [m[1] for m in merged]))
        order += 1
    if not heap:
        return [[] for _ in range(windows)]
    out = []
    for tree in heap[0][3]:
        found, open_ = [], [tree] if tree else []
        while open_:
            i, p, q = open_.pop()
            if i is None:
                open_ += [p, q]
            else:
                found.append(i)
        out.append(sorted(found))
    return out


def partition(sizes: list[int], capacity: int) -> list[list[int]]:
    """Near-equal windows, none over capacity; no size may be above it."""
    windows = -(-sum(sizes) // capacity)
    while True:
        sets = difference(sizes, windows)
        if all(sum(sizes[i] for i in s) <= capacity for s in sets):
            return [s for s in sets if s]
        windows += 1


def _windows(parts: list[tuple], capacity: int) -> Iterator[list[tuple]]:
    """Windows of (document number, doc_id, start, ids, doc_tokens)."""
    for chosen in partition([len(p[3]) // 4 for p in parts], capacity):
        pieces: list[tuple] = []
        for i in chosen:
            number, doc_id, start, ids, total = parts[i]
            if pieces and pieces[-1][0] == number and pieces[-1][2] + len(pieces[-1][3]) // 4 == start:
                pieces[-1] = (*pieces[-1][:3], pieces[-1][3] + ids, total)
            else:
                pieces.append(parts[i])
        yield pieces


def _pack(path: str, end_id: int, capacity: int, grain: int, group_windows: int,
          batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encoder = unit_encoder(path)
    end = np.asarray([end_id], "<u4").tobytes()
    schema = pa.schema([(f.name, pa.binary() if f.name == "ids" else pa.int64()) for f in PIECES])
    sequence = TaskContext.get().partitionId() << 33
    waiting: list[tuple] = []
    waiting_ids = number = 0
    rows: list[tuple] = []

    def flush() -> Iterator[pa.RecordBatch]:
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
            rows.clear()

    def close(room: int) -> None:
        """Pack the waiting parts, as far as they fit `room` ids; a part is cut at the end of it."""
        nonlocal sequence, waiting, waiting_ids
        group: list[tuple] = []
        for k, (n, doc_id, start, ids, total) in enumerate(waiting):
            size = min(room, len(ids) // 4)
            group.append((n, doc_id, start, ids[:4 * size], total))
            room -= size
            if not room:
                rest = [(n, doc_id, start + size, ids[4 * size:], total)] if 4 * size < len(ids) else []
                waiting = rest + waiting[k + 1:]
                break
        else:
            waiting = []
        waiting_ids = sum(len(p[3]) // 4 for p in waiting)
        for window in _windows(group, capacity):
            offset = 0
            for _, doc_id, start, ids, total in window:
                rows.append((doc_id, start, len(ids) // 4, ids, total, sequence, offset))
                offset += len(ids) // 4
            sequence += 1

    group_ids = group_windows * max(1, capacity - SPARE)
    for batch in batches:
        doc_ids, texts = batch.column(0).to_pylist(), batch.column(1)
        for low in range(0, len(texts), 256):
            for doc_id, text in zip(doc_ids[low:low + 256], texts.slice(low, 256).to_pylist(), strict=True):
                ids = encoder.encode(text or "") + end
                total, number = len(ids) // 4, number + 1
                full = total // capacity * capacity
                for start in range(0, full, capacity):
                    rows.append((doc_id, start, capacity, ids[4 * start:4 * (start + capacity)], total, sequence, 0))
                    sequence += 1
                waiting_ids += total - full
                start = full
                while start < total:
                    left = total - start
                    stop = total if left <= grain else start + (left + 1) // 2
                    waiting.append((number, doc_id, start, ids[4 * start:4 * stop], total))
                    start = stop
                while waiting_ids >= group_ids:
                    close(group_ids)
            yield from flush()
    while waiting:
        close(group_ids)
    yield from flush()


def pack_documents(documents: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = CAPACITY,
                   grain: int = GRAIN, group_windows: int = GROUP_WINDOWS) -> DataFrame:
    """One row per piece: where it lies in its document and in its window, and its ids (little-endian 32 bits).

    `group_windows` bounds what a task partitions at once, `grain` the smallest cut.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(
        lambda batches: _pack(tokenizer_path, end_id, capacity, grain, group_windows, batches), PIECES)


def digest_pieces(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids.

    Spark makes it, so that no second Python worker stands beside the one that packs.
    """
    return pieces.select(*[F.crc32("ids").alias("ids_crc32") if c == "ids" else c for c in pieces.columns])
