"""Benchmark decontamination by suffix arrays over shards of the training texts.

Every shard (a slice of whole documents) gets a suffix array of its words; every
suffix of the benchmark is looked up in it by binary search. Suffixes that do not
begin with two words some benchmark suffix begins with are left out of the array:
no search can end at them. Documents are never shuffled. The benchmark is sent to
the tasks in blocks of bounded size; more blocks take more passes over the
documents, which carry their hit ranges along.

Words are lowered (A-Z only) runs of digits, letters and non-ASCII characters. A
window is `window` words in a row; an item of fewer words, but not none, is one
window. A word of a document inside any occurrence of a window is hit.

Defined results: a NULL or empty text has no words and no hits; so has a benchmark
item. A benchmark row without `item_id` is left out. Repeated items count once,
repeated documents give their rows each. Columns of the documents are kept; result
columns replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timelens.llm.store import kept as stored
from timelens.llm.words import ALPHANUMERIC, find_words, gram_hashes, text_slices

WINDOW = 10
RESULT_COLUMNS = {"n_words", "n_hit", "hit_ranges", "item_ids", "longest_match"}

BLOCK_BYTES = 16 << 20
"""Benchmark text that goes to every task at once."""


class Benchmark(NamedTuple):
    words: np.ndarray        # of all items of the block, one after the other
    ends: np.ndarray         # the end of the item each word belongs to
    suffixes: np.ndarray     # one start of every distinct window
    lengths: np.ndarray      # words of that window
    low: np.ndarray          # the window as bytes in the order of suffixes
    high: np.ndarray         # behind all suffixes that begin with it
    firsts: np.ndarray       # hashes of one- and two-word beginnings
    item_offsets: np.ndarray
    items: np.ndarray        # items of each window


def _suffix_keys(words: np.ndarray, ends: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """The next `width` words from each place, no further than the text, as bytes that sort like the suffixes."""
    places = at[:, None] + np.arange(width)
    inside = places < ends[at][:, None]
    picked = np.where(inside, words[np.minimum(places, len(words) - 1)], np.uint64(0))
    return np.ascontiguousarray(picked.astype(">u8")).view(f"S{8 * width}").ravel()


def _ends(rows: np.ndarray) -> np.ndarray:
    return np.searchsorted(rows, rows, "right")


def index_benchmark(items: list, texts: list, window: int = WINDOW) -> Benchmark:
    found_rows, found = [], []
    for low, _, data, offsets in text_slices(pa.array(texts, pa.large_string())):
        words = find_words(data, offsets, ALPHANUMERIC)
        found_rows.append(words.rows + low)
        found.append(words.hashes)
    rows = np.concatenate([np.zeros(0, np.int64), *found_rows])
    words = np.concatenate([np.zeros(0, np.uint64), *found])
    ends, starts = _ends(rows), np.searchsorted(rows, rows, "left")
    at = np.arange(len(words))
    wanted = np.flatnonzero((at + window <= ends) | (at == starts) & (ends - starts < window))
    sizes = np.minimum(ends[wanted] - wanted, window)
    keys = _suffix_keys(words, ends, wanted, window) if len(wanted) else np.zeros(0, f"S{8 * window}")
    # an item of fewer words is another window than a longer one that begins with it
    tagged = np.rec.fromarrays([keys, sizes], names="key,size")
    _, first, which = np.unique(tagged, return_index=True, return_inverse=True)
    ids = np.asarray(items, np.int64)[rows[wanted]] if len(wanted) else np.zeros(0, np.int64)
    pairs = np.unique(np.stack([which.ravel(), ids], 1), axis=0) if len(wanted) else np.zeros((0, 2), np.int64)
    suffixes, lengths = wanted[first], sizes[first]
    low = keys[first]
    high = np.array([k.ljust(8 * n, b"\0") + b"\xff" * (8 * (window - n) + 1) for k, n in zip(low, lengths, strict=True)],
                    dtype=f"S{8 * window + 1}")
    firsts = [gram_hashes(words[s:s + min(n, 2)], min(n, 2)) for s, n in zip(suffixes, lengths, strict=True)]
    return Benchmark(words, ends, suffixes, lengths, low, high,
                     np.unique(np.concatenate([np.zeros(0, np.uint64), *firsts])),
                     np.searchsorted(pairs[:, 0], np.arange(len(suffixes) + 1)), pairs[:, 1])


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def search_shard(words: np.ndarray, rows: np.ndarray, bench: Benchmark, window: int = WINDOW):
    """(start, length, window id, longest match) of every occurrence of a benchmark window."""
    ends = _ends(rows)
    begins = _among(gram_hashes(words, 1), bench.firsts)
    pairs = _among(gram_hashes(words, 2), bench.firsts)
    begins[:len(pairs)] |= pairs & (rows[:len(pairs)] == rows[1:])
    at = np.flatnonzero(begins)
    if not len(at):
        return (np.zeros(0, np.int64),) * 4
    keys = _suffix_keys(words, ends, at, window)
    order = np.argsort(keys, kind="stable")
    array, keys = at[order], keys[order]
    left = np.searchsorted(keys, bench.low, "left")
    right = np.maximum(left, np.searchsorted(keys, bench.high, "left"))
    counts = right - left
    which = np.repeat(np.arange(len(counts)), counts)
    places = np.repeat(left - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
    starts, lengths = array[places], bench.lengths[which]
    longest, test = lengths.copy(), bench.suffixes[which]
    going = np.arange(len(starts))
    while len(going):
        here, there = starts[going] + longest[going], test[going] + longest[going]
        more = (here < ends[starts[going]]) & (there < bench.ends[test[going]])
        going, here, there = going[more], here[more], there[more]
        going = going[words[here] == bench.words[there]]
        longest[going] += 1
    return starts, lengths, which, longest


def _marked(n: int, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + lengths, -1)
    return np.cumsum(change[:-1]) > 0


def _search(bench: Benchmark, window: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.schema.names
        texts = batch.column(names.index("text"))
        known = batch.column(names.index("hit_ranges"))
        items_so_far = batch.column(names.index("item_ids"))
        longest_so_far = batch.column(names.index("longest_match"))
        for low, high, data, offsets in text_slices(texts):
            found = find_words(data, offsets, ALPHANUMERIC)
            n_rows = high - low
            starts, lengths, which, longest = search_shard(found.hashes, found.rows, bench, window)
            firsts = np.searchsorted(found.rows, np.arange(n_rows + 1))
            n_words = np.diff(firsts)
            before = known.slice(low, n_rows).to_pylist()
            for r, ranges in enumerate(before):
                if ranges:
                    was = np.asarray(ranges, np.int64).reshape(-1, 2)
                    starts = np.concatenate([starts, was[:, 0] + firsts[r]])
                    lengths = np.concatenate([lengths, was[:, 1] - was[:, 0]])
            hit = _marked(len(found.hashes), starts, lengths)
            hit_rows = found.rows[hit]
            n_hit = np.bincount(hit_rows, minlength=n_rows)
            # hit words as ranges [start, end) within their rows
            change = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
            ranges_out: list[list[int]] = [[] for _ in range(n_rows)]
            for a, b in change.reshape(-1, 2).tolist():
                while a < b:
                    r = int(found.rows[a])
                    stop = min(b, int(firsts[r + 1]))
                    ranges_out[r] += [a - int(firsts[r]), stop - int(firsts[r])]
                    a = stop
            items: list[list[int]] = [x or [] for x in items_so_far.slice(low, n_rows).to_pylist()]
            length_out = np.asarray(longest_so_far.slice(low, n_rows).to_pylist(), np.int64)
            if len(which):
                word_rows = found.rows[starts[:len(which)]]
                np.maximum.at(length_out, word_rows, longest)
                for r, w in np.unique(np.stack([word_rows, which], 1), axis=0).tolist():
                    items[r].extend(bench.items[bench.item_offsets[w]:bench.item_offsets[w + 1]].tolist())
            columns = {n: batch.column(i).slice(low, n_rows) for i, n in enumerate(names)}
            columns |= {
                "n_words": pa.array(n_words, pa.int64()), "n_hit": pa.array(n_hit, pa.int64()),
                "hit_ranges": pa.array(ranges_out, pa.list_(pa.int64())),
                "item_ids": pa.array([sorted(set(x)) for x in items], pa.list_(pa.int64())),
                "longest_match": pa.array(length_out, pa.int64()),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def benchmark_blocks(benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> Iterator[Benchmark]:
    """The benchmark as blocks of about `block_bytes` of text, told apart by a hash of the item."""
    rows = (benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
            .where(F.col("item_id").isNotNull() & F.col("text").isNotNull()))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = -(-int(total) // block_bytes) or 1
    for k in range(n):
        block = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).toArrow()
        yield index_benchmark(block["item_id"].to_pylist(), block["text"].to_pylist(), window)


def find_contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                       block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents with n_words, n_hit, hit_ranges (start, end, start, end, ... in words),
    item_ids (sorted) and longest_match (words of the longest verbatim match, 0 for none)."""
    kept = [c for c in documents.columns if c not in RESULT_COLUMNS]
    out = documents.select(*kept).withColumns({
        "text": F.col("text").cast("string"), "n_words": F.lit(0).cast("long"), "n_hit": F.lit(0).cast("long"),
        "hit_ranges": F.lit(None).cast("array<long>"), "item_ids": F.lit(None).cast("array<long>"),
        "longest_match": F.lit(0).cast("long"),
    })
    context = documents.sparkSession.sparkContext
    for k, block in enumerate(benchmark_blocks(benchmark, window, block_bytes)):
        if k:
            out = stored(out)
        sent = context.broadcast(block)
        out = out.mapInArrow(lambda batches, sent=sent: _search(sent.value, window, batches), out.schema)
    return out


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without any benchmark window, with their own columns, whatever their names."""
    if RESULT_COLUMNS.isdisjoint(documents.columns):
        return find_contamination(documents, benchmark, window).where(F.col("n_hit") == 0).select(*documents.columns)
    packed = documents.select(F.struct("*").alias("row"), "text")
    return find_contamination(packed, benchmark, window).where(F.col("n_hit") == 0).select("row.*")
