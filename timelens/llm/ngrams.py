"""Language-model scores from a log-frequency Bloom filter of bigram counts.

Training tokens (lowered words and one end per document) and pairs of neighbours are
counted exactly over the corpus: tasks count their own, counts meet by hash. A count
c is quantised to the level 1 + floor(log c / log BASE), and a term of level q enters
the filter q times, as (term, 1) to (term, q). Probing (term, 1), (term, 2), ... until
one is missing gives the level back; it is never too low. The filter is made of
segments, one for each hash bucket, sized by their entries, so it grows with the
corpus; segments go to the tasks in waves of at most `wave_bytes`, and each wave is a
pass over the documents which leaves the levels found so far with them. One wave is
the usual case. The result does not depend on the number of waves.

A token's probability is (1 - w) p(token) + w p(token | token before), both of
quantised counts, where w rises with the count of the token before, from 0 to
MOST_WEIGHT. A pair's level is held below that of its tokens.

The base score needs exact counts of all words of all documents. The most frequent
words, at most HOT_WORDS and one a bucket, are sent to the tasks, which settles half
of all tokens and all crowded words. The other words travel to their bucket, packed by
slices of documents; there counts come from the very same tokens, and what they add to
each document travels back to the slice. No bucket holds a word of more than
its share of the tokens.

Defined results: a NULL or empty text has the end as its only token. A document
without id trains. Repeated documents count as often as they come, and each gets its
row. Without training tokens all counts are 0 and probabilities are the smoothed ones.
Words are told apart by 64 bits, pairs by at least 40. The rows of the documents must
come in the same order when a task is run again, as they do from files.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from timelens.llm.store import kept as stored
from timelens.llm.words import NON_SPACE, find_words, mix, text_slices

BASE = 1.5
PROBES, BITS_PER_ENTRY = 4, 6
HOT_WORDS = 1 << 16
MOST_WEIGHT, HALF_WEIGHT = 0.25, 2.0
WAVE_BYTES = 160 << 20
CHUNK_TOKENS = 1 << 21
"""Tokens a task counts before it hands them on."""

END, BEGIN = mix(np.array([0xE4D, 0xBE6], np.uint64))
_FIRST, _SECOND = mix(np.array([0xF1, 0xF2], np.uint64)) | np.uint64(1)
_LEVEL = np.uint64(0x9E3779B97F4A7C15)


class Tokens(NamedTuple):
    rows: np.ndarray
    hashes: np.ndarray
    pairs: np.ndarray


def read_tokens(data: np.ndarray, offsets: np.ndarray, n_rows: int) -> Tokens:
    """All tokens with the end of each row, and the hash of each with the token before."""
    found = find_words(data, offsets, NON_SPACE)
    behind = np.searchsorted(found.rows, np.arange(n_rows), "right")
    rows = np.insert(found.rows, behind, np.arange(n_rows))
    hashes = np.insert(found.hashes, behind, END)
    before = np.empty_like(hashes)
    before[1:] = hashes[:-1]
    before[np.searchsorted(rows, np.arange(n_rows))] = BEGIN
    return Tokens(rows, hashes, mix(before * _FIRST + hashes * _SECOND))


def levels_of(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / math.log(BASE) + 1e-9).astype(np.int64)


def _level_means() -> np.ndarray:
    """The middle of the whole counts of each level; 0 for level 0."""
    means = [0.0]
    for level in range(1, 128):
        low, high = math.ceil(BASE ** (level - 1) - 1e-6), math.ceil(BASE ** level - 1e-6) - 1
        means.append(max(low, (low + high) / 2))
    return np.array(means)


MEANS = _level_means()


def _places(keys: np.ndarray, level: int | np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
    """The bits of (key, level) in a segment of `sizes` bits, one probe after the other."""
    x = mix(keys + np.asarray(level).astype(np.uint64) * _LEVEL)
    step = (x >> np.uint64(32)) | np.uint64(1)
    at = x & np.uint64(0xFFFFFFFF)
    for _ in range(PROBES):
        yield (at % sizes).astype(np.int64)
        at = at + step


def _short(hashes: np.ndarray, bucket_bits: int) -> np.ndarray:
    """The 40 bits behind those of the bucket."""
    return (hashes << np.uint64(bucket_bits)) >> np.uint64(24)


def make_segment(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The filter of short keys with their counts, as bytes."""
    levels = levels_of(counts)
    size = max(64, int(levels.sum()) * BITS_PER_ENTRY + 7 & ~7)
    bits = np.zeros(size, bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        for places in _places(keys[levels >= level], level, np.uint64(size)):
            bits[places] = True
    return np.packbits(bits, bitorder="little")


class Wave(NamedTuple):
    """Some segments one behind the other; a bucket that is not among them has no bits."""
    bucket_bits: int
    starts: np.ndarray   # bytes
    sizes: np.ndarray    # bits
    data: np.ndarray

    def levels(self, hashes: np.ndarray) -> np.ndarray:
        """The level of each hash; 0 for those of other waves."""
        bucket = (hashes >> np.uint64(64 - self.bucket_bits)).astype(np.int64)
        out = np.zeros(len(hashes), np.uint8)
        going = np.flatnonzero(self.sizes[bucket])
        keys, sizes = _short(hashes, self.bucket_bits), self.sizes[bucket]
        starts, level = self.starts[bucket], 0
        while len(going) and level < len(MEANS) - 1:
            level += 1
            kept = np.ones(len(going), bool)
            for places in _places(keys[going], level, sizes[going]):
                kept &= (self.data[starts[going] + (places >> 3)] >> (places & 7).astype(np.uint8) & 1).astype(bool)
            going = going[kept]
            out[going] = level
        return out


class Counts(NamedTuple):
    """What the whole training corpus gives to every task."""
    tokens: int
    types: int
    documents: int
    hot: np.ndarray
    hot_counts: np.ndarray

    @property
    def denominator(self) -> float:
        return self.tokens + 0.1 * (self.types + 1)

    def of_hot(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.hot):
            return np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.hot, hashes), len(self.hot) - 1)
        return self.hot[at] == hashes, self.hot_counts[at]


def _packed(array: np.ndarray) -> bytes:
    return np.ascontiguousarray(array).tobytes()


def _count_tokens(bucket_bits: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of words (kind 0, 8 bytes a key) and pairs (kind 1, 5 bytes), by bucket."""
    waiting: list[Tokens] = []

    def hand_on() -> Iterator[pa.RecordBatch]:
        for kind, hashes in ((0, np.concatenate([t.hashes for t in waiting])), (1, np.concatenate([t.pairs for t in waiting]))):
            keys, counts = np.unique(hashes, return_counts=True)
            buckets = keys >> np.uint64(64 - bucket_bits)
            cuts = np.searchsorted(buckets, np.arange((1 << bucket_bits) + 1, dtype=np.uint64))
            held = np.flatnonzero(np.diff(cuts))
            if kind:
                data = _short(keys, bucket_bits).astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:]
            else:
                data = keys
            counts = counts.astype(np.uint32)
            yield pa.RecordBatch.from_pydict({
                "bucket": pa.array(held, pa.int32()), "kind": pa.array(np.full(len(held), kind), pa.int32()),
                "keys": pa.array([_packed(data[cuts[b]:cuts[b + 1]]) for b in held], pa.binary()),
                "counts": pa.array([_packed(counts[cuts[b]:cuts[b + 1]]) for b in held], pa.binary())})
        waiting.clear()

    held = 0
    for batch in batches:
        for low, high, data, offsets in text_slices(batch.column(0)):
            waiting.append(read_tokens(data, offsets, high - low))
            held += len(waiting[-1].rows)
            if held >= CHUNK_TOKENS:
                yield from hand_on()
                held = 0
    if waiting:
        yield from hand_on()


_SEGMENTS = "bucket int, tokens long, types long, hot binary, hot_counts binary, segment binary"


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    terms, which = np.unique(np.concatenate(keys), return_inverse=True)
    return terms, np.bincount(which.ravel(), np.concatenate(counts).astype(np.float64), len(terms)).astype(np.int64)


def _make_segments(bucket_bits: int, hot_each: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[int, int], tuple[list, list]] = {}
    for batch in batches:
        for bucket, kind, keys, counts in zip(*(batch.column(i) for i in range(4)), strict=True):
            if kind.as_py():
                data = np.zeros((len(keys.as_py()) // 5, 8), np.uint8)
                data[:, 3:] = np.frombuffer(keys.as_buffer(), np.uint8).reshape(-1, 5)
                array = data.view(">u8").ravel().astype(np.uint64)
            else:
                array = np.frombuffer(keys.as_buffer(), np.uint64)
            lists = held.setdefault((bucket.as_py(), kind.as_py()), ([], []))
            lists[0].append(array)
            lists[1].append(np.frombuffer(counts.as_buffer(), np.uint32))
    for bucket in sorted({b for b, _ in held}):
        words, counts = _merge(*held.pop((bucket, 0), ([np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)])))
        pairs, pair_counts = _merge(*held.pop((bucket, 1), ([np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)])))
        segment = make_segment(np.concatenate([_short(words, bucket_bits), pairs]), np.concatenate([counts, pair_counts]))
        hot = np.lexsort((words, -counts))[:hot_each]
        yield pa.RecordBatch.from_pydict({
            "bucket": pa.array([bucket], pa.int32()), "tokens": pa.array([int(counts.sum())], pa.int64()),
            "types": pa.array([len(words)], pa.int64()), "hot": pa.array([_packed(words[hot])], pa.binary()),
            "hot_counts": pa.array([_packed(counts[hot])], pa.binary()),
            "segment": pa.array([segment.tobytes()], pa.binary())})


class Model(NamedTuple):
    counts: Counts
    bucket_bits: int
    tasks: int
    segments: DataFrame


def build_model(training: DataFrame, hot_words: int = HOT_WORDS) -> Model:
    """The counts and filter segments of the training documents' `text`, kept in the shared folder."""
    spark = training.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bucket_bits = max(4, (2 * tasks - 1).bit_length())
    texts = training.select(F.col("text").cast("string").alias("text"))
    hot_each = max(1, hot_words >> bucket_bits)
    segments = stored(
        texts.mapInArrow(lambda b: _count_tokens(bucket_bits, b), "bucket int, kind int, keys binary, counts binary")
        .repartition(tasks, "bucket").mapInArrow(lambda b: _make_segments(bucket_bits, hot_each, b), _SEGMENTS))
    # two numbers and at most `hot_each` words a bucket
    rows = segments.drop("segment").toArrow()
    hot = np.frombuffer(b"".join(rows["hot"].to_pylist()), np.uint64)
    hot_counts = np.frombuffer(b"".join(rows["hot_counts"].to_pylist()), np.int64)
    order = np.argsort(hot)
    ends = hot_counts[hot == END]
    counts = Counts(sum(rows["tokens"].to_pylist()), sum(rows["types"].to_pylist()),
                    int(ends[0]) if len(ends) else 0, hot[order], hot_counts[order])
    if not len(ends) and counts.tokens:
        counts = counts._replace(documents=training.count())
    return Model(counts, bucket_bits, tasks, segments)


def wave_buckets(model: Model, wave_bytes: int = WAVE_BYTES) -> list[list[int]]:
    """The buckets of each wave."""
    groups: list[list[int]] = [[]]
    held = 0
    for bucket, size in sorted((r[0], r[1]) for r in model.segments.select("bucket", F.octet_length("segment")).collect()):
        if held and held + size > wave_bytes:
            groups.append([])
            held = 0
        groups[-1].append(bucket)
        held += size
    return groups


def fetch_wave(model: Model, buckets: list[int]) -> Wave:
    starts, bits = np.zeros(1 << model.bucket_bits, np.int64), np.zeros(1 << model.bucket_bits, np.uint64)
    data, at = [np.zeros(0, np.uint8)], 0
    if buckets:
        rows = (model.segments.where(F.col("bucket").between(buckets[0], buckets[-1]))
                .select("bucket", "segment").toArrow())
        for bucket, segment in zip(rows["bucket"].to_pylist(), rows["segment"], strict=True):
            part = np.frombuffer(segment.as_buffer(), np.uint8)
            starts[bucket], bits[bucket] = at, 8 * len(part)
            data.append(part)
            at += len(part)
    return Wave(model.bucket_bits, starts, bits, np.concatenate(data))


def _levels(tokens: Tokens, wave: Wave, before: bytes | None) -> np.ndarray:
    """[2, token] levels of words and pairs, with those of earlier waves."""
    out = np.zeros((2, len(tokens.rows)), np.uint8)
    for k, hashes in enumerate((tokens.hashes, tokens.pairs)):
        terms, which = np.unique(hashes, return_inverse=True)
        out[k] = wave.levels(terms)[which.ravel()]
    if before is not None:
        out = np.maximum(out, np.frombuffer(before, np.uint8).reshape(2, -1))
    return out


def _earlier(batch: pa.RecordBatch, low: int, high: int, tokens: Tokens) -> bytes | None:
    """The levels that earlier waves left in the rows, in the order of the slice's tokens."""
    kept = [x for x in batch.column(batch.schema.names.index("levels")).slice(low, high - low).to_pylist()]
    if not kept or kept[0] is None:
        return None
    halves = [np.frombuffer(x, np.uint8).reshape(2, -1) for x in kept]
    return np.concatenate(halves, 1).tobytes()


def _add_levels(wave: Wave, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.schema.names
        for low, high, data, offsets in text_slices(batch.column(names.index("text"))):
            tokens = read_tokens(data, offsets, high - low)
            levels = _levels(tokens, wave, _earlier(batch, low, high, tokens))
            cuts = np.searchsorted(tokens.rows, np.arange(high - low + 1))
            columns = [c.slice(low, high - low) for c in batch.columns]
            columns[names.index("levels")] = pa.array(
                [_packed(levels[:, a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays(columns, names)


def log_probabilities(tokens: Tokens, levels: np.ndarray, counts: Counts) -> np.ndarray:
    words = levels[0]
    firsts = np.searchsorted(tokens.rows, np.unique(tokens.rows))
    before = np.concatenate([words[:1], words[:-1]])
    context = MEANS[before]
    context[firsts] = counts.documents
    limit = np.minimum(before, words)
    limit[firsts] = words[firsts]
    pair = MEANS[np.minimum(levels[1], limit)]
    alone = (MEANS[words] + 0.1) / counts.denominator
    weight = MOST_WEIGHT * context / (context + HALF_WEIGHT)
    given = np.minimum(1.0, pair / np.maximum(context, 1))
    return np.log10((1 - weight) * alone + weight * given)


_TRAVEL = "bucket int, slice long, kind int, ids binary, held binary, numbers binary, keys binary, uses binary, rows binary, times binary"


def _travel(rows: list[dict]) -> pa.RecordBatch:
    types = {"bucket": pa.int32(), "slice": pa.int64(), "kind": pa.int32()}
    names = [x.split()[0] for x in _TRAVEL.split(", ")]
    return pa.RecordBatch.from_pydict({n: pa.array([r.get(n) for r in rows], types.get(n, pa.binary())) for n in names})


def _send(model_counts: Counts, wave: Wave, bucket_bits: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per slice: its documents (kind 0), and by bucket the words whose counts are not at hand (kind 1)."""
    number = TaskContext.get().partitionId() << 33
    shift = np.uint64(64 - bucket_bits)
    for batch in batches:
        names = batch.schema.names
        ids, held = batch.column(names.index("doc_id")), batch.column(names.index("held_out")).to_numpy(zero_copy_only=False)
        for low, high, data, offsets in text_slices(batch.column(names.index("text"))):
            n = high - low
            tokens = read_tokens(data, offsets, n)
            levels = _levels(tokens, wave, _earlier(batch, low, high, tokens))
            logs = log_probabilities(tokens, levels, model_counts)
            hot, counts = model_counts.of_hot(tokens.hashes)
            numbers = np.zeros((4, n))
            numbers[0] = np.bincount(tokens.rows, minlength=n)
            numbers[1] = np.bincount(tokens.rows[hot & (counts > 0)], minlength=n)
            numbers[2] = np.bincount(tokens.rows[hot], np.log10(counts[hot] + 0.1), n)
            numbers[3] = np.bincount(tokens.rows, logs, n)
            part = ids.slice(low, n)
            known = pa.RecordBatch.from_arrays([part], ["doc_id"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, known.schema) as out:
                out.write_batch(known)
            home = int(mix(np.array([number], np.uint64))[0]) % (1 << bucket_bits)
            rows = [{"bucket": home, "slice": number, "kind": 0, "ids": sink.getvalue().to_pybytes(),
                     "held": _packed(held[low:high].astype(np.uint8)), "numbers": _packed(numbers)}]
            order = np.lexsort((tokens.rows[~hot], tokens.hashes[~hot]))
            words, of = tokens.hashes[~hot][order], tokens.rows[~hot][order]
            if len(words):
                new = np.concatenate([[True], (words[1:] != words[:-1]) | (of[1:] != of[:-1])])
                at = np.flatnonzero(new)
                times = np.diff(np.append(at, len(words)))
                words, of = words[at], of[at]
                keys, first = np.unique(words, return_index=True)
                first = np.append(first, len(words))
                cuts = np.searchsorted(keys >> shift, np.arange((1 << bucket_bits) + 1, dtype=np.uint64))
                marked = of.astype(np.uint32) | (~held[low:high][of]).astype(np.uint32) << np.uint32(31)
                for b in np.flatnonzero(np.diff(cuts)).tolist():
                    k0, k1 = cuts[b], cuts[b + 1]
                    p0, p1 = first[k0], first[k1]
                    rows.append({"bucket": b, "slice": number, "kind": 1, "keys": _packed(keys[k0:k1]),
                                 "uses": _packed(np.diff(first[k0:k1 + 1]).astype(np.uint32)),
                                 "rows": _packed(marked[p0:p1]), "times": _packed(times[p0:p1].astype(np.uint32))})
            yield _travel(rows)
            number += 1


def _look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of all slices meet; per slice goes back what they add to its documents (kind 2)."""
    slices, keys, rows, times, sizes = [], [], [], [], []
    for batch in batches:
        kinds = batch.column(2).to_numpy()
        passing = np.flatnonzero(kinds == 0)
        if len(passing):
            yield batch.take(pa.array(passing))
        for i in np.flatnonzero(kinds == 1).tolist():
            uses = np.frombuffer(batch.column(7)[i].as_buffer(), np.uint32)
            keys.append(np.repeat(np.frombuffer(batch.column(6)[i].as_buffer(), np.uint64), uses))
            rows.append(np.frombuffer(batch.column(8)[i].as_buffer(), np.uint32))
            times.append(np.frombuffer(batch.column(9)[i].as_buffer(), np.uint32))
            slices.append(batch.column(1)[i].as_py())
            sizes.append(len(rows[-1]))
    if not keys:
        return
    all_rows, all_times = np.concatenate(rows), np.concatenate(times).astype(np.float64)
    terms, which = np.unique(np.concatenate(keys), return_inverse=True)
    which = which.ravel()
    training = all_rows >> np.uint32(31) == 1
    counts = np.bincount(which[training], all_times[training], len(terms))
    added, known = all_times * np.log10(counts + 0.1)[which], all_times * (counts > 0)[which]
    of = (all_rows & np.uint32(0x7FFFFFFF)).astype(np.int64)
    by: dict[int, list[tuple[int, int]]] = {}
    at = 0
    for number, size in zip(slices, sizes, strict=True):
        by.setdefault(number, []).append((at, at + size))
        at += size
    out = []
    for number, parts in by.items():
        place = np.concatenate([np.arange(a, b) for a, b in parts])
        docs, inverse = np.unique(of[place], return_inverse=True)
        sums = np.stack([np.bincount(inverse.ravel(), known[place]), np.bincount(inverse.ravel(), added[place])])
        out.append({"bucket": 0, "slice": number, "kind": 2, "rows": _packed(docs.astype(np.uint32)), "numbers": _packed(sums)})
        if len(out) == 256:
            yield _travel(out)
            out = []
    if out:
        yield _travel(out)


def _gather(counts: Counts, schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices with all that was added to their documents."""
    slices: dict[int, tuple] = {}
    added: dict[int, np.ndarray] = {}
    for batch in batches:
        for i in range(len(batch)):
            number, numbers = batch.column(1)[i].as_py(), np.frombuffer(batch.column(5)[i].as_buffer(), np.float64)
            if batch.column(2)[i].as_py() == 0:
                known = pa.ipc.open_stream(batch.column(3)[i].as_buffer()).read_all().column(0).combine_chunks()
                held = np.frombuffer(batch.column(4)[i].as_buffer(), np.uint8).astype(bool)
                slices[number] = (known, held, numbers.reshape(4, -1))
            else:
                rows = np.frombuffer(batch.column(8)[i].as_buffer(), np.uint32).astype(np.int64)
                sums = numbers.reshape(2, -1)
                have = added.get(number)
                size = int(rows.max()) + 1
                if have is None or have.shape[1] < size:
                    grown = np.zeros((2, max(size, 1024)))
                    if have is not None:
                        grown[:, :have.shape[1]] = have
                    have = added[number] = grown
                have[:, rows] += sums
    for number, (known, held, numbers) in slices.items():
        n = len(held)
        more = np.zeros((2, n))
        if number in added:
            size = min(n, added[number].shape[1])
            more[:, :size] = added[number][:, :size]
        tokens = numbers[0]
        base = numbers[2] + more[1] - tokens * math.log10(counts.denominator)
        yield pa.RecordBatch.from_arrays(
            [known, pa.array(held), pa.array(tokens.astype(np.int64)), pa.array((numbers[1] + more[0]).astype(np.int64)),
             pa.array(np.full(n, counts.tokens, np.int64)), pa.array(base), pa.array(numbers[3])], schema=schema)


def score_documents(documents: DataFrame, model: Model, wave_bytes: int = WAVE_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of all documents.

    `documents` has doc_id, text and held_out; the model's training documents must be
    those that are not held out, since exact counts are taken from them on the way.
    """
    context = documents.sparkSession.sparkContext
    rows = documents.select("doc_id", F.col("text").cast("string").alias("text"), "held_out",
                            F.lit(None).cast("binary").alias("levels"))
    *earlier, last = wave_buckets(model, wave_bytes)
    for buckets in earlier:
        wave = context.broadcast(fetch_wave(model, buckets))
        rows = stored(rows.mapInArrow(lambda b, wave=wave: _add_levels(wave.value, b), rows.schema))
        wave.unpersist()
    sent = context.broadcast((model.counts, fetch_wave(model, last)))
    bits = model.bucket_bits
    id_type = documents.schema["doc_id"].dataType.simpleString()
    out = (f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, "
           "base_score double, score double")
    schema = pa.schema([("doc_id", to_arrow_type(documents.schema["doc_id"].dataType)), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                        ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    return (rows.mapInArrow(lambda b: _send(sent.value[0], sent.value[1], bits, b), _TRAVEL)
            .repartition(model.tasks, "bucket").mapInArrow(_look_up, _TRAVEL)
            .repartition(model.tasks, "slice").mapInArrow(lambda b: _gather(sent.value[0], schema, b), out))
