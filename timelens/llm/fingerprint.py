"""Document fingerprints by I-Match over randomised lexicons.

The lexicon holds the terms whose inverse document frequency, ln(documents /
documents with the term), lies within a band; frequencies are of all documents,
counted in a table of fixed size. A text's distinct lexicon terms are hashed as a
set (a sum of mixed term hashes: the same in any order) for each of several
randomised subsets of the lexicon. Subsets come in levels, each holding a quarter of
the one before, so that short and long texts have levels where subsets hold one or
two of their terms; an edit then changes some subset hashes, not all. The likeness of
two fingerprints is the share of equal hashes among the subsets that either text
has terms of, on the sparsest level where that is a third of the subsets.

Defined results: terms are runs of digits, letters and non-ASCII characters, A-Z
lowered. A text with terms, but none in the band, uses all its terms. A text without
terms (NULL, empty, signs only) has the fingerprint of zeros, like only to its kind.
Equal texts have equal fingerprints. Repeated rows are kept. In `with_neighbours`
rows of one id are ordered by a hash of their text, and a NULL id comes first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timelens.llm.sketch import counter_of, distinct_pairs, hashed_counts
from timelens.llm.words import ALPHANUMERIC, find_words, mix, text_slices
from timelens.llm.store import kept

BAND = (2.0, 7.0)
BITS = 22
LEVELS, SUBSETS = 5, 24

_SEEDS = mix(np.arange(1, SUBSETS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class Lexicon(NamedTuple):
    inside: np.ndarray
    bits: int


def _terms(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for _, _, data, offsets in text_slices(batch.column(0)):
        found = find_words(data, offsets, ALPHANUMERIC)
        yield distinct_pairs(found.rows, found.hashes)[1]


def build_lexicon(documents: DataFrame, band: tuple[float, float] = BAND, bits: int = BITS) -> Lexicon:
    """One flag a counter: whether its terms are in the band."""
    texts = documents.select(documents["text"].cast("string").alias("text"))
    n = max(1, documents.count())
    low, high = band

    def inside(counts: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore"):
            idf = np.log(n / counts.astype(np.float64))
        return (idf >= low) & (idf <= high)

    return Lexicon(hashed_counts(texts, _terms, bits, inside, np.bool_), bits)


def fingerprints(texts: pa.Array, lexicon: Lexicon) -> np.ndarray:
    """[text, level * subset] 16-bit hashes; 0 where the text has no term in the subset."""
    out = np.zeros((len(texts), LEVELS, SUBSETS), np.uint16)
    for low, high, data, offsets in text_slices(texts):
        n = high - low
        found = find_words(data, offsets, ALPHANUMERIC)
        rows, terms = distinct_pairs(found.rows, found.hashes)
        inside = lexicon.inside[counter_of(terms, lexicon.bits)]
        some = np.zeros(n, bool)
        some[rows[inside]] = True
        kept = inside | ~some[rows]
        rows, terms = rows[kept], terms[kept]
        for s in range(SUBSETS):
            drawn = mix(terms ^ _SEEDS[s])
            member, of = drawn, rows
            for level in range(LEVELS):
                if level:
                    # the two top bits not used yet
                    held = member >> np.uint64(64 - 2 * level) == 0
                    member, of = member[held], of[held]
                if not len(of):
                    break
                starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
                sums = np.add.reduceat(mix(member), starts)
                out[low + of[starts], level, s] = (mix(sums) >> np.uint64(48)).astype(np.uint16) | np.uint16(1)
    return out.reshape(len(texts), LEVELS * SUBSETS)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each fingerprint of `a` to the one of `b` in the same place."""
    a, b = (x.reshape(-1, LEVELS, SUBSETS) for x in (a, b))
    either = ((a > 0) | (b > 0)).sum(2)
    equal = ((a > 0) & (a == b)).sum(2)
    filled = either * 3 >= SUBSETS
    level = np.where(filled.any(1), LEVELS - 1 - np.argmax(filled[:, ::-1], 1), 0)
    at = np.arange(len(a))
    return np.where(either[:, 0] == 0, 1.0, equal[at, level] / np.maximum(either[at, level], 1))


def _hex(prints: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes().hex() for row in np.ascontiguousarray(prints.astype(">u2"))], pa.string())


def fingerprint_documents(documents: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The documents with their `fingerprint`."""
    rows = documents.select(*[c for c in documents.columns if c != "fingerprint"]).withColumn("text", F.col("text").cast("string"))
    sent = documents.sparkSession.sparkContext.broadcast(lexicon)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = _hex(fingerprints(batch.column("text"), sent.value))
            yield pa.RecordBatch.from_arrays([*batch.columns, prints], [*batch.schema.names, "fingerprint"])

    return rows.mapInArrow(add, T.StructType([*rows.schema.fields, T.StructField("fingerprint", T.StringType())]))


_EDITED = ("doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, "
           "near_edited double, near_next double")
_WALKED = _EDITED + ", kind int, partition int, text string"


def edit(text: str, following: str) -> str:
    """The last quarter of the characters replaced by the first as many of the following text."""
    n = len(text) // 4
    return text[:len(text) - n] + following[:n]


def _rows(ids: list, texts: list[str], prints: np.ndarray, following: list[str], next_prints: np.ndarray, lexicon: Lexicon):
    """The finished columns of texts whose following texts are known."""
    edited = [edit(t, f) for t, f in zip(texts, following, strict=True)]
    edited_prints = fingerprints(pa.array(edited, pa.large_string()), lexicon)
    return {
        "doc_id": pa.array(ids, pa.int64()), "n_chars": pa.array([len(t) for t in texts], pa.int64()),
        "edited_sha256": pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
        "fingerprint": pa.array([p.tobytes() for p in prints], pa.binary()),
        "edited_fingerprint": pa.array([p.tobytes() for p in edited_prints], pa.binary()),
        "near_edited": pa.array(likeness(prints, edited_prints), pa.float64()),
        "near_next": pa.array(likeness(prints, next_prints), pa.float64()),
    }


def _walk(lexicon: Lexicon, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows with the one behind each; the first and last of the partition as kinds 1 and 2."""
    partition = TaskContext.get().partitionId()

    def end_row(kind: int, doc_id, text: str, prints: np.ndarray) -> pa.RecordBatch:
        none = pa.array([None], pa.string())
        return pa.RecordBatch.from_pydict({
            "doc_id": pa.array([doc_id], pa.int64()), "n_chars": pa.array([len(text)], pa.int64()), "edited_sha256": none,
            "fingerprint": pa.array([prints.tobytes()], pa.binary()), "edited_fingerprint": none.cast(pa.binary()),
            "near_edited": none.cast(pa.float64()), "near_next": none.cast(pa.float64()),
            "kind": pa.array([kind], pa.int32()), "partition": pa.array([partition], pa.int32()), "text": pa.array([text], pa.string())})

    last = None
    for batch in batches:
        for k in range(0, len(batch), 512):
            part = batch.slice(k, 512)
            ids, texts = part.column(0).to_pylist(), [t or "" for t in part.column(1).to_pylist()]
            prints = fingerprints(pa.array(texts, pa.large_string()), lexicon)
            if last is None:
                yield end_row(1, ids[0], texts[0], prints[0])
            else:
                ids, texts, prints = [last[0], *ids], [last[1], *texts], np.concatenate([last[2][None], prints])
            if len(ids) > 1:
                done = _rows(ids[:-1], texts[:-1], prints[:-1], texts[1:], prints[1:], lexicon)
                n = len(ids) - 1
                done |= {"kind": pa.array([0] * n, pa.int32()), "partition": pa.array([partition] * n, pa.int32()),
                         "text": pa.nulls(n, pa.string())}
                yield pa.RecordBatch.from_pydict(done)
            last = (ids[-1], texts[-1], prints[-1])
    if last is not None:
        yield end_row(2, *last)


def _finish(lexicon: Lexicon, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last row of each partition with the first of the next."""
    size = LEVELS * SUBSETS
    for batch in batches:
        ids, texts, prints, following, next_prints = (batch.column(i).to_pylist() for i in range(5))
        if ids:
            as_prints = [np.frombuffer(b"".join(p), np.uint16).reshape(-1, size) for p in (prints, next_prints)]
            yield pa.RecordBatch.from_pydict(_rows(ids, texts, as_prints[0], following, as_prints[1], lexicon))


def _shown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        for name in ("fingerprint", "edited_fingerprint"):
            found = np.frombuffer(b"".join(columns[name].to_pylist()), np.uint16).reshape(-1, LEVELS * SUBSETS)
            columns[name] = _hex(found)
        yield pa.RecordBatch.from_pydict(columns)


def with_neighbours(documents: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Every document's fingerprint, that of its edited text, and the likeness to it and to the next document.

    Texts are shuffled once, into ranges of ids; each task walks its range in order.
    What lies across two ranges, one row a range, is joined afterwards.
    """
    spark = documents.sparkSession
    sent = spark.sparkContext.broadcast(lexicon)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    walked = kept(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        lambda b: _walk(sent.value, b), _WALKED))
    # one number a range
    ranges = sorted(r[0] for r in walked.where("kind = 1").select("partition").collect())
    following = dict(zip(ranges, ranges[1:] + ranges[:1], strict=True))
    result = walked.where("kind = 0").drop("kind", "partition", "text")
    if ranges:
        after = spark.createDataFrame(list(following.items()), "partition int, following int")
        tails = walked.where("kind = 2").join(after, "partition").select(
            "doc_id", "text", "fingerprint", F.col("following").alias("partition"))
        heads = walked.where("kind = 1").select(
            "partition", F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint"))
        ends = tails.join(heads, "partition").select("doc_id", "text", "fingerprint", "next_text", "next_fingerprint")
        result = result.unionAll(ends.mapInArrow(lambda b: _finish(sent.value, b), _EDITED))
    return result.mapInArrow(_shown, _EDITED.replace("binary", "string"))
