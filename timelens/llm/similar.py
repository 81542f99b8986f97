"""What joins of sets by Jaccard similarity share: sets of a slice of texts, an order of
elements by rarity, prefixes, and exact verification of pairs.

Sets are named by a 64-bit digest of their elements, so that equal sets are one from
the start, however many documents hold them. Elements are ordered by how often the
corpus has them, as told by a table of fixed size, then by hash: any one order gives
the same results, and a rare-first order keeps what many texts share out of prefixes.
Two sets of a similarity of THRESHOLD or more share an element of their prefixes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timelens.llm.sketch import counter_of, hashed_counts, several_hits
from timelens.llm.store import kept
from timelens.llm.words import mix, text_slices

# similarity NUMERATOR / DENOMINATOR and up
NUMERATOR, DENOMINATOR = 3, 4
RARITY_BITS = 25
SHARED_BITS = 28
FLAG_BITS = 22
SET_BITS = 22  # of a sort key, for the set; the rest is the upper bits of the element
PIVOT_ROWS = 2000
"""Pairs of one first set that are verified together."""


class Sets(NamedTuple):
    """Sets of a slice of texts; elements are distinct in a set and ascend."""
    rows: np.ndarray     # of each set
    numbers: np.ndarray  # of each set in its row
    starts: np.ndarray   # bytes of each set's text in the slice
    ends: np.ndarray
    of: np.ndarray       # the set of each element
    elements: np.ndarray

    @property
    def sizes(self) -> np.ndarray:
        return np.bincount(self.of, minlength=len(self.rows))


ReadSets = Callable[[np.ndarray, np.ndarray], Sets]
# Of rows with a digest: (name, text) of all texts in question, and the rows with names in place of digests.
Fetch = Callable[[DataFrame], tuple[DataFrame, DataFrame]]


def distinct_elements(of: np.ndarray, elements: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct elements of each set, ascending within it.

    One sort by set and the upper bits of the element; by both in full where a slice has
    more sets than fit beside those bits, or elements that only differ below them.
    """
    def sorted_by(order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = of[order], elements[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        return a, b, new

    if not len(of) or int(of.max()) < 1 << SET_BITS:
        keys = of.astype(np.uint64) << np.uint64(64 - SET_BITS) | elements >> np.uint64(SET_BITS)
        order = np.argsort(keys)
        a, b, new = sorted_by(order)
        keys = keys[order]
        if not np.any(new[1:] & (keys[1:] == keys[:-1])):
            return a[new], b[new]
    a, b, new = sorted_by(np.lexsort((elements, of)))
    return a[new], b[new]


def digests(sets: Sets) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(sets.elements), dtype=np.uint64)])
    cuts = np.searchsorted(sets.of, np.arange(len(sets.rows) + 1))
    return mix(total[cuts[1:]] - total[cuts[:-1]] + np.diff(cuts).astype(np.uint64)).view(np.int64)


def _steps(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.round(8 * np.log2(counts.astype(np.float64) + 1)), 255).astype(np.uint8)


def rarity(texts: DataFrame, read: ReadSets, most_bits: int = RARITY_BITS, least_bits: int = 16) -> np.ndarray:
    """A byte for each counter: more for elements of more sets, 8 steps for twice as many.

    The table has about a counter for every 32 bytes of text, at least 2^least_bits and at most 2^most_bits; texts
    are not measured where these are one.
    """
    def elements(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, _, data, offsets in text_slices(batch.column(0)):
            yield read(data, offsets).elements

    bits = most_bits if least_bits >= most_bits else min(most_bits, max(least_bits, (text_bytes(texts) // 32).bit_length()))
    return hashed_counts(texts, elements, bits, _steps, np.uint8)


def text_bytes(texts: DataFrame) -> int:
    return int(texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])


def prefixes(sets: Sets, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set, element, position) of the elements a similar set must share one of, rarest first."""
    bits = len(ranks).bit_length() - 1
    order = np.argsort(sets.of << 8 | ranks[counter_of(sets.elements, bits)], kind="stable")
    of, elements = sets.of[order], sets.elements[order]
    cuts = np.searchsorted(of, np.arange(len(sets.rows)))
    place = np.arange(len(of)) - cuts[of]
    sizes = sets.sizes
    long = sizes - -(-sizes * NUMERATOR // DENOMINATOR) + 1
    early = place < long[of]
    return of[early], elements[early], place[early]


def in_slice_once(digest: np.ndarray) -> np.ndarray:
    """One of the sets of each digest."""
    _, first = np.unique(digest, return_index=True)
    once = np.zeros(len(digest), bool)
    once[first] = True
    return once


def shared_prefixes(texts: DataFrame, read: ReadSets, ranks: Broadcast, most_bits: int = SHARED_BITS) -> np.ndarray:
    """A bit for each counter of `several_hits`: whether prefixes hit it more than once.

    A prefix element whose bit is not set is in the prefix of one set alone and makes no
    pair. Its counter is that of `mix(element)`: prefixes prefer small hashes. The table has
    about a counter for every 6 bytes of text, at most 2^most_bits; beyond that elements of
    one set pass too, which changes no pair.
    """
    def hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, _, data, offsets in text_slices(batch.column(0)):
            sets = read(data, offsets)
            of, elements, _ = prefixes(sets, ranks.value)
            yield mix(elements[in_slice_once(digests(sets))[of]])

    bits = min(most_bits, max(16, (text_bytes(texts) // 6).bit_length()))
    return several_hits(texts, hashes, bits)


def _first_column(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    yield batch.column(0).to_numpy()


def flags(rows: DataFrame, bits: int = FLAG_BITS, ids_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]] = _first_column) -> np.ndarray:
    """One flag a counter: whether one of the ids (one column of longs, or `ids_of` batches of rows) falls on it.

    `ids_of` runs in the tasks that count, so that they need no second Python worker beside them.
    """
    def hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for ids in ids_of(batch):
            yield mix(ids.view(np.uint64))

    return hashed_counts(rows, hashes, bits, lambda counts: counts > 0, np.bool_)


def flagged(ids: np.ndarray, held: np.ndarray) -> np.ndarray:
    return held[counter_of(mix(ids.view(np.uint64)), len(held).bit_length() - 1)]


def texts_by_place(names_of: Callable[[Broadcast], DataFrame], texts_of: Callable[[Broadcast], DataFrame]) -> Fetch:
    """Fetches the texts of sets from one place each.

    Of flagged digests `names_of` has (digest, name) of all their places, of flagged names `texts_of` has (name, text).
    """
    def fetch(asked: DataFrame) -> tuple[DataFrame, DataFrame]:
        context = asked.sparkSession.sparkContext
        names = names_of(context.broadcast(flags(asked.select("digest")))).groupBy("digest").agg(F.min("name").alias("name"))
        asked = kept(asked.join(names, "digest").drop("digest"))
        return texts_of(context.broadcast(flags(asked.select("name")))), asked

    return fetch


def _named(held: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        mine = np.flatnonzero(flagged(batch.column(0).to_numpy(), held))
        if len(mine):
            yield batch.take(pa.array(mine))


def texts_by_name(texts: DataFrame, names: DataFrame) -> Fetch:
    """Fetches texts by their own hash; `texts` has name and text, `names` a name for each digest."""
    def fetch(asked: DataFrame) -> tuple[DataFrame, DataFrame]:
        asked = kept(asked.join(names, "digest").drop("digest"))
        sent = texts.sparkSession.sparkContext.broadcast(flags(asked.select("name")))
        return texts.mapInArrow(lambda batches: _named(sent.value, batches), "name long, text string"), asked

    return fetch


def _verify(read: ReadSets, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by first set, its own text first, then those to compare with it; a row may repeat."""
    first, pivot, last = None, np.zeros(0, np.uint64), None
    for batch in batches:
        a_ids, b_ids, shared, unions = [], [], [], []
        for low, high, data, offsets in text_slices(batch.column(3)):
            sets = read(data, offsets)
            cuts = np.searchsorted(sets.rows[sets.of], np.arange(high - low + 1))
            b, salt, of = (batch.column(i).slice(low, high - low) for i in range(3))
            b, salt, own = b.to_numpy(), salt.to_numpy(), of.is_null().to_numpy(zero_copy_only=False)
            of = of.fill_null(0).to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], (b[1:] != b[:-1]) | (salt[1:] != salt[:-1])]))
            for start, stop in zip(starts.tolist(), [*starts[1:].tolist(), high - low], strict=True):
                here = (b[start], salt[start])
                if own[start]:
                    first, pivot, last = here, sets.elements[cuts[start]:cuts[start + 1]], None
                rows = np.arange(start, stop)[~own[start:stop]]
                if not len(rows) or first != here:
                    continue
                elements = sets.elements[cuts[rows[0]]:cuts[stop]]
                sizes = np.diff(cuts[rows[0]:stop + 1])
                at = np.minimum(np.searchsorted(pivot, elements), len(pivot) - 1)
                both = np.bincount(np.repeat(np.arange(len(rows)), sizes), pivot[at] == elements, len(rows)).astype(np.int64)
                new = np.ones(len(rows), bool)
                new[1:] = of[rows[1:]] != of[rows[:-1]]
                new[0] = of[rows[0]] != last
                last = of[rows[-1]]
                a_ids.append(of[rows][new])
                b_ids.append(np.full(int(new.sum()), here[0]))
                shared.append(both[new])
                unions.append((len(pivot) + sizes - both)[new])
        if a_ids:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x).astype(np.int64)) for x in (a_ids, b_ids, shared, unions)], ["a", "b", "shared", "joined"])


def verify(pairs: DataFrame, fetch: Fetch, read: ReadSets) -> DataFrame:
    """a, b, shared, joined: sizes of the intersection and union of the sets of each pair (a, b).

    `pairs` are distinct. Texts of the sets in question are read anew and sent, once
    for each pair, to where the pairs of their `b` are; a frequent `b` is split.
    """
    counted = pairs.groupBy("b").agg(F.ceil(F.count("*") / PIVOT_ROWS).cast("int").alias("salts"))
    asked = (pairs.join(counted, "b")
             .select(F.col("a").alias("digest"), "b", F.pmod(F.xxhash64("a"), "salts").cast("int").alias("salt"), F.col("a").alias("of"))
             .unionAll(counted.select(F.col("b").alias("digest"), "b", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"),
                                      F.lit(None).cast("long").alias("of"))))
    found, asked = fetch(asked)
    return (found.join(asked, "name").select("b", "salt", "of", "text")
            .repartition("b", "salt").sortWithinPartitions("b", "salt", F.col("of").asc_nulls_first())
            .mapInArrow(lambda batches: _verify(read, batches), "a long, b long, shared long, joined long"))


def similar() -> F.Column:
    return F.col("shared") * DENOMINATOR >= F.col("joined") * NUMERATOR


def may_be_similar(n: Column, m: Column, differ: Column) -> Column:
    """Whether sets of sizes n and m that differ in `differ` elements at least can be similar."""
    return ((F.least(n, m) * DENOMINATOR >= F.greatest(n, m) * NUMERATOR)
            & ((n + m) * (DENOMINATOR - NUMERATOR) >= differ * (DENOMINATOR + NUMERATOR)))
