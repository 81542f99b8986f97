"""Line dedup by an exact set-similarity join of the lines of all documents.

A line's tokens are its distinct words. Two lines match at a Jaccard similarity of
0.75 or more; a line goes if an earlier one, kept or not, matches it. Earlier means by
document id, then by line number (then, for lines of documents with the same id, by
a hash). Lines of any length take part; only those without words stay as they are.

Lines of equal tokens are one set, which stays at its first place. Sets are joined by
prefixes: tokens are ordered by rarity, and matching sets share one of their rarest
quarter and one. Sets that meet at a token pass the length filter, the positional
filter (tokens behind the shared one must still allow the overlap) and a filter on
parity bits of the sets (each token in one set alone changes one bit at most; long sets
have more bits). Of the earlier sets that pass, every set keeps the KEPT most alike of those
that by their bits look sure to match, or SPARE if none does, and these pairs are verified
on the texts, which are read at one place each. A set whose kept pairs all fail, and that
had more, gets all its pairs verified in a second pass: up to LISTED such sets meet the
lines of every slice, as the first pass kept them, by the filters on sizes and parity bits;
more of them meet by their tokens again. So a group of similar lines costs some pairs a
line, and no pair that could decide is left out.

A passage's many copies are one set; what is sent of it is once a slice of documents
and token. The sets at a frequent token are compared in blocks, earliest first, and
leave as soon as they have their pairs.

Defined results: a NULL text has no lines, an empty one a single empty line. A NULL
id comes first. Rows that repeat (same id, same text) are treated alike: what stays
in one stays in the other. Words are runs of anything but ASCII white space, A-Z
lowered. Lines end at \\n only.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timelens.llm.similar import (
    DENOMINATOR, NUMERATOR, Fetch, Sets, digests, distinct_elements, flagged, flags, prefixes, rarity, similar, texts_by_place, verify,
)
from timelens.llm.store import kept
from timelens.llm.words import NON_SPACE, find_words, mix, text_slices

LEAST_WORDS = 1
RARITY_BITS = 22
KEPT = 2
SPARE = 96
"""Pairs of a set of which none looks sure to match."""
LISTED = 512
"""Sets left unsure up to which the second pass reads no documents."""
HELD = 1 << 18
"""Postings a task holds before it hands them on."""

SURE, MOST_UNLIKE = 24, 127
"""Steps up to which a pair looks sure to match, and the last step; the fewer, the earlier it is verified."""

CROWD = 256
"""Sets at a token from which on they are compared in blocks."""
PAIRS = 1 << 18
"""Pairs filtered at once."""

WIDTHS, WIDE_FROM = (1, 2, 4), (64, 100)
"""Words of parity bits of sets, and the tokens from which on sets have the second and third number of them."""
WIDE = WIDTHS[-1]

NO_ID = np.iinfo(np.int64).min


def line_starts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, first byte) of every line of every row."""
    ends = np.flatnonzero(data == 10)
    rows = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, ends, "right") - 1])
    starts = np.concatenate([offsets[:-1], ends + 1])
    order = np.lexsort((starts, rows))
    return rows[order], starts[order]


def line_sets(data: np.ndarray, offsets: np.ndarray) -> Sets:
    """The token sets of the lines that have words."""
    found = find_words(data, offsets, NON_SPACE)
    rows, starts = line_starts(data, offsets)
    # of lines that begin at one place, the last is the one with words
    line = np.repeat(np.arange(len(starts)), np.diff(np.append(np.searchsorted(found.starts, starts), len(found.starts))))
    of, elements = distinct_elements(line, found.hashes)
    sizes = np.bincount(of, minlength=len(rows))
    filled = np.flatnonzero(sizes >= LEAST_WORDS)
    place = np.full(len(rows), -1)
    place[filled] = np.arange(len(filled))
    firsts = np.searchsorted(rows, np.arange(len(offsets) - 1))
    ends = np.append(starts[1:], len(data))
    last = np.append(rows[1:] != rows[:-1], True) if len(rows) else np.zeros(0, bool)
    ends = np.where(last, offsets[1:][rows], ends - 1)
    return Sets(rows[filled], filled - firsts[rows[filled]], starts[filled], ends[filled], place[of], elements)


def _words(data: np.ndarray, offsets: np.ndarray) -> Sets:
    """All words as the elements of one set, repeated ones too: enough to tell rare tokens from frequent ones."""
    found = find_words(data, offsets, NON_SPACE)
    none = np.zeros(0, np.int64)
    return Sets(none, none, none, none, none, found.hashes)


def parities(sets: Sets) -> tuple[np.ndarray, np.ndarray]:
    """Parity bits of the sets, WIDE words each, and how many of the words count.

    Of 64 * WIDE bits, each is the parity of the set's tokens that fall on it. Small sets have
    them folded to fewer words, the others 0; a fold of bits is the parity of both's tokens.
    """
    bit, width = mix(sets.elements), widths(sets.sizes)
    words = np.empty((len(width), WIDE), np.uint64)
    if not len(width):
        return words, width
    starts = np.searchsorted(sets.of, np.arange(len(width)))  # no set is empty
    one = np.uint64(1) << (bit & np.uint64(63))
    of = (bit >> np.uint64(6)).astype(np.uint8) & np.uint8(WIDE - 1)
    for w in range(WIDE):
        words[:, w] = np.bitwise_xor.reduceat(one * (of == w), starts)
    for size in WIDTHS[:-1]:
        small = np.flatnonzero(width == size)
        for w in range(size, WIDE):
            words[small, w % size] ^= words[small, w]
        words[small, size:] = 0
    return words, width


def widths(sizes: np.ndarray) -> np.ndarray:
    """Words of parity bits by the size of a set: the more tokens may differ, the more bits tell."""
    return np.array(WIDTHS)[np.searchsorted(WIDE_FROM, sizes, "right")]


_PACKED = ("bucket int, kind int, ids array<long>, row_keys binary, n_lines binary, rows binary, numbers binary, digests binary, "
           "keys binary, sizes binary, places binary, bits binary, docs binary")
_TYPES = {"bucket": pa.int32(), "kind": pa.int32(), "ids": pa.list_(pa.int64())}
_NAMES = [x.split()[0] for x in _PACKED.split(", ")]


def _packed(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({n: pa.array([r.get(n) for r in rows], _TYPES.get(n, pa.binary())) for n in _NAMES})


def _by_bucket(held: list[tuple[np.ndarray, ...]], bucket_bits: int) -> Iterator[pa.RecordBatch]:
    if not held:
        return
    elements, *columns, words = [np.concatenate(x) for x in zip(*held, strict=True)]
    # prefixes prefer small hashes, so buckets take another one; tokens of a bucket go by its next 32 bits, and
    # tokens that share these meet more sets than they need
    mixed = mix(elements)
    bucket = (mixed >> np.uint64(64 - bucket_bits)).astype(np.min_scalar_type((1 << bucket_bits) - 1))
    order = np.argsort(bucket, kind="stable")
    cuts = np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=1 << bucket_bits))])
    columns = [(mixed << np.uint64(bucket_bits) >> np.uint64(32)).astype(np.uint32), *columns]
    columns = [c[order] for c in columns]
    words, width = words[order], widths(columns[2])
    counted = np.arange(WIDE) < width[:, None]
    names = ("keys", "digests", "sizes", "places", "docs", "numbers")
    rows = [{"bucket": b, "kind": 1, "bits": words[cuts[b]:cuts[b + 1]][counted[cuts[b]:cuts[b + 1]]].tobytes()}
            | {n: c[cuts[b]:cuts[b + 1]].tobytes() for n, c in zip(names, columns, strict=True)}
            for b in np.flatnonzero(np.diff(cuts)).tolist()]
    if rows:
        yield _packed(rows)


def _send(ranks: np.ndarray, bucket_bits: int, tokens: np.ndarray | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of each slice (kind 0, first pass only) and prefix tokens by bucket (kind 1)."""
    for batch in batches:
        ids, keys = batch.column(0), batch.column(1).to_numpy()
        order_ids = ids.fill_null(int(NO_ID)).to_numpy()
        held: list[tuple[np.ndarray, ...]] = []
        for low, high, data, offsets in text_slices(batch.column(2)):
            if sum(len(h[0]) for h in held) > HELD:
                yield from _by_bucket(held, bucket_bits)
                held = []
            sets = line_sets(data, offsets)
            digest, sizes, (bits, width) = digests(sets), sets.sizes, parities(sets)
            if tokens is None:
                present = batch.column(2).slice(low, high - low).is_valid().to_numpy(zero_copy_only=False)
                n_lines = np.bincount(line_starts(data, offsets)[0], minlength=high - low) * present
                yield _packed([{
                    "bucket": int(mix(keys[low:low + 1].view(np.uint64))[0]) & (1 << bucket_bits) - 1, "kind": 0,
                    "ids": ids.slice(low, high - low).to_pylist(), "row_keys": keys[low:high].tobytes(),
                    "n_lines": n_lines.astype(np.int64).tobytes(), "rows": sets.rows.astype(np.uint32).tobytes(),
                    "numbers": sets.numbers.astype(np.uint32).tobytes(), "digests": digest.tobytes(),
                    "sizes": sizes.astype(np.uint32).tobytes(), "bits": bits[np.arange(WIDE) < width[:, None]].tobytes()}])
            docs, numbers = order_ids[low:high][sets.rows], sets.numbers
            of, elements, places = prefixes(sets, ranks)
            order = np.lexsort((numbers, docs, digest))
            first = order[np.concatenate([[True], digest[order][1:] != digest[order][:-1]])] if len(order) else order
            once = np.zeros(len(digest), bool)
            once[first] = True
            mine = once[of]
            if tokens is not None:
                mine &= flagged(elements.view(np.int64), tokens)
            of = of[mine]
            held.append((elements[mine], digest[of], sizes[of].astype(np.uint32), places[mine].astype(np.uint32),
                         docs[of], numbers[of].astype(np.uint32), bits[of]))
        yield from _by_bucket(held, bucket_bits)


class _Meeting:
    """Sets at tokens, ordered by (token, size), with all that the filters need."""

    def __init__(self, columns: list[np.ndarray]):
        keys, digest, sizes, places, bits, docs, numbers = columns
        # each set once a token, at its first place
        joint = mix(keys) + digest.view(np.uint64)
        order = np.argsort(joint)
        alike = joint[order][1:] == joint[order][:-1]
        if (alike & ((keys[order][1:] != keys[order][:-1]) | (digest[order][1:] != digest[order][:-1]))).any():
            order = np.lexsort((digest, keys))
        again = (keys[order][1:] == keys[order][:-1]) & (digest[order][1:] == digest[order][:-1])
        if again.any():
            some = np.concatenate([again, [False]]) | np.concatenate([[False], again])
            mine = order[some]
            run = np.cumsum(np.concatenate([[0], ~again]))[some]
            order[some] = mine[np.lexsort((numbers[mine], docs[mine], run))]
        order = order[np.concatenate([[True], ~again])] if len(order) else order
        _, group = np.unique(keys[order], return_inverse=True)
        # by (token, size)
        order = order[np.argsort(group << 32 | sizes[order].astype(np.int64), kind="stable")]
        self.keys, self.digest = keys[order], digest[order]
        self.sizes, self.places = sizes[order].astype(np.int64), places[order].astype(np.int64)
        self.small = self.sizes.astype(np.int32)
        self.docs, self.numbers = docs[order], numbers[order]
        self.words = bits.reshape(len(bits), -1)[order] if len(order) else bits.reshape(0, WIDE)
        self.width = np.minimum(widths(self.sizes), self.words.shape[1])
        self.bits = np.bitwise_xor.reduce(self.words, axis=1)
        self.starts = np.flatnonzero(np.concatenate([[True], self.keys[1:] != self.keys[:-1]])) if len(order) else np.zeros(0, np.int64)
        self.ends = np.append(self.starts[1:], len(order))

    @cached_property
    def rank(self) -> np.ndarray:
        """Of all entries, by place."""
        rank = np.empty(len(self.keys), np.int64)
        rank[self.order(np.arange(len(rank)))] = np.arange(len(rank))
        return rank

    def order(self, rows: np.ndarray, *above: np.ndarray) -> np.ndarray:
        """What sorts rows by place, within what is `above` (the last counts first)."""
        return np.lexsort((self.digest[rows], self.numbers[rows], self.docs[rows], *above))

    def before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether i is at an earlier place than j."""
        return (self.docs[i] < self.docs[j]) | (self.docs[i] == self.docs[j]) & (
            (self.numbers[i] < self.numbers[j]) | (self.numbers[i] == self.numbers[j]) & (self.digest[i] < self.digest[j]))

    def passing(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        # most pairs fail by one word of parity bits; the other filters are for those that are left
        total = self.small[i] + self.small[j]
        may = total - 2 * ((NUMERATOR * total + NUMERATOR + DENOMINATOR - 1) // (NUMERATOR + DENOMINATOR))
        left = np.flatnonzero(np.bitwise_count(self.bits[i] ^ self.bits[j]) <= may)
        y, x, may = i[left], j[left], may[left]
        least, most = np.minimum(self.sizes[y], self.sizes[x]), np.maximum(self.sizes[y], self.sizes[x])
        behind = np.minimum(self.sizes[y] - self.places[y], self.sizes[x] - self.places[x])
        fits = np.flatnonzero((least * DENOMINATOR >= most * NUMERATOR) & (2 * behind >= least + most - may))
        differ, _ = self.differ(y[fits], x[fits])
        good = np.zeros(len(i), bool)
        good[left[fits[differ <= may[fits]]]] = True
        return good

    def differ(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """In how many parity bits sets differ, folded to what both have, and how many bits these are."""
        shared = np.minimum(self.width[i], self.width[j])
        differ = np.bitwise_count(self.bits[i] ^ self.bits[j]).astype(np.int64)
        for size in WIDTHS[1:]:
            wide = np.flatnonzero(shared == size)
            if not len(wide):
                continue
            changed = self.words[i[wide]] ^ self.words[j[wide]]
            counts = np.zeros(len(wide), np.int64)
            for w in range(size):
                folded = changed[:, w].copy()
                for other in range(w + size, changed.shape[1], size):
                    folded ^= changed[:, other]
                counts += np.bitwise_count(folded)
            differ[wide] = counts
        return differ, 64 * shared

    def unlike(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How unlike pairs are that pass, by their parity bits: SURE steps for half the tokens they may differ in."""
        differ, bits = self.differ(i, j)
        total = self.sizes[i] + self.sizes[j]
        estimate = -bits / 2 * np.log(np.maximum(1 - 2 * differ / bits, 1e-9))
        may = total + 2 * (-NUMERATOR * total // (NUMERATOR + DENOMINATOR))
        return np.minimum(np.ceil(SURE * 2 * estimate / np.maximum(may, 0.5)), MOST_UNLIKE).astype(np.int64)

    def likely(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether pairs that pass look sure to match: by their parity bits they differ in half the tokens they may, at most."""
        return self.unlike(i, j) <= SURE

    def pairs(self, wanted: np.ndarray | None, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(later, earlier) of pairs that pass; of crowded tokens the first `least` and one more of each set,
        or SPARE and one more where none is likely.

        With `wanted`, all pairs whose later set is wanted.
        """
        if wanted is not None:
            yield from self._of_wanted(wanted)
            return
        crowd = self.ends - self.starts > CROWD
        for a, b in zip(self.starts[crowd].tolist(), self.ends[crowd].tolist(), strict=True):
            yield from self._blocks(np.arange(a, b)[self.order(np.arange(a, b))], least)
        group = np.repeat(np.arange(len(self.starts)), self.ends - self.starts)
        mine = np.flatnonzero(~crowd[group]) if len(group) else group
        # partners behind i: larger sets within the length filter
        joint = group << 32 | self.sizes
        stop = np.searchsorted(joint, group[mine] << 32 | self.sizes[mine] * DENOMINATOR // NUMERATOR, "right")
        count = np.maximum(stop - mine - 1, 0)
        total = np.cumsum(count)
        low = 0
        while low < len(mine):
            high = max(low + 1, int(np.searchsorted(total, (total[low - 1] if low else 0) + PAIRS, "right")))
            n = count[low:high]
            i = np.repeat(mine[low:high], n)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
            good = self.passing(i, j)
            i, j = i[good], j[good]
            swap = self.before(i, j)
            yield np.where(swap, j, i), np.where(swap, i, j)
            low = high

    def _of_wanted(self, wanted: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        group = np.repeat(np.arange(len(self.starts)), self.ends - self.starts)
        mine = np.flatnonzero(flagged(self.digest, wanted)) if len(group) else group
        # partners on both sides, within the length filter
        joint = group << 32 | self.sizes
        base = group[mine] << 32
        start = np.searchsorted(joint, base | -(-self.sizes[mine] * NUMERATOR // DENOMINATOR), "left")
        count = np.searchsorted(joint, base | self.sizes[mine] * DENOMINATOR // NUMERATOR, "right") - start
        total = np.cumsum(count)
        low = 0
        while low < len(mine):
            high = max(low + 1, int(np.searchsorted(total, (total[low - 1] if low else 0) + PAIRS, "right")))
            n = count[low:high]
            i = np.repeat(mine[low:high], n)
            j = np.arange(len(i)) + np.repeat(start[low:high] - (np.cumsum(n) - n), n)
            good = self.passing(i, j)
            i, j = i[good], j[good]
            good = self.rank[j] < self.rank[i]
            yield i[good], j[good]
            low = high

    def _blocks(self, group: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        going, found, sure = np.arange(1, len(group)), np.zeros(len(group), np.int64), np.zeros(len(group), bool)
        low, size = 0, 32
        while low < len(group) - 1 and len(going):
            high = min(len(group), low + size)
            for part in range(0, len(going), max(1, PAIRS // size)):
                some = going[part:part + max(1, PAIRS // size)]
                y, x = np.repeat(some, high - low), np.tile(np.arange(low, high), len(some))
                y, x = y[x < y], x[x < y]
                good = self.passing(group[y], group[x])
                y, x = y[good], x[good]
                found += np.bincount(y, minlength=len(group))
                sure[y[self.likely(group[y], group[x])]] = True
                yield group[y], group[x]
            going = going[(found[going] <= np.where(sure[going], least, max(least, SPARE))) & (going > high)]
            low, size = high, min(size * 2, 512)


def _counted_words(sizes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Parity bits of which only the words that count were sent."""
    counted = np.arange(WIDE) < widths(sizes)[:, None]
    words = np.zeros(counted.shape, np.uint64)
    words[counted] = bits
    return words


def _read_postings(rows: list[list]) -> list[np.ndarray]:
    """Keys (bucket and token), digests, sizes, places, words of parity bits, documents and lines of packed postings
    of tokens that several have."""
    types = (np.uint32, np.int64, np.uint32, np.uint32, np.uint64, np.int64, np.uint32)
    buckets, *packed = zip(*rows, strict=True)
    keys, digest, sizes, places, bits, docs, numbers = (
        np.concatenate([np.frombuffer(b, t) for b in c]) for c, t in zip(packed, types, strict=True))
    of = np.repeat(np.array(buckets, np.uint64), [b.size // 4 for b in packed[0]])
    words = _counted_words(sizes, bits)
    keys = of << np.uint64(32) | keys
    # a set alone at a token meets none
    order = np.argsort(keys)
    again = keys[order][1:] == keys[order][:-1]
    several = order[np.concatenate([again, [False]]) | np.concatenate([[False], again])] if len(order) else order
    return [c[several] for c in (keys, digest, sizes, places, words, docs, numbers)]


def _packed_pairs(met: _Meeting, later: np.ndarray, earlier: np.ndarray, more: np.ndarray) -> Iterator[pa.RecordBatch]:
    y, x = met.digest[later], met.digest[earlier]
    marks = np.isin(y, more) | met.unlike(later, earlier) << 1
    for low in range(0, len(y), 1 << 16):
        part = slice(low, low + (1 << 16))
        yield _packed([{"bucket": 0, "kind": 2, "digests": y[part].tobytes(), "keys": x[part].tobytes(),
                        "bits": marks[part].astype(np.uint8).tobytes(), "docs": met.docs[earlier][part].tobytes(),
                        "numbers": met.numbers[earlier][part].astype(np.int64).tobytes()}])


def _meet(wanted: np.ndarray | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate pairs (kind 2) as sets' digests: y in `digests`, x in `keys`; in `bits` whether y had more (1), and twice how unlike the pair is."""
    rows = []
    for batch in batches:
        kinds = batch.column(1).to_numpy()
        passing = np.flatnonzero(kinds == 0)
        if len(passing):
            yield batch.take(pa.array(passing))
        for i in np.flatnonzero(kinds == 1).tolist():
            rows.append([batch.column(0)[i].as_py(), *(
                batch.column(_NAMES.index(n))[i].as_buffer() for n in ("keys", "digests", "sizes", "places", "bits", "docs", "numbers"))])
    if not rows:
        return
    met = _Meeting(_read_postings(rows))
    rows.clear()
    more = np.zeros(0, np.int64)

    def reduced(later: np.ndarray, earlier: np.ndarray, more: np.ndarray):
        """Distinct pairs, of each later set the first ones; `more` gets the sets that lose some."""
        y, x = met.digest[later], met.digest[earlier]
        order = np.lexsort((x, y))
        later, earlier, y, x = later[order], earlier[order], y[order], x[order]
        new = np.ones(len(y), bool)
        new[1:] = (y[1:] != y[:-1]) | (x[1:] != x[:-1])
        later, earlier, y = later[new], earlier[new], y[new]
        if wanted is None:
            unlike = met.unlike(later, earlier)
            order = met.order(earlier, unlike, y)
            later, earlier, y, unlike = later[order], earlier[order], y[order], unlike[order]
            first = np.searchsorted(y, y)
            mine = np.arange(len(y)) - first < np.where(unlike[first] > SURE, max(KEPT, SPARE), KEPT)
            more = np.unique(np.concatenate([more, y[~mine]]))
            later, earlier = later[mine], earlier[mine]
        return later, earlier, more

    none = np.zeros(0, np.int64)
    waiting, size = [(none, none)], 0
    for later, earlier in met.pairs(wanted, KEPT):
        waiting.append((later, earlier))
        size += len(later)
        if size > 2 * PAIRS:
            later, earlier, more = reduced(*(np.concatenate(c) for c in zip(*waiting, strict=True)), more)
            if wanted is not None:
                # all pairs go on, so none has to wait
                yield from _packed_pairs(met, later, earlier, more)
                later, earlier = none, none
            waiting, size = [(later, earlier)], len(later)
    later, earlier, more = reduced(*(np.concatenate(c) for c in zip(*waiting, strict=True)), more)
    yield from _packed_pairs(met, later, earlier, more)


_LINE_COLUMNS = ("ids", "rows", "numbers", "digests", "sizes", "bits")


def _line_columns(batch: pa.RecordBatch) -> Iterator[list[np.ndarray]]:
    """Digests, sizes, words of parity bits, documents and lines of the sets of each slice; columns as in _LINE_COLUMNS."""
    for ids, rows, numbers, digest, sizes, bits in zip(*(batch.column(i) for i in range(6)), strict=True):
        docs = ids.values.fill_null(int(NO_ID)).to_numpy()[np.frombuffer(rows.as_buffer(), np.uint32)]
        held = np.frombuffer(sizes.as_buffer(), np.uint32)
        yield [np.frombuffer(digest.as_buffer(), np.int64), held, _counted_words(held, np.frombuffer(bits.as_buffer(), np.uint64)),
               docs, np.frombuffer(numbers.as_buffer(), np.uint32)]


def _listed(wanted: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All that the filters need of the wanted sets."""
    for batch in batches:
        for digest, sizes, words, docs, numbers in _line_columns(batch):
            mine = np.flatnonzero(flagged(digest, wanted))
            if len(mine):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(digest[mine]), pa.array(docs[mine]), pa.array(numbers[mine].astype(np.int64)),
                     pa.array(sizes[mine].astype(np.int64)), pa.array([w.tobytes() for w in words[mine]], pa.binary())],
                    ["digest", "doc", "number", "size", "bits"])


def _beside(wanted: np.ndarray, few: list[np.ndarray], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate pairs (kind 2) of `few` wanted sets, columns as of a slice, and all earlier ones of the lines of every slice."""
    for batch in batches:
        for columns in _line_columns(batch):
            digest, sizes, words, docs, numbers = (np.concatenate(c) for c in zip(columns, few, strict=True))
            met = _Meeting([np.zeros(len(digest), np.uint64), digest, sizes, np.zeros(len(digest), np.uint32), words, docs, numbers])
            for later, earlier in met.pairs(wanted, KEPT):
                yield from _packed_pairs(met, later, earlier, np.zeros(0, np.int64))


def _line_names(keys: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """A name for each line of a row with a key."""
    return mix(mix(keys.view(np.uint64)) + numbers.astype(np.uint64)).view(np.int64)


def _names_of(held: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The names of the lines whose sets are flagged."""
    for batch in batches:
        for keys, rows, numbers, digest in zip(*(batch.column(i) for i in range(4)), strict=True):
            ids = np.frombuffer(digest.as_buffer(), np.int64)
            mine = np.flatnonzero(flagged(ids, held))
            if len(mine):
                of = np.frombuffer(keys.as_buffer(), np.int64)[np.frombuffer(rows.as_buffer(), np.uint32)[mine]]
                names = _line_names(of, np.frombuffer(numbers.as_buffer(), np.uint32)[mine])
                yield pa.RecordBatch.from_arrays([pa.array(ids[mine]), pa.array(names)], ["digest", "name"])


def _lines_named(held: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines whose names are flagged."""
    for batch in batches:
        keys = batch.column(0).to_numpy()
        for low, high, data, offsets in text_slices(batch.column(1)):
            rows, starts = line_starts(data, offsets)
            firsts = np.searchsorted(rows, np.arange(high - low))
            names = _line_names(keys[low:high][rows], np.arange(len(rows)) - firsts[rows])
            mine = np.flatnonzero(flagged(names, held))
            if len(mine):
                last = np.append(rows[1:] != rows[:-1], True)
                ends = np.where(last, offsets[1:][rows], np.append(starts[1:], 0) - 1)
                texts = [data[a:b].tobytes().decode() for a, b in zip(starts[mine], ends[mine], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(names[mine]), pa.array(texts, pa.string())], ["name", "text"])


def line_texts(rows: DataFrame, packed: DataFrame) -> Fetch:
    """Fetches the texts of sets from one line each, as `packed` tells of the lines of `rows`; no words are looked for."""
    def names_of(held: Broadcast) -> DataFrame:
        return packed.where("kind = 0").select("row_keys", "rows", "numbers", "digests").mapInArrow(
            lambda batches: _names_of(held.value, batches), "digest long, name long")

    def texts_of(held: Broadcast) -> DataFrame:
        return rows.select("row_key", "text").mapInArrow(lambda batches: _lines_named(held.value, batches), "name long, text string")

    return texts_by_place(names_of, texts_of)


def _unpack_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for y, x, more, doc, number in zip(*(batch.column(i) for i in range(5)), strict=True):
            ids = [pa.array(np.frombuffer(c.as_buffer(), np.int64)) for c in (y, x, doc, number)]
            marks = np.frombuffer(more.as_buffer(), np.uint8)
            yield pa.RecordBatch.from_arrays([*ids, pa.array((marks & 1).astype(bool)), pa.array((marks >> 1).astype(np.int32))],
                                             ["y", "x", "doc", "number", "more", "unlike"])


def _unpack_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, keys, rows, numbers, digest in zip(*(batch.column(i) for i in range(5)), strict=True):
            of = np.frombuffer(rows.as_buffer(), np.uint32).astype(np.int64)
            row_keys = np.frombuffer(keys.as_buffer(), np.int64)
            yield pa.RecordBatch.from_arrays(
                [ids.values.take(pa.array(of)), pa.array(row_keys[of]), pa.array(np.frombuffer(numbers.as_buffer(), np.uint32).astype(np.int64)),
                 pa.array(np.frombuffer(digest.as_buffer(), np.int64))], ["doc_id", "row_key", "number", "digest"])


def _unpack_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, keys, n_lines in zip(*(batch.column(i) for i in range(3)), strict=True):
            yield pa.RecordBatch.from_arrays(
                [ids.values, pa.array(np.frombuffer(keys.as_buffer(), np.int64)), pa.array(np.frombuffer(n_lines.as_buffer(), np.int64))],
                ["doc_id", "row_key", "n_lines"])


def _prefix_tokens(ranks: np.ndarray, wanted: np.ndarray, batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """Prefix tokens of the wanted sets."""
    for _, _, data, offsets in text_slices(batch.column(0)):
        sets = line_sets(data, offsets)
        mine = flagged(digests(sets), wanted)
        of, elements, _ = prefixes(sets, ranks)
        yield np.unique(elements[mine[of]]).view(np.int64)


def _row_key() -> F.Column:
    return F.xxhash64("doc_id", "text", F.lit(2))


def find_repeats(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, row_key, n_lines) of all rows, and (row_key, removed): the sorted numbers of lines that go, from 0."""
    spark = documents.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bucket_bits = max(4, (8 * tasks - 1).bit_length())  # several a task, so that tasks are even
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.select("doc_id", _row_key().alias("row_key"), "text")
    texts = rows.select("text")
    ranks = spark.sparkContext.broadcast(rarity(texts, _words, RARITY_BITS, RARITY_BITS))

    def met(tokens: np.ndarray | None, wanted: np.ndarray | None) -> DataFrame:
        both = spark.sparkContext.broadcast((tokens, wanted))
        return kept(rows.mapInArrow(lambda b: _send(ranks.value, bucket_bits, both.value[0], b), _PACKED)
                       .repartition(tasks, "bucket").mapInArrow(lambda b: _meet(both.value[1], b), _PACKED))

    def pairs_of(packed: DataFrame) -> DataFrame:
        return (packed.where("kind = 2").select("digests", "keys", "bits", "docs", "numbers")
                .mapInArrow(_unpack_pairs, "y long, x long, doc long, number long, more boolean, unlike int")
                .groupBy("y", "x").agg(F.max("more").alias("more"), *[F.min(c).alias(c) for c in ("unlike", "doc", "number")])
                .select("y", "x", "more", F.struct("unlike", "doc", "number", "x").alias("place")))

    def met_in_slices(wanted: np.ndarray) -> DataFrame:
        """As `met`, of the sets left unsure, from the lines that the first pass kept."""
        lines = packed.where("kind = 0").select(*_LINE_COLUMNS)
        sent = spark.sparkContext.broadcast(wanted)
        found = (lines.mapInArrow(lambda b: _listed(sent.value, b), "digest long, doc long, number long, size long, bits binary")
                 .join(unsure, "digest", "left_semi").groupBy("digest").agg(F.min(F.struct("doc", "number", "size", "bits")).alias("set"))
                 .select("digest", "set.*").toArrow())
        digest, docs, numbers, sizes = (found[c].to_numpy() for c in ("digest", "doc", "number", "size"))
        words = np.frombuffer(b"".join(found["bits"].to_pylist()), np.uint64).reshape(-1, WIDE)
        few = spark.sparkContext.broadcast([digest, sizes.astype(np.uint32), words, docs, numbers.astype(np.uint32)])
        return kept(lines.mapInArrow(lambda b: _beside(sent.value, few.value, b), _PACKED))

    packed = met(None, None)
    fetch = line_texts(rows, packed)
    # of what the tasks kept, the most alike pairs of all
    of_set = Window.partitionBy("y")
    most = F.when(F.min("place.unlike").over(of_set) > SURE, max(KEPT, SPARE)).otherwise(KEPT)
    asked = kept(pairs_of(packed).withColumn("nth", F.row_number().over(of_set.orderBy("place"))).withColumn("most", most)
                 .withColumn("more", F.max(F.col("more") | (F.col("nth") > F.col("most"))).over(of_set))
                 .where("nth <= most").select("y", "x", "more"))
    names = [F.col("y").alias("a"), F.col("x").alias("b")]
    checked = kept(verify(asked.select(*names), fetch, line_sets))
    matched = checked.where(similar()).select(F.col("a").alias("digest")).distinct()
    unsure = kept(asked.where("more").select(F.col("y").alias("digest")).distinct().join(matched, "digest", "left_anti"))
    n_unsure = unsure.count()
    if n_unsure:
        wanted = flags(unsure)
        if n_unsure <= LISTED:
            second = met_in_slices(wanted)
        else:
            sent = spark.sparkContext.broadcast(wanted)
            second = met(flags(texts, ids_of=lambda b: _prefix_tokens(ranks.value, sent.value, b)), wanted)
        again = (pairs_of(second).select(*names).join(unsure.select(F.col("digest").alias("a")), "a", "left_semi")
                 .join(checked.select("a", "b"), ["a", "b"], "left_anti"))
        more = verify(kept(again), fetch, line_sets)
        matched = matched.unionAll(more.where(similar()).select(F.col("a").alias("digest"))).distinct()
    lines = packed.where("kind = 0").select("ids", "row_keys", "rows", "numbers", "digests").mapInArrow(
        _unpack_lines, "doc_id long, row_key long, number long, digest long")
    place = F.struct(F.coalesce("doc_id", F.lit(int(NO_ID))).alias("doc"), "number")
    firsts = (lines.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("n"))
              .join(matched.withColumn("matched", F.lit(True)), "digest", "left").where("n > 1 OR matched"))
    removed = (lines.join(firsts, "digest").where(F.col("matched").isNotNull() | (place != F.col("first")))
               .groupBy("row_key").agg(F.array_sort(F.collect_set("number")).alias("removed")))
    named = packed.where("kind = 0").select("ids", "row_keys", "n_lines").mapInArrow(
        _unpack_rows, "doc_id long, row_key long, n_lines long")
    return named, removed


def mark_lines(documents: DataFrame) -> DataFrame:
    """doc_id, n_lines and removed (numbers of the lines that go) of every document."""
    named, removed = find_repeats(documents)
    none = F.array().cast("array<long>")
    return named.join(removed, "row_key", "left").select("doc_id", "n_lines", F.coalesce("removed", none).alias("removed"))


def drop_repeated_lines(documents: DataFrame) -> DataFrame:
    """The documents without the lines that go; all other columns as they are. A text none of whose lines stay is empty."""
    _, removed = find_repeats(documents)
    text = F.col("text").cast("string")
    key = F.xxhash64(F.col("doc_id").cast("long"), text, F.lit(2))
    packed = documents.select(F.struct("*").alias("row"), text.alias("text"), key.alias("row_key"))
    lines = F.split("text", "\n", -1)
    left = F.array_join(F.filter(lines, lambda line, i: ~F.array_contains("removed", i.cast("long"))), "\n")
    cleaned = F.when(F.col("removed").isNull(), F.col("text")).otherwise(left)
    columns = [cleaned.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in documents.columns]
    return packed.join(removed, "row_key", "left").select(*columns)
