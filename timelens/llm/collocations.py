"""Phrase collocations from depth-truncated suffix trees, built group by group.

A text falls into pieces at the ends of its sentences and lines, a piece into words. The suffixes of
a piece's words, cut to DEPTH words, form a tree whose leaf totals are the counts of all
phrases. The tree is partitioned vertically: its suffixes are dealt by their first word, those of
a word with more occurrences than a memory budget by their first two words, and where these
are still too many by all of theirs. Prefixes that lie next to each other are put
into one group until the budget is full. Each group is one subtree, built by itself: its
suffixes are sorted word by word, and the total of a node is the sum of the leaves below it.
Nodes above the prefix of their group are added up over groups.

Only phrases of LEAST occurrences are asked for, and every part of such a phrase has as many.
So a suffix ends before its phrase becomes too rare. Tables of counters of fixed
size, one for each length, in which phrases may share a counter and no count is too low, tell
where; they hold the loads of the prefixes as well. They save work only: the counts are those
of the trees, and where a corpus is too large for the tables, more suffixes travel.

How it runs: a task adds up equal suffixes of all its texts before it hands them on,
so a frequent phrase travels as one row a task, and suffixes travel packed, with their words
written out once a row. A group is bounded by the budget, whichever word it belongs
to. Everything behind the trees is DataFrame code on phrases with LEAST occurrences.

Defined results: a NULL text is empty, a NULL language is `und`. Only A-Z are lowered. Repeated
documents count as often as they come. A language without candidates has no rows. An empty
table gives none. Extra columns are left out. Words of a text are told apart by 64-bit hashes
in their task, and by their bytes from there on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timelens.llm.sketch import counter_of, hashed_counts
from timelens.llm.store import kept
from timelens.llm.words import LOWER, Words, find_words, gram_hashes, hash_ranges, mix, text_slices

DEPTH, LEAST = 4, 30
COVERED = 80
"""Percent of a phrase's occurrences that a longer one must have to replace it."""
BEST = 2000

BUDGET = 1 << 19
"""Suffixes of a group, at most, before equal ones are added up."""

BITS = (22, 24, 23, 22)
"""Counters of phrases of 1 to DEPTH words, as powers of two."""

HELD, ROW = 1 << 19, 1 << 12
"""Different suffixes that a task holds at a time, and those that travel in one row; their words are told apart by 16 bits."""

_BREAK = np.zeros(256, bool)
_BREAK[[10, 11, 12, 13, *b".,;:!?"]] = True
_INSIDE = ~_BREAK
_INSIDE[[9, 32]] = False

_SUFFIXES = "group long, depth int, lang string, words string, suffixes binary, counts binary, n_words long"
_NODES = "lang string, phrase string, size int, f long"


def _languages(column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The languages of a batch, each row's place among them, and their hashes."""
    coded = column.cast(pa.string()).fill_null("und").dictionary_encode()
    names = coded.dictionary.to_pylist()
    raw = [n.encode() for n in names]
    ends = np.cumsum([len(r) for r in raw], dtype=np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    hashes = hash_ranges(data, np.concatenate([[0], ends[:-1]]).astype(np.int64), ends) if names else np.zeros(0, np.uint64)
    return names, coded.indices.to_numpy(zero_copy_only=False), mix(hashes)


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, Words, np.ndarray, np.ndarray, list[str], np.ndarray]]:
    """(lowered bytes, words, hashes by language, whether a word's piece goes on with the next one, languages, each word's)."""
    names, places, seeds = _languages(batch.column(1))
    for low, high, data, offsets in text_slices(batch.column(0)):
        found = find_words(data, offsets, _INSIDE)
        if not len(found.starts):
            continue
        lowered = LOWER[data]
        breaks = np.zeros(len(data) + 1, np.int32)
        np.cumsum(_BREAK[lowered], out=breaks[1:])
        on = np.zeros(len(found.starts), bool)
        on[:-1] = (breaks[found.starts[1:]] == breaks[found.ends[:-1]]) & (found.rows[1:] == found.rows[:-1])
        lang = places[low:high][found.rows]
        yield lowered, found, mix(found.hashes + seeds[lang]), on, names, lang


def loads(counts: np.ndarray) -> np.ndarray:
    """Counts as one byte each: 0 below LEAST, and above an upper bound in steps of a quarter of a power of two."""
    steps = np.ceil(4 * np.log2(np.maximum(counts, 1) / LEAST)).clip(0, 250) + 1
    return np.where(counts < LEAST, 0, steps).astype(np.uint8)


def load_of(codes: np.ndarray) -> np.ndarray:
    """The upper bounds that `loads` wrote down."""
    return np.where(codes > 0, np.ceil(LEAST * 2.0 ** ((codes.astype(float) - 1) / 4)), 0)


def phrases_at(hashes: np.ndarray, on: np.ndarray, tables: tuple) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For 1, 2, ... words, one more than there are tables at most: hashes of the phrases that begin at each word, and
    whether all their parts are frequent by the tables; a phrase itself is judged when the next length is asked for."""
    n = len(hashes)
    may = np.ones(n, bool)
    for size in range(1, DEPTH + 1):
        grams = np.zeros(n, np.uint64)
        grams[:max(0, n - size + 1)] = gram_hashes(hashes, size)
        yield grams, may
        if size > len(tables):
            return
        often = may & (tables[size - 1][counter_of(grams, tables[size - 1].size.bit_length() - 1)] > 0)
        may = on & often
        may[:-1] &= often[1:]


def _phrase_hashes(sent, batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """Hashes of the phrases one word longer than the tables reach."""
    for _, _, hashes, on, _, _ in _pieces(batch):
        *_, (grams, may) = phrases_at(hashes, on, sent.value if sent else ())
        yield grams[may]


def _edges(codes: np.ndarray, budget: int) -> np.ndarray:
    """Where a new group begins: counters lie next to each other until the budget is full."""
    load = load_of(np.arange(256))
    held = np.where(load <= budget, load, 0).astype(np.int64)[codes]
    filled = np.cumsum(held) // budget
    return np.flatnonzero(filled[1:] != filled[:-1]) + 1


class Suffixes:
    """The different suffixes of a task with their counts."""

    def __init__(self, tables: tuple, edges: tuple, budget: int):
        self.tables, self.edges, self.budget = tables, edges, budget
        self.texts: dict[int, str] = {}
        self.clear()

    def clear(self) -> None:
        self.found: list[tuple[np.ndarray, ...]] = []
        self.size = 0
        self.texts.clear()

    def add(self, lowered: np.ndarray, found: Words, hashes: np.ndarray, on: np.ndarray, lang: np.ndarray) -> None:
        """The suffixes of a slice: words by hash, 0 behind the last."""
        n = len(hashes)
        frequent = []
        for table, (grams, may) in zip(self.tables, phrases_at(hashes, on, self.tables), strict=True):
            frequent.append(may & (table[counter_of(grams, table.size.bit_length() - 1)] > 0))
        often = frequent[0]
        at = np.flatnonzero(often)
        parts = np.stack([np.where(f[at], hashes[np.minimum(at + k, n - 1)], 0) for k, f in enumerate(frequent)])
        key = mix(parts[0])
        for k in range(1, DEPTH):
            key = mix(key + parts[k] + np.uint64(k))
        _, first, counts = np.unique(key, return_index=True, return_counts=True)
        self.found.append((key[first], parts[:, first], counts, lang[at[first]]))
        self.size += len(first)
        used, where = np.unique(hashes[often], return_index=True)
        where = at[where]
        for h, i in zip(used.tolist(), where.tolist(), strict=True):
            if h not in self.texts:
                self.texts[h] = lowered[found.starts[i]:found.ends[i]].tobytes().decode()

    def merge(self) -> None:
        key, parts, counts, lang = (np.concatenate(c, axis=-1) for c in zip(*self.found, strict=True))
        _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        self.found = [(key[first], parts[:, first], np.bincount(inverse, counts).astype(np.int64), lang[first])]
        self.size = len(first)

    def groups(self, parts: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The group of each suffix and the length of its prefix."""
        words, pairs = self.tables[:2]
        one = counter_of(parts[0], words.size.bit_length() - 1)
        two = counter_of(gram_hashes(parts[:2].T.ravel(), 2)[::2], pairs.size.bit_length() - 1)
        heavy = load_of(words[one]) > self.budget
        load = load_of(pairs[two])
        whole = heavy & (parts[1] != 0) & (load > self.budget)
        split = heavy & ~whole
        one = np.searchsorted(self.edges[0], one, "right")
        behind = len(self.edges[0]) + 1
        share = (key % (load // self.budget + 1).astype(np.uint64)).astype(np.int64)
        spread = behind + len(self.edges[1]) + 1 + (two.astype(np.int64) << 20) + share
        two = behind + np.searchsorted(self.edges[1], two, "right")
        return (np.where(whole, spread, np.where(split, two, one)),
                np.where(whole, DEPTH, np.where(split, 2, 1)).astype(np.int32))

    def rows(self, names: list[str]) -> Iterator[tuple]:
        """The suffixes packed by group and language."""
        self.merge()
        key, parts, counts, lang = self.found[0]
        group, depth = self.groups(parts, key)
        order = np.lexsort((*parts[::-1], lang, group))
        parts, counts, lang, group, depth = parts[:, order], counts[order], lang[order], group[order], depth[order]
        edges = np.flatnonzero((group[1:] != group[:-1]) | (lang[1:] != lang[:-1])) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(group)], strict=True):
            for low in range(a, b, ROW):
                high = min(b, low + ROW)
                words, places = np.unique(parts[:, low:high], return_inverse=True)
                texts = [self.texts[h] if h else "" for h in words.tolist()]
                if texts[0]:
                    texts, places = ["", *texts], places + 1
                some = counts[low:high]
                yield (int(group[low]), int(depth[low]), names[lang[low]], " ".join(texts),
                       places.astype("<u2").tobytes(), some.astype(np.min_scalar_type(some.max())).tobytes(), 0)


def _find_suffixes(sent, budget: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.binary(), pa.binary(), pa.int64()]
    held, totals = Suffixes(*sent.value, budget), {}
    known: list[str] = []

    def packed() -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []
        for row in held.rows(known):
            waiting.append(row)
            if len(waiting) == 64:
                yield _batch(waiting, kinds)
        if waiting:
            yield _batch(waiting, kinds)
        held.clear()

    for batch in batches:
        for lowered, found, hashes, on, names, lang in _pieces(batch):
            for name in names:
                if name not in totals:
                    totals[name] = 0
                    known.append(name)
            place = np.array([known.index(name) for name in names])
            for k, n in enumerate(np.bincount(lang, minlength=len(names)).tolist()):
                totals[names[k]] += n
            held.add(lowered, found, hashes, on, place[lang])
            if held.size > 2 * HELD:
                held.merge()
                if held.size > HELD:
                    yield from packed()
    if held.found:
        yield from packed()
    total_group = -1 - TaskContext.get().partitionId()
    rows = [(total_group, 0, name, None, None, None, n) for name, n in totals.items()]
    if rows:
        yield _batch(rows, kinds)


def _batch(rows: list[tuple], kinds: list[pa.DataType]) -> pa.RecordBatch:
    out = pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)],
        ["group", "depth", "lang", "words", "suffixes", "counts", "n_words"])
    rows.clear()
    return out


class Subtree:
    """One group's suffixes, sorted into a tree."""

    def __init__(self) -> None:
        self.words: dict[str, int] = {"": 0}
        self.languages: dict[str, int] = {}
        self.found: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, lang: str, words: str, suffixes: bytes, counts: bytes) -> None:
        ids = np.array([self.words.setdefault(w, len(self.words)) for w in words.split(" ")], np.int32)
        places = ids[np.frombuffer(suffixes, "<u2")].reshape(DEPTH, -1)
        language = self.languages.setdefault(lang, len(self.languages))
        n = places.shape[1]
        totals = np.frombuffer(counts, f"<u{len(counts) // n}").astype(np.int64)
        self.found.append((np.vstack([np.full(n, language, np.int32), places]), totals))

    def nodes(self, depth: int) -> Iterator[tuple[str, str, int, int]]:
        """(language, phrase, words, total) of every node; those that are whole, from `depth` on, only with LEAST occurrences."""
        rows, counts = (np.concatenate(c, axis=-1) for c in zip(*self.found, strict=True))
        order = np.lexsort(rows[::-1])
        rows, counts = rows[:, order], counts[order]
        words, languages = list(self.words), list(self.languages)
        new = np.ones(rows.shape[1], bool)
        new[1:] = rows[0, 1:] != rows[0, :-1]
        for size in range(1, DEPTH + 1):
            new[1:] |= rows[size, 1:] != rows[size, :-1]
            firsts = np.flatnonzero(new)
            totals = np.add.reduceat(counts, firsts)
            here = (rows[size, firsts] > 0) & ((totals >= LEAST) | (size < depth))
            for row, total in zip(rows[:size + 1, firsts[here]].T.tolist(), totals[here].tolist(), strict=True):
                yield languages[row[0]], " ".join([words[w] for w in row[1:]]), size, total


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of every group, whose rows follow each other; words in all are nodes of size 0."""
    open_, depth, tree = None, 0, Subtree()

    def packed() -> Iterator[pa.RecordBatch]:
        rows = list(tree.nodes(depth)) if tree.found else []
        for low in range(0, len(rows), 1 << 14):
            part = list(zip(*rows[low:low + (1 << 14)], strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(part[0]), pa.array(part[1]), pa.array(part[2], pa.int32()), pa.array(part[3], pa.int64())],
                ["lang", "phrase", "size", "f"])

    for batch in batches:
        for k, group in enumerate(batch.column(0).to_pylist()):
            if group < 0:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column(2)[k].as_py()]), pa.array([""]), pa.array([0], pa.int32()),
                     pa.array([batch.column(6)[k].as_py()], pa.int64())], ["lang", "phrase", "size", "f"])
                continue
            if group != open_:
                if open_ is not None:
                    yield from packed()
                open_, depth, tree = group, batch.column(1)[k].as_py(), Subtree()
            tree.add(*(batch.column(c)[k].as_py() for c in (2, 3, 4, 5)))
    if open_ is not None:
        yield from packed()


def count_phrases(documents: DataFrame, budget: int = BUDGET, bits: tuple[int, ...] = BITS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, f) of the phrases of 1 to DEPTH words with LEAST occurrences, and (lang, n) of all words."""
    context = documents.sparkSession.sparkContext
    rows = documents.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    tables: tuple[np.ndarray, ...] = ()
    for size in bits:
        sent = context.broadcast(tables) if tables else None
        tables += (hashed_counts(rows, lambda batch, sent=sent: _phrase_hashes(sent, batch), size, loads, np.uint8),)
    tables = context.broadcast((tables, tuple(_edges(t, budget) for t in tables[:2])))
    suffixes = rows.mapInArrow(lambda batches: _find_suffixes(tables, budget, batches), _SUFFIXES)
    nodes = suffixes.repartition("group").sortWithinPartitions("group").mapInArrow(_build, _NODES)
    found = kept(nodes.groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f")).where((F.col("f") >= LEAST) | (F.col("size") == 0)))
    return found.where("size > 0"), found.where("size = 0").select("lang", F.col("f").alias("n"))


def score_cuts(phrases: DataFrame) -> DataFrame:
    """Phrases of two words and more with their lowest-scoring cut: a, l, r, score."""
    parts = F.split("phrase", " ")
    cuts = phrases.where("size >= 2").select(
        "lang", "phrase", "size", F.col("f").alias("a"), parts.alias("parts"),
        F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")).select(
        "lang", "phrase", "size", "a", "k",
        F.array_join(F.slice("parts", F.lit(1), F.col("k")), " ").alias("left"),
        F.array_join(F.slice("parts", F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("right"))
    total = lambda name, side: phrases.select("lang", F.col("phrase").alias(side), F.col("f").alias(name))
    scored = cuts.join(total("l", "left"), ["lang", "left"]).join(total("r", "right"), ["lang", "right"]).withColumn(
        "score", F.expr("(cast(a as decimal(20, 0)) * 2000000BD) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))"))
    best = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    return scored.groupBy("lang", "phrase", "size", "a").agg(best).select(
        "lang", "phrase", "size", "a", "cut.l", "cut.r", "cut.score")


def drop_covered(scored: DataFrame) -> DataFrame:
    """Phrases that no longer one has inside itself in COVERED percent of their occurrences."""
    size, parts = F.col("size"), F.split("phrase", " ")
    spans = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda n: F.transform(
        F.sequence(F.lit(1), size - n + 1), lambda at: F.array_join(F.slice(parts, at, n), " "))))
    inner = scored.where("size >= 3").select("lang", F.col("a").alias("longer"), F.explode(F.array_distinct(spans)).alias("phrase"))
    most = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    exact = lambda c, by: F.col(c).cast("decimal(20, 0)") * F.lit(by)
    kept_ones = F.col("longer").isNull() | (exact("longer", 100) < exact("a", COVERED))
    return scored.join(most, ["lang", "phrase"], "left").where(kept_ones).drop("longer")


def number_in_order(rows: DataFrame, by: str, order: list[Column], rank: str = "rank") -> DataFrame:
    """Rows numbered from 1 within each value of `by`, in a total order, without a task that sees a whole value.

    Rows are sorted by ranges; a row's number is its place in its task behind the rows of its value in tasks before.
    """
    place = F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1))
    placed = kept(kept(rows).repartitionByRange(by, *order).sortWithinPartitions(by, *order).select(
        "*", F.spark_partition_id().alias("_task"), place.alias("_place")))
    parts = placed.groupBy(by, "_task").agg(F.count("*").alias("_rows"), F.min("_place").alias("_first"))
    before = Window.partitionBy(by).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(by, "_task", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first") + 1).alias("_start"))
    return placed.join(starts, [by, "_task"]).withColumn(rank, F.col("_place") + F.col("_start")).drop("_task", "_place", "_start")


def mine_collocations(documents: DataFrame, best: int = BEST, budget: int = BUDGET) -> DataFrame:
    """Each language's best phrases: lang, rank, phrase, a, l, r, n, score."""
    phrases, totals = count_phrases(documents, budget)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    ranked = number_in_order(drop_covered(score_cuts(phrases)), "lang", order).where(F.col("rank") <= best)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
