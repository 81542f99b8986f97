"""N-gram Jaccard join in the metric space of shingle sets, distance 1 - similarity.

Sets are distinct five-word shingles. Two documents link at a similarity of 0.75,
that is within a distance of EPS = 0.25.

First regions. A document's prefix is the rarest quarter of its shingles and one
more; linked documents share a prefix shingle, so the documents with one shingle in
their prefixes form a region, and every link lies within one. A region's pivot is the
document that meets most others; regions with the same pivot are one. At first every document
is compared with the pivot it shares most prefix shingles with, its Voronoi cell's.

Then regions are joined recursively. In each round, every region that holds documents
of several components gets a pivot for each of up to CELLS of them, the largest, whose
component is its cell. A distance of EPS or less to a pivot is a link; sizes and prints
(parities of shingles) bound a distance from below, and where that leaves no link, or both
are of one component, the texts are not compared. Pivots have no link left to find then.
Of the WINDOWS largest cells all distances to the pivot are taken, or their bounds: by the
triangle inequality the distances of linked documents to any pivot differ by EPS at most, so
a document of the cell whose distance lies outside the window of those outside the cell has no
link left either. The others, the boundary, are the next region, until it has a single
component. A document of a region of up to MET that by the bounds fits none of another
component leaves it in any round. Documents that are far apart fall away in one round, and a
group of near copies costs one distance each.

Links are exact; components are their transitive closure, found by hooking every
set to the least of its neighbours until nothing changes. Equal sets are one from the
start. A document is sent to where its pivots are compared, a frequent pivot's
documents in several parts. Lists of links, regions and components stay distributed.

Defined results: words are runs of anything but ASCII white space, A-Z lowered; a
document of fewer than five words has them all as one shingle; without words (NULL,
empty, white space) it has none and links with nothing. Repeated rows have each their
row. A NULL id is never the least of a component that has another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Row, Window
from pyspark.sql import functions as F

from timelens.llm.similar import (
    DENOMINATOR, NUMERATOR, Fetch, Sets, digests, distinct_elements, in_slice_once, may_be_similar, prefixes, rarity,
    shared_prefixes, texts_by_name, verify,
)
from timelens.llm.sketch import hit_severally
from timelens.llm.store import kept
from timelens.llm.words import NON_SPACE, find_words, mix, shingles, text_slices

WORDS = 5
EPS = 1 - NUMERATOR / DENOMINATOR
CELLS = 64
"""Components of a region that get a pivot in one round."""

WINDOWS = 2
"""Of these the largest, whose cells get windows."""

LINKS = 1 << 18
"""Links, or compared pairs, that one task takes at least."""

MEMBERS = 1 << 13
"""Rows of open regions that one task takes at least."""

MET = 2048
"""Documents of a region up to which all of its pairs are looked at by prints."""

CHUNK = 4096
HELD = 1 << 18
"""Postings a task holds before it hands them on."""

HOT = 1 << 17
"""Estimated documents with a shingle from which on its region is gathered in parts."""


def document_sets(data: np.ndarray, offsets: np.ndarray) -> Sets:
    """The shingle set of every text, empty ones too."""
    n = len(offsets) - 1
    rows, grams = shingles(find_words(data, offsets, NON_SPACE), WORDS, n)
    of, elements = distinct_elements(rows, grams)
    return Sets(np.arange(n), np.zeros(n, np.int64), offsets[:-1], offsets[1:], of, elements)


PRINT = 16
"""Longs of a document's print: enough bits to tell apart documents of 1,500 shingles."""
PRINTS = [f"print{i}" for i in range(PRINT)]


def set_prints(sets: Sets) -> np.ndarray:
    """PRINT longs a set: of each bit, the parity of the set's shingles that fall on it.

    Two sets differ in at least as many shingles as their prints in bits.
    """
    n, width = len(sets.rows), 64 * PRINT
    out = np.zeros((n, width // 8), np.uint8)
    bit = (mix(~sets.elements) % np.uint64(width)).astype(np.int64)
    for low in range(0, n, 2048):
        high = min(n, low + 2048)
        a, b = np.searchsorted(sets.of, [low, high])
        hits = np.bincount((sets.of[a:b] - low) * width + bit[a:b], minlength=(high - low) * width)
        out[low:high] = np.packbits((hits & 1).astype(np.uint8).reshape(high - low, width), axis=1)
    return out.view(np.int64)


def _differ(others: list[str]) -> Column:
    """Bits in which the prints of two documents differ."""
    return sum((F.bit_count(F.col(a).bitwiseXOR(F.col(b))) for a, b in zip(PRINTS, others, strict=True)), F.lit(0))


def _by_bucket(held: list[tuple[np.ndarray, ...]], bits: int, bucket_bits: int, ranks: np.ndarray) -> Iterator[pa.RecordBatch]:
    elements, digest, sizes, places = (np.concatenate(x) for x in zip(*held, strict=True))
    estimate = np.exp2(ranks[(elements >> np.uint64(64 - bits)).astype(np.int64)] / 8.0)
    parts = (estimate // HOT).astype(np.uint64) + np.uint64(1)
    salt = mix(digest.view(np.uint64)) % parts
    # prefixes prefer small hashes, so buckets take another one
    bucket = ((mix(elements) >> np.uint64(64 - bucket_bits)) + salt) % np.uint64(1 << bucket_bits)
    for hot in (False, True):
        mine = np.flatnonzero((parts > 1) == hot)
        order = mine[np.argsort(bucket[mine], kind="stable")]
        cuts = np.searchsorted(bucket[order], np.arange((1 << bucket_bits) + 1, dtype=np.uint64))
        used = np.flatnonzero(np.diff(cuts))
        if len(used):
            slices = [order[cuts[b]:cuts[b + 1]] for b in used]
            yield pa.RecordBatch.from_pydict({
                "bucket": pa.array(used, pa.int32()), "region": pa.array([0] * len(used), pa.int64()),
                "hot": pa.array([hot] * len(used), pa.bool_()), "ids": pa.nulls(len(used), pa.list_(pa.int64())),
                "keys": pa.array([elements[x].tobytes() for x in slices], pa.binary()),
                "digests": pa.array([digest[x].tobytes() for x in slices], pa.binary()),
                "sizes": pa.array([sizes[x].tobytes() for x in slices], pa.binary()),
                "places": pa.array([places[x].tobytes() for x in slices], pa.binary())})


def _postings(ranks: np.ndarray, shared: np.ndarray, bucket_bits: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Prefix shingles of several sets with their set's digest and size, packed by bucket; documents' rows beside them."""
    bits = len(ranks).bit_length() - 1
    for batch in batches:
        names = batch.schema.names
        ids, keys = batch.column(names.index("doc_id")), batch.column(names.index("name")).to_numpy()
        held: list[tuple[np.ndarray, ...]] = []
        for low, high, data, offsets in text_slices(batch.column(names.index("text"))):
            if sum(len(h[0]) for h in held) > HELD:
                yield from _by_bucket(held, bits, bucket_bits, ranks)
                held = []
            sets = document_sets(data, offsets)
            digest, sizes = digests(sets), sets.sizes
            yield pa.RecordBatch.from_pydict({
                "bucket": pa.array([int(digest[0]) & (1 << bucket_bits) - 1], pa.int32()), "region": pa.array([0], pa.int64()), "hot": pa.array([None], pa.bool_()),
                "ids": pa.array([ids.slice(low, high - low).to_pylist()], pa.list_(pa.int64())),
                "keys": pa.array([keys[low:high].tobytes()], pa.binary()),
                "digests": pa.array([digest.tobytes()], pa.binary()), "sizes": pa.array([sizes.astype(np.uint32).tobytes()], pa.binary()),
                "places": pa.array([set_prints(sets).tobytes()], pa.binary())})
            of, elements, places = prefixes(sets, ranks)
            # equal sets of the slice are sent once
            mine = in_slice_once(digest)[of] & hit_severally(mix(elements), shared)
            held.append((elements[mine], digest[of[mine]], sizes[of[mine]].astype(np.uint32), places[mine].astype(np.uint32)))
        if held:
            yield from _by_bucket(held, bits, bucket_bits, ranks)


_PACKED = "bucket int, region long, hot boolean, ids array<long>, keys binary, digests binary, sizes binary, places binary"


def _concatenated(parts: list[pa.Scalar], kind: type) -> np.ndarray:
    return np.concatenate([np.frombuffer(p.as_buffer(), kind) for p in parts])


def _may_link(keys: np.ndarray, sizes: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Which documents, sorted by shingle and size, can have a link whose first common shingle this is.

    Such a link shares nothing rarer, so at most the shingles from this one on; the
    overlap it needs is least with the smallest other document within the length bound.
    """
    if not len(keys):
        return np.zeros(0, bool)
    group = np.cumsum(np.concatenate([[0], keys[1:] != keys[:-1]]))
    at = np.arange(len(keys))
    partner = np.searchsorted(group << 32 | sizes, group << 32 | -(-sizes * NUMERATOR // DENOMINATOR), "left")
    partner = np.where(partner == at, np.minimum(at + 1, len(keys) - 1), partner)
    least, most = np.minimum(sizes, sizes[partner]), np.maximum(sizes, sizes[partner])
    overlap = -(-NUMERATOR * (least + most) // (NUMERATOR + DENOMINATOR))
    return (partner != at) & (group[partner] == group) & (least * DENOMINATOR >= most * NUMERATOR) & (sizes - places >= overlap)


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Regions of two documents and more, named by their pivot or by their hot shingle; documents' rows pass."""
    held: dict[bool, list] = {False: [], True: []}
    for batch in batches:
        hot = batch.column(2).to_pylist()
        passing = [i for i, h in enumerate(hot) if h is None]
        if passing:
            yield batch.take(pa.array(passing))
        for i, h in enumerate(hot):
            if h is not None:
                held[h].append(tuple(batch.column(c)[i] for c in (4, 5, 6, 7)))
    for hot, rows in held.items():
        if not rows:
            continue
        keys, digest, sizes, places = (
            _concatenated(x, k) for x, k in zip(zip(*rows, strict=True), (np.uint64, np.int64, np.uint32, np.uint32), strict=True))
        rows.clear()
        order = np.lexsort((digest, keys))
        keys, digest, sizes, places = keys[order], digest[order], sizes[order], places[order]
        new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (digest[1:] != digest[:-1])])
        keys, digest, sizes, places = keys[new], digest[new], sizes[new], places[new]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        counts = np.diff(np.append(starts, len(keys)))
        if hot:
            # other parts of the region are elsewhere: its shingle names it
            names = mix(keys[starts]).view(np.int64)
            shared = np.ones(len(digest), np.uint32)
        else:
            order = np.lexsort((sizes, keys))
            keys, digest, sizes, places = keys[order], digest[order], sizes[order], places[order]
            some = _may_link(keys, sizes.astype(np.int64), places.astype(np.int64))
            keys, digest, sizes = keys[some], digest[some], sizes[some]
            some = np.zeros(len(keys) + 1, bool)
            some[1:-1] = keys[1:] == keys[:-1]
            some = some[1:] | some[:-1]
            keys, digest, sizes = keys[some], digest[some], sizes[some]
            region = np.cumsum(np.concatenate([[0], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
            # the pivot is the document that meets the most others: an original rather than a copy with changes
            weight = np.bincount(region)[region] if len(region) else region
            _, of = np.unique(digest, return_inverse=True)
            met = np.bincount(of.ravel(), weight)[of.ravel()] if len(of) else np.zeros(0)
            order = np.lexsort((digest, -met, region))
            first = order[np.concatenate([[True], region[order][1:] != region[order][:-1]])] if len(order) else order
            pivots = digest[first][region]
            # regions of one pivot are one: all their documents share a shingle with it
            order = np.lexsort((digest, pivots))
            new = np.ones(len(order), bool)
            new[1:] = (pivots[order][1:] != pivots[order][:-1]) | (digest[order][1:] != digest[order][:-1])
            shared = np.diff(np.append(np.flatnonzero(new), len(order))).astype(np.uint32)
            order = order[new]
            digest, sizes, pivots = digest[order], sizes[order], pivots[order]
            starts = np.flatnonzero(np.concatenate([[True], pivots[1:] != pivots[:-1]])) if len(pivots) else np.zeros(0, np.int64)
            counts, names = np.diff(np.append(starts, len(pivots))), pivots[starts]
        for low in range(0, len(starts), 1024):
            packs = [(n, s, min(s + CHUNK, a + c)) for n, a, c in zip(names[low:low + 1024], starts[low:low + 1024], counts[low:low + 1024], strict=True)
                     for s in range(a, a + c, CHUNK)]
            yield pa.RecordBatch.from_pydict({
                "bucket": pa.array([0] * len(packs), pa.int32()), "region": pa.array([n for n, _, _ in packs], pa.int64()),
                "hot": pa.array([hot] * len(packs), pa.bool_()), "ids": pa.nulls(len(packs), pa.list_(pa.int64())),
                "keys": pa.array([shared[a:b].tobytes() for _, a, b in packs], pa.binary()),
                "digests": pa.array([digest[a:b].tobytes() for _, a, b in packs], pa.binary()),
                "sizes": pa.array([sizes[a:b].tobytes() for _, a, b in packs], pa.binary()), "places": pa.nulls(len(packs), pa.binary())})


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for region, shared, digest, sizes in zip(*(batch.column(i) for i in range(4)), strict=True):
            ids = np.frombuffer(digest.as_buffer(), np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), region.as_py())), pa.array(ids), pa.array(np.frombuffer(sizes.as_buffer(), np.uint32).astype(np.int64)),
                 pa.array(np.frombuffer(shared.as_buffer(), np.uint32).astype(np.int64))], ["region", "digest", "n", "shared"])


def _unpack_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, keys, digest, sizes, prints in zip(*(batch.column(i) for i in range(5)), strict=True):
            marks = np.frombuffer(prints.as_buffer(), np.int64).reshape(-1, PRINT)
            yield pa.RecordBatch.from_arrays(
                [ids.values, pa.array(np.frombuffer(keys.as_buffer(), np.int64)), pa.array(np.frombuffer(digest.as_buffer(), np.int64)),
                 pa.array(np.frombuffer(sizes.as_buffer(), np.uint32).astype(np.int64)), *(pa.array(marks[:, i]) for i in range(PRINT))],
                ["doc_id", "name", "digest", "n_shingles", *PRINTS])


def _name() -> Column:
    return F.xxhash64("text", F.lit(3))


def find_regions(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, name, digest, n_shingles, prints) of all documents, and (region, digest, n, shared) of the first regions:
    `shared` is the number of prefix shingles that put the document there."""
    spark = documents.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bucket_bits = max(4, (2 * tasks - 1).bit_length())
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("name", _name())
    ranks = spark.sparkContext.broadcast(rarity(rows.select("text"), document_sets))
    several = spark.sparkContext.broadcast(shared_prefixes(rows.select("text"), document_sets, ranks))
    packed = kept(
        rows.mapInArrow(lambda b: _postings(ranks.value, several.value, bucket_bits, b), _PACKED)
        .repartition(tasks, "bucket").mapInArrow(_regions, _PACKED))
    named = packed.where("hot IS NULL").select("ids", "keys", "digests", "sizes", "places").mapInArrow(
        _unpack_documents, ", ".join(f"{c} long" for c in ("doc_id", "name", "digest", "n_shingles", *PRINTS)))
    members = packed.where("hot IS NOT NULL").select("region", "keys", "digests", "sizes").mapInArrow(
        _unpack, "region long, digest long, n long, shared long")
    return named, members.groupBy("region", "digest", "n").agg(F.sum("shared").alias("shared"))


def _pairs(asked: DataFrame) -> DataFrame:
    """x, y as a, b: the set with the least digest is b, to which the others are sent."""
    return asked.withColumns({"a": F.greatest("x", "y"), "b": F.least("x", "y")})


def _links(found: DataFrame) -> DataFrame:
    return found.where(F.col("shared") * DENOMINATOR >= F.col("joined") * NUMERATOR).select("a", "b")


def _sized(df: DataFrame, each: int, *more: Column) -> tuple[DataFrame, Row]:
    """The rows, kept, in partitions for `each` of them; their number `n` and what else is to be summed up.

    Rows that fit one partition are grouped and joined where they are, without a shuffle.
    """
    seen = Observation()
    held = kept(df.observe(seen, F.count(F.lit(1)).alias("n"), *more))
    found = Row(**seen.get)
    return held.coalesce(_partitions(found.n, each)), found


def _partitions(rows: int, each: int) -> int:
    return max(1, -(-rows // each))


def _fit(n: np.ndarray, prints: np.ndarray, component: np.ndarray) -> np.ndarray:
    """Which of some sets may be similar to one of another component, by sizes and prints (see `may_be_similar`)."""
    out = np.zeros(len(n), bool)
    for low in range(0, len(n), 64):
        rows = np.arange(low, min(len(n), low + 64))
        m = n[rows][:, None]
        differ = np.bitwise_count(prints[rows][:, None] ^ prints[None]).sum(axis=2, dtype=np.int64)
        fit = ((np.minimum(n, m) * DENOMINATOR >= np.maximum(n, m) * NUMERATOR)
               & ((n + m) * (DENOMINATOR - NUMERATOR) >= differ * (DENOMINATOR + NUMERATOR)))
        out[rows] = (fit & (component[rows][:, None] != component)).any(axis=1)
    return out


def _fit_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that come by region, without those that fit none of another component in their region."""
    def left(rows: pa.RecordBatch) -> pa.RecordBatch:
        region, n, component = (rows.column(rows.schema.names.index(c)).to_numpy() for c in ("region", "n", "component"))
        prints = np.stack([rows.column(rows.schema.names.index(c)).to_numpy() for c in PRINTS], axis=1).view(np.uint64)
        cuts = np.flatnonzero(np.concatenate([[True], region[1:] != region[:-1], [True]])).tolist()
        fit = np.concatenate([_fit(n[a:b], prints[a:b], component[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
        return rows.filter(pa.array(fit))

    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.concat_batches([*waiting, batch])
        region = rows.column(rows.schema.names.index("region")).to_numpy()
        # the last region may go on
        cut = len(region) - int(np.argmax(region[::-1] != region[-1])) if region[0] != region[-1] else 0
        waiting = [rows.slice(cut)]
        if cut:
            yield left(rows.slice(0, cut))
    if waiting:
        yield left(waiting[0])


def _partnered(members: DataFrame) -> DataFrame:
    """The members of regions without those that cannot link with another component of their region.

    All pairs of a region of up to MET documents are looked at in one task, by sizes and prints;
    larger regions of several components are left as they are. Without `component` every document is one.
    """
    columns = members.columns
    members = kept(members if "component" in columns else members.withColumn("component", F.col("digest")))
    several = (members.groupBy("region").agg(F.min("component").alias("one"), F.max("component").alias("other"), F.count("*").alias("met"))
               .where("one != other").select("region", "met"))
    counted = members.join(several, "region")
    small = counted.where(F.col("met") <= MET).drop("met").repartition("region").sortWithinPartitions("region")
    return small.mapInArrow(_fit_members, small.schema).unionByName(counted.where(F.col("met") > MET).drop("met")).select(*columns)


def _open_regions(members: DataFrame) -> tuple[DataFrame, int]:
    """Only the regions that hold several components, their members that may link, and how many rows these are."""
    left, found = _sized(_partnered(members), MEMBERS)
    return left, found.n


def _merged(members: DataFrame) -> DataFrame:
    """(region, digest, n, shared) with each region under that of its documents that meets most others in all regions.

    Tasks name regions by what they hold, so one group of near copies has several at first.
    """
    members = kept(members)
    sizes = members.groupBy("region").agg(F.count("*").alias("size"))
    met = members.join(sizes, "region").groupBy("digest").agg(F.sum("size").alias("met"))
    named = members.join(met, "digest").groupBy("region").agg(F.max_by("digest", F.struct("met", "digest")).alias("to"))
    return (members.join(named, "region").groupBy(F.col("to").alias("region"), "digest", "n").agg(F.sum("shared").alias("shared")))


def join_regions(members: DataFrame, prints: DataFrame, fetch: Fetch) -> DataFrame:
    """(digest, component) of all sets that have a link; `prints` has a row for each digest."""
    slack = 1e-9
    members = kept(_partnered(_merged(members).join(prints, "digest")))
    marks = [f"pivot_{c}" for c in PRINTS]
    differ = _differ(marks)
    may = may_be_similar(F.col("n"), F.col("pivot_n"), differ)

    def as_pivot(one: str) -> list[Column]:
        return [F.col(f"{one}.digest").alias("pivot"), F.col(f"{one}.n").alias("pivot_n"),
                *[F.col(f"{one}.{c}").alias(m) for c, m in zip(PRINTS, marks, strict=True)]]

    pivots = members.groupBy("region").agg(
        F.min(F.struct(F.col("digest") != F.col("region"), "digest", "n", *PRINTS)).alias("p")).select("region", *as_pivot("p"))
    near = members.join(pivots, "region").where("digest != pivot").where(may)
    homes = near.groupBy("digest").agg(F.max_by("pivot", F.struct("shared", "pivot")).alias("home"))
    found, n = _sized(verify(kept(_pairs(homes.select(F.col("digest").alias("x"), F.col("home").alias("y"))).select("a", "b").distinct()),
                             fetch, document_sets), LINKS)
    all_known, n_known = found, n.n
    names = components(_links(found))
    members, n_open = _open_regions(members.drop("shared").join(names, "digest", "left").withColumn("component", F.coalesce("component", "digest")))
    while n_open:
        known = all_known.coalesce(_partitions(n_known, LINKS))
        # digests are hashes: the least is any
        least = members.groupBy("region", "component").agg(F.min(F.struct("digest", "n", *PRINTS)).alias("p"), F.count("*").alias("size"))
        in_order = Window.partitionBy("region").orderBy(F.desc("size"), "p.digest")
        pivots = (least.withColumn("nth", F.row_number().over(in_order)).where(F.col("nth") <= CELLS)
                  .select(F.col("region").alias("in"), F.col("component").alias("cell"), (F.col("nth") <= WINDOWS).alias("wide"), *as_pivot("p")))
        # only what can link two cells, and all distances to the pivots of the largest
        meets = (F.col("region") == F.col("in")) & (F.col("digest") != F.col("pivot")) & (F.col("wide") | may & (F.col("component") != F.col("cell")))
        near, _ = _sized(_pairs(members.join(pivots, meets)
                                .withColumns({"differ": differ, "x": F.col("digest"), "y": F.col("pivot"), "fit": may}))
                         .drop("in", "x", "y", "component", "cell", *PRINTS, *marks), MEMBERS * CELLS)
        pairs = kept(near.where("fit").select("a", "b").distinct().join(known, ["a", "b"], "left_anti"))
        found, n = _sized(verify(pairs, fetch, document_sets), LINKS)
        all_known, n_known = all_known.unionAll(found), n_known + n.n
        known = all_known.coalesce(_partitions(n_known, LINKS))
        names = with_links(names, _links(found))
        # of regions that are one component now, nothing is left to find
        members, n_open = _open_regions(members.drop("component").join(names, "digest", "left").withColumn("component", F.coalesce("component", "digest")))
        if not n_open:
            break
        near = near.where("wide").join(members.select("region").distinct(), "region", "left_semi")
        # distances to pivots: known ones, or what sizes and prints leave open
        total = F.col("n") + F.col("pivot_n")
        open_from = F.greatest(1 - F.least("n", "pivot_n") / F.greatest("n", "pivot_n"), 2 * F.col("differ") / (total + F.col("differ")))
        measured = (near.join(known.select("a", "b", (1 - F.col("shared") / F.col("joined")).alias("d")), ["a", "b"], "left")
                    .select("region", "digest", "pivot", F.coalesce("d", open_from).alias("low"), F.coalesce("d", F.lit(1.0)).alias("high"))
                    .join(names, "digest", "left").withColumn("component", F.coalesce("component", "digest"))
                    .join(names.select(F.col("digest").alias("pivot"), F.col("component").alias("cell")), "pivot", "left")
                    .withColumn("mine", F.col("component") == F.coalesce("cell", "pivot")))
        windows = (measured.where("NOT mine").groupBy("region", "pivot")
                   .agg(F.min("low").alias("from"), F.max("high").alias("to")))
        reaches = (F.col("high") >= F.col("from") - EPS - slack) & (F.col("low") <= F.col("to") + EPS + slack)
        # a pivot, and what of its cell lies outside its window, has no link left
        done = measured.where("mine").join(windows, ["region", "pivot"], "left").where(~F.coalesce(reaches, F.lit(False)))
        left = (members.join(done.select("region", "digest"), ["region", "digest"], "left_anti")
                .join(pivots.select(F.col("in").alias("region"), F.col("pivot").alias("digest")), ["region", "digest"], "left_anti"))
        members, n_open = _open_regions(left)
    return names


def _star_links(links: DataFrame) -> tuple[DataFrame, Row]:
    return _sized(links, LINKS, F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("mark"))


def with_links(names: DataFrame, links: DataFrame) -> DataFrame:
    """`names`, the (digest, component) of `components`, after further links: only those between components are run over."""
    ends = links
    for c in ("a", "b"):
        ends = (ends.join(names.select(F.col("digest").alias(c), "component"), c, "left")
                .withColumn(c, F.coalesce("component", c)).drop("component"))
    moved = components(ends)
    if moved.isEmpty():
        return names
    to = moved.select(F.col("digest").alias("component"), F.col("component").alias("to"))
    held, _ = _sized(names.join(to, "component", "left").select("digest", F.coalesce("to", "component").alias("component")).unionAll(moved), LINKS)
    return held


def components(links: DataFrame) -> DataFrame:
    """(digest, component) of all linked sets: every set hooks to the least it can reach.

    Each round joins the links of a star's centre among its leaves (the least gets the
    others), so long chains shrink by half or more.
    """
    edges, before = _star_links(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct())
    while True:
        # a is less than b: every set sends its greater neighbours to its least one, which is among its lesser ones
        least = edges.groupBy(F.col("b").alias("a")).agg(F.min("a").alias("m"))
        large = edges.join(least, "a", "left").select(F.coalesce("m", "a").alias("a"), "b").distinct()
        # then every set sends its lesser neighbours, and itself, to its least one
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = (large.join(least, "b").where("a != m").select(F.col("m").alias("a"), F.col("a").alias("b"))
                 .unionAll(least.select(F.col("m").alias("a"), "b")).distinct())
        edges, now = _star_links(small)
        if now == before:
            break
        before = now
    return edges.select(F.col("b").alias("digest"), F.col("a").alias("component"))


def find_components(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id that links reach) of every document."""
    named, members = find_regions(documents)
    texts = documents.select(F.col("text").cast("string").alias("text")).select(_name().alias("name"), "text")
    prints = named.groupBy("digest").agg(*[F.min(c).alias(c) for c in PRINTS])
    names = join_regions(members, prints, texts_by_name(texts, named.groupBy("digest").agg(F.min("name").alias("name"))))
    placed = named.drop(*PRINTS).join(names, "digest", "left").withColumn("component", F.coalesce("component", "digest"))
    least = placed.where("n_shingles > 0").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return (placed.join(least, "component", "left")
            .select("doc_id", "n_shingles",
                    F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")))


def keep_one(documents: DataFrame) -> DataFrame:
    """One document of each component, that of the least id (a NULL id last); those without words all stay.

    Rows of one id are told apart by their text; of rows that repeat both, one stays.
    """
    text = F.col("text").cast("string")
    key = F.xxhash64("doc_id", text, F.lit(9))
    found = find_components(documents.select(key.alias("doc_id"), text.alias("text"))).withColumnRenamed("doc_id", "row_key")
    ids = documents.select(key.alias("row_key"), F.struct(F.col("doc_id").isNull().alias("none"), "doc_id").alias("place"))
    least = (found.where("n_shingles > 0").select("row_key", "component_id").distinct().join(ids, "row_key")
             .groupBy("component_id").agg(F.min(F.struct("place", "row_key")).alias("least"))
             .select(F.col("least.row_key").alias("row_key"), F.lit(True).alias("single")))
    empty = found.where("n_shingles = 0").select("row_key", F.lit(False).alias("single")).distinct()
    packed = documents.select(F.struct("*").alias("row"), key.alias("row_key"))
    nth = F.row_number().over(Window.partitionBy("row_key").orderBy(F.lit(0)))
    return (packed.join(least.unionAll(empty), "row_key").withColumn("nth", nth)
            .where("NOT single OR nth = 1").select("row.*"))
