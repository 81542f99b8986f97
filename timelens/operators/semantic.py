"""Exact nearest-vector search by cosine similarity.

Every task scores its Arrow batches against the query vectors by one matrix
product and keeps its own best k rows per query, so what leaves a task is
bounded by k and not by the rows it read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from datetime import datetime

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from timelens.operators.events import shown, since
from timelens.operators.topk import check_limit, top_per_group

# Vectors that travel together, and meet others in one matrix product.
BLOCK = 512


def cosine_scores(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Float32 similarity of every query to every row; 0 beside a zero vector."""
    rows = rows.astype(np.float64)
    row_length = np.sqrt((rows * rows).sum(axis=1))
    query_length = np.sqrt((queries * queries).sum(axis=1)).astype(np.float32).astype(np.float64)
    length = query_length[:, None] * row_length[None, :]
    product = queries @ rows.T
    scores = np.divide(product, length, out=np.zeros_like(product), where=length != 0)
    return np.nan_to_num(scores, nan=-np.inf).astype(np.float32)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, equal ones by lower id."""
    if len(scores) > 4 * k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        among = np.flatnonzero(scores >= floor)
    else:
        among = np.arange(len(scores))
    return among[np.lexsort((ids[among], -scores[among]))[:k]]


def _local_best(
    batches: Iterable[pa.RecordBatch], queries: np.ndarray, query_ids: Sequence, k: int, schema: pa.Schema
) -> Iterator[pa.RecordBatch]:
    """Best k rows per query of one task's batches, kept up to date batch by batch."""
    best: list[pa.Table | None] = [None] * len(query_ids)
    least = np.full(len(query_ids), -np.inf, dtype=np.float32)  # score to reach, once k are kept
    for batch in batches:
        if batch.num_rows == 0:
            continue
        vectors = batch.column("embedding")
        values = vectors.flatten().to_numpy(zero_copy_only=False)
        scores = cosine_scores(values.reshape(batch.num_rows, -1), queries)
        plain = pa.Table.from_batches([batch.drop_columns(["embedding"])])
        ids = plain.column("event_id").to_numpy()
        for q in np.flatnonzero(scores.max(axis=1) >= least):
            top = _best(scores[q], ids, k)
            found = plain.take(pa.array(top)).append_column("score", pa.array(scores[q][top]))
            if best[q] is not None:
                found = pa.concat_tables([best[q], found])
                keep = _best(found.column("score").to_numpy(), found.column("event_id").to_numpy(), k)
                found = found.take(pa.array(keep))
            best[q] = found
            if found.num_rows == k:
                least[q] = found.column("score")[k - 1].as_py()
    for query_id, found in zip(query_ids, best):
        if found is not None:
            labelled = found.append_column("query_id", pa.array([query_id] * found.num_rows, pa.int64()))
            yield from labelled.select(schema.names).cast(schema).combine_chunks().to_batches()


def _candidates(
    vectors: DataFrame, queries: Sequence[tuple[int, Sequence[float]]], k: int
) -> DataFrame:
    """Rows that are among their task's best k of some query; all queries of one dimension."""
    dimension = len(queries[0][1])
    usable = vectors.filter(F.col("embedding").isNotNull() & (F.size("embedding") == dimension))
    carried = [f for f in usable.schema.fields if f.name != "embedding"]
    out = T.StructType([
        *carried, T.StructField("score", T.FloatType()), T.StructField("query_id", T.LongType()),
    ])
    matrix = np.array([v for _, v in queries], dtype=np.float32).astype(np.float64)
    ids = [i for i, _ in queries]
    arrow = to_arrow_schema(out)

    def best_of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _local_best(batches, matrix, ids, k, arrow)

    return usable.mapInArrow(best_of_task, out)


def semantic_search(
    events: DataFrame, query: Sequence[float], start: datetime | None = None, limit: int = 10
) -> DataFrame:
    """The ``limit`` events from ``start`` on that are nearest to the query vector.

    Events without an embedding, or with one of another length, do not count.
    Nearest first, equal similarity by ``event_id``; the score is not returned.
    """
    check_limit(limit)
    rows = events if start is None else since(events, start)
    if limit == 0 or len(query) == 0:
        return shown(rows).limit(0)
    wide = shown(rows).columns
    found = _candidates(rows.select(*wide, "embedding"), [(0, query)], limit)
    return shown(found.orderBy(F.desc("score"), F.asc("event_id")).limit(limit))


def _pack_blocks(size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (id, vector) as blocks of up to ``size`` vectors of one dimension."""
    task = TaskContext.get().partitionId() << 33
    waiting: dict[int, tuple[list[np.ndarray], list[np.ndarray]]] = {}
    held: dict[int, int] = {}
    number = 0

    def block(dimension: int) -> pa.RecordBatch:
        nonlocal number
        ids, rows = (np.concatenate(x) for x in waiting.pop(dimension))
        held[dimension] = 0
        number += 1
        return pa.RecordBatch.from_pydict({
            "dimension": pa.array([dimension], pa.int32()), "block": pa.array([task + number], pa.int64()),
            "ids": pa.array([ids.astype("<i8").tobytes()]), "rows": pa.array([rows.astype("<f4").tobytes()])})

    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        vectors = batch.column(1)
        sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
        for dimension in np.unique(sizes).tolist():
            chosen = np.flatnonzero(sizes == dimension)
            values = vectors.take(pa.array(chosen)).flatten().to_numpy(zero_copy_only=False).reshape(len(chosen), dimension)
            for low in range(0, len(chosen), size):
                some = chosen[low:low + size]
                place = waiting.setdefault(dimension, ([], []))
                place[0].append(ids[some])
                place[1].append(values[low:low + size])
                held[dimension] = held.get(dimension, 0) + len(some)
                if held[dimension] >= size:
                    yield block(dimension)
    for dimension in list(waiting):
        yield block(dimension)


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows of (id, vector) packed into blocks where they lie."""
    return rows.mapInArrow(lambda batches: _pack_blocks(size, batches), "dimension int, block long, ids binary, rows binary")


def _best_of_pairs(k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The best k of every query over the pairs of blocks that follow each other, one matrix product a pair."""
    open_, query_ids = None, np.zeros(0, np.int64)
    best: list[tuple[np.ndarray, np.ndarray]] = []
    least = np.zeros(0, np.float32)  # score to reach, once k are kept

    def found() -> pa.RecordBatch:
        counts = [len(ids) for _, ids in best]
        return pa.RecordBatch.from_pydict({
            "query_id": pa.array(np.repeat(query_ids, counts), pa.int64()),
            "event_id": pa.array(np.concatenate([ids for _, ids in best]), pa.int64()),
            "score": pa.array(np.concatenate([scores for scores, _ in best]), pa.float32())})

    for batch in batches:
        dimensions, blocks = (batch.column(c).to_pylist() for c in (0, 1))
        for row, (dimension, block) in enumerate(zip(dimensions, blocks, strict=True)):
            if block != open_:
                if open_ is not None:
                    yield found()
                open_ = block
                query_ids = np.frombuffer(batch.column(2)[row].as_buffer(), "<i8")
                matrix = np.frombuffer(batch.column(3)[row].as_buffer(), "<f4").reshape(-1, dimension).astype(np.float64)
                best = [(np.zeros(0, np.float32), np.zeros(0, np.int64))] * len(query_ids)
                least = np.full(len(query_ids), -np.inf, np.float32)
            ids = np.frombuffer(batch.column(4)[row].as_buffer(), "<i8")
            vectors = np.frombuffer(batch.column(5)[row].as_buffer(), "<f4").reshape(-1, dimension)
            scores = cosine_scores(vectors, matrix)
            for q in np.flatnonzero(scores.max(axis=1) >= least):
                held, names = best[q]
                top = _best(scores[q], ids, k)
                held, names = np.concatenate([held, scores[q][top]]), np.concatenate([names, ids[top]])
                keep = _best(held, names, k)
                best[q] = held[keep], names[keep]
                if len(keep) == k:
                    least[q] = held[keep[-1]]
    if open_ is not None:
        yield found()


def semantic_search_many(
    queries: DataFrame, events: DataFrame, k: int = 10, block: int = BLOCK, grid: int | None = None
) -> DataFrame:
    """For every row ``query_id, vector`` the ids of its ``k`` nearest events, ranked from 1.

    Queries and events are packed into blocks where they lie, and the blocks dealt over a
    grid of ``grid`` by ``grid`` cells (as many cells as shuffle partitions, if not given):
    a block of queries goes to all cells of a row, a block of events to all of a column, and
    every pair of blocks meets in one cell, by an equal key. A cell keeps the best ``k`` of a
    block of queries at a time. Nothing passes the driver, and the plan is the same for any
    number of queries.
    """
    check_limit(k)
    spark = events.sparkSession
    if k == 0:
        return spark.createDataFrame([], "query_id long, rank int, event_id long")
    wide = grid or max(1, math.isqrt(int(spark.conf.get("spark.sql.shuffle.partitions"))))
    vector = lambda df, key, c: df.select(
        F.col(key).cast("long").alias("id"), F.col(c).cast("array<float>").alias("vector")).filter(F.size("vector") > 0)
    dealt = F.pmod(F.xxhash64("block"), F.lit(wide)).cast("int")
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(wide - 1)))
    asked = _blocks(vector(queries, "query_id", "vector"), block).select(
        "dimension", "block", F.col("ids").alias("query_ids"), F.col("rows").alias("queries"), dealt.alias("_row"),
        everywhere.alias("_column"))
    there = _blocks(vector(events, "event_id", "embedding"), block).select(
        "dimension", "ids", "rows", dealt.alias("_column"), everywhere.alias("_row"))
    # a cell is much work for few bytes: with partitions of a set number, several are not packed into one task
    cell = ["dimension", "_row", "_column"]
    asked, there = (side.repartition(2 * wide * wide, *cell) for side in (asked, there))
    pairs = asked.join(there.hint("merge"), cell).select(
        "dimension", "block", "query_ids", "queries", "ids", "rows")
    found = pairs.mapInArrow(lambda batches: _best_of_pairs(k, batches), "query_id long, event_id long, score float")
    ranked = top_per_group(found, ["query_id"], [F.desc("score"), F.asc("event_id")], k)
    return ranked.select("query_id", "rank", "event_id")
