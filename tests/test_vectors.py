from __future__ import annotations

import math
import struct

import numpy as np
import pytest
from conftest import T0, at, events
from pyspark.sql import functions as F

from timelens.functions import vectors as fv
from timelens.operators import embedding as em
from timelens.operators import semantic


def vectors(spark, rows):
    return spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "event_id long, embedding array<float>")


def test_bytes_round_trip(spark):
    rows = [[1.0, 2.0, 3.0], [0.0], [-1.5, 0.0, 1.5, 3.140000104904175], [math.pi, math.e], None]
    back = fv.import_vectors(fv.export_vectors(vectors(spark, rows)), "blob", "again").orderBy("event_id").collect()
    for r in back:
        assert r.again == r.embedding
        assert r.embedding is None or len(r.blob) == 4 * len(r.embedding)
    assert bytes(back[0].blob) == struct.pack("<3f", 1, 2, 3)


def test_bad_bytes_are_null(spark):
    df = spark.createDataFrame([(bytearray(b""),), (bytearray(b"abc"),), (None,)], "blob binary")
    assert [r.embedding for r in fv.import_vectors(df, "blob").collect()] == [None] * 3


def test_norm(spark):
    df = vectors(spark, [[3.0, 4.0], [0.0, 0.0, 0.0], [1.0]]).select("event_id", fv.norm(F.col("embedding")).alias("n"))
    assert [r.n for r in df.orderBy("event_id").collect()] == pytest.approx([5, 0, 1], abs=1e-5)


@pytest.mark.parametrize("q, r, expected", [
    ([1, 2, 3], [1, 2, 3], 1), ([1, 0], [0, 1], 0), ([1, 0], [-1, 0], -1),
    ([1, 2], [1, 2, 3], 0), ([1, 2], [0, 0], 0), ([0, 0], [1, 2], 0),
])
def test_cosine(spark, q, r, expected):
    row = spark.range(1).select(fv.cosine(fv.literal_vector(q), fv.literal_vector(r)).alias("c")).first()
    assert row.c == pytest.approx(expected, abs=1e-5)


def test_semantic_ranking(spark):
    df = events(spark, [
        (0, "u", "rowA", [1.0, 0.0, 0.0]), (1, "u", "rowB", [0.7, 0.7, 0.0]), (2, "u", "rowC", [0.0, 1.0, 0.0]),
        (3, "u", "short", [1.0]), (4, "u", "none"),
    ])
    got = semantic.semantic_search(df, [1.0, 0.0, 0.0], at(-10), 2).collect()
    assert [r.message for r in got] == ["rowA", "rowB"]
    assert "score" not in got[0].asDict()
    assert [r.message for r in semantic.semantic_search(df, [1.0, 0.0, 0.0], at(1), 9).collect()] == ["rowB", "rowC"]


def test_semantic_without_vectors(spark):
    assert semantic.semantic_search(events(spark, [(0, "u", "m")]), [1.0], at(-1), 5).count() == 0


def test_zero_query_gives_rows_in_tie_order(spark):
    df = events(spark, [(0, "u", "a", [1.0, 0.0]), (1, "u", "b", [0.0, 1.0])])
    assert [r.message for r in semantic.semantic_search(df, [0.0, 0.0], T0, 5).collect()] == ["a", "b"]


@pytest.mark.parametrize("block", [1, 3, 256])
def test_many_queries_equal_brute_force(spark, block):
    rng = np.random.default_rng(7)
    data = rng.normal(size=(120, 8)).astype("f4")
    data[5] = data[6]  # a tie
    df = spark.createDataFrame(
        [(i, [float(x) for x in v]) for i, v in enumerate(data)], "event_id long, embedding array<float>"
    ).repartition(5)
    queries = df.filter("event_id < 10").select(F.col("event_id").alias("query_id"), F.col("embedding").alias("vector"))
    got = {(r.query_id, r.rank): r.event_id for r in semantic.semantic_search_many(queries, df, 4, block).collect()}
    wide = data.astype("f8")
    unit = wide / np.linalg.norm(wide, axis=1)[:, None]
    for q in range(10):
        score = (unit @ unit[q]).astype("f4")
        order = sorted(range(120), key=lambda i: (-score[i], i))[:4]
        assert [got[q, k] for k in range(1, 5)] == order


@pytest.mark.parametrize("grid", [1, 3])
def test_blocks_of_several_dimensions_meet(spark, grid):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 2 + i % 3)]) for i in range(90)]
    rows += [(500, None), (501, []), (502, [0.0, 0.0]), (503, [float("nan"), 1.0])]
    df = spark.createDataFrame(rows, "event_id long, embedding array<float>").repartition(4)
    asked = spark.createDataFrame([(i, v) for i, v in rows if i % 7 == 0 or i > 499], "query_id int, vector array<double>").repartition(3)
    got = {}
    for r in semantic.semantic_search_many(asked, df, 5, 7, grid).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.event_id
    held = {i: np.array(v, "f4").astype("f8") for i, v in rows if v}

    def score(a, b):
        length = np.float64(np.float32(np.sqrt((a * a).sum()))) * np.sqrt((b * b).sum())
        return -np.inf if np.isnan(length) else np.float32(a @ b / length) if length else np.float32(0)

    for q in [i for i, v in rows if v and (i % 7 == 0 or i > 499)]:
        same = [i for i in held if len(held[i]) == len(held[q])]
        want = sorted(same, key=lambda i: (-score(held[q], held[i]), i))[:5]
        assert [got[q][k] for k in sorted(got[q])] == want, q
    assert set(got) <= set(held)


def test_plan_does_not_grow_with_the_queries(spark):
    def plan(n):
        vectors = F.array(F.col("id").cast("float"), F.lit(1.0).cast("float"))
        queries = spark.range(n).select(F.col("id").alias("query_id"), vectors.alias("vector"))
        events_ = spark.range(50).select(F.col("id").alias("event_id"), vectors.alias("embedding"))
        found = semantic.semantic_search_many(queries, events_, 3)
        return len(found._jdf.queryExecution().executedPlan().toString().splitlines())

    started = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    assert plan(10) == plan(10_000)
    assert spark.sparkContext.statusTracker().getJobIdsForGroup(None) == started


def test_pending_rows_stay_pending_when_embedding_fails(spark):
    df = events(spark, [(0, "u", "good"), (1, "", "bad"), (2, None, "good too")])
    seen = []

    def picky(texts):
        seen.extend(r.text for r in texts.collect())
        return texts.withColumn(
            "embedding", F.when(~F.col("text").contains("bad"), F.array(F.lit(1.0).cast("float")))
        )

    done = em.embed_pending(df, picky)
    assert sorted(r.event_id for r in done.collect()) == [1, 3]
    assert sorted(seen) == ["bad", "good too", "u: good"]
    assert [r.event_id for r in em.embed_pending(df, picky, done).collect()] == []
    joined = em.with_embeddings(df, done).orderBy("event_id").collect()
    assert [r.embedding for r in joined] == [[1.0], None, [1.0]]


def test_default_embedder_ranks_shared_words_first(spark):
    df = events(spark, [(0, "", "disk failure on sda"), (1, "", "user logged in"), (2, "", "Disk failure")])
    embedder = em.hashing_embedder(256)
    full = em.with_embeddings(df, em.embed_pending(df, embedder))
    q = em.embed_query(spark, embedder, "disk failure")
    assert [r.event_id for r in semantic.semantic_search(full, q, None, 2).collect()] == [3, 1]


def test_cells_are_not_packed_into_one_task(spark):
    rows = spark.range(64).select("id", F.array(F.rand(1), F.rand(2)).cast("array<float>").alias("v"))
    found = semantic.semantic_search_many(
        rows.select(F.col("id").alias("query_id"), F.col("v").alias("vector")),
        rows.select(F.col("id").alias("event_id"), F.col("v").alias("embedding")), 3, 4, 3)
    assert found._jdf.queryExecution().toString().count(", 18), REPARTITION_BY_NUM") >= 2
    assert found.count() == 64 * 3
