import collections
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from timelens.llm import ngrams, toxicity

from .conftest import words


def expected(rows):
    held = [d is not None and zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in rows]
    tokens = [[*words(t), None] for _, t in rows]
    counts = collections.Counter(w for h, t in zip(held, tokens) if not h for w in t)
    n, v = sum(counts.values()), len(counts)
    return [(d, h, len(t), sum(counts[w] > 0 for w in t), n, sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t))
            for (d, _), h, t in zip(rows, held, tokens)]


def score(frame_, **more):
    rows = frame_.withColumn("held_out", toxicity.in_fold("doc_id", 10))
    model = ngrams.build_model(rows.where("NOT held_out"), **more.pop("build", {}))
    return ngrams.score_documents(rows, model, **more)


def key(row):
    return (row[0] is None, row[0] or 0, *row[1:5], round(row[5], 6))


@pytest.mark.parametrize("hot", [1 << 16, 16])
def test_base_scores_match_brute_force(docs, frame, hot):
    got = score(frame(docs), build={"hot_words": hot}).collect()
    assert [key(r) for r in sorted(got, key=key)] == [key(r) for r in sorted(expected(docs), key=key)]
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)


def test_scores_do_not_depend_on_waves(docs, frame):
    one = score(frame(docs)).collect()
    many = score(frame(docs), wave_bytes=200).collect()
    assert np.allclose(sorted(r["score"] for r in one), sorted(r["score"] for r in many))


def test_levels_come_back_and_are_never_too_low():
    rng = np.random.default_rng(0)
    hashes = np.unique(rng.integers(0, 1 << 63, 4000, dtype=np.uint64) * np.uint64(2))
    counts = np.maximum(1, (rng.pareto(1, len(hashes)) * 3).astype(np.int64))
    bits = 3
    bucket = hashes >> np.uint64(64 - bits)
    starts, sizes, data = np.zeros(8, np.int64), np.zeros(8, np.uint64), []
    for b in range(8):
        mine = bucket == b
        part = ngrams.make_segment(ngrams._short(hashes[mine], bits), counts[mine])
        starts[b], sizes[b] = sum(map(len, data)), 8 * len(part)
        data.append(part)
    wave = ngrams.Wave(bits, starts, sizes, np.concatenate(data))
    found, levels = wave.levels(hashes), ngrams.levels_of(counts)
    assert (found >= levels).all() and (found == levels).mean() > 0.85
    others = rng.integers(0, 1 << 63, 4000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    assert (wave.levels(others) == 0).mean() > 0.85


def test_seen_text_scores_above_unseen(frame):
    rows = [(i, "the cat sat on the mat and the dog lay by the door") for i in range(40)] + [(100, "door the by lay dog the and mat")]
    rows += [(i, f"noise{i} words{i}") for i in range(200, 260)]
    got = {r["doc_id"]: r for r in score(frame(rows)).collect()}
    assert got[1]["score"] / got[1]["n_tokens"] > got[100]["score"] / got[100]["n_tokens"]
    assert got[1]["score"] > got[1]["base_score"]


def test_no_documents_and_no_training_documents(frame):
    assert score(frame([])).collect() == []
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    (row,) = score(frame([(held, "a b")])).collect()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == (3, 0, 0)
    assert math.isclose(row["base_score"], 0.0, abs_tol=1e-9)


def test_other_id_types_and_columns(frame):
    rows = frame([("a", "x y", 1), (None, None, 2)], "doc_id string, text string, score int")
    model = ngrams.build_model(rows)
    out = ngrams.score_documents(rows.withColumn("held_out", F.lit(False)), model)
    assert sorted((r["doc_id"] or "", r["n_tokens"], r["n_known"]) for r in out.collect()) == [("", 1, 1), ("a", 3, 3)]
