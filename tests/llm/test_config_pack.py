"""Best-fit packing: the program against exhaustive search, the pieces against the tokenizer itself."""

import random
import zlib
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from timelens.llm import config_pack as cp, queries  # noqa: E402

BPE = public_tokenizers.path("byte_bpe_50k.json")


def fewest(lengths, capacity):
    """The least number of sequences by trying every way."""
    lengths = tuple(sorted(lengths, reverse=True))

    @lru_cache(None)
    def search(k, rooms):
        if k == len(lengths):
            return 0
        best = 1 + search(k + 1, tuple(sorted((*rooms, capacity - lengths[k]))))
        for i, room in enumerate(rooms):
            if room >= lengths[k] and (not i or rooms[i - 1] != room):
                best = min(best, search(k + 1, tuple(sorted((*rooms[:i], room - lengths[k], *rooms[i + 1:])))))
        return best

    return search(0, ())


def check_plan(histogram, capacity):
    plan, bound = cp.plan_sequences(histogram, capacity)
    held = np.zeros(capacity + 1, np.int64)
    for lengths, copies in plan:
        assert copies > 0 and sum(lengths) <= capacity and list(lengths) == sorted(lengths, reverse=True)
        np.add.at(held, list(lengths), copies)
    assert (held == histogram).all()
    return sum(c for _, c in plan), bound


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=9))
def test_small_plans_are_the_best(lengths):
    took, bound = check_plan(np.bincount(lengths, minlength=13), 12)
    best = fewest(lengths, 12)
    assert bound <= best <= took <= best + (best > 3)


@pytest.mark.parametrize("seed", range(4))
def test_plans_come_near_the_bound(seed, monkeypatch):
    rng = np.random.default_rng(seed)
    sizes = np.clip(rng.lognormal(4.2, 0.9, 60_000).astype(int), 1, 256)
    if seed == 3:  # a third of all pieces have one length, which nothing fills up
        sizes[:20_000] = 201
    histogram = np.bincount(sizes, minlength=257)
    took, bound = check_plan(histogram, 256)
    assert bound <= took <= 1.002 * len(cp.best_fit(sizes, 256)) + 1
    if seed < 3:
        assert took <= 1.002 * bound + 1


def test_programs_take_part_in_plans(monkeypatch):
    rng = np.random.default_rng(9)
    histogram = np.bincount(rng.integers(1, 129, 50_000), minlength=129)
    left = histogram.copy()
    cover, bound = cp.fractional(histogram, 128)
    held = np.zeros(129)
    for lengths, times in cover.items():
        assert sum(lengths) <= 128
        np.add.at(held, list(lengths), times)
    assert (held[1:] >= histogram[1:] * (1 - 1e-6)).all() and bound <= sum(cover.values())
    copies = sum(c for _, c in cp._round(cover, left, 128))
    assert (left >= 0).all() and copies > 0.8 * bound and left.sum() < 0.1 * histogram.sum()


def test_places_are_dense():
    plan = [((5, 3, 3), 4), ((8,), 2), ((3, 2), 1)]
    codes, pers, sequences, offsets = cp.places(plan)
    assert [(c >> 44, c & 0xFFF) for c in codes.tolist()] == [(2, 0), (3, 0), (3, 8), (5, 0), (8, 0)]
    assert pers.tolist() == [1, 2, 1, 1, 1] and sequences.tolist() == [6, 0, 6, 0, 4] and offsets.tolist() == [3, 5, 0, 0, 0]


def check_pieces(rows, texts, capacity):
    """Ids, cuts and places of pieces; gives the number of sequences."""
    tokenizer = Tokenizer.from_file(BPE)
    tokenizer.encode_special_tokens = True
    want = []
    for doc_id, text in texts:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        want += [(doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    order = lambda x: [(v is None, v or 0) for v in x]
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=order) == sorted(want, key=order)
    held = {}
    for r in rows:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert set(held) == set(range(len(held)))
    return len(held)


@pytest.mark.parametrize("capacity", [64, 2048])
def test_documents_are_cut_and_placed(docs, frame, capacity):
    rows = [(d, t, 1, "x") for d, t in docs]
    found = cp.pack_documents(frame(rows, "doc_id long, text string, length int, task string"), BPE, capacity=capacity).collect()
    took = check_pieces(found, docs, capacity)
    assert all(zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in found)
    lengths = np.array([r["length"] for r in found])
    assert took <= len(cp.best_fit(lengths, capacity)) + 1


def test_empty_table_and_hot_length(frame):
    assert cp.pack_documents(frame([], "doc_id long, text string"), BPE).collect() == []
    same = [(k, "same text here" if k % 3 else None) for k in range(3000)]
    # 2,000 texts of four ids and 1,000 of one
    assert check_pieces(cp.pack_documents(frame(same), BPE, capacity=16).collect(), same, 16) == -(-9000 // 16)


def test_query_on_the_given_tables(spark, tmp_path, docs):
    rng = random.Random(2)
    texts = [*docs, (5000, " ".join(f"w{rng.randint(0, 999)}" for _ in range(4000)))]
    spark.createDataFrame([(d, t, "en") for d, t in texts], "doc_id long, text string, lang string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op13_best_fit_pack"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert dict(got.dtypes)["piece"] == "int"
    check_pieces(got.collect(), texts, 2048)
