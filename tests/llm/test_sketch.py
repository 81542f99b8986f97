"""Counters in packed form, counters hit more than once, prints of sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from timelens.llm.near_duplicates import PRINT, document_sets, set_prints
from timelens.llm.sketch import _packed, _places, _read, _several, hit_severally, several_hits
from timelens.llm.words import mix, text_slices


@pytest.mark.parametrize("size", [1, 5, 16, 1 << 16])
@pytest.mark.parametrize("most", [1, 2, 255, 256, 65535])
@pytest.mark.parametrize("share", [0.0, 0.01, 0.5, 1.0])
def test_packed_counters_come_back(size, most, share):
    rng = np.random.default_rng(size + most)
    part = (rng.integers(1, most + 1, size) * (rng.random(size) < share)).astype(np.uint16)
    back = _read(*(pa.scalar(x, pa.binary()) for x in _packed(part)), size)
    assert np.array_equal(back, part)


def test_hits_in_one_task_and_over_several(spark):
    def _hashes(batch):
        yield mix(batch.column(0).to_numpy().view(np.uint64))

    values = [*range(3000), *range(0, 3000, 7), *([5] * 40)]
    table = several_hits(spark.createDataFrame([(v,) for v in values], "v long").repartition(3), _hashes, 22)
    hashes = mix(np.arange(3000).astype(np.uint64))
    counters, n = np.unique((mix(np.array(values).astype(np.uint64)) >> np.uint64(42)).astype(np.int64), return_counts=True)
    several = set(counters[n > 1].tolist())
    assert hit_severally(hashes, table).tolist() == [int(h >> np.uint64(42)) in several for h in hashes]
    assert not several_hits(spark.createDataFrame([], "v long"), _hashes, 16).any()


def test_hits_cut_over_flushes(monkeypatch):
    monkeypatch.setattr("timelens.llm.sketch.HELD", 10)
    batches = [pa.RecordBatch.from_pydict({"v": pa.array(x, pa.int64())}) for x in ([1] * 11, list(range(2, 14)), [3, 13, 13, 13])]
    parts = list(_several(_places(lambda b: iter([b.column(0).to_numpy().view(np.uint64) << np.uint64(40)]), 24, iter(batches))))
    held = {p: np.flatnonzero(np.unpackbits(np.frombuffer(c, np.uint8))).tolist()
            for b in parts for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)}
    assert held == {0: [1, 3, 13]}


def test_prints_never_differ_in_more_bits_than_sets_in_shingles():
    rng = np.random.default_rng(1)
    texts = ["", "one", *(" ".join(str(x) for x in rng.integers(0, 12, n)) for n in rng.integers(1, 900, 60))]
    texts += [f"{t} tail {i}" for i, t in enumerate(texts)]
    (_, _, data, offsets), = text_slices(pa.array(texts, pa.string()))
    sets = document_sets(data, offsets)
    prints = set_prints(sets).view(np.uint64)
    assert prints.shape == (len(texts), PRINT)
    each = [set(sets.elements[sets.of == i].tolist()) for i in range(len(texts))]
    bits = [int(np.bitwise_count(prints[i] ^ prints[j]).sum()) for i in range(len(texts)) for j in range(len(texts))]
    apart = [len(each[i] ^ each[j]) for i in range(len(texts)) for j in range(len(texts))]
    assert all(b <= a for b, a in zip(bits, apart, strict=True))
    assert any(b == a for b, a in zip(bits, apart, strict=True) if a)
