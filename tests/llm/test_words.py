import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from timelens.llm.words import ALPHANUMERIC, NON_SPACE, find_words, shingles, text_slices

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aBz09 .\n\té漢-", max_size=40)), max_size=8)


@settings(max_examples=60, deadline=None)
@given(TEXTS, st.integers(1, 30))
def test_words_and_hashes_are_those_of_each_row(texts, limit):
    for inside, pattern in ((NON_SPACE, rb"[^\x20\x09-\x0d]+"), (ALPHANUMERIC, rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")):
        got, by_word = [], {}
        for low, high, data, offsets in text_slices(pa.array(texts, pa.string()), limit):
            found = find_words(data, offsets, inside)
            for r, a, b, h in zip(*found, strict=True):
                word = data[a:b].tobytes().lower()
                got.append((low + r, word))
                assert by_word.setdefault(word, h) == h
        assert got == [(i, w) for i, t in enumerate(texts) for w in re.findall(pattern, (t or "").encode().lower())]
        assert len(set(by_word.values())) == len(by_word)


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_shingles_match_sets_of_tuples(texts):
    made = {}
    for low, high, data, offsets in text_slices(pa.array(texts, pa.string())):
        rows, grams = shingles(find_words(data, offsets, NON_SPACE), 3, high - low)
        for r, g in zip(rows.tolist(), grams.tolist(), strict=True):
            made.setdefault(low + r, []).append(g)
    for i, t in enumerate(texts):
        w = (t or "").encode().lower().split()
        want = [tuple(w[k:k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [tuple(w)] * (len(w) > 0)
        assert len(made.get(i, [])) == len(want)
        assert len(set(made.get(i, []))) == len(set(want))


def test_slices_cover_everything_once():
    texts = pa.array(["a" * n for n in (0, 3, 50, 1, 0, 7)])
    parts = [(low, high, len(data)) for low, high, data, _ in text_slices(texts, 10)]
    assert parts[0][0] == 0 and parts[-1][1] == 6 and sum(p[2] for p in parts) == 61
    assert list(text_slices(pa.array([], pa.string()))) == []
    assert np.concatenate([np.diff(o) for _, _, _, o in text_slices(texts, 10)]).tolist() == [0, 3, 50, 1, 0, 7]
