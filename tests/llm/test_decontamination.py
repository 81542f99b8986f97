import re

import pytest

from timelens.llm import decontaminate

from .conftest import lower, sentence

PATTERN = rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"


def brute(rows, items, size):
    bench = [(i, re.findall(PATTERN, lower(t))) for i, t in items if i is not None]
    out = []
    for doc_id, text in rows:
        w = re.findall(PATTERN, lower(text))
        hit, found = set(), set()
        for item, iw in bench:
            n = min(size, len(iw))
            for s in range(len(iw) - n + 1) if n else ():
                for p in range(len(w) - n + 1):
                    if w[p:p + n] == iw[s:s + n]:
                        hit.update(range(p, p + n))
                        found.add(item)
        out.append((doc_id, len(w), len(hit), sorted(found)))
    return out


def benchmark_of(docs):
    import random
    rng = random.Random(2)
    items = [(i, sentence(rng, 12)) for i in range(3)]
    for i, (_, text) in enumerate(docs[10:30]):
        w = (text or "").split()
        if len(w) > 14:
            items.append((10 + i, " ".join(w[2:14]).upper()))
    return items + [(90, "same " * 12), (91, "same"), (92, "two-words"), (92, "HERE"), (93, ""), (94, None), (None, "one"), (10, "here")]


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_hits_match_brute_force(docs, frame, block):
    rows = [d for d in docs if d[0] != 1006]
    items = benchmark_of(docs)
    got = decontaminate.find_contamination(frame(rows), frame(items, "item_id long, text string"), 5, block)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    found = [(r["doc_id"], r["n_words"], r["n_hit"], r["item_ids"]) for r in got.collect()]
    assert sorted(found, key=key) == sorted(brute(rows, items, 5), key=key)


def test_longest_match_and_ranges(frame):
    text = "zero a b c d e f g h i j k l nine a b"
    bench = frame([(1, "x a b c d e f g h i j k l y")], "item_id long, text string")
    (row,) = decontaminate.find_contamination(frame([(5, text)]), bench).collect()
    assert (row["hit_ranges"], row["longest_match"], row["item_ids"]) == ([1, 13], 12, [1])


def test_affected_documents_go_and_columns_stay(frame):
    text = "a b c d e f g h i j k"
    rows = frame([(1, text, 8, "k"), (2, "a b c", 9, "m"), (3, None, 1, None)], "doc_id long, text string, n_hit int, item_ids string")
    bench = frame([(1, text)], "item_id long, text string")
    out = decontaminate.decontaminate(rows, bench)
    assert out.columns == rows.columns
    assert sorted(map(tuple, out.collect())) == [(2, "a b c", 9, "m"), (3, None, 1, None)]


def test_empty_tables(frame):
    bench = frame([], "item_id long, text string")
    assert decontaminate.find_contamination(frame([]), bench).collect() == []
    (row,) = decontaminate.find_contamination(frame([(1, "a b")]), bench).collect()
    assert (row["n_words"], row["n_hit"], row["item_ids"], row["longest_match"]) == (2, 0, [], 0)
