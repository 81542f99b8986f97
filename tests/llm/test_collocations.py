"""Collocations against counts of all phrases in plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from timelens.llm import collocations as co, queries

from .conftest import WORDS, sentence


def brute(rows, best=2000):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\v\f\r]", lowered):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for size in range(1, 5):
                for i in range(len(words) - size + 1):
                    f[lang, tuple(words[i:i + size])] += 1
    found = {k: a for k, a in f.items() if a >= 30 and len(k[1]) > 1}
    out = {}
    for (lang, p), a in found.items():
        inside = lambda q: len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q)))
        if any(o == lang and inside(q) and 100 * b >= 80 * a for (o, q), b in found.items()):
            continue
        score, _, l, r = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), l, r))
    return sorted((lang, rank, p.decode(), -a, l, r, n[lang], -score)
                  for lang, held in out.items() for rank, (score, a, p, l, r) in enumerate(sorted(held)[:best], 1))


def fixture_rows(seed=1):
    rng = random.Random(seed)
    common = ["Alpha beta", "x1 y2 Z3 漢字 tail", "señor été: beta", "a b c d e f", "same same same same"]
    rows = [(1, None, "en"), (2, "", None), (3, " \t\n.,", "en"), (4, "no. end", "xx"), (5, "straße phi " * 2000, "de")]
    for i in range(400):
        parts = [sentence(rng, rng.randint(0, 6)) if rng.random() < 0.5 else rng.choice(common) for _ in range(rng.randint(1, 6))]
        parts += [rng.choice(WORDS[:14]) + " " + rng.choice(WORDS[:9]) for _ in range(40)]
        rows.append((i, rng.choice([" ", "\t", ". ", "\n", " , ", "  "]).join(parts), rng.choice(["en", "en", "en", "de", None, "und"])))
    return rows + rows[:40] + [(7, "hot copy of one line " * 3, "en")] * 300


SCHEMA = "doc_id long, text string, lang string, phrase string, f int, group string"


def mined(frame, rows, **kw):
    found = co.mine_collocations(frame([(*r, "x", 1, "g") for r in rows], SCHEMA), **kw)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(map(tuple, found.collect()))


@pytest.mark.parametrize("budget", [1 << 19, 500, 40])
def test_matches_brute_force(frame, budget):
    rows = fixture_rows()
    want = brute(rows)
    assert len({w[0] for w in want}) == 3 and len(want) > 60 and {len(w[2].split(" ")) for w in want} == {2, 3, 4}
    assert mined(frame, rows, budget=budget) == want


def test_few_counters_and_full_tasks_change_nothing(frame, monkeypatch):
    monkeypatch.setattr(co, "HELD", 50)
    monkeypatch.setattr(co, "ROW", 7)
    monkeypatch.setattr(co.count_phrases, "__defaults__", (300, (5, 6, 6, 4)))
    rows = fixture_rows(2)
    assert mined(frame, rows, budget=300) == brute(rows)


def test_groups_stay_within_the_budget(frame):
    documents = frame([r[:3] for r in fixture_rows(3)], "doc_id long, text string, lang string")
    words = co.hashed_counts(documents.select("text", "lang"), lambda batch: co._phrase_hashes(None, batch), 16, co.loads, "u1")
    groups = np.searchsorted(co._edges(words, 1000), np.arange(1 << 16), "right")
    load = co.load_of(words)
    held = np.bincount(groups, np.where(load <= 1000, load, 0))
    assert len(held) > 3 and max(held) <= 2000 and load.max() > 1000


def test_ties_and_limits(frame):
    rows = [(k, "b a, a b, é z; a c", "en") for k in range(30)]
    got = mined(frame, rows)
    assert got == brute(rows) and len(got) == 4
    assert mined(frame, rows, best=2) == brute(rows, 2)
    assert mined(frame, []) == []
    assert mined(frame, [(1, None, None)]) == []


def test_query_on_the_given_tables(spark, tmp_path):
    rows = fixture_rows(5)
    spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op11_collocations"](spark, str(tmp_path))
    assert {t for n, t in got.dtypes if n not in ("lang", "phrase")} == {"bigint"}
    assert sorted(map(tuple, got.collect())) == brute(rows)
