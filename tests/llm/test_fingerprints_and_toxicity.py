import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from timelens.llm import fingerprint, toxicity

from .conftest import sentence


def key(row):
    return (row[0] is not None, row[0] or 0)


def test_neighbours_match_brute_force(docs, frame):
    rows = list({d: (d, t) for d, t in docs}.values())
    table = frame([(d, t, "x") for d, t in rows], "doc_id long, text string, fingerprint string")
    lexicon = fingerprint.build_lexicon(table, band=(0.0, 9.0), bits=16)
    got = {r["doc_id"]: r for r in fingerprint.with_neighbours(table, lexicon).collect()}
    ordered = sorted(rows, key=key)
    assert len(got) == len(ordered)
    texts = [t or "" for _, t in ordered]
    prints = fingerprint.fingerprints(pa.array(texts), lexicon)
    for k, (doc_id, _) in enumerate(ordered):
        nxt = (k + 1) % len(ordered)
        n = len(texts[k]) // 4
        edited = texts[k][:len(texts[k]) - n] + texts[nxt][:n]
        edited_print = fingerprint.fingerprints(pa.array([edited]), lexicon)
        r = got[doc_id]
        assert (r["n_chars"], r["edited_sha256"]) == (len(texts[k]), hashlib.sha256(edited.encode()).hexdigest())
        assert r["fingerprint"] == prints[k].astype(">u2").tobytes().hex()
        assert r["edited_fingerprint"] == edited_print[0].astype(">u2").tobytes().hex()
        assert r["near_edited"] == fingerprint.likeness(prints[k:k + 1], edited_print)[0]
        assert r["near_next"] == fingerprint.likeness(prints[k:k + 1], prints[nxt:nxt + 1])[0]


def test_likeness_tells_edits_from_others():
    rng = random.Random(3)
    texts = [sentence(rng, n) for n in (60, 200, 800, 3000)]
    lexicon = fingerprint.Lexicon(np.ones(1 << 16, bool), 16)
    prints = fingerprint.fingerprints(pa.array(texts), lexicon)
    edited = fingerprint.fingerprints(pa.array([t[:-len(t) // 8] for t in texts]), lexicon)
    assert (fingerprint.likeness(prints, prints) == 1).all()
    assert (fingerprint.likeness(prints, edited) > 0.4).all()
    assert (fingerprint.likeness(prints[:2], prints[2:]) < 0.4).all()


def test_texts_without_terms_and_empty_tables(frame):
    lexicon = fingerprint.Lexicon(np.zeros(1 << 16, bool), 16)
    prints = fingerprint.fingerprints(pa.array([None, "", "!!", "outside the band"]), lexicon)
    assert not prints[:3].any() and prints[3].any()
    assert fingerprint.likeness(prints[:2], prints[1:3]).tolist() == [1.0, 1.0]
    assert fingerprint.likeness(prints[:1], prints[3:])[0] == 0.0
    empty = frame([])
    assert fingerprint.with_neighbours(empty, fingerprint.build_lexicon(empty)).collect() == []
    (row,) = fingerprint.with_neighbours(frame([(1, "alone in here")]), lexicon).collect()
    assert row["n_chars"] == 13 and row["near_next"] == 1.0
    same = fingerprint.fingerprint_documents(frame([(1, "a b"), (2, "a b")]), lexicon).collect()
    assert same[0]["fingerprint"] == same[1]["fingerprint"]


def toxic_corpus(n, seed=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = sentence(rng, rng.randint(20, 120)).split(" ")
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["grumbo", "snarlig", "vexnok" + rng.choice("abcdef")])
        rows.append((i, " ".join(words), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def model():
    rows = toxic_corpus(240)
    return toxicity.train([t for _, t, _ in rows], np.array([y for _, _, y in rows]))


def test_held_out_accuracy(model):
    rows = toxic_corpus(200, seed=9)
    scores, _, _ = toxicity.score_texts(model, pa.array([t for _, t, _ in rows]))
    right = (scores >= 0.5) == np.array([y for _, _, y in rows], bool)
    assert right.mean() > 0.95


def test_every_window_of_a_long_text_counts(model):
    rng = random.Random(5)
    clean = sentence(rng, 3000)
    words = clean.split(" ")
    words[2777] = words[2780] = "grumbo"
    scores, counts, tops = toxicity.score_texts(model, pa.array([clean, " ".join(words), None, "", "..."]))
    assert scores[0] < 0.5 <= scores[1] and tops[1] <= 2780 < tops[1] + 2 * toxicity.WINDOW
    assert counts[0] == 1 + -(-(3000 - toxicity.WINDOW) // toxicity.STRIDE)
    assert (scores[2:] == model.base_rate).all() and (counts[2:] == 0).all()


def test_gradients_match_differences(model):
    rng = np.random.default_rng(0)
    w = {k: rng.normal(0, 0.5, v.shape) for k, v in toxicity._start_weights(4, 4, 1).items()}
    inputs = rng.normal(0, 1, (7, 2 * toxicity.VECTOR + 3))
    ids = rng.integers(0, 7, (6, 5))
    mask = (rng.random((6, 5)) < 0.8).astype(float)
    mask[0] = 1
    labels = np.array([0, 1, 1, 0, 1.0])

    def loss():
        z = toxicity._forward(inputs, ids, mask, w).astype(float)
        return float(np.mean(np.log1p(np.exp(z)) - labels * z))

    g, d_inputs = toxicity._gradients(inputs, ids, mask, labels, w)
    for held, grad in [*((w[k], g[k]) for k in g if w[k].ndim), (inputs, d_inputs)]:
        for _ in range(3):
            at = tuple(rng.integers(0, s) for s in held.shape)
            was, step = held[at], 1e-2
            held[at] = was + step
            up = loss()
            held[at] = was - step
            down = loss()
            held[at] = was
            assert abs((up - down) / (2 * step) - grad[at]) < 2e-3


def test_the_driver_does_not_train(frame, monkeypatch):
    import os
    rows, driver, train = toxic_corpus(60), os.getpid(), toxicity.train

    def elsewhere(texts, marks):
        assert os.getpid() != driver
        return train(texts, marks)

    monkeypatch.setattr(toxicity, "train", elsewhere)
    trained = toxicity.train_on(frame([(d, t) for d, t, _ in rows]), frame([(d, y) for d, _, y in rows], "doc_id long, toxic int"), 30)
    assert trained.weights and 0 < trained.base_rate < 1


def test_tables(frame):
    rows = toxic_corpus(60)
    documents = frame([(d, t, 0.5) for d, t, _ in rows] + [(None, None, 0.5), (7, rows[7][1], 0.5)], "doc_id long, text string, toxicity double")
    labels = frame([(d, y) for d, _, y in rows] + [(0, 0), (None, 1), (3, None), (999, 1)], "doc_id long, toxic int")
    trained = toxicity.train_on(documents, labels, 20)
    out = toxicity.score_documents(documents, trained).collect()
    assert len(out) == 62 and all(0 <= r["toxicity"] <= 1 for r in out)
    none = toxicity.train_on(documents, frame([], "doc_id long, toxic int"))
    assert {r["toxicity"] for r in toxicity.score_documents(documents, none).collect()} == {0.0}
    assert toxicity.score_documents(frame([]), none).collect() == []
