"""Token counts and packing against the tokenizers themselves."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer, models  # noqa: E402

from timelens.llm import pack, token_counts  # noqa: E402

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = st.text(alphabet="abthe ,.'1 9é漢😀\n\t ▁sZ<|>", max_size=50)


@pytest.fixture(scope="module")
def auto():
    return token_counts.automaton(PIECES)


@pytest.fixture(scope="module")
def unigram():
    vocabulary = token_counts.read_vocabulary(PIECES)
    return Tokenizer(models.Unigram([("<unk>", 0.0), *vocabulary.items()], 0, False))


def count(unigram, text):
    if not text:
        return 0
    spaced = "▁" + text.replace(" ", "▁")
    found = unigram.encode(spaced)
    return sum(1 if i else len(spaced[a:b].encode()) for i, (a, b) in zip(found.ids, found.offsets, strict=True))


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXTS, max_size=4))
def test_counts_match_the_tokenizer(texts):
    auto = token_counts.automaton(PIECES)
    counts, _ = token_counts.count_texts(auto, pa.array(texts, pa.string()))
    tokenizer = Tokenizer(models.Unigram([("<unk>", 0.0), *token_counts.read_vocabulary(PIECES).items()], 0, False)) if not hasattr(
        test_counts_match_the_tokenizer, "held") else test_counts_match_the_tokenizer.held
    test_counts_match_the_tokenizer.held = tokenizer
    assert counts.tolist() == [count(tokenizer, t) for t in texts]


def test_counts_of_long_parts_and_documents(auto, unigram, docs, frame):
    texts = ["x" * 900 + "é😀 b" * 200, "abc" * 400]
    assert token_counts.count_texts(auto, pa.array(texts))[0].tolist() == [count(unigram, t) for t in texts]
    out = token_counts.count_tokens(frame([(d, t, 5) for d, t in docs], "doc_id long, text string, n_tokens int"), PIECES)
    assert sorted(out.columns) == ["doc_id", "n_tokens", "text", "token_score"]
    assert all(r["n_tokens"] == count(unigram, r["text"]) for r in out.collect())
    assert token_counts.count_tokens(frame([]), PIECES).collect() == []


def test_ties_follow_the_tokenizer():
    vocabulary = {"▁": -1.0, "a": -2.0, "b": -2.0, "ab": -4.0, "ba": -4.0, "aba": -6.0, "▁a": -3.0}
    auto = token_counts.Automaton(vocabulary)
    tokenizer = Tokenizer(models.Unigram([("<unk>", -1.0), *vocabulary.items()], 0, False))
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice("ab ") for _ in range(rng.randint(1, 12)))
        assert token_counts.count_texts(auto, pa.array([text]))[0][0] == len(tokenizer.encode("▁" + text.replace(" ", "▁")).ids), text


def test_vocabularies_that_cannot_be_split_are_refused():
    with pytest.raises(ValueError):
        token_counts.Automaton({"a▁b": -1.0})
    with pytest.raises(ValueError):
        token_counts.Automaton({"a": -1.5})


@pytest.mark.parametrize("long", [1, 1 << 15])
def test_vocabularies_that_cannot_be_split_are_counted_over_the_whole_text(monkeypatch, long):
    monkeypatch.setattr(token_counts, "LONG_TEXT", long)
    vocabulary = {"▁": -1.25, "a": -2.1, "b": -2.7, "é": -3.3, "a▁b": -3.9, "ab": -4.4, "b\na": -4.05, "▁▁": -2.3, "▁ab": -5.15, "▁b▁": -4.2}
    auto = token_counts.Automaton(vocabulary, whole=True)
    tokenizer = Tokenizer(models.Unigram([("<unk>", 0.0), *vocabulary.items()], 0, False))
    rng = random.Random(4)
    texts = ["".join(rng.choice("aab b \né漢") for _ in range(rng.randint(0, 30))) for _ in range(300)] + ["ab a" * 900, None]
    assert token_counts.count_texts(auto, pa.array(texts))[0].tolist() == [count(tokenizer, t) for t in texts]


def test_a_trained_unigram_model_is_counted(frame, docs, tmp_path):
    import sentencepiece
    path = str(tmp_path / "unigram")
    sentencepiece.SentencePieceTrainer.train(
        sentence_iterator=iter([x for _, t in docs for x in (t or "").split("\n")]), model_prefix=path, vocab_size=300,
        model_type="unigram", hard_vocab_limit=False, minloglevel=2)
    vocabulary = token_counts.read_vocabulary(f"{path}.model")
    assert not token_counts.falls_apart(vocabulary)
    tokenizer = Tokenizer(models.Unigram([("<unk>", 0.0), *vocabulary.items()], 0, False))
    got = token_counts.count_tokens(frame(docs), f"{path}.model").collect()
    assert [r["n_tokens"] for r in got] == [count(tokenizer, r["text"]) for r in got] and len(got) == len(docs)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_units_give_the_ids_of_the_whole_text(text):
    held = test_units_give_the_ids_of_the_whole_text.__dict__.setdefault("held", {})
    if not held:
        held["t"] = Tokenizer.from_file(BPE)
        held["t"].encode_special_tokens = True
    ids = np.frombuffer(pack.unit_encoder(BPE).encode(text), "<u4").tolist()
    assert ids == held["t"].encode(text, add_special_tokens=False).ids


def test_pieces_give_every_id_once(docs, frame):
    tokenizer = Tokenizer.from_file(BPE)
    tokenizer.encode_special_tokens = True
    rows = [(k, t) for k, (_, t) in enumerate(docs)]
    found = pack.digest_pieces(pack.pack_documents(frame([(d, t, 1) for d, t in rows], "doc_id long, text string, start int"), BPE, capacity=128)).collect()
    by_doc, by_window = {}, {}
    for r in found:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_window.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == {d for d, _ in rows}
    for doc_id, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(by_doc[doc_id], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at:at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for pieces in by_window.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 128
    assert sum(r["length"] for r in found) > 0.9 * 128 * len(by_window)


def test_differencing_is_near_equal_and_raises_the_count():
    rng = random.Random(4)
    sizes = [rng.randint(1, 60) for _ in range(200)]
    sets = pack.difference(sizes, 10)
    sums = [sum(sizes[i] for i in s) for s in sets]
    assert sorted(i for s in sets for i in s) == list(range(200)) and max(sums) - min(sums) <= 2
    assert pack.difference([], 3) == [[], [], []]
    tight = pack.partition([60, 60, 60], 100)
    assert sorted(map(len, tight)) == [1, 1, 1]


def test_no_documents_no_pieces(frame):
    assert pack.digest_pieces(pack.pack_documents(frame([]), BPE)).collect() == []


def test_checksums_need_no_second_python_worker(frame):
    found = pack.digest_pieces(pack.pack_documents(frame([(1, "one two"), (2, None)]), BPE))
    assert found.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert found.schema["ids_crc32"].dataType.simpleString() == "bigint"
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
