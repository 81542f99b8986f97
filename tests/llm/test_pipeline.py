"""The corpus pipeline, stage by stage and as a whole, against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

import corpus_pipeline  # noqa: E402
from timelens.llm import toxicity  # noqa: E402

from .conftest import corpus, lower, sentence, words  # noqa: E402

# the extra columns have names the stages use themselves
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars", "row", "removed", "toxicity", "row_key", "chars_before", "component_id", "n_hit")
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, row string, removed string, toxicity double, "
          "row_key int, chars_before int, component_id string, n_hit int")
BENCHMARK = [(1, "x " + " ".join(f"bench{k}" for k in range(14))), (2, "short item"), (3, None), (None, "alpha"), (4, "")]


def fixture_rows():
    rng = random.Random(9)
    texts = corpus(n=40)
    texts += [(2000 + i, sentence(rng, 12) + " grubzel fnord grubzel " * 3 + sentence(rng, 3)) for i in range(24)]
    texts += [(3000 + i, sentence(rng, 20) + " " + " ".join(f"Bench{k}" for k in range(i, i + 11))) for i in range(5)]
    texts += [(3100, "a first line\nshared words\n"), (3101, "shared words"), (3102, " \n"), (3103, sentence(rng, 9) + "\nshared words\nShort item")]
    return [(d, t, "en", None, None if k % 7 == 3 else 10**7 + k, "r", "x", 0.75, k, -k, "c", 1) for k, (d, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    rows = fixture_rows()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(d, 80, int("grubzel" in (t or ""))) for d, t, *_ in rows if d is not None and d < 3000 and d % 5 != 2] + [(None, 1, 1), (77777, 1, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(BENCHMARK, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def brute_toxicity(rows, model):
    return [r for r in rows if toxicity.score_texts(model, pa.array([r[1]], pa.string()))[0][0] < 0.5]


def brute_lines(rows):
    lines = [((r[0] is not None, r[0] or 0, k), frozenset(words(x)), r[:2]) for r in rows for k, x in enumerate((r[1] or "").split("\n"))]
    gone = {}
    for place, tokens, name in lines:
        if tokens and any(o < place and 4 * len(tokens & s) >= 3 * len(tokens | s) for o, s, _ in lines):
            gone.setdefault(name, set()).add(place[2])
    out = []
    for r in rows:
        if r[:2] in gone:
            text = "\n".join(x for k, x in enumerate(r[1].split("\n")) if k not in gone[r[:2]])
            if words(text):
                out.append((r[0], text, *r[2:4], len(text), *r[5:]))
        else:
            out.append(r)
    return out


def brute_near(rows):
    def shingles(text):
        w = words(text)
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, group = [shingles(r[1]) for r in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 4 * len(sets[i] & sets[j]) >= 3 * len(sets[i] | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    least = {}
    for r, s, g in zip(rows, sets, group):
        if s:
            least[g] = min(least.get(g, (True, 0)), (r[0] is None, r[0] or 0))
    out, seen = [], set()
    for r, s, g in zip(rows, sets, group):
        if not s or (r[0] is None, r[0] or 0) == least[g] and g not in seen:
            out.append(r)
            seen |= {g} if s else set()
    return out


def brute_contaminated(rows):
    def read(text):
        return re.findall(rb"[0-9a-z\x80-\xff]+", lower(text))

    windows = {tuple(w[s:s + 10]) for i, t in BENCHMARK if i is not None and (w := read(t)) for s in range(max(1, len(w) - 9))}
    sizes = {len(w) for w in windows}
    return [r for r in rows if not any(tuple(w[p:p + n]) in windows for w in [read(r[1])] for n in sizes for p in range(len(w) - n + 1))]


def named(rows):
    """Rows to compare; of rows that repeat id and text, any one may stay, so what tells them apart is left out."""
    return Counter((r[0], r[1], r[2], r[3], None if r[0] == 1007 else r[4], *r[5:8], *([0, 0] if r[0] == 1007 else r[8:10]), *r[10:]) for r in map(tuple, rows))


def check_pieces(pieces, rows):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    by_doc, by_window = {}, {}
    for r in pieces:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_window.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == {r[0] for r in rows}
    for doc_id, texts in ((d, [r[1] for r in rows if r[0] == d]) for d in by_doc):
        ids = [np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for t in texts]
        assert sum(r["length"] for r in by_doc[doc_id]) == sum(map(len, ids))
        if len(ids) == 1:
            at = 0
            for r in sorted(by_doc[doc_id], key=lambda r: r["start"]):
                assert r["start"] == at and r["ids_crc32"] == zlib.crc32(ids[0][at:at + r["length"]].tobytes())
                at += r["length"]
    for window in by_window.values():
        at = 0
        for r in sorted(window, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024


def test_stages_and_run_match_brute_force(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    model = toxicity.train_on(docs, spark.read.parquet(f"{tables}/labels.parquet"))
    want = [lambda rows: brute_toxicity(rows, model), brute_lines, brute_near, brute_contaminated]
    rows = fixture_rows()
    for (name, stage), brute in zip(corpus_pipeline.STAGES[:-1], want):
        out, expected = stage(spark, docs, tables), brute(rows)
        assert tuple(out.columns) == COLUMNS and out.dtypes == docs.dtypes, name
        assert named(out.collect()) == named(expected), name
        assert len(expected) < len(rows), f"{name} has nothing to do"
        rows, docs = expected, spark.createDataFrame(expected, SCHEMA).repartition(3)
    left = {r[0] for r in rows}
    assert {None, 1000, 1001, 1002, 3100, 3102} <= left and not left & {1004, 3000, 3101, 3103}
    check_pieces(corpus_pipeline.STAGES[-1][1](spark, docs, tables).collect(), rows)
    check_pieces(corpus_pipeline.run(spark, tables).collect(), rows)


def test_an_empty_table_gives_no_windows(spark, tables, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tables}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
