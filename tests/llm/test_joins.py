"""Line dedup and near duplicates against brute force, and their defined cases."""

import random

import numpy as np
import pytest

from timelens.llm import line_dedup, near_duplicates
from timelens.llm.similar import Sets, digests, distinct_elements

from .conftest import sentence, words


def shingle_set(text):
    w = words(text)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    sets = [shingle_set(t) for _, t in rows]
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                group[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets)) if d is not None)


def test_components_match_brute_force(docs, frame):
    got = near_duplicates.find_components(frame(docs)).where("doc_id IS NOT NULL").collect()
    assert sorted(map(tuple, got)) == brute_components(docs)


def test_components_of_a_crowd_of_near_copies_and_a_chain(frame, monkeypatch):
    import random
    rng = random.Random(1)
    base = sentence(rng, 120).split(" ")
    rows = []
    for i in range(80):
        text = list(base)
        for _ in range(rng.randint(0, 4)):
            text[rng.randrange(120)] = f"edit{rng.randint(0, 9)}"
        rows.append((i, " ".join(text)))
    chain = [f"w{k}" for k in range(200)]
    rows += [(200 + i, " ".join(chain[6 * i:6 * i + 60])) for i in range(20)]
    monkeypatch.setattr(near_duplicates, "CELLS", 3)
    got = near_duplicates.find_components(frame(rows)).collect()
    assert sorted(map(tuple, got)) == brute_components(rows)


def test_members_that_fit_no_other_of_their_region_leave_it(frame, monkeypatch):
    rng = random.Random(4)
    long = [sentence(rng, 1200) for _ in range(6)]
    near = long[0].split(" ")
    near[5:15] = [f"edit{k}" for k in range(10)]
    texts = [*long, " ".join(near)]
    blobs = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(blobs), np.uint8)
    sets = near_duplicates.document_sets(data, np.cumsum([0, *map(len, blobs)]))
    prints = near_duplicates.set_prints(sets)
    schema = "region long, digest long, n long, " + ", ".join(f"{c} long" for c in near_duplicates.PRINTS)
    rows = [(r, i, int(sets.sizes[i]), *map(int, prints[i])) for r, some in ((1, range(7)), (2, range(1, 6)), (3, (0, 6))) for i in some]
    members = frame(rows, schema)
    monkeypatch.setattr(near_duplicates, "MET", 6)  # region 1 is larger
    got = sorted((r[0], r[1]) for r in near_duplicates._partnered(members).collect())
    assert got == [*((1, i) for i in range(7)), (3, 0), (3, 6)]


def test_members_that_fit_their_own_component_only_leave_their_region(frame):
    schema = "region long, digest long, n long, component long, " + ", ".join(f"{c} long" for c in near_duplicates.PRINTS)
    alike = [0] * near_duplicates.PRINT
    other = [-1] * near_duplicates.PRINT
    rows = [(1, 10, 100, 10, *alike), (1, 11, 100, 10, *alike), (1, 12, 100, 12, *other),
            (2, 20, 100, 20, *alike), (2, 21, 100, 20, *other), (2, 22, 100, 22, *alike)]
    got = near_duplicates._partnered(frame(rows, schema))
    assert got.columns == schema.replace(" long", "").split(", ")
    assert sorted((r[0], r[1]) for r in got.collect()) == [(2, 20), (2, 22)]


def test_regions_of_one_group_are_merged(frame):
    rows = [(r, d, 50, 1) for r, some in ((7, (1, 2, 3)), (8, (2, 3, 4)), (9, (3, 4)), (5, (5, 6))) for d in some]
    got = near_duplicates._merged(frame(rows, "region long, digest long, n long, shared long")).collect()
    assert sorted(map(tuple, got)) == [(3, 1, 50, 1), (3, 2, 50, 2), (3, 3, 50, 3), (3, 4, 50, 2), (6, 5, 50, 1), (6, 6, 50, 1)]


def test_further_links_join_components(frame):
    schema = "a long, b long"
    first, more = [(9, 2), (2, 5), (7, 8), (20, 21)], [(8, 5), (30, 31), (9, 5), (31, -4)]
    names = near_duplicates.with_links(near_duplicates.components(frame(first, schema)), frame(more, schema))
    assert sorted(map(tuple, names.collect())) == [(5, 2), (7, 2), (8, 2), (9, 2), (21, 20), (30, -4), (31, -4)]
    assert sorted(map(tuple, near_duplicates.with_links(names, frame([(7, 9)], schema)).collect())) == sorted(map(tuple, names.collect()))
    assert "Generate" not in near_duplicates.components(frame(first, schema))._jdf.queryExecution().toString()


def test_components_split_hot_shingles(docs, frame, monkeypatch):
    monkeypatch.setattr(near_duplicates, "HOT", 4)
    monkeypatch.setattr(near_duplicates, "CHUNK", 3)
    got = near_duplicates.find_components(frame(docs)).where("doc_id IS NOT NULL").collect()
    assert sorted(map(tuple, got)) == brute_components(docs)


def test_keep_one_keeps_columns_and_the_least_id(docs, frame):
    rows = [(d, t, k, 7) for k, (d, t) in enumerate(docs)]
    frame_ = frame(rows, "doc_id long, text string, component_id long, row_key int")
    kept = near_duplicates.keep_one(frame_)
    assert kept.columns == ["doc_id", "text", "component_id", "row_key"]
    got = sorted(((r[0] is None, r[0] or 0, r[1] or "") for r in kept.collect()))
    best = {d: c for d, _, c in brute_components(docs)}
    want = [(False, d, t or "") for d, t in dict.fromkeys(docs) if d is not None and best[d] == d and shingle_set(t)]
    want += [(False, d, t or "") for d, t in docs if d is not None and not shingle_set(t)] + [(True, 0, t) for d, t in docs if d is None]
    assert got == sorted(want)


def brute_lines(rows):
    lines = []
    for doc_id, text in rows:
        for k, line in enumerate(text.split("\n") if text is not None else []):
            tokens = frozenset(words(line))
            if len(tokens) >= line_dedup.LEAST_WORDS:
                lines.append(((doc_id is not None, doc_id or 0, k), tokens, (doc_id, text)))
    gone = {}
    for place, tokens, row in lines:
        for other, theirs, _ in lines:
            if other < place and 4 * len(tokens & theirs) >= 3 * len(tokens | theirs):
                gone.setdefault(row, set()).add(place[2])
    return gone


def expected_lines(rows):
    gone = brute_lines(rows)
    return sorted(((d is not None, d or 0), 0 if t is None else len(t.split("\n")), sorted(gone.get((d, t), ()))) for d, t in rows)


@pytest.mark.parametrize("crowd, kept", [(256, 4), (3, 1)])
def test_lines_match_brute_force(docs, frame, monkeypatch, crowd, kept):
    monkeypatch.setattr(line_dedup, "CROWD", crowd)
    monkeypatch.setattr(line_dedup, "KEPT", kept)
    got = line_dedup.mark_lines(frame(docs)).collect()
    assert sorted(((r[0] is not None, r[0] or 0), r[1], r[2]) for r in got) == expected_lines(docs)


def test_short_lines_match_brute_force_without_a_least_size(docs, frame):
    import random
    rng = random.Random(3)
    rows = [(2000 + i, "\n".join(" ".join(rng.choice("a b C d e f".split()) for _ in range(rng.randint(0, 5))) for _ in range(6)))
            for i in range(30)]
    rows += [(3000, "All rights reserved."), (3001, "x\nAll rights reserved.\n\n "), (3002, "la la " * 60), (3003, "la la " * 60)] + docs
    lines = [((d is not None, d or 0, k), frozenset(words(line)), (d, t)) for d, t in rows for k, line in enumerate((t or "").split("\n"))]
    gone = {}
    for place, tokens, row in lines:
        if tokens and any(o < place and 4 * len(tokens & s) >= 3 * len(tokens | s) for o, s, _ in lines):
            gone.setdefault(row, set()).add(place[2])
    got = line_dedup.mark_lines(frame(rows)).collect()
    want = [((d is not None, d or 0), 0 if t is None else len(t.split("\n")), sorted(gone.get((d, t), ()))) for d, t in rows]
    assert sorted(((r[0] is not None, r[0] or 0), r[1], r[2]) for r in got) == sorted(want)
    assert {3001, 3003} <= {d for d, _ in gone}


def test_similar_lines_that_just_miss_are_all_tried(frame, monkeypatch):
    monkeypatch.setattr(line_dedup, "KEPT", 1)
    base = [f"t{k}" for k in range(24)]
    rows = [(i, " ".join(base[:18] + [f"u{i}_{k}" for k in range(6)])) for i in range(12)]
    rows += [(50 + i, " ".join(base[:21] + [f"u{i}_{k}" for k in range(3)])) for i in range(12)]
    got = line_dedup.mark_lines(frame(rows)).collect()
    assert sorted(((r[0] is not None, r[0] or 0), r[1], r[2]) for r in got) == expected_lines(rows)


def test_the_second_pass_starts_from_the_wanted_sets(monkeypatch):
    import numpy as np
    from timelens.llm.similar import flagged
    rng = np.random.default_rng(6)
    n = 4000  # one crowded token
    columns = [np.zeros(n, np.uint64), rng.permutation(n).astype(np.int64), rng.integers(5, 40, n).astype(np.uint32),
               np.zeros(n, np.uint32), np.zeros(n, np.uint64), rng.integers(0, 50, n), np.arange(n, dtype=np.uint32)]
    met = line_dedup._Meeting(columns)
    wanted = np.zeros(1 << 22, bool)
    wanted[rng.integers(0, len(wanted), len(wanted) // 1000)] = True
    asked = np.flatnonzero(flagged(met.digest, wanted))
    assert 0 < len(asked) < 40
    seen = []
    passing = met.passing
    monkeypatch.setattr(met, "passing", lambda i, j: seen.append(len(i)) or passing(i, j))
    got = {p for y, x in met.pairs(wanted, 2) for p in zip(y.tolist(), x.tolist())}
    assert sum(seen) <= len(asked) * n
    y, x = np.repeat(asked, n), np.tile(np.arange(n), len(asked))
    good = (met.rank[x] < met.rank[y]) & passing(y, x)
    assert got == set(zip(y[good].tolist(), x[good].tolist())) and got


def test_dropping_lines_keeps_columns_and_other_lines(docs, frame):
    rows = [(t, d, "x", 1) for d, t in docs]
    out = line_dedup.drop_repeated_lines(frame(rows, "text string, doc_id long, removed string, row_key int"))
    assert out.columns == ["text", "doc_id", "removed", "row_key"]
    gone = brute_lines(docs)
    want = [(d, t if t is None or (d, t) not in gone else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[d, t]))
            for d, t in docs]
    key = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "")
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=key) == sorted(want, key=key)


def test_empty_tables(frame):
    assert near_duplicates.find_components(frame([])).collect() == []
    assert near_duplicates.keep_one(frame([])).collect() == []
    assert line_dedup.mark_lines(frame([])).collect() == []


def test_elements_of_more_sets_than_a_key_holds():
    """Five million sets in one slice, and elements that differ in their lowest bits only."""
    count = 5_000_000
    of = np.repeat(np.arange(count), 2)
    elements = np.tile(np.array([7 << 40, 3 << 40], np.uint64), count)
    got_of, got = distinct_elements(of, elements)
    assert np.array_equal(got_of, of) and np.array_equal(got, np.tile(np.array([3 << 40, 7 << 40], np.uint64), count))
    each = np.arange(count)
    names = digests(Sets(each, each, each, each, got_of, got))
    assert len(np.unique(names)) == 1
    near = np.array([9, 8, 9, 8, 9, 5], np.uint64)
    for of, want_of, want in (([0] * 6, [0, 0, 0], [5, 8, 9]), ([1, 0, 1, 0, 0, 0], [0, 0, 0, 1], [5, 8, 9, 9])):
        got_of, got = distinct_elements(np.array(of), near)
        assert (got_of.tolist(), got.tolist()) == (want_of, want)


def test_long_lines_that_share_a_token_are_told_apart_by_wider_parities():
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{k}" for k in [0, *rng.choice(np.arange(1, 2000), 149, replace=False)]) for _ in range(60)]
    near = texts[0].split(" ")
    texts.append(" ".join([*near[:-10], *(f"v{k}" for k in range(10))]))
    data = np.frombuffer("\n".join(texts).encode(), np.uint8)
    sets = line_dedup.line_sets(data, np.array([0, len(data)]))
    n = len(sets.rows)
    words, width = line_dedup.parities(sets)
    assert n == 61 and (width == line_dedup.WIDE).all()
    columns = [np.zeros(n, np.uint64), digests(sets), sets.sizes, np.zeros(n, np.int64), words, np.zeros(n, np.int64), np.arange(n)]
    met = line_dedup._Meeting(columns)
    got = [(met.numbers[y], met.numbers[x]) for a, b in met.pairs(None, 2) for y, x in zip(a, b)]
    assert got == [(60, 0)]


@pytest.mark.parametrize("spare", [0, 256])
def test_a_set_whose_first_pairs_fail_has_others(frame, monkeypatch, spare):
    """Doubtful pairs are kept beside the first ones, and with none kept the second pass has them all."""
    passes = []
    monkeypatch.setattr(line_dedup, "KEPT", 1)
    monkeypatch.setattr(line_dedup, "SPARE", spare)
    monkeypatch.setattr(line_dedup._Meeting, "likely", lambda self, i, j: np.zeros(len(i), bool))
    monkeypatch.setattr(line_dedup._Meeting, "passing", lambda self, i, j: np.ones(len(i), bool))
    prefix_tokens = line_dedup.flags
    monkeypatch.setattr(line_dedup, "flags", lambda *a, **k: passes.append(1) or prefix_tokens(*a, **k))
    base = [f"t{k}" for k in range(24)]
    rows = [(i, " ".join(base[:18] + [f"u{i}_{k}" for k in range(6)])) for i in range(12)]
    rows += [(50 + i, " ".join(base[:21] + [f"u{i}_{k}" for k in range(3)])) for i in range(12)]
    got = line_dedup.mark_lines(frame(rows)).collect()
    assert sorted(((r[0] is not None, r[0] or 0), r[1], r[2]) for r in got) == expected_lines(rows)
    assert bool(passes) == (spare == 0)


@pytest.mark.parametrize("listed", [0, 512])
def test_few_unsure_sets_meet_the_lines_of_every_slice(frame, monkeypatch, listed):
    """The second pass of a few sets looks for no tokens, that of more does; both have all pairs."""
    scans = []
    monkeypatch.setattr(line_dedup, "KEPT", 1)
    monkeypatch.setattr(line_dedup, "SPARE", 0)
    monkeypatch.setattr(line_dedup, "LISTED", listed, raising=False)
    monkeypatch.setattr(line_dedup._Meeting, "passing", lambda self, i, j: np.ones(len(i), bool))
    flags = line_dedup.flags
    monkeypatch.setattr(line_dedup, "flags", lambda *a, **k: scans.append("ids_of" in k) or flags(*a, **k))
    base = [f"t{k}" for k in range(24)]
    rows = [(i, "\n".join(["two words", " ".join(base[:18] + [f"u{i}_{k}" for k in range(6)])])) for i in range(12)]
    rows += [(50 + i, " ".join(base[:21] + [f"u{i}_{k}" for k in range(3)])) for i in range(12)]
    rows += [(None, " ".join(base[:21] + ["u0_0", "u0_1"])), (70, " ".join(f"w{k}" for k in range(150)))]
    got = line_dedup.mark_lines(frame(rows)).collect()
    assert sorted(((r[0] is not None, r[0] or 0), r[1], r[2]) for r in got) == expected_lines(rows)
    assert scans and any(scans) == (not listed)


def test_texts_of_sets_are_read_at_one_place(frame):
    rows = [(i, f"{i}\nthe same line é\n\n the SAME line é ") for i in range(9)] + [(9, None), (10, ""), (10, "a\n"), (11, "a")]
    keyed = frame(rows).selectExpr("doc_id", "xxhash64(doc_id, text, 2) AS row_key", "text")
    packed = keyed.mapInArrow(lambda b: line_dedup._send(np.zeros(1 << 16, np.uint8), 4, None, b), line_dedup._PACKED)
    data = np.frombuffer("the same line é\na\n7".encode(), np.uint8)
    ids = digests(line_dedup.line_sets(data, np.array([0, len(data)]))).tolist()
    found, asked = line_dedup.line_texts(keyed, packed)(frame([(i,) for i in ids], "digest long"))
    texts = sorted(r["text"] for r in found.join(asked, "name").collect())
    assert [t.lower().strip() for t in texts] == ["7", "a", "the same line é"]


def test_sets_that_repeat_at_a_token_stay_at_their_first_place():
    rng = np.random.default_rng(2)
    n = 3000
    keys, digest = rng.integers(0, 40, n).astype(np.uint64), rng.integers(0, 30, n)
    sizes = (digest % 7 + 5).astype(np.uint32)
    docs, numbers = rng.integers(0, 500, n), rng.integers(0, 9, n).astype(np.uint32)
    met = line_dedup._Meeting([keys, digest, sizes, np.zeros(n, np.uint32), np.zeros(n, np.uint64), docs, numbers])
    want = {}
    for k, d, *place in zip(keys.tolist(), digest.tolist(), docs.tolist(), numbers.tolist()):
        want[k, d] = min(want.get((k, d), place), place)
    got = list(zip(met.keys.tolist(), met.digest.tolist()))
    assert len(got) == len(want) and dict(zip(got, zip(met.docs.tolist(), met.numbers.tolist()))) == {k: tuple(v) for k, v in want.items()}
    assert list(zip(met.keys.tolist(), met.sizes.tolist())) == sorted(zip(met.keys.tolist(), met.sizes.tolist()))
