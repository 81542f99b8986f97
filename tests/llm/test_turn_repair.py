"""Repair of conversations against an exhaustive search of edits, row by row."""

import hashlib
import random
import re
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from timelens.llm import queries, turn_repair as tr

SPACE = " \t\n\v\f\r"


def faults(rows):
    """(role, text, fault) of rows in order."""
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(SPACE)
        out.append((role, text, "blank" if not bare else "duplicate" if (role, text) in seen
                    else "truncated" if bare[-1] not in ".!?" else ""))
        seen.add((role, text))
    return out


def brute_edits(rows):
    """Least (cost, letters, repaired rows) by a table over rows and the roles so far, best letters first."""
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def inserted(best):
        for _ in range(4):
            for state, (cost, letters, out) in list(best.items()):
                for r in ("user", "assistant"):
                    to = after.get((state, r[0]))
                    new = (cost + 2, letters + "I", [*out, (r, "")])
                    if to and (to not in best or new[:2] < best[to][:2]):
                        best[to] = new
        return best

    best = inserted({"": (0, "", [])})
    for role, text, fault in rows:
        then = {}

        def offer(to, new):
            if to is not None and (to not in then or new[:2] < then[to][:2]):
                then[to] = new

        more = int(fault == "truncated")
        for state, (cost, letters, out) in best.items():
            offer(state, (cost + 3, letters + "D", out))
            if fault not in ("blank", "duplicate"):
                offer(after.get((state, role[:1] or " ")), (cost + more, letters + "K", [*out, (role, text)]))
                for r in ("user", "assistant"):
                    offer(after.get((state, r[0])), (cost + 2 + more, letters + "R", [*out, (r, text)]))
        best = inserted(then)
    return min(best[q] for q in ("", "a") if q in best)


def brute(rows):
    """The digest row of every conversation from (conv_id, turn, role, text)."""
    space = lambda x: " " if x is None else str(x)
    found = {}
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        held = found.setdefault(conv, [])
        text = "" if kind == 1 else re.sub("[.!?]", "", space(text)) if kind == 2 else space(text)
        row = (turn is not None, turn or 0, "user" if kind == 4 else space(role), hashlib.sha256(text.encode()).digest(), text)
        held += [row] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv, held in found.items():
        held.sort()
        turns = [r[1] for r in held if r[0]]
        marked = faults([(r[2], r[4]) for r in held])
        names = [m[2] for m in marked]
        initials = [r[2][:1] or " " for r in held]
        cost, audit, repaired = brute_edits(marked)
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, names.count("blank"), names.count("duplicate"),
            names.count("truncated"), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest())
    return out


def fixture_rows(seed=3):
    rng = random.Random(seed)
    texts = ["Fine.", "What?", "cut off", " \t\n", "", None, "a. b! c?", "é漢 ends!", "ends. \r\n", "x" * 3000 + "."]
    rows = []
    for conv in [*range(60), None]:
        turns = [rng.choice([None, k, k, k, k + 3, 1]) for k in range(rng.choice([0, 1, 2, 5, 9, 14]))]
        rows += [(conv, t, rng.choice(["user", "assistant"] * 4 + ["system", "tool", None, ""]), rng.choice(texts)) for t in turns]
    rows += [(900, k, "user", "Again.") for k in range(700)] + [(901, 5, "assistant", "Same.")] * 300
    rows += [(902, k, ("user", "assistant")[k % 2], f"Turn {k}" + "." * (k % 5 > 0)) for k in range(900)]
    return rows


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("sua-"), st.sampled_from(".xt"), st.integers(1, 9)), max_size=9))
def test_runs_give_the_least_letters_at_the_least_cost(runs):
    names = {"s": "system", "u": "user", "a": "assistant", "-": "tool"}
    fault = {".": "", "x": "blank", "t": "truncated"}
    rows = [(names[r], "", fault[f]) for r, f, n in runs for _ in range(n)]
    assert tr.cheapest_edits([(r + f, n) for r, f, n in runs], tr.Powers()) == brute_edits(rows)[:2]


def test_long_runs_take_few_products():
    powers = tr.Powers()
    cost, audit = tr.cheapest_edits([("u.", 100_000), ("ax", 70_000)], powers)
    assert cost == 100_000 + 3 * 70_000  # every other turn becomes the assistant's
    assert len(audit) - audit.count("I") == 170_000
    assert max(map(len, powers.values())) <= 17


def digests(rows, frame, **kw):
    damaged = tr.damage(frame(rows, **kw))
    return {r["conv_id"]: tuple(r)[1:] for r in tr.with_digests(*tr.repair_conversations(damaged)).collect()}


def test_conversations_match_brute_force(frame):
    rows = fixture_rows()
    got = digests([(*r, "extra", 7) for r in rows], frame,
                  schema="conv_id long, turn long, role string, text string, audit string, place int")
    assert got == brute(rows)
    assert sum(v[6] == "" for v in got.values()) > 0


def test_ids_of_text_and_empty_table(frame):
    rows = [(f"c{c}" if c is not None else None, t, r, x) for c, t, r, x in fixture_rows(4)[:200]]
    assert digests(rows, frame, schema="conv_id string, turn int, role string, text string") == brute(rows)
    assert digests([], frame, schema="conv_id long, turn long, role string, text string") == {}


def test_repaired_rows_are_in_order(frame):
    rows = fixture_rows(8)
    _, repaired = tr.repair_conversations(tr.damage(frame(rows, "conv_id long, turn long, role string, text string")))
    held = {}
    for r in repaired.collect():
        held.setdefault(r["conv_id"], []).append(r)
    assert held
    for found in held.values():
        found.sort(key=lambda r: r["place"])
        assert [r["place"] for r in found] == list(range(len(found)))
        assert re.fullmatch("s?(ua)+", "".join(r["role"][0] for r in found))
        assert all((r["edit"] == "I") == (r["turn"] is None and r["text"] == "") or r["turn"] is None for r in found)


def test_query_on_the_given_tables(spark, tmp_path):
    rows = fixture_rows(11)
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.QUERIES["op12_turn_repair"](spark, str(tmp_path))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == brute(rows)
