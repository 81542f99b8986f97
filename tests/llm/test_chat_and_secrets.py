import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from timelens.llm import chat, credentials

TEXT = st.lists(st.sampled_from(["<", "s", ">", "/", "[", "]", "I", "N", "T", "S", "\\", " ", "\n", "é", "[INST]", "</s>", "<<SYS>>", "<</ROLE>>"]), max_size=25).map("".join)


@settings(max_examples=400, deadline=None)
@given(TEXT, st.one_of(st.none(), st.sampled_from(["user", "assistant", "system", "tool", ""]), TEXT))
def test_turns_come_back_and_control_strings_do_not_occur(text, role):
    escaped = chat.escape_text(text)
    assert not any(c in escaped for c in chat.INSTRUCT.control)
    assert chat.unescape_text(escaped) == text
    segments = [{"text": t, "loss": on} for t, on in chat.format_turn(role, text)]
    assert chat.read_turn(segments) == (role, text)
    assert [chat.unescape_text(s["text"]) for s in segments if s["loss"]] == ([text] if role == "assistant" else [])


def test_machine_marks_turns_out_of_order():
    def walk(roles):
        state, out = chat.START, []
        for r in roles:
            state, fine = chat.step(state, r)
            out.append(fine)
        return out

    assert walk(["system", "user", "assistant", "user", "assistant"]) == [True] * 5
    assert walk(["assistant", "user"]) == [False, True]
    assert walk(["user", "user", "system", "tool", None, "user"]) == [True, False, False, False, False, True]


def test_conversations(frame):
    rows = [(1, 1, "assistant", "yes"), (1, 0, "user", None), (2, 0, "user", "a"), (2, 0, "user", "a"), (2, None, "robot", "b"),
            (None, 0, None, "</s>"), (3, 0, "assistant", "")]
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(frame(
        [(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, segments int"))).collect()}
    assert got[1]["turns_sha256"] == hashlib.sha256(b"user\n\nassistant\nyes\n").hexdigest()
    assert (got[1]["loss_chars"], got[1]["loss_sha256"], got[1]["valid"]) == (3, hashlib.sha256(b"yes").hexdigest(), True)
    assert (got[2]["n_turns"], got[2]["valid"]) == (3, False)
    assert got[2]["turns_sha256"] == hashlib.sha256(b"robot\nb\nuser\na\nuser\na\n").hexdigest()
    assert got[None]["turns_sha256"] == hashlib.sha256(b"\n</s>\n").hexdigest()
    assert (got[3]["loss_chars"], got[3]["valid"]) == (0, False)
    assert chat.read_back(chat.format_conversations(frame([], "conv_id long, turn long, role string, text string"))).collect() == []


ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)


def base(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_base_spans_match_the_patterns(frame):
    key, digest = "AKIA" + "X7" * 9, "0123456789abcdef" * 2
    texts = [None, "", "no secrets", "password=hunter2", "token= token:abcdefgh", "é漢 API_KEY : 'a.b-c=d'", f"{key} {key} 漢{digest}",
             "secret=short secret=longer1", f"token={digest}", f"AKIAAKIA{'Z' * 20}", "AKIA" + "1" * 15, "passwd\n=abcdefgh",
             "Pass" + "word\"  =  \"abcdef\"", "apikey=secret=abcdef", "tokeN:" + "=" * 7]
    texts += [f"{i} password={'x' * i} {key}" for i in range(9)]
    got = credentials.scan_secrets(frame([(i, f"src{i % 4}", t, 1) for i, t in enumerate(texts)],
                                         "doc_id long, source string, text string, base int")).collect()
    assert len(got) == len(texts)
    for r in got:
        assert [(s["start"], s["rank"], s["end"]) for s in r["base"]] == base(texts[r["repository"]]), r
        assert set(map(tuple, r["base"])) <= set(map(tuple, r["spans"]))


def test_owners_separate_examples_from_live_ones(frame):
    live, copied = "Zk9-live_only_by_one_owner", "Zk9-everybody_has_this_one"
    rows = [(1, "a", f"x {live} y"), (2, "a", f"again {live}"), (3, "a", copied), (4, "b", copied), (5, None, f"token={'q' * 8}"),
            (6, "a", f"token={'q' * 8}"), (6, "a", f"token={'q' * 8}"), (7, "b", "password=only_here_77")]
    got = {r["repository"]: r for r in credentials.scan_secrets(frame(rows, "doc_id long, source string, text string")).collect()}
    assert [(s["start"], s["rank"], s["end"]) for s in got[1]["spans"]] == [(2, 3, 2 + len(live))]
    assert (got[1]["n_live"], got[1]["n_copied"]) == (1, 0) and got[2]["n_live"] == 1
    assert got[3]["spans"] == [] and got[4]["n_copied"] == 0
    assert (got[5]["n_live"], got[5]["n_copied"], len(got[5]["spans"])) == (0, 1, 1)
    assert (got[7]["n_live"], got[7]["n_copied"]) == (1, 0)
    assert credentials.scan_secrets(frame([], "doc_id long, source string, text string")).collect() == []


def test_scan_stays_native(frame):
    plan = credentials.scan_secrets(frame([(1, "a", "token=abcdefg")], "doc_id long, source string, text string"))
    text = plan._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", text)
