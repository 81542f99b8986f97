from __future__ import annotations

import io
import json

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.errors import StreamingQueryException

from timelens.schemas import EVENTS
from timelens.sources import follow
from timelens.sources.follow import FollowReader, follow_lines
from timelens.sources.tables import read_table
from timelens.streaming import feeds


def brute(data: bytes, start: int, end: int, longest: int) -> list:
    """(position, line) of the finished lines that begin in the range."""
    out, at = [], 0
    for line in data.split(b"\n")[:-1]:
        if start <= at < end:
            out.append((at, None if len(line) + 1 > longest else line))
        at += len(line) + 1
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 12), max_size=12), st.integers(1, 9), st.lists(st.integers(0, 100), max_size=4))
def test_ranges_own_each_line_once(sizes, block, cuts):
    data = b"".join(bytes([97 + i % 26]) * n + b"\n" for i, n in enumerate(sizes)) + b"unfinished"
    last = follow.last_line_end(io.BytesIO(data), 0, len(data))
    assert last == len(data) - len("unfinished")
    edges = sorted({0, last, *(c for c in cuts if c < last)})
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(follow, "BLOCK", block)
        patch.setattr(follow, "LONGEST_LINE", 8)
        for a, b in zip(edges, edges[1:]):
            got = [(int(p), line) for at, lines in follow.whole_lines(io.BytesIO(data), a, b) for p, line in zip(at, lines)]
            assert got == brute(data, a, b, 8)


@given(st.binary(max_size=60), st.integers(0, 60), st.integers(1, 5))
def test_next_lines_are_counted(data, start, rows):
    start = min(start, len(data))
    ends = [i + 1 for i in range(start, len(data)) if data[i] == 10][:rows]
    assert follow.behind_lines(io.BytesIO(data), start, len(data), rows) == (ends[-1] if ends else start, len(ends))


def write(path, *lines, tail=""):
    with path.open("a") as out:
        out.write("".join(f"{line}\n" for line in lines) + tail)


def run(spark, folder, tmp_path, **options):
    stream = follow_lines(spark, str(folder), **options)
    feeds.ingest_journal(stream, str(tmp_path / "t"), str(tmp_path / "cp"), str(tmp_path / "rejects"), once=True).awaitTermination()
    rows = read_table(spark, str(tmp_path / "t"), EVENTS).collect()
    return sorted(r.message for r in rows)


def message(text):
    return json.dumps({"MESSAGE": text})


def test_a_growing_file_is_read_on_from_mid_file(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write(folder / "a", message("one"), "broken", tail='{"MESSAGE":"tw')
    assert run(spark, folder, tmp_path) == ["one"]
    write(folder / "a", 'o"}', message("three"))
    write(folder / "b", message("four"))
    write(folder / "_hidden", message("not this"))
    assert run(spark, folder, tmp_path) == ["four", "one", "three", "two"]
    assert run(spark, folder, tmp_path) == ["four", "one", "three", "two"]
    (folder / "a").write_text(message("x") + "\n")  # begun anew
    (folder / "b").unlink()
    assert run(spark, folder, tmp_path) == ["four", "one", "three", "two", "x"]
    assert [r.value for r in spark.read.parquet(str(tmp_path / "rejects")).collect()] == ["broken"]


def test_a_line_that_is_too_long_is_rejected_and_the_rest_read(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    room = follow.LONGEST_LINE - 1 - len(message(""))
    write(folder / "a", message("a" * room), message("b" * (room + 1)), message("c" * 3 * follow.LONGEST_LINE), message("end"))
    assert [m[:3] for m in run(spark, folder, tmp_path)] == ["aaa", "end"]
    assert [r.value for r in spark.read.parquet(str(tmp_path / "rejects")).collect()] == [None, None]
    with pytest.raises(StreamingQueryException, match="line above"):
        (tmp_path / "other").mkdir()
        run(spark, folder, tmp_path / "other", long_lines="fail")


def test_begin_now_and_bytes_that_are_no_text(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write(folder / "a", message("before"))
    assert run(spark, folder, tmp_path, begin="now") == []
    (folder / "a").open("ab").write(b'{"MESSAGE":"\xff"}\r\n')
    assert run(spark, folder, tmp_path, begin="now") == ["�"]


def test_an_empty_or_missing_folder_gives_no_lines(spark, tmp_path):
    assert run(spark, tmp_path / "none", tmp_path) == []


def test_flush_by_rows_or_time(tmp_path, monkeypatch):
    now = [100.0]
    monkeypatch.setattr(follow.time, "monotonic", lambda: now[0])
    write(tmp_path / "a", *"12345")
    write(tmp_path / "b", "1")
    reader = FollowReader({"path": str(tmp_path), "rows": "2", "wait": "2"})

    def step():
        start = reader.at or {"files": {}}
        end = reader.latestOffset()
        reader.partitions(start, end)
        return end["files"]

    assert step() == {"a": 4}
    assert step() == {"a": 8}
    now[0] += 1.9
    assert step() == {"a": 8}  # one line waits in each
    now[0] += 0.2
    assert step()["b"] == 2
    now[0] += 2
    assert step() == {"a": 10, "b": 2}
    same = reader.latestOffset()
    assert reader.latestOffset() is same


def test_what_piled_up_is_flushed_many_loads_a_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, n in (("a", 45), ("b", 23), ("c", 4)):
        write(tmp_path / "in" / name, *[message(f"{name}{i}") for i in range(n)])
    query = feeds.ingest_flushed(
        spark, str(tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "cp"), rows=5, wait=0.3)
    feeds.drain(query, 0.3)
    assert len([p for p in (tmp_path / "cp" / "commits").iterdir() if p.name.isdigit()]) <= 3
    rows = read_table(spark, str(tmp_path / "t"), EVENTS).select("load_id", "message").collect()
    assert len({r.message for r in rows}) == len(rows) == 72
    loads = {}
    for r in rows:
        loads.setdefault((r.message[0], r.load_id), []).append(int(r.message[1:]))
    assert {(name, min(at) // 5, len(at)) for (name, _), at in loads.items()} == {
        *[("a", k, 5) for k in range(9)], *[("b", k, 5) for k in range(4)], ("b", 4, 3), ("c", 0, 4)}


def test_a_batch_is_cut_by_bytes(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write(folder / "a", *[message(str(i)) for i in range(100)])
    query = feeds.ingest_journal(
        follow_lines(spark, str(folder), most_bytes=500), str(tmp_path / "t"), str(tmp_path / "cp"), every=0)
    query.processAllAvailable()
    query.stop()
    loads = read_table(spark, str(tmp_path / "t"), EVENTS).groupBy("load_id").count().collect()
    assert sum(r["count"] for r in loads) == 100 and len(loads) > 2


@pytest.mark.parametrize("options", [{"begin": "later"}, {"rows": "-1"}, {"bytes": "0"}, {"long_lines": "cut"}])
def test_wrong_options_are_refused(options):
    with pytest.raises(ValueError):
        FollowReader({"path": "/tmp", **options})
