from __future__ import annotations

import pytest
from conftest import T0, at, events

from timelens.operators import events as ev

SEARCHED = [
    (-30, "sshd.service", "key login by carol"),
    (-20, "kernel", "memory used up, worker ended"),
    (-10, "sshd.service", "wrong PASSWORD from dave"),
]


def messages(df):
    return [r.message for r in df.collect()]


def test_latest_is_newest_first(spark):
    df = events(spark, [(-60, "sshd.service", "key login"), (0, "kernel", "memory used up")])
    assert messages(ev.latest_events(df, 10)) == ["memory used up", "key login"]
    assert messages(ev.latest_events(df, 1)) == ["memory used up"]
    assert messages(ev.latest_events(df, 0)) == []


def test_latest_of_nothing(spark):
    assert ev.latest_events(events(spark, []), 10).count() == 0


def test_latest_breaks_ties_by_id_and_fills_gaps(spark):
    df = events(spark, [(0, None, "a"), (0, None, "b"), (0, None, "c")])
    rows = ev.latest_events(df, 2).collect()
    assert [(r.message, r.unit, r.source, r.pid) for r in rows] == [("a", "", "", 0), ("b", "", "", 0)]


def test_negative_limit_is_refused(spark):
    df = events(spark, [])
    for call in (ev.latest_events, ev.pending_events):
        with pytest.raises(ValueError):
            call(df, limit=-1)


def test_search_ignores_case_and_looks_at_units(spark):
    df = events(spark, SEARCHED)
    assert len(messages(ev.search_events(df, "wrong password", at(-60)))) == 1
    assert len(messages(ev.search_events(df, "sshd", at(-60)))) == 2
    assert messages(ev.search_events(df, "memory", at(-15))) == []
    assert len(messages(ev.search_events(df, "memory", at(-20)))) == 1


def test_search_has_no_upper_bound_and_folds_accents(spark):
    df = events(spark, [(99999, None, "DÉJÀ vu")])
    assert messages(ev.search_events(df, "déjà", T0)) == ["DÉJÀ vu"]


def test_search_wildcards_only_on_request(spark):
    df = events(spark, [(0, "u", "50% done"), (1, "u", "50 well done"), (2, "u", r"a\b")])
    assert messages(ev.search_events(df, "50%d", T0)) == []
    assert messages(ev.search_events(df, "50% d", T0)) == ["50% done"]
    assert messages(ev.search_events(df, "50%d", T0, wildcards=True)) == ["50 well done", "50% done"]
    assert messages(ev.search_events(df, r"A\B", T0, wildcards=True)) == [r"a\b"]


def test_near_keeps_the_earliest_of_the_window(spark):
    df = events(spark, [(s, "u", f"m{s}") for s in (-120, -30, 0, 30, 120)])
    assert messages(ev.events_near(df, T0, 60, 10)) == ["m-30", "m0", "m30"]
    assert messages(ev.events_near(df, T0, 60, 2)) == ["m-30", "m0"]
    assert messages(ev.events_near(df, T0, 30, 10)) == ["m-30", "m0", "m30"]
    assert messages(ev.events_near(df, T0, -1, 10)) == []


def test_pending_newest_first_and_shrinking(spark):
    df = events(spark, [(-3, "u", "older"), (-2, None, "middle"), (-1, "u", "newest")])
    pending = ev.pending_events(df, limit=10)
    assert messages(pending) == ["newest", "middle", "older"]
    assert pending.collect()[1].unit == ""
    done = spark.createDataFrame([(3, [1.0])], "event_id long, embedding array<float>")
    assert messages(ev.pending_events(df, done, 10)) == ["middle", "older"]
    assert ev.pending_events(df, done).count() == 2
