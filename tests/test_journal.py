from __future__ import annotations

import json
from datetime import datetime

import pytest
from conftest import T0
from pyspark.sql import functions as F

from timelens.sources.journal import parse_journal, read_lines, typed_lines

TIME = {"__REALTIME_TIMESTAMP": "1705320000000123"}


def typed(spark, *lines):
    df = spark.createDataFrame([(i, l) for i, l in enumerate(lines)], "n long, value string")
    return typed_lines(df.withColumn("arrived", F.lit(T0))).orderBy("n").collect()


def record(spark, **fields):
    return typed(spark, json.dumps({"MESSAGE": "m", **TIME, **fields}))[0]


@pytest.mark.parametrize("line, message", [
    ('{"MESSAGE":"text"}', "text"), ('  {"MESSAGE":"text"}\t', "text"), ('{"MESSAGE":"null"}', "null"),
    ('{"MESSAGE":["x","y"]}', "x"), ('{"MESSAGE":[[["z"]]]}', "z"), ('{"MESSAGE":[104,105]}', "104"),
    ('{"MESSAGE":5}', "5"), ('{"MESSAGE":-7.25}', "-7.25"), ('{"MESSAGE":1.50}', "1.5"), ('{"MESSAGE":0}', "0"),
    ('{"MESSAGE":1e3}', "1000"), ('{"MESSAGE":1e21}', "1000000000000000000000"),
    ('{"MESSAGE":[[[["deep"]]]]}', "deep"), ('{"MESSAGE":[[[[[7,8]]]]]}', "7"), ('{"MESSAGE":[["a\\"],[b", 1]]}', 'a"],[b'),
    ('{"MESSAGE":1e40}', "1" + "0" * 40), ('{"MESSAGE":1e-20}', "0." + "0" * 19 + "1"), ('{"MESSAGE":-1.25e-7}', "-0.000000125"),
    ('{"MESSAGE":123456789.125}', "123456789.125"), ('{"MESSAGE":"a","MESSAGE":"b"}', "b"), ('{"MESSAGE":" "}', " "), ('{"MESSAGE":"[1]"}', "[1]"),
])
def test_accepted(spark, line, message):
    row = typed(spark, line)[0]
    assert row.accepted and row.message == message


@pytest.mark.parametrize("line", [
    "", "null", "7", '"MESSAGE"', '{"MESSAGE":"a"', '{"MESSAGE":"a"} x', '{"MESSAGE":"a"}{"MESSAGE":"b"}',
    '{"MESSAGE":"a"},{"MESSAGE":"b"}', '{"MESSAGE":"a"},null', '{"MESSAGE":"a"},', '[{"MESSAGE":"a"}]',
    '{"MESSAGE":"a"}] x [{}', '{"MESSAGE":"a"},"end-of-journal-line"', '{"MESSAGE":[[],"x"]}', '{"MESSAGE":[{"a":1}]}', '{"MESSAGE":""}', '{"MESSAGE":[]}', '{"MESSAGE":true}', '{"MESSAGE":null}',
    '{"MESSAGE":{"a":1}}', '{"PRIORITY":"3"}', "{}", '{"message":"lower"}',
])
def test_rejected(spark, line):
    assert not typed(spark, line)[0].accepted


@pytest.mark.parametrize("value, priority", [
    ("6", 6), (6, 6), ("+3", 3), ("-1", -1), ("x", 0), (" 3", 0), ("3.0", 0), ("", 0), (None, 0), ("99999999999", 0),
    (["4", "5"], 4), (True, 0),
])
def test_priority(spark, value, priority):
    assert record(spark, PRIORITY=value).priority == priority


def test_second_choices_and_untrimmed_texts(spark):
    row = record(spark, _SYSTEMD_UNIT="  ", UNIT=" u ", SYSLOG_IDENTIFIER="", _COMM="c", _PID="", SYSLOG_PID="7")
    assert (row.unit, row.source, row.pid) == (" u ", "c", 7)
    row = record(spark, _SYSTEMD_UNIT="a", UNIT="b", SYSLOG_IDENTIFIER="i", _COMM="c", _PID="5", SYSLOG_PID="7")
    assert (row.unit, row.source, row.pid) == ("a", "i", 5)
    row = record(spark)
    assert (row.unit, row.source, row.pid) == ("", "", 0)


@pytest.mark.parametrize("pid, expected", [("2147483647", 2147483647), ("2147483648", 0), (" 5", 0), ("x", 0), (12, 12)])
def test_pid(spark, pid, expected):
    assert record(spark, _PID=pid).pid == expected


def test_time(spark):
    assert record(spark).ts == datetime(2024, 1, 15, 12, 0, 0, 123)
    assert record(spark, __REALTIME_TIMESTAMP=1705320000000123).ts == datetime(2024, 1, 15, 12, 0, 0, 123)
    for bad in ("soon", "", None, " 1"):
        assert record(spark, __REALTIME_TIMESTAMP=bad).ts == T0


def test_events_and_rejects_of_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"MESSAGE":"one"}\nbroken\n{"MESSAGE":"two"}\n')
    events, rejects = parse_journal(read_lines(spark, str(tmp_path)))
    assert sorted(r.message for r in events.collect()) == ["one", "two"]
    assert [r.value for r in rejects.collect()] == ["broken"]
    assert events.filter(F.col("ts").isNull()).count() == 0


def test_a_line_is_parsed_once(spark):
    df = spark.createDataFrame([("{}", T0)], "value string, arrived timestamp")
    plan = parse_journal(df)[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("parseJson") == 1
