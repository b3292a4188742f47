"""The log source and sink: appends of several writers, torn lines, files that are not opened, failures."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from quarrygraph.sources import eventlog


def test_append_and_read(spark, tmp_path):
    at = f"file://{tmp_path}/log"
    assert eventlog.read(spark, at).count() == 0
    rows = spark.range(100).select((F.col("id") * 10.0).alias("ts"), F.lit("attempt").alias("event"), F.col("id").cast("string").alias("tool_use_id"))
    eventlog.append(rows.repartitionByRange(4, "ts"), at)
    eventlog.append(spark.createDataFrame([(5000.0, True, None), (None, False, "x"), (-3.5, None, "e")], "ts double, ok boolean, error string"), at)
    names = os.listdir(tmp_path / "log")
    assert len([n for n in names if not n.startswith(".")]) >= 5 and all(eventlog.NAME.match(n) for n in names if not n.startswith("."))
    got = eventlog.read(spark, at)
    assert got.count() == 102 and got.where("ok").count() == 1 and got.where("error = 'e'").first().ts == -3.5
    assert {r.ts for r in eventlog.read(spark, at, 900).collect()} == {*(i * 10.0 for i in range(90, 100)), 5000.0}
    reader = eventlog._Reader(at, 900.0)
    assert len(reader.partitions()) == 2  # the last quarter and the second append
    with pytest.raises(Exception, match="appended"):
        spark.createDataFrame([(1.0,)], "ts double").selectExpr("ts").write.format("eventlog").mode("overwrite").save(at)


def test_torn_and_odd_lines(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "by-hand.jsonl").write_text('{"ts": 1, "event": "a", "ok": "no"}\n{"ts": "2"}\n[1]\n{"ts": 3.5, "event": 7, "other": 1}\n\n{"ts": true}\n{"ts": NaN}\n{"ts": 4, "event": "to')
    (tmp_path / "log" / ".hidden.part").write_text('{"ts": 9}\n')
    got = eventlog.read(spark, str(tmp_path / "log")).orderBy("ts").collect()
    assert [(r.ts, r.event, r.ok) for r in got] == [(1.0, "a", None), (3.5, None, None)]


def test_a_failed_append_leaves_nothing(spark, tmp_path):
    at = f"file://{tmp_path}/log"
    bad = spark.range(20).repartition(2).select(F.col("id").cast("double").alias("ts"), F.when(F.col("id") == 13, F.raise_error("no")).otherwise("a").alias("event"))
    with pytest.raises(Exception, match="no"):
        eventlog.append(bad, at)
    assert eventlog.read(spark, at).count() == 0


def test_filters_on_time_are_pushed(spark, tmp_path):
    at = f"file://{tmp_path}/log"
    eventlog.append(spark.range(40).select(F.col("id").cast("double").alias("ts")).repartitionByRange(4, "ts"), at)
    from pyspark.sql.datasource import GreaterThanOrEqual, LessThan

    r = eventlog._Pushed(at, float("-inf"))
    assert len(list(r.pushFilters([GreaterThanOrEqual(("ts",), 30.0), LessThan(("ts",), 99.0)]))) == 2 and len(r.partitions()) == 1
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        assert eventlog.read(spark, at).where("ts > 35 and event is null").count() == 4
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
