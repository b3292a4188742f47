"""Streams with timers: counts, admission and retention against plain loops, and the state of keys that are idle."""

from __future__ import annotations

import datetime as dt

import pytest

from quarrygraph.streaming import budget

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocks(spark):
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.unset(PROVIDER)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def at(s):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)


def stream(spark, tmp_path, batches):
    schema = "id long, user string, ts timestamp, kind string, use string"
    for i, rows in enumerate(batches):
        spark.createDataFrame([(k, u, at(s), kind, use) for k, u, s, kind, use in rows], schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in/b{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in/*")


def run(df, spark, tmp_path, name, var):
    where = f"file://{tmp_path}/{name}"
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", where).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(300)
    q.stop()
    held = spark.read.format("statestore").option("stateVarName", var).load(where)
    return spark.table(name).collect(), {r.key[0] for r in held.select("key").collect()}


def test_rolling_counts_and_idle_keys(rocks, tmp_path):
    batches = [[(1, "u", 0, "", None), (2, "u", 10, "", None), (3, "v", 10, "", None)], [(4, "u", 20, "", None), (5, "u", 12, "", None)], [(6, "w", 5000, "", None)], [(7, "w", 5001, "", None), (8, "u", 30, "", None)]]
    got, keys = run(budget.rolling_counts(stream(rocks, tmp_path, batches), "user", "ts", "id", 15, "1 minute"), rocks, tmp_path, "counts", "times")
    assert {(r.id, r.used) for r in got} == {(1, 1), (2, 2), (3, 1), (5, 3), (4, 3), (6, 1), (7, 2)}  # 8 is too late
    assert keys == {"w"}


def test_admissions(rocks, tmp_path):
    one = [(i, "u", i, "request", f"r{i}") for i in range(9)]  # the ninth waits until the first has left the minute
    two = [(20, "u", 9, "request", "r1"), (21, "u", 70, "limited", None), (22, "u", 71, "request", None), (23, "u", 90, "limited", None), (24, "u", 91, "request", None), (25, "u", 95, "ok", None), (26, "u", 96, "request", None)]
    three = [(40, "z", 400_000, "request", None)]
    four = [(41, "z", 400_001, "request", None)]
    df = budget.admissions(stream(rocks, tmp_path, [one, two, three, four]), "user", "ts", "id", per_minute=8, per_day=11, most_sleep_s=55, late="1 minute")
    got, keys = run(df, rocks, tmp_path, "admitted", "times")
    d = {r.id: (r.decision, r.slept) for r in got}
    assert all(d[i] == ("allow", 0) for i in range(8))
    assert d[8] == ("allow", 52_000_000 + budget.SLACK) and d[20] == ("known", 0)
    assert d[22] == ("allow", 29_000_000 + budget.SLACK) and d[24] == ("deny: backoff", 0)
    assert d[26] == ("allow", 0) and d[40] == d[41] == ("allow", 0)
    assert {r.id: r.today for r in got}[26] == 9  # the one that sleeps until 100.05 has not called yet
    assert keys == {"z"}


def test_retention(rocks, tmp_path):
    batches = [[(1, "u", 0, "", None), (2, "u", 100, "", None), (3, "v", 0, "", None)], [(4, "u", 160, "", None)], [(5, "w", 400, "", None)], [(6, "w", 401, "", None)]]
    got, keys = run(budget.expired(stream(rocks, tmp_path, batches), "user", "ts", "id", 120, "10 seconds"), rocks, tmp_path, "expired", "held")
    assert sorted((r.user, r.id, r.us // 1_000_000 - 1_704_067_200) for r in got) == [("u", "1", 0), ("u", "2", 100), ("u", "4", 160), ("v", "3", 0)]
    assert keys == {"w"}


def test_streams_ask_for_their_store(spark, tmp_path):
    with pytest.raises(ValueError, match="RocksDB"):
        budget.rolling_counts(spark.createDataFrame([], "id long, user string, ts timestamp"), "user", "ts", "id", 15)
