"""Streams over the event table, run to the end of what there is."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from pageloom.operators import quota
from pageloom.streaming import ledger

SF = "/root/testdata/sf0.001/events.parquet"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="needs the given tables")


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


@pytest.fixture()
def events(spark, tmp_path):
    e = spark.read.parquet(SF)
    e.write.parquet(str(tmp_path / "events"))
    return ledger.source(spark, str(tmp_path / "events"), e)


def test_windows(spark, events):
    got = run(ledger.windowed(events), "windows")
    whole = spark.read.parquet(SF).groupBy(F.to_date("ts").alias("d"), "event_type").count()
    n = {(str(r["start"])[:10], r["event_type"]): r["n"] for r in got.collect()}
    assert n and all({(str(r["d"]), r["event_type"]): r["count"] for r in whole.collect()}[k] == v for k, v in n.items())


def test_ledger(spark, events):
    s = events.select(F.col("user_id").alias("client"), "ts", F.col("value").alias("seconds"))
    got = run(ledger.ledger(s), "ledger", "update")
    last = {(r["client"], str(r["day"])): r["used"] for r in got.groupBy("client", "day").agg(F.max("used").alias("used")).collect()}
    whole = quota.daily_usage(spark.read.parquet(SF).select(F.col("user_id").alias("client"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("seconds")))
    assert last == {(r["client"], str(r["day"])): pytest.approx(r["used"]) for r in whole.collect()}


def test_sessions(spark, events):
    got = {(r["user_id"], str(r["start"])): r["n"] for r in run(ledger.sessions(events), "sessions").collect()}
    gap, want = dt.timedelta(minutes=30), {}
    seen: dict = {}
    for r in spark.read.parquet(SF).select("user_id", F.col("ts").cast("timestamp").alias("ts")).orderBy("ts").collect():
        start, last = seen.get(r["user_id"], (None, None))
        if last is None or r["ts"] >= last + gap:
            start = r["ts"]
        want[r["user_id"], str(start)] = want.get((r["user_id"], str(start)), 0) + 1
        seen[r["user_id"]] = (start, r["ts"])
    assert got and all(want[k] == n for k, n in got.items())  # the last sessions are still open


def test_unique(spark, events):
    assert run(ledger.unique(events), "unique").count() == spark.read.parquet(SF).select("event_id").distinct().count()
