"""Live leases against the batch replay: any cut into batches, restarts, timers, late events."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pageloom.operators import quota
from pageloom.streaming import leases

KIND = "client string, ts timestamp, lease string, action string"
T0 = dt.datetime(2026, 4, 3, 6)


@pytest.fixture()
def store(spark):
    for k, v in {**leases.STORE, "spark.sql.shuffle.partitions": "2"}.items():
        spark.conf.set(k, v)
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    for k in leases.STORE:
        spark.conf.unset(k)


def made(rng, clients=4, n=25):
    """Leases over three local days, by client; each client is looked at once at the end."""
    out = []
    for c in range(clients):
        t = T0 + dt.timedelta(seconds=c)
        for k in range(n):
            t += dt.timedelta(seconds=rng.choice([1, 30, 200, 700, 9_000, 20_000]), microseconds=rng.randrange(10**6))
            out.append((f"c{c}", t, f"l{c}-{k}", "start"))
            if rng.random() < 0.7:
                out.append((f"c{c}", t + dt.timedelta(seconds=rng.choice([5, 100, 499, 501, 30_000])), f"l{c}-{k}", "check"))
            if rng.random() < 0.8:
                out.append((f"c{c}", t + dt.timedelta(seconds=rng.choice([0, 50, 400, 600, 40_000])), f"l{c}-{k}", "end"))
        out.append((f"c{c}", T0 + dt.timedelta(days=6), "none", "check"))
    return sorted(out, key=lambda e: (e[1], e[0], e[2]))


def ran(spark, batches, tmp_path, late, restart=True):
    """What the stream gives when each batch comes in a run of its own, from one checkpoint."""
    source, sink, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    for rows in batches:
        spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(source)
        e = spark.readStream.schema(KIND).parquet(source)
        q = leases.live(e, late=late).writeStream.format("parquet").option("path", sink).option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(180)
    return sorted(tuple(r) for r in spark.read.parquet(sink).filter("client <> 'flush'").orderBy("client", "ts").collect())


FLUSH = [("flush", T0 + dt.timedelta(days=30), "x", "check")]


def test_stream_equals_replay(spark, store, tmp_path):
    rng = random.Random(1)
    events = made(rng)
    want = sorted(tuple(r) for r in quota.replay(spark.createDataFrame(events, KIND), timers=True).collect())
    results = {r[5] for r in want}
    assert {"granted", "refused", "running", "expired", "ended", "ignored"} <= results and sum(r[3] == "timer" for r in want) >= 8
    cut = len(events) // 3
    one = ran(spark, [events, FLUSH], tmp_path / "one", "1 hour")
    assert one == want
    shuffled = events[:]
    for i in range(0, len(shuffled), 7):  # out of order, but within the watermark's delay, and cut where it hurts
        part = shuffled[i : i + 7]
        rng.shuffle(part)
        shuffled[i : i + 7] = part
    cuts = ran(spark, [shuffled[:cut], shuffled[cut : 2 * cut + 3], shuffled[2 * cut + 3 :], FLUSH], tmp_path / "three", "7 days")
    assert cuts == want


def test_late_events_change_nothing(spark, store, tmp_path):
    s = lambda n: T0 + dt.timedelta(seconds=n)
    first = [("a", s(0), "1", "start"), ("a", s(10), "1", "end"), ("a", s(9_000), "2", "start")]
    late = [("a", s(5), "1", "check"), ("a", s(20), "3", "start"), ("a", s(9_100), "2", "end")]
    got = ran(spark, [first, [("flush", s(9_050), "x", "check")], late, FLUSH], tmp_path, "1 second")
    assert [(r[2], r[3], r[5], r[6]) for r in got if r[5] != "late"] == [("1", "start", "granted", 0.0), ("1", "end", "ended", 10.0), ("2", "start", "granted", 10.0), ("2", "end", "ended", 110.0)]


def test_timers_split_days(spark):
    """A lease open over two midnights is charged to each day by the clock."""
    tz = dt.timedelta(hours=9)
    night = dt.datetime(2026, 4, 4) - tz
    at = lambda seconds: night + dt.timedelta(seconds=seconds)
    events = [{"ts": at(-100), "lease": "x", "action": "start"}, {"ts": at(90_000), "lease": "x", "action": "end"}]
    rows = quota.replay_client(events, timers=True)
    assert [(r["action"], r["result"], r["used"]) for r in rows] == [("start", "granted", 0.0), ("timer", "running", 0.0), ("timer", "expired", 500.0), ("end", "ignored", 0.0)]
    assert [r["ts"] for r in rows if r["action"] == "timer"] == [at(0), at(500)]
    plain = quota.replay_client(events)
    assert [(r["action"], r["result"]) for r in plain] == [("start", "granted"), ("end", "expired")]


def test_replay_with_timers_keeps_events(spark):
    events = made(random.Random(2), 2, 10)
    d = spark.createDataFrame(events, KIND)
    n = quota.replay(d, timers=True).filter(F.col("action") != "timer").count()
    assert n == len(events) == quota.replay(d).count()
