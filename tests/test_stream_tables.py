"""Joins of streams, and the store that counts each batch once."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pageloom.plans.store import UsageStore
from pageloom.streaming import joins

T0 = dt.datetime(2026, 4, 4)
STARTS, ENDS = "job_id string, started timestamp, client string", "job_id string, ended timestamp, status string"


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


@pytest.fixture()
def few(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def streamed(spark, batches, tmp_path, longest, late):
    """Batches of (starts, ends), a run each, from one checkpoint."""
    where = {k: str(tmp_path / k) for k in ("starts", "ends", "out", "check")}
    for starts, ends in batches:
        for name, rows, kind in (("starts", starts, STARTS), ("ends", ends, ENDS)):
            spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(where[name])
        s, e = (spark.readStream.schema(kind).parquet(where[name]) for name, kind in (("starts", STARTS), ("ends", ENDS)))
        q = joins.with_ends(s, e, longest, late).writeStream.format("parquet").option("path", where["out"]).option("checkpointLocation", where["check"]).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    return sorted(map(tuple, spark.read.parquet(where["out"]).filter("job_id <> 'flush'").collect()), key=str)


def batch(spark, starts, ends, longest):
    return sorted(map(tuple, joins.with_ends(spark.createDataFrame(starts, STARTS), spark.createDataFrame(ends, ENDS), longest).filter("job_id <> 'flush'").collect()), key=str)


FLUSH = ([("flush", at(100_000), "f")], [("flush", at(100_000), "done")])


def test_stream_join_equals_batch(spark, few, tmp_path):
    rng = random.Random(3)
    starts = [(f"j{k}", at(rng.randrange(600)), f"c{k % 5}") for k in range(120)]
    ends = [(j, s + dt.timedelta(minutes=rng.choice([0, 5, 119, 120, 121, 400, -3])), rng.choice(["succeeded", "failed"])) for j, s, _ in starts if rng.random() < 0.8]
    ends += [("unknown", at(5), "failed"), (None, at(6), "failed"), (ends[0][0], ends[0][1] + dt.timedelta(minutes=1), "again")]
    want = batch(spark, starts, ends, "2 hours")
    assert any(r[3] is None for r in want) and any(r[3] is not None for r in want) and len({r[0] for r in want}) == 120
    rng.shuffle(starts)
    rng.shuffle(ends)
    half = [(starts[:50], ends[60:]), (starts[50:], ends[:60]), FLUSH]  # ends before their starts, a restart between
    assert streamed(spark, half, tmp_path, "2 hours", "12 hours") == want
    assert joins.unended(spark.createDataFrame(starts, STARTS), spark.createDataFrame(ends, ENDS), "2 hours").columns == ["job_id", "started", "client"]


def test_late_rows_of_stream_join(spark, few, tmp_path):
    """An end behind both watermarks is dropped: its job counts as one that never ended."""
    first = ([("a", at(0), "c"), ("b", at(1), "c")], [("a", at(10), "succeeded")])
    later = ([("x", at(5000), "c")], [("x", at(5001), "succeeded")])
    late = ([("z", at(2), "c")], [("b", at(11), "succeeded")])
    got = streamed(spark, [first, later, late, FLUSH], tmp_path, "1 hour", "10 minutes")
    assert {r[0]: r[4] for r in got} == {"a": "succeeded", "b": None, "x": "succeeded"}


SPENT = "client string, ts timestamp, seconds double"


def used(store):
    return {(r["client"], str(r["day"])): r["used"] for r in store.usage(10_000.0).collect()}


def test_store_counts_batches_once(spark, tmp_path):
    st = UsageStore(spark, str(tmp_path / "s"))
    assert used(st) == {}
    write = st.sink("ledger")
    one = spark.createDataFrame([("a", at(0), 10.0), ("b", at(1), 5.5), ("a", at(2), -3.0)], SPENT)
    two = spark.createDataFrame([("a", at(3), 7.0)], SPENT)
    for number, rows in ((0, one), (1, two), (1, two), (0, one)):  # both replayed
        write(rows, number)
    want = {("a", "2026-04-04"): 17.0, ("b", "2026-04-04"): 5.5}
    assert used(st) == want
    st.commit(spark.createDataFrame([("b", at(9), 1.0)], SPENT))
    st.commit(spark.createDataFrame([("b", at(9), 1.0)], SPENT))  # by hand: twice is two
    want["b", "2026-04-04"] = 7.5
    assert used(st) == want
    assert st.compact() == 4 and used(st) == want
    write(two, 1)  # replayed after it was summed up
    assert used(st) == want
    write(spark.createDataFrame([("c", at(20), 2.0)], SPENT), 2)
    want["c", "2026-04-04"] = 2.0
    assert used(st) == want and st.compact() == 2 and used(UsageStore(spark, str(tmp_path / "s"))) == want
    assert st.compact() == 0 and used(st) == want
    with pytest.raises(ValueError):
        st.sink("a/b")(two, 0)


def test_store_when_compaction_is_cut_off(spark, tmp_path):
    st = UsageStore(spark, str(tmp_path / "s"))
    st.commit(spark.createDataFrame([("a", at(0), 10.0)], SPENT))
    st.sink("q")(spark.createDataFrame([("a", at(0), 1.0)], SPENT), 4)
    # A snapshot without its marks: the compaction that wrote it didn't get so far.
    spark.createDataFrame([("a", at(0).date(), 99)], "client string, day date, seconds int").write.parquet(str(tmp_path / "s/snapshots/snapshot-0/usage"))
    assert used(st) == {("a", "2026-04-04"): 11.0}
    assert st.compact() == 2 and used(st) == {("a", "2026-04-04"): 11.0}


def test_stream_into_store(spark, few, tmp_path):
    source = str(tmp_path / "in")
    st = UsageStore(spark, str(tmp_path / "s"))
    for k in range(3):
        spark.createDataFrame([("a", at(k), 1.0 + k)], SPENT).coalesce(1).write.mode("append").parquet(source)
        q = spark.readStream.schema(SPENT).parquet(source).writeStream.foreachBatch(st.sink("s")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert q.awaitTermination(60)
    assert used(st) == {("a", "2026-04-04"): 6.0}
    # The last batch's commit is lost: it is run again.
    commits = tmp_path / "c/commits"
    last = max((p for p in commits.iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    last.unlink()
    (commits / f".{last.name}.crc").unlink(missing_ok=True)
    q = spark.readStream.schema(SPENT).parquet(source).writeStream.foreachBatch(st.sink("s")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(60) and used(st) == {("a", "2026-04-04"): 6.0}
    assert st.usage().select(F.count("*")).first()[0] == 1
