"""Streaming forms: the quota ledger, job status, sessions and daily windows over event streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pageloom.operators.quota import LIMIT, ZONE, local_day

LATE = "1 day"


def source(spark, path: str, like: DataFrame) -> DataFrame:
    """A Parquet folder as a stream of the same columns."""
    return spark.readStream.schema(like.schema).parquet(path)


def windowed(events: DataFrame, length: str = "1 day", late: str = LATE) -> DataFrame:
    """Counts and sums of value by event type in tumbling windows; events later than ``late`` are dropped by the watermark."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = LATE) -> DataFrame:
    """Sessions of each user."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def unique(events: DataFrame, late: str = LATE) -> DataFrame:
    """Each event_id once within the watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def ledger(spent: DataFrame, limit: float = LIMIT, zone: str = ZONE, late: str = LATE) -> DataFrame:
    """spent (client, ts, seconds) -> client, day, used after each batch: a capped running sum per client and local day.

    State is one number a key and goes once the watermark is two days past the day.
    """
    e = spent.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).withColumn("day", local_day(F.col("ts"), zone))

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        used = state.get[0] if state.exists else 0.0
        for x in frames:
            used = min(limit, used + float(x["seconds"].clip(lower=0).sum()))
        state.update((used,))
        end = pd.Timestamp(key[1]) + pd.Timedelta(days=2)
        state.setTimeoutTimestamp(max(int(end.timestamp() * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"client": [key[0]], "day": [key[1]], "used": [used]})

    kind = spent.schema["client"].dataType.simpleString()
    return e.groupBy("client", "day").applyInPandasWithState(run, f"client {kind}, day date, used double", "used double", "update", GroupStateTimeout.EventTimeTimeout)
