"""Jobs as two streams, of starts and of ends, joined while both run.

Each side has a watermark, and an end counts only within ``longest`` of its start, so the state of a job goes when neither an end
can come any more nor a start: only then is a job known not to have ended, and given without an end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LONGEST, LATE = "1 day", "1 hour"


def _seconds(ended: Column, began: Column) -> Column:
    return (F.unix_micros(ended) - F.unix_micros(began)) / 1e6


def with_ends(starts: DataFrame, ends: DataFrame, longest: str = LONGEST, late: str = LATE) -> DataFrame:
    """starts (job_id, started, ...) with ended, status and seconds of their ends (job_id, ended, status); null if a job has none.

    For streams and tables alike: a table has no late rows, a stream drops those behind the watermark (``late`` behind its latest).  An end
    before its start, or more than ``longest`` after it, isn't this job's.  Rows without a job_id or a time have no partner; a
    job that ends twice has two rows.
    """
    a = starts.withColumn("started", F.col("started").cast("timestamp"))
    b = ends.select(F.col("job_id").alias("__job"), F.col("ended").cast("timestamp").alias("ended"), "status")
    if starts.isStreaming:
        a = a.withWatermark("started", late)
    if ends.isStreaming:
        b = b.withWatermark("ended", late)
    within = (F.col("ended") >= F.col("started")) & (F.col("ended") <= F.col("started") + F.expr(f"interval {longest}"))
    d = a.join(b, (F.col("job_id") == F.col("__job")) & within, "left_outer").drop("__job")
    return d.withColumn("seconds", _seconds(F.col("ended"), F.col("started")))


def unended(starts: DataFrame, ends: DataFrame, longest: str = LONGEST, late: str = LATE) -> DataFrame:
    """The starts that no end came for."""
    return with_ends(starts, ends, longest, late).filter("ended is null").drop("ended", "status", "seconds")
