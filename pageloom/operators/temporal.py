"""Joins and frames by time: as-of joins, joins of overlapping intervals, sums and ranks over ranges of time.

What must be seen in order is never a whole key's rows.  Time is cut into buckets: a task orders the rows of one key and one
bucket, and what earlier buckets leave behind is carried over as one row a bucket.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of a bucket.
DAY = 86_400


def bucket(ts: Column, seconds: int = DAY) -> Column:
    return F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(seconds * 1_000_000)).cast("long")


def as_of(left: DataFrame, right: DataFrame, on: list[str], ts: str = "ts", strict: bool = False, seconds: int = DAY, name: str = "known") -> DataFrame:
    """left with ``name``: a struct of the last row of right, of equal ``on``, whose time isn't after the row's (or is before it, if strict).

    Null if there is none.  Of right's rows of one time the greatest counts.  A null time knows nothing and is never known;
    null keys equal each other.  A key's rows are ordered by bucket of time; the last row of each bucket is carried to the next ones.
    """
    value = F.struct(*[c for c in right.columns if c not in on])
    r = right.filter(F.col(ts).isNotNull()).groupBy(*on, F.col(ts).alias("__ts")).agg(F.max(value).alias("__known"))
    x = left.select(*on, F.col(ts).alias("__ts"), F.struct(*left.columns).alias("__row"))
    both = x.withColumn("__side", F.lit(0 if strict else 1)).unionByName(r.withColumn("__side", F.lit(1 if strict else 0)), allowMissingColumns=True)
    both = both.withColumn("__bucket", bucket(F.col("__ts"), seconds))
    # What each bucket leaves, and what it finds: one row a key and bucket.
    by = Window.partitionBy(*on).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    left_over = both.groupBy(*on, "__bucket").agg(F.max_by("__known", F.when(F.col("__known").isNotNull(), F.col("__ts"))).alias("__left"))
    found = left_over.select(*on, "__bucket", F.last("__left", ignorenulls=True).over(by).alias("__found"))
    inside = Window.partitionBy(*on, "__bucket").orderBy("__ts", "__side").rowsBetween(Window.unboundedPreceding, 0)
    rows = both.withColumn("__last", F.last("__known", ignorenulls=True).over(inside)).filter(F.col("__row").isNotNull())
    same = functools.reduce(operator.and_, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*on, "__bucket"]])
    d = rows.alias("a").join(found.alias("b"), same, "left")
    known = F.when(F.col("a.__ts").isNotNull(), F.coalesce("a.__last", "b.__found"))
    return d.select("a.__row.*", known.alias(name))


def overlapping(left: DataFrame, right: DataFrame, on: list[str], start: str = "start", end: str = "end", seconds: int = 3600) -> DataFrame:
    """Pairs of rows whose half-open intervals overlap: ``on``, and structs l and r of the rows; ``on`` may be empty.

    An equi-join on the keys and the buckets of time that both intervals touch; a pair that meets in several buckets is reported in the
    first of them.  Intervals with a null, or that end before they start, meet nothing; empty ones meet what they lie inside of.
    """

    def spread(d: DataFrame, side: str) -> DataFrame:
        ok = d.filter(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(start) <= F.col(end)))
        first, last = bucket(F.col(start), seconds), bucket(F.timestamp_micros(F.greatest(F.unix_micros(F.col(end).cast("timestamp")) - 1, F.unix_micros(F.col(start).cast("timestamp")))), seconds)
        return ok.select(*[F.col(k).alias(f"{side}_{k}") for k in on], F.struct(*d.columns).alias(side), first.alias(f"{side}_first"), F.explode(F.sequence(first, last)).alias(f"{side}_bucket"))

    a, b = spread(left, "l"), spread(right, "r")
    same = functools.reduce(operator.and_, [F.col(f"l_{k}") == F.col(f"r_{k}") for k in on], F.col("l_bucket") == F.col("r_bucket"))
    meets = (F.col(f"l.{start}") < F.col(f"r.{end}")) & (F.col(f"r.{start}") < F.col(f"l.{end}"))
    d = a.join(b, same & meets & (F.col("l_bucket") == F.greatest("l_first", "r_first")))
    return d.select(*[F.col(f"l_{k}").alias(k) for k in on], "l", "r")


def trailing_sum(rows: DataFrame, on: list[str], value: str, length: int, ts: str = "ts", name: str = "recent") -> DataFrame:
    """rows with ``name``: the sum of value over the key's rows of the last ``length`` seconds, rows of the same time included.

    A range frame over the buckets of one length: a row stands in its own bucket and, to be summed only, in the next, so no task orders more of a
    key than two buckets.  A null value is 0, a row without a time has no sum.  Sums are of decimals, so their order doesn't matter.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    d = rows.withColumns({"__t": micros, "__own": F.floor(micros / F.lit(length * 1_000_000)).cast("long"), "__v": F.coalesce(value, F.lit(0)).cast("decimal(28,6)")})
    d = d.select("*", F.explode(F.when(F.col("__t").isNull(), F.array(F.lit(None).cast("long"))).otherwise(F.array("__own", F.col("__own") + 1))).alias("__in"))
    w = Window.partitionBy(*on, "__in").orderBy("__t").rangeBetween(-length * 1_000_000, 0)
    d = d.withColumn(name, F.when(F.col("__t").isNotNull(), F.sum("__v").over(w).cast("double")))
    return d.filter("__in <=> __own").drop("__t", "__own", "__v", "__in")


def daily_ranks(rows: DataFrame, day: str, value: str, tiles: int = 4) -> DataFrame:
    """rows with place (rank by value, largest first), dense_place, share (percent_rank) and tile of each day.

    A day's rows are ordered without being one task's: rows are counted by day and value first; ranks follow from these counts,
    which are as many as a day has different values.
    """
    n = rows.groupBy(day, value).agg(F.count("*").alias("__n"))
    w = Window.partitionBy(day).orderBy(F.desc(value))
    n = n.withColumns({"__before": F.sum("__n").over(w) - F.col("__n"), "dense_place": F.row_number().over(w), "__all": F.sum("__n").over(Window.partitionBy(day))})
    share = F.when(F.col("__all") > 1, F.col("__before") / (F.col("__all") - 1)).otherwise(0.0)
    # ntile by first place: equal values share a tile.
    tile = F.floor(F.col("__before") * tiles / F.col("__all")).cast("int") + 1
    n = n.select(F.col(day).alias("__day"), F.col(value).alias("__value"), (F.col("__before") + 1).alias("place"), "dense_place", share.alias("share"), tile.alias("tile"))
    return rows.join(n, F.col(day).eqNullSafe(F.col("__day")) & F.col(value).eqNullSafe(F.col("__value"))).drop("__day", "__value")
