"""Connected components by alternating large and small stars.

Each round is two aggregations and joins over the edges; nothing is gathered by node or on
the driver, and each round's edges are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.store import Workspace


def components(edges: DataFrame, at: Workspace, name: str) -> DataFrame:
    """edges (a, b: long) -> (id, root): the smallest id reachable, for each id of an edge but the roots."""
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    e = at.keep(e, f"{name}-0")
    state, turn = None, 0
    while True:
        # Large star: the larger neighbours of each node move to the smallest one.
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(e.select(F.col("v").alias("x"), F.col("u").alias("y")))
        low = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.filter("y > x").join(low, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: a node and its smaller neighbours move to the smallest of these.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        turn += 1
        new = at.keep(small, f"{name}-{turn}")
        at.drop(f"{name}-{turn - 1}")
        now = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            return new.select(F.col("u").alias("id"), F.col("v").alias("root"))
        e, state = new, now
