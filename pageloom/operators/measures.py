"""Measures that merge: sketches kept as columns of a table, cubes and roll-ups.

A sketch table has a row a group of the finest kind; coarser groups merge its sketches and never see the rows again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Registers of a distinct-count sketch, as a power of two (an error of about 0.8 %); size of a quantile sketch (about 0.7 % of rank).
REGISTERS, QUANTILE = 14, 400


def sketches(rows: DataFrame, by: list[str], distinct: str, value: str) -> DataFrame:
    """by, n, total, people (a sketch of distinct ``distinct``) and spread (one of the quantiles of ``value``); nulls are in neither sketch."""
    d = rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.sum(F.col(value).cast("decimal(28,6)")).alias("total"),
        F.hll_sketch_agg(F.col(distinct), REGISTERS).alias("people"),
        F.kll_sketch_agg_double(F.col(value).cast("double"), QUANTILE).alias("spread"),
    )
    return d


def _merged() -> list[Column]:
    return [F.sum("n").alias("n"), F.sum("total").alias("total"), F.hll_union_agg("people").alias("people"), F.kll_merge_agg_double("spread").alias("spread")]


def merged(table: DataFrame, by: list[str]) -> DataFrame:
    """Rows of sketches() or merged(), of one or several tables, as coarser groups."""
    return table.groupBy(*by).agg(*_merged())


def rolled_up(table: DataFrame, by: list[str]) -> DataFrame:
    """merged() for by, for all but its last column, and so on to one row for all; level is how many columns are left out."""
    return table.rollup(*by).agg(*_merged(), F.grouping_id().alias("level"))


def estimates(table: DataFrame, quantiles: tuple[float, ...] = (0.5, 0.9)) -> DataFrame:
    """table without its sketches, with distinct and an estimate for each quantile (q50, q90, ...)."""
    q = [F.kll_sketch_get_quantile_double("spread", F.lit(x)).alias(f"q{round(100 * x)}") for x in quantiles]
    return table.select(*[c for c in table.columns if c not in ("people", "spread")], F.hll_sketch_estimate("people").alias("distinct"), *q)


def cubed(rows: DataFrame, by: list[str], *measures: Column) -> DataFrame:
    """measures for every subset of by; ``set`` is the number of the subset, a bit for each column that is left out (the first column's the highest)."""
    return rows.cube(*by).agg(*measures, F.grouping_id().alias("set"))
