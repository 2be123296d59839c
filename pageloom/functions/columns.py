"""Helpers for building plans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns (new or replaced) that are worked out once a row, however often later steps refer to them.

    A generator of one row stands between, so the optimizer can't copy the expression into its uses.
    """
    for name, c in columns.items():
        df = df.select(*[x for x in df.columns if x != name], F.explode(F.array(c)).alias(name))
    return df


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), the value being worked out once; for columns within lambdas, where ``once`` can't stand."""
    return F.element_at(F.transform(F.array(value), use), 1)
