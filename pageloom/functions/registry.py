"""The library's functions under SQL names, for a session's own queries.

Column rules become SQL functions that the optimizer inlines, so a query in SQL text has the plan that the same rules have as
columns; the walk of page trees is a table function.  ``NAMES`` says what there is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from pageloom.functions import geometry as g
from pageloom.functions import metrics as m
from pageloom.functions import text as t
from pageloom.sources.documents import Walk

BOX = "struct<left: double, bottom: double, right: double, top: double>"
RECT = "struct<x0: double, y0: double, x1: double, y1: double>"
#: Name: (arguments with types, type of the result, the rule as a column).
NAMES: dict[str, tuple[dict[str, str], str, Callable[..., Column]]] = {
    "bbox": ({"left": "double", "bottom": "double", "right": "double", "top": "double"}, BOX, g.box),
    "bbox_area": ({"a": BOX}, "double", g.area),
    "bbox_intersection": ({"a": BOX, "b": BOX}, "double", g.intersection),
    "bbox_iou": ({"a": BOX, "b": BOX}, "double", g.iou),
    "bbox_iom": ({"a": BOX, "b": BOX}, "double", g.iom),
    "bbox_area_ratio": ({"a": BOX, "b": BOX}, "double", g.area_ratio),
    "same_column": ({"a": RECT, "b": RECT}, "boolean", g.same_column),
    "text_slug": ({"said": "string"}, "string", t.slug),
    "text_collapsed": ({"said": "string"}, "string", t.collapsed),
    "text_normalised": ({"said": "string"}, "string", t.normalised),
    "text_stripped": ({"said": "string"}, "string", m.stripped),
    "text_language": ({"said": "string"}, "string", t.detected_language),
    "text_stage": ({"said": "string"}, "string", t.stage),
    "box_colour": ({"label": "string"}, "array<double>", m.colour),
}
WALK = "page_walk"


def _sql(spark: SparkSession, rule: Callable[..., Column], arguments: dict[str, str]) -> str:
    """A rule as SQL over its arguments, as Spark itself spells the resolved expression."""
    empty = spark.createDataFrame([], ", ".join(f"{a} {kind}" for a, kind in arguments.items()))
    said = empty.select(rule(*[F.col(a) for a in arguments]).alias("x"))
    return said._jdf.queryExecution().analyzed().expressions().head().child().sql()


def register(spark: SparkSession, prefix: str = "") -> list[str]:
    """Makes all names known to the session; gives them."""
    for name, (arguments, result, rule) in NAMES.items():
        args = ", ".join(f"{a} {kind.upper()}" for a, kind in arguments.items())
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({args}) RETURNS {result.upper()} RETURN {_sql(spark, rule, arguments)}")
    spark.udtf.register(f"{prefix}{WALK}", Walk)
    return [f"{prefix}{n}" for n in (*NAMES, WALK)]
