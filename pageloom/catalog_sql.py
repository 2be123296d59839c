"""Queries written as SQL text over the names of functions/registry.py; they equal the same queries written as columns."""

from __future__ import annotations

from pageloom import catalog
from pageloom.catalog import query
from pageloom.functions import registry
from pageloom.plans import bridges as b


def _views(spark, **tables):
    """SQL text that stands for tables, by name."""
    registry.register(spark, "pl_")
    for name, df in tables.items():
        df.createOrReplaceTempView(f"pl_{name}")


@query(catalog.SQL["bbox_iou_pairs"])
def bbox_iou_pairs_by_sql(spark, sf_dir):
    """G1-G6, F7 in SQL text."""
    _views(spark, boxes=b.vector_boxes(b.table(spark, sf_dir, "embeddings")))
    return spark.sql(
        """SELECT x.doc_id, x.page, x.label, x.ord AS ord_a, y.ord AS ord_b, round(pl_bbox_iou(x.box, y.box), 6) AS iou, round(pl_bbox_iom(x.box, y.box), 6) AS iom
        FROM pl_boxes x JOIN pl_boxes y ON x.doc_id = y.doc_id AND x.page = y.page AND x.label = y.label AND x.ord < y.ord
        WHERE pl_bbox_area_ratio(x.box, y.box) >= 0.8D AND (pl_bbox_iou(x.box, y.box) >= 0.85D OR pl_bbox_iom(x.box, y.box) >= 0.9D)"""
    )


@query(catalog.SQL["json_walk_units"])
def json_walk_units_by_sql(spark, sf_dir):
    """S3, F1 in SQL text: the walk as a table function."""
    _views(spark, trees=catalog._trees(spark, sf_dir))
    return spark.sql(
        """SELECT t.conv_id, w.ord, w.page, coalesce(w.label, 'text') AS label, pl_text_stripped(w.text) AS text, w.top
        FROM pl_trees t, LATERAL pl_page_walk(t.tree) w WHERE w.text RLIKE '(?U)\\\\S'"""
    )


@query(catalog.SQL["language_detect"])
def language_detect_by_sql(spark, sf_dir):
    """T12 in SQL text."""
    d = catalog.documents(spark, sf_dir).select("doc_id", "text")
    more = spark.createDataFrame([(-1 - i, s) for i, s in enumerate(catalog._SAMPLES)], d.schema)
    _views(spark, said=d.unionByName(more))
    return spark.sql("SELECT doc_id, pl_text_language(text) AS tag FROM pl_said")
