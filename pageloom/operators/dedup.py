"""Overlapping boxes: the pairs that duplicate each other, and the greedy removal.

Both keep to (doc_id, page, label); a page's boxes are few, so a page is one group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions import geometry as g
from pageloom.functions.metrics import stripped
from pageloom.functions.text import normalised

#: Default thresholds.
AREA_RATIO, IOU, IOM = 0.8, 0.85, 0.9


def duplicates(a: Column, b: Column) -> Column:
    """Whether two rows (structs with box, said: normalised text) of one page and label are duplicates."""
    said = F.contains(a["said"], b["said"]) | F.contains(b["said"], a["said"])
    return (g.area_ratio(a["box"], b["box"]) >= AREA_RATIO) & ((g.iou(a["box"], b["box"]) >= IOU) | ((g.iom(a["box"], b["box"]) >= IOM) & said))


def duplicate_pairs(boxes: DataFrame) -> DataFrame:
    """doc_id, page, label, ord_a < ord_b and measures of each duplicate pair (an equi-join with a residual condition)."""
    x = boxes.select("doc_id", "page", "label", "ord", F.struct("box", normalised(F.coalesce("text", F.lit(""))).alias("said")).alias("r"))
    a, b = x.alias("a"), x.alias("b")
    j = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in ("doc_id", "page", "label")] + [F.col("a.ord") < F.col("b.ord"), duplicates(F.col("a.r"), F.col("b.r"))])
    return j.select("a.doc_id", "a.page", "a.label", F.col("a.ord").alias("ord_a"), F.col("b.ord").alias("ord_b"), g.iou(F.col("a.r.box"), F.col("b.r.box")).alias("iou"), g.iom(F.col("a.r.box"), F.col("b.r.box")).alias("iom"))


def deduplicated(rows: DataFrame, raw_length: bool = False) -> DataFrame:
    """rows (doc_id, ord, page, label, box, text, ...) without duplicates, by the greedy rule (J1; J2 with raw_length).

    In order, a row is compared with the kept ones; at each match the better of the two goes on
    comparing (larger area, then longer text, else the kept one), and at the end takes the place of the
    first match, while the other matches go.  ``ord`` of a survivor is that of its place.
    """
    text = F.coalesce("text", F.lit(""))
    rest = [c for c in rows.columns if c not in ("doc_id", "page", "label")]
    row = F.struct(F.col("ord").alias("slot"), "box", normalised(text).alias("said"), g.area(F.col("box")).alias("size"), F.length(text if raw_length else stripped(text)).alias("length"), F.struct(*rest).alias("row"))
    d = rows.withColumn("__r", row).groupBy("doc_id", "page", "label").agg(F.array_sort(F.collect_list("__r")).alias("__rows"))
    kind = d.schema["__rows"].dataType.elementType.simpleString()
    none = F.array().cast("array<bigint>")

    def one(kept: Column, new: Column) -> Column:
        def against(state: Column, k: Column) -> Column:
            c = state["c"]
            hit = duplicates(c, k)
            better = (c["size"] > k["size"]) | ((c["size"] == k["size"]) & (c["length"] > k["length"]))
            return F.struct(F.when(hit & ~better, k).otherwise(c).alias("c"), F.when(hit, F.concat(state["hits"], F.array(k["slot"].cast("bigint")))).otherwise(state["hits"]).alias("hits"))

        found = F.aggregate(kept, F.struct(new.alias("c"), none.alias("hits")), against)

        def settle(s: Column) -> Column:
            at = F.get(s["hits"], 0)
            moved = F.struct(at.cast(rows.schema["ord"].dataType).alias("slot"), *[s["c"][k].alias(k) for k in ("box", "said", "size", "length", "row")])
            stay = F.filter(kept, lambda k: ~F.array_contains(s["hits"], k["slot"].cast("bigint")) | (k["slot"].cast("bigint") == at))
            return F.when(F.size(s["hits"]) == 0, F.concat(kept, F.array(new))).otherwise(F.transform(stay, lambda k: F.when(k["slot"].cast("bigint") == at, moved).otherwise(k)))

        return F.element_at(F.transform(F.array(found), settle), 1)

    d = d.withColumn("__kept", F.aggregate("__rows", F.array().cast(f"array<{kind}>"), one))
    d = d.select("doc_id", "page", "label", F.explode("__kept").alias("__k"))
    return d.select(*[F.col(c) if c in ("doc_id", "page", "label") else (F.col("__k.slot").alias("ord") if c == "ord" else F.col(f"__k.row.{c}").alias(c)) for c in rows.columns])
