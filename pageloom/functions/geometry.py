"""Boxes as column expressions.

A PDF box has left, bottom, right, top (origin at the bottom left, y upwards); a render
rectangle has x0, y0, x1, y1 (y downwards).  Both are structs of doubles.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def zero() -> Column:
    return F.lit(0.0)


def box(left: Column, bottom: Column, right: Column, top: Column) -> Column:
    """A normalised PDF box: sides in order whatever order they came in (G1)."""
    return F.struct(F.least(left, right).alias("left"), F.least(bottom, top).alias("bottom"), F.greatest(left, right).alias("right"), F.greatest(bottom, top).alias("top"))


def box_of_array(a: Column) -> Column:
    """From [left, bottom, right, top]; null unless there are four numbers."""
    return F.when(F.size(a) == 4, box(F.get(a, 0), F.get(a, 1), F.get(a, 2), F.get(a, 3)))


def width(b: Column) -> Column:
    return b["right"] - b["left"]


def height(b: Column) -> Column:
    return b["top"] - b["bottom"]


def area(b: Column) -> Column:
    """Never negative."""
    return F.greatest(width(b), zero()) * F.greatest(height(b), zero())


def intersection(a: Column, b: Column) -> Column:
    """Common area; boxes that only touch have none."""
    w = F.least(a["right"], b["right"]) - F.greatest(a["left"], b["left"])
    h = F.least(a["top"], b["top"]) - F.greatest(a["bottom"], b["bottom"])
    return F.when((w > 0) & (h > 0), w * h).otherwise(zero())


def _share(part: Column, of: Column) -> Column:
    return F.when(of > 0, F.try_divide(part, of)).otherwise(zero())


def iou(a: Column, b: Column) -> Column:
    """Intersection over union."""
    common = intersection(a, b)
    return _share(common, area(a) + area(b) - common)


def iom(a: Column, b: Column) -> Column:
    """Intersection over the smaller area."""
    return _share(intersection(a, b), F.least(area(a), area(b)))


def area_ratio(a: Column, b: Column) -> Column:
    """Smaller over larger area."""
    return _share(F.least(area(a), area(b)), F.greatest(area(a), area(b)))


def rect(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def to_rect(b: Column, page_height: Column) -> Column:
    """Render rectangle of a PDF box on an unrotated page."""
    return rect(F.least(b["left"], b["right"]), page_height - F.greatest(b["top"], b["bottom"]), F.greatest(b["left"], b["right"]), page_height - F.least(b["top"], b["bottom"]))


def rect_width(r: Column) -> Column:
    return r["x1"] - r["x0"]


def rect_height(r: Column) -> Column:
    return r["y1"] - r["y0"]


def rounded(r: Column, places: int = 3) -> Column:
    """[x0, y0, x1, y1] rounded."""
    return F.array(*[F.round(r[k], places) for k in ("x0", "y0", "x1", "y1")])


#: From which font size a rectangle grows, and by how much.
LARGE_FONT = 16.0
PAD_X = {"share": 0.035, "font": 0.2, "most": 18.0}
PAD_Y = {"share": 0.15, "font": 0.9, "most": 28.0, "above": 0.3}


def render_rect(r: Column, font: Column) -> Column:
    """Room for large type: wider on both sides, higher above and, more, below."""
    px = F.least(F.greatest(rect_width(r) * PAD_X["share"], font * PAD_X["font"]), F.lit(PAD_X["most"]))
    py = F.least(F.greatest(rect_height(r) * PAD_Y["share"], font * PAD_Y["font"]), F.lit(PAD_Y["most"]))
    grown = rect(r["x0"] - px, r["y0"] - py * PAD_Y["above"], r["x1"] + px, r["y1"] + py)
    return F.when(font < LARGE_FONT, r).otherwise(grown)


def union_of(r: str) -> Column:
    """Aggregate: the rectangle around a column of rectangles."""
    return rect(F.min(f"{r}.x0"), F.min(f"{r}.y0"), F.max(f"{r}.x1"), F.max(f"{r}.y1"))


#: When rectangles stand in one column.
SAME_COLUMN = {"overlap": 0.55, "edge": 12.0, "edge_share": 0.18}


def same_column(a: Column, b: Column) -> Column:
    """Enough horizontal overlap, or both edges close."""
    narrow = F.least(rect_width(a), rect_width(b))
    common = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    near = F.greatest(F.lit(SAME_COLUMN["edge"]), narrow * SAME_COLUMN["edge_share"])
    return (common / F.greatest(narrow, F.lit(1.0)) >= SAME_COLUMN["overlap"]) | ((F.abs(a["x0"] - b["x0"]) <= near) & (F.abs(a["x1"] - b["x1"]) <= near))


def vertical_overlap(upper: Column, lower: Column) -> Column:
    """Negative where there is a gap."""
    return upper["y1"] - lower["y0"]


def shifted(r: Column, by: Column) -> Column:
    """Moved down."""
    return rect(r["x0"], r["y0"] + by, r["x1"], r["y1"] + by)


def page_rect(page: Column, blocks: Column) -> Column:
    """The page's own rectangle, else the one around its blocks, else nothing at the origin."""
    return F.coalesce(page, blocks, rect(zero(), zero(), zero(), zero()))
