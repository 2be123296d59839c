"""Layout: overlap penalties, columns, typography candidates, the page plan and its shifts.

Blocks have doc_id, page, block_id (order on the page), rect (struct x0, y0, x1, y1), text,
label, font_size, font_name, lines, line_height, spacing, toc_page.  A page is the unit of what must go
in order (columns, the plan, shifts); everything else is relational.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.functions import geometry as g
from pageloom.functions import metrics as m
from pageloom.functions.columns import let, once
from pageloom.functions.text import font_family

#: Labels that are planned; penalties; candidate steps.
PLANNED = ("paragraph", "heading", "caption", "list item")
OVERLAP = {"width": 0.2, "most": 0.22, "base": 0.05, "slope": 0.16}
NEAR = {"height": 0.32, "least": 4.0, "most": 0.16, "base": 0.04, "slope": 0.1}
SCALES = {"outer": (1.0, 0.96, 0.92, 0.86, 0.82, 0.74, 0.68), "middle": (1.0, 0.96, 0.92, 0.88, 0.82, 0.76, 0.68, 0.62)}
LINE_RATIOS = (1.0, 0.96, 0.92, 0.88, 0.84, 0.8)
TIGHTER = (0.02, 0.04, 0.06, 0.08, 0.1, 0.12, 0.16, 0.2)
TIGHTEST, NO_SPACING, LEAST_LINE = -0.22, 0.005, 1.02
CHANGED = {"scale": 0.999, "line": 0.01}
SLACK = 1e-5
COST = {"scale": 1000.0, "line": 4.0, "spacing": 25.0}
LADDERS = {"large": (1.0, 0.92, 0.82, 0.68, 0.0), "small": (0.92, 0.82, 0.68, 0.0), "middle": (0.88, 0.76, 0.62, 0.0), "pretext": (1.0, 0.96, 0.92)}
BLOCKED = ("planner_overflow", "pymupdf_probe_overflow", "postpass_overlap_overflow")
PREVIEW = 160


def paragraph_box(label: Column) -> Column:
    return F.lower(m.stripped(label)).isin(*PLANNED)


def planned(label: Column, toc_page: Column) -> Column:
    """Whether a block is measured and planned."""
    return (F.coalesce(toc_page, F.lit("")) == "") & paragraph_box(label)


def reading_order(units: DataFrame) -> DataFrame:
    """units with nr (1...) and block_id: from top to bottom, then left to right, then as they came.

    Ids have four digits or more; what must be in order goes by nr.
    """
    w = Window.partitionBy("doc_id", "page").orderBy(F.desc("box.top"), "box.left", "ord")
    return units.withColumn("nr", F.row_number().over(w)).withColumn("block_id", block_id(F.col("nr")))


def block_id(nr: Column) -> Column:
    return F.format_string("b%04d", nr)


def number(block: Column) -> Column:
    """The number in a block's id: ids sort by it, not as strings."""
    return F.substring(block, 2, 12).cast("int")


def overlap_penalty(a: Column, b: Column) -> Column:
    """Of one rectangle by another: by common height if they overlap, by nearness if there is a small gap; 0 if neither."""
    across = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    down = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    narrow = F.greatest(F.least(g.rect_width(a), g.rect_width(b)), F.lit(1.0))
    low = F.least(g.rect_height(a), g.rect_height(b))
    reach = F.greatest(low * NEAR["height"], F.lit(NEAR["least"]))
    over = F.least(F.lit(OVERLAP["most"]), down / F.greatest(low, F.lit(1.0)) * OVERLAP["slope"] + OVERLAP["base"])
    near = F.least(F.lit(NEAR["most"]), (F.lit(1.0) + down / reach) * NEAR["slope"] + NEAR["base"])
    beside = (across > 0) & (across / narrow >= OVERLAP["width"])
    return F.when(~beside, 0.0).when(down > 0, over).when(-down <= reach, near).otherwise(0.0)


def _penalties(x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray, a: np.ndarray, e: np.ndarray) -> np.ndarray:
    """overlap_penalty of rectangles a by rectangles e, number by number."""
    width, tall = x1 - x0, y1 - y0
    across = np.fmin(x1[a], x1[e]) - np.fmax(x0[a], x0[e])
    down = np.fmin(y1[a], y1[e]) - np.fmax(y0[a], y0[e])
    narrow, low = np.fmax(np.fmin(width[a], width[e]), 1.0), np.fmin(tall[a], tall[e])
    reach = np.fmax(low * NEAR["height"], NEAR["least"])
    over = np.fmin(OVERLAP["most"], down / np.fmax(low, 1.0) * OVERLAP["slope"] + OVERLAP["base"])
    near = np.fmin(NEAR["most"], (1.0 + down / reach) * NEAR["slope"] + NEAR["base"])
    beside = (across > 0) & (across / narrow >= OVERLAP["width"])
    return np.where(~beside, 0.0, np.where(down > 0, over, np.where(-down <= reach, near, 0.0)))


def _worst(bs: pa.Array) -> pa.Array:
    """bs (blocks of a page) -> for each the largest penalty, if it is planned, by the earlier ones of its page; 0 if none."""
    of = np.repeat(np.arange(len(bs)), bs.value_lengths().to_numpy(zero_copy_only=False))
    flat = bs.flatten()
    nr, mine, *sides = (pc.struct_field(flat, k).to_numpy(zero_copy_only=False) for k in ("nr", "mine", "x0", "y0", "x1", "y1"))
    order = np.lexsort((nr, of))
    page, nr, mine, sides = of[order], nr[order], mine[order].astype(bool), [x[order].astype(float) for x in sides]
    worst = np.zeros(len(page))
    for d in range(1, len(page)):  # blocks d apart
        same = page[:-d] == page[d:]
        if not same.any():
            break
        e = np.flatnonzero(same & mine[d:] & (nr[:-d] < nr[d:]))
        worst[e + d] = np.maximum(worst[e + d], _penalties(*sides, e + d, e))
    back = np.empty(len(page))
    back[order] = worst
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(bs) + 1)).astype(np.int32)), pa.array(back))


def overlap_spacing(blocks: DataFrame) -> DataFrame:
    """blocks with penalty (null if none) and adjusted spacing.

    Every block meets the earlier ones of its page.  A page's blocks are one row meanwhile, so nothing is joined back.
    """
    r = F.col("__r")
    b = blocks.withColumn("__r", g.render_rect(F.col("rect"), F.col("font_size")))
    row = F.struct(number(F.col("block_id")).alias("nr"), F.coalesce(planned(F.col("label"), F.col("toc_page")), F.lit(False)).alias("mine"), *[r[k].alias(k) for k in ("x0", "y0", "x1", "y1")])
    other = [c for c in blocks.columns if c not in ("doc_id", "page")]
    pages = b.groupBy("doc_id", "page").agg(F.collect_list(F.struct(F.struct(*other).alias("b"), row.alias("r"))).alias("bs"))
    pages = pages.withColumn("p", F.arrow_udf(_worst, "array<double>")(F.transform("bs", lambda x: x["r"])))
    out = pages.select("doc_id", "page", F.explode(F.zip_with("bs", "p", lambda x, p: F.struct(x["b"].alias("b"), p.alias("p")))).alias("x"))
    out = out.select("doc_id", "page", *[F.col("x.b")[c].alias(c) for c in other], F.when(F.col("x.p") > 0, -F.round("x.p", 3)).alias("penalty")).select(*blocks.columns, "penalty")
    return out.withColumn("adjusted", F.when(F.col("penalty").isNotNull(), m.combined_spacing(F.col("spacing"), F.col("penalty"))).otherwise(F.col("spacing")))


def column_clusters(blocks: DataFrame) -> DataFrame:
    """blocks with column (1...): each goes to the first column whose first block it shares one with.

    First fit over blocks from left to right; the columns' first blocks never move, so one fold over the page does.
    """
    other = [c for c in blocks.columns if c not in ("doc_id", "page")]
    x = F.struct(F.col("rect.x0").alias("x0"), F.col("rect.y0").alias("y0"), number(F.col("block_id")).alias("nr"), "block_id", F.struct(*other).alias("b"))
    p = blocks.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(x)).alias("bs"))
    anchors = F.array().cast("array<struct<x0:double,y0:double,x1:double,y1:double>>")

    def place(s: Column, r: Column) -> Column:
        at = F.coalesce(F.get(F.filter(F.transform(s["anchors"], lambda a, i: F.when(g.same_column(r, a), i)), lambda i: i.isNotNull()), 0), F.size(s["anchors"]))
        return let(at, lambda k: F.struct(F.when(k == F.size(s["anchors"]), F.concat(s["anchors"], F.array(r))).otherwise(s["anchors"]).alias("anchors"), F.concat(s["at"], F.array(k.cast("int"))).alias("at")))

    # Columns open from left to right, so their numbers are already in the order of their first blocks.
    at = F.aggregate(F.transform("bs", lambda x: x["b"]["rect"]), F.struct(anchors.alias("anchors"), F.array().cast("array<int>").alias("at")), place)["at"]
    p = p.select("doc_id", "page", F.explode(F.zip_with("bs", at, lambda x, k: F.struct(x["b"].alias("b"), k.alias("at")))).alias("x"))
    return p.select("doc_id", "page", *[F.col("x.b")[c].alias(c) for c in other], (F.col("x.at") + 1).alias("column")).select(*blocks.columns, "column")


def scale_ladder(font: Column) -> Column:
    """Scales to try in order."""
    a = lambda k: F.array(*map(F.lit, LADDERS[k]))
    return F.when(font >= 16, a("large")).when(font <= 11.5, a("small")).otherwise(a("middle"))


#: An estimator gets (font, spacing or null, characters, width) and says how many lines a text takes.
Estimator = Callable[[Column, Column, Column, Column], Column]


def analytic(font: Column, letter: Column, characters: Column, width: Column) -> Column:
    """An approximation of a renderer: characters a line = width / ((0.55 + spacing) font)."""
    room = F.greatest(F.floor(width / F.greatest((F.lit(m.GLYPH_WIDTH) + F.coalesce(letter, F.lit(0.0))) * font, F.lit(0.1))), F.lit(1))
    return F.greatest(F.ceil(characters / room), F.lit(1)).cast("int")


def _sized(blocks: DataFrame) -> Column:
    """What a block's candidates are made of."""
    return F.struct(F.col("font_size").alias("font"), "line_height", "spacing", F.greatest(F.col("line_height"), F.round(F.col("font_size") * LEAST_LINE, 3)).alias("line"), F.length("text").alias("n"), g.rect_width(F.col("rect")).alias("w"))


def _priced(b: Column, c: Column, gen: Column, estimate: Estimator) -> Column:
    s, h, x = c["scale"], c["line"], c["letter"]
    base = F.coalesce(b["spacing"], F.lit(0.0))
    cost = F.round((F.lit(1.0) - s) * COST["scale"] + F.greatest(F.lit(0.0), b["line"] * s - h) * COST["line"] + F.abs(F.coalesce(x, F.lit(0.0)) - base) * COST["spacing"], 6)
    return F.struct(cost.alias("cost"), gen.alias("gen"), s.alias("scale"), c["font"].alias("font"), h.alias("line"), x.alias("letter"), estimate(c["font"], x, b["n"], b["w"]).alias("lines"))


def _lines_of(b: Column, s: Column) -> Column:
    def of_font(f: Column) -> Column:
        h = F.array_distinct(F.transform(F.array(*map(F.lit, LINE_RATIOS)), lambda r: F.round(F.greatest(f * LEAST_LINE, b["line"] * s * r), 3)))
        return F.transform(h, lambda x: F.struct(s.alias("scale"), f.alias("font"), x.alias("line")))

    return let(F.round(b["font"] * s, 3), of_font)


def _letters_of(b: Column) -> Column:
    tight = F.transform(F.array(*map(F.lit, TIGHTER)), lambda d: F.round(F.greatest(F.coalesce(b["spacing"], F.lit(0.0)) - d, F.lit(TIGHTEST)), 3))
    return F.array_distinct(F.concat(F.array(b["spacing"]), F.transform(tight, lambda x: F.when(F.abs(x) >= NO_SPACING, x))))


def _scales_of(b: Column) -> Column:
    a = lambda v: F.array(*map(F.lit, v))
    return F.when((b["font"] >= 16) | (b["font"] <= 11.5), a(SCALES["outer"])).otherwise(a(SCALES["middle"]))


def candidates_of(b: Column, estimate: Estimator = analytic, few: Column | None = None) -> Column:
    """All candidates of a block (_sized), by cost, in the order of making where costs are equal (L1-L3, O3); few: of _to_try, only those."""
    letters = _letters_of(b)
    made = F.flatten(F.transform(_scales_of(b) if few is None else few["scales"], lambda s: _lines_of(b, s)))
    with_letters = lambda xs: F.flatten(F.transform(made, lambda c: F.transform(xs, lambda x: F.struct(c["scale"].alias("scale"), c["font"].alias("font"), c["line"].alias("line"), x.alias("letter")))))
    base = F.coalesce(b["spacing"], F.lit(0.0))
    dear = lambda c: ((F.lit(1.0) - c["scale"]) * COST["scale"] + F.greatest(F.lit(0.0), b["line"] * c["scale"] - c["line"]) * COST["line"] >= few["dear"]) & (F.abs(F.coalesce(c["letter"], F.lit(0.0)) - base) * COST["spacing"] >= few["far"] - SLACK)
    wanted = lambda cs: cs if few is None else F.filter(cs, lambda c: F.array_contains(few["open"], c["scale"]) | dear(c))
    return let(letters, lambda xs: F.sort_array(F.transform(wanted(with_letters(xs)), lambda c, k: _priced(b, c, k, estimate))))


def cheapest_of(b: Column, estimate: Estimator = analytic) -> Column:
    """The first of candidates_of: the block as it is, which costs nothing."""
    f = F.round(b["font"] * 1.0, 3)
    as_is = F.struct(F.lit(1.0).alias("scale"), f.alias("font"), F.round(F.greatest(f * LEAST_LINE, b["line"]), 3).alias("line"), b["spacing"].alias("letter"))
    return let(as_is, lambda c: _priced(b, c, F.lit(0), estimate))


def _to_try(b: Column, fits: Callable[[Column], Column]) -> Column:
    """Among which candidates are the first of candidates_of that fits, and the last of all: those of scales ``open``, and those that
    cost ``dear`` (but for spacing) and ``far`` (for spacing) or more; scales: of either, in order.

    The analytic estimate, like height and cost, never falls when a size, a line height or a spacing grows.  So a scale has
    a candidate that fits if its lowest lines with the tightest spacing do; no scale costs less than its reduction alone, or more
    than with its lowest lines and the farthest spacing.  SLACK is more than costs are rounded by.
    """
    base = F.coalesce(b["spacing"], F.lit(0.0))

    def of_letters(xs: Column) -> Column:
        zeros = F.transform(xs, lambda x: F.coalesce(x, F.lit(0.0)))
        far = F.array_max(F.transform(zeros, lambda x: F.abs(x - base))) * COST["spacing"]
        return F.struct(F.array_min(zeros).alias("tightest"), far.alias("far"))

    def chosen(x: Column) -> Column:
        def of_scale(s: Column) -> Column:
            f = F.round(b["font"] * s, 3)
            low = F.round(F.greatest(f * LEAST_LINE, b["line"] * s * min(LINE_RATIOS)), 3)
            return let(F.struct(f.alias("f"), low.alias("low")), lambda y: F.struct(s.alias("s"), ((F.lit(1.0) - s) * COST["scale"]).alias("least"), ((F.lit(1.0) - s) * COST["scale"] + F.greatest(F.lit(0.0), b["line"] * s - y["low"]) * COST["line"]).alias("most"), F.coalesce(fits(F.struct(y["low"].alias("line"), analytic(y["f"], x["tightest"], b["n"], b["w"]).alias("lines"))), F.lit(False)).alias("open")))

        def kept(each: Column) -> Column:
            dear = F.array_max(F.transform(each, lambda y: y["most"])) - SLACK
            bound = F.array_min(F.transform(F.filter(each, lambda y: y["open"]), lambda y: y["most"])) + x["far"] + SLACK
            cheap = lambda y, z: y["open"] & (y["least"] <= z["bound"])
            names = lambda ys: F.transform(ys, lambda y: y["s"])
            return let(F.struct(dear.alias("dear"), bound.alias("bound")), lambda z: F.struct(names(F.filter(each, lambda y: cheap(y, z) | (y["most"] >= z["dear"]))).alias("scales"), names(F.filter(each, lambda y: cheap(y, z))).alias("open"), z["dear"].alias("dear"), x["far"].alias("far")))

        return let(F.transform(_scales_of(b), of_scale), kept)

    return let(let(_letters_of(b), of_letters), chosen)


def enough_of(b: Column, fits: Callable[[Column], Column], estimate: Estimator = analytic) -> Column:
    """The candidates of a block that can be the first to fit, or the last: only the cheapest if that fits.

    With another estimate, of which nothing is known, all.
    """
    rest = let(_to_try(b, fits), lambda few: candidates_of(b, estimate, few)) if estimate is analytic else candidates_of(b, estimate)
    return let(cheapest_of(b, estimate), lambda c: F.when(fits(c), F.array(c)).otherwise(rest))


def candidate_sizes(blocks: DataFrame) -> DataFrame:
    """Planned blocks with the number of their candidates, and the largest and smallest size among them; none is priced for it."""
    b = blocks.filter(planned(F.col("label"), F.col("toc_page")))
    b = once(once(b, __b=_sized(b)), __made=F.flatten(F.transform(_scales_of(F.col("__b")), lambda s: _lines_of(F.col("__b"), s))))
    fonts = F.transform("__made", lambda x: x["font"])
    n = F.size("__made") * F.size(_letters_of(F.col("__b")))
    return b.select(*blocks.columns, n.cast("long").alias("candidates"), F.array_max(fonts).alias("largest"), F.array_min(fonts).alias("smallest"))


def with_candidates(blocks: DataFrame, estimate: Estimator = analytic) -> DataFrame:
    """Planned blocks with ``candidates``: array of structs by cost (L1-L3, O3).

    Scales x line heights x spacings are made, made distinct, measured, priced and sorted inside the row, so nothing is
    shuffled; height = lines * line height.
    """
    b = blocks.filter(planned(F.col("label"), F.col("toc_page")))
    b = once(once(b, __b=_sized(b)), candidates=candidates_of(F.col("__b"), estimate))
    return b.select(*blocks.columns, "candidates")


def measured_candidates(blocks: DataFrame, measure: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """with_candidates, each text, width, size, line height and spacing measured once by ``measure`` (sources/helpers.py); a missing answer is an error.

    height: of the candidate as measured, in points.
    """
    c = with_candidates(blocks)
    rows = c.select("doc_id", "page", "block_id", "text", "font_name", g.rect_width(F.col("rect")).alias("w"), F.explode("candidates").alias("c"))
    family = font_family(F.col("font_name"))
    wanted = rows.select("doc_id", "page", "block_id", "c", F.struct("text", family.alias("font_family_css"), (F.col("c.font") * PX).alias("font_size_px"), (F.col("c.line") * PX).alias("line_height_px"), (F.col("w") * PX).alias("max_width_px"), F.col("c.letter").alias("letter_spacing_em")).alias("r"))
    wanted = wanted.withColumn("request_id", F.concat(F.sha2(F.to_json("r"), 256), F.lit(":"), F.format_string("%.3f", F.col("c.scale"))))
    asked = wanted.select("request_id", "r.*").dropDuplicates(["request_id"])
    told = measured(asked.select("request_id"), measure(asked)).select("request_id", "line_count", (F.col("height") / PX).alias("height"))
    new = F.struct("c.cost", "c.gen", "c.scale", "c.font", "c.line", "c.letter", F.col("line_count").alias("lines"), "height")
    back = wanted.join(told, "request_id").groupBy("doc_id", "page", "block_id").agg(F.sort_array(F.collect_list(new)).alias("candidates"))
    return c.drop("candidates").join(back, ["doc_id", "page", "block_id"])


def reason(c: Column, line_height: Column, spacing: Column) -> Column:
    """What a candidate changes (L3): by more than rounding may, and against the block's own line height."""
    apart = F.abs(F.coalesce(c["letter"], F.lit(0.0)) - F.coalesce(spacing, F.lit(0.0))) >= NO_SPACING
    said = F.concat_ws("+", F.when(c["scale"] < CHANGED["scale"], "font_scale"), F.when(c["line"] < line_height * c["scale"] - CHANGED["line"], "line_height"), F.when(apart, "letter_spacing"))
    return F.coalesce(F.nullif(said, F.lit("")), F.lit("none"))


def height(c: Column) -> Column:
    return F.round(c["lines"] * c["line"], 3)


def first_scale(fits: Callable[[Column], Column], ladder: Column) -> Column:
    """The first scale of a ladder that fits, and whether any does; else the last (O7).  Scales after the first fit aren't asked for."""
    tried = F.aggregate(ladder, F.lit(None).cast("double"), lambda found, s: F.when(found.isNotNull(), found).when(fits(s), s))
    return let(tried, lambda s: F.struct(F.coalesce(s, F.element_at(ladder, -1)).alias("scale"), s.isNotNull().alias("fits")))


def drawn_scale(blocks: DataFrame, ladder: Column | None = None, estimate: Estimator = analytic) -> DataFrame:
    """blocks with scale and fits: the first scale of their ladder (L8) at which their text is no taller than its rectangle.

    A scale of 0 stands for "as small as it takes" and fits whatever it is.
    """
    tall = lambda s: estimate(F.col("font_size") * s, F.col("spacing"), F.length("text"), g.rect_width(F.col("rect"))) * F.col("line_height") * s
    s = first_scale(lambda s: (s == 0.0) | (tall(s) <= g.rect_height(F.col("rect"))), scale_ladder(F.col("font_size")) if ladder is None else ladder)
    return once(blocks, __s=s).select(*blocks.columns, "__s.scale", "__s.fits")


def typography_candidates(blocks: DataFrame) -> DataFrame:
    """A row for each candidate of each planned block, with its rank by cost."""
    b = with_candidates(blocks).select("doc_id", "page", "block_id", "line_height", "font_size", "spacing", F.posexplode("candidates").alias("rank", "c"))
    c = F.col("c")
    return b.select("doc_id", "page", "block_id", (F.col("rank") + 1).alias("rank"), "c.gen", "c.scale", "c.font", "c.line", "c.letter", "c.cost", "c.lines", height(c).alias("height"), reason(c, F.col("line_height"), F.col("spacing")).alias("reason"))


def first_feasible(blocks: DataFrame) -> DataFrame:
    """The cheapest candidate of each block that fits its own height, else the last one, marked as overflow (O6 without running positions)."""
    b = blocks.filter(planned(F.col("label"), F.col("toc_page")))
    b = once(b, __v=F.struct(g.rect_height(F.col("rect")).alias("room"), m.safety(F.col("line_height")).alias("safe")), __b=_sized(b))
    fits = lambda c: height(c) + F.col("__v.safe") <= F.col("__v.room")
    b = once(b, candidates=enough_of(F.col("__b"), fits))
    b = once(b, __fits=F.get(F.filter("candidates", fits), 0))
    b = once(b, c=F.coalesce("__fits", F.element_at("candidates", -1)))
    c = F.col("c")
    return b.select("doc_id", "page", "block_id", "c.scale", "c.font", "c.line", "c.letter", "c.lines", height(c).alias("height"), reason(c, F.col("line_height"), F.col("spacing")).alias("reason"), F.col("__fits").isNull().alias("overflow"))


#: Fixed value: pixels a point.
PX = 96 / 72

#: A validator gets (block, x0, y0, x1, y1, candidate) and says (fits, y0, y1 of what it drew, scale used).
Validator = Callable[[dict, float, float, float, float, dict], tuple[bool, float, float, float]]
#: How far below its column's end a trial may reach.
OVER = 0.01


def to_plan(blocks: DataFrame, adjust: bool = True) -> DataFrame:
    """blocks as they are planned (J3, G9): spacing after overlaps, and the rectangle that large type is given."""
    b = overlap_spacing(blocks)
    b = b.withColumn("spacing", F.col("adjusted") if adjust else F.col("spacing")).select(*blocks.columns)
    return b.withColumn("rect", g.render_rect(F.col("rect"), F.col("font_size")))


def legacy_plan(blocks: DataFrame) -> DataFrame:
    """block_id, plan rectangle and shift without a planner (P13): the rectangle large type is given; the shift is never negative."""
    r = g.render_rect(F.col("rect"), F.col("font_size"))
    return blocks.select("doc_id", "page", "block_id", r.alias("planned"), F.greatest(F.lit(0.0), F.round(r["y0"] - F.col("rect.y0"), 3)).alias("shift"))


def _columns_of(blocks: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """doc_id, page, column, floor, bs: the blocks of each column from top to bottom, with all that planning them takes.

    Candidates aren't among it (they are made where they are tried), unless they are given: as they were measured.
    """
    b = column_clusters(blocks)
    more = []
    if candidates is not None:
        b = b.join(candidates.select("doc_id", "page", "block_id", "candidates"), ["doc_id", "page", "block_id"], "left")
        more = ["candidates"]
    row = F.struct(F.col("rect.y0").alias("y0"), F.col("rect.x0").alias("x0"), number(F.col("block_id")).alias("nr"), "block_id", F.col("rect.y1").alias("y1"), F.col("rect.x1").alias("x1"), g.rect_height(F.col("rect")).alias("own"), planned(F.col("label"), F.col("toc_page")).alias("planned"), (F.coalesce("toc_page", F.lit("")) != "").alias("toc"), m.gap(F.col("line_height")).alias("gap"), m.safety(F.col("line_height")).alias("safe"), F.col("font_size").alias("font"), F.col("line_height").alias("line"), F.col("spacing").alias("letter"), "text", _sized(b).alias("b"), *more)
    return b.groupBy("doc_id", "page", "column").agg(F.max("rect.y1").alias("floor"), F.array_sort(F.collect_list(row)).alias("bs"))


def _picked(x: Column, c: Column, tall: Column | None = None) -> Column:
    return F.struct(c["scale"].alias("scale"), c["font"].alias("font"), c["line"].alias("line"), c["letter"].alias("letter"), c["lines"].alias("lines"), (height(c) if tall is None else tall).alias("height"), reason(c, x["line"], x["letter"]).alias("reason"))


PLACED = "block_id string, plan_y0 double, plan_y1 double, actual_y0 double, actual_y1 double, shift double, fallback string, scale double, font double, line double, letter double, lines int, height double, reason string, used double, overlap double, top_delta double, bottom_delta double"


def page_plan(blocks: DataFrame, validator: Validator | None = None, adjust: bool = True, estimate: Estimator = analytic, measure: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The plan of every block (L4, W6, O6), column by column from top to bottom.

    A block stands below what stands above it, in its cheapest candidate that ends within its column; if none does, in the last
    one, as an overflow.  Blocks that aren't planned keep their height.  Without a validator that is a fold over the column's
    blocks, which makes a block's candidates as it comes to it, and only if the block doesn't fit as it is; with one, the trials of a
    column are made by a worker in order.  estimate: how many lines a text takes; measure: asks an external program instead.
    """
    ready = to_plan(blocks, adjust)
    d = _columns_of(ready, measured_candidates(ready, measure) if measure else None)
    given = measure is not None
    of = lambda x, cs: F.transform(cs, lambda c: _picked(x, c, F.round(c["height"], 3) if given else None))
    if validator is not None:
        every = lambda x: F.when(x["planned"], of(x, x["candidates"] if given else candidates_of(x["b"], estimate)))
        d = d.withColumn("bs", F.transform("bs", lambda x: x.withField("candidates", every(x)).dropFields("b")))
        return _validated(d, validator)
    kind = F.array().cast(f"array<struct<{PLACED.replace(' ', ':').replace(',:', ',')}>>")

    def step(s: Column, x: Column) -> Column:
        def place(y: Column) -> Column:
            tall = lambda c: F.round(c["height"], 3) if given else height(c)
            fits = lambda c: F.greatest(x["own"], tall(c) + x["safe"]) <= s["floor"] - y
            tried = F.when(x["planned"], x["candidates"] if given else enough_of(x["b"], fits, estimate))

            def found(cs: Column) -> Column:
                first = F.get(F.filter(cs, fits), 0)
                return let(F.struct(first.alias("chosen"), F.coalesce(first, F.get(cs, F.size(cs) - 1)).alias("last")), lambda t: let(F.struct(F.when(t["chosen"].isNotNull(), _picked(x, t["chosen"], tall(t["chosen"]))).alias("chosen"), F.when(t["last"].isNotNull(), _picked(x, t["last"], tall(t["last"]))).alias("last")), lambda p: row(y, p["chosen"], p["last"])))

            return let(tried, found)

        def row(y: Column, chosen: Column, last: Column) -> Column:
            end = y + F.greatest(F.when(x["planned"], F.greatest(x["own"], last["height"] + x["safe"])).otherwise(x["own"]), F.lit(1.0))
            why = F.when(x["planned"], F.coalesce(chosen["reason"], F.lit("planner_overflow"))).when(x["toc"], "toc_passthrough").otherwise("legacy_passthrough")
            used = F.when(x["planned"] & chosen.isNull(), 0.0).otherwise(1.0)
            own = lambda k, other: F.when(x["planned"], last[k]).otherwise(other).alias(k)
            made = F.struct(x["block_id"].alias("block_id"), y.alias("plan_y0"), end.alias("plan_y1"), y.alias("actual_y0"), end.alias("actual_y1"), F.round(y - x["y0"], 3).alias("shift"), why.alias("fallback"), own("scale", F.lit(1.0)), own("font", x["font"]), own("line", x["line"]), own("letter", x["letter"]), own("lines", F.lit(None)), own("height", F.lit(None)), own("reason", F.lit("none")), used.alias("used"), *[F.lit(0.0).alias(k) for k in ("overlap", "top_delta", "bottom_delta")])
            return F.struct(s["floor"].alias("floor"), end.alias("bottom"), F.concat(s["rows"], F.array(made)).alias("rows"))

        return let(F.greatest(x["y0"], F.coalesce(s["bottom"] + x["gap"], x["y0"])), place)

    start = F.struct(F.col("floor"), F.lit(None).cast("double").alias("bottom"), kind.alias("rows"))
    d = d.select("doc_id", "page", "column", F.explode(F.aggregate("bs", start, step)["rows"]).alias("r"))
    return d.select("doc_id", "page", "r.block_id", "column", *[f"r.{x.split()[0]}" for x in PLACED.split(", ")[1:]])


def _validated(columns: DataFrame, validator: Validator) -> DataFrame:
    """As page_plan, each trial being put to a validator."""
    names = [x.split()[0] for x in PLACED.split(", ")]

    def trial(b: dict, y: float, tall: float, c: dict, floor: float) -> tuple[float, float, float] | None:
        """(top, bottom, scale used) of a candidate drawn at y, if it fits."""
        fits, top, bottom, used = validator(b, b["x0"], y, b["x1"], y + max(tall, 1.0), c)
        return (top, bottom, used) if fits and bottom <= floor + OVER else None

    def lay(columns: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in columns:
            rows = [{**{k: c[k] for k in ("doc_id", "page", "column")}, **r} for c in frame.to_dict("records") for r in column(list(c["bs"]), c["floor"])]
            yield pd.DataFrame(rows, columns=["doc_id", "page", "column", *names])

    def column(bs: list[dict], floor: float) -> Iterator[dict]:
        bottom: float | None = None
        for b in bs:
            y = b["y0"] if bottom is None else max(b["y0"], bottom + b["gap"])
            shift, overlap, drawn, asked, chosen = round(y - b["y0"], 3), 0.0, None, False, None
            tall_of = lambda c, b=b: max(b["own"], c["height"] + b["safe"])
            if not b["planned"]:
                tall, why, last = b["own"], "toc_passthrough" if b["toc"] else "legacy_passthrough", {"scale": 1.0, "font": b["font"], "line": b["line"], "letter": b["letter"], "reason": "none"}
                drawn = (y, y + max(tall, 1.0), 1.0)
            else:
                for c in b["candidates"]:
                    if tall_of(c) <= floor - y:
                        asked, drawn = True, trial(b, y, tall_of(c), c, floor)
                        if drawn:
                            chosen = c
                            break
                last = chosen or b["candidates"][-1]
                tall, why = tall_of(last), last["reason"] if chosen else "pymupdf_probe_overflow" if asked else "planner_overflow"
                drawn = drawn or (y, y + max(tall, 1.0), 0.0)
                if bottom is not None and drawn[0] < bottom:  # drawn into what stands above: once more, further down
                    overlap = round(bottom - drawn[0], 3)
                    down = y + (bottom - drawn[0]) + b["gap"]
                    again = trial(b, down, tall, last, floor) if floor - down >= 1.0 else None
                    if again:
                        y, drawn, overlap, why = down, again, 0.0, "postpass_shift" if why == "none" else why
                    else:
                        drawn, why = (None, None, drawn[2]), "postpass_overlap_overflow"
            end = y + max(tall, 1.0)
            if drawn[0] is not None:
                bottom = drawn[1]
            delta = [0.0 if drawn[0] is None else round(a - p, 3) for a, p in zip(drawn[:2], (y, end), strict=True)]
            yield {"block_id": b["block_id"], "plan_y0": y, "plan_y1": end, "actual_y0": drawn[0], "actual_y1": drawn[1], "shift": shift, "fallback": why, **{k: last.get(k) for k in ("scale", "font", "line", "letter", "lines", "height", "reason")}, "used": drawn[2], "overlap": overlap, "top_delta": delta[0], "bottom_delta": delta[1]}

    kind = columns.schema["doc_id"].dataType.simpleString()
    out = columns.mapInPandas(lay, f"doc_id {kind}, page int, column int, {PLACED}")
    return out.select("doc_id", "page", "block_id", "column", *names[1:])


def shifted_plan(plan: DataFrame) -> DataFrame:
    """plan_y0 and plan_y1 after blocks have been drawn taller than planned: later ones of a column move down.

    plan has doc_id, page, column, block_id, plan_y0, plan_y1, actual_y0, actual_y1, line.  A fold over each column.
    """
    b = F.struct("plan_y0", number(F.col("block_id")).alias("nr"), "block_id", "plan_y1", "actual_y0", "actual_y1", m.gap(F.col("line")).alias("gap"))
    d = plan.groupBy("doc_id", "page", "column").agg(F.array_sort(F.collect_list(b)).alias("bs"))
    empty = F.array().cast("array<struct<block_id:string,y0:double,y1:double,moved:double>>")

    def step(s: Column, x: Column) -> Column:
        want = F.round(F.greatest(x["plan_y0"], s["bottom"] + x["gap"]) - x["plan_y0"], 3)
        by = F.when(s["bottom"].isNotNull() & (want > 0.5), want).otherwise(0.0)
        row = F.struct(x["block_id"].alias("block_id"), (x["plan_y0"] + by).alias("y0"), (x["plan_y1"] + by).alias("y1"), by.alias("moved"))
        return F.struct((F.coalesce(x["actual_y1"], x["plan_y1"]) + by).alias("bottom"), F.concat(s["rows"], F.array(row)).alias("rows"))

    d = d.select("doc_id", "page", "column", F.explode(F.aggregate("bs", F.struct(F.lit(None).cast("double").alias("bottom"), empty.alias("rows")), step)["rows"]).alias("r"))
    return d.select("doc_id", "page", "column", "r.*")


def allowed(fallback: Column) -> Column:
    """Whether a planned block may be drawn."""
    return ~F.coalesce(fallback, F.lit("planner_missing")).isin(*BLOCKED, "planner_missing")


def matched(blocks: DataFrame, plan: DataFrame) -> DataFrame:
    """blocks with their plan (J4, J6): by block_id; plans without an id go, in order (``pos``, if there), to the blocks that are left.

    Blocks without a plan are planner_missing and aren't drawn.
    """
    named = plan.filter("block_id is not null")
    j = blocks.join(named.drop("pos"), ["doc_id", "page", "block_id"], "left")
    if "pos" in plan.columns:
        order = lambda c: F.row_number().over(Window.partitionBy("doc_id", "page").orderBy(c))
        left = blocks.join(named.select("doc_id", "page", "block_id"), ["doc_id", "page", "block_id"], "left_anti").withColumn("__k", order(number(F.col("block_id"))))
        queue = plan.filter("block_id is null").withColumn("__k", order("pos")).drop("block_id", "pos")
        j = blocks.join(named.drop("pos"), ["doc_id", "page", "block_id"]).unionByName(left.join(queue, ["doc_id", "page", "__k"], "left").drop("__k"))
    j = j.withColumn("fallback", F.coalesce("fallback", F.lit("planner_missing")))
    return j.withColumn("drawn", allowed(F.col("fallback")))


def measured(requests: DataFrame, results: DataFrame) -> DataFrame:
    """requests (request_id, ...) with what was measured for each; a request without a result is an error.

    results: request_id, line_count, and height_px or height_pt.
    """
    r = results.select(F.col("request_id").alias("__id"), F.coalesce(*[F.col(c) for c in ("height_px", "height_pt") if c in results.columns]).alias("height"), "line_count")
    j = requests.join(r, F.col("request_id") == F.col("__id"), "left")
    missing = F.raise_error(F.concat(F.lit("no measurement for request "), "request_id")).cast("double")
    return j.withColumn("height", F.when(F.col("__id").isNull(), missing).otherwise(F.col("height"))).drop("__id")


def remembered(validator: Validator, places: int = 3) -> Validator:
    """A validator that answers equal trials from memory (L7): by the block's text, its place, and the candidate, rounded."""
    seen: dict[tuple, tuple[bool, float, float, float]] = {}

    def ask(b: dict, x0: float, y0: float, x1: float, y1: float, c: dict) -> tuple[bool, float, float, float]:
        near = lambda v: None if v is None else round(v, places)
        key = (b.get("text"), b.get("font"), *map(near, (x0, y0, x1, y1, c["scale"], c["font"], c["line"], c["letter"])), c["lines"])
        if key not in seen:
            seen[key] = validator(b, x0, y0, x1, y1, c)
        return seen[key]

    return ask


def text_box(words: DataFrame, *keys: str) -> DataFrame:
    """The rectangle around what was drawn, by keys (L9): around words that aren't blank, else around blocks; null if there is neither.

    words has kind ("word" or "block"), text and x0, y0, x1, y1.
    """
    around = lambda k, f, c: f(F.when((F.col("kind") == k) & (F.trim("text") != ""), F.col(c)))
    sides = [(F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1")]
    return words.groupBy(*keys).agg(*[F.coalesce(around("word", f, c), around("block", f, c)).alias(c) for f, c in sides])


def added_words(before: DataFrame, after: DataFrame) -> DataFrame:
    """The rectangle around words (x0, y0, x1, y1, word, ...) that came in between, one row; null if none did."""
    return after.exceptAll(before).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
