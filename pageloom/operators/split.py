"""Splitters: one unit becomes several, and shares its box with them.

Units have doc_id, ord (input order), path (order below ord), page, label, box (struct left,
bottom, right, top), text, font_size, font_name, toc_page and the metrics lines,
line_height and spacing.  Every step is ``DataFrame -> DataFrame`` without a shuffle; only the
final numbering needs a document's units together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.functions import geometry as g
from pageloom.functions import metrics as m
from pageloom.functions.columns import once
from pageloom.functions.text import collapsed

#: Bullets, and when explicit lines are units of their own.
BULLETS = "●•▪◦■□"
MOST_SEGMENTS, WIDE, TALL, CLOSE = 4, 1.45, 1.75, 1.15
NATURAL_LINE, LEAST_NATURAL, MOST_GAP = 1.2, 1.05, 0.85
SHORT_TITLE_WORDS, FEW_DOTS = 8, 8

SECTION = r"\d+(?:\.\d+)+(?=[\s])"
AT_SECTION = rf"(?U)(?:^|(?<=\s))(?={SECTION})"
AT_MARKER = rf"(?U)(?=[{BULLETS}])|(?:^|(?<=\s))(?=\d+[.)])"
LEADER = r"(?:(?:\.\s*){4,}|(?:·\s*){4,}|(?:․\s*){4,})"
ENTRY = rf"(?Us)(.*?){LEADER}([A-Za-z0-9]+)"
PAGE_AT_END = r"(?U)^(.+?)\s+(\d{1,4}|[ivxlcdmIVXLCDM]{1,8})$"


def _parts(text: Column, at: str) -> Column:
    return F.filter(F.transform(F.split(text, at), m.stripped), lambda x: x != "")


def list_parts(text: Column) -> Column:
    """The items a list unit's text holds, one or several."""
    lines = F.transform(m.full_lines(text), m.stripped)
    t = m.stripped(text)
    sections = F.size(F.regexp_extract_all(t, F.lit(rf"(?U)(?<!\S){SECTION}"), F.lit(0)))
    markers = F.size(F.regexp_extract_all(t, F.lit(rf"(?U)[{BULLETS}]|(?<!\S)\d+[.)]"), F.lit(0)))
    by_section = F.filter(_parts(t, AT_SECTION), lambda x: x.rlike(rf"(?U)^\d+(?:\.\d+)+(?:\s|$)"))
    return F.when(F.size(lines) > 1, lines).when(t == "", F.array().cast("array<string>")).when(sections > 1, by_section).when(markers > 1, _parts(t, AT_MARKER)).otherwise(F.array(t))


def toc_entries(text: Column) -> Column:
    """(text, page) of entries with leaders; null if there is too little of a table of contents."""
    titles, pages = (F.regexp_extract_all(text, F.lit(ENTRY), F.lit(k)) for k in (1, 2))
    both = F.zip_with(titles, pages, lambda a, b: F.struct(m.stripped(a).alias("text"), b.alias("page")))
    both = F.filter(both, lambda x: x["text"] != "")
    dots = F.length(text) - F.length(F.replace(text, F.lit("."), F.lit("")))
    # Looking for a leader first is linear; looking for entries isn't.
    return F.when(text.rlike(f"(?U){LEADER}[A-Za-z0-9]") & ((F.size(both) > 1) | ((F.size(both) == 1) & (dots >= FEW_DOTS))), both)


def trailing_page(text: Column) -> Column:
    """(text, page) of a title that ends in a page number; else null.

    Roman letters count as a number whatever word they spell.
    """
    title, page = m.stripped(F.regexp_extract(text, PAGE_AT_END, 1)), F.regexp_extract(text, PAGE_AT_END, 2)
    return F.when((title != "") & (page != ""), F.struct(title.alias("text"), page.alias("page")))


def explicit_segments(text: Column) -> Column:
    """Paragraphs between blank lines if there are several, else lines."""
    paragraphs = F.filter(F.transform(F.split(text, r"(?U)\n\s*\n"), collapsed), lambda x: x != "")
    return F.when(F.size(paragraphs) > 1, paragraphs).otherwise(F.transform(m.full_lines(text), m.stripped))


def splits_explicitly(text: Column, segments: Column, width: Column, height: Column, font: Column) -> Column:
    """Whether lines are units of their own: blank lines, or lines well short of the box."""
    n = F.size(segments)
    longest = F.array_max(F.transform(segments, m.visible))
    room = width / F.greatest(font * m.GLYPH_WIDTH, F.lit(1.0))
    apart = (height / F.greatest(n, F.lit(1)) >= font * TALL) & (longest <= room * CLOSE)
    known = (font > 0) & (width > 0) & (height > 0) & (longest > 0)
    return n.between(2, MOST_SEGMENTS) & (text.rlike(r"(?U)\n\s*\n") | F.coalesce(known & ((room >= longest * WIDE) | apart), F.lit(False)))


def _segments(c: Column) -> Column:
    """array<string> as segments without a page."""
    return F.transform(c, lambda x: F.struct(x.alias("text"), F.lit("").alias("page")))


def _heights(kind: str) -> Column:
    """(heights, gap) of __segments in a box of height __height."""
    s, total, font = F.col("__segments"), F.col("__height"), F.col("font_size")
    n = F.greatest(F.size(s), F.lit(1))
    zero = F.lit(0.0)
    if kind == "equal":
        return F.struct(F.transform(s, lambda _: total / n).alias("heights"), zero.alias("gap"))
    add = lambda a: F.aggregate(a, zero, lambda x, y: x + y)
    if kind == "weighted":
        w = F.transform(s, lambda x: m.line_count(x["text"], total, font).cast("double"))
        shares = F.transform(F.array(w), lambda ws: F.transform(F.array(F.greatest(add(ws), F.lit(1.0))), lambda all_: F.transform(ws, lambda x: total * x / all_)))  # each bound once
        return F.struct(F.flatten(F.flatten(shares)).alias("heights"), zero.alias("gap"))
    has = F.coalesce(font > 0, F.lit(False))
    natural = F.transform(s, lambda x: F.when(has, F.greatest(font * NATURAL_LINE * F.greatest(F.size(m.full_lines(x["text"])), F.lit(1)), font * LEAST_NATURAL)).otherwise(F.lit(1.0)))
    extra = F.greatest(total - add(natural), zero)
    gap = F.when(has & (F.size(s) > 1), F.least(extra / F.greatest(F.size(s) - 1, F.lit(1)), font * MOST_GAP)).otherwise(zero)
    scale = F.greatest(total - gap * (F.size(s) - 1), zero) / F.greatest(add(natural), F.lit(1.0))
    return F.struct(F.transform(natural, lambda x: x * scale).alias("heights"), gap.alias("gap"))


def subdivided(units: DataFrame, segments: Column, kind: str) -> DataFrame:
    """Units whose segments aren't null become those segments, top to bottom; the last ends where the unit does.

    kind: weighted (by lines), gaps (natural heights with gaps) or equal.  A unit without height stays.
    """
    u = once(units.withColumn("__height", F.abs(g.height(F.col("box")))), __all=segments)
    u = u.withColumn("__segments", F.when((F.size("__all") > 0) & (F.col("__height") > 0), F.col("__all")))
    u = once(u, __h=_heights(kind))
    u = u.select("*", F.posexplode_outer(F.coalesce("__segments", F.array(F.lit(None).cast("struct<text:string,page:string>")))).alias("__at", "__segment"))
    above = F.aggregate(F.slice(F.col("__h.heights"), 1, F.col("__at")), F.lit(0.0), lambda a, x: a + x + F.col("__h.gap"))
    u = once(u, __top=F.col("box.top") - above)
    bottom = F.when(F.col("__at") == F.size("__segments") - 1, F.col("box.bottom")).otherwise(F.col("__top") - F.get(F.col("__h.heights"), F.col("__at")))
    split = F.col("__segment").isNotNull()
    part = F.struct(F.col("box.left").alias("left"), bottom.alias("bottom"), F.col("box.right").alias("right"), F.col("__top").alias("top"))
    u = once(u, box=F.when(split, part).otherwise(F.col("box")))
    u = u.withColumns({"text": F.when(split, F.col("__segment.text")).otherwise(F.col("text")), "toc_page": F.when(split, F.col("__segment.page")).otherwise(F.col("toc_page")), "path": F.when(split, F.concat("path", F.array("__at"))).otherwise(F.col("path"))})
    height = F.abs(g.height(F.col("box")))
    u = once(u, lines=F.when(split, F.lit(1) if kind == "equal" else m.line_count(F.col("text"), height, F.col("font_size"))).otherwise(F.col("lines")))
    u = u.withColumn("line_height", F.when(split, m.line_height(height, F.col("font_size"), F.col("lines"))).otherwise(F.col("line_height")))
    u = u.withColumn("spacing", F.when(split, m.letter_spacing(F.col("text"), F.abs(g.width(F.col("box"))), F.col("font_size"), F.col("lines"))).otherwise(F.col("spacing")))
    return u.select(*units.columns)


def _label() -> Column:
    return F.lower(m.stripped(F.col("label")))


def split_lists(units: DataFrame) -> DataFrame:
    u = once(units, __parts=F.when(_label() == "list item", list_parts(F.col("text"))))
    return subdivided(u, F.when(F.size("__parts") > 1, _segments(F.col("__parts"))), "weighted").select(*units.columns)


def split_toc(units: DataFrame) -> DataFrame:
    u = once(units, __leaders=F.col("text").rlike(f"(?U){LEADER}[A-Za-z0-9]"))
    u = once(u, __entries=F.when(F.col("__leaders"), toc_entries(F.col("text"))), __one=F.when(~F.col("__leaders") & (_label() == "list item"), trailing_page(m.stripped(F.col("text")))))
    return subdivided(u, F.when(F.col("__leaders"), F.col("__entries")).when(F.col("__one").isNotNull(), F.array("__one")), "equal").select(*units.columns)


def normalise_special(units: DataFrame) -> DataFrame:
    """Part headings, page numbers at the end, chapter titles."""
    u = once(units, __said=collapsed(F.col("text")))
    u = once(u, __one=trailing_page(F.col("__said")))
    said, one, paged = F.col("__said"), F.col("__one"), F.col("toc_page") != ""
    section = one["text"].rlike(r"(?U)^\d+(?:\.\d+)+\s")
    label = F.when(section, "list item").when(_label() == "heading", "paragraph").when((_label() == "paragraph") & (F.size(F.split(one["text"], " ")) <= SHORT_TITLE_WORDS), "paragraph")
    part = paged & said.rlike("(?i)^part$")
    inline = ~paged & one.isNotNull() & label.isNotNull()
    u = u.withColumns(
        {
            "__done": paged | inline,
            "text": F.when(part, F.concat(F.lit("PART "), F.col("toc_page"))).when(inline, one["text"]).otherwise(F.col("text")),
            "label": F.when(part, "paragraph").when(inline, label).otherwise(F.col("label")),
            "toc_page": F.when(part, "").when(inline, one["page"]).otherwise(F.col("toc_page")),
        }
    )
    u = once(u, __prefix=F.regexp_extract(said, r"(?i)^(chapter\s+\d+)\s*[A-Z].+$", 1))
    prefix = F.col("__prefix")
    title = m.stripped(F.substring(said, F.length(prefix) + 1, F.length(said)))
    u = once(u, __titled=trailing_page(title))
    titled = F.col("__titled")
    pair = F.array(F.struct(prefix.alias("text"), F.lit("").alias("page")), F.coalesce(titled, F.struct(title.alias("text"), F.lit("").alias("page"))))
    chapter = ~F.col("__done") & _label().isin("heading", "paragraph") & (prefix != "")
    return subdivided(u, F.when(chapter, pair), "gaps").select(*units.columns)


def split_explicit_lines(units: DataFrame) -> DataFrame:
    u = once(units, __lines=explicit_segments(F.col("text")))
    s = F.col("__lines")
    ok = _label().isin("paragraph", "heading", "caption") & splits_explicitly(F.col("text"), s, F.abs(g.width(F.col("box"))), F.abs(g.height(F.col("box"))), F.col("font_size"))
    return subdivided(u, F.when(ok, _segments(s)), "gaps").select(*units.columns)


def renumbered(units: DataFrame) -> DataFrame:
    """unit_id u00001... in each document, in order."""
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord", "path"))
    return units.withColumn("unit_id", F.format_string("u%05d", n))


def may_split(units: DataFrame) -> Column:
    """False only for units that every splitter leaves as they are: one line, no leader, no number at its end, no chapter, no list marks."""
    text = F.coalesce(F.col("text"), F.lit(""))
    marks = (_label() == "list item") & text.rlike(rf"(?U)[{BULLETS}]|(?<!\S)\d+[.)]|(?<!\S){SECTION}")
    return F.coalesce(marks, F.lit(False)) | text.rlike(rf"(?U)[\n\r]|{LEADER}[A-Za-z0-9]|\s(?:\d{{1,4}}|[ivxlcdmIVXLCDM]{{1,8}})\s*$|(?i:^\s*chapter\s)") | (F.coalesce("toc_page", F.lit("")) != "")


def split_units(units: DataFrame) -> DataFrame:
    """All splitters in their order, then numbering.  Units that can't split go round the splitters."""
    may = may_split(units)
    split = units.filter(may)
    for step in (split_lists, split_toc, normalise_special, split_explicit_lines):
        split = step(split)
    return renumbered(split.unionByName(units.filter(~may)))
