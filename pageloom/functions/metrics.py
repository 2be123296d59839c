"""Typography estimated from a text, its box and its font size."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the estimates.
LINE_FACTOR, MOST_LINES, LONG_TEXT = 1.15, 24, 80
LINE_HEIGHT, LEAST_LINE_HEIGHT, MOST_LINE_HEIGHT = 1.2, 1.0, 1.8
GLYPH_WIDTH, SPACING_LOW, SPACING_HIGH, SPACING_NONE = 0.55, -0.05, 0.12, 0.005
SPACED_CHARS = (2, 24)
COMBINED_LOW = -0.22
GAP_SHARE, SAFETY_SHARE = 0.12, 0.08
BLANKS = r"(?U)\s+"
COLOURS = {"paragraph": (0.12, 0.49, 0.95), "heading": (0.87, 0.29, 0.25), "caption": (0.14, 0.64, 0.31), "list item": (0.78, 0.45, 0.1)}
OTHER_COLOUR = (0.5, 0.5, 0.5)


def stripped(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def visible(c: Column) -> Column:
    """Number of characters that aren't white space."""
    return F.length(F.regexp_replace(c, BLANKS, ""))


def full_lines(c: Column) -> Column:
    """Lines that aren't blank."""
    return F.filter(F.split(c, "\r\n|[\n\r]"), lambda x: x.rlike(r"(?U)\S"))


def line_count(text: Column, height: Column, font: Column) -> Column:
    """Lines a box of this height holds, no fewer than the text has."""
    own = F.when(text.contains("\n") | text.contains("\r"), F.greatest(F.size(full_lines(text)), F.lit(1))).otherwise(F.lit(1))
    fits = F.rint(height / F.greatest(font * LINE_FACTOR, F.lit(1.0))).cast("int")
    fits = F.when((F.length(text) >= LONG_TEXT) & (F.length(stripped(text)) >= LONG_TEXT), F.greatest(fits, F.lit(2))).otherwise(fits)
    known = (F.coalesce(font, F.lit(0.0)) > 0) & (height != 0)
    return F.when(known, F.greatest(own, F.least(F.greatest(fits, F.lit(1)), F.lit(MOST_LINES)))).otherwise(own)


def line_height(height: Column, font: Column, lines: Column) -> Column:
    """Null without a font size."""
    even = F.least(F.greatest(height / F.greatest(lines, F.lit(1)), font * LEAST_LINE_HEIGHT), font * MOST_LINE_HEIGHT)
    return F.when(F.coalesce(font, F.lit(0.0)) > 0, F.round(F.when(height == 0, font * LINE_HEIGHT).otherwise(even), 3))


def letter_spacing(text: Column, width: Column, font: Column, lines: Column) -> Column:
    """For one short line: what its width leaves for each character beyond a usual glyph; null if next to nothing."""
    n = visible(text)
    em = (width / F.greatest(n, F.lit(1))) / F.when(font > 0, font) - GLYPH_WIDTH
    em = F.least(F.greatest(em, F.lit(SPACING_LOW)), F.lit(SPACING_HIGH))
    ok = (F.coalesce(font, F.lit(0.0)) > 0) & (lines == 1) & n.between(*SPACED_CHARS) & (width > 0)
    return F.when(ok & (F.abs(em) > SPACING_NONE), F.round(em, 3))


def font_size(given: Column, default: Column) -> Column:
    return F.when(given > 0, given).otherwise(default)


def resolved_lines(given: Column) -> Column:
    """A positive number, rounded, else 1 (P5)."""
    n = F.rint(given.cast("double")).cast("int")
    return F.when(n > 0, n).otherwise(F.lit(1))


def resolved_line_height(given: Column, font: Column) -> Column:
    return F.when(given > 0, given).otherwise(F.round(font * LINE_HEIGHT, 3))


def resolved_spacing(given: Column) -> Column:
    return given.try_cast("double")


def combined_spacing(base: Column, change: Column) -> Column:
    """Sum within bounds; null if next to nothing."""
    x = F.least(F.greatest(F.coalesce(base, F.lit(0.0)) + change, F.lit(COMBINED_LOW)), F.lit(SPACING_HIGH))
    return F.when(F.abs(x) >= SPACING_NONE, F.round(x, 3))


def gap(line_height: Column) -> Column:
    return F.greatest(F.lit(1.0), F.round(line_height * GAP_SHARE, 3))


def safety(line_height: Column) -> Column:
    return F.greatest(F.lit(1.0), F.round(line_height * SAFETY_SHARE, 3))


def toc_row(x0: Column, y0: Column, x1: Column, y1: Column, font: Column) -> Column:
    """Title, leader and page rectangles of a table-of-contents row; whether the leader is drawn."""
    w = x1 - x0
    page = F.least(F.greatest(font * 3.2, w * 0.14), w * 0.24)
    leader = F.least(F.greatest(font * 6.0, w * 0.18), w * 0.34)
    return F.struct((x1 - page - leader).alias("title_x1"), (x1 - page).alias("page_x0"), leader.alias("leader_width"), (leader > font).alias("leader_drawn"))


def leader_text(width: Column, font: Column) -> Column:
    """Dots (P16)."""
    return F.repeat(F.lit("."), F.greatest((width / F.greatest(font * 0.42, F.lit(1.0))).cast("int"), F.lit(4)))


def colour(label: Column) -> Column:
    """[r, g, b] of a box of this label."""
    out = F.array(*map(F.lit, OTHER_COLOUR))
    for k, v in COLOURS.items():
        out = F.when(label == k, F.array(*map(F.lit, v))).otherwise(out)
    return out
