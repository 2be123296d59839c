"""Chat formatting (DataFrame functions only).

A declarative template gives the strings before and after a turn and the roles whose text
is learned from.  A finite-state machine over the roles validates the order of turns.  The
result holds text segments with a loss flag each; their concatenation is the formatted
text.  Control strings inside roles and texts are escaped reversibly: ``<``, n backslashes
and ``|`` become ``<``, n+1 backslashes and ``|``, so no control string can arise.

Turns are ordered by turn, then role, then text (ties and repeated rows are kept, null turns come first); null
role or text is empty; a null conv_id is a conversation of its own kind; extra columns are ignored; very long texts are
formatted whole; an empty table gives an empty result.  One conversation is one row, so it must fit into a task: rows
without a conv_id are all one.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks round a turn, roles under the loss mask, and the machine {state: {role: next state}}."""

    start: str = "<|im_start|>"
    after_role: str = "\n"
    end: str = "<|im_end|>\n"
    learned: tuple[str, ...] = ("assistant",)
    first: str = "start"
    moves: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "told", "user": "asked"},
            "told": {"user": "asked"},
            "asked": {"assistant": "answered", "tool": "asked"},
            "answered": {"user": "asked", "tool": "asked"},
        }
    )
    accepted: tuple[str, ...] = ("answered",)


CHATML = Template()


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<$1\\|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*)\|", "<$1|")


def escape_role(c: Column) -> Column:
    """As escape; a line feed, which ends the role, becomes ``<n|`` (and ``<n|`` itself ``<\\n|``)."""
    return F.replace(F.regexp_replace(c, r"<(\\*)(n?)\|", r"<$1\\$2|"), F.lit("\n"), F.lit("<n|"))


def unescape_role(c: Column) -> Column:
    return F.regexp_replace(F.replace(c, F.lit("<n|"), F.lit("\n")), r"<\\(\\*)(n?)\|", "<$1$2|")


def _machine(t: Template) -> Column:
    """State after all turns; the empty state is the sink of a forbidden move."""

    def step(state: Column, turn: Column) -> Column:
        out = F.lit("")
        for s, moves in t.moves.items():
            for role, to in moves.items():
                out = F.when((state == s) & (turn["role"] == role), to).otherwise(out)
        return out

    return F.aggregate("turns", F.lit(t.first), step)


def chat_format(turns: DataFrame, template: Template = CHATML) -> DataFrame:
    """conv_id, n_turns, valid, segments array<struct<text, loss>>, formatted."""
    t = template
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    d = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    segments = F.flatten(
        F.transform(
            "turns",
            lambda x: F.array(
                F.struct(F.concat(F.lit(t.start), escape_role(x["role"]), F.lit(t.after_role)).alias("text"), F.lit(False).alias("loss")),
                F.struct(escape(x["text"]).alias("text"), x["role"].isin(*t.learned).alias("loss")),
                F.struct(F.lit(t.end).alias("text"), F.lit(False).alias("loss")),
            ),
        )
    )
    d = d.select("conv_id", F.size("turns").cast("long").alias("n_turns"), _machine(t).isin(*t.accepted).alias("valid"), segments.alias("segments"))
    return d.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_back(formatted: Column, template: Template = CHATML) -> Column:
    """array<struct<role, text>> of a formatted text."""
    t = template
    parts = F.split(formatted, F.lit(r"\Q" + t.end + r"\E"))
    parts = F.slice(parts, 1, F.size(parts) - 1)
    header = len(t.start) + 1
    return F.transform(
        parts,
        lambda x: F.struct(
            unescape_role(F.substring(F.substring_index(x, t.after_role, 1), header, 1 << 30)).alias("role"),
            unescape(F.substring(x, F.length(F.substring_index(x, t.after_role, 1)) + 1 + len(t.after_role), F.length(x))).alias("text"),
        ),
    )
