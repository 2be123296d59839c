"""Repair of conversation structure by signature deduplication.

Each conversation, its rows in order of turn, is encoded as a compact string, its signature: one character a row, for its
role and fault.  Only distinct signatures are solved, each once: a memoised recursion over (row, role before it) finds the
cheapest edits that make the roles follow ``(system? (user assistant)+)?``.  Audits are joined back to their conversations
and replayed on the rows.

Faults, the first of these in each row: blank (no visible character), duplicate (role and text seen earlier in the
conversation), truncated (the last visible character ends no sentence).  Edits, with costs: K keep 0, R set role to user or
assistant 2, D delete 3, I insert an empty user or assistant turn 2; a truncated row that stays costs 1 more.  Blank and
duplicate rows must be deleted.  Of equally cheap audits the ASCII-least is taken.

Roles count by their first character (u, a, s; any other can't stay).  A null role or text is one space; rows without a turn
come first; rows of one turn are ordered by role and text, so any layout of the input gives the same result.  A null conv_id is a
conversation of its own.  Very long texts cost what reading them costs; a very long conversation is a string of a character a
row.  An empty table gives empty results; further columns are not read.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.llm.store import Workspace

VISIBLE = r"[^\x20\x09-\x0D]"
ENDED = r"[.!?][\x20\x09-\x0D]*\z"
#: Costs of edits; roles that may follow each other; names of the roles that edits give.
COST = {"K": 0, "R": 2, "D": 3, "I": 2}
TRUNCATED = 1
LEGAL = ("su", "ua", "au")
ROLES = {"u": "user", "a": "assistant"}
#: Rows whose characters are put together at a time.
CHUNK = 4096


def _key(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(" "))


def _rows(conversations: DataFrame) -> DataFrame:
    c = conversations
    said = lambda x: F.coalesce(c[x], F.lit(" ")).alias(x)
    return c.select(_key(c["conv_id"]).alias("key"), c["conv_id"], c["turn"].cast("long").alias("turn"), said("role"), said("text"))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with known faults, by crc32 of ``conv_id:turn`` modulo 20: 0 the row is lost, 1 its text,
    2 its sentence marks, 3 it stands twice, 4 its role is user."""
    r = _rows(conversations).withColumn("fate", F.crc32(F.concat("key", F.lit(":"), _key(F.col("turn")))) % 20).filter("fate <> 0")
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    times = F.sequence(F.lit(1), F.when(F.col("fate") == 3, 2).otherwise(1))
    return r.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")


def faults(conversations: DataFrame) -> DataFrame:
    """Rows with key, pos (1...), fault (blank, duplicate, truncated or null), illegal (the step from the row before), mark (of the signature)."""
    order = [F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")]
    w = Window.partitionBy("key").orderBy(*order)
    r = _rows(conversations).withColumn("initial", F.substring("role", 1, 1))
    r = r.withColumns({"pos": F.row_number().over(w), "before": F.lag("initial").over(w), "last": F.lag("turn").over(w)})
    r = r.withColumn("seen", F.row_number().over(Window.partitionBy("key", "role", "text").orderBy("pos")))
    fault = F.when(~F.col("text").rlike(VISIBLE), "blank").when(F.col("seen") > 1, "duplicate").when(~F.col("text").rlike(ENDED), "truncated")
    r = r.withColumn("fault", fault)
    kind = F.when(F.col("initial").isin("u", "a", "s"), F.col("initial")).otherwise("o")
    mark = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper(kind)).otherwise(kind)
    new = F.col("turn").isNotNull() & (F.col("last").isNull() | (F.col("last") != F.col("turn")))
    illegal = F.col("before").isNotNull() & ~F.concat("before", "initial").isin(*LEGAL)
    return r.select("key", "pos", "turn", "role", "text", "fault", illegal.alias("illegal"), new.alias("new"), mark.alias("mark"))


def signatures(rows: DataFrame) -> DataFrame:
    """Of faults(): key, signature and counts of each conversation; characters are joined chunk by chunk."""
    n = lambda c: F.sum(c.cast("long"))
    line = lambda c, by, x: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, x))), lambda s: s[x]), "").alias(c)
    part = rows.groupBy("key", F.floor((F.col("pos") - 1) / CHUNK).alias("chunk")).agg(
        line("marks", "pos", "mark"), F.min("turn").alias("low"), F.max("turn").alias("high"), n(F.col("new")).alias("turns"), n(F.col("illegal")).alias("illegal"), *[F.count_if(F.col("fault") == k).alias(k) for k in ("blank", "duplicate", "truncated")]
    )
    gaps = F.coalesce(F.max("high") - F.min("low") + 1, F.lit(0)) - F.sum("turns")
    return part.groupBy("key").agg(line("signature", "chunk", "marks"), gaps.alias("gaps"), *[F.sum(k).alias(k) for k in ("blank", "duplicate", "truncated", "illegal")])


STATES = " sua"  # the role before: none yet, system, user, assistant
_NEXT = {" ": "su", "s": "u", "u": "a", "a": "u"}
_FAR = 1 << 60


def solve(signature: str) -> tuple[int, str, list[tuple[str, int]]]:
    """(cost, audit, for each edit the role it gives or "", and its row or 0) of the cheapest, then ASCII-least, edits.

    best(i, state) is the least cost of the rows from i on; its memo is filled from the last row, so the recursion is never deep.
    At most two turns are inserted in a row: a third would come back to a state that was there before.
    """
    n = len(signature)
    best = array("q", [_FAR]) * (4 * (n + 1))

    def moves(i: int, state: str) -> Iterator[tuple[str, int, int, str]]:
        """(edit, cost, next row, next state), in the order of the edits' letters."""
        mark = signature[i] if i < n else None
        due = _NEXT[state][-1]  # what an edit can put here: user, or assistant after a user
        if mark:
            yield "D", COST["D"], i + 1, state
        yield "I", COST["I"], i, due
        if mark and mark != "x":
            extra = TRUNCATED if mark.isupper() else 0
            if mark.lower() in _NEXT[state]:
                yield "K", COST["K"] + extra, i + 1, mark.lower()
            yield "R", COST["R"] + extra, i + 1, due

    for i in range(n, -1, -1):
        for turn in range(3):  # without an insertion, then with one, then with two
            for s, state in enumerate(STATES):
                least = 0 if i == n and state in " a" else best[4 * i + s]
                for _, cost, to, after in moves(i, state):
                    if (to > i) == (turn == 0):
                        least = min(least, cost + best[4 * to + STATES.index(after)])
                best[4 * i + s] = least
    i, state, audit, edits = 0, " ", [], []
    while not (i == n and state in " a" and best[4 * i + STATES.index(state)] == 0):
        left = best[4 * i + STATES.index(state)]
        edit, to, after = next((e, to, after) for e, cost, to, after in moves(i, state) if cost + best[4 * to + STATES.index(after)] == left)
        audit.append(edit)
        edits.append((ROLES[after] if edit in "RI" else "", to if to > i else 0))
        i, state = to, after
    return best[0], "".join(audit), edits


EDITS = "array<struct<edit: string, role: string, pos: int>>"


def _solved(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for x in frames:
        for signature in x["signature"]:
            cost, audit, edits = solve(signature)
            yield pd.DataFrame({"signature": [signature], "cost": [cost], "audit": [audit], "edits": [[{"edit": e, "role": r, "pos": p} for e, (r, p) in zip(audit, edits, strict=True)]]})


def repair(conversations: DataFrame, every: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(audits, repaired): a row a conversation with gaps, blank, duplicate, truncated, illegal, signature, cost, audit; and the repaired
    rows (key, n in order, turn, role, text, edit).  every: a table with the conv_ids that have an audit even without rows.

    key is conv_id as text (a space if null).
    """
    at = Workspace(conversations.sparkSession, "conversations")
    rows = at.keep(faults(conversations), "rows")
    signed = at.keep(signatures(rows), "signatures")
    solved = at.keep(signed.select("signature").distinct().mapInPandas(_solved, f"signature string, cost long, audit string, edits {EDITS}"), "solved")
    found = signed.join(solved, "signature")
    ids = (every if every is not None else conversations).select(_key(F.col("conv_id")).alias("key"), "conv_id").distinct()
    audits = ids.join(found.drop("edits"), "key", "left").na.fill({"signature": "", "audit": "", **dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), 0)})
    each = found.select("key", F.posexplode("edits").alias("n", "e")).filter("e.edit <> 'D'").select("key", "n", "e.edit", F.col("e.role").alias("given"), "e.pos")
    repaired = each.join(rows.select("key", "pos", "turn", "role", "text"), ["key", "pos"], "left")
    inserted = F.col("edit") == "I"
    role = F.when(F.col("given") != "", F.col("given")).otherwise(F.col("role"))
    return audits, repaired.select("key", "n", "turn", role.alias("role"), F.when(inserted, "").otherwise(F.col("text")).alias("text"), "edit")


def digests(repaired: DataFrame) -> DataFrame:
    """key, sha256 of each conversation's ``role:text`` lines, joined by line ends; rows pass as a sorted stream, one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, h = None, None
        for b in batches:
            done = []
            for k, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if k != key:
                    done += [(key, h.hexdigest())] if h else []
                    key, h = k, hashlib.sha256()
                else:
                    h.update(b"\n")
                h.update(line.encode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_pydict({"key": pa.array([x[0] for x in done], pa.string()), "sha256": pa.array([x[1] for x in done], pa.string())})
        if h:
            yield pa.RecordBatch.from_pydict({"key": [key], "sha256": [h.hexdigest()]})

    lines = repaired.select("key", "n", F.concat("role", F.lit(":"), "text").alias("line")).repartition("key").sortWithinPartitions("key", "n")
    return lines.select("key", "line").mapInArrow(run, "key string, sha256 string")
