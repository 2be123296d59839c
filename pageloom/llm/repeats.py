"""Removal of repeated byte strings by sparse distributed prefix doubling.

A byte goes if it is covered by a ``length``-byte string (50) that also starts in a document
with a smaller doc_id.  Prefix doubling ranks positions by their first h bytes, then sorts
pairs (rank at i, rank at i + h) to rank them by 2h, until ranks are unique or past the
threshold.  Here:

* Positions are sampled by content: of the h-byte strings (h = 24) inside each 50-byte string,
  the one with the smallest rank is its anchor.  Equal strings have equal anchors at equal
  offsets, so only anchors are sorted, about one position in 14; a rank is a 64-bit name.
* Round 1 sorts (name of an anchor, two independent names of its context, doc_id): the context is all that the
  strings of this anchor cover.  A name met once is unique and falls away.  A context that
  a smaller document has too is repeated whole, and past the threshold at once.
* Round 2, for anchors whose name is shared but whose contexts differ: the offset grows by half of what is left, to
  both sides; the 37 bytes up to the anchor's end and the 37 from its start get names, and a side whose name one document
  alone has is unique.
* Round 3, for the other sides: the offset grows to the full length; each 50-byte string that holds such a side is
  sorted by the pair of names of its halves, and is repeated if the pair's smallest document is another.

Each round goes in slices, one after the other: anchors and strings by their names, texts by their doc_id.  A slice has all
rows of its names, so results don't depend on it; what lies on disk at a time is a share of a round's rows.

Sorting is Spark's; what comes back to a document are spans.  A null or empty text has nothing
to remove.  A null doc_id takes no part in comparisons and keeps all its bytes.  Rows that repeat a doc_id are judged
alike: only smaller doc_ids count.  An empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm import bytehash as bh
from pageloom.llm.store import Workspace

LENGTH, NAME = 50, 24
#: Slices of names of anchors (each reads all texts again), of texts whose strings are named, and of names of strings.
ANCHORS, TEXTS, STRINGS = 2, 2, 2
PART = 1 << 16  # strings that start in so many bytes are handled together, so that arrays stay in the processor's cache
_INDEX = np.uint64((1 << 20) - 1)


class Contexts:
    """Anchors of a piece of text: position p, strings from first to last (starts), names a, c and e (c and e by different bases)."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, starts: int | None = None, piece: int | None = None):
        """data: texts one after the other, each ending at one of ends; strings starting at ``starts`` or later are left out.

        piece: only anchors whose names are in that one of the ANCHORS slices.
        """
        none = np.zeros(0, np.int64)
        self.p = self.first = self.last = none
        self.a = self.c = self.e = np.zeros(0, np.uint64)
        self.sums = self.other = np.zeros(1, np.uint64)
        n = len(data) - LENGTH + 1
        if n <= 0:
            return
        self.sums = bh.prefix_sums(data)
        names = bh.kgrams(self.sums, NAME)
        # The smallest name in each window, the leftmost if several are (44 bits tell names apart).
        window = LENGTH - NAME + 1
        low = names & ~_INDEX
        low |= np.arange(len(names), dtype=np.uint64)
        step = 1
        while 2 * step <= window:
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        low = np.minimum(low[: len(low) - (window - step)], low[window - step :])
        p = (low & _INDEX).astype(np.int64)
        # A string may not reach over its text's end.
        ok = np.ones(n, bool)
        for end in ends[ends < len(data)]:
            ok[max(0, end - LENGTH + 1) : end] = False
        if starts is not None:
            ok[starts:] = False
        changed = np.empty(n + 1, bool)
        changed[0] = changed[n] = True
        np.not_equal(p[1:], p[:-1], out=changed[1:n])
        self.first = np.flatnonzero(ok & (changed[:n] | np.concatenate([[True], ~ok[:-1]])))
        self.last = np.flatnonzero(ok & (changed[1:] | np.concatenate([~ok[1:], [True]])))
        self.p = p[self.first]
        self.a = bh.mix(names[self.p])
        if piece is not None:
            mine = np.flatnonzero(self.a % np.uint64(ANCHORS) == np.uint64(piece))
            self.p, self.a, self.first, self.last = self.p[mine], self.a[mine], self.first[mine], self.last[mine]
        self.other = bh.prefix_sums(data, bh.BASES[1])
        before = (self.p - self.first).astype(np.uint64)
        self.c = bh.mix(bh.spans(self.other, self.first, self.last + LENGTH, bh.BASES[1]) + before)
        self.e = bh.mix(bh.spans(self.sums, self.first, self.last + LENGTH) + before)

    def strings(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All starts from first to last, and the pair of names of each string."""
        size = last - first + 1
        at = np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()) if len(first) else np.zeros(0, np.int64)
        half = LENGTH // 2
        # Both names over the whole length: rank pair (first half, second half), each folded with the other base.
        left = bh.spans(self.sums, at, at + half) + np.uint64(0x9E3779B97F4A7C15) * bh.spans(self.sums, at + half, at + LENGTH)
        right = bh.spans(self.other, at, at + half, bh.BASES[1]) + np.uint64(0xD1342543DE82EF95) * bh.spans(self.other, at + half, at + LENGTH, bh.BASES[1])
        return at, bh.mix(left), bh.mix(right)


def parts(data: np.ndarray, offsets: np.ndarray, piece: int | None = None) -> Iterator[tuple[int, int, int, Contexts]]:
    """(i, j, shift, contexts) for texts i..j; positions count from data[shift].  A long text comes in several parts."""
    for i, j in bh.pieces(offsets, PART):
        a, b = int(offsets[i]), int(offsets[j])
        if b - a <= PART:
            yield i, j, a, Contexts(data[a:b], offsets[i + 1 : j + 1] - a, None, piece)
        else:
            for s in range(a, b, PART):
                e = min(b, s + PART + LENGTH - 1)
                yield i, j, s, Contexts(data[s:e], np.array([e - s]), PART, piece)


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def _key(a: np.ndarray, c: np.ndarray, e: np.ndarray) -> np.ndarray:
    """What a context is called within its document."""
    return bh.mix(a + np.uint64(0x9E3779B97F4A7C15) * c + np.uint64(0xD1342543DE82EF95) * e)


def _anchors(batches: Iterator[pa.RecordBatch], piece: int | None = None) -> Iterator[pa.RecordBatch]:
    """a, c, e, doc_id: each context of a document, once in a part."""
    for b in bh.tidy(batches):
        data, offsets = bh.text_buffers(b.column(1))
        ids = b.column(0).to_numpy(zero_copy_only=False)
        for i, j, shift, x in parts(data, offsets, piece):
            if not len(x.p):
                continue
            of = np.searchsorted(offsets[i : j + 1], x.first + shift, "right") - 1 + i
            order = np.lexsort((x.e, x.c, x.a, of))
            a, c, e, of = x.a[order], x.c[order], x.e[order], of[order]
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1]) | (e[1:] != e[:-1]) | (of[1:] != of[:-1])
            yield pa.RecordBatch.from_arrays([_longs(a[new]), _longs(c[new]), _longs(e[new]), _longs(ids[of[new]])], names=["a", "c", "e", "doc_id"])


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, c, e, doc_id) in order -> (doc_id, key, whole).

    whole: a smaller document has the context.  Not whole: the first document of a context whose
    anchor other contexts share, to be looked into.  A row is held until it is
    known whether another context follows.
    """
    last = None  # (a, c, e, doc_id) of the first row of the last context, and whether its anchor has others (then it was given out)
    for b in bh.tidy(batches):
        a, c, e, d = (b.column(k).to_numpy(zero_copy_only=False) for k in range(4))
        if not len(a):
            continue
        if last:
            a, c, e, d = (np.concatenate([[x], y]) for x, y in zip(last[:4], (a, c, e, d), strict=True))
        same_a = np.concatenate([[False], a[1:] == a[:-1]])
        same_c = same_a & np.concatenate([[False], (c[1:] == c[:-1]) & (e[1:] == e[:-1])])
        head = d[np.maximum.accumulate(np.where(same_c, 0, np.arange(len(a))))]
        whole = same_c & (d > head)
        group = np.cumsum(~same_a) - 1
        shared = np.zeros(group[-1] + 1, bool)
        shared[group[same_a & ~same_c]] = True
        if last and last[4]:
            shared[0] = True
        look = ~same_c & shared[group]
        if last and last[4]:
            look[0] = False
        yield _out(a[whole], c[whole], e[whole], d[whole], True)
        yield _out(a[look], c[look], e[look], d[look], False)
        last = (a[-1], c[-1], e[-1], head[-1], bool(shared[-1]))


def _out(a, c, e, d, whole: bool) -> pa.RecordBatch:
    a, c, e = (np.asarray(x, np.int64).view(np.uint64) for x in (a, c, e))
    return pa.RecordBatch.from_arrays([_longs(np.asarray(d, np.int64)), _longs(_key(a, c, e)), pa.array(np.full(len(a), whole))], names=["doc_id", "key", "whole"])


def _within(x: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(x), bool)
    return keys[np.minimum(np.searchsorted(keys, x), len(keys) - 1)] == x


def _of_text(keys: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Keys of several texts made different from each other's."""
    return keys.astype(np.uint64) ^ bh.mix(text.astype(np.uint64) + np.uint64(1))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and the row of each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(sizes)), sizes)


def _chosen(data: np.ndarray, offsets: np.ndarray, *keys: pa.Array) -> Iterator[tuple[int, Contexts, list[np.ndarray], np.ndarray]]:
    """(shift, contexts, for each column of keys the indices of those named in their text's keys, the text of every context)."""
    wanted = []
    for k in keys:
        values, rows = _flat(k)
        wanted.append(np.sort(_of_text(values.view(np.uint64), rows)))
    for i, j, shift, x in parts(data, offsets):
        of = np.searchsorted(offsets[i : j + 1], x.first + shift, "right") - 1 + i
        name = _of_text(_key(x.a, x.c, x.e), of)
        yield shift, x, [np.flatnonzero(_within(name, w)) for w in wanted], of


#: What a side of an anchor is named by: half of what the anchor leaves of the length, to one side.
REACH = (LENGTH - NAME) // 2


def _sides(x: Contexts, hit: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each side, the anchors of hit whose strings hold it, and its name (a pair's two halves in one)."""
    p = x.p[hit]
    for side, ok, a, b in ((0, x.first[hit] <= p - REACH, p - REACH, p + NAME), (1, x.last[hit] > p - REACH, p, p + NAME + REACH)):
        a, b = a[ok], b[ok]
        yield side, ok, bh.mix(bh.spans(x.sums, a, b) + np.uint64(0x9E3779B97F4A7C15) * bh.spans(x.other, a, b, bh.BASES[1]) + np.uint64(side))


def _extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text, keys -> name and document of each side of the anchors to look into."""
    for b in bh.tidy(batches):
        data, offsets = bh.text_buffers(b.column(1))
        ids = b.column(0).to_numpy(zero_copy_only=False)
        for _, x, (hit,), of in _chosen(data, offsets, b.column(2)):
            key = _key(x.a[hit], x.c[hit], x.e[hit])
            for side, ok, name in _sides(x, hit):
                if len(name):
                    yield pa.RecordBatch.from_arrays([_longs(name), _longs(ids[of[hit[ok]]]), _longs(key[ok]), pa.array(np.full(len(name), side, np.int32))], names=["name", "doc_id", "key", "side"])


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text, keys by side -> doc_id, start and the pair of names of each string that holds one of the sides."""
    for b in bh.tidy(batches):
        data, offsets = bh.text_buffers(b.column(1))
        ids = b.column(0).to_numpy(zero_copy_only=False)
        for shift, x, (left, right), of in _chosen(data, offsets, b.column(2), b.column(3)):
            # A string belongs to the left side if it starts REACH bytes or more before the anchor, else to the right.
            hit = np.concatenate([left, right])
            first = np.concatenate([x.first[left], np.maximum(x.first[right], x.p[right] - REACH + 1)])
            last = np.concatenate([np.minimum(x.last[left], x.p[left] - REACH), x.last[right]])
            ok = first <= last
            if not ok.any():
                continue
            hit, first, last = of[hit[ok]], first[ok], last[ok]
            at, r1, r2 = x.strings(first, last)
            text = np.repeat(hit, last - first + 1)
            yield pa.RecordBatch.from_arrays([_longs(r1), _longs(r2), _longs(ids[text]), _longs(at + shift - offsets[text])], names=["r1", "r2", "doc_id", "start"])


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (r1, r2, doc_id, start) in order -> (doc_id, start) of the strings that a smaller document has too."""
    last = None  # r1, r2 and first document of the last string
    for b in bh.tidy(batches):
        r1, r2, d, start = (b.column(k).to_numpy(zero_copy_only=False) for k in range(4))
        if not len(d):
            continue
        same = np.concatenate([[last is not None and (r1[0], r2[0]) == last[:2]], (r1[1:] == r1[:-1]) & (r2[1:] == r2[:-1])])
        head = d[np.maximum.accumulate(np.where(same, 0, np.arange(len(d))))]
        if last and same[0]:
            head[: len(d) if same.all() else int(np.argmin(same))] = last[2]
        gone = d > head
        yield pa.RecordBatch.from_arrays([_longs(d[gone]), _longs(start[gone])], names=["doc_id", "start"])
        last = (r1[-1], r2[-1], head[-1])


def _mark(edge: np.ndarray, first: np.ndarray, last: np.ndarray) -> None:
    """Strings starting from first to last cover bytes."""
    np.add.at(edge, first, 1)
    np.add.at(edge, np.minimum(last + LENGTH, len(edge) - 1), -1)


SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])


def _cleaned(part: pa.RecordBatch, named: bool) -> pa.RecordBatch:
    """Of doc_id, text, whole, strings, as _removed; named: some rows have keys in whole."""
    data, offsets = bh.text_buffers(part.column(1))
    base = int(offsets[0])
    data, offsets = data[base : int(offsets[-1])], offsets - base
    edge = np.zeros(len(data) + 1, np.int32)
    starts, rows = _flat(part.column(3))
    _mark(edge, starts + offsets[rows], starts + offsets[rows])
    if named:
        for shift, x, (hit,), _ in _chosen(data, offsets, part.column(2)):
            _mark(edge, x.first[hit] + shift, x.last[hit] + shift)
    gone = np.cumsum(edge[:-1]) > 0
    before = np.concatenate([[0], np.cumsum(gone)])[offsets]
    n_bytes, n_removed = np.diff(offsets), np.diff(before)
    # Runs of removed bytes, cut at the ends of texts.
    inside = np.zeros(len(data) + 1, bool)
    inside[offsets] = True
    prior, after = np.concatenate([[False], gone[:-1]]), np.concatenate([gone[1:], [False]])
    start, end = np.flatnonzero(gone & (~prior | inside[:-1])), np.flatnonzero(gone & (~after | inside[1:])) + 1
    of = np.searchsorted(offsets, start, "right") - 1
    per = np.searchsorted(of, np.arange(part.num_rows + 1)).astype(np.int32)
    spans = pa.ListArray.from_arrays(pa.array(per), pa.StructArray.from_arrays([_longs(start - offsets[of]), _longs(end - offsets[of])], fields=list(SPAN)))
    left = data[~gone]
    kept = pa.Array.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer(np.ascontiguousarray(offsets - before).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(left))]).cast(pa.binary())
    return pa.RecordBatch.from_arrays([part.column(0), _longs(n_bytes), _longs(n_removed), spans, kept], names=["doc_id", "n_bytes", "n_removed", "spans", "kept"])


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text, whole (keys), strings (starts) -> doc_id, n_bytes, n_removed, spans array<struct<start, end>>, kept (bytes).

    Only texts that have keys are named again.
    """
    for b in bh.tidy(batches):
        keyed = pc.fill_null(pc.greater(pc.list_value_length(b.column(2)), 0), False)
        for named, rows in ((True, b.filter(keyed)), (False, b.filter(pc.invert(keyed)))):
            for i, j in bh.pieces(bh.text_buffers(rows.column(1))[1], 1 << 22):
                yield _cleaned(rows.slice(i, j - i), named)


def _in_slices(at: Workspace, name: str, n: int, of: Callable[[int], DataFrame]) -> DataFrame:
    """What ``of`` makes of each of n slices, written one after the other (name-0 ...) and read as one."""
    made = [at.keep(of(k), f"{name}-{k}") for k in range(n)]
    return at.spark.read.schema(made[0].schema).parquet(*(f"{at.path}/{name}-{k}" for k in range(n)))


def _drop(at: Workspace, name: str, n: int) -> None:
    at.drop(*(f"{name}-{k}" for k in range(n)))


def remove_repeats(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans, kept (bytes) for each row of documents."""
    at = Workspace(documents.sparkSession, "repeats")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = docs.filter("doc_id is not null")
    mine = lambda c, n, k: F.pmod(F.xxhash64(c), F.lit(n)) == k

    def ranked(k: int) -> DataFrame:
        named = known.mapInArrow(lambda batches: _anchors(batches, k), "a long, c long, e long, doc_id long")
        return named.repartition("a").sortWithinPartitions("a", "c", "e", "doc_id").mapInArrow(_ranked, "doc_id long, key long, whole boolean")

    ranks = _in_slices(at, "ranks", ANCHORS, ranked)
    # Names of sides: only those that several documents have go on.
    look = ranks.filter("not whole").groupBy("doc_id").agg(F.collect_list("key").alias("keys"))
    sides = known.join(look, "doc_id").select("doc_id", "text", "keys").mapInArrow(_extended, "name long, doc_id long, key long, side int")
    sides = at.keep(sides, "sides")
    shared = sides.groupBy("name").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high").select("name")
    of = lambda k: F.collect_list(F.when(F.col("side") == k, F.col("key")))
    look = at.keep(sides.join(shared, "name").groupBy("doc_id").agg(of(0).alias("left"), of(1).alias("right")), "look")
    at.drop("sides")

    def named(k: int) -> DataFrame:
        both = known.filter(mine("doc_id", TEXTS, k)).join(look.filter(mine("doc_id", TEXTS, k)), "doc_id")
        return both.select("doc_id", "text", "left", "right").mapInArrow(_strings, "r1 long, r2 long, doc_id long, start long")

    pairs = _in_slices(at, "pairs", TEXTS, named)
    at.drop("look")

    def repeated(k: int) -> DataFrame:
        return pairs.filter(mine("r1", STRINGS, k)).repartition("r1").sortWithinPartitions("r1", "r2", "doc_id").mapInArrow(_repeated, "doc_id long, start long")

    starts = _in_slices(at, "starts", STRINGS, repeated)
    _drop(at, "pairs", TEXTS)
    whole = ranks.filter("whole").select("doc_id", "key", F.lit(None).cast("long").alias("start"))
    each = whole.unionByName(starts.select("doc_id", F.lit(None).cast("long").alias("key"), "start"))
    found = at.keep(each.groupBy("doc_id").agg(F.collect_list("key").alias("whole"), F.collect_set("start").alias("strings")), "found")
    _drop(at, "ranks", ANCHORS)
    _drop(at, "starts", STRINGS)
    out = docs.join(found, "doc_id", "left").select("doc_id", "text", "whole", "strings")
    return out.mapInArrow(_removed, "doc_id long, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept binary")
