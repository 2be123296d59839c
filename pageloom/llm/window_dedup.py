"""Removal of repeated runs of words behind a count-min prefilter.

A word goes if it is covered by a window of ``WINDOW`` words (20) whose word sequence also starts earlier: in a document with a
smaller doc_id, or earlier in the same one.  Windows are judged on the input.

* Of the 8-word sequences inside a window, the one with the smallest hash is its anchor.  Equal windows have equal anchors at
  equal offsets, so a window can't be found more often than its anchor.
* Pass 1: each task counts its anchors in a sketch of two rows of counters that stop at 2 (two bit planes).  The sketches of
  all tasks are merged, block by block.  A sketch never counts too little: the merged one overestimates how often each window is found.
* Pass 2: windows whose anchor is counted twice or more are grouped exactly; all others are unique.  What is grouped is the
  context of an anchor, all words covered by its windows: the first document of each context is an aggregate, combined in each task
  before the shuffle.  Every later copy of a context is repeated whole.
* Windows of first contexts whose anchor other contexts share (the edges of passages) are grouped one by one in the same way.

What comes back to a document is only what it is first in, so a passage in very many documents is no hot key: it is a row a task in
the shuffle and a row in the result.  The sketch has 2**28 counters a row at most (64 MB to broadcast), by the size of the texts; beyond some
3 GB of text it lets more unique windows through, which costs time but no result: contexts are about one in seven windows.
Exact means by two independent 64-bit hashes of the words.

Words are as they stand, case and all.  A null or empty text has no words.  A null doc_id takes no part and keeps all its words.
Rows that repeat a doc_id are parts of one document, in the order of a hash of their texts; equal rows are judged alike.  Very long texts are
read in parts.  An empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm import bytehash as bh
from pageloom.llm.store import Workspace

WINDOW, GRAM = 20, 8
#: Bytes of text, and words, handled together; bits of a block of the sketch; the most and least counters of a row, as powers of two.
PART, WORDS, BLOCK, MOST, LEAST = 1 << 20, 1 << 18, 1 << 19, 28, 19
_INDEX = np.uint64((1 << 20) - 1)
_AGAIN = np.uint64(0x9E3779B97F4A7C15)


def _word_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, first word of each text (and their number)."""
    start, end, first, _ = bh.words(data, bounds, lower=False)
    return start, end, first


class Texts:
    """Some texts as rows of word hashes: two a word, and the first word of each text."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.start, self.end, self.first = _word_spans(data, bounds)
        self.x, self.y = (np.concatenate([np.zeros(0, np.uint64), *self._hashes(data, base)]) for base in bh.BASES)

    def _hashes(self, data: np.ndarray, base: int) -> Iterator[np.ndarray]:
        """A long text's words are hashed in parts (a word is never cut)."""
        n, i = len(self.start), 0
        while i < n:
            a = int(self.start[i])
            j = max(i + 1, int(np.searchsorted(self.end, a + PART, "right")))
            sums = bh.prefix_sums(data[a : int(self.end[j - 1])], base)
            yield bh.spans(sums, self.start[i:j] - a, self.end[i:j] - a, base)
            i = j

    def runs(self) -> Iterator[Runs]:
        """Windows by their anchors, so many words at a time."""
        n = len(self.x)
        for s in range(0, max(0, n - WINDOW + 1), WORDS):
            yield Runs(self, s, min(n, s + WORDS + WINDOW - 1))


class Runs:
    """Windows that start at words s to e - WINDOW, in runs of one anchor: first and last start (words of the texts), a."""

    def __init__(self, texts: Texts, s: int, e: int):
        x = texts.x[s:e]
        n = e - s - WINDOW + 1
        up = bh.Powers.of(bh.BASES[0], e - s + 1).up
        self.s, self.sums = s, np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * up[: e - s])])
        up = bh.Powers.of(bh.BASES[1], e - s + 1).up
        self.other = np.concatenate([np.zeros(1, np.uint64), np.cumsum(texts.y[s:e] * up[: e - s])])
        grams = bh.mix(bh.kgrams(self.sums, GRAM))
        low = grams & ~_INDEX
        low |= np.arange(len(grams), dtype=np.uint64)
        size, step = WINDOW - GRAM + 1, 1
        while 2 * step <= size:
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        low = np.minimum(low[: len(low) - (size - step)], low[size - step :])
        p = (low & _INDEX).astype(np.int64)
        ok = np.ones(n, bool)  # a window doesn't reach over its text's end
        for end in texts.first[1:-1]:
            if s < end < e:
                ok[max(0, end - s - WINDOW + 1) : end - s] = False
        changed = np.ones(n + 1, bool)
        np.not_equal(p[1:], p[:-1], out=changed[1:n])
        before, after = np.concatenate([[True], ~ok[:-1]]), np.concatenate([~ok[1:], [True]])
        self._first = np.flatnonzero(ok & (changed[:n] | before))
        self._last = np.flatnonzero(ok & (changed[1:] | after))
        self.p = p[self._first]
        self.a = grams[self.p]
        self.first, self.last = self._first + s, self._last + s

    def only(self, k: np.ndarray) -> Runs:
        for name in ("_first", "_last", "p", "a", "first", "last"):
            setattr(self, name, getattr(self, name)[k])
        return self

    def names(self) -> tuple[np.ndarray, np.ndarray]:
        """Two names of each run's words and of where its anchor stands among them."""
        offset = (self.p - self._first).astype(np.uint64)
        b, e = self._first, self._last + WINDOW
        return bh.mix(bh.spans(self.sums, b, e) + offset), bh.mix(bh.spans(self.other, b, e, bh.BASES[1]) + offset)

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and two names of every window of the runs."""
        size = self._last - self._first + 1
        at = np.repeat(self._first - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return at + self.s, bh.spans(self.sums, at, at + WINDOW), bh.spans(self.other, at, at + WINDOW, bh.BASES[1])


def _texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, int, int, Texts, np.ndarray]]:
    """(batch, i, j, texts i..j of it, their bytes)."""
    for b in bh.tidy(batches):
        data, offsets = bh.text_buffers(b.column(column))
        for i, j in bh.pieces(offsets, PART):
            own = data[int(offsets[i]) : int(offsets[j])]
            yield b, i, j, Texts(own, offsets[i : j + 1] - offsets[i]), own


def _places(a: np.ndarray, bits: int) -> list[np.ndarray]:
    """The counter of each anchor in the two rows."""
    return [(x >> np.uint64(64 - bits)).astype(np.int64) for x in (a, bh.mix(a ^ _AGAIN))]


class Sketch:
    """Two rows of 2**bits counters that stop at 2, as bit planes: seen, and seen again."""

    def __init__(self, bits: int):
        self.bits = bits
        self.seen, self.again = (np.zeros((2, 1 << (bits - 3)), np.uint8) for _ in range(2))

    def add(self, a: np.ndarray) -> None:
        for r, place in enumerate(_places(a, self.bits)):
            place, n = np.unique(place, return_counts=True)
            if not len(place):
                continue
            byte, bit = place >> 3, (1 << (place & 7)).astype(np.uint8)
            head = np.flatnonzero(np.concatenate([[True], byte[1:] != byte[:-1]]))
            once, twice = np.bitwise_or.reduceat(bit, head), np.bitwise_or.reduceat(np.where(n > 1, bit, 0).astype(np.uint8), head)
            at = byte[head]
            self.again[r, at] |= twice | (self.seen[r, at] & once)
            self.seen[r, at] |= once


def _sketched(bits: int):
    """A task's sketch: row, block, the two planes, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, size = Sketch(bits), _block(bits)
        for _, _, _, t, _ in _texts(batches, 0):
            for x in t.runs():
                s.add(x.a)
        for r in range(2):
            for k in range(0, 1 << (bits - 3), size):
                seen, again = s.seen[r, k : k + size], s.again[r, k : k + size]
                if seen.any():
                    yield pa.RecordBatch.from_pydict({"row": pa.array([r], pa.int32()), "block": pa.array([k // size], pa.int32()), "seen": [pa.compress(seen, "zstd", asbytes=True)], "again": [pa.compress(again, "zstd", asbytes=True)]})

    return run


def _block(bits: int) -> int:
    """Bytes of a block of a plane."""
    return min(BLOCK, 1 << bits) >> 3


def _merged(size: int):
    """Planes (blocks of ``size`` bytes) in order of row and block -> one plane of what is seen again for each; a block at a time is held."""

    def out(key: tuple[int, int], again: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"row": pa.array([key[0]], pa.int32()), "block": pa.array([key[1]], pa.int32()), "again": [pa.compress(again, "zstd", asbytes=True)]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, seen, again = None, None, None
        for b in batches:
            for row, block, s, t in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                s, t = (np.frombuffer(pa.decompress(v, size, "zstd", asbytes=True), np.uint8) for v in (s, t))
                if key != (row, block):
                    if key:
                        yield out(key, again)
                    key, seen, again = (row, block), s.copy(), t.copy()
                else:
                    again |= t | (seen & s)
                    seen |= s
        if key:
            yield out(key, again)

    return run


def sketch(texts: DataFrame, at: Workspace, most: int = MOST) -> tuple[int, np.ndarray]:
    """Bits, and the plane (two rows) of what is counted twice or more, over the anchors of all texts (column text)."""
    n = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(most, max(LEAST, (n // 16).bit_length()))
    size = _block(bits)
    parts = texts.select("text").mapInArrow(_sketched(bits), "row int, block int, seen binary, again binary")
    merged = parts.repartition("row", "block").sortWithinPartitions("row", "block").mapInArrow(_merged(size), "row int, block int, again binary")
    plane = np.zeros((2, 1 << (bits - 3)), np.uint8)
    for r in at.keep(merged, "sketch").toLocalIterator():  # at most 2 * 2**most bits, 64 MB
        k = r["block"] * size
        plane[r["row"], k : k + size] = np.frombuffer(pa.decompress(bytes(r["again"]), size, "zstd", asbytes=True), np.uint8)
    return bits, plane


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def _lists(column: pa.Array, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Values of rows i..j of a list column (sorted in each row by Spark), and the row of each, from 0."""
    c = column.slice(i, j - i)
    values = c.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return values, np.repeat(np.arange(j - i), np.diff(c.offsets.to_numpy(zero_copy_only=False)))


def _among(x: np.ndarray, found: np.ndarray) -> np.ndarray:
    found = np.sort(found)
    return found[np.minimum(np.searchsorted(found, x), len(found) - 1)] == x if len(found) else np.zeros(len(x), bool)


def remove_repeats(documents: DataFrame, most: int = MOST) -> DataFrame:
    """doc_id, n_words, n_removed, spans (removed runs of words), kept (the other words, joined by one space) for each row.

    most: counters of a row of the sketch, as a power of two; it changes time, not results.
    """
    spark = documents.sparkSession
    at = Workspace(spark, "windows")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), "text")
    known = docs.filter("doc_id is not null and text is not null")
    bits, plane = sketch(known, at, most)
    counted = spark.sparkContext.broadcast(plane)

    def repeated(a: np.ndarray) -> np.ndarray:
        """Whether each anchor is counted twice or more."""
        yes = np.ones(len(a), bool)
        for r, place in enumerate(_places(a, bits)):
            yes &= (counted.value[r][place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
        return yes

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, i, _, t, _ in _texts(batches, 2):
            ids, rows = (b.column(k).to_numpy(zero_copy_only=False)[i:] for k in (0, 1))
            for x in t.runs():
                x = x.only(repeated(x.a))
                of = np.searchsorted(t.first, x.first, "right") - 1
                yield pa.RecordBatch.from_arrays([*map(_longs, (x.a, *x.names(), ids[of], rows[of], x.first - t.first[of]))], names=["a", "x", "y", "doc_id", "row", "start"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, i, j, t, _ in _texts(batches, 2):
            ids, rows = (b.column(k).to_numpy(zero_copy_only=False)[i:] for k in (0, 1))
            starts, of = _lists(b.column(3), i, j)
            wanted = t.first[of] + starts
            for r in t.runs():
                start, x, y = r.only(_among(r.first, wanted)).windows()
                of = np.searchsorted(t.first, start, "right") - 1
                yield pa.RecordBatch.from_arrays([*map(_longs, (x, y, ids[of], rows[of], start - t.first[of]))], names=["x", "y", "doc_id", "row", "start"])

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, i, j, t, data in _texts(batches, 1):
            takes_part = np.asarray(b.column(0).slice(i, j - i).is_valid())
            # Whole contexts that are the first, contexts to look into, and the first windows of these.
            whole, looked, single = (t.first[of] + v for v, of in (_lists(b.column(k), i, j) for k in (2, 3, 4)))
            edge = np.zeros(len(t.x) + 1, np.int32)
            for r in t.runs():
                k = repeated(r.a) & takes_part[np.searchsorted(t.first, r.first, "right") - 1] & ~_among(r.first, whole)
                look = _among(r.first, looked)
                np.add.at(edge, r.first[k & ~look], 1)
                np.add.at(edge, r.last[k & ~look] + WINDOW, -1)
                start, _, _ = r.only(k & look).windows()
                start = start[~_among(start, single)]
                np.add.at(edge, start, 1)
                np.add.at(edge, start + WINDOW, -1)
            yield _result(b.column(0).slice(i, j - i), t, data, np.cumsum(edge[:-1]) > 0)

    lists = lambda c: F.array_sort(F.collect_list(c))
    first = F.min(F.struct("doc_id", "row", "start")).alias("f")
    found = known.mapInArrow(contexts, "a long, x long, y long, doc_id long, row long, start long")
    firsts = at.keep(found.groupBy("a", "x", "y").agg(first).select("a", "f.*"), "firsts")
    shared = firsts.groupBy("a").agg(F.count("*").alias("n"))
    firsts = at.keep(firsts.join(shared, "a").select("doc_id", "row", "start", (F.col("n") > 1).alias("look")), "looked")
    look = firsts.filter("look").groupBy("doc_id", "row").agg(lists("start").alias("starts"))
    each = known.join(look, ["doc_id", "row"]).select("doc_id", "row", "text", "starts").mapInArrow(windows, "x long, y long, doc_id long, row long, start long")
    single = at.keep(each.groupBy("x", "y").agg(first).select("f.*"), "single")
    of = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("start"))))
    both = firsts.withColumn("kind", F.when(F.col("look"), 1).otherwise(0)).drop("look").unionByName(single.withColumn("kind", F.lit(2)))
    both = at.keep(both.groupBy("doc_id", "row").agg(*[of(F.col("kind") == k).alias(n) for k, n in enumerate(("whole", "looked", "single"))]), "found")
    at.drop("sketch", "firsts", "looked", "single")
    none = lambda c: F.coalesce(c, F.array().cast("array<long>")).alias(c)
    out = docs.join(both, ["doc_id", "row"], "left").select("doc_id", "text", *map(none, ("whole", "looked", "single")))
    return out.mapInArrow(cleaned, "doc_id long, n_words long, n_removed long, spans array<struct<start: long, end: long>>, kept string")


SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])


def _result(ids: pa.Array, t: Texts, data: np.ndarray, gone: np.ndarray) -> pa.RecordBatch:
    """Of texts with their removed words, as remove_repeats."""
    n = len(ids)
    edge = np.zeros(len(gone) + 1, bool)
    edge[t.first] = True
    prior, after = np.concatenate([[False], gone])[: len(gone)], np.concatenate([gone, [False]])[1:]
    start, end = np.flatnonzero(gone & (~prior | edge[:-1])), np.flatnonzero(gone & (~after | edge[1:])) + 1
    of = np.searchsorted(t.first, start, "right") - 1
    spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(n + 1)).astype(np.int32)), pa.StructArray.from_arrays([_longs(start - t.first[of]), _longs(end - t.first[of])], fields=list(SPAN)))
    before = np.concatenate([[0], np.cumsum(gone)])[t.first]
    kept = np.flatnonzero(~gone)
    size = t.end[kept] - t.start[kept] + 1  # each word with a space after it
    text = np.searchsorted(t.first, kept, "right") - 1
    last = np.ones(len(kept), bool)
    last[:-1] = text[1:] != text[:-1]
    size[last] -= 1
    parts = []
    for a in range(0, len(kept), WORDS):
        w, s, z = kept[a : a + WORDS], size[a : a + WORDS], last[a : a + WORDS]
        at = np.repeat(t.start[w] - (np.cumsum(s) - s), s) + np.arange(s.sum())
        part = data[np.minimum(at, len(data) - 1)].copy()
        part[(np.cumsum(s) - 1)[~z]] = 32
        parts.append(part)
    ends = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(text, np.arange(n + 1))]
    joined = np.ascontiguousarray(np.concatenate([np.zeros(0, np.uint8), *parts]))
    words = pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(joined)]).cast(pa.string())
    return pa.RecordBatch.from_arrays([ids, _longs(np.diff(t.first)), _longs(np.diff(before)), spans, words], names=["doc_id", "n_words", "n_removed", "spans", "kept"])
