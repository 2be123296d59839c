"""Ranked lexical search over a tiered index with residual bounds.

A document's score for an item is the sum, over the item's terms, of weight(term) * impact(term, document), all integers.  The
index has a row a document and a column a tier: a term's highest impacts, up to 1,024 of them, are in tier 0, the next up to
16 times as many in tier 1, and so on (whole steps of impact only, so that a tier is a range of impacts).  Rows are stored by
the first tier they have a posting in, so a search of the first tiers reads only these folders and columns.

A search goes from tier to tier.  The postings read so far give each document a lower bound; what is left of each term is
bounded by the highest impact below its tier, its residual.  The 50th best lower bound is the bar.  Once the residuals of
an item's terms add up to less than its bar, no document that hasn't been met can enter: the item is proven, the documents whose upper
bound reaches the bar are scored in all tiers, and the best are its answer.  Items without that proof, or with more than 20 times as many
such documents as answers, go on to the next tier, at the last of which nothing is left.  The answers are exact.

Searches are made for batches of items with some 250,000 terms together; the index of a batch holds the postings of its terms, of
every document.  Terms are told apart by two independent 64-bit hashes.  Nothing is grouped by term: a posting stays with its
document, and a frequent term's postings are as spread as the documents.

A document without a term (null or empty text) isn't counted or ranked, an item without one has no answers.  Rows that repeat
a doc_id or item_id are documents and items of their own; ties go by ascending doc_id (nulls last), then by row.  Very long texts
are read in parts.  Empty tables give an empty result; further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageloom.llm import bytehash as bh
from pageloom.llm.store import Workspace

#: Bytes that are in no term: all of ASCII but letters and digits.
BETWEEN = np.zeros(256, bool)
BETWEEN[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
#: Answers an item; size of a term's first tier, and how much larger each next one is; impacts of a step; terms of a batch; times the
#: answers that an item's candidates may be, to be scored in all tiers at once.
BEST, FIRST, GROWTH, STEP, BATCH, MANY = 50, 1024, 16, 1 << 14, 250_000, 20
#: Bytes of text handled together; cells of a table of scores (documents x items) made at a time; rows that may be broadcast.
PART, CELLS, FEW = 1 << 22, 1 << 20, 500_000


def _cuts(data: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Parts of a text of up to ``most`` bytes, or more if a term is longer; none is cut inside a term."""
    a = 0
    while a < len(data):
        b = min(len(data), a + most)
        while b < len(data):
            near = np.flatnonzero(BETWEEN[data[a:b]])
            if len(near):
                b = a + int(near[-1]) + 1
                break
            b = min(len(data), b + most)
        yield a, b
        a = b


def terms_of(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, text of each term counted from i, its two names), for texts i..j; a long text comes in several parts."""
    for i, j in bh.pieces(offsets, PART):
        whole = data[int(offsets[i]) : int(offsets[j])]
        for a, b in _cuts(whole, PART) if j == i + 1 else [(0, len(whole))]:
            bounds = offsets[i : j + 1] - offsets[i] if j > i + 1 else np.array([0, b - a])
            start, end, first, low = bh.words(whole[a:b], bounds, BETWEEN)
            x, y = (bh.spans(bh.prefix_sums(low, base), start, end, base) for base in bh.BASES)
            yield i, j, np.repeat(np.arange(j - i), np.diff(first)), x.view(np.int64), y.view(np.int64)


def _listed(values: np.ndarray, of: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    """Lists of values by row; of is sorted."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(n + 1)).astype(np.int32)), pa.array(values, kind))


def item_terms(items: DataFrame) -> DataFrame:
    """item, x, y: the distinct terms of each row of items (item, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bh.tidy(batches):
            data, offsets = bh.text_buffers(b.column(1))
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for i, _, of, x, y in terms_of(data, offsets):
                yield pa.RecordBatch.from_arrays([pa.array(ids[of + i]), pa.array(x), pa.array(y)], names=["item", "x", "y"])

    return items.select("item", "text").mapInArrow(run, "item long, x long, y long").distinct()


class Vocabulary:
    """Terms by two names; a term's number is its place."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        order = np.lexsort((y, x))
        x, y = x[order], y[order]
        new = np.ones(len(x), bool)
        new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        self.x, self.y = x[new], y[new]
        self.again = bool((self.x[1:] == self.x[:-1]).any())  # two terms of one first name: looked up one by one

    def numbers(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The number of each term, or -1."""
        if not len(self.x):
            return np.full(len(x), -1)
        at = np.minimum(np.searchsorted(self.x, x), len(self.x) - 1)
        if self.again:
            for k in np.flatnonzero((self.x[at] == x) & (self.y[at] != y)):
                last = np.searchsorted(self.x, x[k], "right")
                at[k] = next((i for i in range(at[k], last) if self.y[i] == y[k]), at[k])
        return np.where((self.x[at] == x) & (self.y[at] == y), at, -1)


def _postings(documents: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """row, doc_id, n (terms with repeats), terms (numbers of the vocabulary) and tfs of each document that has a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = max(1, len(vocabulary.x))
        for b in bh.tidy(batches):
            data, offsets = bh.text_buffers(b.column(2))
            n, keys, tfs = np.zeros(b.num_rows, np.int64), [], []
            for i, j, of, x, y in terms_of(data, offsets):
                n[i:j] += np.bincount(of, minlength=j - i)
                number = vocabulary.numbers(x, y)
                hit = number >= 0
                key, tf = np.unique((of[hit] + i) * size + number[hit], return_counts=True)
                keys.append(key)
                tfs.append(tf)
            key, where = np.unique(np.concatenate([np.zeros(0, np.int64), *keys]), return_inverse=True)
            tf = np.bincount(where, np.concatenate([np.zeros(0), *tfs]), len(key)).astype(np.int64)
            of, number = key // size, key % size
            kept = np.flatnonzero(n > 0)
            new = np.cumsum(n > 0) - 1
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(kept)), b.column(1).take(pa.array(kept)), pa.array(n[kept]), _listed(number.astype(np.int32), new[of], len(kept), pa.int32()), _listed(tf, new[of], len(kept), pa.int64())], names=["row", "doc_id", "n", "terms", "tfs"])

    d = documents.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return d.mapInArrow(run, "row long, doc_id long, n long, terms array<int>, tfs array<long>")


def impacts(tf: np.ndarray, n: np.ndarray, count: int, total: int) -> np.ndarray:
    """Of a term that stands tf times in a document of n terms; count documents have total terms."""
    m = 100 - 50 + (50 * n * count) // total
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def weight(df: int, count: int) -> int:
    return math.floor(1000 * math.log((2 * count + 2) / (2 * df + 1)))


class Index:
    """The tiered index of the terms of a vocabulary, over all documents."""

    def __init__(self, documents: DataFrame, vocabulary: Vocabulary, at: Workspace, name: str = "index", first: int = FIRST):
        self.at, self.name = at, name
        p = at.keep(_postings(documents, vocabulary), f"{name}-postings")
        self.count, total = p.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        count, n_terms = self.count, len(vocabulary.x)
        # How many postings, and the highest, each term has in each step of impact.
        each = p.select("n", F.explode(F.arrays_zip("terms", "tfs")).alias("t")).select(F.col("t.terms").alias("term"), F.col("t.tfs").alias("tf"), F.expr(f"100 - 50 + ((50 * n * {count}L) div {max(total, 1)}L)").alias("m"))
        each = each.select("term", F.expr("(1000000000L * tf) div (1000 * tf + 20 * m)").alias("impact"))
        h = at.keep(each.groupBy("term", F.floor(F.col("impact") / STEP).cast("int").alias("step")).agg(F.count("*").alias("k"), F.max("impact").alias("top")), f"{name}-steps")
        most = h.groupBy("term").agg(F.sum("k").alias("k")).agg(F.max("k")).first()[0] or 0
        sizes = [first]
        while sizes[-1] < most:
            sizes.append(sizes[-1] * GROWTH)
        self.tiers = len(sizes)
        h = h.withColumn("sum", F.sum("k").over(Window.partitionBy("term").orderBy(F.desc("step"))))
        cut = [F.min(F.when(F.col("sum") <= s, F.col("step"))).alias(f"cut{t}") for t, s in enumerate(sizes)]
        rest = [F.max(F.when(F.col("sum") > s, F.col("top"))).alias(f"rest{t}") for t, s in enumerate(sizes)]
        rows = h.groupBy("term").agg(F.sum("k").alias("df"), *cut, *rest).collect()  # a row a term of the batch
        self.weights = np.zeros(n_terms, np.int64)
        cuts = np.full((self.tiers, n_terms), 1 << 30, np.int64)  # a tier holds the steps from here on
        self.rest = np.zeros((self.tiers, n_terms), np.int64)
        for r in rows:
            self.weights[r["term"]] = weight(r["df"], count)
            for t in range(self.tiers):
                cuts[t, r["term"]] = r[f"cut{t}"] if r[f"cut{t}"] is not None else 1 << 30
                self.rest[t, r["term"]] = r[f"rest{t}"] or 0
        self._store(p, cuts, max(total, 1))
        at.drop(f"{name}-postings", f"{name}-steps")

    def _store(self, p: DataFrame, cuts: np.ndarray, total: int) -> None:
        tiers, count = self.tiers, self.count

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in bh.tidy(batches):
                rows = b.num_rows
                terms, of = flat(b.column(3))
                tfs, _ = flat(b.column(4))
                impact = impacts(tfs, b.column(2).to_numpy(zero_copy_only=False)[of], count, total)
                tier = (impact // STEP < cuts[:, terms]).sum(0) if len(terms) else terms
                first = np.full(rows, tiers, np.int64)
                np.minimum.at(first, of, tier)
                out = [b.column(0), b.column(1), pa.array(first.astype(np.int32))]
                for t in range(tiers):
                    k = tier == t
                    out += [_listed(terms[k].astype(np.int32), of[k], rows, pa.int32()), _listed(impact[k], of[k], rows, pa.int64())]
                yield pa.RecordBatch.from_arrays(out, names=["row", "doc_id", "first", *[f"{x}{t}" for t in range(tiers) for x in ("terms", "impacts")]])

        self.kind = "row long, doc_id long, first int, " + ", ".join(f"terms{t} array<int>, impacts{t} array<long>" for t in range(tiers))
        self.table = self.at.keep(p.mapInArrow(run, self.kind).filter(F.col("first") < tiers), self.name, by="first")

    def upto(self, tier: int) -> DataFrame:
        """Documents that have a posting in the tiers up to this one, and these postings."""
        return self.table.filter(F.col("first") <= tier).select("row", "doc_id", *[f"{x}{t}" for t in range(tier + 1) for x in ("terms", "impacts")])


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and the row of each."""
    sizes = np.diff(column.offsets.to_numpy(zero_copy_only=False))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(sizes)), sizes)


class Sums:
    """Scores of documents for items: items with their terms, by term."""

    def __init__(self, item: np.ndarray, term: np.ndarray, n_items: int, n_terms: int, weights: np.ndarray, rest: np.ndarray):
        order = np.argsort(term, kind="stable")
        self.item, self.n_items, self.weights, self.rest = item[order], n_items, weights, rest
        self.start = np.searchsorted(term[order], np.arange(n_terms + 1))

    def tables(self, batch: pa.RecordBatch, tiers: int, at: int = 2) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, end, lower bounds, residuals of the terms met) of rows x items; sums are below 2**53, so doubles hold them."""
        each = [(*flat(batch.column(at + 2 * t)), flat(batch.column(at + 2 * t + 1))[0]) for t in range(tiers)]
        term, of, impact = (np.concatenate([e[k] for e in each]) for k in range(3))
        order = np.argsort(of, kind="stable")
        term, of, impact = term[order], of[order], impact[order]
        size = max(1, CELLS // max(1, self.n_items))
        for a in range(0, batch.num_rows, size):
            b = min(batch.num_rows, a + size)
            i, j = np.searchsorted(of, [a, b])
            t = term[i:j]
            times = self.start[t + 1] - self.start[t]
            row = np.repeat(of[i:j] - a, times)
            inside = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            cell = row * self.n_items + self.item[np.repeat(self.start[t], times) + inside]
            cells = (b - a) * self.n_items
            low = np.bincount(cell, np.repeat((self.weights[t] * impact[i:j]).astype(np.float64), times), cells)
            met = np.bincount(cell, np.repeat((self.weights[t] * self.rest[t]).astype(np.float64), times), cells)
            yield a, b, low.reshape(b - a, self.n_items), met.reshape(b - a, self.n_items)


def _bars(index: DataFrame, sums: Sums, tiers: int, best: int) -> dict[int, float]:
    """For each item a score that ``best`` documents reach by their lower bounds, at most about a hundredth below the best-th."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = np.zeros((best, sums.n_items))
        for b in bh.tidy(batches):
            for _, _, low, _ in sums.tables(b, tiers):
                both = np.concatenate([top, low])
                top = np.partition(both, len(both) - best, axis=0)[len(both) - best :]
        place, item = np.nonzero(top)
        score = top[place, item]
        yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int64)), pa.array(np.floor(np.log(score) * 100).astype(np.int64)), pa.array(score)], names=["item", "level", "score"])

    # A task tells its best documents by level of score; levels are counted, so an item's rows don't grow with the tasks.
    levels = index.mapInArrow(run, "item long, level long, score double").groupBy("item", "level").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    w = Window.partitionBy("item").orderBy(F.desc("level"))
    reached = levels.withColumn("n", F.sum("n").over(w)).filter(F.col("n") >= best).groupBy("item").agg(F.max(F.struct("level", "least"))["least"].alias("bar"))
    return {r["item"]: r["bar"] for r in reached.collect()}  # a number an item of the batch


def _met(index: DataFrame, sums: Sums, tiers: int, bar: np.ndarray, left: np.ndarray) -> np.ndarray:
    """For each item how many documents reach its bar by their upper bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(sums.n_items, np.int64)
        for batch in bh.tidy(batches):
            for _, _, low, met in sums.tables(batch, tiers):
                n += ((low > 0) & (low + left - met >= bar)).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n)), pa.array(n[n > 0])], names=["item", "n"])

    out = np.zeros(sums.n_items, np.int64)
    for r in index.mapInArrow(run, "item long, n long").groupBy("item").agg(F.sum("n").alias("n")).collect():  # a number an item of the batch
        out[r["item"]] = r["n"]
    return out


def _candidates(index: DataFrame, sums: Sums, tiers: int, bar: np.ndarray, left: np.ndarray, best: int) -> DataFrame:
    """item, row, doc_id, score: documents whose upper bound reaches their item's bar; score is the lower bound.

    Where nothing is left that is the score, and of documents read together only the best of an item are given.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bh.tidy(batches):
            ids = batch.column(1).fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
            for a, _, low, met in sums.tables(batch, tiers):
                row, item = np.nonzero((low > 0) & (low + left - met >= bar))
                score = low[row, item]
                order = np.lexsort((row, ids[row + a], -score, item))
                row, item, score = row[order], item[order], score[order]
                k = (np.arange(len(item)) - np.searchsorted(item, item) < best) | (left[item] > 0)
                rows = pa.array(row[k] + a)
                yield pa.RecordBatch.from_arrays([pa.array(item[k].astype(np.int64)), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(score[k].astype(np.int64))], names=["item", "row", "doc_id", "score"])

    return index.mapInArrow(run, "item long, row long, doc_id long, score long")


def _exact(index: Index, found: DataFrame, sums: Sums, name: str) -> DataFrame:
    """found with each document's score in all tiers."""
    asked = index.at.keep(found.groupBy("row").agg(F.collect_list("item").alias("items")), name)
    tiers = index.tiers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bh.tidy(batches):
            item, of = flat(batch.column(2 + 2 * tiers))
            for a, b, low, _ in sums.tables(batch, tiers):
                k = (of >= a) & (of < b)
                rows = pa.array(of[k])
                yield pa.RecordBatch.from_arrays([pa.array(item[k]), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(low[of[k] - a, item[k]].astype(np.int64))], names=["item", "row", "doc_id", "score"])

    rows = index.upto(tiers - 1).join(F.broadcast(asked) if asked.count() <= FEW else asked, "row")
    return rows.select("row", "doc_id", *[f"{x}{t}" for t in range(tiers) for x in ("terms", "impacts")], "items").mapInArrow(run, "item long, row long, doc_id long, score long")


def _batch(documents: DataFrame, wanted: list, best: int, at: Workspace, name: str, first: int) -> list[DataFrame]:
    """Answers (item, row, doc_id, score) of a batch of items with their terms (item, x, y): for each item its best and some more."""
    items = np.array([r["item"] for r in wanted], np.int64)
    x, y = (np.array([r[k] for r in wanted], np.int64) for k in ("x", "y"))
    vocabulary = Vocabulary(x, y)
    term = vocabulary.numbers(x, y)
    index = Index(documents, vocabulary, at, name, first)
    ids, item = np.unique(items, return_inverse=True)
    named = lambda d, own: d.join(F.broadcast(d.sparkSession.createDataFrame([(k, int(ids[i])) for k, i in enumerate(own)], "item long, __item long")), "item").select(F.col("__item").alias("item"), "row", "doc_id", "score")
    counts = index.weights[term] > 0  # a term of weight 0, or of no document, adds nothing
    item, term = item[counts], term[counts]
    active, out = np.unique(item), []
    for t in range(index.tiers):
        if not len(active):
            break
        k = np.isin(item, active)
        mine, terms = np.searchsorted(active, item[k]), term[k]
        sums = Sums(mine, terms, len(active), len(vocabulary.x), index.weights, index.rest[t])
        left = np.bincount(mine, (index.weights[terms] * index.rest[t][terms]).astype(np.float64), len(active))
        bars = _bars(index.upto(t), sums, t + 1, best)
        bar = np.array([bars.get(i, 1.0) for i in range(len(active))])
        proven = (left < bar) | (left == 0)
        if (left[proven] > 0).any():
            # Scoring them in all tiers shall cost less than the next tier does.
            few = _met(index.upto(t), sums, t + 1, bar, left) <= MANY * best
            proven &= few | (left == 0)
        if proven.any():
            own = np.flatnonzero(proven)
            k = np.isin(mine, own)
            sums = Sums(np.searchsorted(own, mine[k]), terms[k], len(own), len(vocabulary.x), index.weights, index.rest[t])
            found = _candidates(index.upto(t), sums, t + 1, bar[own], left[own], best)
            if left[own].any():
                found = _exact(index, at.keep(found, f"{name}-candidates-{t}"), sums, f"{name}-asked-{t}")
            out.append(at.keep(named(found, active[own]), f"{name}-found-{t}"))
        active = active[~proven]
    return out


def search(documents: DataFrame, items: DataFrame, best: int = BEST, batch: int = BATCH, first: int = FIRST) -> DataFrame:
    """item_id, rank, doc_id, score of the ``best`` documents for each row of items (item_id, text).

    batch, first: terms of a batch and postings of a term's first tier; they change time, not results.
    """
    spark = documents.sparkSession
    at = Workspace(spark, "search")
    asked = at.keep(items.select(F.monotonically_increasing_id().alias("item"), "item_id", "text"), "items")
    terms = at.keep(item_terms(asked), "item-terms")
    batches = max(1, math.ceil(terms.count() / batch))
    out = spark.createDataFrame([], "item long, row long, doc_id long, score long")
    for b in range(batches):
        wanted = terms.filter(F.pmod(F.xxhash64("item"), F.lit(batches)) == b).collect()  # at most about ``batch`` rows, by the number of batches
        for found in _batch(documents, wanted, best, at, f"index-{b}", first):
            out = out.unionByName(found)
    # The best of a part of the documents first, so that no task sorts all of an item's.
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    part = out.withColumn("r", F.row_number().over(Window.partitionBy("item", F.pmod(F.xxhash64("row"), F.lit(8))).orderBy(*order))).filter(F.col("r") <= best)
    ranked = part.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= best)
    return asked.select("item", "item_id").join(ranked.drop("r"), "item").select("item_id", "rank", "doc_id", "score")
