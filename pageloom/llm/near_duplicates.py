"""N-gram Jaccard join: all links between texts alike by word shingles, as components.

Words are runs of other characters than ASCII white space, A-Z lower-cased; a text's set is that of its
5-word shingles (64-bit hashes), or of its whole word sequence if that is shorter.  Two
texts link when the sets' Jaccard similarity is 0.75 or more.

1. Texts with equal sets form one class, led by the smallest doc_id.
2. In each task one text stands for its class.  Sets are ordered: shingles that many documents hold come last, others by hash.  Two
   similar sets share a shingle among the first n - ceil(0.75 n) + 1 of each (the prefix);
   these are shuffled by shingle, and shingles of one class fall away.
3. In runs of more than ``hot`` classes every class is first held against the run's smallest doc_id only;
   pairs that can still reach the similarity are verified exactly and joined into components, so that a huge group isn't searched pair by pair.
4. Every run that holds several components (at first each class is one) is searched by a signature tree: its leaves
   are classes in order of set size, nodes hold the OR of their classes' token bitmaps, ranges of set sizes and of
   shared-token counts.  A dual traversal goes down pairs of nodes that may hold a pair of different components whose
   greatest possible overlap suffices.  Runs above ``most`` classes are dealt in blocks, each pair of
   blocks a task of its own, so no run gathers in one task and no pair is lost.
5. Pairs are counted over all runs; the count and the sizes bound the overlap again; what
   is left is verified exactly.  All links give the components.

Links within a component already known are not looked for; so components are whole,
and copies are never expanded into pairs.

Null texts, and texts without words, have no shingle and no link.  Repeated rows give repeated results.  A null doc_id is kept;
it names no class, but its row gets the component of its class.  Different texts under one doc_id
are classes by themselves, named by that doc_id.  An empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm import bytehash as bh
from pageloom.llm.components import components
from pageloom.llm.store import Workspace

WORDS = 5
LONG = 4 << 20


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts and the first word of each (a long text is cut between words)."""
    if len(data) <= LONG or len(bounds) > 2:
        start, end, first, low = bh.words(data, bounds)
        return bh.spans(bh.prefix_sums(low), start, end), first
    parts, at = [], 0
    while at < len(data):
        end = min(len(data), at + LONG)
        while end < len(data):  # to the next white space
            blank = np.flatnonzero(bh.SPACE[data[end : end + LONG]])
            if len(blank):
                end += int(blank[0])
                break
            end = min(len(data), end + LONG)
        s, e, _, low = bh.words(data[at:end], np.array([0, end - at]))
        parts.append(bh.spans(bh.prefix_sums(low), s, e))
        at = end
    out = np.concatenate(parts)
    return out, np.array([0, len(out)])


def sets(column: pa.Array, size: int = WORDS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For texts i..j of a column: (i, j, their distinct shingles by text and value, first shingle of each text)."""
    data, offsets = bh.text_buffers(column)
    for i, j in bh.pieces(offsets):
        w, first = word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        h, of = bh.shingles(w, first, size)
        order = np.lexsort((h, of))
        h, of = h[order], of[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
        h, of = h[new], of[new]
        yield i, j, h, np.searchsorted(of, np.arange(j - i + 1))


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def prefix_size(n):
    return n - (3 * n + 3) // 4 + 1


#: Of a table of pairs: what two sizes need, and what the prefixes leave open.
def _needed(n: str, m: str) -> Column:
    return F.ceil((3 * (F.col(n) + F.col(m))) / 7.0)


def _rest(n: str, m: str) -> Column:
    big = F.greatest(n, m)
    return F.floor((3 * big + 3) / 4.0) - 1


def _sizes_fit(n: str, m: str) -> Column:
    return 4 * F.least(n, m) >= 3 * F.greatest(n, m)


def _digests(h: np.ndarray, first: np.ndarray) -> list[bytes]:
    """A 128-bit name of each text's set."""
    return [blake2b(h[i:j].tobytes(), digest_size=16).digest() for i, j in zip(first[:-1], first[1:], strict=True)]


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind 0: doc_id, n, set digest of each text.  kind 1: shingles that often occur in this task, and how often."""
    names = ["kind", "id", "n", "s1", "s2"]
    seen: list[np.ndarray] = []
    held = 0

    def often(least: int) -> tuple[np.ndarray, np.ndarray]:
        h, c = np.unique(np.concatenate(seen), return_counts=True) if seen else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        return h[c >= least], c[c >= least]

    def frequent() -> pa.RecordBatch:
        h, c = often(4)
        zero = pa.array(np.zeros(len(h), np.int64))
        return pa.RecordBatch.from_arrays([pa.array(np.ones(len(h), np.int32)), _longs(h), _longs(c), zero, zero], names=names)

    for b in bh.tidy(batches):
        for i, j, h, first in sets(b.column(1)):
            digest = np.frombuffer(b"".join(_digests(h, first)), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(j - i, np.int32)), b.column(0).slice(i, j - i), _longs(np.diff(first)), pa.array(digest[:, 0]), pa.array(digest[:, 1])], names=names)
            seen.append(h)
            held += len(h)
            if held > 2_000_000:  # bounded memory: what is frequent shows again and again
                yield frequent()
                seen, held = [], 0
    yield frequent()


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, id, n) sorted by h and id: each (h, id) once, where h has several, with the first id of h (c) and its n (cn)."""
    names = ["h", "id", "n", "c", "cn"]
    last = None  # h, id, c, cn of the row before those at hand
    held = None  # a row that may stand alone
    for b in bh.tidy(batches):
        h, i, n = (b.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        if held is not None:
            h, i, n = (np.concatenate([a, x]) for a, x in zip(held, (h, i, n), strict=True))
        before_h = np.concatenate([[last[0] if last else 0], h[:-1]])
        before_i = np.concatenate([[last[1] if last else 0], i[:-1]])
        same = h == before_h
        if last is None and len(h):
            same[0] = False
        new = ~(same & (i == before_i))
        h, i, n, same = h[new], i[new], n[new], same[new]
        if not len(h):
            continue
        at = np.maximum.accumulate(np.where(same, -1, np.arange(len(h))))
        c, cn = np.where(at >= 0, i[at], last[2] if last else 0), np.where(at >= 0, n[at], last[3] if last else 0)
        follows = np.concatenate([same[1:], [False]])
        alone = ~same & ~follows
        held = None
        if not same[-1]:
            held = (h[-1:], i[-1:], n[-1:])
            if len(h) > 1:
                last = (h[-2], i[-2], c[-2], cn[-2])
        else:
            last = (h[-1], i[-1], c[-1], cn[-1])
        out = ~alone
        yield pa.RecordBatch.from_arrays([_longs(x[out]) for x in (h, i, n, c, cn)], names=names)


def _whole_runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """Columns of batches, cut so that rows equal in the first ``keys`` columns stay together."""
    held: list[np.ndarray] | None = None
    for b in bh.tidy(batches):
        x = [b.column(k).to_numpy(zero_copy_only=False) for k in range(b.num_columns)]
        if held is not None:
            x = [np.concatenate([a, y]) for a, y in zip(held, x, strict=True)]
        if not len(x[0]):
            continue
        changed = np.zeros(len(x[0]), bool)
        for k in range(keys):
            changed[1:] |= x[k][1:] != x[k][:-1]
        starts = np.flatnonzero(changed)
        if not len(starts):
            held = x
            continue
        held = [y[starts[-1] :] for y in x]
        yield [y[: starts[-1]] for y in x]
    if held is not None and len(held[0]):
        yield held


class Group:
    """Classes of one run: set sizes n, counts of shared tokens q, roots, blocks and bitmaps, in order of n."""

    LEAF, FAN = 32, 8

    def __init__(self, n, q, root, block, bits, between: bool):
        self.n, self.q, self.root, self.block, self.bits, self.between = n, q, root, block, bits, between

    def fits(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the classes may link, by size and by the greatest overlap that bitmaps allow."""
        n, m = self.n[i], self.n[j]
        ok = (self.root[i] != self.root[j]) & (4 * np.minimum(n, m) >= 3 * np.maximum(n, m))
        if self.between:
            ok &= self.block[i] != self.block[j]
        i, j = i[ok], j[ok]
        only_i = np.bitwise_count(self.bits[i] & ~self.bits[j]).sum(axis=1, dtype=np.int64)
        only_j = np.bitwise_count(self.bits[j] & ~self.bits[i]).sum(axis=1, dtype=np.int64)
        shared = np.minimum(self.q[i] - only_i, self.q[j] - only_j)
        ok[ok] = shared >= _least_shared(self.n[i], self.n[j])
        return ok

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (i, j) that fit, by dual traversal of the tree with itself."""
        levels = [self._leaves()]
        while len(levels[-1][0]) > 1:
            levels.append(self._above(levels[-1]))
        a = b = np.zeros(1, np.int64)
        for level in levels[-2::-1]:
            size = len(level[0])
            k = np.arange(self.FAN)
            a, b = (x.ravel() for x in np.broadcast_arrays((a[:, None] * self.FAN + k)[:, :, None], (b[:, None] * self.FAN + k)[:, None, :]))
            ok = (a < size) & (b < size) & (a <= b)
            a, b = a[ok], b[ok]
            ok = self._may(level, a, b)
            a, b = a[ok], b[ok]
        out_i, out_j, k = [], [], np.arange(self.LEAF)
        for s in range(0, len(a), 4096):
            i, j = np.broadcast_arrays((a[s : s + 4096, None] * self.LEAF + k)[:, :, None], (b[s : s + 4096, None] * self.LEAF + k)[:, None, :])
            ok = (i < j) & (j < len(self.n))
            i, j = i[ok], j[ok]
            ok = self.fits(i, j)
            out_i.append(i[ok])
            out_j.append(j[ok])
        return (np.concatenate(out_i), np.concatenate(out_j)) if out_i else (np.zeros(0, np.int64),) * 2

    @staticmethod
    def _reduce(starts, bits, low, high, q, many, roots):
        r = lambda f, x: f.reduceat(x, starts, axis=0)
        return r(np.bitwise_or, bits), r(np.minimum, low), r(np.maximum, high), r(np.maximum, q), r(np.maximum, many), r(np.minimum, roots[0]), r(np.maximum, roots[1])

    def _leaves(self):
        # A class may have several tokens on one bit: no more than its tokens beyond one for each bit set.
        many = self.q - np.bitwise_count(self.bits).sum(axis=1, dtype=np.int64) + 1
        return self._reduce(np.arange(0, len(self.n), self.LEAF), self.bits, self.n, self.n, self.q, many, (self.root, self.root))

    def _above(self, level):
        bits, low, high, q, many, r0, r1 = level
        return self._reduce(np.arange(0, len(low), self.FAN), bits, low, high, q, many, (r0, r1))

    @staticmethod
    def _may(level, a, b) -> np.ndarray:
        """Whether two nodes may hold a pair that fits: sizes in reach, different roots, enough common bits."""
        bits, low, high, q, many, r0, r1 = level
        ok = (4 * high[a] >= 3 * low[b]) & (4 * high[b] >= 3 * low[a]) & ~((r0[a] == r1[a]) & (r0[b] == r1[b]) & (r0[a] == r0[b]))
        common = np.bitwise_count(bits[a] & bits[b]).sum(axis=1, dtype=np.int64)
        shared = np.minimum(np.minimum(q[a], q[b]), common + np.minimum(many[a], many[b]) - 1)
        # The least that any two sizes from these ranges need.
        need = (3 * (low[a] + low[b]) + 6) // 7 - ((3 * np.maximum(high[a], high[b]) + 3) // 4 - 1)
        return ok & (shared >= np.maximum(need, 1))


def _least_shared(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Common tokens that the prefixes of linked sets of these sizes must have."""
    return np.maximum(1, (3 * (n + m) + 6) // 7 - ((3 * np.maximum(n, m) + 3) // 4 - 1))


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, ka, kb, id, n, q, root, block, b0..b3), runs by (h, ka, kb) in order of n: pairs that may link."""
    for x in _whole_runs(batches, 3):
        h, ka, kb, i, n, q, root, block = x[:8]
        bits = np.stack([y.astype(np.int64).view(np.uint64) for y in x[8:]], axis=1)
        first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (ka[1:] != ka[:-1]) | (kb[1:] != kb[:-1])]))
        size = np.diff(np.concatenate([first, [len(h)]]))
        found = []
        # Runs of one leaf, all at once: rows d apart.
        run = np.repeat(np.arange(len(first)), size)
        leaf = size[run] <= Group.LEAF
        every = Group(n, q, root, np.where(ka == kb, np.arange(len(h)), block), bits, True)
        for d in range(1, int(size[size <= Group.LEAF].max(initial=1))):
            a = np.flatnonzero(leaf[:-d] & (run[:-d] == run[d:]))
            a = a[every.fits(a, a + d)]
            found.append((a, a + d))
        for s, k in zip(first[size > Group.LEAF], size[size > Group.LEAF], strict=True):
            g = slice(s, s + k)
            a, b = Group(n[g], q[g], root[g], block[g], bits[g], bool(ka[s] != kb[s])).pairs()
            found.append((a + s, b + s))
        if found:
            a, b = (np.concatenate(y) for y in zip(*found, strict=True))
            low, high = i[a] < i[b], i[a] > i[b]
            a, b = np.concatenate([a[low], b[high]]), np.concatenate([b[low], a[high]])
            yield pa.RecordBatch.from_arrays([_longs(i[a]), _longs(i[b]), _longs(n[a]), _longs(n[b])], names=["a", "b", "n", "m"])


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, few: int = 1_000_000) -> DataFrame:
    """Of pairs (a, b, n, m), those whose sets' similarity is 0.75 or more, exactly."""
    ids = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).distinct().join(classes.select("rep", "s1", "s2"), "rep")
    if ids.count() <= few:
        ids = F.broadcast(ids)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bh.tidy(batches):
            for i, j, h, first in sets(b.column(1)):
                digest = np.frombuffer(b"".join(_digests(h, first)), np.int64).reshape(-1, 2)
                mine = (digest[:, 0] == b.column(2).to_numpy()[i:j]) & (digest[:, 1] == b.column(3).to_numpy()[i:j])
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), _longs(h))
                out = pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), lists], names=["rep", "tokens"])
                yield out.filter(pa.array(mine))

    t = docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("rep")).select("rep", "text", "s1", "s2")
    t = t.mapInArrow(read, "rep long, tokens array<bigint>").dropDuplicates(["rep"])
    # The smaller id is the one that many pairs may share: its set comes last, so that no shuffle carries it pair by pair.
    p = pairs.join(t.select(F.col("rep").alias("b"), F.col("tokens").alias("y")), "b").join(t.select(F.col("rep").alias("a"), F.col("tokens").alias("x")), "a")
    return p.withColumn("both", F.size(F.array_intersect("x", "y"))).filter(175 * F.col("both") >= 75 * (F.col("n") + F.col("m"))).select("a", "b")


def _runs_of_classes(docs: DataFrame, at: Workspace) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Classes of equal sets, each row's class, and runs of classes that share a prefix shingle."""
    spark = docs.sparkSession
    t = at.keep(docs.mapInArrow(_summary, "kind int, id long, n long, s1 long, s2 long"), "summary")
    texts = t.filter("kind = 0").select(F.col("id").alias("doc_id"), "n", "s1", "s2")
    classes = at.keep(texts.filter("n > 0").groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep")), "classes")
    member = at.keep(texts.join(classes, ["s1", "s2", "n"], "left"), "member")

    # Shingles that many documents hold: at most 1/4096 of all shingles can be as frequent, and at most the million most frequent are told apart.
    n = texts.count()
    heavy = t.filter("kind = 1").groupBy("id").agg(F.sum("n").alias("n")).filter(F.col("n") >= max(256, n // 4096)).orderBy(F.desc("n"), "id").limit(1_000_000)
    last = spark.sparkContext.broadcast(np.sort(np.array([r["id"] for r in heavy.collect()], np.int64).view(np.uint64)))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late, sent = last.value, set()
        for b in bh.tidy(batches):
            for i, _, h, first in sets(b.column(1)):
                size = np.diff(first)
                # Of equal sets in a task one stands for all; which class it is in is known from its id.
                size = np.where([x in sent or sent.add(x) is not None for x in _digests(h, first)], -1, size)
                of = np.repeat(np.arange(len(size)), np.diff(first))
                where = np.searchsorted(late, h)
                hot = late[np.minimum(where, len(late) - 1)] == h if len(late) else np.zeros(len(h), bool)
                order = np.lexsort((h, hot, of))
                rank = np.arange(len(h)) - first[of]
                kept = order[rank < np.where(size < 0, 0, prefix_size(size))[of]]
                yield pa.RecordBatch.from_arrays([_longs(h[kept]), b.column(0).take(pa.array(of[kept] + i)), pa.array(np.zeros(len(kept), np.int64))], names=["h", "id", "n"])

    run = "h long, id long, n long, c long, cn long"
    p = docs.filter("doc_id is not null").mapInArrow(prefixes, "h long, id long, n long")
    p = p.repartition("h").sortWithinPartitions("h", "id").mapInArrow(_runs, run)
    p = at.keep(p.select("h", "id"), "shared")
    p = p.join(member.filter("doc_id is not null").select(F.col("doc_id").alias("id"), "rep", "n").distinct(), "id").select("h", F.col("rep").alias("id"), "n")
    return classes, member, at.keep(p.repartition("h").sortWithinPartitions("h", "id").mapInArrow(_runs, run), "runs")


def _found(p: DataFrame, most: int) -> DataFrame:
    """Pairs of classes with different roots that may be linked (a, b, n, m), of runs (h, id, n, root)."""
    mixed = p.groupBy("h").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("k")).filter("r0 <> r1").select("h", F.ceil(F.col("k") / most).cast("int").alias("blocks"))
    word = F.shiftright(F.col("h"), 6).bitwiseAND(F.lit(3))
    bit = F.expr("shiftleft(1L, cast(h & 63 as int))")
    signature = p.groupBy("id").agg(F.count("*").alias("q"), *[F.coalesce(F.bit_or(F.when(word == k, bit)), F.lit(0)).alias(f"b{k}") for k in range(4)])
    g = p.join(mixed, "h").join(signature, "id")
    g = g.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    g = g.select("h", F.least("block", "other").alias("ka"), F.greatest("block", "other").alias("kb"), "id", "n", "q", "root", "block", "b0", "b1", "b2", "b3")
    g = g.repartition("h", "ka", "kb").sortWithinPartitions("h", "ka", "kb", "n", "id")
    found = g.mapInArrow(_search, "a long, b long, n long, m long").groupBy("a", "b", "n", "m").agg(F.count("*").alias("k"))
    return found.filter(F.col("k") + _rest("n", "m") >= _needed("n", "m")).drop("k")


def near_duplicates(documents: DataFrame, most: int = 4096, hot: int = 256) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of documents."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    at = Workspace(documents.sparkSession, "near-duplicates")
    classes, member, p = _runs_of_classes(docs, at)

    # In large runs, each class against the smallest of its run.  (Counts are of these runs only, so some links wait for the trees.)
    large = p.groupBy("h").count().filter(F.col("count") > hot).select("h")
    star = p.join(large, "h", "left_semi").filter((F.col("id") != F.col("c")) & _sizes_fit("n", "cn")).groupBy(F.col("c").alias("a"), F.col("id").alias("b"), F.col("cn").alias("n"), F.col("n").alias("m")).agg(F.count("*").alias("k"))
    star = at.keep(star.filter(F.col("k") + _rest("n", "m") >= _needed("n", "m")).drop("k"), "stars")
    links = at.keep(verified(star, docs, classes), "links")
    roots = components(links, at, "roots")

    # What different components share, searched by trees.
    p = p.select("h", "id", "n").join(roots, "id", "left").select("h", "id", "n", F.coalesce("root", "id").alias("root"))
    found = at.keep(_found(p, most), "found")
    more = at.keep(verified(found, docs, classes), "more")
    final = components(links.unionByName(more), at, "final")
    at.drop("summary", "classes", "shared", "runs", "stars", "links", "found", "more")

    out = member.join(final, member["rep"] == final["id"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("root", "rep", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def links(documents: DataFrame, most: int = 4096) -> DataFrame:
    """doc_id, n_links (other rows whose text is linked to this one's) for each row of documents: every pair is searched by the trees and verified, no component stands for its pairs.

    A row without shingles or with a null doc_id has none.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    at = Workspace(documents.sparkSession, "links")
    classes, member, p = _runs_of_classes(docs, at)
    # As each class is its own root, no pair is left out.
    found = at.keep(_found(p.select("h", "id", "n", F.col("id").alias("root")), most), "found")
    pairs = at.keep(verified(found, docs, classes), "pairs")
    rows = member.filter("doc_id is not null and n > 0").groupBy(F.col("rep").alias("id")).agg(F.count("*").alias("rows"))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = both.join(rows, both["b"] == rows["id"]).groupBy("a").agg(F.sum("rows").alias("others"))
    n = rows.join(others, rows["id"] == others["a"], "left").select("id", (F.col("rows") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    out = member.join(n, member["rep"] == n["id"], "left")
    return out.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("n_links")).otherwise(F.lit(None)).alias("n_links")).na.fill(0, ["n_links"])
