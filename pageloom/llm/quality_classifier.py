"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network.

Every trigram of a word's UTF-8 bytes (with ends marked) has a fixed sparse random index
vector, drawn from its hash; a word's vector is the sum over its trigrams plus, for words of
the training sample, the index vectors of their neighbours there (random indexing).  A
text's features are the mean and the deviation of its words' vectors, how
often two of its words are the same and how alike different ones are, and its length (six figures beside the vectors).  A network with one hidden layer, trained in
numpy by Adam with a validation part, gives a logit; dividing it by a temperature fitted on
that part calibrates the probability.

Labels are learned from at most about ``sample`` labelled rows, drawn by a hash of doc_id;
the model holds a vector for every word that stands in them three times or more.  Sums over the sample are of integers, so the model doesn't depend on the
layout of the rows.  Every text is then scored whole, however long.  A score of just ``threshold`` counts as good.

A null or empty text has features too (zeros) and a score; null labels are not learned
from; several labels of one doc_id each count; without labels, or with one class only, the
score is the share of that class (0.5 without any).  Rows are judged one by one (repeated rows give
repeated results); an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm import bytehash as bh

WORD = re.compile(r"[^\x01\x20\x09-\x0D]+")
SIZE, ONES = 32, 4
NONE = np.zeros((0, SIZE), np.float32)


def index_vectors(keys: np.ndarray, size: int = SIZE) -> np.ndarray:
    """For each 64-bit key a few +1 and -1 at places drawn from it."""
    out, h = np.zeros((len(keys), size), np.float32), keys.astype(np.uint64)
    rows = np.arange(len(keys))
    for _ in range(ONES):
        h = h * np.uint64(0x5851F42D4C957F2D) + np.uint64(0x14057B7EF767814F)
        out[rows, (h >> np.uint64(33)) % np.uint64(size)] += np.where(h >> np.uint64(63), 1, -1)
    return out


#: Index vectors of trigrams (of UTF-8 bytes, by hash) and of neighbouring words (by hash).
TRIGRAMS = index_vectors(np.arange(1 << 15) + 1)
NEIGHBOURS = index_vectors(np.arange(1 << 15) + (1 << 20))


def spelled(words: list[str]) -> np.ndarray:
    """Unit vectors of words, sums over their trigrams with the ends marked."""
    data = np.frombuffer(("\x01" + "\x01".join(words) + "\x01").encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    code = ((data[:-2] << 16 | data[1:-1] << 8 | data[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(17)
    ends = np.flatnonzero(data == 1)
    inside = np.ones(len(code), bool)
    inside[ends[1:-1] - 1] = False  # a trigram over the end of a word
    first = ends[:-1] - np.arange(len(words))
    v = np.add.reduceat(TRIGRAMS[code[inside]], first, axis=0)
    return v / np.maximum(np.sqrt(np.einsum("ij,ij->i", v, v)), 1e-6)[:, None]


class Vectors:
    """Word vectors: how a word is spelled, and its neighbours in the training sample if it was there."""

    def __init__(self, words: list[str], context: np.ndarray):
        self.rows = {w: i for i, w in enumerate(words, 1)}
        self.context = np.concatenate([np.zeros((1, SIZE), np.float32), context])

    def of(self, words: list[str]) -> np.ndarray:
        get = self.rows.get
        spelt = np.concatenate([spelled(words[i : i + 20_000]) for i in range(0, len(words), 20_000)])
        return spelt + self.context[[get(w, 0) for w in words]]


EXTRA = 6


def features(text: str | None, vectors: Vectors) -> np.ndarray:
    counted = Counter(WORD.findall(text)) if text else None
    if not counted:
        return np.zeros(2 * SIZE + EXTRA, np.float32)
    k = np.fromiter(counted.values(), np.float64, len(counted))
    n = float(k.sum())
    m = vectors.of(list(counted))
    squares = m * m
    mean = k @ m / n
    deviation = np.sqrt(np.maximum(k @ squares / n - mean * mean, 0))
    # How often two words drawn from the text are the same; how alike they are if they are not.
    same = float(k @ (k - 1)) / max(1.0, n * (n - 1))
    unlike = n * n - float(k @ k)
    alike = (n * n * float(mean @ mean) - float((k * k) @ squares.sum(axis=1))) / max(1.0, unlike)
    shortness = 1 / np.sqrt(n)
    more = [np.log1p(n) / 5, shortness, len(counted) / n, np.sqrt(same), alike, float(k.max()) / n - shortness]
    return np.concatenate([mean * np.sqrt(min(n, 30.0)), deviation, more]).astype(np.float32)


@dataclass
class Network:
    """Standardised features, a hidden tanh layer, a logit, a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, hidden: int = 24, rounds: int = 40, seed: int = 7) -> Network:
    """y: 0 or 1, both there.  A fifth of the rows validates: the best round is kept, then the temperature fitted."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    cut = max(1, len(x) // 5)
    held, rest = order[:cut], order[cut:]
    scale = x[rest].std(axis=0)
    net = Network(x[rest].mean(axis=0), np.where(scale > 1e-6, scale, 1.0), rng.normal(0, 0.1, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 0.1, hidden), 0.0)
    z = (x - net.mean) / net.scale
    params = [net.w1, net.b1, net.w2, np.zeros(1)]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0

    def loss(i: np.ndarray) -> float:
        a = np.tanh(z[i] @ params[0] + params[1]) @ params[2] + params[3]
        return float(np.mean(np.logaddexp(0, a) - y[i] * a))

    best, kept = np.inf, None
    for _ in range(rounds):
        rng.shuffle(rest)
        for i in np.array_split(rest, max(1, len(rest) // 64)):
            h = np.tanh(z[i] @ params[0] + params[1])
            d = (1 / (1 + np.exp(-(h @ params[2] + params[3]))) - y[i]) / len(i)
            back = np.outer(d, params[2]) * (1 - h * h)
            grads = [z[i].T @ back + 1e-4 * params[0], back.sum(axis=0), h.T @ d + 1e-4 * params[2], np.array([d.sum()])]
            step += 1
            for p, g, a, b in zip(params, grads, first, second, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= 0.003 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
        if (now := loss(held)) < best:
            best, kept = now, [p.copy() for p in params]
    net.w1, net.b1, net.w2, net.b2 = kept[0], kept[1], kept[2], float(kept[3][0])
    a = net.logit(x[held])
    grid = np.geomspace(0.25, 8, 60)
    net.temperature = float(grid[np.argmin([np.mean(np.logaddexp(0, a / t) - y[held] * a / t) for t in grid])])
    return net


@dataclass
class Model:
    words: list[str]
    context: np.ndarray
    network: Network | None
    share: float

    def vectors(self) -> Vectors:
        return Vectors(self.words, self.context)

    def score(self, texts: list[str | None], vectors: Vectors) -> np.ndarray:
        if self.network is None or not texts:
            return np.full(len(texts), self.share)
        return self.network.probability(np.array([features(t, vectors) for t in texts]))


def draw(labels: DataFrame, sample: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, quality) of about ``sample`` rows, evenly from the classes; the classes' sizes."""
    d = labels.filter(F.col("quality").isin(0, 1)).select("doc_id", "quality")
    sizes = {r["quality"]: r["count"] for r in d.groupBy("quality").count().collect()}
    drawn = F.pmod(F.xxhash64(F.lit("quality"), "doc_id"), F.lit(1 << 30))
    keep = F.lit(False)
    for c, n in sizes.items():
        keep = F.when(F.col("quality") == c, drawn < int(min(1.0, sample / 2 / n) * (1 << 30))).otherwise(keep)
    return d.filter(keep), sizes


def fit(docs: DataFrame, labels: DataFrame, sample: int = 6_000, least: int = 3, reach: int = 2) -> Model:
    """A model of labels (doc_id, quality: 0 or 1) of docs (doc_id, text).

    least: how often a word must stand in the sample to have a vector of its neighbours; one seen less has hardly met any.
    """
    drawn, sizes = draw(labels, sample)
    if len(sizes) < 2:
        return Model([], NONE, None, float(next(iter(sizes), 0.5)))
    d = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")  # about sample rows

    def neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        times: Counter = Counter()
        around_vectors = NEIGHBOURS.astype(np.int64)
        for b in bh.tidy(batches):
            for t in b["text"]:
                w = WORD.findall(t) if isinstance(t, str) else []
                if not w:
                    continue
                index = around_vectors[[zlib.crc32(x.encode("utf-8", "surrogatepass")) & 0x7FFF for x in w]]
                sums = np.concatenate([np.zeros((1, SIZE), np.int64), np.cumsum(index, axis=0)])
                i = np.arange(len(w))
                around = sums[np.minimum(i + reach + 1, len(w))] - sums[np.maximum(i - reach, 0)] - index
                for x, v in zip(w, around, strict=True):
                    if x in total:
                        total[x] += v
                    else:
                        total[x] = v.copy()
                times.update(w)
        seen = list(times)
        yield pd.DataFrame({"word": pd.Series(seen, dtype=object), "n": pd.Series([times[x] for x in seen], dtype="int64"), "v": pd.Series([total[x].tolist() for x in seen], dtype=object)})

    summed = d.select("text").mapInPandas(neighbours, "word string, n long, v array<bigint>")
    summed = summed.groupBy("word").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("v")[i]) for i in range(SIZE)]).alias("v"))
    found = summed.filter(F.col("n") >= least).select("word", "v").toArrow()  # of words of at most about sample rows
    order = np.argsort(np.array(found.column("word").to_pylist(), object), kind="stable") if found.num_rows else np.zeros(0, np.int64)
    words = [found.column("word")[int(i)].as_py() for i in order]
    sums = found.column("v").combine_chunks().flatten().to_numpy().reshape(-1, SIZE)[order].astype(np.float32) if words else NONE
    context = sums / np.maximum(1e-6, np.linalg.norm(sums, axis=1, keepdims=True)).astype(np.float32) * np.float32(0.5)
    shared = docs.sparkSession.sparkContext.broadcast((words, context))

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vectors = Vectors(*shared.value)
        for b in bh.tidy(batches):
            x = [features(t if isinstance(t, str) else None, vectors) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "quality": b["quality"], "x": pd.Series([r.tobytes() for r in x], dtype=object)})

    kind = d.schema["doc_id"].dataType.simpleString()
    rows = d.mapInPandas(featured, f"doc_id {kind}, quality int, x binary").collect()  # at most about sample rows
    rows.sort(key=lambda r: (str(r["doc_id"]), bytes(r["x"])))
    x = np.array([np.frombuffer(r["x"], np.float32) for r in rows], np.float64)
    y = np.array([r["quality"] for r in rows], np.float64)
    if len(set(y)) < 2:
        return Model(words, context, None, float(y.mean()) if len(y) else 0.5)
    network = train(x, y)
    # The classes were drawn evenly: their true odds move the logit.
    odds = np.log(sizes[1] / sizes[0]) - np.log(max(1.0, (y == 1).sum()) / max(1.0, (y == 0).sum()))
    network.b2 += float(odds) * network.temperature
    return Model(words, context, network, 0.5)


def scores(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """The kept columns of docs and score, for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # vectors of words of the sample, and the network
    d = docs.select(*keep, F.col("text").alias("__text")) if keep else docs.select(F.col("text").alias("__text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        vectors = m.vectors()
        for b in bh.tidy(batches):
            said = m.score([t if isinstance(t, str) else None for t in b["__text"]], vectors)
            yield b.drop(columns="__text").assign(score=said)

    kinds = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "score double"])
    return d.mapInPandas(run, kinds)


def held_out_by_id() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


def learn(docs: DataFrame, labels: DataFrame, sample: int = 6_000) -> Model:
    """A model of the labelled rows that aren't held out."""
    known = labels.select("doc_id", "quality").filter(~F.coalesce(held_out_by_id(), F.lit(True)))
    return fit(docs, known, sample)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""
    d = docs.select("doc_id", "text", F.coalesce(held_out_by_id(), F.lit(False)).alias("held_out"))
    out = scores(d, learn(docs, labels), "doc_id", "held_out")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of docs, with all their columns, that score at least threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        vectors = m.vectors()
        for b in bh.tidy(batches):
            yield b.filter(pa.array(m.score(b.column(at).to_pylist(), vectors) >= threshold))

    return docs.mapInArrow(run, docs.schema)
