"""Language identification: words first, character n-grams for the unseen.

Training counts, per language, lower-cased words (runs of letters) and the character
n-grams of their distinct forms.  A known word scores its per-language log frequency.  An
unseen word backs off: the longest n (4, 3, 2, 1) of which it holds a known n-gram scores
the mean of their log frequencies.  A text's score is the posterior of the best language, flattened
for the dependence between words.

The model is fitted on at most about ``sample`` labelled rows, drawn by a hash of doc_id
(all of them while there are fewer), and holds every word and n-gram of theirs: the bound on rows bounds the size of what is
broadcast.  Every text is then scored whole, however long.

A null text, or one without a letter, is ``und`` with score 0; with no labelled rows every
text is.  A null lang is not learned from; rows are judged one by one, so repeated
rows give repeated results; an empty table gives an empty result; a null doc_id is kept
(never held out, never learned from); further columns are not read.  Ties go to the
language that sorts first.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm import bytehash as bh
from pageloom.llm.store import Workspace

LETTERS = re.compile(r"[^\W\d_]+")
LONGEST = 4
SMOOTH = 0.5


def words_of(text: str) -> list[str]:
    """Runs of letters (Unicode's L categories), lower-cased."""
    found = LETTERS.findall(text.lower())
    if text.isascii() or all(w.isalpha() for w in found):
        return found
    # The pattern also takes signs like a half or a Roman numeral.
    return [w for x in found for w in "".join(c if c.isalpha() else " " for c in x).split()]


def grams_of(word: str, n: int) -> list[str]:
    w = f"<{word}>" if n > 1 else word
    return [w[i : i + n] for i in range(len(w) - n + 1)]


@dataclass
class Model:
    languages: list[str]
    words: dict[str, int]
    word_logs: np.ndarray
    grams: dict[str, int]
    gram_logs: np.ndarray

    def vector(self, word: str) -> np.ndarray | None:
        """Log frequencies by language; None if nothing in it is known."""
        if (i := self.words.get(word)) is not None:
            return self.word_logs[i]
        for n in range(LONGEST, 0, -1):
            known = [j for g in grams_of(word, n) if (j := self.grams.get(g)) is not None]
            if known:
                return self.gram_logs[known].mean(axis=0)
        return None

    def predict(self, text: str | None, cache: dict[str, np.ndarray | None]) -> tuple[str, float]:
        counted = Counter(words_of(text)) if text else {}
        if not counted or not self.languages:
            return "und", 0.0
        total, n = np.zeros(len(self.languages)), 0
        vectors, times = [], []
        for w, k in counted.items():
            v = cache.get(w, cache)
            if v is cache:
                v = self.vector(w)
                if len(cache) < 200_000:
                    cache[w] = v
            if v is not None:
                vectors.append(v)
                times.append(k)
                n += k
        if vectors:
            total = np.asarray(times, float) @ np.asarray(vectors)
        best = int(np.argmax(total))
        share = np.exp((total - total[best]) / max(1.0, n / 30))
        return self.languages[best], float(1 / share.sum())


def _grams(word: Column, size: int) -> Column:
    """As grams_of, of a word with its ends marked."""
    places = F.sequence(F.lit(1), F.length(word) - size + 1)
    return F.when(F.length(word) >= size, F.transform(places, lambda i: word.substr(i, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def fit(docs: DataFrame, sample: int = 20_000) -> Model:
    """A model of the rows of docs (text, lang) whose lang isn't null."""
    d = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    n = d.count()
    if n > sample:
        d = d.filter(F.pmod(F.xxhash64(F.lit("lang"), "doc_id"), F.lit(1 << 30)) < int(sample / n * (1 << 30)))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in bh.tidy(batches):
            for lang, texts in b.groupby("lang")["text"]:
                counted: Counter = Counter()
                for t in texts:
                    counted.update(words_of(t))
                yield pd.DataFrame({"lang": lang, "word": list(counted), "n": list(counted.values())}, columns=["lang", "word", "n"])

    at = Workspace(docs.sparkSession, "language-id")
    counted = d.select("lang", "text").mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counted = at.keep(counted, "counted")  # the words of at most about ``sample`` rows
    # Each distinct word once: unseen words are like rare ones.
    held = [_grams(F.col("word") if size == 1 else F.concat(F.lit("<"), F.col("word"), F.lit(">")), size) for size in range(1, LONGEST + 1)]
    pieces = counted.select("lang", F.explode(F.concat(*held)).alias("key")).groupBy("lang", "key").agg(F.count("*").alias("n"))
    known, parts = (x.toArrow() for x in (counted.withColumnRenamed("word", "key"), pieces))
    languages = sorted(set(known.column("lang").to_pylist()))
    at.drop("counted")
    return Model(languages, *logs(known, languages), *logs(parts, languages))


def logs(rows: pa.Table, languages: list[str]) -> tuple[dict[str, int], np.ndarray]:
    """Of counts (lang, key, n): the keys' rows, and their smoothed log frequencies by language."""
    if not rows.num_rows:
        return {}, np.zeros((0, len(languages)))
    keys = rows.column("key").combine_chunks().dictionary_encode()
    which = {x: i for i, x in enumerate(languages)}
    langs = rows.column("lang").combine_chunks().dictionary_encode()
    lang = np.array([which[x] for x in langs.dictionary.to_pylist()])[langs.indices.to_numpy()]
    seen = np.zeros((len(keys.dictionary), len(languages)))
    np.add.at(seen, (keys.indices.to_numpy(), lang), rows.column("n").to_numpy())
    index = {k: i for i, k in enumerate(keys.dictionary.to_pylist())}
    return index, np.log(seen + SMOOTH) - np.log(seen.sum(axis=0, keepdims=True) + SMOOTH * max(1, len(index)))


def identify(docs: DataFrame, model: Model, held_out: Column) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the words and n-grams of at most about ``sample`` rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, cache = shared.value, {}
        for b in bh.tidy(batches):
            said = [m.predict(t if isinstance(t, str) else None, cache) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "held_out": b["held_out"], "lang_pred": [x[0] for x in said], "score": [x[1] for x in said]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text").mapInPandas(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def held_out_by_id(parts: int, part: int) -> Column:
    """crc32 of doc_id as text, modulo parts, is part."""
    return F.crc32(F.col("doc_id").cast("string")) % parts == part


def language_id(docs: DataFrame, sample: int = 20_000) -> DataFrame:
    held = held_out_by_id(5, 0)
    return identify(docs, fit(docs.filter(~held), sample), held)
