"""Quality rules as weak supervision (DataFrame functions only).

Rules vote good (1), bad (0) or abstain (null) on figures of the whole text.  The votes
of all documents are counted by pattern (at most 3**rules patterns, whatever the input).
Expectation-maximisation on those counts estimates, for each rule, how often its votes are right on good and on bad
documents, and the share of good documents; a document's posterior probability of being good decides, instead
of a demand that every rule pass.  An abstention says nothing, so a document on which all rules abstain has the share
of good documents as its probability.  Labels are not used.

Null text has no words; very long texts are read whole; an empty table gives an empty result; repeated rows are judged
each for itself; a null doc_id is kept; a posterior of just ``at_least`` is kept; further columns of the input are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.store import Workspace

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[^#*$%&|<>]+"


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are worked out once a row, even where lambdas refer to them.

    (A generator stands between, so the optimizer can't copy the expression into them.)
    """
    for name, c in columns.items():
        df = df.select("*", F.explode(F.array(c)).alias(name))
    return df


def counts(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_distinct, n_letters, n_capitals, n_exclaims, n_ends (words
    that end in a mark), n_symbol_lines."""
    size = lambda c: F.size(c).cast("long")
    left = lambda other: F.length(F.regexp_replace("text", other, "")).cast("long")
    t = F.coalesce("text", F.lit(""))
    d = docs.select("doc_id", t.alias("text"))
    d = once(d, words=F.array_remove(F.split("text", SPACES), ""), lines=F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    d = d.select(
        "doc_id",
        size("words").alias("n_words"),
        left(SPACES).alias("word_chars"),
        left(SYMBOLS).alias("n_symbols"),
        left(r"\P{L}+").alias("n_letters"),
        left(r"\P{Lu}+").alias("n_capitals"),
        left("[^!]+").alias("n_exclaims"),
        F.regexp_count("text", F.lit(r"[.,;:!?](?:[\x20\x09-\x0D]|\z)")).cast("long").alias("n_ends"),
        size("lines").alias("n_lines"),
        size(F.filter("lines", lambda x: x.rlike("[#*$%&|<>]"))).alias("n_symbol_lines"),
        (size("lines") - size(F.array_distinct("lines"))).alias("n_dup_lines"),
        size(F.array_distinct("words")).alias("n_distinct"),
        "words",
    )
    w = F.col("words")
    windows = F.when(F.size(w) >= 3, F.sequence(F.lit(0), F.size(w) - 3)).otherwise(F.array().cast("array<int>"))
    d = once(d, triples=F.transform(windows, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))).drop("words")
    some = F.size(F.array_distinct("triples")) < F.size("triples")
    placed = F.when(some, F.sort_array(F.transform("triples", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    d = once(d, placed=placed).drop("triples")
    p = F.col("placed")
    same = lambda x, k: F.coalesce(F.get(p, k)["h"] == x["h"], F.lit(False))
    d = once(d, at=F.sort_array(F.transform(F.filter(p, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))).drop("placed")
    # Words under windows at sorted starts: each start adds the words up to the next one, three at most.
    a = F.col("at")
    covered = F.aggregate(a, F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")), lambda s, x: F.struct(x.alias("last"), (s["n"] + F.least(F.lit(3), x - s["last"])).alias("n")))["n"]
    return d.withColumn("n_repeat_words", covered.cast("long")).drop("at")


def _ratio(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, 0).when(good, 1)


def _between(a: str, b: str, bad: tuple[float, float], good: tuple[float, float]) -> Column:
    """Bad if a / b is outside ``bad``, good if it is within ``good``."""
    x = _ratio(a, b)
    return _vote((x < bad[0]) | (x > bad[1]), (x >= good[0]) & (x <= good[1]))


#: Each rule: figures -> 0 (bad), 1 (good) or null (abstains).  The limits are those that web corpora are usually filtered by,
#: with room between bad and good.  Several rules look at one fault from different sides, so that they can confirm each other.
RULES: dict[str, Callable[[], Column]] = {
    "length": lambda: _vote(F.col("n_words") < 20, F.col("n_words") >= 100),
    "symbols": lambda: _vote(_ratio("n_symbols", "n_words") >= 0.1, _ratio("n_symbols", "n_words") <= 0.02),
    "letters": lambda: _vote(_ratio("n_letters", "word_chars") < 0.8, _ratio("n_letters", "word_chars") >= 0.9),
    "symbol_lines": lambda: _vote(_ratio("n_symbol_lines", "n_lines") >= 0.5, _ratio("n_symbol_lines", "n_lines") <= 0.1),
    "repeats": lambda: _vote(_ratio("n_repeat_words", "n_words") > 0.3, _ratio("n_repeat_words", "n_words") <= 0.1),
    "variety": lambda: _vote((_ratio("n_distinct", "n_words") < 0.2) & (F.col("n_words") < 2000), _ratio("n_distinct", "n_words") >= 0.35),
    "lines": lambda: F.when(F.col("n_lines") >= 2, _vote(_ratio("n_dup_lines", "n_lines") >= 0.3, _ratio("n_dup_lines", "n_lines") <= 0.1)),
    "word_length": lambda: _between("word_chars", "n_words", (3, 10), (3.5, 8.5)),
    "capitals": lambda: _vote(_ratio("n_capitals", "word_chars") > 0.3, _ratio("n_capitals", "word_chars") <= 0.1),
    "exclaims": lambda: _vote(_ratio("n_exclaims", "n_words") >= 0.1, _ratio("n_exclaims", "n_words") <= 0.02),
    "ends": lambda: _between("n_ends", "n_words", (0.01, 0.4), (0.03, 0.3)),
}


@dataclass(frozen=True)
class Belief:
    """What is believed of a rule before any document is seen, and how strongly (as a share of the documents)."""

    good: float = 0.9  # documents that are good
    caught: float = 0.3  # votes on a bad document that are bad: it shows some faults only
    wrong: float = 0.02  # votes on a good document that are bad
    weight: float = 0.05


def estimate(patterns: list[tuple[tuple[int, ...], int]], rules: int, belief: Belief = Belief(), rounds: int = 200) -> dict[tuple[int, ...], float]:
    """Expectation-maximisation over counted vote patterns: {pattern: posterior of good}.

    A vote is 0, 1 or 2 (abstains; it has no part in the likelihood).  A rule has two probabilities: that a vote it casts
    on a bad document is bad, and that one it casts on a good document is bad.  Pseudo-counts of the beliefs keep the classes
    from changing places.  Patterns: at most 3**rules.
    """
    if not patterns:
        return {}
    patterns = sorted(patterns)
    total = sum(n for _, n in patterns)
    strength = belief.weight * total
    good, bad_votes = belief.good, [[belief.caught] * rules, [belief.wrong] * rules]  # of a bad, of a good document
    cast = [[(r, v) for r, v in enumerate(p) if v < 2] for p, _ in patterns]
    last: list[float] = []
    for _ in range(rounds):
        weigh = [(math.log(1 - g) - math.log(1 - b), math.log(g) - math.log(b)) for b, g in zip(*bad_votes, strict=True)]  # of a good, of a bad vote
        prior = math.log(good) - math.log(1 - good)
        odds = [prior + sum(weigh[r][1 - v] for r, v in c) for c in cast]
        q = [1 / (1 + math.exp(-max(-500.0, min(500.0, x)))) for x in odds]
        if last and max(abs(a - b) for a, b in zip(q, last, strict=True)) < 1e-9:
            break
        last = q
        votes = [[strength] * rules, [strength] * rules]
        bad = [[strength * belief.caught] * rules, [strength * belief.wrong] * rules]
        for (_, n), c, x in zip(patterns, cast, q, strict=True):
            for r, v in c:
                votes[0][r] += n * (1 - x)
                votes[1][r] += n * x
                if v == 0:
                    bad[0][r] += n * (1 - x)
                    bad[1][r] += n * x
        good = (strength * belief.good + sum(n * x for (_, n), x in zip(patterns, q, strict=True))) / (strength + total)
        bad_votes = [[min(1 - 1e-6, max(1e-6, b / v)) for b, v in zip(bad[k], votes[k], strict=True)] for k in (0, 1)]
        good = min(1 - 1e-6, max(1e-6, good))
    return {p: x for (p, _), x in zip(patterns, last, strict=True)}


def quality_rules(docs: DataFrame, rules: dict[str, Callable[[], Column]] = RULES, at_least: float = 0.5) -> DataFrame:
    """The figures of every document, base_failed, the posterior p_good and kept."""
    spark = docs.sparkSession
    code = sum((F.coalesce(rule(), F.lit(2)) * 3**k for k, rule in enumerate(rules.values())), F.lit(0)).cast("int")
    d = Workspace(spark, "quality-rules").keep(counts(docs).withColumn("pattern", code), "figures")
    counted = d.groupBy("pattern").count().collect()  # at most 3**len(rules) rows
    votes = lambda x: tuple(x // 3**k % 3 for k in range(len(rules)))
    found = estimate([(votes(r["pattern"]), r["count"]) for r in counted], len(rules))
    p = F.broadcast(spark.createDataFrame([(r["pattern"], found[votes(r["pattern"])]) for r in counted], "pattern int, p_good double"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return d.join(p, "pattern", "left").withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("p_good") >= at_least)).drop("pattern")
