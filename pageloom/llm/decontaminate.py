"""Benchmark decontamination as a prefix-filtered set join (DataFrame functions only).

Words are maximal runs of ASCII letters and digits and of non-ASCII characters, A-Z
lower-cased.  A window is 13 consecutive words of an item (a shorter item is one window).
Containment of a whole window asks that every word of it occur, so the prefix that must be
joined is one word; words are ordered by how many documents hold them, and each window
is joined on its rarest word (its anchor) alone.  The anchor's place in the window bounds
the window's start, the text's length bounds its end, and the words at that place are then
compared with the window's exactly.

The windows are broadcast only while there are at most ``broadcast_windows`` of them.  Beyond that places of words are
joined with them by a shuffle (each word with its follower, which must be the window's too, so that frequent anchors
give few candidates); candidates then take the words they claim from their document, and those are compared.  No
document's words are sent along with each of its places.

Null texts have no words; very long texts are read whole.  A null doc_id is kept.  Rows are judged one by one, so repeated
rows give repeated results; repeated items count by item_id once; a null item_id is named
as the empty string; an empty benchmark finds nothing; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.quality_rules import once
from pageloom.llm.store import Workspace

#: What is between words of a text not yet lower-cased (A-Z belong to words too).
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(c: Column) -> Column:
    return F.coalesce(F.translate(c, UPPER, LOWER), F.lit(""))


def folded(c: Column) -> Column:
    """A cheaper key: equal for all words that are equal once lowered (and for a few more)."""
    return F.coalesce(F.lower(c), F.lit(""))


def words_of(text: Column) -> Column:
    """Words as written; compare them lowered."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN), "")


def windows(benchmark: DataFrame, size: int) -> DataFrame:
    """item_id, words: every distinct window of every item."""
    b = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words_of(lowered(F.col("text"))).alias("all"))
    b = once(b.filter(F.size("all") > 0), starts=F.sequence(F.lit(1), F.greatest(F.size("all") - (size - 1), F.lit(1))))
    return b.select("item_id", F.explode("starts").alias("at"), "all").select("item_id", F.slice("all", F.col("at"), size).alias("words")).distinct()


def hits(docs: DataFrame, benchmark: DataFrame, size: int = 13, broadcast_windows: int = 200_000) -> DataFrame:
    """doc_id, n_words, hits array<struct<start, length, item_id>> for each row of docs (starts count from 1)."""
    spark = docs.sparkSession
    w = windows(benchmark, size)
    few = w.limit(broadcast_windows + 1).collect()
    small = len(few) <= broadcast_windows
    w = spark.createDataFrame(few, w.schema).coalesce(1) if small else w
    hint = F.broadcast if small else (lambda x: x)

    # How many documents' words each benchmark word is: the order of rarity, over all documents.
    d = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words_of(F.col("text")).alias("words"))
    at = Workspace(spark, "decontamination")
    if not small:  # read several times: rows must keep their numbers
        d = at.keep(d, "words")
    vocabulary = w.select(F.explode("words").alias("key")).distinct()
    seen = d.select(F.explode("words").alias("word")).select(folded(F.col("word")).alias("folded"), "word")
    seen = seen.join(hint(vocabulary.select(folded(F.col("key")).alias("folded")).distinct()), "folded").select(lowered(F.col("word")).alias("key"))
    rarity = vocabulary.join(seen.groupBy("key").agg(F.count("*").alias("n")), "key", "left").select("key", F.coalesce("n", F.lit(0)).alias("n"))

    # The rarest word of each window, and its first place there.
    placed = w.select("item_id", "words", F.posexplode("words").alias("offset", "key")).join(hint(rarity), "key")
    first = F.min(F.struct("n", "key", "offset"))
    anchors = placed.groupBy("item_id", "words").agg(first.alias("a")).select("item_id", F.col("words").alias("window"), folded(F.col("a.key")).alias("anchor"), F.col("a.offset").alias("offset"))
    anchors = anchors.groupBy("anchor", "offset", "window").agg(F.sort_array(F.collect_set("item_id")).alias("items"))

    d = d.withColumn("n_words", F.size("words"))
    if not small:
        return _joined(d, at.keep(anchors.withColumn("w", F.monotonically_increasing_id()), "anchors"))
    d = d.select("row", "doc_id", "n_words", "words", F.posexplode_outer("words").alias("pos", "word")).withColumn("anchor", folded(F.col("word")))
    j = d.join(hint(anchors), (d["anchor"] == anchors["anchor"]) & (d["pos"] >= anchors["offset"]) & (d["pos"] - anchors["offset"] + F.size(anchors["window"]) <= d["n_words"]), "left")
    start = F.col("pos") - F.col("offset") + 1
    said = _said(F.when(F.col("offset").isNull(), 1).otherwise(start), F.coalesce(F.size("window"), F.lit(1)))
    hit = F.when(F.col("offset").isNotNull() & (said == F.array_join("window", " ")), F.struct(start.alias("start"), F.size("window").alias("length"), F.col("items")))
    j = j.select("row", "doc_id", "n_words", "pos", hit.alias("hit")).filter(F.col("hit").isNotNull() | F.coalesce(F.col("pos") == 0, F.lit(True)))
    return j.groupBy("row", "doc_id").agg(F.max("n_words").cast("long").alias("n_words"), F.collect_list("hit").alias("hits")).drop("row")


def _said(start: Column, size: Column) -> Column:
    """Words of a document from start on, compared as a text (words hold no spaces)."""
    return lowered(F.array_join(F.slice("words", start, size), " "))


def _joined(d: DataFrame, anchors: DataFrame) -> DataFrame:
    """As hits, of documents (row, doc_id, n_words, words) and windows (w, anchor, offset, window, items), by shuffles only."""
    size = F.size("window")
    follower = F.when(F.col("offset") + 1 < size, folded(F.get("window", F.col("offset") + 1)))
    keys = anchors.select("w", "anchor", "offset", size.alias("size"), follower.alias("follower"))
    places = d.select("row", "n_words", F.posexplode(F.transform("words", lambda x, i: F.struct(folded(x).alias("anchor"), folded(F.get("words", i + 1)).alias("next")))).alias("pos", "at"))
    places = places.select("row", "n_words", "pos", "at.anchor", "at.next")
    # What a place and a window must share is one key; a window's last word has no follower.
    one = lambda a, b: F.concat_ws(" ", a, b)
    ends = keys.filter("follower is null")
    last = places.join(ends.select("anchor").distinct(), "anchor", "left_semi").withColumn("key", F.col("anchor"))
    found = places.withColumn("key", one(F.col("anchor"), F.col("next"))).unionByName(last)
    keys = keys.select("w", "offset", "size", F.when(F.col("follower").isNull(), F.col("anchor")).otherwise(one(F.col("anchor"), F.col("follower"))).alias("key"))
    found = found.join(keys, "key").filter("pos >= offset and pos - offset + size <= n_words").select("row", "w", (F.col("pos") - F.col("offset") + 1).alias("start"), "size")
    claimed = found.join(d.select("row", "words"), "row").select("row", "w", "start", "size", _said(F.col("start"), F.col("size")).alias("said"))
    held = claimed.join(anchors.select("w", F.array_join("window", " ").alias("window"), "items"), "w").filter("said = window")
    held = held.groupBy("row").agg(F.collect_list(F.struct("start", F.col("size").alias("length"), "items")).alias("hits"))
    out = d.select("row", "doc_id", F.col("n_words").cast("long")).join(held, "row", "left")
    return out.select("doc_id", "n_words", F.coalesce("hits", F.array().cast(held.schema["hits"].dataType)).alias("hits"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 13, percent: int = 5, broadcast_windows: int = 200_000) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted item_ids as strings), contaminated.

    A document is contaminated if words inside occurrences of windows make up at least
    ``percent`` of its words.
    """
    d = hits(docs, benchmark, size, broadcast_windows)
    d = once(d, spans=F.sort_array(F.transform("hits", lambda h: F.struct(h["start"].alias("start"), (h["start"] + h["length"]).alias("end")))))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    union = F.aggregate("spans", start, lambda s, x: F.struct(F.greatest(s["end"], x["end"]).alias("end"), (s["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(s["end"], x["start"]))).alias("n")))["n"]
    d = d.select("doc_id", "n_words", union.cast("long").alias("n_hit"), F.sort_array(F.array_distinct(F.flatten(F.transform("hits", lambda h: h["items"])))).alias("items"))
    return d.select("*", F.size("items").cast("long").alias("n_items"), ((F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words"))).alias("contaminated"))
