"""The registered queries of these operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm import chat_format, conversation_repair, decontaminate, language_id, lexical_search, licenses, near_duplicates, pii, quality_classifier, quality_rules, repeats, sentencepiece_scan, window_dedup

#: A public SentencePiece model, there on every machine.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CONTROL = "<|im_end|><|im_start|>assistant ok"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = pii.find_pii(table(spark, sf_dir, "documents"))
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    line = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return d.select("doc_id", *[n(k) for k in pii.KINDS], F.sha2(line("base"), 256).alias("base_sha256"), line("spans").alias("spans"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))


def op2_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.links(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return d.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_sentences", *[F.array_join(c, ",").alias(c) for c in ("known", "rules", "licenses")])


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)], c.schema)
    d = chat_format.chat_format(c.unionByName(extra))
    d = quality_rules.once(d, back=chat_format.read_back(F.col("formatted")), learned=F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: chat_format.unescape(s["text"])), ""))
    said = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return d.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = quality_rules.quality_rules(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")


def op10_sentencepiece(spark: SparkSession, sf_dir: str, model: str = MODEL) -> DataFrame:
    d = sentencepiece_scan.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    back = sentencepiece_scan.decode(d.withColumnRenamed("text", "source"), model)
    return back.select(
        "doc_id",
        F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_pieces"),
        F.sha2(F.array_join(F.transform("ids", lambda x: x.cast("string")), " "), 256).alias("ids_sha256"),
        F.col("text").eqNullSafe(F.col("source")).alias("round_trip"),
    )


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    audits, repaired = conversation_repair.repair(conversation_repair.damaged(c), every=c)
    d = audits.join(conversation_repair.digests(repaired), "key", "left")
    return d.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = window_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_pii, op2_jaccard_join, op2_jaccard_links, op3_decontamination, op4_license_scan, op5_chat_formatting, op6_suffix_dedup, op7_language_id, op8_quality_rules, op9_quality_classifier, op10_sentencepiece, op11_conversation_repair, op12_substring_dedup, op13_lexical_search)}
