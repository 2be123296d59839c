"""The corpus pipeline: documents in, token ids of the clean, distinct ones out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next one's docs.  A stage works on all that its predecessor kept.

Rows are judged as rows: those that share a doc_id, or have none, are documents of their own, the one with the smaller doc_id (nulls
last), then text hash, coming first.  A null or empty text has no duplicates, isn't contaminated, holds no personal data and encodes to nothing; whether it is
good the classifier says.  Equal texts are one group, of which the first row stays.  Without labels of both classes there is no
classifier, and all rows stay.  Very long texts are read whole; an empty table gives an empty result; further columns are
kept, whatever their names, but by the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm import decontaminate, near_duplicates, pii, quality_classifier, sentencepiece_scan
from pageloom.llm.queries import MODEL, table
from pageloom.llm.store import Workspace, scratch

#: Ids that may be sent to every executor (8 MB); more are joined by a shuffle.
FEW = 1_000_000


def numbered(docs: DataFrame, at: Workspace) -> tuple[DataFrame, str]:
    """docs with a number of its own for each row, in the order of doc_id, and that column's name."""
    name = "row"
    while name in docs.columns:
        name = f"_{name}"
    n, different = docs.agg(F.count("*"), F.count_distinct("doc_id")).first()
    if n == different:
        return docs.withColumn(name, F.col("doc_id").cast("long")), name
    order = [F.asc_nulls_last("doc_id"), F.xxhash64("text")]
    d = docs.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id())
    return at.keep(d, "numbered"), name


def without(docs: DataFrame, ids: DataFrame, name: str, at: Workspace) -> DataFrame:
    """docs whose number (column ``name``) isn't among those of ids."""
    ids = at.keep(ids, "dropped")
    return docs.join(F.broadcast(ids) if ids.count() <= FEW else ids, name, "left_anti").drop(name)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good; all, if there is nothing to learn from."""
    model = quality_classifier.learn(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.keep_good(docs, model) if model.network else docs


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates."""
    at = Workspace(spark, "pipeline-distinct")
    rows, name = numbered(docs, at)
    d = near_duplicates.near_duplicates(rows.select(F.col(name).alias("doc_id"), "text"))
    return without(rows, d.filter("doc_id <> component_id").select(F.col("doc_id").alias(name)), name, at).select(*docs.columns)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth is benchmark text."""
    at = Workspace(spark, "pipeline-contaminated")
    rows, name = numbered(docs, at)
    d = decontaminate.decontaminate(rows.select(F.col(name).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return without(rows, d.filter("contaminated").select(F.col("doc_id").alias(name)), name, at).select(*docs.columns)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data masked; n_chars follows the text."""
    d = pii.mask_pii(docs)
    if "n_chars" in d.columns:
        d = d.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return d.select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces and ids of each document."""
    d = sentencepiece_scan.encode(docs.select("doc_id", "text"), MODEL)
    return d.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_pieces"), "ids")


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", distinct), ("benchmark decontamination", uncontaminated), ("PII", private), ("SentencePiece encoding", encoded)]

#: SQL can't express a trained classifier; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        with scratch():  # a stage's own tables go once its result is written, and so does its predecessor's
            docs = at.keep(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            at.drop(f"stage-{k - 1}")
    return docs
