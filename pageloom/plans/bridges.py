"""Driver tables as this engine's model: lines of documents as units, vectors as boxes, events as jobs.

The rules are simple arithmetic, so that SQL can state them too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.functions import geometry as g
from pageloom.functions import metrics as m

PAGE_HEIGHT, LINES_A_PAGE = 800.0, 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(documents: DataFrame) -> DataFrame:
    """Units of the lines of documents, with metrics."""
    d = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "text"))
    k, i = F.col("ord"), F.col("doc_id")
    label = F.when(k % 7 == 0, "heading").when(k % 7 == 3, "list item").when(k % 7 == 5, "caption").otherwise("paragraph")
    left, top = 72.0 + (k % 3) * 4.0, 760.0 - (k % LINES_A_PAGE) * 18.0
    d = d.select(
        "doc_id",
        "ord",
        F.array().cast("array<int>").alias("path"),
        (F.floor(k / LINES_A_PAGE) + 1).cast("int").alias("page"),
        label.alias("label"),
        F.struct(left.alias("left"), (top - (10.0 + ((k + i) % 5) * 6.25)).alias("bottom"), (left + 60.0 + ((k * 37 + i) % 11) * 40.0).alias("right"), top.alias("top")).alias("box"),
        "text",
        F.when(k % 13 != 12, 8.0 + (k % 9) * 1.5).alias("font_size"),
        F.lit("").alias("font_name"),
        F.lit("").alias("toc_page"),
    )
    return with_metrics(d)


def with_metrics(units: DataFrame) -> DataFrame:
    """lines, line_height and spacing of each unit."""
    h, w = F.abs(g.height(F.col("box"))), F.abs(g.width(F.col("box")))
    u = units.withColumn("lines", m.line_count(F.col("text"), h, F.col("font_size")))
    return u.withColumn("line_height", m.line_height(h, F.col("font_size"), F.col("lines"))).withColumn("spacing", m.letter_spacing(F.col("text"), w, F.col("font_size"), F.col("lines")))


def blocks(units: DataFrame, default_font: float = 12.0) -> DataFrame:
    """Layout blocks of units, in reading order."""
    from pageloom.operators.layout import reading_order

    u = reading_order(units).withColumn("font_size", m.font_size(F.col("font_size"), F.lit(default_font)))
    return u.select("doc_id", "page", "block_id", "ord", "label", "text", g.to_rect(F.col("box"), F.lit(PAGE_HEIGHT)).alias("rect"), "font_size", "font_name", m.resolved_lines(F.col("lines")).alias("lines"), m.resolved_line_height(F.col("line_height"), F.col("font_size")).alias("line_height"), "spacing", "toc_page")


def vector_boxes(embeddings: DataFrame) -> DataFrame:
    """Boxes of the first four numbers of each vector, few positions: documents of 120 boxes on four pages."""
    v = lambda k, n: F.pmod(F.floor(F.abs(F.get("embedding", k).cast("double")) * 1024), F.lit(n))
    left, bottom = v(0, 4) * 1.0, v(1, 4) * 1.0
    b = F.struct(left.alias("left"), bottom.alias("bottom"), (left + 40.0 + v(2, 4) * 2.0).alias("right"), (bottom + 40.0 + v(3, 4) * 2.0).alias("top"))
    return embeddings.select(F.floor(F.col("vec_id") / 120).alias("doc_id"), (F.col("vec_id") % 4 + 1).cast("int").alias("page"), F.when(F.col("label") % 2 == 0, "paragraph").otherwise("caption").alias("label"), F.col("vec_id").alias("ord"), b.alias("box"), F.lit("").alias("text"))


def spent(events: DataFrame) -> DataFrame:
    return events.select(F.col("user_id").alias("client"), F.col("ts").cast("timestamp").alias("ts"), F.greatest(F.col("value"), F.lit(0.0)).alias("seconds"))


def job_intervals(events: DataFrame) -> DataFrame:
    """Each event as a job that runs for its value in whole minutes."""
    minutes = F.floor(F.greatest(F.coalesce("value", F.lit(0.0)), F.lit(0.0))).cast("long")
    return events.select(F.col("event_id").alias("job_id"), F.col("ts").cast("timestamp").alias("start"), F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + minutes * 60_000_000).alias("end"), (minutes * 60).cast("double").alias("seconds"), F.col("user_id").alias("client"))
