"""Reports: structured documents, layout reports, Markdown, JSON lines, job summaries.

Documents are nested by page and position; each is one row, so a report's size is a document's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageloom.functions import geometry as g
from pageloom.functions import metrics as m
from pageloom.operators.layout import PREVIEW


def structured_documents(units: DataFrame, **header: str) -> DataFrame:
    """doc_id, header columns, pages[page, elements[...]] in order (A1, K1, P10)."""
    e = F.struct("ord", F.coalesce("unit_id", F.lit("")).alias("id"), "label", F.array("box.left", "box.bottom", "box.right", "box.top").alias("bbox"), F.col("text").alias("content"), "font_name", "font_size", F.col("lines").alias("estimated_line_count"), F.col("line_height").alias("line_height_pt"), F.col("spacing").alias("letter_spacing_em"), F.col("toc_page").alias("toc_page_number"), F.coalesce("translated", F.lit("")).alias("translated"))
    p = units.groupBy("doc_id", "page").agg(F.transform(F.array_sort(F.collect_list(e)), lambda x: x.dropFields("ord")).alias("elements"))
    d = p.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "elements"))).alias("pages"))
    return d.select("doc_id", *[F.lit(v).alias(k) for k, v in header.items()], "pages")


def markdown(units: DataFrame) -> DataFrame:
    """doc_id, markdown: a page heading whenever the page changes, then the text (W2, K2); repeated if pages interleave."""
    said = F.coalesce(F.nullif("translated", F.lit("")), F.col("text"))
    w = Window.partitionBy("doc_id").orderBy("ord")
    turned = F.coalesce(F.lag("page").over(w) != F.col("page"), F.lit(True))
    u = units.select("doc_id", "ord", F.concat(F.when(turned, F.concat(F.lit("## Page "), F.col("page").cast("string"), F.lit("\n\n"))).otherwise(""), said).alias("part"))
    d = u.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "part"))).alias("parts"))
    return d.select("doc_id", F.array_join(F.transform("parts", lambda x: x["part"]), "\n\n").alias("markdown"))


def layout_report(blocks: DataFrame, engine: str = "pretext") -> DataFrame:
    """doc_id, layout_engine, overflow[...], layout_plan[...] of matched blocks."""
    bbox = F.array(*[F.round(c, 3) for c in (F.col("rect.x0"), F.col("plan_y0"), F.col("rect.x1"), F.col("plan_y1"))])
    plan = F.struct("page", "block_id", "label", F.col("column"), bbox.alias("planned_bbox"), F.col("shift").alias("vertical_shift_pt"), F.col("top_delta").alias("top_delta_pt"), F.col("bottom_delta").alias("bottom_delta_pt"), F.col("lines").alias("pretext_line_count"), F.col("height").alias("pretext_height_pt"), F.col("used").alias("final_scale_used"), F.lit(engine).alias("layout_engine"), F.col("fallback").alias("layout_fallback"), F.col("reason").alias("planner_candidate_reason"), F.col("overlap").alias("post_render_overlap_pt"), F.col("font").alias("planned_font_size"), F.col("line").alias("planned_line_height_pt"), F.col("letter").alias("planned_letter_spacing_em"))
    over = F.when(~F.col("drawn"), F.struct("page", "block_id", "label", F.col("used").alias("scale"), F.substring("text", 1, PREVIEW).alias("text_preview"), F.col("fallback").alias("layout_fallback")))
    d = blocks.groupBy("doc_id").agg(F.array_sort(F.collect_list(over)).alias("overflow"), F.array_sort(F.collect_list(plan)).alias("layout_plan"))
    return d.select("doc_id", F.lit(engine).alias("layout_engine"), "overflow", "layout_plan")


def job_summaries(blocks: DataFrame, provider: str, target: str) -> DataFrame:
    """doc_id, units, overflow count and a line of text."""
    d = blocks.groupBy("doc_id").agg(F.count("*").alias("units"), F.count_if(~F.col("drawn")).alias("overflow"))
    return d.withColumn("summary", F.format_string(f"job %s: {provider}, {target}, %d units, %d overflow", F.col("doc_id").cast("string"), "units", "overflow"))


def write_json(df: DataFrame, path: str, mode: str = "error") -> None:
    """One object a line (K1, K3, K4); nulls are written, so readers find every field."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_markdown(df: DataFrame, path: str, mode: str = "error") -> None:
    """Text files by doc_id (K2)."""
    df.select(F.col("markdown").alias("value"), "doc_id").write.mode(mode).partitionBy("doc_id").text(path)


def write_markdown_batches(df: DataFrame, path: str, buckets: int = 64, mode: str = "error") -> None:
    """JSON lines of doc_id and markdown, in ``buckets`` folders by a hash of doc_id (K2).

    For many documents: as many files as buckets, not as documents; a document is found by its bucket, pmod(xxhash64(doc_id), buckets).
    """
    d = df.select("doc_id", "markdown", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).alias("bucket"))
    d.repartition(buckets, "bucket").write.mode(mode).partitionBy("bucket").json(path)


#: Fixed value: the width of an outline in a preview.
OUTLINE = 1.1


def box_preview(boxes: DataFrame, pages: DataFrame) -> DataFrame:
    """What to outline on each page (K6): boxes (doc_id, page, ord, label, box) of pages (doc_id, page, height) that are there, as
    rectangles from the top with colour (red, green, blue) and width; boxes of other pages are skipped."""
    x = boxes.join(pages.select("doc_id", "page", F.col("height").alias("__height")), ["doc_id", "page"])
    r, c = g.to_rect(F.col("box"), F.col("__height")), m.colour(F.lower(m.stripped(F.col("label"))))
    x = x.withColumns({"__r": r, "__c": c})
    return x.select("doc_id", "page", "ord", "label", "__r.x0", "__r.y0", "__r.x1", "__r.y1", *[F.get("__c", k).alias(n) for k, n in enumerate(("red", "green", "blue"))], F.lit(OUTLINE).alias("width"))


def append_log(messages: DataFrame, path: str) -> None:
    """messages (ts, message) as ``[ts] message`` lines (K7)."""
    messages.select(F.format_string("[%s] %s", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), "message").alias("value")).write.mode("append").text(path)


#: What is published for a job.
ARTIFACTS = {"translated": "translated.pdf", "boxes": "boxes.pdf", "markdown": "result.md", "structured": "structured.json", "report": "render_report.json", "units": "translation_units.jsonl"}


def artifacts(jobs: DataFrame, root: str, files: DataFrame | None = None) -> DataFrame:
    """jobs (job_id) with the map of what is published for each (K8); with files (path), of those that exist only (K9)."""
    pairs = [x for k, v in ARTIFACTS.items() for x in (F.lit(k), F.concat(F.lit(f"{root}/"), F.col("job_id"), F.lit(f"/{v}")))]
    all_ = F.create_map(*pairs)
    if files is None:
        return jobs.withColumn("artifacts", all_)
    each = jobs.select("job_id", F.explode(all_).alias("__k", "path")).join(files.select("path").distinct(), "path", "left_semi")
    there = each.groupBy("job_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("__k", "path")))).alias("artifacts"))
    return jobs.join(there, "job_id", "left").withColumn("artifacts", F.coalesce("artifacts", F.create_map().cast("map<string,string>")))
