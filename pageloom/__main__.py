"""Command line: ``python -m pageloom translate INPUT``, ``sweep ROOT``, ``queries`` (also by spark-submit)."""

from __future__ import annotations

import argparse
import sys
import time


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pageloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    t = sub.add_parser("translate", help="page trees (JSON files) to translated, structured documents, Markdown and layout reports")
    t.add_argument("input", help="a JSON file or a folder of them, at any path Spark can read")
    t.add_argument("--output", required=True)
    t.add_argument("--provider", default=None, help="a registered translator (default: identity)")
    t.add_argument("--target", default=None)
    t.add_argument("--model", default=None)
    t.add_argument("--pages", default="all", choices=["all", "first20", "first"])
    t.add_argument("--engine", default=None, choices=["legacy", "pretext"])
    t.add_argument("--no-adjust", action="store_true", help="leave letter spacing alone where blocks overlap")
    w = sub.add_parser("sweep", help="delete workspaces past their retention")
    w.add_argument("root")
    w.add_argument("--hours", type=float, default=None)
    sub.add_parser("queries", help="names of the registered queries")
    return p


def translate(spark, a) -> None:
    from pyspark.sql import functions as F

    from pageloom import settings
    from pageloom.operators import dedup, jobs, layout, split
    from pageloom.operators import translate as tr
    from pageloom.plans import bridges, reports
    from pageloom.sources import documents, parsers

    s = settings.of_session(spark)
    files = documents.binary_files(spark, a.input, "*.json")
    trees = parsers.required(parsers.parsed(files, "json"))
    doc = F.regexp_extract("path", r"([^/]+)\.json$", 1)
    u = documents.units(trees.select(doc.alias("doc_id"), "tree")).withColumns({"path": F.array().cast("array<int>"), "toc_page": F.lit("")})
    limit = {"all": None, "first20": 20, "first": 1}[a.pages]
    u = jobs.first_pages(dedup.deduplicated(u), limit)
    u = split.split_units(bridges.with_metrics(u)).withColumn("ord", (F.row_number().over(split.Window.partitionBy("doc_id").orderBy("ord", "path")) - 1).cast("int"))
    u = tr.postprocessed(tr.translated(u, a.provider or "identity", a.target or s["target_language"], a.model or s["default_model"]), tr.phrases(spark, []), "en")
    u = tr.worth_drawing(u.withColumn("translated", F.col("final")).drop("final"))
    u.write.mode("error").parquet(f"{a.output}/units")
    u = spark.read.parquet(f"{a.output}/units")
    reports.write_json(reports.structured_documents(u, provider=a.provider or "identity"), f"{a.output}/structured")
    reports.write_markdown(reports.markdown(u), f"{a.output}/markdown")
    b = bridges.blocks(u, s["base_font_size"])
    if (a.engine or s["layout_engine"]) == "pretext":
        keep = b.select("doc_id", "page", "block_id", "rect", "label", "text")
        reports.write_json(reports.layout_report(layout.matched(keep, layout.page_plan(b, adjust=not a.no_adjust))), f"{a.output}/report")
    else:
        reports.write_json(layout.legacy_plan(b), f"{a.output}/report")


def main(argv: list[str] | None = None) -> int:
    a = arguments().parse_args(argv)
    if a.command == "queries":
        from pageloom import catalog

        print("\n".join(sorted(catalog.QUERIES)))
        return 0
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName(f"pageloom {a.command}").getOrCreate()
    if a.command == "sweep":
        from pageloom.operators import jobs

        for name in jobs.sweep(spark, a.root, time.time(), jobs.RETENTION_S if a.hours is None else int(a.hours * 3600)):
            print(name)
        return 0
    if a.input.lower().endswith((".pdf", ".txt", ".md")):
        print("the input must be a page tree (.json) or a folder of them; parse other files with a registered parser first", file=sys.stderr)
        return 2
    translate(spark, a)
    return 0


if __name__ == "__main__":
    sys.exit(main())
