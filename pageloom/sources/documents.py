"""Sources: PDF files as bytes, machine-readable page trees, uploads, measurement requests."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from pageloom.functions import geometry as g

#: Largest upload; labels of boxes; keys of the tree with their aliases.
MOST_UPLOAD = 50 * 1024 * 1024
BOX_LABELS = ("paragraph", "heading", "caption", "list item")
KEYS = {"page": ("page number", "page"), "bbox": ("bounding box", "bbox"), "label": ("type", "label"), "font_size": ("font size", "font_size"), "font": ("font", "font"), "content": ("content", "content")}


def binary_files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """path, modificationTime, length, content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def first_matching(files: DataFrame, suffixes: tuple[str, ...]) -> DataFrame:
    """The first file by path with one of the suffixes; an error if there is none."""
    ok = files.filter(F.lower("path").rlike("(" + "|".join(s.lower().replace(".", r"\.") for s in suffixes) + ")$"))
    return ok.agg(F.min_by(F.struct(*files.columns), "path").alias("f")).select(F.when(F.col("f").isNull(), F.raise_error(F.lit("no file with a matching suffix")).cast("struct<path:string>")["path"]).otherwise(F.col("f.path")).alias("path"))


def uploads(files: DataFrame, most: int = MOST_UPLOAD) -> DataFrame:
    """files with a verdict: accepted, too_large or not_pdf (S7); rejected ones are a dead-letter table."""
    return files.withColumn("verdict", F.when(~F.lower("path").endswith(".pdf"), "not_pdf").when(F.col("length") > most, "too_large").otherwise("accepted"))


def structured(spark: SparkSession, path: str) -> DataFrame:
    """Elements of structured documents written earlier, with page and position."""
    d = spark.read.option("multiLine", "true").json(path)
    p = d.select("job_id", F.explode("pages").alias("p"))
    return p.select("job_id", F.col("p.page").alias("page"), F.posexplode("p.elements").alias("pos", "e")).select("job_id", "page", "pos", "e.*")


def _row(node: dict) -> tuple | None:
    def key(name: str):
        first, other = KEYS[name]  # a key that is there hides its alias, even if it is null
        return node[first] if first in node else node.get(other)

    page, bbox, text = key("page"), key("bbox"), key("content")
    if not isinstance(page, int) or not isinstance(bbox, list) or len(bbox) != 4:
        return None
    try:
        sides = [float(x) for x in bbox]
    except (TypeError, ValueError):
        return None
    size, font, label = key("font_size"), key("font"), key("label")
    number = isinstance(size, (int, float)) and not isinstance(size, bool)
    return (int(page), str(label) if label is not None else None, *sides, text if isinstance(text, str) else None, float(size) if number else None, font if isinstance(font, str) else "")


def tree_rows(root: object) -> Iterator[tuple]:
    """Every object of a JSON tree with a page and a box, depth first, parents before children."""
    stack = [root]
    while stack:
        node = stack.pop()
        if isinstance(node, dict):
            row = _row(node)
            if row is not None:
                yield row
            stack.extend(reversed(list(node.values())))
        elif isinstance(node, list):
            stack.extend(reversed(node))


@udtf(returnType="ord int, page int, label string, left double, bottom double, right double, top double, text string, font_size double, font_name string")
class Walk:
    """tree_rows of a tree, numbered."""

    def eval(self, tree: str) -> Iterator[tuple]:
        try:
            root = json.loads(tree) if tree else None
        except ValueError:
            return
        for n, row in enumerate(tree_rows(root)):
            yield (n, *row)


def walked(trees: DataFrame, key: str, tree: str) -> DataFrame:
    """key and the walked rows of each tree; a page or label filter that is known belongs before this."""
    t = trees.select(F.col(key).alias("__key"), F.col(tree).alias("__tree"))
    return t.lateralJoin(Walk(F.col("__tree").outer())).withColumnRenamed("__key", key).drop("__tree")


def _box() -> Column:
    return F.struct("left", "bottom", "right", "top")


def units(trees: DataFrame, key: str = "doc_id", tree: str = "tree") -> DataFrame:
    """Positioned text units: content that isn't blank, numbered in the walk's order (S3, F1)."""
    w = walked(trees, key, tree).filter(F.col("text").rlike(r"(?U)\S"))
    return w.select(key, "ord", "page", F.coalesce("label", F.lit("text")).alias("label"), _box().alias("box"), F.regexp_replace("text", r"(?U)^\s+|\s+$", "").alias("text"), "font_size", "font_name")


def boxes(trees: DataFrame, key: str = "doc_id", tree: str = "tree") -> DataFrame:
    """Detected boxes of the four labels; their text may be empty."""
    w = walked(trees, key, tree).withColumn("label", F.lower(F.trim(F.coalesce("label", F.lit("")))))
    b = _box()
    return w.filter(F.col("label").isin(*BOX_LABELS)).select(key, "ord", "page", "label", g.box(*[b[k] for k in ("left", "bottom", "right", "top")]).alias("box"), F.coalesce("text", F.lit("")).alias("text"))


def measurement_requests(raw: DataFrame, column: str = "json") -> DataFrame:
    """Requests from JSON lists: objects with an id, defaults filled in."""
    kind = "array<struct<request_id:string,text:string,font_family_css:string,font_size_px:double,line_height_px:double,max_width_px:double,letter_spacing_em:double>>"
    r = raw.select(F.explode(F.from_json(column, kind)).alias("r")).select("r.*").filter(F.trim("request_id") != "")
    return r.na.fill({"text": "", "font_family_css": "sans-serif", "font_size_px": 16.0, "line_height_px": 20.0, "max_width_px": 1.0})


def run_log(spark: SparkSession, path: str) -> DataFrame:
    """ts, message and key=value fields of append-only log lines ``[ts] message``."""
    t = spark.read.text(path)
    message = F.regexp_extract("value", r"^\[[^\]]*\] (.*)$", 1)
    pairs = F.transform(F.regexp_extract_all(message, F.lit(r"(\w+=\S+)"), F.lit(1)), lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.regexp_replace(x, r"^\w+=", "").alias("v")))
    return t.select(F.regexp_extract("value", r"^\[([^\]]*)\]", 1).try_cast("timestamp").alias("ts"), message.alias("message"), F.map_from_entries(F.array_distinct(pairs)).alias("fields"))


#: How a pointer to a large file begins, and the least size of a real model file.
POINTER, LEAST_MODEL = "version https://git-lfs.github.com/spec/", 1 << 20


def model_assets(files: DataFrame) -> DataFrame:
    """files (path, length, content) with state: pointer (the file itself is elsewhere), too_small or ready."""
    start = F.substring("content", 1, len(POINTER)).cast("string")
    return files.withColumn("state", F.when(start == POINTER, "pointer").when(F.col("length") <= LEAST_MODEL, "too_small").otherwise("ready"))
