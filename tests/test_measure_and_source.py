"""The page-tree data source, and measuring with an external program."""

import json
import os

import pytest
from pyspark.sql import functions as F

from pageloom.operators import layout
from pageloom.sources import documents, helpers, pages, parsers

TREE = {"pages": [{"page": 1, "type": "heading", "bbox": [0, 90, 100, 100], "content": " Title ", "font": "Arial", "font size": 14, "kids": [{"page": 1, "bbox": [0, 80, 50, 88], "content": "inner"}]}, {"page number": 2, "label": "paragraph", "bounding box": [0, 10, 100, 60], "content": "Body"}, {"page": 2, "bbox": [0, 0, 1, 1], "content": "  "}, {"page": 3, "type": "paragraph", "bbox": [0, 0, 9, 9], "content": "last"}]}


@pytest.fixture()
def trees(spark, tmp_path):
    pages.register(spark)
    for k in range(5):
        sub = tmp_path / f"d{k % 2}"
        sub.mkdir(exist_ok=True)
        (sub / f"t{k}.json").write_text(json.dumps(TREE if k else {"page": 1, "bbox": [1, 2, 3, 4], "content": "only"}))
    (tmp_path / "bad.json").write_text("{not json")
    (tmp_path / "worse.json").write_bytes(b"\xff\xfe\x00")
    (tmp_path / "_hidden.json").write_text("{}")
    return str(tmp_path)


def test_source_equals_parser_and_walk(spark, trees):
    got = spark.read.format("pagetrees").load(trees)
    files = documents.binary_files(spark, trees, "*.json").filter(~F.col("path").contains("_hidden"))
    parsed = parsers.parsed(files, "json")
    want = documents.units(parsed.filter("error is null"), "path", "tree")
    name = lambda p: p.split("/")[-1]
    plain = lambda d: sorted((name(r["path"]), r["page"], r["label"], r["left"], r["bottom"], r["right"], r["top"], r["text"], r["font_size"], r["font_name"]) for r in d.collect())
    assert plain(got.filter("error is null")) == plain(want.select("path", "page", "label", "box.*", "text", "font_size", "font_name")) and got.filter("error is null").count() == 17
    bad = {name(r["path"]): r["error"].split(":")[0] for r in got.filter("error is not null").collect()}
    assert bad == {name(r["path"]): r["error"].split(":")[0] for r in parsed.filter("error is not null").collect()} == {"bad.json": "JSONDecodeError", "worse.json": "UnicodeDecodeError"}


def test_source_takes_filters(spark, trees):
    d = spark.read.format("pagetrees").load(trees)
    few = d.filter((F.col("page") <= 2) & (F.col("label") == "paragraph"))
    assert sorted(r["text"] for r in few.collect()) == ["Body"] * 4
    reader = pages.Reader({"path": trees})
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual

    left = list(reader.pushFilters([LessThanOrEqual(("page",), 2), GreaterThan(("top",), 1.0), In(("label",), ("paragraph", "text")), EqualTo(("text",), "x")]))
    assert [type(f).__name__ for f in left] == ["GreaterThan", "EqualTo"]
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert sorted(r[8] for r in rows) == ["Body"] * 4 + ["inner"] * 4 + ["only"]  # and no rows of errors
    plan = few._jdf.queryExecution().explainString(few.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "Filter (" not in plan.split("Scan")[0] and "pagetrees" in plan.lower()


def test_source_deals_files_by_size(spark, trees):
    assert len(pages.Reader({"path": trees, "bytespertask": "1"}).partitions()) == 7 and len(pages.Reader({"path": trees}).partitions()) == 1
    one = spark.read.format("pagetrees").load(os.path.join(trees, "d0", "t0.json"))
    assert [r["text"] for r in one.collect()] == ["only"]
    with pytest.raises(Exception, match="nowhere"):
        spark.read.format("pagetrees").load("/nowhere/at/all").collect()


#: A helper that counts a line for each ten characters, and does what a text tells it.
HELPER = '''
import json, os, sys, time
items = json.load(sys.stdin)["items"]
for x in items:
    if x["text"] == "hang": time.sleep(30)
    if x["text"] == "die": sys.exit("no browser here")
    if x["text"] == "nonsense": print("{"); sys.exit()
    if x["text"] == "list": print("[]"); sys.exit()
    if x["text"] == "shape": print('{"results": 3}'); sys.exit()
    if x["text"].startswith("once ") and not os.path.exists(x["text"][5:]):
        open(x["text"][5:], "w").close(); sys.exit("the first time")
print(json.dumps({"results": [{"id": x["id"], "measured_line_count": -(-len(x["text"]) // 10), "measured_height_pt": x["line_height_pt"] * -(-len(x["text"]) // 10)} for x in items if x["text"] != "skip"] + ["odd", {"id": " "}]}))
'''


@pytest.fixture()
def helper(tmp_path):
    path = tmp_path / "measure.py"
    path.write_text(HELPER)
    return str(path)


def request(name, text, line=20.0):
    return {"request_id": name, "text": text, "font_family_css": None, "font_size_px": 16.0, "line_height_px": line, "max_width_px": 100.0, "letter_spacing_em": None}


def test_answers_of_helpers(helper):
    assert helpers.ask([request("a:1.000", "x" * 25), request("b:0.960", "skip")], helper) == {"a:1.000": (3, 60.0)}
    assert helpers.ask([], "/nowhere") == {}
    assert helpers.answers('{"a:1": {"line_count": 2, "height_px": 28.5}, "b:1": 7, "c:1": {"line_count": "x"}}') == {"a:1": (2, 28.5), "c:1": (1, 0.0)}


@pytest.mark.parametrize(("text", "error"), [("hang", helpers.HelperTimeout), ("die", helpers.HelperFailed), ("nonsense", helpers.BadAnswer), ("list", helpers.BadAnswer), ("shape", helpers.BadAnswer)])
def test_errors_of_helpers(helper, text, error):
    with pytest.raises(error):
        helpers.ask([request("a:1", text)], helper, timeout=1.5)


def test_missing_helpers(tmp_path, monkeypatch):
    with pytest.raises(helpers.HelperMissing, match="missing"):
        helpers.ask([request("a:1", "x")], str(tmp_path / "missing.py"))
    script = tmp_path / "measure.mjs"
    script.write_text("export {};")
    monkeypatch.setenv("PATH", str(tmp_path))
    with pytest.raises(helpers.HelperMissing, match="node"):
        helpers.ask([request("a:1", "x")], str(script))


KIND = "request_id string, text string, font_family_css string, font_size_px double, line_height_px double, max_width_px double, letter_spacing_em double, more int"


def test_measuring_in_tasks(spark, helper, tmp_path):
    flag = str(tmp_path / "flag")
    rows = [(*request(f"r{k}:1", "y" * k).values(), 1) for k in range(1, 30)] + [(*request("again:1", f"once {flag}").values(), 1), (*request(" ", "blank").values(), 1)]
    d = spark.createDataFrame(rows, KIND).repartition(3)
    got = {r["request_id"]: (r["line_count"], r["height_px"]) for r in helpers.measuring(helper, batch=4)(d).collect()}
    assert {f"r{k}:1": (-(-k // 10), -(-k // 10) * 20.0) for k in range(1, 30)}.items() <= got.items() and len(got) == 30 and os.path.exists(flag)
    with pytest.raises(Exception, match="HelperFailed"):
        helpers.measuring(helper)(spark.createDataFrame([(*request("d:1", "die").values(), 1)], KIND)).collect()


BLOCK = "doc_id long, page int, block_id string, ord int, label string, text string, rect struct<x0: double, y0: double, x1: double, y1: double>, font_size double, font_name string, lines int, line_height double, spacing double, toc_page string"


def blocks(spark, *texts):
    return spark.createDataFrame([(1, 1, f"b{k:04d}", k, "paragraph", t, (0.0, 50.0 * k, 200.0, 50.0 * k + 40), 12.0, "", 1, 14.4, None, "") for k, t in enumerate(texts, 1)], BLOCK)


def test_plan_with_measurements(spark, helper):
    b = blocks(spark, "ten chars!", "z" * 25, "w" * 95)
    got = {r["block_id"]: r for r in layout.page_plan(b, measure=helpers.measuring(helper)).collect()}
    assert [got[f"b{k:04d}"]["lines"] for k in (1, 2, 3)] == [1, 3, 10]
    first = got["b0001"]
    assert (first["scale"], first["height"], first["fallback"]) == (1.0, 14.4, "none") and got["b0003"]["fallback"] == "planner_overflow"
    with pytest.raises(Exception, match="no measurement for request"):
        layout.page_plan(blocks(spark, "skip"), measure=helpers.measuring(helper)).collect()


def test_estimator_is_an_argument(spark):
    b = blocks(spark, "any text at all")
    one = lambda font, letter, n, w: F.lit(1)
    many = lambda font, letter, n, w: F.lit(9)
    assert [layout.page_plan(b, estimate=f).first()["fallback"] for f in (one, many)] == ["none", "planner_overflow"]
    assert {c["lines"] for r in layout.with_candidates(b, many).collect() for c in r["candidates"]} == {9}


def test_enough_is_the_start_of_all(spark):
    b = blocks(spark, "short", "long text " * 12)
    for r in layout.with_candidates(b).withColumn("one", layout.cheapest_of(layout._sized(b))).collect():
        assert r["candidates"][0] == r["one"]


def test_first_scale_that_fits(spark):
    b = blocks(spark, "ok", "words " * 30, "more words " * 400)
    got = [(r["scale"], r["fits"]) for r in layout.drawn_scale(b).orderBy("block_id").collect()]
    assert got[0] == (0.88, True) and got[1][0] in (0.76, 0.62) and got[2] == (0.0, True)
    never = layout.drawn_scale(b, F.array(F.lit(1.0), F.lit(0.9))).orderBy("block_id").collect()
    assert [(r["scale"], r["fits"]) for r in never] == [(1.0, True), (0.9, False), (0.9, False)]
