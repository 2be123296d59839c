"""Facts about splitting, de-duplication, layout, quotas, jobs, translation and sources."""

import datetime as dt
import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from pageloom import __main__ as cli
from pageloom import settings
from pageloom.operators import dedup, jobs, layout, quota, split, translate
from pageloom.plans import reports, store
from pageloom.sources import documents as src
from pageloom.sources import parsers

UNIT = "doc_id int, ord int, path array<int>, page int, label string, box struct<left:double,bottom:double,right:double,top:double>, text string, font_size double, font_name string, toc_page string, lines int, line_height double, spacing double"


def unit(text, label="paragraph", box=(0.0, 0.0, 100.0, 40.0), font=10.0, page=""):
    return (1, 0, [], 1, label, box, text, font, "", page, 1, 12.0, None)


def units(spark, *rows):
    return spark.createDataFrame(list(rows), UNIT)


def said(df):
    return [(r["label"], r["text"], r["toc_page"]) for r in df.orderBy("unit_id").collect()]


@pytest.mark.parametrize(
    ("text", "parts"),
    [
        ("8.3 Speed of Sound 573 8.3.1 Comments 581", ["8.3 Speed of Sound 573", "8.3.1 Comments 581"]),
        ("one\n\n two ", ["one", "two"]),
        ("intro • a • b", ["intro", "• a", "• b"]),
        ("1. x 2) y", ["1. x", "2) y"]),
        ("plain", ["plain"]),
        ("lost 1.1 a 1.2 b", ["1.1 a", "1.2 b"]),
    ],
)
def test_list_parts(spark, text, parts):
    assert spark.range(1).select(split.list_parts(F.lit(text))).first()[0] == parts


def test_split_chain(spark):
    two = said(split.split_units(units(spark, unit("1.1 Scope 15 1.2 Terms 18", "list item"))))
    assert two == [("list item", "1.1 Scope", "15"), ("list item", "1.2 Terms", "18")]
    assert said(split.split_units(units(spark, unit("PART 2", "list item")))) == [("paragraph", "PART 2", "")]
    assert said(split.split_units(units(spark, unit("9.1 Introduction 346")))) == [("list item", "9.1 Introduction", "346")]
    assert said(split.split_units(units(spark, unit("Chapter 3 Flow over bodies of revolution and so on and so forth", "heading")))) == [("heading", "Chapter 3", ""), ("heading", "Flow over bodies of revolution and so on and so forth", "")]
    assert said(split.split_units(units(spark, unit("First.....1 Second ..... 22 tail")))) == [("paragraph", "First", "1"), ("paragraph", "Second", "22")]


def test_explicit_lines(spark):
    assert said(split.split_units(units(spark, unit("one part\n\nother part", font=None)))) == [("paragraph", "one part", ""), ("paragraph", "other part", "")]
    long = "x" * 60 + "\n" + "y" * 60
    assert len(said(split.split_units(units(spark, unit(long))))) == 1


def test_subdivision_keeps_the_height(spark):
    got = split.split_units(units(spark, unit("a\nb\nc", "list item", (0.0, 10.0, 50.0, 100.0)))).orderBy("unit_id").collect()
    assert [r["box"]["top"] for r in got] == [100.0, pytest.approx(70.0), pytest.approx(40.0)]
    assert got[-1]["box"]["bottom"] == 10.0


def plain_dedup(rows):
    """The greedy rule on (left, bottom, right, top) rows of one group."""

    def area(b):
        return (b[2] - b[0]) * (b[3] - b[1])

    def same(a, b):
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        common = w * h if w > 0 and h > 0 else 0
        small, large = sorted((area(a), area(b)))
        return small / large >= 0.8 and (common / (small + large - common) >= 0.85 or common / small >= 0.9)

    kept = []
    for r in rows:
        hits, c = [], r
        for i, k in enumerate(kept):
            if same(c, k):
                hits.append(i)
                c = c if area(c) > area(k) else k
        if hits:
            kept[hits[0]] = c
            kept = [k for i, k in enumerate(kept) if i not in hits[1:]]
        else:
            kept.append(r)
    return kept


def test_greedy_dedup(spark):
    rng = random.Random(3)
    groups = {p: [(float(a), float(b), a + 40.0 + rng.randint(0, 3) * 2, b + 40.0 + rng.randint(0, 3) * 2) for a, b in ((rng.randint(0, 4), rng.randint(0, 4)) for _ in range(14))] for p in range(6)}
    df = spark.createDataFrame([(1, p, "x", k, b, "") for p, bs in groups.items() for k, b in enumerate(bs)], "doc_id int, page int, label string, ord int, box struct<left:double,bottom:double,right:double,top:double>, text string")
    got = {}
    for r in dedup.deduplicated(df).orderBy("page", "ord").collect():
        got.setdefault(r["page"], []).append(tuple(r["box"]))
    assert got == {p: plain_dedup(bs) for p, bs in groups.items()}


BLOCK = "doc_id bigint, page int, block_id string, rect struct<x0:double,y0:double,x1:double,y1:double>, text string, label string, font_size double, font_name string, lines int, line_height double, spacing double, toc_page string"


def block(k, rect, text="word", label="paragraph", toc="", font=10.0):
    return (1, 1, f"b{k:04d}", rect, text, label, font, "", 1, 12.0, None, toc)


def blocks(spark, *rows):
    return spark.createDataFrame(list(rows), BLOCK)


def test_columns(spark):
    b = blocks(spark, block(1, (0.0, 0.0, 100.0, 20.0)), block(2, (200.0, 0.0, 300.0, 20.0)), block(3, (4.0, 50.0, 100.0, 70.0)))
    assert {r["block_id"]: r["column"] for r in layout.column_clusters(b).collect()} == {"b0001": 1, "b0003": 1, "b0002": 2}


def test_overlap_gives_negative_spacing(spark):
    b = blocks(spark, block(1, (0.0, 0.0, 100.0, 30.0)), block(2, (0.0, 24.0, 100.0, 54.0)))
    got = {r["block_id"]: (r["penalty"], r["adjusted"]) for r in layout.overlap_spacing(b).collect()}
    assert got == {"b0001": (None, None), "b0002": (-0.082, -0.082)}


def test_candidates_are_sorted_and_distinct(spark):
    c = layout.typography_candidates(blocks(spark, block(1, (0.0, 0.0, 100.0, 30.0), font=12.0))).orderBy("rank").collect()
    keys = [(r["font"], r["line"], r["letter"]) for r in c]
    assert len(set(keys)) == len(keys) and [r["cost"] for r in c] == sorted(r["cost"] for r in c)
    assert c[0]["reason"] == "none" and c[0]["cost"] == 0 and c[0]["scale"] == 1.0


def test_plan_pushes_down_only_its_own_column(spark):
    b = blocks(spark, block(1, (0.0, 0.0, 100.0, 30.0), "x" * 80), block(2, (0.0, 31.0, 100.0, 60.0)), block(3, (300.0, 31.0, 400.0, 60.0)), block(4, (0.0, 100.0, 100.0, 300.0)), block(5, (300.0, 70.0, 400.0, 80.0), toc="4"))
    p = {r["block_id"]: r for r in layout.page_plan(b).collect()}
    assert p["b0001"]["plan_y1"] > 30.0 and p["b0002"]["plan_y0"] >= p["b0001"]["actual_y1"] + 1
    assert p["b0003"]["shift"] == 0 and p["b0005"]["fallback"] == "toc_passthrough"


def test_validator_is_asked_in_order_of_cost(spark):
    def small_only(b, x0, y0, x1, y1, c):
        return c["scale"] < 0.95, y0, y1, 1.0

    b = blocks(spark, block(1, (0.0, 0.0, 100.0, 90.0)))
    r = layout.page_plan(b, small_only).first()
    assert r["scale"] == 0.92 and "font_scale" in r["reason"]


def test_fold_equals_trials_that_all_fit(spark):
    rng = random.Random(6)
    rows = [block(k, (x := rng.choice([0.0, 150.0, 320.0]), y := k * 14.0 + rng.random() * 9, x + rng.choice([60.0, 120.0]), y + rng.choice([8.0, 20.0, 30.0])), "word " * rng.randint(1, 40), rng.choice(["paragraph", "heading", "figure"]), rng.choice(["", "", "7"]), rng.choice([9.0, 12.0, 18.0])) for k in range(1, 40)]
    b = blocks(spark, *rows)
    plain = {r["block_id"]: r.asDict() for r in layout.page_plan(b).collect()}
    asked = {r["block_id"]: r.asDict() for r in layout.page_plan(b, layout.remembered(lambda b, x0, y0, x1, y1, c: (True, y0, y1, 1.0))).collect()}
    assert set(plain) == set(asked) and len(plain) == 39
    for k, r in plain.items():
        assert {c: v if not isinstance(v, float) else round(v, 6) for c, v in r.items()} == {c: v if not isinstance(v, float) else round(v, 6) for c, v in asked[k].items()}


def test_large_type_is_planned_where_it_is_drawn(spark):
    r = layout.page_plan(blocks(spark, block(1, (0.0, 50.0, 100.0, 80.0), font=20.0), block(2, (0.0, 200.0, 100.0, 400.0)))).filter("block_id = 'b0001'").first()
    assert r["plan_y0"] == pytest.approx(50.0 - 18.0 * 0.3)
    p = layout.legacy_plan(blocks(spark, block(1, (0.0, 50.0, 100.0, 80.0), font=20.0))).first()
    assert p["planned"]["y1"] == pytest.approx(98.0) and p["shift"] == 0.0


def test_drawn_into_what_stands_above(spark):
    def rises(b, x0, y0, x1, y1, c):
        return True, y0 - (8.0 if b["block_id"] == "b0002" and y0 < 45 else 0.0), y1, 1.0

    b = blocks(spark, block(1, (0.0, 0.0, 100.0, 30.0)), block(2, (0.0, 31.0, 100.0, 60.0)), block(3, (0.0, 100.0, 100.0, 300.0)))
    got = {r["block_id"]: r for r in layout.page_plan(b, rises).collect()}
    assert got["b0002"]["fallback"] == "postpass_shift" and got["b0002"]["overlap"] == 0.0
    always = {r["block_id"]: r for r in layout.page_plan(b, lambda b, x0, y0, x1, y1, c: (b["block_id"] != "b0002" or y0 < 35, y0 - (8.0 if b["block_id"] == "b0002" else 0.0), y1, 1.0)).collect()}
    assert always["b0002"]["fallback"] == "postpass_overlap_overflow" and always["b0002"]["actual_y0"] is None and always["b0002"]["overlap"] > 0
    none = layout.page_plan(b, lambda b, x0, y0, x1, y1, c: (False, y0, y1, 1.0)).filter("block_id = 'b0001'").first()
    assert none["fallback"] == "pymupdf_probe_overflow" and none["used"] == 0.0


def test_reason_needs_more_than_rounding(spark):
    c = F.struct(F.lit(0.9995).alias("scale"), F.lit(11.99).alias("line"), F.lit(0.004).alias("letter"))
    d = F.struct(F.lit(0.9).alias("scale"), F.lit(10.0).alias("line"), F.lit(-0.05).alias("letter"))
    none = F.lit(None).cast("double")
    assert list(spark.range(1).select(layout.reason(c, F.lit(12.0), none), layout.reason(d, F.lit(12.0), none)).first()) == ["none", "font_scale+line_height+letter_spacing"]


def test_pages_of_more_than_9999_blocks(spark):
    d = spark.range(12_000).select(F.lit(1).alias("doc_id"), F.lit(1).alias("page"), F.struct(F.lit(0.0).alias("left"), (12_000.0 - F.col("id")).alias("top")).alias("box"), F.col("id").alias("ord"))
    got = layout.reading_order(d).filter("ord in (0, 9998, 10500)").orderBy("ord").collect()
    assert [r["block_id"] for r in got] == ["b0001", "b9999", "b10501"] and spark.range(1).select(layout.number(F.lit("b10501"))).first()[0] == 10501


def test_missing_measurement_is_an_error(spark):
    asked = spark.createDataFrame([("a",), ("b",)], "request_id string")
    there = spark.createDataFrame([("a", 3.0, 1), ("b", 4.0, 2)], "request_id string, height_pt double, line_count int")
    assert {r["request_id"]: r["height"] for r in layout.measured(asked, there).collect()} == {"a": 3.0, "b": 4.0}
    with pytest.raises(Exception, match="no measurement for request b"):
        layout.measured(asked, there.filter("request_id = 'a'")).collect()


def test_equal_trials_are_asked_once():
    asked = []
    v = layout.remembered(lambda *a: asked.append(a) or (True, 0.0, 1.0, 1.0))
    c = {"scale": 1.0, "font": 9.0, "line": 12.0, "letter": None, "lines": 1}
    assert v({"text": "x"}, 0, 0.0, 1, 1, c) == v({"text": "x"}, 0, 0.00001, 1, 1, c) and len(asked) == 1
    assert v({"text": "y"}, 0, 0.0, 1, 1, c) and len(asked) == 2


def test_text_boxes(spark):
    w = spark.createDataFrame([(1, "word", "a", 1.0, 2.0, 3.0, 4.0), (1, "word", " ", 0.0, 0.0, 9.0, 9.0), (1, "block", "a", 0.0, 0.0, 9.0, 9.0), (2, "block", "b", 5.0, 5.0, 6.0, 6.0), (3, "word", "", 5.0, 5.0, 6.0, 6.0)], "page int, kind string, text string, x0 double, y0 double, x1 double, y1 double")
    assert {r["page"]: tuple(r)[1:] for r in layout.text_box(w, "page").collect()} == {1: (1.0, 2.0, 3.0, 4.0), 2: (5.0, 5.0, 6.0, 6.0), 3: (None,) * 4}


def test_feedback_shift(spark):
    p = spark.createDataFrame([(1, 1, 1, "b1", 0.0, 20.0, 0.0, 28.0, 14.0), (1, 1, 1, "b2", 22.0, 42.0, None, None, 14.0), (1, 1, 2, "b3", 22.0, 42.0, None, None, 14.0)], "doc_id int, page int, column int, block_id string, plan_y0 double, plan_y1 double, actual_y0 double, actual_y1 double, line double")
    got = {r["block_id"]: (r["y0"], r["y1"]) for r in layout.shifted_plan(p).collect()}
    assert got == {"b1": (0.0, 20.0), "b2": (pytest.approx(29.68), pytest.approx(49.68)), "b3": (22.0, 42.0)}


@pytest.mark.parametrize(("font", "scales"), [(12.0, [0.88, 0.76, 0.62, 0.0]), (10.394, [0.92, 0.82, 0.68, 0.0]), (18.5, [1.0, 0.92, 0.82, 0.68, 0.0])])
def test_ladders(spark, font, scales):
    assert spark.range(1).select(layout.scale_ladder(F.lit(font))).first()[0] == scales


def test_drawing_is_gated(spark):
    d = spark.createDataFrame([("none",), ("postpass_overlap_overflow",), (None,)], "f string")
    assert [r[0] for r in d.select(layout.allowed(F.col("f"))).collect()] == [True, False, False]


def test_added_words(spark):
    kind = "x0 double, y0 double, x1 double, y1 double, word string"
    before = spark.createDataFrame([(0.0, 0.0, 1.0, 1.0, "a")], kind)
    after = spark.createDataFrame([(0.0, 0.0, 1.0, 1.0, "a"), (0.0, 0.0, 1.0, 1.0, "a"), (2.0, 3.0, 4.0, 5.0, "b")], kind)
    assert list(layout.added_words(before, after).first()) == [0.0, 0.0, 4.0, 5.0]
    assert list(layout.added_words(after, after).first()) == [None] * 4


def at(day, hour, minute):
    return dt.datetime(2026, 4, day, hour, minute)


def test_leases():
    def run(*events, **k):
        return [(r["result"], r["used"]) for r in quota.replay_client([{"ts": t, "lease": x, "action": a} for t, x, a in events], **k)]

    s = dt.timedelta(seconds=1)
    a = at(4, 1, 0)
    assert run((a, "x", "start"), (a + 200 * s, "x", "end"), (a + 300 * s, "y", "start"), (a + 600 * s, "y", "end"), (a + 700 * s, "z", "start")) == [("granted", 0.0), ("ended", 200.0), ("granted", 200.0), ("expired", 500.0), ("refused", 500.0)]
    late = at(4, 14, 59)  # 23:59 in Seoul
    assert run((late, "x", "start"), (late + 120 * s, "x", "end")) == [("granted", 0.0), ("ended", 60.0)]
    assert run((late, "x", "start"), (late + 60 * s, "y", "start")) == [("granted", 0.0), ("granted", 0.0)]


def test_lease_over_two_midnights_and_checks():
    def run(*events, **k):
        return [(r["result"], r["used"]) for r in quota.replay_client([{"ts": t, "lease": x, "action": a} for t, x, a in events], **k)]

    s, late = dt.timedelta(seconds=1), at(4, 14, 59)
    two_days = late + dt.timedelta(days=1, seconds=120)
    # All that came after the first midnight is today's.
    assert run((late, "x", "start"), (two_days, "x", "check")) == [("granted", 0.0), ("expired", 500.0)]
    assert run((late, "x", "start"), (late + 90 * s, "x", "check"), (late + 100 * s, "x", "end")) == [("granted", 0.0), ("running", 0.0), ("ended", 40.0)]
    assert run((late, "x", "start"), (late, "y", "start"), (late + 10 * s, "z", "end")) == [("granted", 0.0), ("refused", 0.0), ("ignored", 0.0)]
    # Two leases of different days are open; the older one finds nothing left of today.
    assert run((late, "x", "start"), (late + 60 * s, "y", "start"), (late + 70 * s, "x", "check")) == [("granted", 0.0), ("granted", 0.0), ("expired", 0.0)]


def test_usage_by_client_and_day(spark):
    d = spark.createDataFrame([("a", at(4, 14, 50), 120.0), ("b", at(4, 14, 50), 80.0), ("a", at(4, 15, 10), 5.0), ("a", at(4, 14, 0), 900.0)], "client string, ts timestamp, seconds double")
    got = {(r["client"], str(r["day"])): r["used"] for r in quota.daily_usage(d).collect()}
    assert got == {("a", "2026-04-04"): 500.0, ("b", "2026-04-04"): 80.0, ("a", "2026-04-05"): 5.0}
    cut = quota.by_day(spark.createDataFrame([("a", at(4, 14, 59), 120.0)], "client string, start timestamp, seconds double"))
    assert {str(r["day"]): r["seconds"] for r in cut.collect()} == {"2026-04-04": 60.0, "2026-04-05": 60.0}


def test_admission():
    assert [v for v, _ in jobs.admit([(0, 10), (0, 10), (1, 10), (1, 10), (2, 1)], 2, 2)] == ["running", "running", "waiting", "waiting", "busy"]
    assert jobs.admit([(0, 5), (0, 9), (1, 4), (6, 1)], 2, 8)[2:] == [("waiting", 5), ("waiting", 9)]


def test_status_and_limits(spark):
    e = spark.createDataFrame([("j", at(1, 0, 0), "queued", 0.0), ("j", at(1, 0, 1), "parsing", 1.5), ("k", at(1, 0, 0), "succeeded", 0.4)], "job_id string, ts timestamp, status string, progress double")
    got = {r["job_id"]: (r["status"], r["progress"], r["done"]) for r in jobs.latest_status(e).collect()}
    assert got == {"j": ("parsing", 1.0, False), "k": ("succeeded", 1.0, True)}
    modes = spark.createDataFrame([("all",), ("first20",), ("first",), ("odd",)], "m string")
    assert [r[0] for r in modes.select(jobs.page_limit(F.col("m"))).collect()] == [None, 20, 1, 1]


def test_postprocess(spark):
    gl = spark.createDataFrame([(1, "Summary", "Kurzfassung")], "ord int, src string, dst string")
    u = spark.createDataFrame([("Summary", "Summary", ""), ("Chapter 4", "x", ""), ("PART", "x", "7"), ("A text", "a publication", ""), ("A text", "ein Text", "")], "text string, translated string, toc_page string")
    got = [r["final"] for r in translate.postprocessed(u, gl, "de").collect()]
    assert got == ["Kurzfassung", "Kapitel 4", "Teil 7", "A text", "ein Text"]


def test_translators(spark):
    with pytest.raises(ValueError, match="unknown"):
        translate.translator("nothing")
    with pytest.raises(ValueError, match="key"):
        translate.translator("openrouter")
    d = spark.createDataFrame([("a",), ("a",), (None,)], "text string")
    assert sorted(str(r["translated"]) for r in translate.translated(d, "identity", "de").collect()) == ["None", "a", "a"]


def test_remote_translator():
    said, waits = [], []

    def service(*answers):
        left = list(answers)
        return lambda url, headers, body: said.append(json.loads(body)) or left.pop(0)

    good = json.dumps({"choices": [{"message": {"content": " Hallo "}}]})
    f = translate.remote(service((429, "{}"), (503, "busy"), (200, good)), "k", "u", sleep=waits.append)
    assert f(["Hello", "  "], "German", "m") == ["Hallo", "  "] and waits == [1.0, 2.0]
    assert said[0]["temperature"] == 0 and "German" in said[0]["messages"][0]["content"]
    with pytest.raises(translate.RemoteError, match="HTTP 401 after 1 attempts: no key"):
        translate.remote(service((401, '{"error": {"message": "no key"}}')), "k", "u")(["x"], "de", "m")
    with pytest.raises(translate.RemoteError, match="HTTP 500 after 3 attempts: oops"):
        translate.remote(service(*[(500, "oops")] * 3), "k", "u", sleep=waits.append)(["x"], "de", "m")
    for bad in ("{", "{}", '{"choices": []}', json.dumps({"choices": [{"message": {"content": " "}}]})):
        with pytest.raises(translate.RemoteError):
            translate.answer(bad)


def test_fallbacks(spark):
    u = spark.createDataFrame([("Comments  and Comment", "Comments and Comment", ""), ("Introduction and Road Map", "검색사이트 x", ""), ("Plain", "Plain\n\t", "")], "text string, translated string, toc_page string")
    got = [r["final"] for r in translate.postprocessed(u, translate.phrases(spark), "ko").collect()]
    assert got == ["논평 and 논평", "소개 및 로드맵", "Plain"]


def test_parsers(spark, tmp_path):
    f = spark.createDataFrame([("a.json", bytearray(b'{"pages": []}')), ("b.json", bytearray(b"{"))], "path string, content binary")
    p = parsers.parsed(f, "json")
    assert {r["path"]: (r["tree"], r["error"] is None) for r in p.collect()} == {"a.json": ('{"pages": []}', True), "b.json": (None, False)}
    with pytest.raises(Exception, match="could not parse b.json"):
        parsers.required(p).collect()
    good = parsers.split_off(p, "error is not null", str(tmp_path / "dead"))
    assert [r["path"] for r in good.collect()] == ["a.json"] and spark.read.parquet(str(tmp_path / "dead")).count() == 1

    def needs(path, content):
        raise ModuleNotFoundError("x", name="pdflib")

    with pytest.raises(Exception, match="parsing needs pdflib"):
        parsers.parsed(f, needs).collect()


def test_settings(spark):
    assert settings.version("v3.10.2-rc1") == (3, 10, 2) and settings.settings({})["target_language"] == "Simplified Chinese"
    spark.conf.set("pageloom.workspace_retention_hours", "-3")
    assert settings.of_session(spark)["retention_h"] == 0.0
    spark.conf.unset("pageloom.workspace_retention_hours")
    with pytest.raises(ValueError):
        settings.settings({"PAGELOOM_BASE_FONT_SIZE": "large"})


def test_sweep_and_progress(spark, tmp_path):
    for name in ("old", "new", "public", "public/old", "public/new"):
        (tmp_path / name).mkdir(exist_ok=True)
        (tmp_path / name / "f").write_text("x")
    for p in (tmp_path / "old", tmp_path / "old" / "f"):
        os.utime(p, (1_000, 1_000))
    now = time.time()
    assert jobs.sweep(spark, str(tmp_path), now, 0) == [] and jobs.sweep(spark, str(tmp_path), now, 3600) == ["old"]
    assert not (tmp_path / "old").exists() and not (tmp_path / "public" / "old").exists() and (tmp_path / "public" / "new").exists()
    told = []
    p = jobs.Progress(lambda v, text: told.append((v, text)))
    for v in (0.2, 0.1, 7):
        p(v, "x")
    assert told == [(0.2, "x"), (0.2, "x"), (1.0, "x")]


def test_store(spark, tmp_path):
    st = store.UsageStore(spark, str(tmp_path / "s"))
    st.commit(spark.createDataFrame([("a", at(4, 14, 0), 300.0), ("a", at(4, 14, 30), 900.0), ("b", at(4, 14, 0), 20.0), ("b", at(4, 14, 1), -5.0)], "client string, ts timestamp, seconds double"))
    kind = "lease string, client string, day date, reserved double, at timestamp, open boolean"
    day = dt.date(2026, 4, 4)
    st.note(spark.createDataFrame([("x", "b", day, 480.0, at(4, 14, 0), True), ("y", "b", day, 30.0, at(4, 14, 0), True), ("x", "b", day, 480.0, at(4, 14, 0), False)], kind))
    st = store.UsageStore(spark, str(tmp_path / "s"))  # opened again
    assert {r["client"]: (r["used"], r["reserved"], r["remaining"]) for r in st.snapshot().collect()} == {"a": (500.0, 0.0, 0.0), "b": (20.0, 30.0, 450.0)}


def test_command_line(spark, tmp_path, capsys):
    tree = {"pages": [{"page": 1, "bbox": [10, 700, 300, 720], "type": "paragraph", "content": "Hello there", "font size": 10}, {"page": 2, "bbox": [10, 600, 300, 640], "type": "list item", "content": "1. one 2. two", "font size": 10}]}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "doc.json").write_text(json.dumps(tree))
    for engine in ("pretext", "legacy"):
        out = str(tmp_path / engine)
        assert cli.main(["translate", str(tmp_path / "in"), "--output", out, "--engine", engine]) == 0
        assert spark.read.text(f"{out}/markdown").first()["value"] == "## Page 1"
        assert [r["content"] for r in spark.read.json(f"{out}/structured").selectExpr("explode(pages) p").selectExpr("explode(p.elements) e").select("e.content").collect()] == ["Hello there", "1. one", "2. two"]
        assert spark.read.json(f"{out}/report").count() == (1 if engine == "pretext" else 3)
    assert cli.main(["translate", "x.pdf", "--output", "y"]) == 2
    assert cli.main(["queries"]) == 0 and "page_assembly" in capsys.readouterr().out


def test_model_assets(spark):
    rows = [("a", 120, bytearray(b"version https://git-lfs.github.com/spec/v1\noid x")), ("b", 5, bytearray(b"tiny")), ("c", 2 << 20, bytearray(b"weights"))]
    got = src.model_assets(spark.createDataFrame(rows, "path string, length long, content binary"))
    assert {r["path"]: r["state"] for r in got.collect()} == {"a": "pointer", "b": "too_small", "c": "ready"}


def test_units_that_go_round_the_splitters(spark):
    rng = random.Random(5)
    bits = ["word", "1.1", "2)", "•", "\n", "....", "·····", "12", "xiv", "Chapter 3", "PART", ".", " "]
    rows = [(1, k, [], 1, rng.choice(["list item", "paragraph", "heading", "figure"]), (0.0, 0.0, 100.0, 40.0), " ".join(rng.choice(bits) for _ in range(rng.randint(1, 6))), 10.0, "", rng.choice(["", "", "4"]), 1, 12.0, None) for k in range(300)]
    u = units(spark, *rows)
    whole = u
    for step in (split.split_lists, split.split_toc, split.normalise_special, split.split_explicit_lines, split.renumbered):
        whole = step(whole)
    keep = lambda d: sorted(tuple(map(str, (r["unit_id"], r["ord"], r["label"], r["text"], r["toc_page"], r["box"], r["lines"]))) for r in d.collect())
    assert keep(split.split_units(u)) == keep(whole) and u.filter(~split.may_split(u)).count() > 20


def test_queue_counters(spark):
    d = spark.createDataFrame([("s", 0.0, 10.0, "running", 0.0), ("s", 0.0, 4.0, "running", 0.0), ("s", 1.0, 3.0, "waiting", 4.0), ("s", 2.0, 1.0, "busy", None)], "surface string, arrival_s double, takes_s double, verdict string, start_s double")
    assert [tuple(jobs.queue_counters(d, F.lit(t)).first()) for t in (2.0, 5.0, 20.0)] == [("s", 2, 1, 2, 8), ("s", 2, 0, 2, 8), ("s", 0, 0, 2, 8)]


def test_logs(spark, tmp_path):
    d = spark.createDataFrame([(at(1, 0, 0), "phase=parse:done pages=3")], "ts timestamp, message string")
    reports.append_log(d, str(tmp_path / "log"))
    r = src.run_log(spark, str(tmp_path / "log")).first()
    assert r["fields"] == {"phase": "parse:done", "pages": "3"} and r["ts"] == at(1, 0, 0)
    m = spark.createDataFrame([(1, "## Page 1")], "doc_id long, markdown string")
    reports.write_markdown(m, str(tmp_path / "md"))
    assert spark.read.text(str(tmp_path / "md")).first()["value"] == "## Page 1"


def test_walk_order_and_aliases(spark):
    tree = {"pages": [{"page": 1, "bbox": [0, 20, 100, 0], "type": "Paragraph", "content": " hello ", "kids": [{"page number": 2, "bounding box": [1, 2, 3, 4], "content": "x", "font size": 9}]}, {"page": 1, "bbox": [0, 0, 1], "content": "no box"}, {"page": None, "page number": None, "bbox": [0, 0, 1, 1], "content": "no page"}, {"page": 1, "bbox": [0, 0, 1, 1], "type": "caption", "content": ""}]}
    d = spark.createDataFrame([(7, json.dumps(tree)), (8, None), (9, "{")], "doc_id int, tree string")
    got = [(r["doc_id"], r["page"], r["label"], r["text"], r["font_size"]) for r in src.units(d).orderBy("doc_id", "ord").collect()]
    assert got == [(7, 1, "Paragraph", "hello", None), (7, 2, "text", "x", 9.0)]
    b = src.boxes(d).orderBy("ord").collect()
    assert [(r["label"], r["text"]) for r in b] == [("paragraph", " hello "), ("caption", "")] and b[0]["box"]["bottom"] == 0.0


def test_reports_round_trip(spark, tmp_path):
    u = units(spark, unit("Hello"), unit("World")).withColumn("ord", F.when(F.col("text") == "Hello", 0).otherwise(1)).withColumn("unit_id", F.lit("u00001")).withColumn("translated", F.lit(""))
    d = reports.structured_documents(u, job_id="j", provider="identity")
    reports.write_json(d, str(tmp_path / "s"))
    assert [r["content"] for r in src.structured(spark, str(tmp_path / "s")).orderBy("pos").collect()] == ["Hello", "World"]
    assert reports.markdown(u).first()["markdown"].startswith("## Page 1\n\nHello")


def test_files(spark, tmp_path):
    (tmp_path / "b.PDF").write_bytes(b"%PDF-")
    (tmp_path / "a.txt").write_bytes(b"x")
    f = src.binary_files(spark, str(tmp_path), "*")
    assert {r["path"].rsplit("/")[-1]: r["verdict"] for r in src.uploads(f, most=3).collect()} == {"b.PDF": "too_large", "a.txt": "not_pdf"}
    assert src.first_matching(f, (".pdf",)).first()["path"].endswith("b.PDF")


def test_vertical_subdivision_takes_every_document(spark, tmp_path):
    texts = {1: "a\nb\nc", 2: "alone", 3: "\n".join("x" * 7), 4: "p\nq"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    from pageloom import catalog

    got = {(r["doc_id"], r["pos"]): (r["text"], r["top"], r["bottom"]) for r in catalog.QUERIES["vertical_subdivision"](spark, str(tmp_path)).collect()}
    want = {}
    for k, t in texts.items():
        ls = t.split("\n")
        for i, x in enumerate(ls):
            want[k, i] = (x, round(700 - 640 * i / len(ls), 6), round(700 - 640 * (i + 1) / len(ls), 6))
    assert got == want


def test_walks_and_slugs_take_whole_texts(spark, tmp_path):
    from pageloom import catalog

    long = "Word " * 40 + "End"
    spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", " " * 80 + "late")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(1, long, "web")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [r["text"] for r in catalog.QUERIES["json_walk_units"](spark, str(tmp_path)).orderBy("ord").collect()]
    assert got == [long, "user", "late", "assistant"]
    assert catalog.QUERIES["text_slugs"](spark, str(tmp_path)).first()["slug"] == "word-" * 40 + "end"


def test_few_scales_are_tried_and_the_outcome_is_that_of_all_candidates(spark):
    """Sizes, rooms and spacings of all kinds: the first candidate that fits and the last one are those of the whole list."""
    rng = random.Random(3)
    rows = [(rng.choice([6.0, 8.0, 11.5, 12.0, 15.9, 16.0, 20.0, 33.3]), rng.choice([0.0, 9.5, 14.4, 24.0, 80.0, 700.0]), rng.choice([None, 0.12, 0.004, -0.05, -0.22, -0.6]), rng.randrange(0, 300), rng.choice([0.0, 40.0, 120.0, 460.0]), rng.uniform(0, 90)) for _ in range(400)]
    d = spark.createDataFrame(rows, "font double, line_height double, spacing double, n int, w double, room double")
    d = d.withColumn("b", F.struct("font", "line_height", "spacing", F.greatest("line_height", F.round(F.col("font") * layout.LEAST_LINE, 3)).alias("line"), "n", "w"))
    fits = lambda c: layout.height(c) + 1.0 <= F.col("room")
    some = layout.enough_of(F.col("b"), fits).alias("some")
    got = d.select("room", some, layout.candidates_of(F.col("b")).alias("every")).collect()
    plain = lambda c: {k: v for k, v in c.asDict().items() if k != "gen"}
    kinds = {"first": 0, "later": 0, "none": 0}
    for r in got:
        ok = lambda cs: [plain(c) for c in cs if round(c["lines"] * c["line"], 3) + 1.0 <= r["room"]][:1]  # noqa: B023, E731
        assert ok(r["some"]) == ok(r["every"])
        first = ok(r["every"]) == [plain(r["every"][0])]
        assert first or plain(r["some"][-1]) == plain(r["every"][-1])
        kinds["first" if first else "later" if ok(r["every"]) else "none"] += 1
    assert min(kinds.values()) > 30
    # A block that nothing fits asks for few candidates, not for all.
    none = [r for r in got if not ok_any(r)]
    assert sum(len(r["some"]) for r in none) < sum(len(r["every"]) for r in none) / 40


def ok_any(r):
    return any(round(c["lines"] * c["line"], 3) + 1.0 <= r["room"] for c in r["every"])


def test_sizes_of_candidates_are_those_of_the_candidates(spark):
    b = blocks(spark, *[block(k, (0.0, 0.0, 100.0, 30.0), font=f) for k, f in enumerate([6.0, 11.5, 12.0, 16.0, 33.3], 1)])
    sizes = {r["block_id"]: (r["candidates"], r["largest"], r["smallest"]) for r in layout.candidate_sizes(b).collect()}
    assert sizes == {r["block_id"]: (len(r["candidates"]), max(c["font"] for c in r["candidates"]), min(c["font"] for c in r["candidates"])) for r in layout.with_candidates(b).collect()}


def test_a_page_is_shuffled_once_for_its_overlaps_and_columns(spark):
    """Neither joins anything back to the blocks, and blocks of any columns keep them."""
    b = blocks(spark, block(1, (0.0, 0.0, 100.0, 30.0)), block(2, (0.0, 24.0, 100.0, 54.0)), block(3, (300.0, 0.0, 400.0, 30.0))).withColumn("more", F.lit(7))
    out = layout.column_clusters(layout.overlap_spacing(b))
    assert sorted((r["block_id"], r["penalty"], r["column"], r["more"]) for r in out.collect()) == [("b0001", None, 1, 7), ("b0002", -0.082, 1, 7), ("b0003", None, 2, 7)]
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
