"""Queries that read the values of single functions and of operators at the edge: sources, splitters, jobs, settings.

Where a rule needs texts that the tables don't hold, the query makes them from a table's rows by a rule of construction;
the SQL then says what must come out from the parts, not by repeating the operator.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pageloom import settings as st
from pageloom.catalog import BLOCKS, LINES, blocks, documents, query, units
from pageloom.functions import geometry as g
from pageloom.functions import metrics as m
from pageloom.functions import text as t
from pageloom.operators import jobs, layout, split, translate
from pageloom.plans import bridges as b
from pageloom.plans import reports
from pageloom.sources import documents as src

_NULL = "CAST(NULL AS STRING)"


@query(
    f"""WITH {BLOCKS}, w AS (SELECT *, lag(y1) OVER (PARTITION BY doc_id, page ORDER BY nr) AS above FROM blocks)
SELECT doc_id, page, block_id, least(x1, x0) AS "left", least(-y0, -y1) AS bottom, greatest(x1, x0) AS "right", greatest(-y0, -y1) AS top, round(x0, 3) AS r0, round(y0 + font / 8, 3) AS r1, round(above - y0, 6) AS overlap FROM w"""
)
def geometry_values(spark, sf_dir):
    """Boxes of arrays with their sides swapped, moved rectangles, overlap with the block above."""
    from pyspark.sql import Window

    x = blocks(spark, sf_dir)
    r = F.col("rect")
    x = x.withColumn("above", F.lag("rect").over(Window.partitionBy("doc_id", "page").orderBy(layout.number(F.col("block_id")))))
    box = g.box_of_array(F.array(r["x1"], -r["y0"], r["x0"], -r["y1"]))
    moved = g.rounded(g.shifted(r, F.col("font_size") / 8))
    return x.select("doc_id", "page", "block_id", box.alias("b"), moved.alias("m"), F.round(g.vertical_overlap(F.col("above"), r), 6).alias("overlap")).select("doc_id", "page", "block_id", "b.*", F.get("m", 0).alias("r0"), F.get("m", 1).alias("r1"), "overlap")


@query(
    f"""WITH {BLOCKS}, s AS (SELECT *, CASE ord % 4 WHEN 0 THEN '0.04' WHEN 1 THEN 'wide' WHEN 2 THEN '' ELSE '-0.5' END AS said, CASE ord % 5 WHEN 0 THEN -1.0 WHEN 1 THEN 2.5 WHEN 2 THEN 3.5 WHEN 3 THEN 0.2 ELSE 7.0 END AS n FROM blocks),
c AS (SELECT *, try_cast(nullif(said, '') AS DOUBLE) AS given, least(greatest(coalesce(spacing, 0) + coalesce(try_cast(nullif(said, '') AS DOUBLE), 0), -0.22), 0.12) AS both_ FROM s)
SELECT doc_id, page, block_id, CAST(CASE WHEN round_even(n, 0) > 0 THEN round_even(n, 0) ELSE 1 END AS INTEGER) AS lines, given, CASE WHEN abs(both_) >= 0.005 THEN round(both_, 3) END AS combined, greatest(1.0, round(line_height * 0.12, 3)) AS gap, greatest(1.0, round(line_height * 0.08, 3)) AS safety FROM c"""
)
def metric_values(spark, sf_dir):
    """P5, P7, P8, P9."""
    k = F.col("ord")
    said = F.when(k % 4 == 0, "0.04").when(k % 4 == 1, "wide").when(k % 4 == 2, "").otherwise("-0.5")
    n = F.when(k % 5 == 0, -1.0).when(k % 5 == 1, 2.5).when(k % 5 == 2, 3.5).when(k % 5 == 3, 0.2).otherwise(7.0)
    given = m.resolved_spacing(F.nullif(said, F.lit("")))
    return blocks(spark, sf_dir).select("doc_id", "page", "block_id", m.resolved_lines(n).alias("lines"), given.alias("given"), m.combined_spacing(F.col("spacing"), F.coalesce(given, F.lit(0.0))).alias("combined"), m.gap(F.col("line_height")).alias("gap"), m.safety(F.col("line_height")).alias("safety"))


@query(
    """SELECT event_id, strftime(CAST(ts AS TIMESTAMP), '%Y%m%d-%H%M%S') || '-' || event_type || '-' || user_id || '-pdf' AS job_id,
  CASE event_id % 4 WHEN 0 THEN 'ctranslate2' WHEN 1 THEN 'openrouter' WHEN 2 THEN 'ctranslate2' ELSE 'other' END AS provider, event_id % 4 IN (0, 2) AS yes, CASE event_id % 4 WHEN 0 THEN 'pretext' ELSE 'legacy' END AS engine,
  (CASE WHEN user_id % 9 - 2 < 1 THEN 1 WHEN user_id % 9 - 2 > 5 THEN 5 ELSE user_id % 9 - 2 END) || ' / 5' AS label,
  CASE event_id % 3 WHEN 0 THEN 'Done' WHEN 1 THEN 'The job failed' ELSE '' END AS message,
  CASE event_id % 3 WHEN 0 THEN 'busy ' || event_id WHEN 1 THEN 'gone' ELSE left('plain text ' || repeat('x', 250), 200) END AS detail FROM events"""
)
def text_values(spark, sf_dir):
    """Job ids, names behind aliases, page labels, messages, error details."""
    e, k = b.table(spark, sf_dir, "events"), F.col("event_id")
    pick = lambda n, *v: F.get(F.array(*map(F.lit, v)), (k % n).cast("int"))
    page = t.clamped_page((F.col("user_id") % 9 - 2).cast("int"), F.lit(5))
    body = F.when(k % 3 == 0, F.format_string('{"error": {"message": "busy %d"}}', k)).when(k % 3 == 1, '{"message": "gone"}').otherwise("plain text " + "x" * 250)
    return e.select(
        "event_id",
        t.job_id(F.col("ts").cast("timestamp_ntz"), F.concat_ws(" ", "event_type", F.col("user_id").cast("string"), F.lit(".PDF"))).alias("job_id"),
        t.provider(pick(4, " Local", "REMOTE", "ct2 ", "Other")).alias("provider"),
        t.truth(pick(4, "Yes", "no", " on ", "")).alias("yes"),
        t.layout_engine(pick(4, " Pretext ", "LEGACY", "odd", "")).alias("engine"),
        t.page_label(page, F.lit(5)).alias("label"),
        t.message(pick(3, "succeeded", "failed", "unheard of")).alias("message"),
        t.retry_detail(body).alias("detail"),
    )


@query(
    f"""WITH {LINES}, p AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY ord) - 1 AS pos FROM units)
SELECT doc_id, page, CAST(pos AS INTEGER) AS pos, label, text AS content, l AS "left", t - h AS bottom, l + w AS "right", t AS top, font AS font_size, lines AS estimated_line_count, line_height AS line_height_pt, spacing AS letter_spacing_em, 'u' || ord AS id, text || '!' AS translated FROM p"""
)
def structured_elements(spark, sf_dir):
    """Every value of the nested documents, written as JSON and read back."""
    u = units(spark, sf_dir).withColumn("unit_id", F.concat(F.lit("u"), "ord")).withColumn("translated", F.concat("text", F.lit("!")))
    d = reports.structured_documents(u, provider="identity")
    said = d.select("doc_id", F.to_json(F.struct("pages"), {"ignoreNullFields": "false"}).alias("j"))
    back = said.select("doc_id", F.explode(F.from_json("j", f"struct<pages: {d.schema['pages'].dataType.simpleString()}>")["pages"]).alias("p"))
    e = back.select("doc_id", "p.page", F.posexplode("p.elements").alias("pos", "e"))
    sides = [F.get("e.bbox", i).alias(k) for i, k in enumerate(("left", "bottom", "right", "top"))]
    return e.select("doc_id", "page", "pos", "e.label", "e.content", *sides, "e.font_size", "e.estimated_line_count", "e.line_height_pt", "e.letter_spacing_em", "e.id", "e.translated")


@query(
    f"""WITH {BLOCKS} SELECT doc_id, count(*) AS units, count(*) FILTER (ord % 5 = 0) AS overflow, 'job ' || doc_id || ': identity, de, ' || count(*) || ' units, ' || count(*) FILTER (ord % 5 = 0) || ' overflow' AS summary FROM blocks GROUP BY doc_id"""
)
def job_summaries(spark, sf_dir):
    """K11, A6."""
    return reports.job_summaries(blocks(spark, sf_dir).withColumn("drawn", F.col("ord") % 5 != 0), "identity", "de")


@query(
    """WITH j AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS job_id, user_id FROM events)
SELECT job_id, '/files/' || job_id || '/result.md' AS markdown, CASE WHEN user_id % 2 = 0 THEN 2 ELSE 1 END AS published, CASE WHEN user_id % 2 = 0 THEN '/files/' || job_id || '/translated.pdf' END AS translated, '{"job_id":"' || job_id || '","started":null}' AS body FROM j"""
)
def job_artifacts(spark, sf_dir):
    """What is published of what exists, and a job's JSON."""
    j = b.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("job_id")).distinct()
    every = j.select(F.concat(F.lit("/files/"), "job_id", F.lit("/result.md")).alias("path"))
    some = j.filter("cast(job_id as long) % 2 = 0").select(F.concat(F.lit("/files/"), "job_id", F.lit("/translated.pdf")).alias("path"))
    a = reports.artifacts(j, "/files", every.unionByName(some))
    body = jobs.response(j.withColumn("started", F.lit(None).cast("string")))
    return a.join(body, "job_id").select("job_id", F.col("artifacts")["markdown"].alias("markdown"), F.size("artifacts").alias("published"), F.col("artifacts")["translated"].alias("translated"), "body")


@query(
    f"""WITH {BLOCKS} SELECT doc_id || ':' || page || ':' || block_id AS request_id, font AS font_size_px, CASE WHEN ord % 2 = 0 THEN line_height ELSE 20.0 END AS line_height_px, CASE WHEN ord % 2 = 0 THEN 'Noto' ELSE 'sans-serif' END AS font_family_css,
  round(CASE WHEN ord % 2 = 0 THEN line_height ELSE 20.0 END * lines, 6) AS height, lines AS line_count FROM blocks"""
)
def measurement_join(spark, sf_dir):
    """Requests from JSON with their defaults, joined to results by id."""
    x = blocks(spark, sf_dir).withColumn("id", F.concat_ws(":", "doc_id", "page", "block_id"))
    even = F.col("ord") % 2 == 0
    ask = F.struct(F.col("id").alias("request_id"), "text", F.when(even, "Noto").alias("font_family_css"), F.col("font_size").alias("font_size_px"), F.when(even, F.col("line_height")).alias("line_height_px"))
    raw = x.groupBy("doc_id").agg(F.to_json(F.collect_list(ask)).alias("json"))
    r = src.measurement_requests(raw)
    results = x.select(F.col("id").alias("request_id"), F.round(F.when(even, F.col("line_height")).otherwise(20.0) * F.col("lines"), 6).alias("height_px"), F.col("lines").alias("line_count"))
    return layout.measured(r, results).select("request_id", "font_size_px", "line_height_px", "font_family_css", "height", "line_count")


@query(
    f"""WITH {LINES} SELECT doc_id, page, count(*) AS n, min(ord) AS first_ord FROM units WHERE (page % 2 = 1 OR page > 3) AND regexp_matches(text, '\\S') AND page <= CASE doc_id % 3 WHEN 0 THEN 1000000 WHEN 1 THEN 20 ELSE 1 END GROUP BY doc_id, page"""
)
def filtered_pages(spark, sf_dir):
    """Units of pages that are there, whose translation isn't blank, within the mode's page limit."""
    u = units(spark, sf_dir).withColumn("translated", F.col("text"))
    there = u.select("doc_id", "page").distinct().filter("page % 2 = 1 or page > 3")
    mode = F.get(F.array(F.lit("all"), F.lit("first20"), F.lit("first")), (F.col("doc_id") % 3).cast("int"))
    x = translate.worth_drawing(jobs.on_pages(u, there)).withColumn("limit", jobs.page_limit(mode))
    return x.filter("limit is null or page <= limit").groupBy("doc_id", "page").agg(F.count("*").alias("n"), F.min("ord").cast("long").alias("first_ord"))


@query(
    """WITH f AS (SELECT doc_id, doc_id || CASE doc_id % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.PDF' ELSE '.txt' END AS path, n_chars * 10000 AS length FROM documents)
SELECT path, CASE WHEN doc_id % 3 = 2 THEN 'not_pdf' WHEN length > 52428800 THEN 'too_large' ELSE 'accepted' END AS verdict FROM f"""
)
def upload_verdicts(spark, sf_dir):
    """S7."""
    end = F.get(F.array(F.lit(".pdf"), F.lit(".PDF"), F.lit(".txt")), (F.col("doc_id") % 3).cast("int"))
    f = documents(spark, sf_dir).select(F.concat(F.col("doc_id").cast("string"), end).alias("path"), (F.col("n_chars") * 10000).alias("length"))
    return src.uploads(f).select("path", "verdict")


def _words(n: int) -> str:
    """SQL for the first words of letters of each document, blank where there are fewer."""
    return f"SELECT doc_id, list_transform(range(1, {n + 1}), lambda i: coalesce(regexp_extract_all(text, '[a-z]{{3,}}')[i], 'none')) AS w FROM documents"


def _with_words(spark, sf_dir, n: int):
    found = F.regexp_extract_all("text", F.lit("[a-z]{3,}"), F.lit(0))
    return documents(spark, sf_dir).select("doc_id", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.get(found, i), F.lit("none"))).alias("w"))


@query(
    f"""WITH d AS ({_words(4)}), p AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN ['1.1 ' || w[1] || ' ' || w[2], '1.2 ' || w[3]] WHEN 1 THEN ['intro ' || w[1], '• ' || w[2], '• ' || w[3] || ' ' || w[4]] WHEN 2 THEN [w[1] || ' ' || w[2], w[3], w[4]] ELSE [w[1] || ' ' || w[2]] END AS parts FROM d)
SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) - 1 AS pos FROM p"""
)
def list_items(spark, sf_dir):
    """Items by section numbers, by bullets, by lines, and one alone."""
    w = lambda i: F.get("w", i - 1)
    k = F.col("doc_id") % 4
    said = F.when(k == 0, F.concat(F.lit("1.1 "), w(1), F.lit(" "), w(2), F.lit(" 1.2 "), w(3))).when(k == 1, F.concat(F.lit("intro "), w(1), F.lit(" • "), w(2), F.lit(" • "), w(3), F.lit(" "), w(4))).when(k == 2, F.concat(w(1), F.lit(" "), w(2), F.lit("\n\n "), w(3), F.lit("\n"), w(4), F.lit(" \n"))).otherwise(F.concat(F.lit("  "), w(1), F.lit(" "), w(2)))
    d = _with_words(spark, sf_dir, 4).select("doc_id", F.posexplode(split.list_parts(said)).alias("pos", "part"))
    return d.select("doc_id", "part", F.col("pos").cast("long").alias("pos"))


@query(
    f"""WITH d AS ({_words(3)}), p AS (SELECT doc_id, [{{'t': w[1] || ' ' || w[2], 'p': CAST(doc_id % 300 AS VARCHAR)}}, {{'t': w[3], 'p': 'xii'}}] AS es FROM d WHERE doc_id % 3 < 2)
SELECT doc_id, e.t AS title, e.p AS toc_page FROM (SELECT doc_id, unnest(es) AS e FROM p)"""
)
def leader_entries(spark, sf_dir):
    """Entries of a table of contents with leaders, dots or middle dots; a text with too few dots has none."""
    w = lambda i: F.get("w", i - 1)
    k = F.col("doc_id") % 3
    dots = F.when(k == 0, " ..... ").when(k == 1, "····").otherwise(" .. ")
    said = F.concat(w(1), F.lit(" "), w(2), dots, (F.col("doc_id") % 300).cast("string"), F.lit(" "), w(3), dots, F.lit("xii"))
    d = _with_words(spark, sf_dir, 3).select("doc_id", F.explode(split.toc_entries(said)).alias("e"))
    return d.select("doc_id", F.col("e.text").alias("title"), F.col("e.page").alias("toc_page"))


@query(
    f"""WITH d AS ({_words(4)}), p AS (SELECT doc_id, CASE doc_id % 2 WHEN 0 THEN [w[1] || ' ' || w[2], w[3] || ' ' || w[4]] ELSE [w[1], w[2] || ' ' || w[3], w[4]] END AS parts FROM d)
SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) - 1 AS pos FROM p"""
)
def explicit_lines(spark, sf_dir):
    """Paragraphs between blank lines, their own lines joined; else lines."""
    w = lambda i: F.get("w", i - 1)
    said = F.when(F.col("doc_id") % 2 == 0, F.concat(w(1), F.lit(" \n"), w(2), F.lit("\n \t\n "), w(3), F.lit("  "), w(4))).otherwise(F.concat(w(1), F.lit("\n"), w(2), F.lit(" "), w(3), F.lit("\n"), w(4), F.lit(" ")))
    d = _with_words(spark, sf_dir, 4).select("doc_id", F.posexplode(split.explicit_segments(said)).alias("pos", "part"))
    return d.select("doc_id", "part", F.col("pos").cast("long").alias("pos"))


@query(
    f"""WITH d AS ({_words(2)}) SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'Kapitel ' || doc_id % 40 WHEN 1 THEN 'Teil 7' WHEN 2 THEN 'Kurzfassung ' || w[1] WHEN 3 THEN w[1] || ' ' || w[2] ELSE 'Ein ' || w[1] END AS final FROM d"""
)
def translation_rules(spark, sf_dir):
    """Structure, the glossary for untouched and for suspicious texts, white space at the ends."""
    w = lambda i: F.get("w", i - 1)
    k = F.col("doc_id") % 5
    both = F.concat(w(1), F.lit(" "), w(2))
    text = F.when(k == 0, F.format_string("CHAPTER  %d", F.col("doc_id") % 40)).when(k == 1, "Part").when(k == 2, F.concat(F.lit("Summary "), w(1))).otherwise(both)
    said = F.when(k == 2, F.concat(F.lit("Summary "), w(1))).when(k == 3, F.concat(F.lit("A PUBLICATION of "), w(1))).when(k == 4, F.concat(F.lit("\tEin "), w(1), F.lit("\n \t"))).otherwise("x")
    u = _with_words(spark, sf_dir, 2).select("doc_id", text.alias("text"), said.alias("translated"), F.when(k == 1, "7").otherwise("").alias("toc_page"))
    return translate.postprocessed(u, translate.phrases(spark, [("Summary", "Kurzfassung")]), "de").select("doc_id", "final")


@query(
    """WITH r AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'ha' WHEN 1 THEN 'z' WHEN 2 THEN '가' ELSE '-' END AS unit, doc_id % 12 + 1 AS n FROM documents)
SELECT doc_id, 'so ' || CASE doc_id % 4 WHEN 0 THEN CASE WHEN n >= 5 THEN unit ELSE repeat(unit, n) END WHEN 3 THEN CASE WHEN n >= 10 THEN unit ELSE repeat(unit, n) END ELSE CASE WHEN n >= 5 THEN unit ELSE rtrim(repeat(unit || ' ', n)) END END || ' end' AS text FROM r"""
)
def stuttering(spark, sf_dir):
    """T5: fragments five times over, spaced letters five times, any character ten times; fewer stay."""
    k, n = F.col("doc_id") % 4, (F.col("doc_id") % 12 + 1).cast("int")
    said = F.when(k == 0, F.repeat(F.lit("ha"), n)).when(k == 1, F.rtrim(F.repeat(F.lit("z "), n))).when(k == 2, F.rtrim(F.repeat(F.lit("가 "), n))).otherwise(F.repeat(F.lit("-"), n))
    return documents(spark, sf_dir).select("doc_id", t.without_repeats(F.concat(F.lit("so "), said, F.lit(" end"))).alias("text"))


@query(
    f"""WITH {BLOCKS}, s AS (SELECT *, ord % 3 = 0 AS unnamed FROM blocks),
q AS (SELECT doc_id, page, y0 + 1000 AS plan_y0, row_number() OVER (PARTITION BY doc_id, page ORDER BY nr DESC) AS k FROM s WHERE unnamed AND ord % 2 = 0),
free AS (SELECT doc_id, page, block_id, row_number() OVER (PARTITION BY doc_id, page ORDER BY nr) AS k FROM s WHERE unnamed)
SELECT s.doc_id, s.page, s.block_id, CASE WHEN NOT unnamed THEN s.y0 ELSE q.plan_y0 END AS plan_y0, CASE WHEN NOT unnamed OR q.plan_y0 IS NOT NULL THEN 'none' ELSE 'planner_missing' END AS fallback, NOT unnamed OR q.plan_y0 IS NOT NULL AS drawn
FROM s LEFT JOIN free f ON f.doc_id = s.doc_id AND f.page = s.page AND f.block_id = s.block_id LEFT JOIN q ON q.doc_id = f.doc_id AND q.page = f.page AND q.k = f.k"""
)
def plan_matching(spark, sf_dir):
    """Plans by id; those without one in order; blocks that no plan is left for."""
    x = blocks(spark, sf_dir)
    unnamed, nr = F.col("ord") % 3 == 0, layout.number(F.col("block_id"))
    named = x.filter(~unnamed).select("doc_id", "page", "block_id", F.col("rect.y0").alias("plan_y0"), F.lit("none").alias("fallback"), nr.alias("pos"))
    queue = x.filter(unnamed & (F.col("ord") % 2 == 0)).select("doc_id", "page", F.lit(None).cast("string").alias("block_id"), (F.col("rect.y0") + 1000).alias("plan_y0"), F.lit("none").alias("fallback"), (-nr).alias("pos"))
    return layout.matched(x.select("doc_id", "page", "block_id"), named.unionByName(queue)).select("doc_id", "page", "block_id", "plan_y0", "fallback", "drawn")


@query(
    f"""WITH {BLOCKS}, g AS (SELECT *, least(greatest((x1 - x0) * 0.035, font * 0.2), 18) AS px, least(greatest((y1 - y0) * 0.15, font * 0.9), 28) AS py FROM blocks)
SELECT doc_id, page, block_id, round(CASE WHEN font < 16 THEN y0 ELSE y0 - py * 0.3 END, 6) AS y0, round(CASE WHEN font < 16 THEN y1 ELSE y1 + py END, 6) AS y1, 0.0::DOUBLE AS shift FROM g"""
)
def legacy_plan(spark, sf_dir):
    """P13, G9."""
    return layout.legacy_plan(blocks(spark, sf_dir)).select("doc_id", "page", "block_id", F.round("planned.y0", 6).alias("y0"), F.round("planned.y1", 6).alias("y1"), "shift")


@query(
    """WITH e AS (SELECT event_id AS job_id, user_id % 7 AS surface, CAST(ts AS TIMESTAMP) AS s, floor(value) AS v FROM events)
SELECT job_id, CAST(ceil(v / 1.5) + 1 AS BIGINT) AS polls, CAST(floor(v / 10) AS BIGINT) AS beats, CASE WHEN job_id % 2 = 0 THEN 200 ELSE 404 END AS http FROM e"""
)
def job_watching(spark, sf_dir):
    """A client's polls, a phase's heartbeats, a lookup of known and unknown jobs."""
    e = b.table(spark, sf_dir, "events").select(F.col("event_id").alias("job_id"), F.col("ts").cast("timestamp").alias("start"), F.floor("value").alias("v"))
    e = e.withColumn("end", F.timestamp_micros(F.unix_micros("start") + F.col("v") * 1_000_000))
    p = jobs.polls(e.select("job_id", F.col("start").alias("asked"), F.col("end").alias("ended"))).select("job_id", "polls")
    h = jobs.heartbeats(e.select("job_id", F.lit("render").alias("phase"), "start", "end", F.lit("page=1").alias("context"))).groupBy("job_id").agg(F.count("*").alias("beats"))
    found = jobs.lookup(e.filter("job_id % 2 = 0").select("job_id", "v"), e.select("job_id")).select("job_id", "http")
    return p.join(h, "job_id", "left").join(found, "job_id").select("job_id", "polls", F.coalesce("beats", F.lit(0).cast("long")).alias("beats"), "http")


_GIVEN = [
    ({}, "legacy", 10.0, 2, 0.9, False, "ctranslate2"),
    ({"PAGELOOM_RENDER_LAYOUT_ENGINE": " PreText", "PAGELOOM_BASE_FONT_SIZE": "12.5", "PAGELOOM_JOB_QUEUE_CONCURRENCY": "0", "PAGELOOM_BOX_OVERLAP_THRESHOLD": "0.7", "PAGELOOM_RATE_LIMIT_ENABLED": "YES", "PAGELOOM_DEFAULT_PROVIDER": "Remote"}, "pretext", 12.5, 1, 0.7, True, "openrouter"),
    ({"PAGELOOM_RENDER_LAYOUT_ENGINE": "odd", "PAGELOOM_DUPLICATE_BOX_THRESHOLD": "0.8", "PAGELOOM_BOX_OVERLAP_THRESHOLD": "0.7", "PAGELOOM_JOB_QUEUE_CONCURRENCY": "5", "PAGELOOM_BASE_FONT_SIZE": " "}, "legacy", 10.0, 5, 0.8, False, "ctranslate2"),
]


@query(
    "WITH s(k, engine, font, jobs, iom, rate_limit, provider) AS (VALUES "
    + ", ".join(f"({k}, '{e}', {f!r}, {n}, {i!r}, {r}, '{p}')" for k, (_, e, f, n, i, r, p) in enumerate(_GIVEN))
    + """)
SELECT e.event_id, s.engine, CASE WHEN e.value IS NULL THEN s.font::DOUBLE ELSE e.value END AS font, s.jobs, s.iom::DOUBLE AS iom, s.rate_limit, s.provider, CAST(greatest(trunc(coalesce(e.value, 500.0)), 1) AS INTEGER) AS daily FROM events e JOIN s ON s.k = e.event_id % 3"""
)
def settings_resolved(spark, sf_dir):
    """Defaults, aliases, clamps; each event is a job with settings of its own, as its table row gives them."""
    from collections.abc import Iterator

    import pandas as pd

    def resolved(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            rows = []
            for k, v in zip(x["event_id"], x["value"], strict=True):
                own = {} if v != v else {"PAGELOOM_BASE_FONT_SIZE": repr(float(v)), "PAGELOOM_RATE_LIMIT_DAILY_SECONDS": str(int(v))}
                s = st.settings({**_GIVEN[k % 3][0], **own})
                rows.append((k, s["layout_engine"], s["base_font_size"], s["running_jobs"], s["iom_threshold"], s["rate_limit"], s["default_provider"], s["daily_seconds"]))
            yield pd.DataFrame(rows, columns=["event_id", "engine", "font", "jobs", "iom", "rate_limit", "provider", "daily"])

    e = b.table(spark, sf_dir, "events").select("event_id", "value")
    return e.mapInPandas(resolved, "event_id long, engine string, font double, jobs int, iom double, rate_limit boolean, provider string, daily int")
