"""Queries over time and groups: as-of and interval joins, range frames, ranks, cubes, mergeable sketches; and texts in boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from pageloom import catalog
from pageloom.catalog import BLOCKS, BOXES, INTERVALS, query
from pageloom.operators import dedup, layout, measures, models, quota, temporal
from pageloom.plans import bridges as b
from pageloom.plans import reports


def _jobs(spark, sf_dir):
    return b.job_intervals(b.table(spark, sf_dir, "events"))


@query(
    f"""WITH {INTERVALS}, ended AS (SELECT client, stop, max(job_id) AS job_id, arg_max(epoch(stop) - epoch(start), job_id)::DOUBLE AS seconds FROM intervals GROUP BY client, stop)
SELECT i.job_id, i.client, i.start, e.job_id AS last_job, e.stop AS last_end, e.seconds AS last_seconds FROM intervals i ASOF LEFT JOIN ended e ON e.client = i.client AND i.start >= e.stop"""
)
def usage_as_of(spark, sf_dir):
    """An as-of join: for each job, what was known of its client's use when it started (the last job that had ended)."""
    j = _jobs(spark, sf_dir)
    ended = j.select("client", F.col("end").alias("ts"), "job_id", "seconds")
    d = temporal.as_of(j.select("client", F.col("start").alias("ts"), "job_id"), ended, ["client"])
    return d.select("job_id", "client", F.col("ts").cast("timestamp_ntz").alias("start"), F.col("known.job_id").alias("last_job"), F.col("known.ts").cast("timestamp_ntz").alias("last_end"), F.col("known.seconds").alias("last_seconds"))


@query(
    f"""WITH {INTERVALS}, leases AS (SELECT event_id AS lease, user_id AS client, CAST(ts AS TIMESTAMP) AS a, CAST(ts AS TIMESTAMP) + INTERVAL 30 MINUTE AS b FROM events)
SELECT i.client, i.job_id, l.lease, (epoch_us(least(i.stop, l.b)) - epoch_us(greatest(i.start, l.a))) / 1e6 AS shared_s FROM intervals i JOIN leases l ON l.client = i.client AND i.start < l.b AND l.a < i.stop"""
)
def job_lease_overlaps(spark, sf_dir):
    """An interval join: jobs and the half-hour leases of their client that they overlap with."""
    e = b.table(spark, sf_dir, "events")
    start = F.col("ts").cast("timestamp")
    leases = e.select(F.col("user_id").alias("client"), F.col("event_id").alias("lease"), start.alias("start"), F.timestamp_micros(F.unix_micros(start) + 1_800_000_000).alias("end"))
    d = temporal.overlapping(_jobs(spark, sf_dir).select("client", "job_id", "start", "end"), leases, ["client"])
    micros = lambda f, k: f(F.unix_micros(f"l.{k}"), F.unix_micros(f"r.{k}"))
    return d.select("client", F.col("l.job_id").alias("job_id"), F.col("r.lease").alias("lease"), ((micros(F.least, "end") - micros(F.greatest, "start")) / 1e6).alias("shared_s"))


@query(
    """SELECT event_id, user_id AS client, CAST(sum(CAST(greatest(coalesce(value, 0), 0) AS DECIMAL(28, 6))) OVER (PARTITION BY user_id ORDER BY CAST(ts AS TIMESTAMP) RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS DOUBLE) AS recent FROM events"""
)
def usage_last_day(spark, sf_dir):
    """A range frame: the seconds each client had used in the 24 hours up to each event."""
    e = b.table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("client"), "ts", F.greatest(F.coalesce("value", F.lit(0.0)), F.lit(0.0)).alias("seconds"))
    return temporal.trailing_sum(e, ["client"], "seconds", 86_400).select("event_id", "client", "recent")


@query(
    """WITH usage AS (SELECT user_id AS client, CAST(CAST(ts AS TIMESTAMP) + INTERVAL 9 HOUR AS DATE) AS day, least(500.0, CAST(sum(CAST(greatest(value, 0) AS DECIMAL(20, 6))) AS DOUBLE)) AS used FROM events GROUP BY 1, 2)
SELECT client, CAST(day AS VARCHAR) AS day, used, rank() OVER w AS place, CAST(dense_rank() OVER w AS INTEGER) AS dense_place, percent_rank() OVER w AS share, CAST((rank() OVER w - 1) * 4 // count(*) OVER (PARTITION BY day) + 1 AS INTEGER) AS tile FROM usage WINDOW w AS (PARTITION BY day ORDER BY used DESC)"""
)
def daily_usage_ranks(spark, sf_dir):
    """Ranks over days: each client's place by its use of the day."""
    d = temporal.daily_ranks(quota.daily_usage(b.spent(b.table(spark, sf_dir, "events"))), "day", "used")
    return d.select("client", F.col("day").cast("string").alias("day"), "used", "place", "dense_place", "share", "tile")


_TYPED = "typed AS (SELECT CAST(CAST(ts AS TIMESTAMP) AS DATE) AS day, event_type AS status, CAST(user_id % 4 AS BIGINT) AS surface, user_id, value FROM events)"


def _typed(spark, sf_dir):
    return b.table(spark, sf_dir, "events").select(F.to_date(F.col("ts").cast("timestamp")).alias("day"), F.col("event_type").alias("status"), (F.col("user_id") % 4).alias("surface"), "user_id", "value")


@query(
    f"""WITH {_TYPED}
SELECT CAST(day AS VARCHAR) AS day, status, surface, grouping_id(day, status, surface) AS set, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(28, 6))) AS DOUBLE) AS total, max(value) AS most FROM typed GROUP BY CUBE (day, status, surface)"""
)
def usage_cube(spark, sf_dir):
    """A cube: counts and sums for every subset of day, status and surface."""
    d = measures.cubed(_typed(spark, sf_dir), ["day", "status", "surface"], F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(28,6)")).cast("double").alias("total"), F.max("value").alias("most"))
    return d.select(F.col("day").cast("string").alias("day"), "status", "surface", F.col("set").cast("long").alias("set"), "n", "total", "most")


@query(
    f"""WITH {_TYPED}
SELECT CAST(day AS VARCHAR) AS day, status, grouping_id(day, status) AS level, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(28, 6))) AS DOUBLE) AS total, count(DISTINCT user_id) AS people, true AS people_close, true AS quantiles_close FROM typed GROUP BY ROLLUP (day, status)"""
)
def sketch_rollup(spark, sf_dir):
    """Sketches by day, status and surface, merged by surface and rolled up; estimates within 3 % (and one) of the exact counts, and within
    2 % of the rank."""
    t = _typed(spark, sf_dir)
    s = measures.rolled_up(measures.merged(measures.sketches(t, ["day", "status", "surface"], "user_id", "value"), ["day", "status"]), ["day", "status"])
    got = measures.estimates(s)
    # The exact figures of the same groups, and the share of values up to each estimate.
    x = t.rollup("day", "status").agg(F.grouping_id().alias("level"), F.countDistinct("user_id").alias("people"))
    same = lambda a, b: F.col(f"{a}.day").eqNullSafe(F.col(f"{b}.day")) & F.col(f"{a}.status").eqNullSafe(F.col(f"{b}.status")) & (F.col(f"{a}.level") == F.col(f"{b}.level"))
    g = got.alias("g").join(x.alias("x"), same("g", "x")).select("g.*", "x.people")
    each = t.select("value", F.explode(F.array(F.struct("day", "status", F.lit(0).cast("long").alias("level")), F.struct("day", F.lit(None).cast("string").alias("status"), F.lit(1).cast("long").alias("level")), F.struct(F.lit(None).cast("date").alias("day"), F.lit(None).cast("string").alias("status"), F.lit(3).cast("long").alias("level")))).alias("o")).select("value", "o.*")
    below = lambda q: F.avg(F.when(F.col("v.value") <= F.col(f"g.{q}"), 1.0).otherwise(0.0))
    under = lambda q: F.avg(F.when(F.col("v.value") < F.col(f"g.{q}"), 1.0).otherwise(0.0))
    ranks = g.alias("g").join(each.alias("v"), same("g", "v")).groupBy(*[F.col(f"g.{c}") for c in ("day", "status", "level", "n", "total", "people", "distinct")]).agg(*[f(q).alias(f"{q}_{k}") for q in ("q50", "q90") for k, f in (("high", below), ("low", under))])
    close = lambda q, x: (F.col(f"{q}_high") >= x - 0.02) & (F.col(f"{q}_low") <= x + 0.02)
    # (With few values a quantile is one of them: its own rank is all there is.)
    few = F.col("n") < 50
    return ranks.select(F.col("day").cast("string").alias("day"), "status", "level", "n", F.col("total").cast("double").alias("total"), "people", (F.abs(F.col("distinct") - F.col("people")) <= 0.03 * F.col("people") + 1).alias("people_close"), (few | (close("q50", 0.5) & close("q90", 0.9))).alias("quantiles_close"))


#: What boxes say, by turns: nothing, equal texts in other spacing and case, texts that hold others, and others.
_SAID = ["", "Figure 1", " figure\t 1 ", "Figure 1 shows the wing", "Table 2", "wing"]
_SAYING = "saying AS (SELECT *, [" + ", ".join(f"'{x}'" for x in _SAID) + "][ord % 6 + 1] AS said FROM boxes)"


def _saying(spark, sf_dir):
    x = b.vector_boxes(b.table(spark, sf_dir, "embeddings"))
    return x.withColumn("text", F.get(F.array(*map(F.lit, _SAID)), (F.col("ord") % 6).cast("int")))


@query(
    rf"""WITH {BOXES}, {_SAYING},
plain AS (SELECT *, lower(trim(regexp_replace(said, '\s+', ' ', 'g'))) AS bare FROM saying),
pairs AS (
  SELECT a.doc_id, a.page, a.label, a.ord AS ord_a, b.ord AS ord_b, (a.r - a.l) * (a.t - a.b) AS sa, (b.r - b.l) * (b.t - b.b) AS sb, a.bare AS xa, b.bare AS xb,
    greatest(0, least(a.r, b.r) - greatest(a.l, b.l)) * greatest(0, least(a.t, b.t) - greatest(a.b, b.b)) AS common
  FROM plain a JOIN plain b ON a.doc_id = b.doc_id AND a.page = b.page AND a.label = b.label AND a.ord < b.ord)
SELECT doc_id, page, label, ord_a, ord_b, round(common / (sa + sb - common), 6) AS iou, round(common / least(sa, sb), 6) AS iom FROM pairs
WHERE least(sa, sb) / greatest(sa, sb) >= 0.8 AND (common / (sa + sb - common) >= 0.85 OR (common / least(sa, sb) >= 0.9 AND (xa = '' OR xb = '' OR contains(xa, xb) OR contains(xb, xa))))"""
)
def saying_box_pairs(spark, sf_dir):
    """Duplicate pairs of boxes with texts, of which some agree."""
    p = dedup.duplicate_pairs(_saying(spark, sf_dir))
    return p.withColumns({"iou": F.round("iou", 6), "iom": F.round("iom", 6)})


#: The greedy fold of bbox_dedup_greedy over boxes that say something: 'said' must agree where boxes hold each other, and of equal areas the longer text is better.
_FOLD_SAYING = (
    catalog._FOLD.replace("'t': t, 'hits': []::BIGINT[]} AS c FROM boxes", "'t': t, 'hits': []::BIGINT[], 'said': lower(trim(regexp_replace(said, '\\s+', ' ', 'g'))), 'len': length(said)} AS c FROM saying")
    .replace("'t': f.t, 'hits': []::BIGINT[]}", "'t': f.t, 'hits': []::BIGINT[], 'said': f.said, 'len': f.len}")
    .replace("'t': a.t, 'hits': list_append(a.hits, k.slot)}", "'t': a.t, 'hits': list_append(a.hits, k.slot), 'said': a.said, 'len': a.len}")
    .replace("'t': k.t, 'hits': list_append(a.hits, k.slot)}", "'t': k.t, 'hits': list_append(a.hits, k.slot), 'said': k.said, 'len': k.len}")
    .replace(">= 0.9)) THEN a", ">= 0.9 AND (contains(a.said, k.said) OR contains(k.said, a.said)))) THEN a")
    .replace("WHEN (a.r - a.l) * (a.t - a.b) > (k.r - k.l) * (k.t - k.b) THEN", "WHEN (a.r - a.l) * (a.t - a.b) > (k.r - k.l) * (k.t - k.b) OR ((a.r - a.l) * (a.t - a.b) = (k.r - k.l) * (k.t - k.b) AND a.len > k.len) THEN")
)


@query(f"WITH RECURSIVE {BOXES.lstrip()}, {_SAYING}, {_FOLD_SAYING} SELECT doc_id, page, label, k.slot AS ord, k.l AS \"left\", k.b AS bottom, k.r AS \"right\", k.t AS top, k.len AS length FROM ends")
def saying_box_dedup(spark, sf_dir):
    """What the greedy rule keeps of boxes with texts; of equal areas the longer text, blanks counted."""
    d = dedup.deduplicated(_saying(spark, sf_dir), raw_length=True)
    return d.select("doc_id", "page", "label", "ord", "box.left", "box.bottom", "box.right", "box.top", F.length("text").cast("long").alias("length"))


@query(
    f"""WITH {BLOCKS}, marked AS (SELECT *, CASE ord % 9 WHEN 1 THEN ' Paragraph ' WHEN 4 THEN 'table' WHEN 6 THEN 'LIST ITEM' ELSE label END AS kind, CASE WHEN ord % 4 = 2 THEN CAST(ord AS VARCHAR) ELSE '' END AS toc FROM blocks)
SELECT doc_id, page, block_id, lower(trim(kind)) IN ('paragraph', 'heading', 'caption', 'list item') AS paragraph_box, toc = '' AND lower(trim(kind)) IN ('paragraph', 'heading', 'caption', 'list item') AS planned FROM marked"""
)
def planned_blocks(spark, sf_dir):
    """blocks of other labels, in other spelling, and of tables of contents."""
    label = F.when(F.col("ord") % 9 == 1, " Paragraph ").when(F.col("ord") % 9 == 4, "table").when(F.col("ord") % 9 == 6, "LIST ITEM").otherwise(F.col("label"))
    x = catalog.blocks(spark, sf_dir).withColumns({"label": label, "toc_page": F.when(F.col("ord") % 4 == 2, F.col("ord").cast("string")).otherwise("")})
    return x.select("doc_id", "page", "block_id", layout.paragraph_box(F.col("label")).alias("paragraph_box"), layout.planned(F.col("label"), F.col("toc_page")).alias("planned"))


_NAMES = {"ko": "Korean", "ja": "Japanese", "zh": "Simplified Chinese", "en": "English"}


@query(
    f"""WITH said AS (SELECT doc_id, text FROM documents UNION ALL SELECT -1 - i AS doc_id, s AS text FROM (SELECT unnest(range(0, {len(catalog._SAMPLES)})) AS i, unnest({catalog._SAMPLES!r}) AS s))
SELECT doc_id, CASE WHEN regexp_matches(text, '[가-힣]') THEN 'kor_Hang' WHEN regexp_matches(text, '[぀-ヿ]') THEN 'jpn_Jpan' WHEN regexp_matches(text, '[㐀-鿿]') THEN 'zho_Hans' ELSE 'eng_Latn' END AS tag FROM said"""
)
def language_tags(spark, sf_dir):
    """The model tag of each text's language, by name."""
    from pageloom.functions import text as t

    d = catalog.documents(spark, sf_dir).select("doc_id", "text")
    more = spark.createDataFrame([(-1 - i, s) for i, s in enumerate(catalog._SAMPLES)], d.schema)
    name = F.element_at(F.create_map(*[F.lit(x) for pair in _NAMES.items() for x in pair]), t.detected_language(F.col("text")))
    return d.unionByName(more).select("doc_id", models.tags(name).alias("tag"))


@query(
    f"""WITH {catalog.LINES}, pages AS (SELECT doc_id, CAST(unnest(range(1, doc_id % 3 + 2)) AS INTEGER) AS page FROM documents)
SELECT u.doc_id, u.page, u.ord, u.label, l AS x0, 800 - t AS y0, l + w AS x1, 800 - t + h AS y1, CASE label WHEN 'paragraph' THEN 0.12 WHEN 'heading' THEN 0.87 WHEN 'caption' THEN 0.14 ELSE 0.78 END AS red, 1.1 AS width
FROM units u JOIN pages p ON p.doc_id = u.doc_id AND p.page = u.page"""
)
def box_preview(spark, sf_dir):
    """What to outline on the pages that are there (one to three of each document)."""
    pages = catalog.documents(spark, sf_dir).select("doc_id", F.explode(F.sequence(F.lit(1), (F.col("doc_id") % 3 + 1).cast("int"))).alias("page"), F.lit(b.PAGE_HEIGHT).alias("height"))
    return reports.box_preview(catalog.units(spark, sf_dir), pages).drop("green", "blue")
