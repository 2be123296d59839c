"""SQL names, and heartbeats of real work."""

import re
import time

import pytest
from pyspark.sql import functions as F

from pageloom import catalog
from pageloom.functions import registry
from pageloom.operators.jobs import Progress
from pageloom.sources import documents
from pageloom.streaming import progress

SF = "/root/testdata/sf0.001"


def nodes(df):
    """Kinds of the plan's operators, without numbers."""
    said = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"\b(\w*(?:Join|Exchange|UDTF|EvalPython|Generate|Aggregate)\w*)\b", re.sub(r"#\d+L?|plan_id=\d+", "", said))


@pytest.mark.parametrize("name", ["bbox_iou_pairs", "json_walk_units", "language_detect"])
def test_sql_text_has_the_plan_of_columns(spark, name):
    a, b = (catalog.QUERIES[n](spark, SF) for n in (name, f"{name}_by_sql"))
    assert nodes(a) == nodes(b)


def test_names_in_sql(spark):
    assert set(registry.register(spark)) == {*registry.NAMES, registry.WALK}
    r = spark.sql("SELECT bbox_area(bbox(3, 4, 1, 2)) AS a, bbox_iou(bbox(0, 0, 2, 2), bbox(1, 0, 3, 2)) AS u, text_slug(' Hello, World ') AS s, text_language('한') AS l, text_stage('Rendering') AS g, bbox_area(CAST(NULL AS STRUCT<left: DOUBLE, bottom: DOUBLE, right: DOUBLE, top: DOUBLE>)) AS n").first()
    assert (r["a"], round(r["u"], 6), r["s"], r["l"], r["g"]) == (4.0, round(1 / 3, 6), "hello-world", "ko", "rendering")
    w = spark.sql("""SELECT w.* FROM VALUES ('{"page": 1, "bbox": [0, 0, 1, 1], "content": "x"}'), ('{'), (NULL) AS t(tree), LATERAL page_walk(t.tree) w""").collect()
    assert [(x["ord"], x["page"], x["text"]) for x in w] == [(0, 1, "x")]


def lines(spark, path):
    return sorted((r["ts"], r["message"]) for r in documents.run_log(spark, path).select("ts", "message").collect())


def slow(spark, n, seconds):
    @F.udf("long")
    def wait(x):
        time.sleep(seconds)
        return x

    return spark.range(0, n, 1, n).select(wait("id").alias("x"))


def test_phase_of_a_job(spark, tmp_path):
    log, told = progress.Log(spark, str(tmp_path / "log")), []
    with progress.phase(log, "render", "page=1", 1.0, Progress(lambda v, t: told.append((v, t)))):
        slow(spark, 12, 1.2).write.format("noop").mode("overwrite").save()
    said = [m for _, m in lines(spark, log.path)]
    beats = [m for m in said if m.startswith("heartbeat phase=render")]
    assert said.count("phase=render:start page=1") == said.count("phase=render:done page=1") == 1 and len(beats) >= 2
    assert any(re.search(r"tasks=([1-9]\d*)/12 page=1$", m) for m in beats) and told[-1] == (1.0, "render") and all(0 <= v <= 1 for v, _ in told)
    with pytest.raises(ValueError), progress.phase(log, "parse", every=60):
        raise ValueError("no")
    assert "phase=parse:failed" in [m for _, m in lines(spark, log.path)]


def test_slow_stream_tells_of_itself(spark, tmp_path):
    spark.range(0, 4).write.parquet(str(tmp_path / "in"))
    log = progress.Log(spark, str(tmp_path / "log"))
    listener = progress.Heartbeats(log, 1.0)
    spark.streams.addListener(listener)
    try:
        def work(batch, number):
            time.sleep(5)
            assert batch.count() == 4

        q = spark.readStream.schema("id long").parquet(str(tmp_path / "in")).writeStream.queryName("slowly").foreachBatch(work).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert q.awaitTermination(60)
        for _ in range(100):
            if not listener.beats:
                break
            time.sleep(0.1)
        time.sleep(1)
    finally:
        spark.streams.removeListener(listener)
    said = [m for _, m in lines(spark, log.path)]
    assert sum(m.startswith("heartbeat phase=stream") and m.endswith("query=slowly") for m in said) >= 3
    assert [m[:32] for m in said if ":done" in m] == ["phase=stream:done batch=0 rows=4"]
