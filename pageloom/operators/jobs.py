"""Jobs: status from event logs, concurrency, admission, retention."""

from __future__ import annotations

import heapq
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pageloom.functions.text import message

#: Jobs at once, jobs waiting; statuses that end a job; the cadence of progress lines; kept for.
RUNNING, WAITING = 2, 8
TERMINAL = ("succeeded", "failed", "quota_exceeded", "queue_busy")
EVERY_UNIT, EVERY_PAGE = 10, 5
RETENTION_S = 86_400
HEARTBEAT_S, POLL_S, CLEANUP_S = 10.0, 1.5, 600.0


def latest_status(events: DataFrame) -> DataFrame:
    """events (job_id, ts, status, progress) -> one row a job: last status and stage, clamped progress, times."""
    last = F.max_by(F.struct("status", "progress"), F.struct("ts", "status", "progress"))
    d = events.groupBy("job_id").agg(last.alias("l"), F.min(F.when(F.col("status") != "queued", F.col("ts"))).alias("started_at"), F.max("ts").alias("updated_at"), F.max(F.when(F.col("status").isin(*TERMINAL), F.col("ts"))).alias("ended_at"))
    p = F.least(F.greatest(F.coalesce("l.progress", F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return d.select("job_id", F.col("l.status").alias("status"), F.when(F.col("l.status") == "succeeded", 1.0).otherwise(p).alias("progress"), "started_at", "updated_at", "ended_at", F.col("l.status").isin(*TERMINAL).alias("done"), message(F.col("l.status")).alias("message"))


def concurrency(jobs: DataFrame, unit: str = "day") -> DataFrame:
    """jobs (job_id, start, end): most jobs at once in each hour, day, ....

    Running sums of +1 and -1 within a minute, on top of the sums of the bucket's minutes before it: what a bucket needs in
    order is a number a minute, however many jobs it has.
    """
    step = F.expr(f"interval 1 {unit}")
    spread = jobs.select("job_id", "start", "end", F.explode(F.sequence(F.date_trunc(unit, "start"), F.date_trunc(unit, "end"), step)).alias("bucket"))
    up = spread.select("bucket", F.greatest("start", "bucket").alias("t"), F.lit(1).alias("d"))
    down = spread.select("bucket", F.col("end").alias("t"), F.lit(-1).alias("d")).filter(F.col("t") < F.col("bucket") + step)
    s = up.unionByName(down).groupBy("bucket", "t").agg(F.sum("d").alias("d")).withColumn("minute", F.date_trunc("minute", "t"))
    w = Window.partitionBy("bucket", "minute").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    m = s.withColumn("n", F.sum("d").over(w)).groupBy("bucket", "minute").agg(F.max("n").alias("top"), F.sum("d").alias("net"))
    earlier = Window.partitionBy("bucket").orderBy("minute").rowsBetween(Window.unboundedPreceding, -1)
    return m.withColumn("n", F.col("top") + F.coalesce(F.sum("net").over(earlier), F.lit(0))).groupBy("bucket").agg(F.max("n").alias("most"))


def admit(arrivals: list[tuple[float, float]], running: int = RUNNING, waiting: int = WAITING) -> list[tuple[str, float | None]]:
    """For jobs (arrival, duration) by arrival: (running, waiting or busy; its start) (B1).  Waiters start in order."""
    free, queue, out = [float("-inf")] * running, [], []
    for at, takes in arrivals:
        while queue and queue[0] <= at:
            heapq.heappop(queue)
        if free[0] <= at:
            said, start = "running", at
        elif len(queue) < waiting:
            said, start = "waiting", free[0]
            heapq.heappush(queue, start)
        else:
            out.append(("busy", None))
            continue
        heapq.heapreplace(free, start + takes)
        out.append((said, start))
    return out


def admission(jobs: DataFrame, running: int = RUNNING, waiting: int = WAITING) -> DataFrame:
    """jobs (surface, job_id, arrival_s, takes_s) with verdict and start_s; each surface has a limiter of its own (B1)."""

    def run(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(["arrival_s", "job_id"])
        found = admit(list(zip(x["arrival_s"], x["takes_s"], strict=True)), running, waiting)
        return x.assign(verdict=[f[0] for f in found], start_s=[f[1] for f in found])

    return jobs.groupBy("surface").applyInPandas(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in jobs.schema) + ", verdict string, start_s double")


def expired(files: DataFrame, now: Column, seconds: int = RETENTION_S) -> DataFrame:
    """files (workspace, modified): workspaces whose newest file is older; "public" stays; 0 or less keeps all."""
    d = files.filter(F.col("workspace") != "public").groupBy("workspace").agg(F.max("modified").alias("newest"))
    return d.filter(F.lit(seconds > 0) & (F.unix_seconds(F.col("newest").cast("timestamp")) < F.unix_seconds(now.cast("timestamp")) - seconds))


def progress_lines(rows: DataFrame, every: int = EVERY_UNIT) -> DataFrame:
    """rows (doc_id, n, total) worth a log line: first, last and each ``every``-th."""
    return rows.filter((F.col("n") == 1) | (F.col("n") == F.col("total")) | (F.col("n") % every == 0))


def page_limit(mode: Column, unknown: int | None = 1) -> Column:
    """Pages to keep by mode; null keeps all; ``unknown`` is what another mode means."""
    return F.when(mode == "all", F.lit(None).cast("int")).when(mode == "first20", 20).when(mode == "first", 1).otherwise(F.lit(unknown).cast("int"))


def first_pages(units: DataFrame, limit: int | None) -> DataFrame:
    """The first pages; none given, or no positive number, keeps all."""
    return units if limit is None or limit <= 0 else units.filter(F.col("page") <= limit)


def on_pages(units: DataFrame, pages: DataFrame) -> DataFrame:
    """Units whose page is there (F3, J11): a semi-join with the pages (doc_id, page)."""
    return units.join(pages.select("doc_id", "page"), ["doc_id", "page"], "left_semi")


def queue_counters(admitted: DataFrame, at: Column, running: int = RUNNING, waiting: int = WAITING) -> DataFrame:
    """surface, active, waiting, capacity and queue_capacity at a moment (A9), of what admission gives."""
    begun = F.col("verdict").isin("running", "waiting")
    active = begun & (F.col("start_s") <= at) & (at < F.col("start_s") + F.col("takes_s"))
    queued = begun & (F.col("arrival_s") <= at) & (at < F.col("start_s"))
    return admitted.groupBy("surface").agg(F.count_if(active).alias("active"), F.count_if(queued).alias("waiting"), F.lit(running).alias("capacity"), F.lit(waiting).alias("queue_capacity"))


def lookup(jobs: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (job_id) with its job's columns and http: 200, or 404 for an unknown job."""
    j = asked.select("job_id").join(jobs.withColumn("__there", F.lit(True)), "job_id", "left")
    return j.withColumn("http", F.when(F.col("__there"), 200).otherwise(404)).drop("__there")


def response(jobs: DataFrame) -> DataFrame:
    """job_id and the job as JSON, nulls written."""
    return jobs.select("job_id", F.to_json(F.struct(*jobs.columns), {"ignoreNullFields": "false"}).alias("body"))


def heartbeats(phases: DataFrame, every: float = HEARTBEAT_S) -> DataFrame:
    """phases (job_id, phase, start, end, context) -> a log line each ``every`` seconds while a phase runs."""
    n = F.floor((F.unix_micros("end") - F.unix_micros("start")) / (every * 1e6)).cast("int")
    p = phases.filter(n > 0).select("*", F.explode(F.sequence(F.lit(1), n)).alias("beat"))
    ts = F.timestamp_micros((F.unix_micros("start") + F.col("beat") * int(every * 1e6)).cast("long"))
    return p.select("job_id", ts.alias("ts"), F.format_string("heartbeat phase=%s elapsed=%.0fs %s", "phase", F.col("beat") * every, F.coalesce("context", F.lit(""))).alias("message"))


def polls(jobs: DataFrame, every: float = POLL_S) -> DataFrame:
    """jobs (job_id, asked, ended) -> how often a client polls until it sees the end, and when that is."""
    gone = (F.unix_micros("ended") - F.unix_micros("asked")) / 1e6
    n = F.greatest(F.ceil(gone / every), F.lit(0)).cast("long")
    return jobs.select("job_id", (n + 1).alias("polls"), F.timestamp_micros((F.unix_micros("asked") + n * int(every * 1e6)).cast("long")).alias("seen"))


def sweep(spark: SparkSession, root: str, now: float, seconds: int = RETENTION_S) -> list[str]:
    """Deletes workspaces under root whose newest file is older, and their published folders (B6, F15, J11); gives their names.

    A scheduled job calls it each ``CLEANUP_S``.  Names of workspaces are a directory's listing, not data.
    """
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if seconds <= 0 or not fs.exists(path):
        return []
    folders = [(s.getPath().getName(), s.getModificationTime()) for s in fs.listStatus(path) if s.isDirectory()]
    base = path.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toUri().getPath().rstrip("/")
    # Files are listed by Spark (in tasks where they are many), as their names and times only; a folder counts with its own time.
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "modificationTime")
    inside = F.substring_index(F.substring(F.regexp_replace("path", r"^\w+:(//[^/]*)?", ""), len(base) + 2, 1 << 20), "/", 1)
    times = files.select(F.url_decode(inside).alias("workspace"), F.col("modificationTime").alias("modified"))
    if folders:
        own = spark.createDataFrame(folders, "workspace string, t long").select("workspace", F.timestamp_millis("t").alias("modified"))
        times = times.join(own.select("workspace"), "workspace", "left_semi").unionByName(own)
    gone = sorted(r["workspace"] for r in expired(times, F.timestamp_seconds(F.lit(now)), seconds).select("workspace").collect())
    for name in gone:
        for p in (jvm.org.apache.hadoop.fs.Path(path, name), jvm.org.apache.hadoop.fs.Path(f"{root}/public/{name}")):
            if fs.exists(p):
                fs.delete(p, True)
    return gone


class Progress:
    """A callback (value, text) that clamps, keeps and tells progress (E8); values never go back."""

    def __init__(self, tell: Callable[[float, str], None] = lambda value, text: None):
        self.tell, self.value, self.lines = tell, 0.0, []

    def __call__(self, value: float, text: str = "") -> None:
        self.value = max(self.value, min(1.0, max(0.0, value)))
        self.lines.append((self.value, text))
        self.tell(self.value, text)
