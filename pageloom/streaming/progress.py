"""Heartbeats: lines in the log while work goes on, from what Spark says of its progress.

A phase of a batch job, or a streaming query while it is active, gets a line each ``every`` seconds: how long it has run, how many tasks of
its jobs are done of how many, and for streams the batch and its rows.  Nothing is made up afterwards: a line is written
when it is due, by a thread of the driver that ends with its phase.
"""

from __future__ import annotations

import datetime as dt
import threading
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession
from pyspark.sql.streaming.listener import QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent, StreamingQueryListener

from pageloom.operators.jobs import HEARTBEAT_S, Progress


class Log:
    """An append-only log of lines ``[ts] message`` in a folder, which ``sources.documents.run_log`` reads.

    The driver writes a line as a small file of its own, without a job: a line must not wait for the work it tells of.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.name, self.n, self.lock = spark, path, uuid.uuid4().hex, 0, threading.Lock()

    def __call__(self, message: str) -> None:
        now = dt.datetime.now(dt.UTC).strftime("%Y-%m-%dT%H:%M:%S")
        with self.lock:
            jvm = self.spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/line-{self.name}-{self.n:06d}.txt")
            self.n += 1
            out = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).create(at)
            out.write(bytearray(f"[{now}] {message}\n".encode()))
            out.close()


def tasks(spark: SparkSession, group: str) -> tuple[int, int]:
    """(done, all) tasks of the stages of a job group's jobs that Spark still knows of."""
    tracker, done, every = spark.sparkContext.statusTracker(), 0, 0
    for job in tracker.getJobIdsForGroup(group):
        info = tracker.getJobInfo(job)
        for stage in info.stageIds if info else ():
            if s := tracker.getStageInfo(stage):
                done, every = done + s.numCompletedTasks, every + s.numTasks
    return done, every


class _Beat(threading.Thread):
    """Calls tell(elapsed seconds) each ``every`` seconds until it is ended."""

    def __init__(self, every: float, tell):
        super().__init__(daemon=True)
        self.every, self.tell, self.over, self.began = every, tell, threading.Event(), time.monotonic()

    def run(self) -> None:
        n = 1
        while not self.over.wait(max(0.0, self.began + n * self.every - time.monotonic())):
            self.tell(time.monotonic() - self.began)
            n = max(n + 1, int((time.monotonic() - self.began) / self.every) + 1)  # a slow line delays none after it

    def end(self) -> None:
        self.over.set()
        if self is not threading.current_thread():
            self.join()


@contextmanager
def phase(log: Log, name: str, context: str = "", every: float = HEARTBEAT_S, progress: Progress | None = None) -> Iterator[str]:
    """Lines while the jobs started inside run, one at its start and end too; gives the job group.  progress is told the share of tasks done."""
    spark, group = log.spark, f"{name}-{uuid.uuid4().hex}"

    def tell(elapsed: float) -> None:
        done, total = tasks(spark, group)
        if progress is not None and total:
            progress(done / total, name)
        log(f"heartbeat phase={name} elapsed={elapsed:.0f}s tasks={done}/{total} {context}".rstrip())

    log(f"phase={name}:start {context}".rstrip())
    spark.sparkContext.setJobGroup(group, name)
    beat = _Beat(every, tell)
    beat.start()
    try:
        yield group
    except BaseException:
        beat.end()
        log(f"phase={name}:failed {context}".rstrip())
        raise
    else:
        beat.end()
        if progress is not None:
            progress(1.0, name)
        log(f"phase={name}:done {context}".rstrip())
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


class Heartbeats(StreamingQueryListener):
    """A listener that writes lines for every streaming query of a session: ``spark.streams.addListener(Heartbeats(log))``."""

    def __init__(self, log: Log, every: float = HEARTBEAT_S):
        self.log, self.every, self.beats, self.last = log, every, {}, {}

    def onQueryStarted(self, event: QueryStartedEvent) -> None:
        run, name = str(event.runId), event.name or str(event.id)
        self.last[run] = (-1, 0)

        def tell(elapsed: float) -> None:
            batch, rows = self.last.get(run, (-1, 0))
            done, total = tasks(self.log.spark, run)  # Spark runs a stream's jobs in a group of its run's id
            self.log(f"heartbeat phase=stream elapsed={elapsed:.0f}s tasks={done}/{total} batch={batch} rows={rows} query={name}")

        self.beats[run] = _Beat(self.every, tell)
        self.beats[run].start()
        self.log(f"phase=stream:start query={name}")

    def onQueryProgress(self, event: QueryProgressEvent) -> None:
        p = event.progress
        before = self.last.get(str(p.runId), (-1, 0))
        self.last[str(p.runId)] = (p.batchId, before[1] + p.numInputRows)

    def onQueryIdle(self, event: object) -> None:
        pass

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:
        run = str(event.runId)
        if beat := self.beats.pop(run, None):
            beat.end()
        batch, rows = self.last.pop(run, (-1, 0))
        self.log(f"phase=stream:{'failed' if event.exception else 'done'} batch={batch} rows={rows} run={run}")
