"""The usage store: what clients have spent, and their open leases, as tables in a folder.

Tables only grow; what holds now is an aggregate of them, so writers need no lock and a lost writer leaves nothing half done.
What is written for a batch of a stream stands in a folder of that query and batch, which is written anew if the batch is: a
batch counts once however often it is replayed.  ``compact`` sums batches up into a snapshot, in few files; a snapshot names
the last batch of each query that is in it, so readers never count a batch twice, also while old folders are still there.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.operators import quota

USAGE = "client string, day date, seconds double, at timestamp"
LEASES = "lease string, client string, day date, reserved double, at timestamp, open boolean"
#: Marks of where rows come from: the query and its batch; a commit by hand is a query of its own.
MARKS = "query string, batch long"
#: Rows of a file of a snapshot; names of queries, which are names of folders.
ROWS = 1_000_000
NAME = re.compile(r"[A-Za-z0-9_.-]+")


class UsageStore:
    def __init__(self, spark: SparkSession, path: str):
        """A store in the folder ``path``, which is made if it isn't there."""
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        for name in ("usage", "leases", "snapshots"):
            self._fs().mkdirs(self._at(name))

    def _at(self, name: str) -> object:
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _fs(self) -> object:
        return self._at("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _read(self, name: str, kind: str) -> DataFrame:
        return self.spark.read.schema(f"{kind}, {MARKS}").option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}")

    def _write(self, rows: DataFrame, name: str, mark: tuple[str, int] | None) -> None:
        query, batch = mark or (f"by-hand-{uuid.uuid4().hex}", 0)
        if not NAME.fullmatch(query):
            raise ValueError(f"a query's name has letters, digits, dots, dashes and underscores only, not {query!r}")
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}/query={query}/batch={batch}")

    def commit(self, spent: DataFrame, zone: str = quota.ZONE, mark: tuple[str, int] | None = None) -> None:
        """spent (client, ts, seconds) is added to its days; with a mark (query, batch) once only."""
        s = spent.select(F.col("client").cast("string").alias("client"), quota.local_day(F.col("ts"), zone).alias("day"), F.greatest("seconds", F.lit(0.0)).cast("double").alias("seconds"), F.col("ts").cast("timestamp").alias("at"))
        self._write(s, "usage", mark)

    def note(self, leases: DataFrame, mark: tuple[str, int] | None = None) -> None:
        """leases (lease, client, day, reserved, at, open): each row is the lease's state from ``at`` on."""
        self._write(leases.select(*[x.split()[0] for x in LEASES.split(", ")]), "leases", mark)

    def sink(self, query: str, zone: str = quota.ZONE) -> Callable[[DataFrame, int], None]:
        """For writeStream.foreachBatch: commits batches of spent; ``query`` names the stream across restarts."""
        return lambda batch, number: self.commit(batch, zone, (query, number))

    def _snapshot(self) -> tuple[str | None, DataFrame]:
        """The last whole snapshot and the batches in it (query, upto)."""
        done = [s.getPath() for s in self._fs().listStatus(self._at("snapshots")) if self._fs().exists(self.jvm.org.apache.hadoop.fs.Path(f"{s.getPath().toString()}/upto/_SUCCESS"))]
        if not done:
            return None, self.spark.createDataFrame([], "query string, upto long")
        last = max(done, key=lambda p: int(p.getName().split("-")[1])).toString()
        return last, self.spark.read.schema("query string, upto long").parquet(f"{last}/upto")

    def _spent(self) -> tuple[DataFrame, DataFrame]:
        """(client, day, seconds) of the last snapshot, and the rows of batches that aren't in it."""
        at, upto = self._snapshot()
        # (As many rows as there are queries and commits by hand since the last snapshot but one.)
        new = self._read("usage", USAGE).join(upto, "query", "left").filter("upto is null or batch > upto").drop("upto")
        kind = "client string, day date, seconds decimal(20,6)"
        old = self.spark.read.schema(kind).parquet(f"{at}/usage") if at else self.spark.createDataFrame([], kind)
        return old, new

    def usage(self, limit: float = quota.LIMIT) -> DataFrame:
        """client, day, used."""
        old, new = self._spent()
        d = old.unionByName(new.select("client", "day", F.col("seconds").cast("decimal(20,6)").alias("seconds")))
        return d.groupBy("client", "day").agg(F.least(F.lit(limit), F.sum("seconds").cast("double")).alias("used"))

    def leases(self) -> DataFrame:
        """Open leases by their last state: lease, client, day, reserved."""
        last = F.max_by(F.struct("client", "day", "reserved", "open"), F.struct("at", F.col("open") == False))  # noqa: E712
        d = self._read("leases", LEASES).groupBy("lease").agg(last.alias("l"))
        return d.filter("l.open").select("lease", "l.client", "l.day", "l.reserved")

    def snapshot(self, limit: float = quota.LIMIT, zone: str = quota.ZONE) -> DataFrame:
        return quota.snapshot(self.usage(limit), self.leases(), limit, zone)

    def compact(self) -> int:
        """Sums all batches up into a new snapshot and removes their folders; gives how many went.

        Batches are listed first: what comes meanwhile isn't in the snapshot and stays.  One compaction may run at a time; a reader that began
        before it may miss files and must read again.
        """
        fs, taken = self._fs(), {}
        for q in fs.listStatus(self._at("usage")):
            if q.getPath().getName().startswith("query="):
                done = [int(b.getPath().getName().split("=")[1]) for b in fs.listStatus(q.getPath()) if fs.exists(self.jvm.org.apache.hadoop.fs.Path(f"{b.getPath().toString()}/_SUCCESS"))]
                if done:
                    taken[q.getPath().getName().split("=", 1)[1]] = max(done)
        before, upto = self._snapshot()
        number = int(before.rsplit("-", 1)[1]) + 1 if before else 0
        old, new = self._spent()
        marks = self.spark.createDataFrame([(q, n) for q, n in taken.items()], "query string, upto long")
        sums = old.unionByName(new.join(marks, "query").filter("batch <= upto").select("client", "day", F.col("seconds").cast("decimal(20,6)").alias("seconds"))).groupBy("client", "day").agg(F.sum("seconds").cast("decimal(20,6)").alias("seconds"))
        at = f"{self.path}/snapshots/snapshot-{number}"
        sums.write.mode("overwrite").option("maxRecordsPerFile", ROWS).parquet(f"{at}/usage")
        # Queries that run on keep their mark; the folders of commits by hand never come again.
        kept = {r["query"]: r["upto"] for r in upto.collect() if not r["query"].startswith("by-hand-")}
        marks = self.spark.createDataFrame([(q, max(n, kept.get(q, -1))) for q, n in {**kept, **taken}.items()], "query string, upto long")
        marks.coalesce(1).write.mode("overwrite").parquet(f"{at}/upto")  # from here on readers take this snapshot
        gone = 0
        for q, n in taken.items():
            for b in fs.listStatus(self._at(f"usage/query={q}")):
                if int(b.getPath().getName().split("=")[1]) <= n:
                    gone += bool(fs.delete(b.getPath(), True))
            if q.startswith("by-hand-"):
                fs.delete(self._at(f"usage/query={q}"), True)
        if before:
            fs.delete(self.jvm.org.apache.hadoop.fs.Path(before), True)
        return gone
