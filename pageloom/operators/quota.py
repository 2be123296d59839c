"""Daily runtime quotas: usage by local day, leases and their roll-over at midnight.

Times are UTC timestamps; a day is a local date of ``zone``.  All clocks are columns.
"""

from __future__ import annotations

import datetime as dt
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Default zone and daily limit in seconds.
ZONE, LIMIT = "Asia/Seoul", 500.0


def local_day(ts: Column, zone: str = ZONE) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, zone))


def resets_at(day: Column, zone: str = ZONE) -> Column:
    """UTC time of the local midnight that ends a day."""
    return F.to_utc_timestamp(F.date_add(day, 1).cast("timestamp"), zone)


def daily_usage(spent: DataFrame, limit: float = LIMIT, zone: str = ZONE) -> DataFrame:
    """spent (client, ts, seconds) -> client, day, used: capped sums, as a running upsert gives them (A3, Q6)."""
    d = spent.groupBy("client", local_day(F.col("ts"), zone).alias("day")).agg(F.sum(F.greatest(F.col("seconds"), F.lit(0)).cast("decimal(20,6)")).alias("s"))
    return d.select("client", "day", F.least(F.lit(limit), F.col("s").cast("double")).alias("used"))


def snapshot(usage: DataFrame, leases: DataFrame, limit: float = LIMIT, zone: str = ZONE) -> DataFrame:
    """client, day, used, reserved, remaining, resets_at (Q1, A2); leases: client, day, reserved."""
    both = usage.select("client", "day", "used", F.lit(0.0).alias("reserved")).unionByName(leases.select("client", "day", F.lit(0.0).alias("used"), "reserved"))
    d = both.groupBy("client", "day").agg(F.sum("used").alias("used"), F.coalesce(F.sum("reserved"), F.lit(0.0)).alias("reserved"))
    return d.withColumn("remaining", F.greatest(F.lit(limit) - F.col("used") - F.col("reserved"), F.lit(0.0))).withColumn("resets_at", resets_at(F.col("day"), zone))


def by_day(intervals: DataFrame, zone: str = ZONE) -> DataFrame:
    """intervals (client, start, seconds) cut at local midnights: client, day, seconds (Q5, exact)."""
    i = intervals.withColumn("__a", F.from_utc_timestamp("start", zone).cast("timestamp")).withColumn("__b", F.timestamp_micros((F.unix_micros("__a") + F.col("seconds") * 1000000).cast("long")))
    i = i.withColumn("day", F.explode(F.sequence(F.to_date("__a"), F.to_date("__b"))))
    begin, end = F.greatest(F.col("__a"), F.col("day").cast("timestamp")), F.least(F.col("__b"), F.date_add("day", 1).cast("timestamp"))
    part = (F.unix_micros(end) - F.unix_micros(begin)) / 1e6
    return i.select("client", "day", part.alias("part")).filter("part > 0").groupBy("client", "day").agg(F.sum(F.col("part").cast("decimal(20,6)")).cast("double").alias("seconds"))


class Leases:
    """Leases of one client: what it has used by day, and its open leases, {name: [day, began, reserved]}.

    A start reserves all that remains of its day, and is refused if nothing does; leases of other days don't count.
    A check or end past local midnight first charges the lease's day with the time up to its midnight; the lease goes on, from
    that midnight, with what today has left (so today bears all the rest, also of days skipped), or expires if that is nothing.
    A lease that has used its reservation expires.
    """

    def __init__(self, limit: float = LIMIT, zone: str = ZONE):
        self.limit, self.zone, self.used, self.held = limit, ZoneInfo(zone), {}, {}

    def day_of(self, t: dt.datetime) -> dt.date:
        return t.replace(tzinfo=dt.UTC).astimezone(self.zone).date()

    def end_of(self, day: dt.date) -> dt.datetime:
        return dt.datetime.combine(day + dt.timedelta(days=1), dt.time(), self.zone).astimezone(dt.UTC).replace(tzinfo=None)

    def remaining(self, day: dt.date) -> float:
        return max(0.0, self.limit - self.used.get(day, 0.0) - sum(x[2] for x in self.held.values() if x[0] == day))

    def _charge(self, day: dt.date, seconds: float) -> None:
        self.used[day] = min(self.limit, self.used.get(day, 0.0) + max(0.0, seconds))

    def _started(self, name: str, t: dt.datetime, today: dt.date) -> str:
        if (left := self.remaining(today)) <= 0:
            return "refused"
        self.held[name] = [today, t, left]
        return "granted"

    def _looked_at(self, name: str, t: dt.datetime, today: dt.date, ending: bool) -> str:
        day, began, reserved = self.held.pop(name)
        if day != today:
            midnight = self.end_of(day)
            self._charge(day, min((t - began).total_seconds(), (midnight - began).total_seconds()))
            day, began, reserved = today, midnight, self.remaining(today)
            if reserved <= 0:
                return "expired"
        spent = max(0.0, (t - began).total_seconds())
        over = spent + 1e-6 >= reserved
        if not (ending or over):
            self.held[name] = [day, began, reserved]
            return "running"
        self._charge(day, min(spent, reserved))
        return "expired" if over else "ended"

    def taken(self, t: dt.datetime, name: str, action: str) -> dict:
        """What comes of an event: ts, lease, action, day, result and used after it."""
        today = self.day_of(t)
        if action == "start":
            said = self._started(name, t, today)
        else:
            said = self._looked_at(name, t, today, action == "end") if name in self.held else "ignored"
        return {"ts": t, "lease": name, "action": action, "day": today, "result": said, "used": self.used.get(today, 0.0)}

    def next_due(self) -> tuple[dt.datetime, str]:
        """When an open lease must be looked at next, and which: at the end of its reservation or at its midnight."""
        ends = lambda x: min(x[1] + dt.timedelta(microseconds=round(x[2] * 1e6)), self.end_of(x[0]))
        return min((ends(x), name) for name, x in self.held.items())

    def due(self, before: dt.datetime) -> list[dict]:
        """Looks, in order, at all leases that are due before a moment (action ``timer``)."""
        out = []
        while self.held:
            t, name = self.next_due()
            if t >= before:
                break
            out.append(self.taken(t, name, "timer"))
        return out


def replay_client(events: list[dict], limit: float = LIMIT, zone: str = ZONE, timers: bool = False) -> list[dict]:
    """Leases of one client in order (Q2-Q5): events (ts, lease, action: start, check or end).

    timers: leases are also looked at when they are due, up to the last event.
    """
    leases, out = Leases(limit, zone), []
    for e in events:
        for row in leases.due(e["ts"]) if timers else []:
            out.append({**e, **row})
        out.append({**e, **leases.taken(e["ts"], e["lease"], e["action"])})
    return out


#: Events of one moment are taken in this order.
ORDER = {"start": 0, "check": 1, "end": 2}


def replay(events: DataFrame, limit: float = LIMIT, zone: str = ZONE, timers: bool = False) -> DataFrame:
    """events (client, ts, lease, action) with result, day and used after each (Q2-Q5); with timers also rows of action ``timer``,
    where a lease expires or rolls over without an event (streaming/leases.py does the same live).

    What a client does must be seen in order: one client's events are one task's.
    """

    def run(x: pd.DataFrame) -> pd.DataFrame:
        rows = x.assign(__k=x["action"].map(ORDER)).sort_values(["ts", "lease", "__k"], kind="stable").drop(columns="__k").to_dict("records")
        out = replay_client([{**r, "ts": r["ts"].to_pydatetime()} for r in rows], limit, zone, timers)
        return pd.DataFrame(out, columns=["client", "ts", "lease", "action", "day", "result", "used"])

    e = events.select("client", F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("lease").cast("string").alias("lease"), "action")
    return e.groupBy("client").applyInPandas(run, f"client {e.schema['client'].dataType.simpleString()}, ts timestamp_ntz, lease string, action string, day date, result string, used double")


