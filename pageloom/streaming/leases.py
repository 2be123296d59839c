"""Live leases: quotas granted, checked, rolled over and expired as events arrive.

State is kept by client: what it has used by local day, its open leases, and events that wait until the watermark has passed them.
Events are taken in the order of their times whatever batches they come in, so a stream gives what ``quota.replay`` with
``timers`` gives for the same events; an event that is later than the watermark is told as late and changes nothing.
Timers of event time end a lease when its reservation is used up and roll it over at local midnight, without an event.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pageloom.operators.quota import LIMIT, ORDER, ZONE, Leases

LATE = "1 hour"
#: State goes when a day is so long past that no open lease can touch it.
FORGET = dt.timedelta(days=2)
#: The state store that keeps maps, lists and timers; a session's setting.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
COLUMNS = "ts timestamp_ntz, lease string, action string, day date, result string, used double"


def _millis(t: dt.datetime) -> int:
    """The first millisecond of event time that isn't before t."""
    return -((dt.datetime(1970, 1, 1) - t) // dt.timedelta(milliseconds=1))


def _moment(millis: int) -> dt.datetime:
    return dt.datetime(1970, 1, 1) + dt.timedelta(milliseconds=millis)


class Clients(StatefulProcessor):
    """Leases of each client (the key)."""

    def __init__(self, limit: float, zone: str):
        self.limit, self.zone = limit, zone

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.used = handle.getMapState("used", "day date", "seconds double")
        self.open = handle.getMapState("open", "lease string", "day date, began timestamp_ntz, reserved double")
        self.waiting = handle.getListState("waiting", "ts timestamp_ntz, lease string, action string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        new, late = [], []
        for x in rows:
            for ts, lease, action in zip(x["ts"], x["lease"], x["action"], strict=True):
                t = ts.to_pydatetime()
                (late if _millis(t) <= now else new).append((t, lease, action))
        if new:
            self.waiting.appendList(new)
            self.handle.registerTimer(_millis(min(t for t, _, _ in new)) + 1)
        if late:
            leases = Leases(self.limit, self.zone)
            yield self._frame(key, [{"ts": t, "lease": lease, "action": action, "day": leases.day_of(t), "result": "late", "used": None} for t, lease, action in late])

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        until = _moment(timerValues.getCurrentWatermarkInMs())
        leases = Leases(self.limit, self.zone)
        leases.used = {day: s for (day,), (s,) in self.used.iterator()}
        leases.held = {name: [day, began, reserved] for (name,), (day, began, reserved) in self.open.iterator()}
        waiting = sorted(self.waiting.get(), key=lambda e: (e[0], e[1], ORDER[e[2]])) if self.waiting.exists() else []
        out, ahead = [], []
        for ts, lease, action in waiting:
            if ts >= until:
                ahead.append((ts, lease, action))
                continue
            out += leases.due(ts)
            out.append(leases.taken(ts, lease, action))
        out += leases.due(until)
        self._keep(leases, ahead, until)
        if out:
            yield self._frame(key, out)

    def _keep(self, leases: Leases, ahead: list[tuple], until: dt.datetime) -> None:
        oldest = min([until.date() - FORGET, *(x[0] for x in leases.held.values())])
        for state, now in ((self.used, {(d,): (s,) for d, s in leases.used.items() if d >= oldest}), (self.open, {(k,): tuple(x) for k, x in leases.held.items()})):
            for k in [k for k in state.keys() if tuple(k) not in now]:
                state.removeKey(tuple(k))
            for k, v in now.items():
                state.updateValue(k, v)
        if ahead:
            self.waiting.put(ahead)
        else:
            self.waiting.clear()
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        due = [*(t for t, _, _ in ahead), *([leases.next_due()[0]] if leases.held else [])]
        if due:
            self.handle.registerTimer(max(_millis(min(due)), _millis(until)) + 1)

    @staticmethod
    def _frame(key: tuple, rows: list[dict]) -> pd.DataFrame:
        d = pd.DataFrame(rows, columns=["ts", "lease", "action", "day", "result", "used"])
        d.insert(0, "client", key[0])
        return d

    def close(self) -> None:
        pass


def live(events: DataFrame, limit: float = LIMIT, zone: str = ZONE, late: str = LATE) -> DataFrame:
    """A stream of events (client, ts, lease, action: start, check or end) as a stream of what came of each (as quota.replay with timers).

    A row is given once the watermark, ``late`` behind the latest event, has passed it.  The session needs ``STORE``.
    """
    e = events.select("client", F.col("ts").cast("timestamp").alias("at"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("lease").cast("string").alias("lease"), "action").withWatermark("at", late)
    kind = events.schema["client"].dataType.simpleString()
    return e.groupBy("client").transformWithStateInPandas(statefulProcessor=Clients(limit, zone), outputStructType=f"client {kind}, {COLUMNS}", outputMode="Append", timeMode="EventTime")
