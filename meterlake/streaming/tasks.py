"""Tasks as a stream: start and done markers folded by id, with timers for tasks that stay open."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE = "description string, session string, begins long, status string"
OUT = "task string, description string, session string, begins timestamp, ends timestamp, status string"
COLUMNS = [c.split()[0] for c in OUT.split(", ")]


def _millis(ts) -> int:
    return int(pd.Timestamp(ts).value // 1_000_000)


class TaskFold(StatefulProcessor):
    """A task's state from its first start on; two numbers and two texts, whatever the number of its markers."""

    def __init__(self, limit_ms: int, keep_ms: int):
        self.limit_ms, self.keep_ms = limit_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.task = handle.getValueState("task", STATE)

    def _out(self, key: tuple, ends, status: str) -> pd.DataFrame:
        description, session, begins, _ = self.task.get()
        return pd.DataFrame([(key[0], description, session, pd.Timestamp(begins, unit="ms"), ends, status)], columns=COLUMNS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, last = None, None
        for frame in rows:
            for kind, ts, description, session in zip(frame["kind"], frame["ts"], frame["description"], frame["session"], strict=True):
                if kind == "start" and (first is None or ts < first[0]):
                    first = (ts, description, session)
                elif kind == "done" and (last is None or ts > last):
                    last = ts
        if not self.task.exists():
            if first is None:  # a done without a start is no task
                return
            begins = _millis(first[0])
            self.task.update((first[1], first[2], begins, "open"))
            self.handle.registerTimer(begins + self.limit_ms)
        if last is not None:
            description, session, begins, status = self.task.get()
            if _millis(last) >= begins:
                late = status == "expired"
                yield self._out(key, pd.Timestamp(last), "late" if late else "done")
                self.task.update((description, session, begins, "expired" if late else "done"))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.task.exists():
            return
        description, session, begins, status = self.task.get()
        if expiredTimerInfo.getExpiryTimeInMs() >= begins + self.limit_ms + self.keep_ms:
            self.task.clear()
            return
        self.handle.registerTimer(begins + self.limit_ms + self.keep_ms)
        if status == "open":
            self.task.update((description, session, begins, "expired"))
            yield self._out(key, pd.NaT, "expired")

    def close(self) -> None:
        pass


def task_stream(markers: DataFrame, limit: timedelta, keep: timedelta, watermark: str = "1 hour") -> DataFrame:
    """(task, description, session, begins, ends, status) from markers (kind, id, description, session, ts).

    The first start of an id counts; in a micro-batch the earliest. A done gives a row `done`, a
    later one another; the last counts. When the watermark passes `limit` after its start, a task
    that is still open gives a row `expired`; a done that comes after that gives one `late`. After
    `keep` more the state goes, and a start is a new task. Rows without id, kind or ts are left out.
    Needs the RocksDB state store.
    """
    rows = markers.filter("id is not null and ts is not null and kind in ('start', 'done')").select("id", "kind", "ts", "description", "session").withWatermark("ts", watermark)
    ms = lambda d: int(d.total_seconds() * 1000)
    return rows.groupBy("id").transformWithStateInPandas(TaskFold(ms(limit), ms(keep)), OUT, "Append", "EventTime")
