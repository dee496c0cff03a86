"""Tasks that expire once they have been idle: event-time timers on a stream, sessions on a table."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

_STATE = "first_seen bigint, last_seen bigint, status string, n_rows bigint"
EXPIRED = "task_id string, first_seen timestamp, last_seen timestamp, status string, n_rows bigint"


class _Idle(StatefulProcessor):
    """Remembers each task's first and last time in microseconds; one timer, ``keep`` after the last, is moved by every newer row."""

    def __init__(self, keep_ms: int) -> None:
        self.keep_ms = keep_ms

    def init(self, handle) -> None:
        self.handle, self.state = handle, handle.getValueState("task", _STATE)

    def _due(self, seen: int) -> int:
        return seen // 1000 + self.keep_ms

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first, last, status, n = self.state.get() if self.state.exists() else (None, None, None, 0)
        before = last
        for row in rows:
            n += 1
            first = row.us if first is None else min(first, row.us)
            # of rows with one time, the later status by spelling counts, whatever the order of arrival
            if last is None or (row.us, row.status or "") >= (last, status or ""):
                last, status = row.us, row.status
        self.state.update((first, last, status, n))
        if before is None or last > before:
            if before is not None:
                self.handle.deleteTimer(self._due(before))
            self.handle.registerTimer(self._due(last))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.state.exists():
            first, last, status, n = self.state.get()
            self.state.clear()
            yield Row(task_id=key[0], first_seen=first, last_seen=last, status=status, n_rows=n)

    def close(self) -> None:
        pass


def expire_idle(df: DataFrame, key: str = "task_id", time: str = "ts", status: str = "status", keep_seconds: int = 3600, late: str = "10 minutes") -> DataFrame:
    """A row for each task (task_id, first_seen, last_seen, status, n_rows) once it was idle for ``keep_seconds``.

    Idle means by event time: the timer fires when the stream's watermark (``late`` behind the newest row) is more than
    ``keep_seconds`` past the task's last row; its state then goes, so state is bounded by the tasks that are alive.
    A task that comes back later begins anew.  Rows older than the watermark are dropped and revive nothing; rows
    without a key or time are left out.  Write it in append mode; the session must name the RocksDB state store provider in
    ``spark.sql.streaming.stateStore.providerClass``.
    """
    rows = df.select(F.col(key).cast("string").alias("task_id"), F.col(time).cast("timestamp").alias("ts"), F.col(status).cast("string").alias("status"))
    rows = rows.where("task_id IS NOT NULL AND ts IS NOT NULL").withColumn("us", F.unix_micros("ts")).withWatermark("ts", late)
    told = rows.groupBy("task_id").transformWithState(_Idle(keep_seconds * 1000), f"task_id string, {_STATE}", "append", "eventTime")
    return told.withColumns({c: F.timestamp_micros(c) for c in ("first_seen", "last_seen")})


def idle_sessions(df: DataFrame, keys: Sequence[str], time: str, keep: str = "1 hour") -> DataFrame:
    """(keys, first_seen, last_seen, n_rows): stretches of rows in which no step is ``keep`` long; the same rule on a table.

    Session windows are summed up before the shuffle, so a key with many rows sends its sessions only.
    """
    window = F.session_window(time, keep)
    return df.where(F.col(time).isNotNull()).groupBy(*keys, window).agg(F.min(time).alias("first_seen"), F.max(time).alias("last_seen"), F.count(F.lit(1)).alias("n_rows")).drop("session_window")
