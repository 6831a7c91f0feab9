"""Thread states kept by key in a state store: one small state a thread, whatever the number of its events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGE = "thread string, status string, n long, idle boolean"


class ThreadProcessor(StatefulProcessor):
    """Folds a thread's events into (place of the last event, its action, number of events), in whatever order they come.

    A thread without events for idle_ms of the clock is reported as idle once, by a timer that each event sets anew.
    """

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long, seq long, status string, n long")
        self.timer = handle.getValueState("timer", "due long")

    @staticmethod
    def _change(key: tuple, status: str | None, n: int, idle: bool) -> pd.DataFrame:
        return pd.DataFrame({"thread": [key[0]], "status": [status], "n": [n], "idle": [idle]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at, seq, status, n = self.last.get() if self.last.exists() else (None, None, None, 0)
        for batch in rows:
            n += len(batch)
            top = batch.sort_values(["at", "seq"]).iloc[-1]
            if at is None or (int(top["at"]), int(top["seq"])) > (at, seq):
                at, seq, status = int(top["at"]), int(top["seq"]), top["action"]
        self.last.update((at, seq, status, n))
        if self.idle_ms >= 0:
            if self.timer.exists():
                self.handle.deleteTimer(self.timer.get()[0])
            due = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
            self.handle.registerTimer(due)
            self.timer.update((due,))
        yield self._change(key, status, n, False)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.timer.clear()
        _, _, status, n = self.last.get()
        yield self._change(key, status, n, True)

    def close(self) -> None:
        pass


def thread_changes(events: DataFrame, idle_ms: int = 7 * 24 * 3_600_000) -> DataFrame:
    """ST9: (thread, status, n, idle) of a stream of events(thread, ts, seq, action): a row for each thread that a batch changes or finds idle.

    The last action is that of the greatest (ts, seq), so late events count but don't turn a thread back. Null times and
    numbers come before all others. idle_ms below zero: no timers.
    """
    lowest = F.lit(-(1 << 62))
    rows = events.select(F.col("thread").cast("string").alias("thread"), F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), lowest).alias("at"), F.coalesce(F.col("seq").cast("long"), lowest).alias("seq"), "action")
    return rows.groupBy("thread").transformWithStateInPandas(statefulProcessor=ThreadProcessor(idle_ms), outputStructType=CHANGE, outputMode="Update", timeMode="ProcessingTime" if idle_ms >= 0 else "None")


def keep_threads(events: DataFrame, checkpoint: str, path: str, idle_ms: int = 7 * 24 * 3_600_000) -> None:
    """Handles all events that are there and writes what each batch changes to path/batch=n; a batch that is run again replaces its rows.

    Only the threads of a batch are read and written, by key, in the state store. Idle threads are found when the next
    events come.
    """
    conf = events.sparkSession.conf
    # clock timers ask for one more batch for ever; without batches of no data a run ends with its last event
    wanted = {PROVIDER: ROCKS, NO_DATA: "false"}
    before = {name: conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        conf.set(name, value)
    try:
        each = lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/batch={n}")
        changes = thread_changes(events, idle_ms).writeStream.outputMode("update").trigger(availableNow=True)
        changes.option("checkpointLocation", checkpoint).foreachBatch(each).start().awaitTermination()
    finally:
        for name, value in before.items():
            conf.unset(name) if value is None else conf.set(name, value)


def threads_now(changes: DataFrame) -> DataFrame:
    """(thread, status, n, idle) after the last batch that changed each thread, from the rows that keep_threads wrote."""
    last = F.max_by(F.struct("status", "n", "idle"), F.struct("batch", "idle")).alias("x")
    return changes.groupBy("thread").agg(last).select("thread", "x.*")


def history_of(events: DataFrame, threads: DataFrame) -> DataFrame:
    """(thread, place, ts, action): the events of the asked threads(thread), first to last; states don't carry them."""
    rows = events.join(threads.select("thread").distinct(), "thread", "left_semi")
    return rows.select("thread", "ts", "seq", "action").orderBy("thread", "ts", "seq")
