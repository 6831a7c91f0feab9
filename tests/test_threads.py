"""Thread states in a state store against the fold over all events."""

import pathlib

import pytest
from pyspark.sql import functions as F

from subjectlens.operators import merge
from subjectlens.operators.tables import fresh_path
from subjectlens.streaming import threads

EVENTS = "thread long, ts timestamp_ntz, seq long, action string"


def _write(spark, folder, parts):
    for part in parts:
        frame = spark.createDataFrame(part, "thread long, s long, seq long, action string")
        frame.select("thread", F.timestamp_seconds("s").alias("ts"), "seq", "action").coalesce(1).write.mode("append").parquet(folder)


def _events(spark, folder):
    stream = spark.readStream.schema("thread long, ts timestamp, seq long, action string").option("maxFilesPerTrigger", 1).parquet(folder)
    return stream


@pytest.mark.parametrize("idle_ms", (-1, 0, 3_600_000))
def test_equal_to_the_fold(spark, idle_ms):
    base = fresh_path(spark, "test-threads")
    events, checkpoint, out = f"{base}/in", f"{base}/state", f"{base}/out"
    parts = [[(i % 7, 1000 + i, i, f"a{i}") for i in range(20 * k, 20 * k + 20)] for k in range(4)]
    parts[2] += [(1, 5, 900, "late"), (None, 5, 901, "no thread"), (2, None, 902, "no time"), (3, 1059, 59, None)]
    _write(spark, events, parts)
    threads.keep_threads(_events(spark, events), checkpoint, out, idle_ms)

    def agree():
        got = {r.thread: (r.status, r.n) for r in threads.threads_now(spark.read.parquet(out)).collect()}
        want = {r.thread if r.thread is None else str(r.thread): (r.status, r.n) for r in merge.thread_states(spark.read.parquet(events)).collect()}
        return got == want

    assert agree()
    batches = sorted(pathlib.Path(out.removeprefix("file://")).glob("batch=*"))
    assert len(batches) >= 4
    # the last batch is run again: as if the run had died before it was marked as done
    last = max((p for p in pathlib.Path(f"{checkpoint.removeprefix('file://')}/commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    for name in (last.name, f".{last.name}.crc"):
        (last.parent / name).unlink(missing_ok=True)
    threads.keep_threads(_events(spark, events), checkpoint, out, idle_ms)
    assert agree()
    _write(spark, events, [[(k, 2000 + k, 2000 + k, "more") for k in range(5)]])
    threads.keep_threads(_events(spark, events), checkpoint, out, idle_ms)
    assert agree()
    now = {r.thread: r.idle for r in threads.threads_now(spark.read.parquet(out)).collect()}
    assert any(now.values()) == (idle_ms == 0)


def test_history_on_demand(spark):
    rows = spark.createDataFrame([(1, None, 2, "b"), (1, None, 1, "a"), (2, None, 1, "x")], EVENTS)
    asked = spark.createDataFrame([(1,), (1,), (9,)], "thread long")
    assert [(r.thread, r.action) for r in threads.history_of(rows, asked).collect()] == [(1, "a"), (1, "b")]
