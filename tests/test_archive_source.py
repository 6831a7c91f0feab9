"""ZIP archives as a source and as a stream."""

import os
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from subjectlens.sources import archive_source


@pytest.fixture
def folder(spark, tmp_path):
    archive_source.register(spark)
    for k in range(3):
        _archive(tmp_path, k)
    (tmp_path / "broken.zip").write_bytes(b"no archive")
    (tmp_path / "other.txt").write_text("x")
    return tmp_path


def _archive(folder, k):
    sub = folder / f"sub{k % 2}"
    sub.mkdir(exist_ok=True)
    with zipfile.ZipFile(sub / f"a{k}.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.mkdir("dir")
        for i in range(k + 2):
            z.writestr(f"dir/m{i}.{'txt' if i % 2 else 'json'}", f"{k}-{i} ü" * 1000 * i)
        z.writestr("empty", "")


def _want(ks):
    out = set()
    for k in ks:
        out |= {(f"a{k}.zip", f"dir/m{i}.{'txt' if i % 2 else 'json'}", (f"{k}-{i} ü" * 1000 * i).encode()) for i in range(k + 2)} | {(f"a{k}.zip", "empty", b"")}
    return out


def _rows(df):
    return {(r.path.rpartition("/")[2], r["name"], bytes(r.content)) for r in df.collect()}


def test_members(spark, folder):
    df = spark.read.format("zip_members").load(str(folder))
    assert _rows(df) == _want(range(3)) and df.rdd.getNumPartitions() == 4
    assert {r["size"] == len(r.content) for r in df.collect()} == {True}
    assert _rows(spark.read.format("zip_members").load(f"file://{folder}/sub1/a1.zip")) == _want([1])


def test_fewer_columns_and_conditions(spark, folder, monkeypatch):
    names = spark.read.format("zip_members").schema("name string, size long").load(str(folder))
    assert sorted(r["name"] for r in names.collect()) == sorted(n for _, n, _ in _want(range(3)))
    df = spark.read.format("zip_members").load(str(folder))
    for condition, keep in ((F.col("name").endswith(".txt"), lambda p, n: n.endswith(".txt")), (F.col("path").contains("a2"), lambda p, n: "a2" in p), ((F.col("name") == "empty") & (F.col("size") == 0), lambda p, n: n == "empty"), (F.col("name").isin("empty", "dir/m1.txt"), lambda p, n: n in ("empty", "dir/m1.txt"))):
        assert _rows(df.filter(condition)) == {x for x in _want(range(3)) if keep(*x[:2])}
    reader = archive_source.ZipMembers({"path": str(folder)}).reader(archive_source.SCHEMA)
    rest = list(reader.pushFilters([archive_source.StringContains(("path",), "a2"), archive_source.EqualTo(("size",), 3)]))
    assert [type(f).__name__ for f in rest] == ["EqualTo"] and len(reader.partitions()) == 1
    with pytest.raises(Exception, match="no such columns"):
        spark.read.format("zip_members").schema("nothing string").load(str(folder)).collect()
    with pytest.raises(Exception, match="nowhere"):
        spark.read.format("zip_members").load(f"{folder}/nowhere").collect()


def test_stream(spark, folder, tmp_path_factory):
    base = tmp_path_factory.mktemp("stream")

    def run():
        stream = spark.readStream.format("zip_members").option("settled", "0").load(str(folder))
        stream.writeStream.format("parquet").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start(f"{base}/out").awaitTermination()
        return spark.read.parquet(f"{base}/out")

    assert _rows(run()) == _want(range(3))
    _archive(folder, 5)
    _archive(folder, 6)
    later = time.time_ns()
    os.utime(folder / "sub1/a5.zip", ns=(later, later))
    os.utime(folder / "sub0/a6.zip", ns=(later, later))
    out = run()
    assert _rows(out) == _want([0, 1, 2, 5, 6]) and out.count() == len(_want([0, 1, 2, 5, 6]))
    assert run().count() == out.count()
