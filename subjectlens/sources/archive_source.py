"""Members of ZIP archives as a Spark source: spark.read.format("zip_members").load(folder), and the same as a stream."""

from __future__ import annotations

import time
import zipfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith,
)
from pyspark.sql.types import BinaryType, LongType, StringType, StructType

SCHEMA = StructType().add("path", StringType()).add("name", StringType()).add("size", LongType()).add("content", BinaryType())
#: Bytes of members that are handed to Spark at once, about; a longer member goes alone.
BATCH_BYTES = 8 << 20
#: An empty archive's bytes.
LEAST_BYTES = 22
#: An archive is taken in by a stream when it has been unchanged for so many seconds, so none of the same moment comes later.
SETTLED_SECONDS = 2.0


class Archive(InputPartition):
    def __init__(self, path: str):
        self.path = path


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}" if path.startswith("/") else path.replace("file:", "file://", 1))


def archives(folder: str) -> list[tuple[int, str]]:
    """(time of change in ns, address) of a file, or of all files of a folder and its subfolders that end in .zip."""
    fs, name = opened(folder)
    found = fs.get_file_info(name)
    if found.type == pafs.FileType.NotFound:
        raise FileNotFoundError(folder)
    prefix = folder[: len(folder) - len(name)] if folder.endswith(name) else "file://"
    files = [found] if found.type == pafs.FileType.File else [f for f in fs.get_file_info(pafs.FileSelector(name, recursive=True)) if f.type == pafs.FileType.File and f.path.lower().endswith(".zip")]
    return sorted((f.mtime_ns or 0, prefix + f.path) for f in files)


class Members:
    """What reader and stream reader have in common: the asked columns, and the conditions that Spark hands over."""

    def __init__(self, options: dict, schema: StructType):
        self.folder, self.names = options["path"], schema.names
        unknown = set(self.names) - set(SCHEMA.names)
        if unknown:
            raise ValueError(f"no such columns: {', '.join(sorted(unknown))}")
        self.conditions: list[tuple[str, str, object]] = []

    def holds(self, column: str, value: str) -> bool:
        tests = {"=": lambda x: value == x, "in": lambda x: value in x, "starts": value.startswith, "ends": value.endswith, "contains": lambda x: x in value}
        return all(tests[kind](x) for c, kind, x in self.conditions if c == column)

    def pushed(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes conditions on path and name; gives back the others, which Spark applies itself."""
        kinds = {EqualTo: "=", In: "in", StringStartsWith: "starts", StringEndsWith: "ends", StringContains: "contains"}
        for f in filters:
            if type(f) in kinds and f.attribute in (("path",), ("name",)) and f.value is not None:
                self.conditions.append((f.attribute[0], kinds[type(f)], f.value))
            else:
                yield f

    def read(self, partition: Archive) -> Iterator[pa.RecordBatch]:
        """Members of one archive; bytes are unpacked only where size alone isn't asked for. What is no archive has none."""
        types = {"path": pa.string(), "name": pa.string(), "size": pa.int64(), "content": pa.binary()}
        fs, name = opened(partition.path)
        rows, held = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, types[n]) for c, n in zip(zip(*rows, strict=True), self.names, strict=True)], names=self.names)

        with fs.open_input_file(name) as f:
            if f.size() < LEAST_BYTES or not zipfile.is_zipfile(f):
                return
            f.seek(0)
            with zipfile.ZipFile(f) as z:
                for m in z.infolist():
                    if m.is_dir() or not self.holds("name", m.filename):
                        continue
                    given = {"path": partition.path, "name": m.filename, "size": m.file_size}
                    if "content" in self.names:
                        given["content"] = z.read(m)
                        held += m.file_size
                    rows.append([given[n] for n in self.names])
                    if held >= BATCH_BYTES or len(rows) >= 10_000:
                        yield batch()
                        rows, held = [], 0
        if rows:
            yield batch()


class MemberReader(DataSourceReader):
    def __init__(self, members: Members):
        self.members = members

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        return self.members.pushed(filters)

    def partitions(self) -> list[Archive]:
        return [Archive(path) for _, path in archives(self.members.folder) if self.members.holds("path", path)]

    def read(self, partition: Archive) -> Iterator[pa.RecordBatch]:
        return self.members.read(partition)


class MemberStream(DataSourceStreamReader):
    """Archives in the order of their change. An offset is the (time, address) of the last one taken in."""

    def __init__(self, members: Members, settled: float):
        self.members, self.settled = members, settled

    def initialOffset(self) -> dict:  # noqa: N802
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        now = time.time_ns() - int(self.settled * 1e9)
        done = [x for x in archives(self.members.folder) if x[0] <= now]
        return {"time": done[-1][0], "path": done[-1][1]} if done else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Archive]:
        low, high = (start["time"], start["path"]), (end["time"], end["path"])
        return [Archive(path) for at, path in archives(self.members.folder) if low < (at, path) <= high]

    def read(self, partition: Archive) -> Iterator[pa.RecordBatch]:
        return self.members.read(partition)


class ZipMembers(DataSource):
    """(path, name, size, content) of the members of all .zip files of a folder, a partition for each archive.

    A schema with fewer of these columns reads less: without content nothing is unpacked. Conditions on path skip
    archives, conditions on name skip members, where spark.sql.python.filterPushdown.enabled is set. Directories have no
    rows. Option settled (seconds): how long a stream waits before it takes in a changed archive.
    """

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> StructType:
        return SCHEMA

    def reader(self, schema: StructType) -> MemberReader:
        return MemberReader(Members(self.options, schema))

    def streamReader(self, schema: StructType) -> MemberStream:  # noqa: N802
        return MemberStream(Members(self.options, schema), float(self.options.get("settled", SETTLED_SECONDS)))


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, and lets Spark hand conditions over."""
    spark.dataSource.register(ZipMembers)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
