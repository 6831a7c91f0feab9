"""WARC records in ZIP packages: written per task, found through the ZIP directory and read record by record."""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subjectlens.llm.shared import fresh_path, need, read, salted_join, stash, text_of
from subjectlens.llm.token_files import open_shared

#: Payloads of fewer bytes are never revisits.
LEAST_BYTES = 0
#: A package is closed after so many bytes of records.
PACKAGE_BYTES = 128 << 20
DATE = "2024-01-01T00:00:00Z"
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"

# ZIP structures (public format, little endian)
_LOCAL = struct.Struct("<4s5H3I2H")
_CENTRAL = struct.Struct("<4s6H3I5H2I")
_END = struct.Struct("<4s4H2IH")
_LOCATOR = struct.Struct("<4sIQI")
_END64 = struct.Struct("<4sQ2H2I4Q")
FULL32, FULL16 = 0xFFFFFFFF, 0xFFFF


# ---------------------------------------------------------------- ZIP


class PackageWriter:
    """Writes stored members; sizes and offsets of 4 GiB and more, or zip64=True, take ZIP64 fields."""

    def __init__(self, out, zip64: bool = False):
        self.out, self.at, self.entries, self.zip64 = out, 0, [], zip64

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, name: str, chunks: list[bytes]) -> None:
        raw, start = name.encode(), self.at
        size, crc = sum(map(len, chunks)), 0
        for c in chunks:
            crc = zlib.crc32(c, crc)
        wide = self.zip64 or size >= FULL32
        extra = struct.pack("<2H2Q", 1, 16, size, size) if wide else b""
        short = FULL32 if wide else size
        self._put(_LOCAL.pack(b"PK\3\4", 45 if wide else 20, 0x800, 0, 0, 33, crc, short, short, len(raw), len(extra)) + raw + extra)
        for c in chunks:
            self._put(c)
        self.entries.append((raw, crc, size, start))

    def close(self) -> None:
        start = self.at
        for raw, crc, size, at in self.entries:
            big = [v for v in (size, size, at) if self.zip64 or v >= FULL32]
            extra = struct.pack(f"<2H{len(big)}Q", 1, 8 * len(big), *big) if big else b""
            s, a = (FULL32 if self.zip64 or v >= FULL32 else v for v in (size, at))
            self._put(_CENTRAL.pack(b"PK\1\2", 45, 45 if big else 20, 0x800, 0, 0, 33, crc, s, s, len(raw), len(extra), 0, 0, 0, 0, a) + raw + extra)
        size, n = self.at - start, len(self.entries)
        if self.zip64 or n >= FULL16 or start >= FULL32:
            end = self.at
            self._put(_END64.pack(b"PK\6\6", 44, 45, 45, 0, 0, n, n, size, start))
            self._put(_LOCATOR.pack(b"PK\6\7", 0, end, 1))
            self._put(_END.pack(b"PK\5\6", 0, 0, FULL16, FULL16, FULL32, FULL32, 0))
        else:
            self._put(_END.pack(b"PK\5\6", 0, 0, n, n, size, start, 0))


def directory(f, size: int) -> dict[str, tuple[int, int, int]]:
    """Members of a ZIP package by name: (offset of the data, bytes, compression method). f can seek and read."""
    tail_at = max(0, size - _END.size - FULL16)
    f.seek(tail_at)
    tail = f.read(size - tail_at)
    while (at := tail.rfind(b"PK\5\6")) >= 0:
        if at + _END.size <= len(tail) and at + _END.size + _END.unpack_from(tail, at)[7] <= len(tail):
            break
        tail = tail[:at]
    else:
        raise ValueError("no end of central directory")
    _, _, _, _, n, length, start, _ = _END.unpack_from(tail, at)
    if FULL16 == n or FULL32 in (length, start):
        locator_at = tail_at + at - _LOCATOR.size
        f.seek(locator_at)
        mark, _, end64, _ = _LOCATOR.unpack(f.read(_LOCATOR.size))
        if mark == b"PK\6\7":
            f.seek(end64)
            mark, _, _, _, _, _, _, n, length, start = _END64.unpack(f.read(_END64.size))
            if mark != b"PK\6\6":
                raise ValueError("damaged ZIP64 end of central directory")
    f.seek(start)
    table, at, members = f.read(length), 0, {}
    for _ in range(n):
        mark, _, _, flags, method, _, _, _, packed, plain, n_name, n_extra, n_note, _, _, _, offset = _CENTRAL.unpack_from(table, at)
        if mark != b"PK\1\2":
            raise ValueError("damaged central directory")
        at += _CENTRAL.size
        name = table[at : at + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra, at = table[at + n_name : at + n_name + n_extra], at + n_name + n_extra + n_note
        while len(extra) >= 4:
            kind, k = struct.unpack_from("<2H", extra)
            if kind == 1:
                wide = iter(struct.unpack_from(f"<{k // 8}Q", extra, 4))
                plain = next(wide) if plain == FULL32 else plain
                packed = next(wide) if packed == FULL32 else packed
                offset = next(wide) if offset == FULL32 else offset
            extra = extra[4 + k :]
        members[name] = (offset, packed, method)
    out = {}
    for name, (offset, packed, method) in members.items():
        f.seek(offset)
        head = _LOCAL.unpack(f.read(_LOCAL.size))
        if head[0] != b"PK\3\4":
            raise ValueError(f"damaged member {name}")
        out[name] = (offset + _LOCAL.size + head[9] + head[10], packed, method)
    return out


# ---------------------------------------------------------------- WARC


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record(page_id: int | None, url: str, payload: bytes, size: int, sha1: str, refers_to: int | None, revisit: bool) -> bytes:
    """One gzipped WARC/1.1 record; a revisit has no payload of its own."""
    kind = "revisit" if revisit else "response"
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + f"Content-Length: {size}\r\n\r\n".encode() + (b"" if revisit else payload)
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id} {url}").urn
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_clean(url)}", f"WARC-Payload-Digest: sha1:{sha1}", "Content-Type: application/http; msgtype=response", f"X-Page-Id: {'' if page_id is None else page_id}"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-Id: {'' if refers_to is None else refers_to}"]
    head = "\r\n".join([*lines, f"Content-Length: {len(body)}"]).encode() + b"\r\n\r\n"
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(head + body + b"\r\n\r\n") + packer.flush()


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers by lower-case name and the HTTP payload of one gzipped record."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    body = rest[: int(headers["content-length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    for line in http.decode("latin-1").split("\r\n")[1:]:
        k, _, v = line.partition(":")
        headers["http-" + k.strip().lower()] = v.strip()
    return headers, payload


def write_package(path: str, rows: list[tuple[dict, bytes]], zip64: bool = False) -> None:
    """rows: (index entry without its place, gzipped record). The file appears under its name only when it is whole."""
    at, lines = 0, []
    for entry, data in rows:
        lines.append(json.dumps(entry | {"offset": at, "length": len(data)}, ensure_ascii=False))
        at += len(data)
    fs, name = open_shared(path)
    fs.create_dir(name.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(name + ".part") as out:
        package = PackageWriter(out, zip64)
        package.add(ARCHIVE, [d for _, d in rows])
        package.add(INDEX, [("\n".join(lines) + "\n").encode()])
        package.close()
    fs.move(name + ".part", name)


def read_index(path: str) -> tuple[int, list[dict]]:
    """Offset of the archive member in the package, and its index entries."""
    fs, name = open_shared(path)
    with fs.open_input_file(name) as f:
        members = directory(f, f.size())
        if any(members[m][2] for m in (ARCHIVE, INDEX)):
            raise ValueError("members must be stored")
        at, size, _ = members[INDEX]
        f.seek(at)
        return members[ARCHIVE][0], [json.loads(x) for x in f.read(size).decode().splitlines()]


def read_records(path: str, base: int, entries: list[dict]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Reads just the byte ranges of the entries."""
    fs, name = open_shared(path)
    with fs.open_input_file(name) as f:
        for e in entries:
            f.seek(base + e["offset"])
            yield parse(f.read(e["length"]))


# ---------------------------------------------------------------- tables


def write_archives(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Writes a record per row of pages(page_id, url, html) and returns the packages (path, n).

    Of records with equal payloads of at least least_bytes bytes the one with the smallest page_id is the response and
    the others revisit it. Equal means the same SHA-256, SHA-1 and length; digests are grouped with partial aggregation,
    so html moves in no shuffle. Rows that repeat the smallest page_id are all responses.
    """
    pages = need(pages, "page_id", "url", "html").select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), text_of("html").alias("html"))
    keyed = pages.withColumn("key", F.concat(F.unhex(F.sha2("html", 256)), F.unhex(F.sha1("html"))))
    first = keyed.groupBy("key").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    marks = salted_join(keyed.select("page_id", "key"), first, ["key"], ["page_id"], "n", pages.count()).filter((F.col("page_id") != F.col("first")) | (F.col("page_id").isNull() & F.col("first").isNotNull()))
    marks = stash(marks.select(F.col("page_id").alias("id"), "key", "first").distinct(), "warc-revisits")
    return _packages(keyed, marks, least_bytes)


def _packages(keyed: DataFrame, marks: DataFrame, least_bytes: int) -> DataFrame:
    spark = keyed.sparkSession
    folder = fresh_path(spark, "warc")
    marks = marks.withColumnRenamed("key", "k").withColumn("marked", F.lit(True))
    on = F.col("id").eqNullSafe(F.col("page_id")) & (F.col("k") == F.col("key"))
    rows = keyed.join(marks, on, "left").select("page_id", "url", F.col("html"), F.col("first"), (F.col("marked").isNotNull() & (F.octet_length("html") >= least_bytes)).alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size, done = TaskContext.get().partitionId(), [], 0, []

        def close():
            path = f"{folder}/part-{number:06d}-{len(done):04d}-{uuid.uuid4().hex[:12]}.wacz"
            write_package(path, held)
            done.append((path, len(held)))

        for b in batches:
            for page_id, url, html, first, revisit in zip(*(c.to_pylist() for c in b.columns), strict=True):
                payload = html.encode("utf-8", "surrogatepass")
                sha1 = digest(payload)
                data = record(page_id, url, payload, len(payload), sha1, first, revisit)
                held.append(({"id": page_id, "url": url, "digest": sha1, "mime": "warc/revisit" if revisit else "text/html"}, data))
                size += len(data)
                if size >= PACKAGE_BYTES:
                    close()
                    held, size = [], 0
        if held:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], names=["path", "n"])

    return stash(rows.mapInArrow(run, "path string, n long"), "warc-packages")


def read_archives(packages: DataFrame) -> DataFrame:
    """(page_id, url, record_type, payload_bytes, payload_digest, refers_to, html) per record.

    A task reads whole packages, which are bounded, a few records at a time. html is null for revisits.
    """
    n = int(packages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    files = packages.select("path").repartition(n, "path")
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "html"]
    typed = pa.schema(list(zip(names, [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()], strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                base, entries = read_index(path)
                for i in range(0, len(entries), 200):
                    out = []
                    for e, (h, payload) in zip(entries[i : i + 200], read_records(path, base, entries[i : i + 200]), strict=True):
                        revisit = h["warc-type"] == "revisit"
                        sha1 = h["warc-payload-digest"].removeprefix("sha1:")
                        if not revisit and (digest(payload) != sha1 or len(payload) != int(h["http-content-length"])):
                            raise ValueError(f"damaged record in {path}")
                        number = lambda x: int(x) if x else None
                        out.append((number(h["x-page-id"]), e["url"], h["warc-type"], int(h["http-content-length"]), sha1, number(h.get("x-refers-to-page-id")), None if revisit else payload.decode("utf-8", "surrogatepass")))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), typed.types, strict=True)], schema=typed)

    return files.mapInArrow(run, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, html string")


def archived(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Writes pages(page_id, url, html) to packages and reads every record back; null html is an empty payload, null url an empty one.

    A null page_id is larger than any other and is kept; an empty table gives no packages and no rows.
    """
    return read_archives(write_archives(pages, least_bytes))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
