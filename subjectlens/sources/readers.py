"""Files as rows: whole texts, members of ZIP archives, contents by media type, robots rules."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from subjectlens.functions.text import extension, file_category, member_category, mime_type

#: Characters of a data file, and of a scanned file, that are kept.
DATA_CHARS, SCAN_CHARS = 100_000, 50_000
#: Agents whose robots rules apply.
AGENTS = ("*", "onsit-crawler")


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): one row for each file, read as UTF-8."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, content) of files; a filter on path or size reads no content."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"), "content")


def data_files(files: DataFrame) -> DataFrame:
    """files(path, content) of data formats with their text, cut to the feature's 100 000 characters."""
    data = files.filter(file_category(F.col("path")) == "data")
    text = F.decode("content", "UTF-8")
    return data.select("path", extension(F.col("path")).alias("format"), F.left(text, F.lit(DATA_CHARS)).alias("text"), F.length(text).alias("chars"))


def zip_members(files: DataFrame) -> DataFrame:
    """(path, name, size, category, mime, content) for each member of the archives in files(path, content).

    Directories have no rows; members come one at a time, so a task holds one archive and one member. What is no ZIP
    archive has no members.
    """
    schema = "path string, name string, size long, content binary"
    typed = pa.schema([("path", pa.string()), ("name", pa.string()), ("size", pa.int64()), ("content", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                data = b.column(1)[i].as_py()
                if data is None or not zipfile.is_zipfile(io.BytesIO(data)):
                    continue
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    for m in z.infolist():
                        if not m.is_dir():
                            body = z.read(m)
                            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((b.column(0)[i].as_py(), m.filename, len(body), body), typed, strict=True)], schema=typed)

    name = F.col("name")
    return files.select("path", "content").mapInArrow(run, schema).select("path", "name", "size", member_category(name).alias("category"), mime_type(name).alias("mime"), "content")


def extracted(files: DataFrame) -> DataFrame:
    """files(id, file_name, category, content, markdown_content, extracted_text, transcript, reply) with their text.

    What is known already stays: markdown, then text, then transcript. Documents, data and media are read by a model, whose
    reply is a column; spreadsheets are read as they are, others too if they look like text. Both are cut to the feature's
    50 000 characters.
    """
    known = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("markdown_content", "extracted_text", "transcript")])
    raw = F.decode("content", "UTF-8")
    looks = (F.length(raw) > 10) & ~F.contains(raw, F.lit("\0"))
    category = F.coalesce("category", F.lit("other"))
    read = (
        F.when(category.isin("pdf", "document", "data", "image", "audio", "video"), F.nullif(F.col("reply"), F.lit("")))
        .when(category == "spreadsheet", F.left(raw, F.lit(SCAN_CHARS)))
        .otherwise(F.when(looks, F.left(raw, F.lit(SCAN_CHARS))))
    )
    return files.select("id", "file_name", F.coalesce(known, read).alias("text"))


def html_pages(responses: DataFrame) -> DataFrame:
    """responses(content_type, ...) that hold HTML or XHTML."""
    return responses.filter(F.contains("content_type", F.lit("text/html")) | F.contains("content_type", F.lit("application/xhtml+xml")))


def robots_rules(robots: DataFrame) -> DataFrame:
    """(host, disallowed, crawl_delay) of robots(host, text).

    A line counts if the last user-agent line above it names one of AGENTS; the last delay that is a number counts.
    """
    lines = robots.select("host", F.posexplode(F.split("text", "\n")).alias("at", "raw")).withColumn("line", F.lower(F.trim(F.regexp_replace("raw", r"^\s+|\s+$", ""))))
    value = F.trim(F.substring_index(F.regexp_replace("line", "^[^:]*:", ""), "\n", 1))
    agent = F.when(F.startswith("line", F.lit("user-agent:")), value.isin(*AGENTS))
    upto = W.partitionBy("host").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    lines = lines.withColumn("value", value).withColumn("ours", F.coalesce(F.last(agent, ignorenulls=True).over(upto), F.lit(False)))
    path = F.when(F.col("ours") & F.startswith("line", F.lit("disallow:")) & (F.col("value") != ""), F.struct("at", "value"))
    delay = F.when(F.col("ours") & F.startswith("line", F.lit("crawl-delay:")), F.col("value").try_cast("double"))
    paths = F.transform(F.array_sort(F.collect_list(path)), lambda x: x["value"])
    return lines.groupBy("host").agg(paths.alias("disallowed"), F.coalesce(F.max_by(delay, F.when(delay.isNotNull(), F.col("at"))), F.lit(0.0)).alias("crawl_delay"))


def path_of(url: Column) -> Column:
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(path == "", "/").otherwise(path)


def allowed(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """pages(url, host, ...) that no disallowed prefix of their host covers; hosts without rules allow all."""
    joined = pages.join(rules.select(F.col("host").alias("__host"), "disallowed"), F.col("host") == F.col("__host"), "left")
    barred = F.coalesce(F.exists("disallowed", lambda p: F.startswith(path_of(F.col("url")), p)), F.lit(False))
    return joined.filter(~barred).drop("__host", "disallowed")
