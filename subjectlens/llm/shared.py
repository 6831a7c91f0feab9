"""What the corpus operators share: tables in the shared folder, byte-wise text rules, small numpy helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts define it.
SPACE = r"[\x20\x09-\x0D]"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, a local one if all tasks run in this process."""
    if not (found := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.conf.set("spark.checkpoint.dir", found := f"file://{tempfile.mkdtemp(prefix='corpus-')}")
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back: later steps start from files that outlive any executor."""
    spark = df.sparkSession
    df.write.parquet(path := fresh_path(spark, name), compression=codec)
    return spark.read.schema(df.schema).parquet(path)


#: Keys with more than 1 / PIECES of all rows are cut into pieces, so there are fewer than PIECES of them.
PIECES = 256


def salted_join(left: DataFrame, right: DataFrame, on: list[str], spread: list[str], size: str, total: int) -> DataFrame:
    """left joined to right, which has one row for each key with its number of rows on the left in `size`; total: all rows on the left.

    A key with many rows is dealt out by a hash of the columns `spread`, and its row on the right is repeated for each
    piece. Only the keys that are cut are broadcast, fewer than PIECES of them.
    """
    pieces = F.greatest(F.lit(1), F.ceil(F.col(size) * PIECES / F.lit(max(1, total)))).cast("int")
    cut = F.broadcast(right.select(*on, pieces.alias("__pieces")).filter("__pieces > 1"))
    dealt = left.join(cut, on, "left").withColumn("__piece", F.pmod(F.xxhash64(*spread), F.coalesce("__pieces", F.lit(1))).cast("int")).drop("__pieces")
    copies = right.withColumn("__piece", F.explode(F.sequence(F.lit(0), pieces - 1)))
    return dealt.join(copies, [*on, "__piece"]).drop("__piece")


def text_of(column: str = "text"):
    """The text, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def need(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns; a table with further columns, whatever their names, gives the same result."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*columns)


def by_bytes(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose texts add up to about so many bytes, or of one row."""
    total = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)) if batch.num_rows else np.empty(0)
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + most, side="right")))
        yield batch.slice(i, j - i)
        i = j
