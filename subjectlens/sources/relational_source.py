"""Tables of a relational database, read in ranges of a key by many tasks at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Rows that the database sends at once.
FETCH_ROWS = 10_000


def relational_table(spark: SparkSession, url: str, table: str, key: str | None = None, partitions: int = 8, **options: str) -> DataFrame:
    """A table by JDBC. With a key (a number, day or time), the rows are read in `partitions` ranges of it, each a task and a query.

    The ends of the ranges come from one small query for the key's least and greatest value, which an index answers; rows
    without a key belong to the first range, rows beyond the ends to the first and last one. Filters that the
    database can do itself and the choice of columns are left to it. Without a key, or where no row has one, one task reads all.
    options: those of Spark's JDBC source, such as driver, user and password.
    """
    reader = spark.read.format("jdbc").options(url=url, fetchsize=str(FETCH_ROWS), **options)
    whole = reader.option("dbtable", table)
    if key is None or partitions <= 1:
        return whole.load()
    ends = spark.read.format("jdbc").options(url=url, **options).option("query", f'SELECT MIN("{key}") AS low, MAX("{key}") AS high FROM {table}').load().first()
    if ends[0] is None:
        return whole.load()
    return whole.option("partitionColumn", key).option("lowerBound", str(ends[0])).option("upperBound", str(ends[1])).option("numPartitions", str(partitions)).load()
