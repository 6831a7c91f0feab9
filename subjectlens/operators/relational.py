"""Relational building blocks: conditional counts, ranking, paging, search, gap-filled days, budgets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from subjectlens.operators.tables import written


def count_where(df: DataFrame, *by: str, **conditions: Column) -> DataFrame:
    """One pass over df: a count per named condition (nulls don't count), by group if `by` is given."""
    counts = [F.count_if(c).alias(name) for name, c in conditions.items()]
    return df.groupBy(*by).agg(*counts) if by else df.agg(*counts)


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows in a total order; each task keeps n rows at most."""
    return df.orderBy(*order).limit(n)


def first_per(df: DataFrame, keys: Sequence[str | Column], *order: Column) -> DataFrame:
    """One row per key: the first in order."""
    return ranked(df, keys, *order).filter("__rank = 1").drop("__rank")


def ranked(df: DataFrame, keys: Sequence[str | Column], *order: Column, name: str = "__rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))


def latest_per(df: DataFrame, key: str, by: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Of each key the values of the row with the largest `by`: an aggregate with partial maxima, no sort of groups."""
    best = F.max_by(F.struct(*keep), F.struct(*by)).alias("__best")
    return df.groupBy(key).agg(best).select(key, *[F.col(f"__best.{c}").alias(c) for c in keep])


def contains_any(needle: str, *columns: str) -> Column:
    """Case-insensitive substring in any of the columns; null columns don't match."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.contains(F.lower(F.col(c)), F.lit(needle.lower())), F.lit(False))
    return out


def page(df: DataFrame, size: int, number: int, *order: Column, most: int = 500) -> DataFrame:
    """Rows of one page (from 0) with total, has_more and next_cursor. size is held at `most`."""
    size = min(size, most)
    total = df.agg(F.count("*").alias("total"))
    shown = df.orderBy(*order).offset(size * number).limit(size)
    after = F.col("total") > size * (number + 1)
    return shown.join(F.broadcast(total)).withColumn("has_more", after).withColumn("next_cursor", F.when(after, F.lit(size * (number + 1)).cast("long")))


def days_filled(df: DataFrame, day: str, end: str, days: int, count: str = "n") -> DataFrame:
    """One row for each of the `days` days up to end, with the number of df's rows; 0 where there are none."""
    spark = df.sparkSession
    calendar = spark.range(1).select(F.explode(F.sequence(F.date_sub(F.lit(end).cast("date"), days - 1), F.lit(end).cast("date"))).alias("day"))
    found = df.filter(F.col(day).between(F.date_sub(F.lit(end).cast("date"), days - 1), F.lit(end).cast("date"))).groupBy(F.col(day).alias("d")).agg(F.count("*").alias(count))
    return calendar.join(F.broadcast(found), F.col("day") == F.col("d"), "left").select("day", F.coalesce(count, F.lit(0)).cast("long").alias(count))


def budgeted(df: DataFrame, size: Column, most: int, *order: Column) -> DataFrame:
    """The first rows in order whose sizes add up to at most `most`. For result lists, which are short: one sorted pass."""
    total = F.sum(size).over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return df.withColumn("__total", total).filter(F.col("__total") <= most).drop("__total")


def batched(df: DataFrame, size: int, *order: Column) -> DataFrame:
    """Adds batch: rows in order, `size` at a time, numbered by sorted partitions so no task sees all rows.

    The sorted rows are written before they are counted, so both uses see the same partitions.
    """
    cut = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id())
    cut = written(cut, "batches")
    starts = cut.groupBy("__part").agg(F.count("*").alias("__n"))
    starts = starts.select("__part", F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = F.row_number().over(W.partitionBy("__part").orderBy("__at")) - 1
    out = cut.join(F.broadcast(starts), "__part").withColumn("batch", F.floor((F.col("__before") + inside) / size).cast("long"))
    return out.drop("__part", "__at", "__before")


def coverage(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(field, filled): non-blank values per column, in one pass."""
    counts = df.agg(*[F.count_if(F.trim(F.col(c).cast("string")) != "").alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("filled")) for c in columns])
    return counts.select(F.explode(pairs).alias("x")).select("x.field", "x.filled")


def aggregated(results: DataFrame, key: str) -> DataFrame:
    """(key, articles, findings, n_sources, compliance) of results(key, seq, articles, findings).

    Articles are sorted and distinct; findings are distinct in the order in which they come; each finding costs ten points of a hundred.
    """
    articles = F.array_sort(F.array_distinct(F.flatten(F.collect_list("articles"))))
    findings = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seq", "findings"))), lambda x: x["findings"])))
    by = results.groupBy(key).agg(articles.alias("articles"), findings.alias("findings"), F.count("*").alias("n_sources"))
    return by.withColumn("compliance", F.greatest(F.lit(0), 100 - 10 * F.size("findings")))


def lookup(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Rows left joined to a lookup table (records of names, addresses or breaches) that was gathered elsewhere."""
    return rows.join(table, key, "left")
