"""Named queries: each takes the tables of a folder and returns a DataFrame; its SQL, if any, says the same for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from subjectlens.plans.cases import CASES_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The Parquet tables of one folder by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def with_cases(sql: str) -> str:
    sql = sql.strip()
    if sql[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {CASES_SQL}, {sql[15:].lstrip()}"
    return f"WITH {CASES_SQL}, {sql[4:].lstrip()}" if sql[:5].upper() == "WITH " else f"WITH {CASES_SQL} {sql}"


def query(sql: str | None = None):
    def add(f: Callable[[Tables], DataFrame]):
        if f.__name__ in QUERIES:
            raise ValueError(f"two queries named {f.__name__}")
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[f.__name__] = with_cases(sql)
        return f

    return add
