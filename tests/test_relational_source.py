"""Tables by JDBC, from the embedded database that comes with Spark."""

import contextlib
import uuid

import pytest
from pyspark.sql import functions as F

from subjectlens.sources.relational_source import relational_table

DRIVER = "org.apache.derby.iapi.jdbc.AutoloadedDriver"
ROWS = [(k, f"name {k % 7}", k * 1.5) for k in range(1, 201)] + [(None, "no key", 0.5)]


@pytest.fixture(scope="module")
def url(spark):
    out = f"jdbc:derby:memory:d{uuid.uuid4().hex};create=true"
    frame = spark.createDataFrame(ROWS, "ID long, NAME string, AMOUNT double")
    try:
        for table, rows in (("REQUESTS", frame), ("NOTHING", frame.limit(0))):
            rows.coalesce(1).write.format("jdbc").options(url=out, driver=DRIVER, dbtable=table, createTableColumnTypes="NAME VARCHAR(50)").save()
    except Exception as e:
        if "ClassNotFound" in str(e):
            pytest.skip("Spark came without the database")
        raise
    yield out
    with contextlib.suppress(Exception):
        spark._jvm.java.sql.DriverManager.getConnection(out.replace("create", "drop"))


def test_ranges(spark, url):
    df = relational_table(spark, url, "REQUESTS", "ID", 4, driver=DRIVER)
    assert df.rdd.getNumPartitions() == 4 and {tuple(r) for r in df.collect()} == set(ROWS)
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 4 and max(sizes) <= 60
    assert {tuple(r) for r in relational_table(spark, url, "REQUESTS", driver=DRIVER).collect()} == set(ROWS)
    assert relational_table(spark, url, "NOTHING", "ID", 4, driver=DRIVER).collect() == []


def test_the_database_filters(spark, url):
    df = relational_table(spark, url, "REQUESTS", "ID", 4, driver=DRIVER)
    few = df.filter("AMOUNT > 290 and NAME = 'name 3'").select("ID")
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "AMOUNT" in plan.split("PushedFilters: [", 1)[1] and "Filter (" not in plan.replace("PushedFilters", "")
    assert {r.ID for r in few.collect()} == {k for k, n, a in ROWS if a > 290 and n == "name 3"}
