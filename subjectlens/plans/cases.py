"""Case records (requests, companies, files, messages) and graph edges as views of the driver's tables.

Each frame has its twin in CASES_SQL, which every query's SQL starts with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What "now" means: queries never read the clock.
REQUEST_NOW, EVENT_NOW = "2001-08-01", "2024-01-30"
EXTENSIONS = ("pdf", "csv", "json", "png", "mp3", "zip", "txt")

CASES_SQL = """
requests AS (
  SELECT o_orderkey AS id, o_custkey AS company_id, o_totalprice AS volume, o_orderdate AS created_at,
         CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'processing' ELSE 'action_required' END AS status,
         CASE left(o_orderpriority, 1) WHEN '1' THEN 'data_access' WHEN '2' THEN 'data_deletion'
              WHEN '3' THEN 'access_and_deletion' ELSE 'rectification' END AS request_type
  FROM orders
), companies AS (
  SELECT c_custkey AS company_id, c_name AS company_name, lower(replace(c_name, '#', '-')) || '.example.com' AS domain,
         c_mktsegment AS segment, c_nationkey AS nation_id FROM customer
), files AS (
  SELECT l_orderkey AS request_id, l_linenumber AS line,
         'file-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '.'
         || ['pdf','csv','json','png','mp3','zip','txt'][l_linenumber] AS file_name,
         l_extendedprice AS size_mb, l_shipdate AS received_at, l_quantity AS quantity,
         CASE l_returnflag WHEN 'A' THEN 'completed' WHEN 'N' THEN 'pending' ELSE 'error' END AS status,
         CASE WHEN l_linestatus = 'F' THEN true WHEN l_linenumber > 5 THEN NULL ELSE false END AS in_graph,
         CASE l_linenumber WHEN 1 THEN 'document' WHEN 2 THEN 'data' WHEN 3 THEN 'data' WHEN 4 THEN 'image' WHEN 5 THEN 'audio'
              WHEN 6 THEN 'archive' END AS category
  FROM lineitem
), messages AS (
  SELECT event_id AS id, user_id AS request_id, event_type AS sender, props AS content, ts, value FROM events
), edges AS (
  SELECT s_name AS s, 'LOCATED_IN' AS p, n_name AS o, round(0.5 + (s_suppkey % 50) / 100.0, 2)::DOUBLE AS confidence, s_suppkey AS seq
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL
  SELECT n_name, 'PART_OF', r_name, 0.9::DOUBLE, 1000000000 + n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey
)"""


def requests(t) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "processing").otherwise("action_required")
    first = F.substring("o_orderpriority", 1, 1)
    kind = F.when(first == "1", "data_access").when(first == "2", "data_deletion").when(first == "3", "access_and_deletion").otherwise("rectification")
    return t.orders.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("company_id"), F.col("o_totalprice").alias("volume"),
        F.col("o_orderdate").alias("created_at"), status.alias("status"), kind.alias("request_type"),
    )


def companies(t) -> DataFrame:
    return t.customer.select(
        F.col("c_custkey").alias("company_id"), F.col("c_name").alias("company_name"),
        F.concat(F.lower(F.replace(F.col("c_name"), F.lit("#"), F.lit("-"))), F.lit(".example.com")).alias("domain"),
        F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation_id"),
    )


def files(t) -> DataFrame:
    line = F.col("l_linenumber")
    extension = F.element_at(F.array(*map(F.lit, EXTENSIONS)), line)
    status = F.when(F.col("l_returnflag") == "A", "completed").when(F.col("l_returnflag") == "N", "pending").otherwise("error")
    in_graph = F.when(F.col("l_linestatus") == "F", True).when(line > 5, F.lit(None)).otherwise(False)
    category = F.when(line == 1, "document").when(line.isin(2, 3), "data").when(line == 4, "image").when(line == 5, "audio").when(line == 6, "archive")
    return t.lineitem.select(
        F.col("l_orderkey").alias("request_id"), line.alias("line"),
        F.concat_ws("", F.lit("file-"), "l_orderkey", F.lit("-"), line, F.lit("-"), "l_partkey", F.lit("."), extension).alias("file_name"),
        F.col("l_extendedprice").alias("size_mb"), F.col("l_shipdate").alias("received_at"), F.col("l_quantity").alias("quantity"),
        status.alias("status"), in_graph.alias("in_graph"), category.alias("category"),
    )


def messages(t) -> DataFrame:
    return t.events.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("request_id"), F.col("event_type").alias("sender"),
        F.col("props").alias("content"), "ts", "value",
    )


def edges(t) -> DataFrame:
    """Triples (s, p, o, confidence, seq): suppliers in nations, nations in regions."""
    located = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_name").alias("s"), F.lit("LOCATED_IN").alias("p"), F.col("n_name").alias("o"),
        F.round(0.5 + (F.col("s_suppkey") % 50) / 100.0, 2).alias("confidence"), F.col("s_suppkey").alias("seq"),
    )
    part = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_name").alias("s"), F.lit("PART_OF").alias("p"), F.col("r_name").alias("o"),
        F.lit(0.9).alias("confidence"), (F.lit(1000000000) + F.col("n_nationkey")).cast("long").alias("seq"),
    )
    return located.unionByName(part)
