"""Queries over votes, vectors, search results, upserts, profiles and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from subjectlens.functions import text as X
from subjectlens.operators import merge as M
from subjectlens.operators import retrieval, validation
from subjectlens.operators import vector_cells as C
from subjectlens.operators.tables import fresh_path
from subjectlens.plans.cases import companies, edges, files, messages, requests
from subjectlens.plans.registry import query
from subjectlens.streaming import incremental, threads

# ---------------------------------------------------------------- votes

_VOTES_SQL = """votes AS (SELECT doc_id AS id, r AS round, a AS agent, CASE WHEN (doc_id + a * r) % 4 = 0 THEN NULL WHEN a % 2 = 0 AND quality = 1 OR (doc_id + a) % 3 = 0 THEN 'CORRECT' ELSE 'INCORRECT' END AS verdict
FROM labels, (SELECT unnest([1, 2, 3]) AS r), (SELECT unnest([1, 2, 3, 4]) AS a))"""


def _votes(t):
    grid = t.labels.select(F.col("doc_id").alias("id"), "quality", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("round")).select("id", "quality", "round", F.explode(F.array(*map(F.lit, (1, 2, 3, 4)))).alias("a"))
    a, i = F.col("a"), F.col("id")
    said = F.when(((a % 2 == 0) & (F.col("quality") == 1)) | ((i + a) % 3 == 0), "correct").otherwise("incorrect")
    reply = F.concat(F.lit("I think ```json {\"verdict\": \""), said, F.lit("\", \"confidence\": 8} ```"))
    votes = grid.filter((i + a * F.col("round")) % 4 != 0).select("id", "round", F.concat(F.lit("agent"), a).alias("agent"), validation.verdict_of(reply).alias("v"))
    return validation.complete_votes(votes.select("id", "round", "agent", F.col("v.verdict").alias("verdict")), ["agent1", "agent2", "agent3", "agent4"], 3)


@query(f"""WITH {_VOTES_SQL}, c AS (SELECT id, round, count(*) FILTER (verdict = 'CORRECT') AS y, count(*) FILTER (verdict = 'INCORRECT') AS n FROM votes GROUP BY 1, 2),
d AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY CASE WHEN y >= 3 OR n >= 3 THEN round ELSE 100 - round END) AS k FROM c)
SELECT id, CASE WHEN y > n THEN 'ACCEPT' WHEN n > y THEN 'REJECT' ELSE 'NEEDS_REVIEW' END AS decision, round FROM d WHERE k = 1""")
def v02_decisions(t):
    """Replies parsed, missing ones unknown, rounds until three agree."""
    return validation.decisions(_votes(t))


@query("""
SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'CORRECT' WHEN 1 THEN 'INCORRECT' ELSE 'UNKNOWN' END AS verdict, CASE p_partkey % 6 WHEN 0 THEN 7.5 WHEN 1 THEN 5
  WHEN 2 THEN 9 ELSE 5 END::DOUBLE AS confidence FROM part""")
def v01_verdicts(t):
    """Verdicts of replies: whole ones, without confidence, unheard ones, broken ones, with words for numbers, without JSON."""
    replies = (
        'I say {"verdict": "correct", "confidence": 7.5} so', '{"verdict": "Incorrect"}', '{"verdict": "perhaps", "confidence": 9}', '{"verdict": "CORRECT", "confidence": 8',
        '{"verdict": "CORRECT", "confidence": "high"}', "CORRECT",
    )
    reply = F.element_at(F.array(*map(F.lit, replies)), (F.col("p_partkey") % 6 + 1).cast("int"))
    return t.part.select(F.col("p_partkey").alias("id"), validation.verdict_of(reply).alias("v")).select("id", "v.verdict", "v.confidence")


@query(f"""
WITH {_VOTES_SQL}, c AS (SELECT id, round, count(*) FILTER (verdict = 'CORRECT') AS y, count(*) FILTER (verdict = 'INCORRECT') AS n FROM votes GROUP BY 1, 2),
d AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY CASE WHEN y >= 3 OR n >= 3 THEN round ELSE 100 - round END) AS k FROM c), e AS (SELECT id, y, n FROM d WHERE k = 1),
i AS (
  SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'High' ELSE 'HIGH RISK' END AS risk, CASE WHEN doc_id % 5 = 0 THEN 'sensitive data'
    WHEN doc_id % 5 = 1 THEN 'Inferred' ELSE 'CONTACT' END AS category,
    CASE WHEN doc_id % 7 = 0 THEN 'inference' ELSE 'email' END AS kind FROM labels
), r AS (SELECT *, risk = 'High' OR doc5 OR kind = 'inference' AS risky FROM (SELECT *, category <> 'CONTACT' AS doc5 FROM i))
SELECT id, risk, CASE WHEN NOT risky THEN 'not_required' WHEN id % 11 = 0 THEN 'not_configured' WHEN y > n THEN 'accepted' ELSE 'needs_review' END AS status FROM r
  JOIN e USING (id) WHERE NOT risky OR id % 11 = 0 OR NOT n > y""")
def v05_item_status(t):
    """Items by their decision where risk, category or type call for one; rejected ones are dropped."""
    k = F.col("doc_id")
    risk = X.choose((k % 3 == 0, "low"), (k % 3 == 1, "High"), otherwise="HIGH RISK")
    category = X.choose((k % 5 == 0, "sensitive data"), (k % 5 == 1, "Inferred"), otherwise="CONTACT")
    items = t.labels.select(k.alias("id"), risk.alias("risk"), category.alias("category"), F.when(k % 7 == 0, "inference").otherwise("email").alias("kind"))
    decided = validation.decisions(_votes(t)).filter("id % 11 <> 0")
    return validation.with_status(items, decided).select("id", "risk", "status")


# ---------------------------------------------------------------- retrieval


_NEAREST_SQL = """v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL
  AND list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) > 0),
q AS (SELECT row_number() OVER () AS r, vec_id AS query_id, e FROM v WHERE vec_id % 100 = 0), s AS (SELECT r, query_id, v.vec_id, label, round(list_cosine_similarity(v.e,
  q.e), 9) AS score FROM v, q)"""


def _asked(t):
    """The query vectors: every one whose id is divisible by 100."""
    return t.embeddings.filter("vec_id % 100 = 0")


@query(f"""WITH {_NEAREST_SQL} SELECT query_id, vec_id, label, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY r ORDER BY s.score DESC, s.vec_id) AS INT) AS rank
FROM s QUALIFY rank <= 10""")
def r01_vector_search(t):
    """The ten nearest to each query vector, with their labels and ranks."""
    found = C.nearest_of_each(_asked(t), t.embeddings, 10).join(t.embeddings.select("vec_id", "label"), "vec_id")
    return found.select("query_id", "vec_id", "label", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {_NEAREST_SQL} SELECT query_id, vec_id, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY r ORDER BY s.score DESC, s.vec_id) <= 10")
def r02_vector_searches(t):
    """The ten nearest to every vector whose id is divisible by 100."""
    return C.nearest_of_each(_asked(t), t.embeddings, 10).select("query_id", "vec_id", F.round("score", 6).alias("score"))


@query(f"WITH {_NEAREST_SQL} SELECT query_id, vec_id, round(score, 6) AS score FROM s WHERE s.score >= 0.5 QUALIFY row_number() OVER (PARTITION BY r ORDER BY s.score DESC, s.vec_id) <= 8")
def p15_vector_threshold(t):
    """The hits of each query vector from a score on."""
    return C.nearest_of_each(_asked(t), t.embeddings, 8, 0.5).select("query_id", "vec_id", F.round("score", 6).alias("score"))


_RESULTS_SQL = """results AS (SELECT 'nation ' || n_name AS content, 0.8::DOUBLE AS score, n_nationkey AS seq, 'graph' AS source FROM nation UNION ALL SELECT 'nation ' || n_name, 0.5::DOUBLE, 1000 + n_nationkey, 'vector' FROM nation
UNION ALL SELECT 'region ' || r_name, 0.9::DOUBLE, 2000 + r_regionkey, 'documents' FROM region)"""


def _results(t):
    row = lambda df, text, score, seq, source: df.select(text.alias("content"), F.lit(score).alias("score"), seq.cast("int").alias("seq"), F.lit(source).alias("source"))
    n = F.concat(F.lit("nation "), F.col("n_name"))
    return row(t.nation, n, 0.8, F.col("n_nationkey"), "graph").unionByName(row(t.nation, n, 0.5, 1000 + F.col("n_nationkey"), "vector")).unionByName(row(t.region, F.concat(F.lit("region "), "r_name"), 0.9, 2000 + F.col("r_regionkey"), "documents"))


@query(f"""WITH {_RESULTS_SQL}, f AS (SELECT * FROM results QUALIFY row_number() OVER (PARTITION BY left(content, 100) ORDER BY score DESC, seq) = 1
  ORDER BY score DESC, seq LIMIT 20)
SELECT content, score, seq, source FROM f""")
def r04_fused(t):
    """Results of several searches, each content once."""
    return retrieval.fused(_results(t))


# ---------------------------------------------------------------- upserts


@query("""SELECT id, CASE WHEN id % 10 = 0 THEN 'closed' ELSE status END AS status, created_at FROM requests WHERE id % 10 <> 1 UNION ALL
  SELECT id, 'closed', created_at FROM requests WHERE id % 10 = 1""")
def m01_upsert(t):
    """Changed rows replace, new rows are added."""
    r = requests(t).select("id", "status", "created_at")
    return M.upsert(r.filter("id % 10 <> 1"), r.filter("id % 10 in (0, 1)").withColumn("status", F.lit("closed")), ["id"])


@query("""SELECT id, CASE WHEN id % 10 = 1 THEN 'closed' ELSE status END AS status FROM requests""")
def m02_insert_missing(t):
    r = requests(t).select("id", "status")
    return M.insert_missing(r.filter("id % 10 <> 1"), r.filter("id % 10 in (0, 1)").withColumn("status", F.lit("closed")), ["id"])


@query("""SELECT request_id, line, file_name FROM files WHERE request_id % 10 <> 0 UNION ALL SELECT DISTINCT request_id, 0, 'again' FROM files WHERE request_id % 10 = 0""")
def m04_replace_artifacts(t):
    f = files(t).select("request_id", "line", "file_name")
    return M.replace_groups(f, f.filter("request_id % 10 = 0").select("request_id", F.lit(0).alias("line"), F.lit("again").alias("file_name")).distinct(), "request_id")


@query("""SELECT company_id, company_name, CASE WHEN company_id % 4 = 0 THEN 'seen' ELSE domain END AS domain, CASE WHEN company_id % 2 = 0 THEN segment
  ELSE 'new' END AS segment FROM companies""")
def m05_merge_node(t):
    """A match changes only some columns, and fills those that were null."""
    c = companies(t).select("company_id", "company_name", "domain", F.when(F.col("company_id") % 2 == 0, F.col("segment")).alias("segment"))
    delta = c.withColumn("company_name", F.lit("other")).withColumn("domain", F.when(F.col("company_id") % 4 == 0, "seen").otherwise(F.col("domain"))).withColumn("segment", F.lit("new"))
    return M.merge_node(c, delta, ["company_id"], ["domain"], ["segment"])


@query("SELECT request_id, line, file_name FROM files WHERE request_id % 5 <> 0")
def m12_cascade_delete(t):
    ids = requests(t).filter("id % 5 = 0").select("id")
    return M.cascade_delete(ids, files=(files(t).select("request_id", "line", "file_name"), "request_id"))["files"]


@query("SELECT id, CASE WHEN id % 10 = 0 THEN 'closed' ELSE status END AS status, volume FROM requests")
def m13_update_present(t):
    """M13, M17."""
    r = requests(t).select("id", "status", "volume")
    return M.update_present(r, r.filter("id % 10 = 0").select("id", F.lit("closed").alias("status"), F.lit(None).cast("double").alias("volume")), ["id"])


@query("SELECT request_id AS thread, arg_max(sender, (ts, id)) AS status, count(*) AS n, string_agg(sender, '>' ORDER BY ts, id) AS history FROM messages GROUP BY 1")
def m15_thread_states(t):
    """A fold over each thread's events."""
    return M.thread_states(messages(t).select(F.col("request_id").alias("thread"), "ts", F.col("id").alias("seq"), F.col("sender").alias("action")))


@query("""
WITH c AS (SELECT company_id, CASE WHEN company_id % 3 = 0 THEN NULL WHEN company_id % 3 = 1 THEN [segment, 'old'] ELSE ['vip', segment] END AS tags FROM companies)
SELECT company_id, array_to_string([x FOR x IN CASE WHEN tags IS NULL THEN ['vip'] WHEN list_contains(tags, 'vip') THEN tags
  ELSE list_append(tags, 'vip') END IF x <> 'old'], ',') AS tags FROM c""")
def u09_tags(t):
    """A tag added where it is not there yet, another removed."""
    k, segment = F.col("company_id"), F.col("segment")
    old = F.when(k % 3 == 1, F.array(segment, F.lit("old"))).when(k % 3 == 2, F.array(F.lit("vip"), segment))
    tags = F.array_remove(F.array_union(F.coalesce(old, F.array().cast("array<string>")), F.array(F.lit("vip"))), "old")
    return companies(t).select("company_id", F.array_join(tags, ",").alias("tags"))


# ---------------------------------------------------------------- profiles


@query("""SELECT doc_id, CAST(len(left(text, 120000)) AS INT) AS chars, CAST(len(regexp_extract_all(left(text, 120000), '\\S+')) AS INT) AS words FROM documents""")
def c01_metrics(t):
    """The feature itself reads a file's first 120 000 characters."""
    text = F.left("text", F.lit(120_000))
    return t.documents.select("doc_id", F.length(text).alias("chars"), F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")).alias("words"))


# ---------------------------------------------------------------- streams


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS n FROM messages GROUP BY 1")
def st8_daily_timeline(t):
    """ST8, A05: rows per day by event-time windows; the same function runs on a stream with a watermark."""
    return incremental.daily_timeline(messages(t).select(F.col("ts").cast("timestamp").alias("ts"))).select(F.col("day"), "n")


@query("SELECT request_id, CAST(sum(value > 5) AS BIGINT) AS n FROM messages GROUP BY 1")
def st1_incremental_scan(t):
    """ST1: the events as a stream of files, handled batch by batch and added up by key."""
    base = fresh_path(t.spark, "scan")
    stream = t.spark.readStream.schema(t.events.schema).option("maxFilesPerTrigger", 1).parquet(f"{t.folder}/events.parquet*")

    def each(batch, number):
        batch.groupBy(F.col("user_id").alias("request_id")).agg(F.count_if(F.col("value") > 5).alias("n")).write.mode("overwrite").parquet(f"{base}/batch={number}")

    incremental.run_available(stream, f"{base}-state", each)
    return t.spark.read.parquet(base).groupBy("request_id").agg(F.sum("n").alias("n"))


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS n FROM messages GROUP BY 1")
def st8_streamed_timeline(t):
    """ST8: the timeline as a stream with a watermark; days are written once they are closed, the last ones at the end of the data."""
    base = fresh_path(t.spark, "days")
    stream = t.spark.readStream.schema(t.events.schema).parquet(f"{t.folder}/events.parquet*")
    days = incremental.daily_timeline(stream.select(F.col("ts").cast("timestamp").alias("ts")))
    incremental.run_updates(days, f"{base}-state", ["day"], base)
    return t.spark.read.parquet(f"{base}/*").groupBy("day").agg(F.max("n").alias("n"))


@query("SELECT request_id AS thread, arg_max(sender, (ts, id)) AS status, count(*) AS n FROM messages GROUP BY 1")
def st9_streamed_threads(t):
    """ST9: thread states kept by key while events stream in; each batch reads and writes its own threads only."""
    base = fresh_path(t.spark, "threads")
    stream = t.spark.readStream.schema(t.events.schema).parquet(f"{t.folder}/events.parquet*")
    events = stream.select(F.col("user_id").alias("thread"), "ts", F.col("event_id").alias("seq"), F.col("event_type").alias("action"))
    threads.keep_threads(events, f"{base}-state", base)
    return threads.threads_now(t.spark.read.parquet(base)).select(F.col("thread").cast(t.events.schema["user_id"].dataType).alias("thread"), "status", "n")


@query("""WITH l AS (SELECT lower(s) AS src, lower(o) AS dst FROM edges), a AS (SELECT DISTINCT lower(s_name) AS url FROM supplier), b AS (SELECT DISTINCT dst AS url
  FROM l JOIN a ON src = url), c AS (SELECT DISTINCT dst AS url FROM l JOIN b ON src = url)
SELECT url, 0 AS depth FROM a UNION ALL SELECT url, 1 FROM b WHERE url NOT IN (SELECT url FROM a) UNION ALL SELECT url, 2 FROM c WHERE url NOT IN (SELECT url FROM b)
  AND url NOT IN (SELECT url FROM a)""")
def st3_frontier(t):
    """ST3, ST4: what can be reached in two steps."""
    return incremental.frontier(edges(t).select(F.lower("s").alias("src"), F.lower("o").alias("dst")), t.supplier.select(F.lower("s_name").alias("url")), 2)
