"""Queries over requests, companies, files and messages: filters, joins, aggregates, ranking, feeds."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from subjectlens.operators import relational as R
from subjectlens.plans.cases import EVENT_NOW, REQUEST_NOW, companies, files, messages, requests
from subjectlens.plans.registry import query

PENDING = ("action_required", "processing")


def _cased(t):
    return requests(t).join(companies(t), "company_id")


# ---------------------------------------------------------------- sources


@query("SELECT id, company_id, status, request_type, created_at FROM requests WHERE status = 'processing'")
def s01_table_read(t):
    """A table read with a parameterised statement."""
    requests(t).createOrReplaceTempView("requests_view")
    return t.spark.sql("SELECT id, company_id, status, request_type, created_at FROM requests_view WHERE status = :status", args={"status": "processing"})


@query("SELECT r.id, r.status, r.request_type, c.company_name, c.domain, r.created_at FROM requests r JOIN companies c USING (company_id)")
def p19_access_requests_view(t):
    """The access_requests projection, columns renamed."""
    return _cased(t).select("id", "status", "request_type", "company_name", "domain", "created_at")


# ---------------------------------------------------------------- filters


@query("""SELECT id, company_name, domain, status, created_at FROM requests JOIN companies USING (company_id)
WHERE (company_name ILIKE '%00012%' OR domain ILIKE '%00012%') AND status = 'completed'""")
def p01_request_search(t):
    """Search text in two columns and a status, each optional."""
    hit = R.contains_any("00012", "company_name", "domain")
    return _cased(t).filter(hit & (F.col("status") == "completed")).select("id", "company_name", "domain", "status", "created_at")


@query("SELECT request_id, line, file_name, status, category FROM files WHERE status = 'pending' OR (category IS NULL AND in_graph IS NULL)")
def p07_unprocessed_files(t):
    """By status, or all content columns null."""
    return files(t).filter((F.col("status") == "pending") | (F.col("category").isNull() & F.col("in_graph").isNull())).select("request_id", "line", "file_name", "status", "category")


@query("SELECT request_id, line, file_name FROM files WHERE status = 'completed' AND in_graph IS NOT TRUE")
def p08_not_in_graph(t):
    """Three-valued IS NOT TRUE."""
    return files(t).filter((F.col("status") == "completed") & ~F.col("in_graph").eqNullSafe(True)).select("request_id", "line", "file_name")


@query("SELECT company_id, company_name, domain FROM companies WHERE company_id IN (3, 5, 8, 13, 21, 34)")
def p09_members_of_list(t):
    return companies(t).filter(F.col("company_id").isin(3, 5, 8, 13, 21, 34)).select("company_id", "company_name", "domain")


@query(f"SELECT id, company_id, created_at FROM requests WHERE created_at > TIMESTAMP '{REQUEST_NOW}' - INTERVAL '3 months'")
def p10_recent_requests(t):
    """P10: newer than three months before the anchor."""
    return requests(t).filter(F.col("created_at") > F.lit(REQUEST_NOW).cast("timestamp") - F.expr("INTERVAL 3 MONTHS")).select("id", "company_id", "created_at")


@query("SELECT company_id, domain FROM companies WHERE domain ILIKE 'customer-000000007.example.com' OR domain ILIKE '%0000100%'")
def p11_domain_match(t):
    return companies(t).filter(F.col("domain").ilike("customer-000000007.example.com") | F.col("domain").ilike("%0000100%")).select("company_id", "domain")


@query("SELECT company_id, company_name, domain, segment FROM companies WHERE company_name = 'Customer#000000042' ORDER BY company_id LIMIT 1")
def p25_point_lookup(t):
    return R.top(companies(t).filter(F.col("company_name") == "Customer#000000042"), 1, F.col("company_id")).select("company_id", "company_name", "domain", "segment")


# ---------------------------------------------------------------- joins


@query("""SELECT company_name, round(sum(size_mb), 2) AS volume FROM requests r JOIN files f ON f.request_id = r.id JOIN companies USING (company_id)
GROUP BY company_name HAVING sum(size_mb) > 0 ORDER BY sum(size_mb) DESC, company_name LIMIT 5""")
def a03_volume_by_company(t):
    """Sums are made per request before the join, so files shuffle once, as partial sums."""
    size = files(t).groupBy("request_id").agg(F.sum("size_mb").alias("s"))
    by = requests(t).join(size, F.col("id") == F.col("request_id")).groupBy("company_id").agg(F.sum("s").alias("s"))
    by = by.join(companies(t), "company_id").groupBy("company_name").agg(F.sum("s").alias("s")).filter("s > 0")
    return R.top(by, 5, F.desc("s"), F.col("company_name")).select("company_name", F.round("s", 2).alias("volume"))


@query("""SELECT m.id, company_name, sender, ts FROM messages m JOIN requests r ON r.id = m.request_id JOIN companies USING (company_id)
ORDER BY ts DESC, m.id DESC LIMIT 5""")
def j02_latest_messages(t):
    """Messages with their request, the newest five. Each message has one request, so the limit can go first."""
    out = messages(t).withColumnRenamed("id", "message_id").join(requests(t).select("id", "company_id"), F.col("request_id") == F.col("id")).join(companies(t), "company_id")
    return R.top(out, 5, F.desc("ts"), F.desc("message_id")).select(F.col("message_id").alias("id"), "company_name", "sender", "ts")


@query("""SELECT m.id, m.request_id, company_name, m.content FROM messages m JOIN requests r ON r.id = m.request_id JOIN companies USING (company_id)
WHERE m.sender = 'purchase'""")
def j03_company_messages(t):
    """Messages that the company itself sent."""
    out = messages(t).filter("sender = 'purchase'").withColumnRenamed("id", "message_id").join(requests(t).select("id", "company_id"), F.col("request_id") == F.col("id"))
    return out.join(companies(t), "company_id").select(F.col("message_id").alias("id"), "request_id", "company_name", "content")


@query("""SELECT file_name, company_name, received_at, size_mb FROM files f JOIN requests r ON r.id = f.request_id JOIN companies USING (company_id)
ORDER BY received_at DESC, file_name, size_mb LIMIT 5""")
def j04_latest_files(t):
    out = files(t).join(requests(t).select("id", "company_id"), F.col("request_id") == F.col("id")).join(companies(t), "company_id")
    return R.top(out, 5, F.desc("received_at"), F.col("file_name"), F.col("size_mb")).select("file_name", "company_name", "received_at", "size_mb")


@query("SELECT f.request_id, f.line, f.file_name, r.status AS request_status FROM files f LEFT JOIN (SELECT * FROM requests WHERE status = 'completed') r ON r.id = f.request_id")
def j05_files_with_request(t):
    """Files keep their row when the request is missing."""
    r = requests(t).filter("status = 'completed'").select("id", F.col("status").alias("request_status"))
    return files(t).join(r, F.col("request_id") == F.col("id"), "left").select("request_id", "line", "file_name", "request_status")


@query("SELECT company_id, company_name FROM companies WHERE lower(company_name) IN (SELECT DISTINCT lower(company_name) FROM companies SEMI JOIN (SELECT * FROM requests WHERE status = 'processing') USING (company_id))")
def j06_contacted(t):
    """Companies already contacted, case-insensitively."""
    asked = companies(t).join(requests(t).filter("status = 'processing'"), "company_id", "left_semi").select(F.lower("company_name").alias("n"))
    return companies(t).join(asked, F.lower("company_name") == F.col("n"), "left_semi").select("company_id", "company_name")


@query("SELECT company_id, company_name FROM companies c WHERE NOT EXISTS (SELECT 1 FROM requests r WHERE r.company_id = c.company_id AND r.status = 'processing')")
def j07_not_contacted(t):
    return companies(t).join(requests(t).filter("status = 'processing'"), "company_id", "left_anti").select("company_id", "company_name")


@query("""
WITH o AS (SELECT CASE WHEN company_id % 13 = 0 THEN 'failed' WHEN company_id IN (SELECT company_id FROM requests) THEN 'sent' ELSE 'skipped' END AS outcome FROM companies)
SELECT count(*) FILTER (outcome = 'sent') AS sent, count(*) FILTER (outcome = 'failed') AS failed, count(*) FILTER (outcome = 'skipped') AS skipped FROM o""")
def a28_bulk_outcome(t):
    """Outcomes of a bulk mailing: sent, failed or skipped."""
    seen = requests(t).select("company_id").distinct().withColumn("seen", F.lit(True))
    outcome = F.when(F.col("company_id") % 13 == 0, "failed").when(F.col("seen"), "sent").otherwise("skipped")
    found = companies(t).join(seen, "company_id", "left").withColumn("outcome", outcome)
    return R.count_where(found, sent=F.col("outcome") == "sent", failed=F.col("outcome") == "failed", skipped=F.col("outcome") == "skipped")


@query("SELECT m.id, m.sender FROM messages m ANTI JOIN (SELECT id FROM messages WHERE content LIKE '%1%') r ON r.id = m.id")
def j25_unread(t):
    """Items not in the set of read ids."""
    return messages(t).join(messages(t).filter(F.contains("content", F.lit("1"))).select("id"), "id", "left_anti").select("id", "sender")


@query("""WITH policy AS (SELECT page_id, url, regexp_replace(url, '^https?://([^/?#]*).*$', '\\1') AS host FROM pages)
SELECT page_id, url, host, f.n_pages FROM policy LEFT JOIN (SELECT host, count(*) AS n_pages FROM policy WHERE url LIKE 'https%' GROUP BY host) f USING (host)""")
def j26_policy_by_domain(t):
    """Pages left joined to policies of the same domain. The disjunction with a URL test is split into equi joins."""
    pages = t.pages.select("page_id", "url", F.regexp_replace("url", r"^https?://([^/?#]*).*$", "$1").alias("host"))
    by = pages.filter(F.col("url").like("https%")).groupBy("host").agg(F.count("*").alias("n_pages"))
    return pages.join(by, "host", "left").select("page_id", "url", "host", "n_pages")


# ---------------------------------------------------------------- aggregates


@query("""SELECT count(*) AS total, count(*) FILTER (status IN ('action_required', 'processing')) AS pending, count(*) FILTER (status = 'completed') AS completed,
count(*) FILTER (request_type LIKE '%access%') AS access_requests, count(*) FILTER (request_type LIKE '%deletion%') AS deletion_requests FROM requests""")
def a01_request_totals(t):
    return R.count_where(
        requests(t), total=F.lit(True), pending=F.col("status").isin(*PENDING), completed=F.col("status") == "completed",
        access_requests=F.col("request_type").like("%access%"), deletion_requests=F.col("request_type").like("%deletion%"),
    )


@query("""SELECT count(*) AS total, count(*) FILTER (status IN ('scheduled', 'processing')) AS pending, count(*) FILTER (status = 'completed') AS completed,
count(*) FILTER (status = 'action_required') AS action_required FROM requests""")
def a02_status_counts(t):
    return R.count_where(requests(t), total=F.lit(True), pending=F.col("status").isin("scheduled", "processing"), completed=F.col("status") == "completed", action_required=F.col("status") == "action_required")


@query("SELECT round(coalesce(sum(size_mb), 0), 2) AS total_mb, count(*) AS n_files FROM files")
def a04_total_volume(t):
    return files(t).agg(F.round(F.coalesce(F.sum("size_mb"), F.lit(0.0)), 2).alias("total_mb"), F.count("*").alias("n_files"))


@query(f"""WITH days AS (SELECT CAST(unnest(generate_series(DATE '{EVENT_NOW}' - 6, DATE '{EVENT_NOW}', INTERVAL 1 DAY)) AS DATE) AS day)
SELECT strftime(day, '%Y-%m-%d') AS day, strftime(day, '%a') AS weekday, count(id) AS n FROM days LEFT JOIN messages ON CAST(ts AS DATE) = day GROUP BY day""")
def a06_week_timeline(t):
    """Counts of the last seven days; days without rows are there too."""
    days = R.days_filled(messages(t).withColumn("d0", F.to_date("ts")), "d0", EVENT_NOW, 7)
    return days.select(F.date_format("day", "yyyy-MM-dd").alias("day"), F.date_format("day", "E").alias("weekday"), "n")


@query("""SELECT company_name, count(*) AS n, CASE WHEN count(*) > 3 THEN 'high' WHEN count(*) > 1 THEN 'medium' ELSE 'low' END AS risk
FROM requests JOIN companies USING (company_id) GROUP BY company_name ORDER BY n DESC, company_name LIMIT 5""")
def a07_top_companies(t):
    by = requests(t).groupBy("company_id").agg(F.count("*").alias("c")).join(companies(t), "company_id").groupBy("company_name").agg(F.sum("c").alias("n"))
    risk = F.when(F.col("n") > 3, "high").when(F.col("n") > 1, "medium").otherwise("low")
    return R.top(by, 5, F.desc("n"), F.col("company_name")).withColumn("risk", risk)


@query("""WITH d AS (SELECT r.id, date_diff('day', created_at, done) - CASE WHEN CAST(done AS TIME) < CAST(created_at AS TIME) THEN 1 ELSE 0 END AS days
  FROM requests r JOIN (SELECT request_id, max(received_at) AS done FROM files GROUP BY request_id) f ON f.request_id = r.id WHERE status = 'completed' AND done >= created_at)
SELECT round(avg(days), 4) AS avg_days, CAST(min(days) AS BIGINT) AS min_days, count(*) FILTER (days > 30) AS late, count(*) AS n FROM d""")
def a08_response_days(t):
    """Days from creation to the last file of completed requests (the completion time is explicit here)."""
    done = files(t).groupBy("request_id").agg(F.max("received_at").alias("done"))
    d = requests(t).filter("status = 'completed'").join(done, F.col("id") == F.col("request_id")).filter("done >= created_at").withColumn("days", F.expr("extract(DAY FROM done - created_at)").cast("long"))
    return d.agg(F.round(F.avg("days"), 4).alias("avg_days"), F.min("days").alias("min_days"), F.count_if(F.col("days") > 30).alias("late"), F.count("*").alias("n"))


@query("""
WITH a AS (SELECT count(*) AS total, count(*) FILTER (status = 'completed') AS completed FROM requests),
h AS (SELECT least(5, count(DISTINCT company_id)) AS holders FROM requests),
s AS (SELECT least(100, greatest(0, floor(0.3 * least(100, greatest(0, 100 - 10 * holders)) + 0.7 * (completed / CASE WHEN total = 0 THEN 1
  ELSE total END * 100) + 0.5))) AS v FROM a, h)
SELECT CAST(v AS BIGINT) AS score, CASE WHEN v >= 80 THEN 'excellent' WHEN v >= 60 THEN 'good' WHEN v >= 40 THEN 'fair' ELSE 'poor' END AS label FROM s""")
def a09_privacy_score(t):
    """Score from holders and success, and its label. Halves round up."""
    a = requests(t).agg(F.count("*").alias("total"), F.count_if(F.col("status") == "completed").alias("completed"), F.least(F.lit(5), F.count_distinct("company_id")).alias("holders"))
    rate = F.col("completed") / F.greatest(F.col("total"), F.lit(1)) * 100
    clamp = lambda c: F.least(F.lit(100), F.greatest(F.lit(0), c))
    v = clamp(F.floor(0.3 * clamp(100 - 10 * F.col("holders")) + 0.7 * rate + 0.5))
    label = F.when(F.col("score") >= 80, "excellent").when(F.col("score") >= 60, "good").when(F.col("score") >= 40, "fair").otherwise("poor")
    return a.select(v.cast("long").alias("score")).withColumn("label", label)


@query("""
WITH d AS (SELECT request_type, epoch(done - created_at) / 86400 AS days FROM requests r JOIN (SELECT request_id, max(received_at) AS done FROM files
  GROUP BY request_id) f ON f.request_id = r.id WHERE done >= created_at),
m AS (SELECT request_type, count(*) FILTER (days <= 30) AS met, count(*) FILTER (days > 30) AS missed, avg(floor(days)) AS avg_days FROM d GROUP BY 1)
SELECT request_type, round(met * 100.0 / CASE WHEN met + missed = 0 THEN 1 ELSE met + missed END, 6)::DOUBLE AS compliance_rate, round(30 - avg_days,
  6) AS days_remaining FROM m""")
def a10_compliance(t):
    """A10: the share of deadlines met, and the days that the average answer leaves of thirty."""
    done = files(t).groupBy("request_id").agg(F.max("received_at").alias("done"))
    rows = requests(t).join(done, F.col("id") == F.col("request_id")).filter("done >= created_at")
    days = (F.unix_micros(F.col("done").cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))) / 86_400_000_000
    by = rows.withColumn("days", days).groupBy("request_type").agg(F.count_if(F.col("days") <= 30).alias("met"), F.count_if(F.col("days") > 30).alias("missed"), F.avg(F.floor("days")).alias("avg_days"))
    rate = F.col("met") * 100.0 / F.greatest(F.col("met") + F.col("missed"), F.lit(1))
    return by.select("request_type", F.round(rate, 6).alias("compliance_rate"), F.round(30 - F.col("avg_days"), 6).alias("days_remaining"))


@query("SELECT status, count(*) AS n FROM files GROUP BY status")
def a12_files_by_status(t):
    return files(t).groupBy("status").agg(F.count("*").alias("n"))


@query("""SELECT coalesce(category, 'other') AS category, count(*) AS n, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'pending') AS processing,
count(*) FILTER (status = 'error') AS error, count(*) FILTER (in_graph) AS synced FROM files GROUP BY 1""")
def a13_files_by_category(t):
    """Per category, null as other."""
    status = F.col("status")
    return R.count_where(files(t).withColumn("category", F.coalesce("category", F.lit("other"))), "category", n=F.lit(True), completed=status == "completed", processing=status == "pending", error=status == "error", synced=F.col("in_graph"))


@query("""SELECT (SELECT count(*) FROM messages) AS n_events, (SELECT count(*) FROM messages WHERE sender = 'error') AS n_errors,
(SELECT count(*) FROM files WHERE status = 'completed') AS files_done, (SELECT count(*) FROM files WHERE status = 'error') AS files_failed""")
def a29_activity(t):
    m = R.count_where(messages(t), n_events=F.lit(True), n_errors=F.col("sender") == "error")
    return m.crossJoin(R.count_where(files(t), files_done=F.col("status") == "completed", files_failed=F.col("status") == "error"))  # one row each


@query("SELECT round(sum(v), 2) AS total, count(*) AS n_companies FROM (SELECT company_id, sum(volume) AS v FROM requests GROUP BY company_id HAVING sum(volume) > 0)")
def a33_volume_of_holders(t):
    return requests(t).groupBy("company_id").agg(F.sum("volume").alias("v")).filter("v > 0").agg(F.round(F.sum("v"), 2).alias("total"), F.count("*").alias("n_companies"))


@query("""
SELECT field, filled FROM (
  SELECT 'request_id' AS field, count(request_id) AS filled FROM files UNION ALL SELECT 'line', count(line) FROM files UNION ALL SELECT 'file_name', count(*) FROM files
    WHERE trim(file_name) <> ''
  UNION ALL SELECT 'size_mb', count(size_mb) FROM files UNION ALL SELECT 'received_at', count(received_at) FROM files UNION ALL SELECT 'quantity', count(quantity)
    FROM files UNION ALL SELECT 'status', count(status) FROM files
  UNION ALL SELECT 'in_graph', count(in_graph) FROM files UNION ALL SELECT 'category', count(*) FROM files WHERE trim(category) <> '') ORDER BY filled DESC, field LIMIT 8""")
def a24_field_coverage(t):
    """Non-blank values per column, the fullest columns first."""
    return R.top(R.coverage(files(t), files(t).columns), 8, F.desc("filled"), F.col("field"))


@query("SELECT user_id % 20 AS bucket, count(*) AS n, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types FROM events GROUP BY 1 ORDER BY n DESC, bucket")
def a31_by_type(t):
    """Counts, most first, with the types that are present."""
    by = messages(t).groupBy((F.col("request_id") % 20).alias("bucket")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("sender")), ",").alias("types"))
    return by.orderBy(F.desc("n"), "bucket")


@query("""SELECT segment, count(*) AS n, CASE WHEN segment IN ('BUILDING', 'MACHINERY') THEN 'goods' ELSE 'other' END AS family, CAST(sum(count(*)) OVER () AS BIGINT) AS total,
CAST(sum(CASE WHEN segment IN ('BUILDING', 'MACHINERY') THEN count(*) ELSE 0 END) OVER () AS BIGINT) AS selected FROM companies GROUP BY segment""")
def a32_legend(t):
    """Nodes per type with its family, and totals overall and of the selected types."""
    goods = F.col("segment").isin("BUILDING", "MACHINERY")
    by = companies(t).groupBy("segment").agg(F.count("*").alias("n"))
    every = W.partitionBy()
    return by.withColumn("family", F.when(goods, "goods").otherwise("other")).withColumn("total", F.sum("n").over(every)).withColumn("selected", F.sum(F.when(goods, F.col("n")).otherwise(F.lit(0))).over(every))


@query("""
WITH b AS (SELECT status, 'e' || request_id || '-' || line AS error, (row_number() OVER (ORDER BY request_id, line, file_name, size_mb) - 1) // 5000 AS batch FROM files)
SELECT batch, count(*) AS executed, count(*) FILTER (status = 'error') AS errored, array_to_string((list(error
  ORDER BY error) FILTER (status = 'error'))[1:10], ',') AS errors FROM b GROUP BY batch""")
def a30_batches(t):
    """Rows in batches of a size, with totals and up to ten errors by batch."""
    order = [F.col(c) for c in ("request_id", "line", "file_name", "size_mb")]
    failed = F.col("status") == "error"
    error = F.when(failed, F.concat(F.lit("e"), "request_id", F.lit("-"), "line"))
    by = R.batched(files(t), 5000, *order).groupBy("batch")
    return by.agg(F.count("*").alias("executed"), F.count_if(failed).alias("errored"), F.array_join(F.slice(F.array_sort(F.collect_list(error)), 1, 10), ",").alias("errors"))


# ---------------------------------------------------------------- ranking, order, paging


@query("""WITH p AS (SELECT id, company_id, status, created_at, row_number() OVER (PARTITION BY company_id ORDER BY created_at DESC, id DESC) AS r FROM requests)
SELECT company_id, id, status, created_at FROM p WHERE r = 1 ORDER BY created_at DESC, company_id LIMIT 50""")
def w01_latest_per_company(t):
    """The newest of each key, then the newest fifty."""
    return R.top(R.latest_per(requests(t), "company_id", ["created_at", "id"], ["id", "status", "created_at"]), 50, F.desc("created_at"), F.col("company_id"))


@query("SELECT first_id, key FROM (SELECT lower(p_name) AS key, min(p_partkey) AS first_id FROM part GROUP BY 1)")
def w09_case_insensitive_dedup(t):
    """The first id of each name, whatever its case."""
    return t.part.groupBy(F.lower("p_name").alias("key")).agg(F.min("p_partkey").alias("first_id"))


@query("SELECT conv_id, string_agg(role, '>' ORDER BY turn) AS roles, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 5 GROUP BY conv_id")
def w17_last_messages(t):
    """The last five turns of each conversation as context."""
    last = R.ranked(t.conversations.select("conv_id", "turn", "role"), ["conv_id"], F.desc("turn")).filter("__rank <= 5")
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])
    return last.groupBy("conv_id").agg(F.array_join(turns, ">").alias("roles"), F.count("*").alias("n"))


@query("SELECT id, company_name, status, created_at FROM requests JOIN companies USING (company_id) ORDER BY company_name, id LIMIT 100")
def l01_sorted_requests(t):
    """Selectable order (here by name), the first hundred."""
    by = {"date": [F.desc("created_at"), F.col("id")], "name": [F.col("company_name"), F.col("id")], "status": [F.col("status"), F.col("id")]}
    return R.top(_cased(t), 100, *by["name"]).select("id", "company_name", "status", "created_at")


@query("""WITH n AS (SELECT company_id, company_name, domain, count(*) OVER () AS total FROM companies)
SELECT company_id, company_name, total, total > 150 AS has_more, CASE WHEN total > 150 THEN 150 END::BIGINT AS next_cursor FROM n
  ORDER BY company_name, company_id LIMIT 50 OFFSET 100""")
def l04_page(t):
    """Page 2 of 50 rows, with total, has_more and next_cursor."""
    return R.page(companies(t).select("company_id", "company_name"), 50, 2, F.col("company_name"), F.col("company_id"))


@query("SELECT file_name, category, received_at FROM files ORDER BY CASE WHEN category IS NULL THEN 1 ELSE 0 END, received_at DESC, file_name LIMIT 40")
def l05_content_first(t):
    return R.top(files(t), 40, F.col("category").isNull().cast("int"), F.desc("received_at"), F.col("file_name")).select("file_name", "category", "received_at")


@query("SELECT id, status, created_at FROM requests WHERE company_id = 7 AND id <> 7 ORDER BY created_at DESC, id LIMIT 10")
def l08_history(t):
    return R.top(requests(t).filter("company_id = 7 AND id <> 7"), 10, F.desc("created_at"), F.col("id")).select("id", "status", "created_at")


@query("SELECT id, sender, ts FROM messages ORDER BY ts DESC, id DESC LIMIT 50")
def l10_newest_fifty(t):
    return R.top(messages(t), 50, F.desc("ts"), F.desc("id")).select("id", "sender", "ts")


@query("""SELECT p_partkey, p_brand, CAST(regexp_extract(p_brand, '(\\d+)', 1) AS DOUBLE) AS version FROM part
ORDER BY version DESC, p_brand DESC, p_partkey LIMIT 30""")
def l12_version_sort(t):
    return R.top(t.part.select("p_partkey", "p_brand", F.regexp_extract("p_brand", r"(\d+)", 1).cast("double").alias("version")), 30, F.desc("version"), F.desc("p_brand"), F.col("p_partkey"))


@query("SELECT p_partkey, p_name FROM part ORDER BY len(p_name) DESC, p_name, p_partkey LIMIT 30")
def l13_longest_first(t):
    return R.top(t.part.select("p_partkey", "p_name"), 30, F.desc(F.length("p_name")), F.col("p_name"), F.col("p_partkey"))


# ---------------------------------------------------------------- feeds


@query("""WITH feed AS (
  SELECT 'request' AS source, CAST(id AS VARCHAR) AS ref, created_at AS happened_at, status AS label FROM requests
  UNION ALL SELECT 'file', file_name, received_at, status FROM files WHERE status <> 'pending'
  UNION ALL SELECT 'message', CAST(id AS VARCHAR), ts, upper(left(sender, 1)) || substr(sender, 2) FROM messages WHERE sender = 'error')
SELECT * FROM feed ORDER BY happened_at DESC, source, ref""")
def u02_activity_feed(t):
    """Three sources in one shape, newest first; pending files are left out."""
    a = requests(t).select(F.lit("request").alias("source"), F.col("id").cast("string").alias("ref"), F.col("created_at").alias("happened_at"), F.col("status").alias("label"))
    b = files(t).filter("status <> 'pending'").select(F.lit("file").alias("source"), F.col("file_name").alias("ref"), F.col("received_at").alias("happened_at"), F.col("status").alias("label"))
    c = messages(t).filter("sender = 'error'").select(F.lit("message").alias("source"), F.col("id").cast("string").alias("ref"), F.col("ts").alias("happened_at"), F.initcap(F.replace("sender", F.lit("_"), F.lit(" "))).alias("label"))
    return a.unionByName(b).unionByName(c).orderBy(F.desc("happened_at"), "source", "ref")


@query("""(SELECT 0 AS rank, 'message' AS source, CAST(id AS VARCHAR) AS ref, ts AS happened_at FROM messages ORDER BY ts DESC, id DESC LIMIT 10)
UNION ALL (SELECT 1, 'file', file_name, received_at FROM files ORDER BY received_at DESC, file_name LIMIT 5)""")
def u03_review_queue(t):
    """Ten messages, then five files."""
    m = R.top(messages(t).select("id", "ts"), 10, F.desc("ts"), F.desc("id")).select(F.lit(0).alias("rank"), F.lit("message").alias("source"), F.col("id").cast("string").alias("ref"), F.col("ts").alias("happened_at"))
    f = R.top(files(t).select("file_name", "received_at"), 5, F.desc("received_at"), F.col("file_name")).select(F.lit(1).alias("rank"), F.lit("file").alias("source"), F.col("file_name").alias("ref"), F.col("received_at").alias("happened_at"))
    return m.unionByName(f)


@query("SELECT company_id, company_name, string_agg(id, ',' ORDER BY id) AS request_ids, count(id) AS n FROM companies LEFT JOIN requests USING (company_id) GROUP BY company_id, company_name")
def j08_optional_collect(t):
    """Left outer and collect; companies without requests keep an empty list."""
    ids = requests(t).groupBy("company_id").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("request_ids"), F.count("*").alias("n"))
    return companies(t).join(ids, "company_id", "left").select("company_id", "company_name", "request_ids", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("""WITH s AS (SELECT r.id, r.status, company_name, domain, (SELECT count(*) FROM files f WHERE f.request_id = r.id) AS n_files,
(SELECT count(*) FROM files f WHERE f.request_id = r.id AND f.status = 'completed') AS n_done FROM requests r JOIN companies USING (company_id)) SELECT * FROM s""")
def r13_request_summary(t):
    """Request, company and file status in one row."""
    f = files(t).groupBy("request_id").agg(F.count("*").alias("n_files"), F.count_if(F.col("status") == "completed").alias("n_done"))
    out = _cased(t).join(f, F.col("id") == F.col("request_id"), "left")
    return out.select("id", "status", "company_name", "domain", F.coalesce("n_files", F.lit(0)).cast("long").alias("n_files"), F.coalesce("n_done", F.lit(0)).cast("long").alias("n_done"))


@query("SELECT request_id, line, file_name, status FROM files WHERE lower(file_name) LIKE '%file-12%' AND status = 'completed' ORDER BY received_at DESC, file_name LIMIT 20")
def r12_locate_file(t):
    hit = R.contains_any("FILE-12", "file_name") & (F.col("status") == "completed")
    return R.top(files(t).filter(hit), 20, F.desc("received_at"), F.col("file_name")).select("request_id", "line", "file_name", "status")
