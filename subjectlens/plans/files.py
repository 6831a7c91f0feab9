"""Queries over files: whole texts, archives, contents by type, robots rules, exports, marked pages, vector points."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import functions as F

from subjectlens.functions.replies import grounded
from subjectlens.operators import relational as R
from subjectlens.operators.tables import fresh_path
from subjectlens.plans.cases import companies, edges, files, requests
from subjectlens.plans.registry import query
from subjectlens.sources import readers, writers

# ---------------------------------------------------------------- reading


@query("SELECT n_regionkey AS region, string_agg(n_name, chr(10) ORDER BY n_name) || chr(10) AS text FROM nation GROUP BY 1")
def s05_text_files(t):
    """Text files, one row each."""
    path = fresh_path(t.spark, "texts")
    t.nation.select(F.col("n_regionkey").alias("region"), "n_name").repartition("region").sortWithinPartitions("region", "n_name").write.partitionBy("region").text(path)
    found = readers.text_files(t.spark, f"{path}/region=*")
    return found.select(F.regexp_extract("path", r"region=(-?\d+)", 1).cast(t.nation.schema["n_regionkey"].dataType).alias("region"), "text")


@query("""
WITH f AS (SELECT page_id, html, CASE page_id % 3 WHEN 0 THEN 'html' WHEN 1 THEN 'json' ELSE 'pdf' END AS e FROM pages WHERE html IS NOT NULL)
SELECT 'p' || page_id || '.' || e AS path, e AS format, md5(left(html, 100000)) AS digest, CAST(len(html) AS INT) AS chars FROM f WHERE e <> 'pdf'""")
def s06_data_files(t):
    """Files of data formats as text."""
    k = F.col("page_id") % 3
    ending = F.when(k == 0, "html").when(k == 1, "json").otherwise("pdf")
    found = t.pages.filter("html is not null").select(F.concat(F.lit("p"), "page_id", F.lit("."), ending).alias("path"), F.encode("html", "UTF-8").alias("content"))
    return readers.data_files(found).select("path", "format", F.md5("text").alias("digest"), "chars")


def _archives(t):
    """An archive for each region: a directory and a file with its nations' names in each of four formats."""

    def run(batches):
        for b in batches:
            for region, names in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                    z.mkdir("data")
                    for i, e in enumerate(("txt", "svg", "3gp", "zip")):
                        z.writestr(f"data/names-{i}.{e}", "\n".join(names) * i)
                yield pa.RecordBatch.from_arrays([pa.array([f"region-{region}.zip"]), pa.array([out.getvalue()], pa.binary())], names=["path", "content"])

    by = t.nation.groupBy(F.col("n_regionkey").cast("long").alias("region")).agg(F.array_sort(F.collect_list("n_name")).alias("names"))
    packed = by.mapInArrow(run, "path string, content binary")
    return packed.unionByName(t.region.select(F.concat(F.lit("broken-"), "r_regionkey").alias("path"), F.encode("r_name", "UTF-8").alias("content")))


@query("""
WITH r AS (SELECT n_regionkey, string_agg(n_name, chr(10) ORDER BY n_name) AS names FROM nation GROUP BY 1)
SELECT 'region-' || n_regionkey || '.zip' AS path, 'data/names-' || i || '.' || ['txt', 'svg', '3gp', 'zip'][i + 1] AS name, CAST(len(names) * i AS BIGINT) AS size,
  ['document', 'image', 'video', 'other'][i + 1] AS category, CASE i WHEN 0 THEN 'text/plain' ELSE 'application/octet-stream' END AS mime, md5(repeat(names, i)) AS digest
FROM r, (SELECT unnest([0, 1, 2, 3]) AS i)""")
def s07_zip_members(t):
    """The members of ZIP archives; what is no archive has none."""
    return readers.zip_members(_archives(t)).select("path", "name", "size", "category", "mime", F.md5("content").alias("digest"))


@query("""
WITH f AS (SELECT page_id, html, ['pdf', 'image', 'spreadsheet', 'other', NULL][1 + page_id % 5] AS c FROM pages)
SELECT page_id AS id, md5(CASE WHEN page_id % 7 = 0 THEN 'known ' || page_id WHEN c IN ('pdf', 'image') THEN CASE WHEN page_id % 2 = 0 THEN 'reply ' || page_id END
  WHEN c = 'spreadsheet' THEN left(html, 50000) WHEN len(html) > 10 THEN left(html, 50000) END) AS digest FROM f""")
def s08_contents(t):
    """The text of files by media type."""
    k = F.col("page_id")
    category = F.when(k % 5 == 0, "pdf").when(k % 5 == 1, "image").when(k % 5 == 2, "spreadsheet").when(k % 5 == 3, "other")
    none = F.lit(None).cast("string")
    rows = t.pages.select(
        k.alias("id"), F.lit("f").alias("file_name"), category.alias("category"), F.encode("html", "UTF-8").alias("content"), F.lit("").alias("markdown_content"),
        F.when(k % 7 == 0, F.concat(F.lit("known "), k)).alias("extracted_text"), none.alias("transcript"), F.when(k % 2 == 0, F.concat(F.lit("reply "), k)).alias("reply"),
    )
    return readers.extracted(rows).select("id", F.md5("text").alias("digest"))


def _robots(t):
    text = F.concat(
        F.lit("User-agent: other\nDisallow: /all\n\nUser-Agent: *\nDisallow: /private"), F.col("r_regionkey"), F.lit("\nDisallow:\nCrawl-delay: soon\nCrawl-Delay: 1."), F.col("r_regionkey"),
        F.lit("\nUser-agent: x\nDisallow: /x\nuser-agent: ONSIT-crawler\n disallow: /Tmp "),
    )
    return t.region.select(F.concat(F.lit("host"), "r_regionkey").alias("host"), text.alias("text"))


@query("SELECT 'host' || r_regionkey AS host, '/private' || r_regionkey || ',/tmp' AS disallowed, CAST('1.' || r_regionkey AS DOUBLE) AS crawl_delay FROM region")
def s10_robots_rules(t):
    """The rules that apply to all agents or to the crawler's own name; the last delay that is a number."""
    return readers.robots_rules(_robots(t)).select("host", F.array_join("disallowed", ",").alias("disallowed"), "crawl_delay")


@query("""
WITH p AS (SELECT c_custkey, 'host' || (c_custkey % 7) AS host, ['/private1/a', '/tmp', '/', '', '/open?x=/tmp', '/private'][1 + c_custkey % 6] AS path FROM customer)
SELECT c_custkey, host FROM p WHERE NOT EXISTS (SELECT 1 FROM region WHERE p.host = 'host' || r_regionkey AND (starts_with(path, '/private' || r_regionkey)
  OR starts_with(path, '/tmp')))""")
def p18_allowed_pages(t):
    """Pages that the rules of their host allow; a host without rules allows all."""
    host = F.concat(F.lit("host"), F.col("c_custkey") % 7)
    path = F.element_at(F.array(*map(F.lit, ("/private1/a", "/tmp", "/", "", "/open?x=/tmp", "/private"))), (F.col("c_custkey") % 6 + 1).cast("int"))
    pages = t.customer.select("c_custkey", host.alias("host"), F.concat(F.lit("https://"), host, path).alias("url"))
    return readers.allowed(pages, readers.robots_rules(_robots(t))).select("c_custkey", "host")


@query("SELECT CAST(n_nationkey AS INT) AS id, n_name AS name FROM nation WHERE n_nationkey < 3")
def s16_seed_rows(t):
    """Rows that a new store begins with, here the first nations."""
    first = [(r.n_nationkey, r.n_name) for r in t.nation.filter("n_nationkey < 3").orderBy("n_nationkey").collect()]  # three rows
    return t.spark.createDataFrame(first, "id int, name string")


@query("""
SELECT o.s, o.p, o.o, o.confidence FROM edges o WHERE o.p = 'PART_OF' UNION ALL
SELECT s, 'SEEN_IN', o, confidence FROM edges WHERE p = 'LOCATED_IN' AND confidence > 0.9""")
def s04_statement_batch(t):
    """Several statements with parameters over one view, their results as one table."""
    edges(t).createOrReplaceTempView("edges_view")
    statements = (
        ("SELECT s, p, o, confidence FROM edges_view WHERE p = :p", {"p": "PART_OF"}),
        ("SELECT s, :name AS p, o, confidence FROM edges_view WHERE p = 'LOCATED_IN' AND confidence > :least", {"name": "SEEN_IN", "least": 0.9}),
    )
    parts = [t.spark.sql(sql, args=args) for sql, args in statements]
    return parts[0].unionByName(parts[1])


# ---------------------------------------------------------------- writing

CLASSES = tuple(writers.CLASS_COLORS)


def _spans(t):
    """A model's items for the texts of suppliers: found, found elsewhere than said, not found, of an unknown class, empty."""
    k = F.col("s_suppkey")
    text = F.concat(F.lit("We share <data> of "), "s_name", F.lit(' & keep\n"records" of '), "s_name", F.lit("."))
    item = lambda c, x, at, p=None: F.struct(F.lit(c).alias("class"), x.alias("text"), F.lit(at).alias("start_offset"), F.lit(p).cast("string").alias("confidence"))
    items = F.array(
        item("data_sharing", F.lit("share <data>"), "0"), item("third_party", F.col("s_name"), "999", "0.5"), item("legal_basis", F.lit("consent"), "x"),
        item("unheard", F.lit("We"), "0"), item("data_right", F.lit(""), "0"), item("personal_data", F.lit("data"), "3"),
    )
    found = F.filter(F.transform(items, lambda i: grounded(text, i, CLASSES)), lambda x: x.isNotNull())
    return t.supplier.select(k.alias("doc_id"), text.alias("text"), found.alias("found"))


_SPANS_SQL = """
d AS (SELECT s_suppkey AS doc_id, s_name, 'We share <data> of ' || s_name || ' & keep' || chr(10) || '"records" of ' || s_name || '.' AS text FROM supplier),
spans AS (
  SELECT doc_id, 'data_sharing' AS class, 'share <data>' AS part, 3 AS start, 15 AS stop, 0.8::DOUBLE AS confidence FROM d
  UNION ALL SELECT doc_id, 'third_party', s_name, 19, 19 + len(s_name), 0.5::DOUBLE FROM d
  UNION ALL SELECT doc_id, 'legal_basis', 'consent', 0, 7, 0.8::DOUBLE FROM d
  UNION ALL SELECT doc_id, 'personal_data', 'data', 10, 14, 0.8::DOUBLE FROM d)"""


@query(f"WITH {_SPANS_SQL} SELECT doc_id, class, part, CAST(start AS INT) AS start, CAST(stop AS INT) AS stop, confidence FROM spans")
def x24_grounded_entities(t):
    """A model's entities at the places where their texts stand."""
    return _spans(t).select("doc_id", F.explode("found").alias("x")).select("doc_id", "x.class", F.col("x.text").alias("part"), "x.start", F.col("x.end").alias("stop"), "x.confidence")


@query(f"""
WITH {_SPANS_SQL}
SELECT '{{"class":"' || class || '","text":"' || part || '","start_offset":' || start || ',"end_offset":' || stop || ',"source_document":"d' || doc_id || '","confidence":' || confidence || '}}' AS line FROM spans""")
def s11_json_lines(t):
    """Grounded entities as JSON lines, written and read back."""
    path = fresh_path(t.spark, "entities")
    rows = _spans(t).select("doc_id", F.explode("found").alias("x"))
    named = rows.select("x.class", "x.text", F.col("x.start").alias("start_offset"), F.col("x.end").alias("end_offset"), F.concat(F.lit("d"), "doc_id").alias("source_document"), "x.confidence")
    writers.json_lines(named, path)
    return t.spark.read.text(path).select(F.col("value").alias("line"))


@query("""
WITH f AS (SELECT s_suppkey AS id, CASE s_suppkey % 3 WHEN 0 THEN s_name WHEN 1 THEN s_name || ', Ltd' ELSE 'the "' || s_name || '"' END AS value FROM supplier
  WHERE s_suppkey % 28 + 1 BETWEEN 3 AND 20)
SELECT id || ',Email,' || CASE WHEN contains(value, ',') OR contains(value, '"') THEN '"' || replace(value, '"', '""') || '"'
  ELSE value END || ',scan,low,2024-01-' || lpad(CAST(id % 28 + 1 AS VARCHAR), 2, '0') AS line FROM f""")
def s12_csv_export(t):
    """Findings between two days as CSV lines, written and read back."""
    k = F.col("s_suppkey")
    value = F.when(k % 3 == 0, F.col("s_name")).when(k % 3 == 1, F.concat("s_name", F.lit(", Ltd"))).otherwise(F.concat(F.lit('the "'), "s_name", F.lit('"')))
    day = F.concat(F.lit("2024-01-"), F.lpad((k % 28 + 1).cast("string"), 2, "0"))
    found = t.supplier.select(
        k.alias("id"), F.lit("Email").alias("type"), value.alias("value"), F.lit("scan").alias("source"), F.lit("low").alias("riskLevel"), day.alias("discoveredAt"), F.lit("d1").alias("discovery"),
    )
    path = fresh_path(t.spark, "export")
    writers.csv_files(writers.export_rows(found, "d1", "2024-01-03", "2024-01-20"), path)
    return t.spark.read.text(path).select(F.col("value").alias("line"))


@query(f"""
WITH {_SPANS_SQL}
SELECT doc_id, '<span class="extraction legal_basis" title="legal_basis: ">consent</span><span class="extraction data_sharing" title="data_sharing: ">share &lt;data&gt;</span>'
  || '<span class="extraction personal_data" title="personal_data: ">data</span>&gt; of <span class="extraction third_party" title="third_party: ">' || s_name || '</span> &amp; keep<br>&quot;records&quot; of ' || s_name || '.' AS body
FROM d""")
def s13_marked_texts(t):
    """Texts with their entities marked. The first one was not found and is said to begin at 0: it takes the text's first letters' place."""
    docs = _spans(t)
    spans = docs.select("doc_id", F.explode("found").alias("x")).select("doc_id", "x.start", "x.end", "x.class", "x.text", F.lit("").alias("title"))
    pages = writers.marked_pages(docs.select("doc_id", "text"), spans)
    return pages.select("doc_id", F.regexp_extract("html", r'(?s)<div id="content">(.*)</div></body>', 1).alias("body"))


@query("""
WITH c AS (SELECT conv_id, turn, text, 'conv' || conv_id AS source FROM conversations)
SELECT source || '_' || turn AS id, source, CAST(turn AS INT) AS chunk_index, CAST(len(text) AS INT) AS end_offset, round(CAST(e.embedding[1] AS DOUBLE), 6) AS x
FROM c JOIN embeddings e ON e.vec_id = c.conv_id""")
def s15_vector_points(t):
    """Chunks with their vectors as points of a vector store."""
    chunks = t.conversations.join(t.embeddings.select("vec_id"), F.col("vec_id") == F.col("conv_id"), "left_semi")
    chunks = chunks.select(F.concat(F.lit("conv"), "conv_id").alias("source"), F.col("turn").cast("int").alias("chunk_index"), "text", F.lit(0).alias("start_offset"), F.length("text").alias("end_offset"), "conv_id")
    vectors = chunks.select("conv_id", "source", "chunk_index").join(t.embeddings, F.col("vec_id") == F.col("conv_id")).select("source", "chunk_index", "embedding")
    points = writers.vector_points(chunks.drop("conv_id"), vectors)
    return points.select("id", "source", "chunk_index", "end_offset", F.round(F.get("vector", F.lit(0)).cast("double"), 6).alias("x"))


@query("""
SELECT r.id, f.line, c.company_name, l.note FROM requests r JOIN companies c USING (company_id) JOIN files f ON f.request_id = r.id
LEFT JOIN (SELECT 'customer-' || lpad(CAST(k AS VARCHAR), 9, '0') || '.example.com' AS domain, 'breach ' || k AS note FROM range(1, 40) t(k)) l USING (domain) WHERE f.line = 1""")
def s17_lookups(t):
    """Records gathered elsewhere (names, breaches, profiles) joined to the cases by domain."""
    table = t.spark.range(1, 40).select(F.concat(F.lit("customer-"), F.lpad(F.col("id").cast("string"), 9, "0"), F.lit(".example.com")).alias("domain"), F.concat(F.lit("breach "), "id").alias("note"))
    rows = requests(t).join(companies(t), "company_id").join(files(t).filter("line = 1"), F.col("request_id") == F.col("id")).select("id", "line", "company_name", "domain")
    return R.lookup(rows, table, "domain").select("id", "line", "company_name", "note")


@query("""
WITH m AS (SELECT request_id, line, file_name FROM files WHERE line IN (1, 2)), x AS (SELECT DISTINCT request_id AS rid, 'export/' || file_name AS member FROM files WHERE line = 1)
SELECT request_id, line, member FROM m JOIN x ON rid = request_id AND contains(member, file_name)""")
def j24_files_to_members(t):
    """Files matched to the archive members whose path holds their name, within their request."""
    names = files(t).filter("line in (1, 2)").select("request_id", "line", "file_name")
    members = files(t).filter("line = 1").select(F.col("request_id").alias("rid"), F.concat(F.lit("export/"), "file_name").alias("member")).distinct()
    return names.join(members, (F.col("rid") == F.col("request_id")) & F.contains("member", F.col("file_name"))).select("request_id", "line", "member")


@query("""
WITH n AS (SELECT n_name AS node, n_nationkey AS k FROM nation)
SELECT 'node' AS kind, '{"id":"' || node || '","color":"#1f77b4","size":' || CAST(10 + k % 5 AS INT) || '}' AS line FROM n
UNION ALL SELECT 'link', '{"from":"' || s || '","to":"' || o || '","label":"' || p || '","dashes":' || CASE WHEN seq % 2 = 0 THEN 'true' ELSE 'false' END || '}'
  FROM edges WHERE p = 'PART_OF'""")
def s14_graph_page(t):
    """Nodes and links of a graph page as JSON; inferred links are dashed."""
    nodes = t.nation.select(F.col("n_name").alias("node"), F.lit("#1f77b4").alias("color"), (10 + F.col("n_nationkey") % 5).cast("int").alias("size"))
    return writers.graph_elements(nodes, edges(t).filter("p = 'PART_OF'").withColumn("inferred", F.col("seq") % 2 == 0))


@query("""
WITH p AS (SELECT page_id, html, ['text/html; charset=utf-8', 'application/xhtml+xml', 'image/png', 'TEXT/HTML', NULL][1 + page_id % 5] AS kind FROM pages)
SELECT page_id, CAST(len(html) AS INT) AS chars FROM p WHERE contains(kind, 'text/html') OR contains(kind, 'application/xhtml+xml')""")
def s09_fetched_pages(t):
    """Of fetched pages those whose content type is HTML."""
    kinds = ("text/html; charset=utf-8", "application/xhtml+xml", "image/png", "TEXT/HTML", None)
    kind = F.element_at(F.array(*[F.lit(k).cast("string") for k in kinds]), (F.col("page_id") % 5 + 1).cast("int"))
    return readers.html_pages(t.pages.withColumn("content_type", kind)).select("page_id", F.length("html").alias("chars"))
