"""Queries that search nodes, edges and documents, and put contexts together."""

from __future__ import annotations

from pyspark.sql import functions as F

from subjectlens.functions.text import topic_articles
from subjectlens.operators import chunking, retrieval, trigrams
from subjectlens.operators import relational as R
from subjectlens.plans.cases import companies, edges, files
from subjectlens.plans.registry import query

#: Nations and suppliers as nodes with properties, and their edges.
NODES_SQL = """nodes AS (
  SELECT 'n' || n_nationkey AS id, 'Company' AS label, n_name AS name, '{"name":"' || n_name || '"}' AS shown, n_name || '|' || 'Region ' || n_regionkey AS hay,
    '{"name":"' || n_name || '","region":"Region ' || n_regionkey || '"}' AS props FROM nation
  UNION ALL SELECT 's' || s_suppkey, 'Account', s_name, '', s_name, '{"username":"' || s_name || '"}' FROM supplier
), links AS (
  SELECT 's' || s_suppkey AS src, 'n' || s_nationkey AS dst, 'HELD_BY' AS type, s_suppkey AS seq FROM supplier
)"""


def _nodes(t):
    label = lambda x: F.array(F.lit(x))
    nations = t.nation.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), label("Company").alias("labels"), F.create_map(F.lit("name"), F.col("n_name"), F.lit("region"), F.concat(F.lit("Region "), "n_regionkey"), F.lit("embedding"), F.lit("nation_1")).alias("props"))
    accounts = t.supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("id"), label("Account").alias("labels"), F.create_map(F.lit("username"), F.col("s_name")).alias("props"))
    return nations.unionByName(accounts)


def _links(t):
    return t.supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("src"), F.concat(F.lit("n"), "s_nationkey").alias("dst"), F.lit("HELD_BY").alias("type"), F.col("s_suppkey").alias("seq"))


@query(f"""
WITH {NODES_SQL}, k AS (SELECT *, CASE WHEN contains(lower(hay), 'nation_1') THEN 0 END AS a, CASE WHEN contains(lower(hay), 'region') THEN 1 END AS b FROM nodes),
h AS (SELECT id, label, name, props, a AS i FROM (SELECT * FROM k WHERE a IS NOT NULL ORDER BY id LIMIT 8) UNION ALL SELECT id, label, name, props, b FROM (SELECT *
  FROM k WHERE b IS NOT NULL ORDER BY id LIMIT 8))
SELECT 'graph' AS source, label AS type, name AS title, props AS content, 0.7::DOUBLE AS score FROM h QUALIFY row_number() OVER (PARTITION BY id ORDER BY i) = 1""")
def r06_graph_search(t):
    """Nodes that hold one of the first three long words, each once."""
    return retrieval.graph_search(_nodes(t), _links(t), "is nation_1 Region", k=8)


@query(f"""
WITH {NODES_SQL}, few AS (SELECT count(*) AS n FROM nodes WHERE contains(lower(hay), 'supplier#000000007'))
SELECT 'graph' AS source, label AS type, name AS title, props AS content, 1.0::DOUBLE AS score FROM nodes WHERE contains(lower(hay), 'supplier#000000007')
UNION ALL SELECT * FROM (SELECT 'graph', 'Relationship', a.name || ' —[' || l.type || ']→ ' || b.name,
  'Account (' || a.props || ') -[' || l.type || ']-> Company ({{"embedding":"nation_1",' || substr(b.props, 2) || ')', 0.5::DOUBLE
  FROM links l JOIN nodes a ON a.id = l.src JOIN nodes b ON b.id = l.dst, few WHERE few.n < 5 AND contains(lower(a.hay), 'supplier#000000007') ORDER BY l.seq LIMIT 10)""")
def r06_graph_search_edges(t):
    """Where few nodes are found, edges of those that hold the word; a word that is the whole question scores full."""
    return retrieval.graph_search(_nodes(t), _links(t), "Supplier#000000007")


@query(f"""
WITH {NODES_SQL}, b AS (SELECT src, dst, type FROM links UNION ALL SELECT dst, src, type FROM links),
x AS (SELECT w AS keyword, n.id, b.type AS relationship, b.dst AS connected FROM nodes n LEFT JOIN b ON b.src = n.id, (SELECT unnest(['nation_2', 'region']) AS w)
  WHERE contains(lower(n.hay), w))
SELECT keyword, id, relationship, connected, 0.8::DOUBLE AS score FROM x QUALIFY row_number() OVER (PARTITION BY keyword ORDER BY id, connected NULLS FIRST, relationship) <= 10""")
def r03_expanded_search(t):
    """Nodes by keyword with their neighbours; each keyword brings a third of the rows."""
    return retrieval.expanded_search(_nodes(t), _links(t), "what is in NATION_2 of Region?", 30)


def _searched(t):
    """Files with texts: every third has a summary, every second a transcript."""
    k = F.col("doc_id")
    return t.documents.select(
        k.alias("id"), F.concat(F.lit("doc-"), k, F.lit(".txt")).alias("file_name"), F.col("lang").alias("category"), F.col("text").alias("extracted_text"),
        F.when(k % 3 == 0, F.concat(F.lit("summary of "), "source")).alias("ai_summary"), F.when(k % 2 == 0, F.lit("")).alias("transcript"), F.lit(None).cast("string").alias("entities"),
        F.date_add(F.lit("2024-01-01").cast("date"), (k % 50).cast("int")).alias("created_at"), F.date_add(F.lit("2024-01-01").cast("date"), (k % 50).cast("int")).alias("received_at"),
    )


_SEARCHED_SQL = """searched AS (
  SELECT doc_id AS id, 'doc-' || doc_id || '.txt' AS file_name, lang AS category, text AS extracted_text, CASE WHEN doc_id % 3 = 0 THEN 'summary of ' || source END AS ai_summary,
    CASE WHEN doc_id % 2 = 0 THEN '' END AS transcript, DATE '2024-01-01' + CAST(doc_id % 50 AS INT) AS created_at FROM documents
)"""


@query(f"""
WITH {_SEARCHED_SQL}, h AS (
  SELECT * FROM searched WHERE (contains(lower(extracted_text), 'the') OR contains(lower(coalesce(ai_summary, '')), 'the')) AND (contains(lower(extracted_text), 'src')
    OR contains(lower(coalesce(ai_summary, '')), 'src'))
  AND lower(category) = 'en' ORDER BY ai_summary IS NULL, extracted_text IS NULL, created_at DESC, id LIMIT 10
), p AS (SELECT *, instr(lower(extracted_text), 'the') AS a, instr(lower(extracted_text), 'src') AS b FROM h)
SELECT id, file_name AS title, category AS type, CASE WHEN ai_summary IS NULL THEN '' ELSE 'AI Summary: ' || ai_summary || CASE WHEN extracted_text = '' THEN ''
  ELSE chr(10) || chr(10) END END
  || CASE WHEN extracted_text = '' THEN '' ELSE 'Extracted Text: ...' || substr(extracted_text, greatest(CASE WHEN a > 0 THEN a WHEN b > 0 THEN b
    ELSE 1 END - 1 - 250, 0) + 1, 500) || '...' END AS content,
  least(1.0, 0.3 + 0.2 * (CASE WHEN ai_summary IS NULL THEN 0 ELSE 1 END + CASE WHEN extracted_text = '' THEN 0 ELSE 1 END))::DOUBLE AS score FROM p""")
def r07_document_search(t):
    """Documents of a type of which some text holds every long word; summaries first, then the newest."""
    return retrieval.document_search(_searched(t), "the is src", "EN", 10)


@query(f"""
WITH RECURSIVE {_SEARCHED_SQL}, f AS (SELECT * FROM searched WHERE contains(file_name, 'doc-1') ORDER BY created_at DESC, id LIMIT 5),
c AS (SELECT id, 1 AS o, 'Extracted Text' AS title, extracted_text AS text FROM f UNION ALL SELECT id, 2, 'AI Summary', ai_summary FROM f),
p AS (
  SELECT id, o, title, text, 0 AS k, instr(lower(text), 'tion') AS pos FROM c WHERE text IS NOT NULL
  UNION ALL
  SELECT id, o, title, text, k + 1, CASE WHEN instr(substr(lower(text), pos + 4), 'tion') = 0 THEN 0 ELSE pos + 3 + instr(substr(lower(text), pos + 4), 'tion') END FROM p WHERE pos > 0 AND k < 5
), x AS (
  SELECT id, o, title, k, substr(text, pos, 4) AS said, trim(substr(text, greatest(pos - 151, 0) + 1, pos + 153 - greatest(pos - 151, 0)), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS part
  FROM p WHERE pos > 0 AND k < 5
), q AS (SELECT id, o, title, string_agg('> ...' || regexp_replace(part, '(?i)tion', '**' || said || '**', 'g') || '...' || chr(10) || chr(10), '' ORDER BY k) AS quoted FROM x GROUP BY ALL),
b AS (SELECT id, string_agg(chr(10) || '**In ' || title || ':**' || chr(10) || quoted, '' ORDER BY o) AS body FROM q GROUP BY id)
SELECT f.id, file_name, '### ' || file_name || chr(10) || coalesce(body, 'No matches for "Tion" found in this document''s content.') AS answer FROM f LEFT JOIN b ON b.id = f.id""")
def r11_found_in_documents(t):
    """Where a term stands in the newest documents of a name, in their texts and their summaries."""
    return retrieval.found_in_documents(_searched(t), "DOC-1", "Tion")


@query("""SELECT n_name AS company, 'HELD_BY' AS relationship, s_name AS data FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE contains(n_name, 'NATION_1')
  ORDER BY s_suppkey LIMIT 20""")
def j14_company_relations(t):
    """Relations of companies whose name holds the filter, if there is one."""
    name = F.lit("NATION_1")
    hit = F.contains("n_name", name) | name.isNull()
    rows = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).filter(hit)
    return R.top(rows, 20, F.col("s_suppkey")).select(F.col("n_name").alias("company"), F.lit("HELD_BY").alias("relationship"), F.col("s_name").alias("data"))


@query("""
WITH q AS (SELECT p_partkey, ['MATCH (n) RETURN n', 'match (n) set n.x = 1', 'MERGE (a)', 'MATCH (n) RETURN n.settings', ' optional match (x) detach delete x',
  'SHOW x'][1 + p_partkey % 6] AS q, CASE WHEN p_partkey % 4 = 0 THEN 'write' ELSE 'read' END AS mode FROM part)
SELECT p_partkey, regexp_matches(q, '(?i)\\b(CREATE|MERGE|DELETE|SET|REMOVE|DETACH)\\b') AS writes, p_partkey % 6 IN (0, 1, 3, 4) AS starts_safe, NOT (mode = 'read'
  AND p_partkey % 6 IN (1, 2, 4)) AS allowed FROM q""")
def p16_statement_guard(t):
    """Whether ad-hoc statements write, and whether their mode allows it."""
    k = F.col("p_partkey")
    texts = ("MATCH (n) RETURN n", "match (n) set n.x = 1", "MERGE (a)", "MATCH (n) RETURN n.settings", " optional match (x) detach delete x", "SHOW x")
    q = F.element_at(F.array(*map(F.lit, texts)), (k % 6 + 1).cast("int"))
    writes = q.rlike(r"(?i)\b(CREATE|MERGE|DELETE|SET|REMOVE|DETACH)\b")
    safe = q.rlike(r"(?i)^\s*(MATCH|OPTIONAL MATCH|CALL|RETURN|WITH)")
    read = F.when(k % 4 == 0, "write").otherwise("read") == "read"
    return t.part.select("p_partkey", writes.alias("writes"), safe.alias("starts_safe"), (~(read & writes)).alias("allowed"))


_RESULTS_SQL = """results AS (
  SELECT 'nation ' || n_name AS content, 'Company' AS type, n_name AS title, 0.8::DOUBLE AS score, n_nationkey AS seq, 'graph' AS source FROM nation
  UNION ALL SELECT 'nation ' || n_name, 'chunk', 'c' || n_nationkey, 0.5::DOUBLE + n_nationkey / 1000.0, 1000 + n_nationkey, 'vector' FROM nation
  UNION ALL SELECT 'region ' || r_name, 'document', r_name, 0.9::DOUBLE, 2000 + r_regionkey, 'document' FROM region
)"""


def _results(t):
    def row(df, content, kind, title, score, seq, source):
        return df.select(content.alias("content"), F.lit(kind).alias("type"), title.alias("title"), score.cast("double").alias("score"), seq.cast("int").alias("seq"), F.lit(source).alias("source"))

    k, n = F.col("n_nationkey"), F.concat(F.lit("nation "), F.col("n_name"))
    graph = row(t.nation, n, "Company", F.col("n_name"), F.lit(0.8), k, "graph")
    vector = row(t.nation, n, "chunk", F.concat(F.lit("c"), k), 0.5 + k / 1000.0, 1000 + k, "vector")
    document = row(t.region, F.concat(F.lit("region "), "r_name"), "document", F.col("r_name"), F.lit(0.9), 2000 + F.col("r_regionkey"), "document")
    return graph.unionByName(vector).unionByName(document)


@query(f"""
WITH {_RESULTS_SQL}, e AS (SELECT *, '[' || upper(source) || ': ' || type || '] ' || title || chr(10) || content || chr(10) || chr(10) AS entry FROM results
  ORDER BY score DESC, seq LIMIT 20),
b AS (SELECT *, sum(len(entry)) OVER (ORDER BY score DESC, seq ROWS UNBOUNDED PRECEDING) AS total FROM e)
SELECT string_agg(entry, '' ORDER BY score DESC, seq) AS context, count(*) AS n, CAST(max(total) AS BIGINT) AS chars FROM b WHERE total <= 400""")
def r08_context(t):
    """Entries of the best results while they fit into a number of characters."""
    return retrieval.context_text(_results(t), 400)


@query("SELECT 'No relevant results found in documents or knowledge graph.' AS context, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS chars")
def r08_context_of_nothing(t):
    """The text where nothing fits."""
    return retrieval.context_text(_results(t), 5)


@query(f"""
WITH {_RESULTS_SQL} SELECT content, score, seq, source FROM (SELECT * FROM results WHERE source = 'vector' QUALIFY row_number() OVER (PARTITION BY left(content, 100)
  ORDER BY score DESC, seq) = 1) ORDER BY score DESC, seq LIMIT 7""")
def r05_hybrid_search(t):
    """The hybrid search without its graph part."""
    return retrieval.hybrid(_results(t), graph=False, k=7).select("content", "score", "seq", "source")


@query(f"""
WITH {_RESULTS_SQL}, v AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, seq) AS r FROM results WHERE source IN ('vector', 'graph'))
SELECT string_agg(printf('%.1f', score * 100) || '% ' || content, chr(10) ORDER BY r) FILTER (source = 'vector'
  AND r <= 5) AS vector_context, string_agg(content, chr(10) ORDER BY r) FILTER (source = 'graph' AND r <= 10) AS graph_context FROM v""")
def r10_prompt_context(t):
    """The first five vector hits with their percentage and the first ten graph rows."""
    return retrieval.prompt_context(_results(t), 5, 10, True)


@query("""
WITH c AS (SELECT n_name AS company, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS categories, count(c_custkey) AS n FROM nation LEFT
  JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name ORDER BY n_name LIMIT 10),
a AS (SELECT c_mktsegment AS value, string_agg(DISTINCT n_name, ',' ORDER BY n_name) AS shared FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1
  ORDER BY 1 LIMIT 20),
k AS (SELECT n_name FROM nation WHERE contains(n_name, 'NATION_2') ORDER BY n_name LIMIT 5)
SELECT 'company_data' AS type, company AS name, coalesce(categories, '') AS detail, n FROM c UNION ALL SELECT 'shared_attribute', value, shared, NULL FROM a UNION ALL
  SELECT 'keyword_match', n_name, 'NATION_2', NULL FROM k""")
def r09_oracle_context(t):
    """What companies hold, what attributes are shared by, and nodes that hold a keyword, as tagged rows."""
    row = lambda df, kind, name, detail, n: df.select(F.lit(kind).alias("type"), name.alias("name"), detail.alias("detail"), n.cast("long").alias("n"))
    joined = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "right")
    held = R.top(joined.groupBy("n_name").agg(F.array_join(F.array_sort(F.collect_set("c_mktsegment")), ",").alias("d"), F.count("c_custkey").alias("k")), 10, F.col("n_name"))
    shared = R.top(joined.filter("c_mktsegment is not null").groupBy("c_mktsegment").agg(F.array_join(F.array_sort(F.collect_set("n_name")), ",").alias("d")), 20, F.col("c_mktsegment"))
    word = R.top(t.nation.filter(F.contains("n_name", F.lit("NATION_2"))), 5, F.col("n_name"))
    none = F.lit(None)
    out = row(held, "company_data", F.col("n_name"), F.col("d"), F.col("k")).unionByName(row(shared, "shared_attribute", F.col("c_mktsegment"), F.col("d"), none))
    return out.unionByName(row(word, "keyword_match", F.col("n_name"), F.lit("NATION_2"), none))


@query("""SELECT 'Found ' || (count(*)) || ' relevant items in the graph:' || chr(10) || string_agg('Company: ' || n_name, chr(10) ORDER BY n_name) AS context FROM nation""")
def g24_graph_context(t):
    """Distinct nodes as lines under their number."""
    nodes = t.nation.select(F.array(F.lit("Company")).alias("labels"), F.create_map(F.lit("name"), F.col("n_name")).alias("props"))
    return retrieval.graph_context(nodes.unionByName(nodes))


#: Which part of the graph a question is answered from, by its words in this order.
PATHS = (("email", "emails"), ("company", "companies"), ("companies", "companies"), ("amazon", "one company"), ("google", "one company"), ("facebook", "one company"))


@query("""
WITH q AS (SELECT r_regionkey AS id, ['Which EMAIL does my company know?', 'list companies', 'what has Google', 'all', 'a company of amazon'][1 + r_regionkey % 5] AS q FROM region)
SELECT id, path, company, account FROM (
  SELECT id, 'companies' AS path, n_name AS company, s_name AS account FROM q, nation LEFT JOIN supplier ON s_nationkey = n_nationkey
    WHERE NOT contains(lower(q), 'email') AND (contains(lower(q), 'company') OR contains(lower(q), 'companies'))
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY n_name, s_name NULLS FIRST) <= 50)
UNION ALL SELECT id, 'emails', c_name, NULL FROM (SELECT id, c_name FROM q, customer WHERE contains(lower(q), 'email') QUALIFY row_number() OVER (PARTITION BY id
  ORDER BY c_name) <= 50)
UNION ALL SELECT id, 'one company', 'Google', NULL FROM q WHERE contains(lower(q), 'google')
UNION ALL SELECT id, 'any node', n_name, NULL FROM (SELECT id, n_name FROM q, nation WHERE q = 'all' QUALIFY row_number() OVER (PARTITION BY id ORDER BY n_name) <= 50)""")
def g23_question_paths(t):
    """The rows of the graph that a question asks for, by its first fitting word."""
    texts = ("Which EMAIL does my company know?", "list companies", "what has Google", "all", "a company of amazon")
    k = F.col("r_regionkey")
    asked = t.region.select(k.alias("id"), F.lower(F.element_at(F.array(*map(F.lit, texts)), (k % 5 + 1).cast("int"))).alias("q"))
    path = F.coalesce(*[F.when(F.contains("q", F.lit(w)), p) for w, p in PATHS], F.lit("any node"))
    known = F.coalesce(*[F.when(F.contains("q", F.lit(w)), w.capitalize()) for w in ("amazon", "google", "facebook")])
    asked = asked.withColumn("path", path).withColumn("known", known)
    none = F.lit(None).cast("string")

    def rows(name, table, *columns):
        return asked.filter(F.col("path") == name).join(F.broadcast(table)).select("id", "path", *[c.alias(n) for c, n in zip(columns, ("company", "account"), strict=True)])

    first = lambda df, *order: R.top(df, 50, *order)
    held = first(t.nation.join(t.supplier, F.col("s_nationkey") == F.col("n_nationkey"), "left"), F.col("n_name"), F.col("s_name").asc_nulls_first())
    out = rows("companies", held, F.col("n_name"), F.col("s_name")).unionByName(rows("emails", first(t.customer, F.col("c_name")), F.col("c_name"), none))
    out = out.unionByName(rows("any node", first(t.nation, F.col("n_name")), F.col("n_name"), none))
    return out.unionByName(asked.filter("path = 'one company'").select("id", "path", F.col("known").alias("company"), none.alias("account")))


@query("""SELECT 'policy' AS tool, company_name AS answer FROM (SELECT company_name FROM companies ORDER BY company_id LIMIT 1) UNION ALL SELECT 'documents', file_name
  FROM (SELECT file_name FROM files ORDER BY received_at DESC, file_name LIMIT 1)
UNION ALL SELECT 'graph', s FROM (SELECT s FROM edges ORDER BY s LIMIT 1) UNION ALL SELECT 'reference', 'Article 6(1)(a), Article 7, Recital 32'""")
def r16_fallback_context(t):
    """What four fixed tools say, for an agent without a tool call of its own."""
    row = lambda df, tool, answer: df.select(F.lit(tool).alias("tool"), answer.alias("answer"))
    out = row(R.top(companies(t), 1, F.col("company_id")), "policy", F.col("company_name")).unionByName(row(R.top(files(t), 1, F.desc("received_at"), F.col("file_name")), "documents", F.col("file_name")))
    out = out.unionByName(row(R.top(edges(t), 1, F.col("s")), "graph", F.col("s")))
    return out.unionByName(row(t.spark.range(1), "reference", topic_articles(F.lit("withdraw consent"))))


# ---------------------------------------------------------------- context of triples


def _told(t):
    """A text for each supplier, with sentences that hold all of its triple, both ends, one end, none."""
    s = F.col("s_name")
    text = F.concat(F.lit("Nothing here. "), s, F.lit(" is named. "), s, F.lit(" sells data to Partner. The Partner of "), s, F.lit(" shares data. End of it."))
    return t.supplier.select(F.col("s_suppkey").alias("doc_id"), text.alias("text"))


@query("""
SELECT s_suppkey AS doc_id, s_suppkey AS triple_id, 2 AS place, s_name || ' sells data to Partner.' AS sentence, CAST(25 + len(s_name) AS INT) AS start,
  CAST(48 + 2 * len(s_name) AS INT) AS "end",
  s_name || ' is named. The Partner of ' || s_name || ' shares data.' AS context FROM supplier""")
def r14_restored_context(t):
    """Triples with the sentence that fits best and those beside it; the score is tested on its own."""
    docs = _told(t)
    pieces = F.split("text", chunking.SENTENCE_END)
    starts = F.transform(pieces, lambda x, i: F.aggregate(F.slice(pieces, F.lit(1), i), F.lit(0), lambda a, y: a + F.length(y) + 1))
    sentences = docs.select("doc_id", F.posexplode(F.arrays_zip(pieces.alias("sentence"), starts.alias("start"))).alias("place", "z")).select("doc_id", "place", "z.sentence", "z.start")
    triples = t.supplier.select(F.col("s_suppkey").alias("doc_id"), F.col("s_suppkey").alias("triple_id"), F.col("s_name").alias("s"), F.lit("SHARES_DATA_WITH").alias("p"), F.lit("Partner").alias("o"))
    return retrieval.restored_context(triples, sentences).select("doc_id", "triple_id", "place", "sentence", "start", "end", "context")


@query("""
WITH g AS (SELECT n_nationkey AS gap_id, 'what of ' || n_name || '?' AS question, CASE WHEN n_nationkey % 3 = 0 THEN 'high' ELSE 'low' END AS priority, n_name FROM nation)
SELECT gap_id, n_name AS s, 'SHARES_WITH' AS p, 'o' || k AS o, CASE k WHEN 0 THEN 0.9 ELSE 0.6 END::DOUBLE AS confidence, question AS source_text, true AS inferred
  FROM g, (SELECT unnest([0, 2]) AS k) WHERE priority = 'high'""")
def r15_gap_triples(t):
    """Triples for gaps of high priority: the first three replies, incomplete ones left out."""
    gaps = t.nation.select(F.col("n_nationkey").alias("gap_id"), F.concat(F.lit("what of "), "n_name", F.lit("?")).alias("question"), F.when(F.col("n_nationkey") % 3 == 0, "high").otherwise("low").alias("priority"))
    grid = t.nation.select(F.col("n_nationkey").alias("gap_id"), F.col("n_name").alias("s"), F.explode(F.array(*map(F.lit, range(5)))).alias("place"))
    replies = grid.select("gap_id", "place", "s", F.when(F.col("place") != 1, "shares with").alias("p"), F.concat(F.lit("o"), "place").alias("o"), F.when(F.col("place") == 0, 0.9).alias("confidence"))
    return retrieval.gap_triples(gaps, replies)


# ---------------------------------------------------------------- search by index


@query("""
WITH d AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL), q AS (SELECT DISTINCT substr(text, 11, 8) AS needle FROM d WHERE doc_id % 100 = 0 UNION
  SELECT DISTINCT substr(text, 1, 2) FROM d WHERE doc_id % 100 = 0)
SELECT needle, doc_id FROM q JOIN d ON needle <> '' AND contains(lower(text), lower(needle))""")
def p06_indexed_search(t):
    """All documents that hold a piece of one of the query documents, eight letters of it and its first two."""
    rows = t.documents.select(F.col("doc_id").alias("id"), "text")
    asked = rows.filter("id % 100 = 0 and text is not null")
    needles = asked.select(F.substring("text", 11, 8).alias("needle")).union(asked.select(F.substring("text", 1, 2)))
    return trigrams.TrigramIndex(rows).search(needles).select("needle", F.col("id").alias("doc_id"))


@query("""
WITH n AS (SELECT s_suppkey AS id, s_name || chr(10) || n_name AS hay FROM supplier JOIN nation ON s_nationkey = n_nationkey), q AS (SELECT n_name AS w FROM nation UNION
  SELECT right(s_name, 3) FROM supplier)
SELECT w AS needle, id FROM q JOIN n ON contains(lower(hay), lower(w))""")
def p05_indexed_properties(t):
    """Nodes with a property that holds a word, for all names of nations and all ends of suppliers' names at once."""
    rows = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("id"), F.concat_ws("\n", "s_name", "n_name").alias("text"))
    needles = t.nation.select(F.col("n_name").alias("needle")).union(t.supplier.select(F.right("s_name", F.lit(3))))
    return trigrams.TrigramIndex(rows).search(needles)


@query("""SELECT doc_id FROM documents WHERE contains(lower(text), 'tion') AND contains(lower(text), 'al') AND contains(lower(text), 'ere')""")
def r07_indexed_words(t):
    """Documents whose text holds every word of a question, by the rarest pieces of the words."""
    index = trigrams.TrigramIndex(t.documents.select(F.col("doc_id").alias("id"), "text"))
    return index.holding(["Tion", "al", "ere"]).select(F.col("id").alias("doc_id"))
