"""Queries over model replies and file contents: JSON in prose, triples, categories, rows, structure, artifacts."""

from __future__ import annotations

from pyspark.sql import functions as F

from subjectlens.functions import content as C
from subjectlens.functions import replies as P
from subjectlens.functions import text as X
from subjectlens.functions import values as V
from subjectlens.operators.indicators import risk_signals
from subjectlens.plans.cases import files, messages, requests
from subjectlens.plans.registry import query


def _pick(values, k):
    return F.element_at(F.array(*[v if not isinstance(v, str) else F.lit(v) for v in values]), (k % len(values) + 1).cast("int"))


# ---------------------------------------------------------------- model replies


def _reply(t):
    """Replies of six kinds: fenced, plain, in prose with inner brackets, with bare keys and commas too many, broken, an object."""
    name, k = F.col("p_name"), F.col("p_partkey")
    full = F.concat(F.lit('[{"subject": "'), name, F.lit('", "predicate": "USES", "object": "data", "confidence": 0.9}]'))
    other = F.concat(F.lit('[{"head": "'), name, F.lit('", "relation": "HAS", "tail": ""}]'))
    loose = F.concat(F.lit('so: [{subject: "'), name, F.lit('", predicate: "USES", object: "x",},]'))
    kinds = (
        F.concat(F.lit("Here:\n```json\n"), full, F.lit("\n```\nthat is all []")), other, F.concat(F.lit("I found "), F.lit('[{"subject": "'), name, F.lit('", "list": [1, [2]]}] and [more].')),
        loose, F.concat(F.lit("[{broken "), name), F.lit('{"a": 1}'),
    )
    return t.part.select(k.alias("id"), _pick(kinds, k).alias("reply"))


@query("""
SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN '[{"subject": "' || p_name || '", "predicate": "USES", "object": "data", "confidence": 0.9}]'
  WHEN 1 THEN '[{"head": "' || p_name || '", "relation": "HAS", "tail": ""}]'
  WHEN 2 THEN '[{"subject": "' || p_name || '", "list": [1, [2]]}]' WHEN 3 THEN '[{"subject": "' || p_name || '", "predicate": "USES", "object": "x"}]'
    WHEN 5 THEN '{"a": 1}' END AS json FROM part""")
def d23_json_in_replies(t):
    """The JSON of a reply: fenced, whole, bracketed in prose, or repaired."""
    return _reply(t).select("id", P.json_of(F.col("reply")).alias("json"))


@query("""
SELECT p_partkey AS id, p_name AS s, CASE p_partkey % 6 WHEN 0 THEN 'USES' WHEN 1 THEN 'HAS' WHEN 2 THEN 'UNKNOWN' ELSE 'USES' END AS p, CASE p_partkey % 6
  WHEN 0 THEN 'data' WHEN 3 THEN 'x' ELSE 'Unknown' END AS o,
  CASE p_partkey % 6 WHEN 0 THEN 0.9::DOUBLE END AS confidence FROM part WHERE p_partkey % 6 < 4""")
def d25_triples_of_replies(t):
    """Triples of replies, under other key names too."""
    found = _reply(t).select("id", F.explode(P.triples_of(P.json_of(F.col("reply")))).alias("x"))
    return found.select("id", "x.s", "x.p", "x.o", "x.confidence")


@query("""SELECT id, CASE WHEN id % 2 = 0 THEN '{"subject": "S' || id || '", "to": "dpo"}' ELSE '{"subject":"GDPR Request","to":"dpo' || id || '"}' END AS draft, CASE
  WHEN id % 2 = 0 THEN 'S' || id ELSE 'GDPR Request' END AS subject FROM requests""")
def d29_draft_or_default(t):
    """A drafted letter as the model wrote it, else the default one."""
    k = F.col("id")
    reply = F.when(k % 2 == 0, F.concat(F.lit('Draft: {"subject": "S'), k, F.lit('", "to": "dpo"} done'))).otherwise("no letter {today")
    draft = P.object_or(reply, F.struct(F.lit("GDPR Request").alias("subject"), F.concat(F.lit("dpo"), k).alias("to")))
    return requests(t).select("id", draft.alias("draft")).withColumn("subject", F.get_json_object("draft", "$.subject"))


@query("""
WITH r AS (SELECT id, request_type FROM requests)
SELECT id, 'datapoint' AS type, 'CONTACT' AS category, 'mail ' || id AS value, 'HIGH' AS risk FROM r UNION ALL SELECT id, 'datapoint', 'CONTACT', 'phone', 'HIGH' FROM r
UNION ALL SELECT id, 'datapoint', 'OTHER', request_type, 'MEDIUM' FROM r UNION ALL SELECT id, 'email', 'IDENTITY', 'x@y', 'MEDIUM' FROM r UNION ALL
  SELECT id, 'entity', 'UNKNOWN', '', 'low' FROM r""")
def d24_flattened_categories(t):
    """Examples of categories and extracted entities as items."""
    entry = lambda values, risk: F.struct(F.array(*values).alias("examples"), F.lit(risk).cast("string").alias("riskLevel"))
    entity = lambda *v: F.struct(*[F.lit(x).cast("string").alias(n) for n, x in zip(("type", "category", "value", "riskLevel"), v, strict=True)])
    categories = F.create_map(F.lit("CONTACT"), entry([F.concat(F.lit("mail "), "id"), F.lit("phone")], "HIGH"), F.lit("OTHER"), entry([F.col("request_type")], None))
    rows = requests(t).select("id", categories.alias("categories"), F.array(entity("email", "IDENTITY", "x@y", None), entity(None, None, None, "low")).alias("extracted"))
    return P.flattened(rows)


@query("""
SELECT id, ['processing', 'action_required', 'processing', 'data_available', 'data_received', 'partial_data', 'rejected', 'extended', 'action_required', 'completed',
  NULL, NULL][1 + id % 12] AS status,
  CASE WHEN id % 3 = 0 THEN CAST(DATE '2024-01-01' + CAST(id % 28 AS INT) AS VARCHAR) WHEN id % 3 = 1 THEN '2024-02-03' END AS day FROM messages""")
def d14_status_of_class(t):
    """The status that a message's class leads to, and dates of breaches, null where they are none."""
    k = F.col("id")
    label = _pick((*V.STATUS_OF_CLASS, "UNRELATED", "OTHER"), k)
    raw = F.when(k % 3 == 0, F.date_add(F.lit("2024-01-01").cast("date"), (k % 28).cast("int")).cast("string")).when(k % 3 == 1, "2024-02-03T10:00:00").otherwise("3 Feb 2024")
    return messages(t).select("id", V.status_of_class(label).alias("status"), V.day_or_null(raw).cast("string").alias("day"))


@query("""
SELECT p_partkey, p_name AS name, '{"a":1}' AS inner_json, '[{"b":2}]' AS list_json, '[1,2]' AS numbers, CASE
  WHEN p_size % 2 = 0 THEN '[{"source":"scan","text":"' || p_brand || '"}]' ELSE '[]' END AS evidence FROM part""")
def f51_plain_properties(t):
    """Properties without nulls, inner objects as JSON text; evidence as JSON."""
    doc = F.concat(F.lit('{"name": "'), "p_name", F.lit('", "none": null, "inner": {"a": 1}, "list": [{"b": 2}], "numbers": [1, 2]}'))
    m = P.plain_props(F.parse_json(doc))
    at = lambda k: F.try_element_at("m", F.lit(k))
    evidence = F.when(F.col("p_size") % 2 == 0, F.array(F.struct(F.lit("scan").alias("source"), F.col("p_brand").alias("text")))).otherwise(F.array().cast("array<struct<source:string,text:string>>"))
    rows = t.part.select("p_partkey", m.alias("m"), F.to_json(evidence).alias("evidence")).filter(~F.array_contains(F.map_keys("m"), "none"))
    return rows.select("p_partkey", at("name").alias("name"), at("inner").alias("inner_json"), at("list").alias("list_json"), at("numbers").alias("numbers"), "evidence")


@query("""SELECT request_id AS thread, '[' || string_agg('{"action":"' || sender || '","id":' || id || '}', ',' ORDER BY id) || ']' AS history FROM messages GROUP BY 1""")
def d17_appended_json(t):
    """JSON arrays with further elements, as one array in order."""
    element = F.to_json(F.struct(F.col("sender").alias("action"), "id"))
    by = messages(t).groupBy(F.col("request_id").alias("thread")).agg(F.array_sort(F.collect_list(F.struct("id", element.alias("x")))).alias("h"))
    return by.select("thread", F.concat(F.lit("["), F.array_join(F.transform("h", lambda x: x["x"]), ","), F.lit("]")).alias("history"))


@query("""
SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_name ELSE 'default' END AS model, 'eu' AS region, CASE WHEN p_size % 2 = 0 THEN p_brand END AS note FROM part""")
def d28_settings(t):
    """Given settings over the defaults; blank ones keep the default, further ones are added."""
    size = F.col("p_size")
    given = F.map_from_arrays(F.array(F.lit("model"), F.lit("note")), F.array(F.when(size % 3 == 0, F.col("p_name")).when(size % 3 == 1, " "), F.when(size % 2 == 0, F.col("p_brand"))))
    m = V.defaults_with(F.create_map(F.lit("model"), F.lit("default"), F.lit("region"), F.lit("eu")), given)
    return t.part.select("p_partkey", m.alias("m")).select("p_partkey", *[F.try_element_at("m", F.lit(k)).alias(k) for k in ("model", "region", "note")])


@query("""
SELECT id, coalesce(CASE WHEN id % 2 = 0 THEN 'old' END, '') || chr(10) || chr(10) || '[2024-01-30 00:00:00] ' || status AS notes FROM requests""")
def m14_notes(t):
    """A note appended with its time."""
    old = F.when(F.col("id") % 2 == 0, "old")
    return requests(t).select("id", V.noted(old, F.lit("2024-01-30 00:00:00"), F.col("status")).alias("notes"))


# ---------------------------------------------------------------- contents


def _contents(t):
    """JSON contents of five kinds: an array of objects, an object with an array, one object, an array of numbers, none."""
    k, name = F.col("p_partkey"), F.col("p_name")
    rows = F.concat(F.lit('[{"id": '), k, F.lit(', "who": {"name": "'), name, F.lit('", "tags": ["a", "b"]}, "gone": null}, {"id": 2, "x": true}]'))
    kinds = (rows, F.concat(F.lit('{"n": 1, "items": '), rows, F.lit(', "more": []}')), F.concat(F.lit(' {"name": "'), name, F.lit('", "deep": {"er": {"k": 1.5}}}')), F.lit("[1, 2, 3]"), F.lit("{no json"))
    return t.part.select(k.alias("id"), _pick(kinds, k).alias("content"))


@query("""
WITH k AS (SELECT p_partkey AS id, p_name FROM part)
SELECT id, 0 AS row, CASE id % 5 WHEN 2 THEN 'name=' || p_name || ',deep.er.k=1.5' ELSE 'id=' || id || ',who.name=' || p_name || ',who.tags=2,gone=' END AS fields
  FROM k WHERE id % 5 < 3
UNION ALL SELECT id, 1, 'id=2,x=true' FROM k WHERE id % 5 < 2""")
def d19_json_rows(t):
    """Rows of JSON contents with dotted names, arrays as their lengths."""
    rows = _contents(t).select("id", F.posexplode(C.json_rows(F.col("content"))).alias("row", "r"))
    return rows.select("id", "row", F.array_join(F.transform("r", lambda x: F.concat(x["name"], F.lit("="), F.coalesce(x["value"], F.lit("")))), ",").alias("fields"))


_ITEM = '{"type":"object","fields":{"id":{"type":"number"},"who":{"type":"object","fields":{"name":{"type":"string"},"tags":{"type":"array","count":2,"item":{"type":"string"}}}},"gone":{"type":"null"}}}'


@query(f"""
SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN '{{"type":"array","count":2,"item":{_ITEM}}}'
  WHEN 1 THEN '{{"type":"object","fields":{{"n":{{"type":"number"}},"items":{{"type":"array","count":2,"item":{_ITEM}}},"more":{{"type":"array","count":0,"item":{{"type":"unknown"}}}}}}}}'
  WHEN 2 THEN '{{"type":"object","fields":{{"name":{{"type":"string"}},"deep":{{"type":"object","fields":{{"er":{{"type":"object","fields":{{"k":{{"type":"number"}}}}}}}}}}}}}}'
  WHEN 3 THEN '{{"type":"array","count":3,"item":{{"type":"number"}}}}' END AS structure FROM part""")
def d21_json_structure(t):
    """D21, C02."""
    return _contents(t).select("id", C.json_schema(F.col("content")).alias("structure"))


@query("""
WITH k AS (SELECT p_partkey AS id FROM part WHERE p_partkey % 5 < 3)
SELECT id, CASE id % 5 WHEN 2 THEN 'name,deep.er.k' ELSE 'id,who.name,who.tags,x' END AS x, CASE id % 5 WHEN 2 THEN '1,1' ELSE '2,1,1,1' END AS y FROM k""")
def c04_chart_spec(t):
    """Non-blank values of each field, the fullest fields first, at most twelve."""
    rows = _contents(t).select("id", C.json_rows(F.col("content")).alias("rows"))
    rows = rows.select("id", C.field_coverage(F.col("rows")).alias("f")).filter("size(f) > 0")
    return rows.select("id", F.array_join(F.transform("f", lambda x: x["name"]), ",").alias("x"), F.array_join(F.transform("f", lambda x: x["n"].cast("string")), ",").alias("y"))


def _notes(t):
    k = F.col("id")
    day = F.lpad((k % 28 + 1).cast("string"), 2, "0")
    body = F.concat(
        F.lit("Log of 5/6/2023:\n\n seen 2024-01-"), day, F.lit("T10:00Z at 51."), 1000 + k % 9000, F.lit(", -0."), 1000 + k % 7000, F.lit(" and 95.123, 10.123; again 2024-01-"), day, F.lit("T10:00Z, then 2024-03-01.")
    )
    return messages(t).select("id", body.alias("text"))


_NOTES_SQL = """n AS (
  SELECT id, lpad(CAST(id % 28 + 1 AS VARCHAR), 2, '0') AS day, CAST(1000 + id % 9000 AS VARCHAR) AS a, CAST(1000 + id % 7000 AS VARCHAR) AS b FROM messages
), x AS (
  SELECT *, 'Log of 5/6/2023:' || chr(10) || chr(10) || ' seen 2024-01-' || day || 'T10:00Z at 51.' || a || ', -0.' || b || ' and 95.123, 10.123; again 2024-01-' || day || 'T10:00Z, then 2024-03-01.' AS text FROM n
)"""


@query(f"""
WITH {_NOTES_SQL}, e AS (
  SELECT id, 0 AS k, '2024-01-' || day || 'T10:00Z' AS date, text, instr(text, '2024-01-') - 1 AS pos FROM x UNION ALL
    SELECT id, 1, '2024-03-01', text, instr(text, '2024-03-01') - 1 FROM x
  UNION ALL SELECT id, 2, '5/6/2023', text, instr(text, '5/6/2023') - 1 FROM x)
SELECT id, CAST(k AS INT) AS k, date, regexp_replace(substr(text, greatest(pos - 80, 0) + 1, pos + 140 - greatest(pos - 80, 0)), '\\s+', ' ', 'g') AS label FROM e""")
def c08_timeline_events(t):
    """Dates of a text with what stands around them, each once."""
    found = _notes(t).select("id", F.posexplode(V.timeline(F.col("text"))).alias("k", "e"))
    return found.select("id", "k", "e.date", "e.label")


@query(f"""
WITH {_NOTES_SQL}
SELECT id, CAST('51.' || a AS DOUBLE) AS lat, CAST('-0.' || b AS DOUBLE) AS lon, printf('%.5f', CAST('51.' || a AS DOUBLE)) || ', ' || printf('%.5f',
  CAST('-0.' || b AS DOUBLE)) AS label FROM x""")
def c07_geo_points(t):
    """Points in range with a label."""
    found = _notes(t).select("id", F.explode(V.coordinates(F.col("text"))).alias("p"))
    return found.select("id", "p.lat", "p.lon", F.concat(F.format_string("%.5f", F.col("p.lat")), F.lit(", "), F.format_string("%.5f", F.col("p.lon"))).alias("label"))


_CONTENTS_SQL = """contents AS (
  SELECT p_partkey AS file_id, CASE p_partkey % 4 WHEN 0 THEN '[{"id": ' || p_partkey || ', "name": "' || p_name || '"}]'
    WHEN 1 THEN 'id;name' || chr(10) || p_partkey || ';"' || p_name || '"'
    WHEN 2 THEN '<html><body><h1>' || p_name || '</h1><p>about health and 10.1.2.3</p></body></html>'
      ELSE '# ' || p_name || chr(10) || 'On 2024-05-06 at 51.12345, 0.12345 write to a' || p_partkey || '@b.org' END AS text
  FROM part
)"""


def artifacts(contents):
    """(file_id, artifact_type, title, payload, confidence) of contents(file_id, text): all artifacts of each file as typed rows.

    The feature reads a file's first 120 000 characters and shows a table's first 250 rows.
    """
    rows = contents.select("file_id", F.left("text", F.lit(120_000)).alias("text"))
    text = F.col("text")
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    json_rows, table = F.slice(C.json_rows(text), 1, V.MOST_ROWS), C.table_rows(V.delimited_rows(text))
    rows = rows.select("file_id", "text", json_rows.alias("rows"), table.alias("table"), C.json_schema(text).alias("structure"))
    points, events = V.coordinates(text), V.timeline(text)
    has = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    cells = lambda rs: F.to_json(F.struct(C.columns_of(rs).alias("columns"), F.transform(rs, lambda r: F.map_from_entries(F.transform(r, lambda x: F.struct(x["name"], x["value"])))).alias("rows")))
    bars = lambda rs: F.to_json(F.struct(F.lit("bar").alias("kind"), F.transform(C.field_coverage(rs), lambda x: x["name"]).alias("x"), F.transform(C.field_coverage(rs), lambda x: x["n"]).alias("y")))
    made = [
        (F.lit(True), "metric", "File Processing Summary", F.to_json(F.struct(F.length(text).alias("characters"), words.alias("words"))), 1.0),
        (F.col("structure").isNotNull(), "json_schema", "JSON Structure", F.col("structure"), 1.0),
        (has("rows"), "table", "JSON Table", cells(F.col("rows")), 0.9),
        (has("rows"), "chart_spec", "JSON Field Coverage", bars(F.col("rows")), 0.82),
        (has("table"), "table", "Parsed Table", cells(F.col("table")), 0.9),
        (has("table"), "chart_spec", "Table Field Coverage", bars(F.col("table")), 0.82),
        (X.is_html(text), "html_preview", "HTML Preview", F.to_json(F.struct(F.left(X.strip_html(text), F.lit(8000)).alias("text"), X.headings(text).alias("headings"))), 0.9),
        (has(X.outline(text)), "document_outline", "Document Outline", F.to_json(F.struct(X.outline(text).alias("headings"))), 0.85),
        (has(points), "geo_points", "Location Points", F.to_json(F.struct(points.alias("points"))), 0.78),
        (has(events), "timeline_events", "Timeline Events", F.to_json(F.struct(events.alias("events"))), 0.75),
    ]
    row = lambda kind, title, payload, confidence: F.struct(F.lit(kind).alias("artifact_type"), F.lit(title).alias("title"), payload.alias("payload"), F.lit(confidence).alias("confidence"))
    every = F.array_compact(F.array(*[F.when(c, row(*rest)) for c, *rest in made]))
    found = rows.select("file_id", F.explode(every).alias("a")).select("file_id", "a.*")
    titles = X.lookup(F.col("kind"), {"email": "Email Addresses Found", "ip": "IP Addresses Found", "sensitive_terms": "Sensitive Data Terms Found"})
    risks = risk_signals(rows.select(F.col("file_id").alias("doc_id"), "text"))
    return found.unionByName(risks.select(F.col("doc_id").alias("file_id"), F.lit("risk_signal").alias("artifact_type"), titles.alias("title"), F.to_json(F.struct("kind", "count", "source")).alias("payload"), "confidence"))


def _files_of_kinds(t):
    k, name = F.col("p_partkey"), F.col("p_name")
    kinds = (
        F.concat(F.lit('[{"id": '), k, F.lit(', "name": "'), name, F.lit('"}]')), F.concat(F.lit("id;name\n"), k, F.lit(';"'), name, F.lit('"')),
        F.concat(F.lit("<html><body><h1>"), name, F.lit("</h1><p>about health and 10.1.2.3</p></body></html>")),
        F.concat(F.lit("# "), name, F.lit("\nOn 2024-05-06 at 51.12345, 0.12345 write to a"), k, F.lit("@b.org")),
    )
    return t.part.select(k.alias("file_id"), _pick(kinds, k).alias("text"))


@query(f"""
WITH {_CONTENTS_SQL}, p AS (SELECT file_id, text, p_name FROM contents JOIN part ON p_partkey = file_id)
SELECT file_id, 'metric' AS artifact_type, 'File Processing Summary' AS title,
  '{{"characters":' || len(text) || ',"words":' || len(regexp_extract_all(text, '\\S+')) || '}}' AS payload, 1.0::DOUBLE AS confidence FROM p
UNION ALL SELECT file_id, 'json_schema', 'JSON Structure',
  '{{"type":"array","count":1,"item":{{"type":"object","fields":{{"id":{{"type":"number"}},"name":{{"type":"string"}}}}}}}}', 1.0 FROM p WHERE file_id % 4 = 0
UNION ALL SELECT file_id, 'table', CASE file_id % 4 WHEN 0 THEN 'JSON Table'
  ELSE 'Parsed Table' END, '{{"columns":["id","name"],"rows":[{{"id":"' || file_id || '","name":"' || p_name || '"}}]}}', 0.9 FROM p WHERE file_id % 4 < 2
UNION ALL SELECT file_id, 'chart_spec', CASE file_id % 4 WHEN 0 THEN 'JSON Field Coverage'
  ELSE 'Table Field Coverage' END, '{{"kind":"bar","x":["id","name"],"y":[1,1]}}', 0.82 FROM p WHERE file_id % 4 < 2
UNION ALL SELECT file_id, 'html_preview', 'HTML Preview', '{{"text":"' || p_name || ' about health and 10.1.2.3","headings":["' || p_name || '"]}}', 0.9 FROM p
  WHERE file_id % 4 = 2
UNION ALL SELECT file_id, 'document_outline', 'Document Outline', '{{"headings":[{{"level":1,"text":"' || p_name || '"}}]}}', 0.85 FROM p WHERE file_id % 4 = 3
UNION ALL SELECT file_id, 'geo_points', 'Location Points', '{{"points":[{{"lat":51.12345,"lon":0.12345}}]}}', 0.78 FROM p WHERE file_id % 4 = 3
UNION ALL SELECT file_id, 'timeline_events', 'Timeline Events',
  '{{"events":[{{"date":"2024-05-06","label":"# ' || p_name || ' On 2024-05-06 at 51.12345, 0.12345 write to a' || file_id || '@b.org"}}]}}', 0.75 FROM p
  WHERE file_id % 4 = 3
UNION ALL SELECT file_id, 'risk_signal', 'Email Addresses Found', '{{"kind":"email","count":1,"source":""}}', 0.9 FROM p WHERE file_id % 4 = 3
UNION ALL SELECT file_id, 'risk_signal', 'IP Addresses Found', '{{"kind":"ip","count":1,"source":""}}', 0.85 FROM p WHERE file_id % 4 = 2
UNION ALL SELECT file_id, 'risk_signal', 'Sensitive Data Terms Found', '{{"kind":"sensitive_terms","count":1,"source":"health"}}', 0.7 FROM p WHERE file_id % 4 = 2""")
def c10_artifacts(t):
    """All artifacts of files of four kinds as typed rows."""
    return artifacts(_files_of_kinds(t))


@query("""
WITH a AS (SELECT request_id, line, file_name, received_at, CASE line % 2 WHEN 0 THEN 'table' ELSE 'metric' END AS kind FROM files)
SELECT request_id, string_agg(kind || ':' || line, ',' ORDER BY received_at, line, file_name) AS artifacts FROM a GROUP BY request_id""")
def c11_artifacts_of_request(t):
    """C11: the artifacts of a request in the order of their creation."""
    kind = F.when(F.col("line") % 2 == 0, "table").otherwise("metric")
    rows = files(t).select("request_id", F.struct("received_at", "line", "file_name", F.concat_ws(":", kind, "line").alias("x")).alias("a"))
    return rows.groupBy("request_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("a")), lambda x: x["x"]), ",").alias("artifacts"))


@query("""
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 2 END AS level, CASE WHEN doc_id % 2 = 0 THEN 'Head ' || doc_id ELSE 'Title Of Part ' || doc_id END AS text FROM documents
UNION ALL SELECT doc_id, 3, 'sub' FROM documents WHERE doc_id % 2 = 0""")
def f44_outlines(t):
    """Markdown headings with their levels, else lines in title case."""
    k = F.col("doc_id")
    text = F.when(k % 2 == 0, F.concat(F.lit("# Head "), k, F.lit("\nbody\n### sub \nTitle Line Here"))).otherwise(F.concat(F.lit("lower line\n  Title Of Part "), k, F.lit(" \r\nAb\nWith. a stop")))
    return t.documents.select("doc_id", F.explode(X.outline(text)).alias("x")).select("doc_id", "x.level", "x.text")
