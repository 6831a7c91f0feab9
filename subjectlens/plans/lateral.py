"""Queries in SQL text that call the table functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from subjectlens.functions import table_functions
from subjectlens.plans.parsing import _contents
from subjectlens.plans.registry import query
from subjectlens.plans.text import LINE_CHUNKS_SQL, SENTENCE_CHUNKS_SQL


def _sql(t, text: str, **frames):
    table_functions.register(t.spark)
    return t.spark.sql(text, **frames)


@query("""WITH w AS (SELECT doc_id, text, regexp_extract_all(text, '\\s*\\S+') AS w FROM documents), n AS (SELECT *, len(w) AS n FROM w WHERE len(w) > 0),
k AS (SELECT *, unnest(CASE WHEN n <= 150 THEN [0] ELSE CAST(range(0, CAST(ceil((n - 150) / 120) AS INT) + 1) AS INT[]) END) AS k FROM n),
s AS (SELECT *, CASE WHEN n <= 150 THEN 0 ELSE len(array_to_string(w[1:k * 120], '')) + len(regexp_extract(w[k * 120 + 1], '^\\s*')) END AS a, CASE
  WHEN n <= 150 THEN len(text) ELSE len(array_to_string(w[1:least(k * 120 + 150, n)], '')) END AS b FROM k)
SELECT doc_id, k AS chunk_index, CAST(a AS INT) AS start_offset, CAST(b AS INT) AS end_offset, substr(text, a + 1, b - a) AS text,
CAST(CASE WHEN n <= 150 THEN n ELSE least(k * 120 + 150, n) - k * 120 END AS INT) AS word_count FROM s""")
def n07_word_chunks(t):
    """Chunks of 150 words of all documents."""
    return _sql(t, "SELECT d.doc_id, c.* FROM {docs} d, LATERAL word_chunks(d.text, 150, 30) c", docs=t.documents)


@query(SENTENCE_CHUNKS_SQL)
def n07_sentence_chunks(t):
    """Sentences of all documents packed into chunks."""
    return _sql(t, "SELECT d.doc_id, c.* FROM {docs} d, LATERAL sentence_chunks(d.text, 120, 20, 200) c", docs=t.documents)


@query(LINE_CHUNKS_SQL)
def n07_line_chunks(t):
    """Lines of all documents packed into chunks."""
    return _sql(t, "SELECT d.doc_id, c.* FROM {docs} d, LATERAL line_chunks(d.text, 600) c", docs=t.documents)


@query("""WITH p AS (SELECT doc_id, text, string_split(lower(text), 'tion') AS parts FROM documents),
k AS (SELECT doc_id, text, parts, unnest(range(1, len(parts))) AS k FROM p), a AS (SELECT *, len(array_to_string(parts[1:k], '')) + (k - 1) * 4 AS pos FROM k)
SELECT doc_id, CAST(k - 1 AS INT) AS place, CAST(pos AS INT) AS start_offset, substr(text, greatest(0, pos - 40) + 1, pos + 44 - greatest(0, pos - 40)) AS excerpt FROM a""")
def n07_excerpts(t):
    """All places of a term in all documents."""
    return _sql(t, "SELECT d.doc_id, e.* FROM {docs} d, LATERAL text_excerpts(d.text, 'Tion', 40) e", docs=t.documents)


@query("""
WITH k AS (SELECT p_partkey AS id, p_name FROM part)
SELECT id, CAST(0 AS INT) AS row, CAST(i - 1 AS INT) AS place, n[i] AS name, v[i] AS value FROM (
  SELECT id, CASE id % 5 WHEN 2 THEN ['name', 'deep.er.k'] ELSE ['id', 'who.name', 'who.tags', 'gone'] END AS n,
    CASE id % 5 WHEN 2 THEN [p_name, '1.5'] ELSE [CAST(id AS VARCHAR), p_name, '2', NULL] END AS v FROM k WHERE id % 5 < 3), LATERAL (SELECT unnest(range(1, len(n) + 1)) AS i)
UNION ALL SELECT id, 1, i - 1, ['id', 'x'][i], ['2', 'true'][i] FROM k, (SELECT unnest([1, 2]) AS i) WHERE id % 5 < 2""")
def n07_json_rows(t):
    """Fields of JSON contents of any shape."""
    return _sql(t, "SELECT d.id, r.* FROM {contents} d, LATERAL json_rows(d.content) r", contents=_contents(t).withColumn("id", F.col("id")))
