"""Queries over findings, pages, triples and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from subjectlens.functions import text as X
from subjectlens.operators import communities as L
from subjectlens.operators import entities as E
from subjectlens.operators import graph as G
from subjectlens.operators import indicators as I  # noqa: E741
from subjectlens.operators import relational as R
from subjectlens.operators.tables import written
from subjectlens.plans.cases import edges
from subjectlens.plans.registry import query

# ---------------------------------------------------------------- findings


@query()
def x20_findings(t):
    """All findings of all documents. Tested by pattern against Python's regular expressions."""
    return I.findings(t.documents)


#: Texts with findings of every kind, one after another, and what is found in them.
_KINDS = (
    "see http://a.example.com/x?y=1, hxxp://b[.]example[.]com and c[.]d[.]org end",
    "mail me at a.b@c.org or joe [at] x.org, ip 10.1.2.3 and 8[.]8[.]8[.]8 end",
    "aHR0cDovL2V4YW1wbGUuY29tL2E= and SFRUUDovL0VYQU1QTEUuQ09N ;",
    " ".join(("a" * 32, "0f" * 20, "ab" * 32, "c" * 128)),
    "fe80::1:2 and 2001:db8::ff00:42:8329 end",
    "4111 1111 1111 1111 no 4111 1111 1111 1112",
    '/* c */ import "pe"\nrule x : tag { meta: a = "b" condition: true }\n',
    "http%3A%2F%2Fexample.com%2Fa end",
    "687474703a2f2f6578616d706c652e636f6d end",
    "key Zx9Qw3Lk7Vb2Nm5Tr8Yp4Hd6 end c\\.d\\.net x",
)
_KINDS_SQL = """found(k, finding_type, value, risk_level, pattern, position) AS (VALUES
  (0, 'URL', 'http://a.example.com/x?y=1', 'low', 'GENERIC_URL', 0), (0, 'URL', 'hxxp://b[.]example[.]com', 'low', 'GENERIC_URL', 1), (0, 'URL', 'c[.]d[.]org', 'low',
    'BRACKET_URL', 2),
  (1, 'URL', '8[.]8[.]8[.]8', 'low', 'BRACKET_URL', 0), (1, 'IP', '10.1.2.3', 'low', 'IPV4', 1), (1, 'Email', 'a.b@c.org', 'medium', 'EMAIL', 2), (1, 'Email',
    'joe [at] x.org', 'medium', 'EMAIL', 3),
  (2, 'URL', 'aHR0cDovL2V4YW1wbGUuY29tL2E= and SFRUUDovL0VYQU1QTEUuQ09N', 'medium', 'B64ENCODED_URL', 0),
  (3, 'Credential', repeat('a', 32), 'high', 'MD5', 0), (3, 'Credential', repeat('0f', 20), 'high', 'SHA1', 1), (3, 'Credential', repeat('ab', 32), 'high', 'SHA256',
    2), (3, 'Credential', repeat('c', 128), 'high', 'SHA512', 3),
  (4, 'IP', 'fe80::1:2', 'low', 'IPV6', 0), (4, 'IP', '2001:db8::ff00:42:8329', 'low', 'IPV6', 1), (5, 'CreditCard', '4111 1111 1111 1111', 'critical', 'CREDIT_CARD', 0),
  (6, 'File', '/* c */ import "pe"' || chr(10) || 'rule x : tag { meta: a = "b" condition: true }', 'low', 'YARA', 0), (7, 'URL', 'http%3A%2F%2Fexample', 'medium',
    'URLENCODED_URL', 0),
  (8, 'URL', '687474703a2f2f6578616d706', 'medium', 'HEXENCODED_URL', 0), (9, 'URL', 'c\\.d\\.net', 'low', 'BACKSLASH_URL', 0), (9, 'Credential',
    'Zx9Qw3Lk7Vb2Nm5Tr8Yp4Hd6', 'high', 'HIGH_ENTROPY', 1)
), all_found AS (SELECT p_partkey AS doc_id, finding_type, value, risk_level, pattern, CAST(position AS INT) AS position FROM part JOIN found ON k = p_partkey % 10)"""


def _kinds(t):
    text = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("p_partkey") % len(_KINDS) + 1).cast("int"))
    return t.part.select(F.col("p_partkey").alias("doc_id"), text.alias("text"))


@query(f"WITH {_KINDS_SQL} SELECT doc_id, finding_type, value, risk_level, pattern, position FROM all_found")
def x01_findings_of_kinds(t):
    """Findings by all patterns, each value once by the first pattern that finds it."""
    return I.findings(_kinds(t))


@query(f"""
WITH {_KINDS_SQL} SELECT count(*) AS total, count(*) FILTER (risk_level = 'critical') AS critical, count(*) FILTER (risk_level = 'high') AS high,
  count(*) FILTER (risk_level = 'medium') AS medium, count(*) FILTER (risk_level = 'low') AS low,
  count(*) FILTER (doc_id % 2 <> 0) AS not_in_graph FROM all_found""")
def a16_risk_summary(t):
    """Findings by risk, and how many are not in the graph yet."""
    risk = F.col("risk_level")
    found = I.findings(_kinds(t)).withColumn("in_graph", F.col("doc_id") % 2 == 0)
    return R.count_where(found, total=F.lit(True), critical=risk == "critical", high=risk == "high", medium=risk == "medium", low=risk == "low", not_in_graph=~F.col("in_graph"))


@query("""
WITH f AS (SELECT p_partkey AS doc_id, ['Email', 'URL', 'Credential', 'CreditCard'][1 + p_partkey % 4] AS finding_type, p_name AS value, ['medium', 'low', 'high',
  'critical', 'high'][1 + p_partkey % 5] AS risk_level, p_size AS position FROM part)
SELECT doc_id, finding_type, left(value, 4) || '...' || left(sha256(value), 8) AS value, risk_level, CASE risk_level WHEN 'critical' THEN 4 ELSE 3 END AS rank FROM f
  WHERE risk_level IN ('critical', 'high') AND finding_type <> 'URL' AND contains(lower(value), 'a')
ORDER BY rank DESC, doc_id, position LIMIT 200""")
def p03_filtered_findings(t):
    """Findings by text, risk and type, worst first, masked, the first two hundred."""
    k = F.col("p_partkey")
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (k % len(v) + 1).cast("int"))
    found = t.part.select(k.alias("doc_id"), pick("Email", "URL", "Credential", "CreditCard").alias("finding_type"), F.col("p_name").alias("value"), pick("medium", "low", "high", "critical", "high").alias("risk_level"), F.col("p_size").alias("position"))
    rank = X.choose((F.col("risk_level") == "critical", 4), (F.col("risk_level") == "high", 3), (F.col("risk_level") == "medium", 2), otherwise=1)
    out = found.filter(F.col("risk_level").isin("critical", "high") & (F.col("finding_type") != "URL") & F.contains(F.lower("value"), F.lit("a")))
    return R.top(out.withColumn("rank", rank), 200, F.desc("rank"), F.col("doc_id"), F.col("position")).select("doc_id", "finding_type", I.masked(F.col("value")).alias("value"), "risk_level", "rank")


@query("""SELECT doc_id, array_to_string(list_sort(list_distinct([regexp_replace(x, '[^0-9. \\[\\]()\\\\]', '', 'g') FOR x IN regexp_extract_all(text,
  '(?:^|[^\\d.])((?:(?:25[0-5]|2[0-4]\\d|1\\d\\d|[1-9]?\\d)\\.){3}(?:25[0-5]|2[0-4]\\d|1\\d\\d|[1-9]?\\d))(?:[^\\d.]|$)', 1)])), ' ') AS ips
FROM documents WHERE regexp_matches(text, '(?:^|[^\\d.])((?:(?:25[0-5]|2[0-4]\\d|1\\d\\d|[1-9]?\\d)\\.){3}(?:25[0-5]|2[0-4]\\d|1\\d\\d|[1-9]?\\d))(?:[^\\d.]|$)')""")
def x07_ip_addresses(t):
    """One pattern of the table."""
    found = I.matches(F.col("text"), I.named("IPV4")[0])
    return t.documents.select("doc_id", found.alias("v")).filter(F.size("v") > 0).select("doc_id", F.array_join(F.array_sort("v"), " ").alias("ips"))


@query("""
SELECT s_suppkey AS doc_id, md5(s_name) AS md5, CASE WHEN s_suppkey % 2 = 0 THEN sha1(s_name)
  ELSE '' END AS sha1, upper(sha256(s_name)) || ' ' || sha256(s_name) AS sha256, md5('a') || md5('b') || md5('c') || md5(s_name) AS sha512 FROM supplier""")
def x10_hashes(t):
    """Hashes by length; longer runs of digits are no hashes."""
    name = F.col("s_name")
    long = F.concat(F.md5(F.lit("a")), F.md5(F.lit("b")), F.md5(F.lit("c")), F.md5(name))
    text = F.concat_ws(" ", F.lit("key:"), F.md5(name), F.when(F.col("s_suppkey") % 2 == 0, F.sha1(name)), F.concat(F.lit("<"), F.upper(F.sha2(name, 256)), F.lit(">;")), F.sha2(name, 256), long, F.concat(long, F.lit("0")))
    shown = [F.array_join(F.array_sort(f"h.{c}"), " ").alias(c) for c in ("md5", "sha1", "sha256", "sha512")]
    return t.supplier.select(F.col("s_suppkey").alias("doc_id"), I.hashes(text).alias("h")).select("doc_id", *shown)


@query("""WITH c AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[0-9]{4}[ ]?[-]?[0-9]{4}[ ]?[-]?[0-9]{4}[ ]?[-]?[0-9]{4}')) AS v
  FROM documents), d AS (SELECT *, regexp_replace(v, '\\D', '', 'g') AS g FROM c)
SELECT doc_id, v AS value FROM d WHERE (SELECT sum(CASE WHEN i % 2 = 1 THEN CASE WHEN x * 2 > 9 THEN x * 2 - 9 ELSE x * 2 END ELSE x END) % 10 = 0
  FROM (SELECT i, CAST(substr(g, 16 - CAST(i AS INT), 1) AS INT) AS x FROM range(16) r(i)))""")
def x14_credit_cards(t):
    return I.findings(t.documents, I.named("CREDIT_CARD")).select("doc_id", "value")


@query("""WITH c AS (SELECT doc_id, len(list_distinct(regexp_extract_all(text, '(?i)\\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\\.[A-Z]{2,}\\b'))) AS e,
  len(list_distinct(regexp_extract_all(text, '\\b(?:\\d{1,3}\\.){3}\\d{1,3}\\b'))) AS i,
[x FOR x IN ['health', 'medical', 'biometric', 'precise location', 'gps', 'financial', 'passport', 'national insurance'] IF contains(lower(text), x)] AS s FROM documents)
SELECT doc_id, 'email' AS kind, CAST(e AS INT) AS count, 0.9::DOUBLE AS confidence, '' AS source FROM c WHERE e > 0 UNION ALL
  SELECT doc_id, 'ip', CAST(i AS INT), 0.85::DOUBLE, '' FROM c WHERE i > 0
UNION ALL SELECT doc_id, 'sensitive_terms', CAST(len(s) AS INT), 0.7::DOUBLE, array_to_string(s, ', ') FROM c WHERE len(s) > 0""")
def x23_risk_signals(t):
    """X23, C09, A25."""
    return I.risk_signals(t.documents)


#: Addresses of a page's links with what they resolve to.
_HREFS = (
    ("guide.html", "https://www.shop.example/docs/guide.html", "internal"),
    ("../up/./a.PDF?x=1#top", "https://www.shop.example/up/a.PDF?x=1", "internal"),
    ("/root/file.zip", "https://www.shop.example/root/file.zip", "internal"),
    ("//cdn.example.net/p.png", "https://cdn.example.net/p.png", "external"),
    ("HTTP://Other.example/x#y", "http://Other.example/x", "external"),
    ("?page=2", "https://www.shop.example/docs/index.html?page=2", "internal"),
    ("#part", "https://www.shop.example/docs/index.html", "internal"),
    ("mailto:a@b.org", None, None),
    ("javascript:void(0)", None, None),
    ("https://www.shop.example/s.mp4", "https://www.shop.example/s.mp4", "internal"),
)
_HREFS_SQL = ", ".join(f"('{h}', " + (f"'{u}', '{k}')" if u else "NULL, NULL)") for h, u, k in _HREFS)


@query(f"""
WITH h(href, link, kind) AS (VALUES {_HREFS_SQL}), own AS (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<(?:a|link)\\s[^>]*?href=["'']([^"''>]*)["'']', 1)) AS href FROM pages),
l AS (
  SELECT page_id, link, kind FROM pages, h WHERE link IS NOT NULL
  UNION ALL SELECT page_id, 'https://www.shop.example' || regexp_replace(href, '#.*$', ''), 'internal' FROM own WHERE href LIKE '/%' AND href NOT LIKE '//%'
  UNION ALL SELECT page_id, regexp_replace(href, '#.*$', ''), CASE WHEN href LIKE 'https://www.shop.example/%' THEN 'internal' ELSE 'external' END FROM own WHERE regexp_matches(href, '^https?://')
)
SELECT page_id, link, kind, regexp_matches(lower(link), '\\.(pdf|docx?|xlsx?|zip|rar|tar|gz|jpe?g|png|gif|svg|mp[34]|avi|mov)$') AS downloadable, count(*) AS n FROM l GROUP BY ALL""")
def x25_links(t):
    """Links of all pages and some of each form, resolved, without fragments, internal or external, and whether they are downloads."""
    tags = [f'<a class="x" href="{h}">go</a>' if i % 2 else f"<link rel=x href='{h}'>" for i, (h, _, _) in enumerate(_HREFS)]
    html = F.concat_ws("\n", "html", F.lit("\n".join(tags)))
    return linked(t.pages.select("page_id", F.lit("https://www.shop.example/docs/index.html").alias("url"), html.alias("html")))


@query("""
WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<(?:a|link)\\s[^>]*?href=["'']([^"''>]*)["'']', 1)) AS href FROM pages)
SELECT page_id, count(*) AS n FROM l WHERE regexp_matches(href, '^https?://') OR NOT regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:') GROUP BY 1""")
def x25_link_counts(t):
    """How many links of each page lead to web addresses."""
    return linked(t.pages).groupBy("page_id").agg(F.sum("n").alias("n"))


def linked(pages):
    """(page_id, link, kind, downloadable, n) of pages(page_id, url, html)."""
    host = lambda v: F.regexp_extract(v, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    rows = pages.select("page_id", "url", F.explode(X.hrefs(F.col("html"))).alias("href"))
    rows = rows.select("page_id", host(F.col("url")).alias("host"), X.resolved(F.col("href"), F.col("url")).alias("link")).filter("link is not null")
    kind = F.when(host(F.col("link")) == F.col("host"), "internal").otherwise("external")
    return rows.groupBy("page_id", "link", kind.alias("kind"), X.is_download(F.col("link")).alias("downloadable")).agg(F.count("*").alias("n"))


@query("""
WITH n AS (SELECT s_suppkey, lower(replace(s_name, '#', '')) AS u FROM supplier)
SELECT s_suppkey, platform, replace(url, '{}', u) AS url, 'supplier' || s_suppkey || '.example.org' AS domain
  FROM n, (VALUES ('github', 'https://github.com/{}'), ('twitter', 'https://twitter.com/{}'), ('instagram', 'https://instagram.com/{}'),
('linkedin', 'https://linkedin.com/in/{}'), ('facebook', 'https://facebook.com/{}'), ('tiktok', 'https://tiktok.com/@{}'), ('youtube', 'https://youtube.com/@{}'),
  ('reddit', 'https://reddit.com/user/{}'), ('pinterest', 'https://pinterest.com/{}'), ('medium', 'https://medium.com/@{}')) p(platform, url)""")
def x27_enrichments(t):
    """Enrichments without a network: an address's domain and the profile URLs of a name on ten platforms."""
    name = F.lower(F.replace("s_name", F.lit("#"), F.lit("")))
    mail = F.concat(F.lit("info@supplier"), "s_suppkey", F.lit(".example.org"))
    profiles = F.explode(F.create_map(*[F.lit(x) for kv in X.PROFILE_URL_OF.items() for x in kv])).alias("platform", "url")
    rows = t.supplier.select("s_suppkey", name.alias("name"), F.split_part(mail, F.lit("@"), F.lit(2)).alias("domain"), profiles)
    return rows.select("s_suppkey", "platform", F.replace("url", F.lit("{}"), F.col("name")).alias("url"), "domain")


@query("""
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'http://a' || p_partkey || '.example.com/x,evil[.]example[.]com' WHEN 1 THEN 'https://b.org/p' ELSE '' END AS urls FROM part""")
def u07_text_urls(t):
    """URLs of a text by the three patterns for text, each once."""
    k = F.col("p_partkey")
    text = F.when(k % 3 == 0, F.concat(F.lit("go http://a"), k, F.lit(".example.com/x or evil[.]example[.]com now"))).when(k % 3 == 1, "see https://b.org/p end").otherwise("nothing to see")
    found = F.filter(I.urls(text), lambda u: ~F.startswith(u, F.lit("http")) | F.contains(u, F.lit("://")))
    return t.part.select("p_partkey", F.array_join(F.array_sort(found, lambda a, b: F.when(F.startswith(a, F.lit("http")), -1).otherwise(1)), ",").alias("urls"))


# ---------------------------------------------------------------- triples and entities

_MESSY_SQL = """messy AS (SELECT ' ' || s || ' ' AS s, lower(p) AS p, upper(o) AS o, round(confidence / 2, 3)::DOUBLE AS confidence, seq * 2 + 1 AS seq FROM edges UNION ALL SELECT s, p, o, confidence, seq * 2 FROM edges
UNION ALL SELECT '', p, o, confidence, seq * 2 FROM edges WHERE seq % 7 = 0)"""


def _messy(t):
    e = edges(t)
    a = e.select(F.concat(F.lit(" "), "s", F.lit(" ")).alias("s"), F.lower("p").alias("p"), F.upper("o").alias("o"), F.round(F.col("confidence") / 2, 3).alias("confidence"), (F.col("seq") * 2 + 1).alias("seq"))
    b = e.withColumn("seq", F.col("seq") * 2)
    return a.unionByName(b).unionByName(b.filter("(seq div 2) % 7 = 0").withColumn("s", F.lit("")))


@query(f"""WITH {_MESSY_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY lower(trim(s)), upper(trim(p)), lower(trim(o)) ORDER BY confidence DESC, seq) AS r
  FROM messy WHERE trim(s) <> '' AND trim(p) <> '' AND trim(o) <> '')
SELECT s, p, o, confidence, seq FROM k WHERE r = 1""")
def w03_distinct_triples(t):
    """Valid triples, each once."""
    return E.dedup_triples(_messy(t).filter(E.is_valid()))


_SPELLED_SQL = """spelled AS (
  SELECT CASE k WHEN 0 THEN 'The ' || s || ' Group' WHEN 1 THEN upper(s) || ' group' WHEN 2 THEN s || ' of Group' ELSE s || ' Group Holding' END AS s, p,
    CASE k WHEN 0 THEN 'Info.' || replace(replace(o, '_', ''), ' ', '') || '@gmail.com'
      WHEN 1 THEN 'info' || lower(replace(replace(o, '_', ''), ' ', '')) || '+x@gmail.com' WHEN 2 THEN 'of the' ELSE 'No ' || o END AS o, confidence, seq * 4 + k AS seq
  FROM edges, (SELECT unnest([0, 1, 2, 3]) AS k) WHERE k < 2 OR seq % 2 = 0
), uses AS (SELECT lower(x) AS name, count(*) AS n FROM (SELECT s AS x FROM spelled UNION ALL SELECT o FROM spelled) GROUP BY 1),
keyed AS (
  SELECT *, CASE WHEN contains(name, '@') THEN replace(split_part(split_part(name, '@', 1), '+', 1), '.', '') || '@' || split_part(name, '@', 2)
    ELSE array_to_string([w FOR w IN regexp_extract_all(name,
      '\\w+') IF w NOT IN ('the','a','an','of','and','or','in','on','at','to','for','with','by','as','is','are','was','were')], ' ') END AS key FROM uses
), canon AS (SELECT name, first_value(name) OVER (PARTITION BY key ORDER BY n DESC, len(name), name) AS canonical FROM keyed WHERE key <> ''),
rooted AS (SELECT *, CASE WHEN len(split_part(canonical, ' ', 1)) >= 4 THEN split_part(canonical, ' ', 1) ELSE canonical END AS root FROM canon),
mapping AS (SELECT name, CASE WHEN len(root) >= 4 THEN first_value(canonical) OVER (PARTITION BY root ORDER BY len(canonical), canonical)
  ELSE canonical END AS canonical FROM rooted)"""


def _spelled(t):
    """The edges with names and e-mails in several spellings of one entity."""
    e = edges(t).select("*", F.explode(F.array(*map(F.lit, range(4)))).alias("k")).filter("k < 2 or seq % 2 = 0")
    k, s, o = F.col("k"), F.col("s"), F.col("o")
    plain = F.replace(F.replace(o, F.lit("_"), F.lit("")), F.lit(" "), F.lit(""))
    name = X.choose((k == 0, F.concat(F.lit("The "), s, F.lit(" Group"))), (k == 1, F.concat(F.upper(s), F.lit(" group"))), (k == 2, F.concat(s, F.lit(" of Group"))), otherwise=F.concat(s, F.lit(" Group Holding")))
    other = X.choose((k == 0, F.concat(F.lit("Info."), plain, F.lit("@gmail.com"))), (k == 1, F.concat(F.lit("info"), F.lower(plain), F.lit("+x@gmail.com"))), (k == 2, "of the"), otherwise=F.concat(F.lit("No "), o))
    return e.select(name.alias("s"), "p", other.alias("o"), "confidence", (F.col("seq") * 4 + k).alias("seq"))


@query(f"WITH {_SPELLED_SQL} SELECT name, canonical FROM mapping")
def e03_canonical_names(t):
    """Spellings of one entity under its most used name, then names with one root under the shortest."""
    return E.root_merged(E.canonical_names(E.uses(_spelled(t))))


@query(f"""
WITH {_SPELLED_SQL} SELECT coalesce(a.canonical, s) AS s, p, coalesce(b.canonical, o) AS o, confidence, seq FROM spelled LEFT JOIN mapping a ON a.name = lower(s) LEFT
  JOIN mapping b ON b.name = lower(o)""")
def e05_resolved_triples(t):
    """Canonical ends; what has no key keeps its own spelling."""
    return E.resolve(_spelled(t))


@query(f"""
WITH {_SPELLED_SQL}, given AS (SELECT lower('The ' || n_name || ' Group') AS name, 'given ' || n_nationkey AS canonical
  FROM nation), every AS (SELECT coalesce(m.name, g.name) AS name, coalesce(g.canonical, m.canonical) AS canonical FROM mapping m FULL JOIN given g ON g.name = m.name)
SELECT coalesce(a.canonical, s) AS s, p, coalesce(b.canonical, o) AS o, confidence, seq FROM spelled LEFT JOIN every a ON a.name = lower(s) LEFT
  JOIN every b ON b.name = lower(o)""")
def e06_overridden_names(t):
    """A model's groups come before the rules."""
    given = t.nation.select(F.lower(F.concat(F.lit("The "), "n_name", F.lit(" Group"))).alias("name"), F.concat(F.lit("given "), "n_nationkey").alias("canonical"))
    return E.resolve(_spelled(t), given)


def _merging(t):
    """Nations to be merged into their regions, with edges among them, to their regions and to suppliers."""
    nodes = t.nation.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.create_map(F.lit("name"), F.col("n_name"), F.lit("own"), F.lit("nation")).alias("props"))
    nodes = nodes.unionByName(t.region.select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.create_map(F.lit("kind"), F.lit("region"), F.lit("own"), F.lit("region")).alias("props")))
    key, region = F.col("n_nationkey"), F.col("n_regionkey")
    link = lambda src, dst, kind, seq: t.nation.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type"), seq.cast("long").alias("seq"))
    n, r = F.concat(F.lit("n"), key), F.concat(F.lit("r"), region)
    links = link(n, r, "PART_OF", key).unionByName(link(n, F.concat(F.lit("s"), key % 3), "HOLDS", key + 100)).unionByName(link(F.concat(F.lit("s"), key % 2), n, "SEES", key + 200))
    return nodes, links, t.nation.select(n.alias("source"), r.alias("target"))


@query("""
WITH m AS (SELECT n_regionkey AS r, min('n' || n_nationkey) AS first, string_agg('n' || n_nationkey, ',' ORDER BY 'n' || n_nationkey) AS merged_from FROM nation GROUP BY 1)
SELECT 'r' || r_regionkey AS id, 'region' AS own, 'region' AS kind, n_name AS name, merged_from FROM region LEFT JOIN m ON r = r_regionkey LEFT
  JOIN nation ON 'n' || n_nationkey = first""")
def e08_merged_nodes(t):
    """Nations go into their regions: a region keeps its own properties and gains those that it lacks, from the first by id."""
    merged, _ = E.merge_nodes(*_merging(t))
    at = lambda k: F.try_element_at("props", F.lit(k)).alias(k)
    return merged.select("id", at("own"), at("kind"), at("name"), "merged_from")


@query("""
SELECT 'r' || n_regionkey AS src, 's' || (n_nationkey % 3) AS dst, 'HOLDS' AS type, CAST(min(n_nationkey) + 100 AS BIGINT) AS seq FROM nation GROUP BY 1, 2 UNION ALL
  SELECT 's' || (n_nationkey % 2), 'r' || n_regionkey, 'SEES', CAST(min(n_nationkey) + 200 AS BIGINT) FROM nation GROUP BY 1, 2""")
def e08_moved_edges(t):
    """Edges move to the target; those between the two go, of equal ones the first stays."""
    return E.merge_nodes(*_merging(t))[1]


# ---------------------------------------------------------------- graphs


@query("""WITH RECURSIVE b AS (SELECT lower(s) AS u, lower(o) AS v FROM edges UNION SELECT lower(o), lower(s) FROM edges), r AS (SELECT u AS node, u AS c FROM b UNION
  SELECT b.v, r.c FROM r JOIN b ON b.u = r.node)
SELECT node, min(c) AS component FROM r GROUP BY node""")
def g03_components(t):
    return G.weak_components(edges(t))


@query("SELECT lower(s) AS node, string_agg(DISTINCT lower(o), ',' ORDER BY lower(o)) AS neighbours FROM edges GROUP BY 1")
def g01_adjacency(t):
    """G01, G02."""
    return G.adjacency(edges(t)).select("node", F.array_join("neighbours", ",").alias("neighbours"))


@query("""WITH n AS (SELECT DISTINCT lower(s) AS s FROM edges UNION SELECT lower(o) FROM edges), d AS (SELECT DISTINCT lower(s) AS u, lower(o) AS v FROM edges UNION
  SELECT lower(o), lower(s) FROM edges)
SELECT u AS node, count(*) AS degree, round(count(*) / ((SELECT count(*) FROM n) - 1.0), 8)::DOUBLE AS centrality FROM d GROUP BY u""")
def g18_degree(t):
    return G.degree_centrality(edges(t)).withColumn("centrality", F.round("centrality", 8))


@query("""WITH w AS (SELECT DISTINCT lower(p_name || ' ' || p_type || ' ' || p_brand || ' s' || (p_size % 5)) AS name
  FROM part), x AS (SELECT name, list_distinct(string_split(name, ' ')) AS w FROM w)
SELECT a.name AS s, b.name AS o, round(len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))), 6)::DOUBLE AS confidence FROM x a
  JOIN x b ON a.name < b.name
WHERE len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) >= 0.6""")
def g08_similar_names(t):
    """Names of parts that share most of their words."""
    names = t.part.select(F.lower(F.concat_ws(" ", "p_name", "p_type", "p_brand", F.concat(F.lit("s"), F.col("p_size") % 5))).alias("name"))
    return G.similar_names(names, edges(t), 0.6).withColumn("confidence", F.round("confidence", 6))


_PATHS_SQL = """b AS (SELECT lower(s) AS x, lower(o) AS y FROM edges UNION SELECT lower(o), lower(s) FROM edges), st AS (SELECT DISTINCT lower(n_name) AS node FROM nation),
p0 AS (SELECT node AS start, node AS pos, [node] AS path FROM st),
p1 AS (SELECT start, y AS pos, min(list_append(path, y)) AS path FROM p0 JOIN b ON x = pos WHERE y <> start GROUP BY 1, 2),
p2 AS (SELECT start, y AS pos, min(list_append(path, y)) AS path FROM p1 JOIN b ON x = pos WHERE y <> start AND (start, y) NOT IN (SELECT start, pos FROM p1) GROUP BY 1, 2),
p3 AS (SELECT start, y AS pos, min(list_append(path, y)) AS path FROM p2 JOIN b ON x = pos WHERE y <> start AND (start, y) NOT IN (SELECT start, pos FROM p1)
  AND (start, y) NOT IN (SELECT start, pos FROM p2) GROUP BY 1, 2),
goals AS (SELECT lower(n_name) AS node FROM nation UNION SELECT lower(s_name) FROM supplier),
found AS (SELECT start, pos AS goal, CAST(len(path) - 1 AS INT) AS hops, path FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3) SEMI
  JOIN goals ON node = pos)"""


def _paths(t):
    nations = t.nation.select(F.lower("n_name").alias("node")).distinct()
    return G.paths(edges(t), nations, nations.union(t.supplier.select(F.lower("s_name"))).distinct(), 3)


@query(f"WITH {_PATHS_SQL} SELECT start, goal, hops, array_to_string(path, '>') AS path FROM found")
def g10_paths(t):
    """How nations reach nations and suppliers with two nodes between at most; the first of the shortest paths."""
    return _paths(t).select("start", "goal", "hops", F.array_join("path", ">").alias("path"))


@query(f"""
WITH {_PATHS_SQL} SELECT start, goal, CAST(k - 1 AS INT) AS step, path[k] AS s, path[k + 1] AS o, 0.8::DOUBLE AS confidence
  FROM (SELECT *, unnest(range(1, len(path))) AS k FROM found)""")
def g11_chains(t):
    """Paths as edges."""
    return G.chain_edges(_paths(t))


@query("""
WITH m AS (SELECT c_name AS node, 'c' || c_nationkey AS community FROM customer), s AS (SELECT community, count(*) AS n FROM m GROUP BY 1 ORDER BY n DESC, community LIMIT 5)
SELECT community, node, n, CAST(row_number() OVER (PARTITION BY community ORDER BY node) AS INT) AS rank FROM m JOIN s USING (community) QUALIFY rank <= 3""")
def g06_representatives(t):
    """Three members of each of the five largest communities, for a model to relate."""
    return G.cross_pairs(t.customer.select(F.col("c_name").alias("node"), F.concat(F.lit("c"), "c_nationkey").alias("community")))


@query()
def g04_communities(t):
    """Communities by modularity; tested against the same moves in plain Python and a sequential Louvain."""
    return L.louvain(edges(t))


def _supply(t):
    """Suppliers and the parts that they deliver, weighted by the lines."""
    lines = t.lineitem.groupBy("l_suppkey", "l_partkey").agg(F.count("*").cast("double").alias("confidence"))
    return lines.select(F.concat(F.lit("Supplier "), "l_suppkey").alias("s"), F.lit("DELIVERS").alias("p"), F.concat(F.lit("Part "), "l_partkey").alias("o"), "confidence", F.lit(0).cast("long").alias("seq"))


@query()
def g04_supply_communities(t):
    """Communities of suppliers and the parts that they deliver, of all order lines."""
    return L.louvain(_supply(t))


@query()
def g04_modularity(t):
    """How many communities the two methods find among suppliers and parts, and their modularity."""
    supply = _supply(t)
    pairs = written(L.weighted_pairs(supply), "links")
    roots = written(G.components(pairs), "roots") if 2 * pairs.count() > L.LOCAL_LINKS else None
    row = lambda name, members: L.modularity_of(pairs, members).select(F.lit(name).alias("method"), "n_communities", F.round("modularity", 8).alias("modularity"))
    return row("louvain", L.louvain_of(pairs, roots=roots)).unionByName(row("labels", written(G.label_propagation(supply, roots=roots), "labels")))


@query()
def g20_eigenvector(t):
    """Eigenvector centrality and sizes; tested against power iteration in numpy."""
    return G.node_sizes(G.eigenvector_centrality(edges(t)).withColumn("centrality", F.round("centrality", 6)), "centrality")


@query("SELECT n_name AS company, count(DISTINCT s_suppkey) AS n_accounts, array_to_string(list_sort(list_distinct(list(s_name)))[1:5], ',') AS accounts FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name ORDER BY n_accounts DESC, n_name LIMIT 10")
def j10_accounts_by_company(t):
    """Optional hop, distinct members (five of them) and counts, the first ten."""
    by = t.nation.join(t.supplier, F.col("s_nationkey") == F.col("n_nationkey"), "left").groupBy(F.col("n_name").alias("company"))
    out = by.agg(F.count_distinct("s_suppkey").alias("n_accounts"), F.array_join(F.slice(F.array_sort(F.collect_set("s_name")), 1, 5), ",").alias("accounts"))
    return R.top(out, 10, F.desc("n_accounts"), F.col("company"))


@query("SELECT o AS attribute, string_agg(DISTINCT s, ',' ORDER BY s) AS shared_by, count(DISTINCT s) AS n FROM edges GROUP BY o HAVING count(DISTINCT s) > 1")
def j11_shared_attribute(t):
    """Attributes with all who share them."""
    by = edges(t).groupBy(F.col("o").alias("attribute")).agg(F.array_sort(F.collect_set("s")).alias("m"))
    return by.filter("size(m) > 1").select("attribute", F.array_join("m", ",").alias("shared_by"), F.size("m").cast("long").alias("n"))


@query("""WITH keep AS (SELECT n_name AS node FROM nation WHERE n_nationkey < 10 UNION SELECT r_name FROM region) SELECT s, p, o FROM edges SEMI
  JOIN keep k ON k.node = s SEMI JOIN keep k2 ON k2.node = o""")
def j15_visible_links(t):
    """Links with both ends among the shown nodes."""
    keep = t.nation.filter("n_nationkey < 10").select(F.col("n_name").alias("node")).union(t.region.select("r_name"))
    return edges(t).join(keep, F.col("s") == F.col("node"), "left_semi").join(keep.withColumnRenamed("node", "m"), F.col("o") == F.col("m"), "left_semi").select("s", "p", "o")


@query("SELECT o AS node FROM edges WHERE s = 'NATION_3' UNION SELECT s FROM edges WHERE o = 'NATION_3' UNION SELECT 'NATION_3'")
def j16_neighbourhood(t):
    """One hop both ways and the node itself."""
    e = edges(t)
    return e.filter("s = 'NATION_3'").select(F.col("o").alias("node")).union(e.filter("o = 'NATION_3'").select("s")).union(t.spark.range(1).select(F.lit("NATION_3"))).distinct()


@query("""
SELECT p AS predicate, count(*) AS n, (SELECT count(*) FROM (SELECT s FROM edges UNION SELECT o FROM edges)) AS n_nodes, (SELECT count(*)
  FROM edges) AS n_edges, (SELECT count(*) FROM edges WHERE seq % 3 = 0) AS inferred,
  (SELECT count(*) FROM edges WHERE seq % 3 <> 0) AS original FROM edges GROUP BY p ORDER BY n DESC, p LIMIT 10""")
def a19_graph_stats(t):
    """Nodes, edges, inferred and original ones, and the ten most frequent predicates."""
    e = edges(t).withColumn("inferred", F.col("seq") % 3 == 0)
    nodes = e.select("s").union(e.select("o")).agg(F.count_distinct("s").alias("n_nodes"))
    by = R.top(e.groupBy(F.col("p").alias("predicate")).agg(F.count("*").alias("n")), 10, F.desc("n"), F.col("predicate"))
    counts = R.count_where(e, n_edges=F.lit(True), inferred=F.col("inferred"), original=~F.col("inferred"))
    return by.join(F.broadcast(nodes)).join(F.broadcast(counts))  # one row each


@query("""SELECT s, p, o, confidence, seq % 3 = 0 AS inferred FROM edges WHERE (NOT (seq % 3 = 0) OR confidence >= 0.7) AND lower(s) <> lower(o)""")
def p13_confidence_gate(t):
    """P13, P14."""
    return E.gate(edges(t).withColumn("inferred", F.col("seq") % 3 == 0), 0.7).filter("lower(s) <> lower(o)").select("s", "p", "o", "confidence", "inferred")


@query("SELECT s_suppkey, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE contains(lower(s_name || '|' || n_name), 'nation_1')")
def p05_any_property(t):
    """Nodes with a property value that contains the text."""
    props = F.create_map(F.lit("name"), F.col("s_name"), F.lit("nation"), F.col("n_name"), F.lit("embedding"), F.lit("nation_1"))
    rows = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).withColumn("props", props)
    return rows.filter(F.exists(F.map_entries("props"), lambda e: (e["key"] != "embedding") & F.contains(F.lower(e["value"]), F.lit("nation_1")))).select("s_suppkey", "s_name")
