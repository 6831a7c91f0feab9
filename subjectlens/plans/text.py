"""Queries over the column functions and the chunkers."""

from __future__ import annotations

from pyspark.sql import functions as F

from subjectlens.functions import text as X
from subjectlens.functions import values as V
from subjectlens.operators import chunking
from subjectlens.plans.cases import EVENT_NOW, REQUEST_NOW, companies, files, messages, requests
from subjectlens.plans.registry import query

_STOPS = "('A','AN','THE','OF','WITH','BY','TO','FROM','IN','ON','FOR')"
_WORDS = "('the','a','an','of','and','or','in','on','at','to','for','with','by','as','is','are','was','were')"

#: Addresses of five kinds made from customers, for the functions on addresses.
ADDRESSES_SQL = """addresses AS (SELECT company_id, CASE company_id % 5 WHEN 0 THEN 'User.' || company_id || '+news@Gmail.com' WHEN 1 THEN '+44 20 ' || (1000 + company_id)
WHEN 2 THEN 'https://www.Shop' || company_id || '.example.com:8080/p?q=1' WHEN 3 THEN 'Shop' || company_id || '.Example.org'
  ELSE 'The Office of ' || company_name END AS v FROM companies)"""


def _addresses(t):
    k = F.col("company_id")
    v = X.choose(
        (k % 5 == 0, F.concat(F.lit("User."), k, F.lit("+news@Gmail.com"))), (k % 5 == 1, F.concat(F.lit("+44 20 "), k + 1000)),
        (k % 5 == 2, F.concat(F.lit("https://www.Shop"), k, F.lit(".example.com:8080/p?q=1"))), (k % 5 == 3, F.concat(F.lit("Shop"), k, F.lit(".Example.org"))),
        otherwise=F.concat(F.lit("The Office of "), F.col("company_name")),
    )
    return companies(t).select("company_id", v.alias("v"))


@query(f"""WITH p AS (SELECT p_partkey, p_type || ' of  the-' || p_name AS phrase FROM part),
q AS (SELECT *, regexp_replace(upper(trim(phrase)), '[ _-]+', '_', 'g') AS pred FROM p), w AS (SELECT *, string_split(pred, '_') AS w FROM q)
SELECT p_partkey, pred, CASE WHEN len(w) <= 3 THEN pred WHEN w[3] NOT IN {_STOPS} THEN w[1] || '_' || w[2] || '_' || w[3]
WHEN w[2] NOT IN {_STOPS} THEN w[1] || '_' || w[2] WHEN w[1] NOT IN {_STOPS} THEN w[1] ELSE w[1] || '_' || w[2] || '_' || w[3] END AS short FROM w""")
def f01_predicates(t):
    """F01, F02."""
    phrase = F.concat("p_type", F.lit(" of  the-"), "p_name")
    return t.part.select("p_partkey", X.predicate(phrase).alias("pred"), X.short_predicate(phrase).alias("short"))


@query(f"SELECT p_partkey, array_to_string([w FOR w IN regexp_extract_all(lower('The ' || p_name || ', of ' || p_brand || ' with An'), '\\w+') IF w NOT IN {_WORDS}], ' ') AS entity FROM part")
def f03_entities(t):
    return t.part.select("p_partkey", X.entity(F.concat(F.lit("The "), "p_name", F.lit(", of "), "p_brand", F.lit(" with An"))).alias("entity"))


@query(f"""
WITH {ADDRESSES_SQL},
k AS (
  SELECT *, CASE company_id % 5 WHEN 0 THEN 'email' WHEN 1 THEN 'phone' WHEN 2 THEN 'url' WHEN 3 THEN 'domain' ELSE 'text' END AS kind FROM addresses
)
SELECT company_id, kind,
  CASE kind WHEN 'email' THEN 'user' || company_id || '@gmail.com' WHEN 'phone' THEN '+4420' || (1000 + company_id)
    WHEN 'url' THEN 'www.shop' || company_id || '.example.com:8080' WHEN 'domain' THEN lower(v)
    ELSE array_to_string([w FOR w IN regexp_extract_all(lower(v), '\\w+') IF w NOT IN {_WORDS}], ' ') END AS key,
  CASE kind WHEN 'url' THEN 'shop' || company_id || '.example.com:8080' ELSE '' END AS domain,
  CASE kind WHEN 'url' THEN 'Shop' || company_id || ' example' ELSE '' END AS company,
  CASE kind WHEN 'url' THEN 'example' WHEN 'email' THEN '+news@gmail' END AS root
FROM k""")
def f04_addresses(t):
    """Kind of an address, the key of its spellings, its domain, company and root."""
    v = F.col("v")
    root = F.when(X.entity_kind(v) == "url", X.root_token(v)).when(X.entity_kind(v) == "email", F.concat(F.lit("+news@"), X.root_token(F.substring_index(v, "@", -1))))
    return _addresses(t).select("company_id", X.entity_kind(v).alias("kind"), X.entity_key(v).alias("key"), X.bare_domain(v).alias("domain"), X.company_of(v).alias("company"), root.alias("root"))


@query("""WITH v AS (SELECT s_suppkey, md5(s_name) || upper(md5(s_name || 'x')) AS v, lpad(CAST(s_suppkey * 7919 + 4785380592391139 AS VARCHAR), 16, '0') AS card FROM supplier),
c AS (SELECT s_suppkey, c, count(*) / 64.0 AS p FROM (SELECT s_suppkey, unnest(string_split(v, '')) AS c FROM v)
  GROUP BY 1, 2), e AS (SELECT s_suppkey, round(-sum(p * log2(p)), 6)::DOUBLE AS entropy FROM c GROUP BY 1)
SELECT s_suppkey, entropy, entropy > 4.5 AS high, (SELECT sum(CASE WHEN i % 2 = 1 THEN CASE WHEN d * 2 > 9 THEN d * 2 - 9 ELSE d * 2 END ELSE d END) % 10 = 0
FROM (SELECT i, CAST(substr(card, 16 - CAST(i AS INT), 1) AS INT) AS d FROM range(16) r(i))) AS luhn FROM v JOIN e USING (s_suppkey)""")
def f13_entropy_luhn(t):
    """F13, F14."""
    v = F.concat(F.md5("s_name"), F.upper(F.md5(F.concat("s_name", F.lit("x")))))
    card = F.lpad((F.col("s_suppkey") * 7919 + F.lit(4785380592391139)).cast("string"), 16, "0")
    entropy = F.round(X.entropy(v), 6)
    return t.supplier.select("s_suppkey", entropy.alias("entropy"), (entropy > 4.5).alias("high"), X.luhn(card).alias("luhn"))


@query(f"""
WITH {ADDRESSES_SQL}
SELECT company_id, replace(replace(v, 'http', 'hxxp'), '.', '[.]') AS defanged, v AS refanged,
  replace(replace(replace(v, ' ', ''), '(', ''), ')', '') AS tidy,
  CASE WHEN contains(v, ':') THEN 6 ELSE 4 END AS version, 'https://www.gravatar.com/avatar/' || md5(lower(v)) AS gravatar,
  CASE company_id % 6 WHEN 0 THEN 'u' || company_id || '@github' WHEN 1 THEN 'u' || company_id WHEN 2 THEN 'AS' || company_id
    WHEN 3 THEN 'btc:' || left(v, 12) || '...' WHEN 4 THEN 'Email: ' || left(v, 50) ELSE v END AS label,
  CASE WHEN company_id % 5 IN (3) THEN lower(v) END AS valid_domain, split_part(v, '@', 2) AS provider, lower(replace(v, ' ', '_')) AS slug,
  CASE WHEN len(v) > 12 THEN left(v, 12) || '...' ELSE v END AS short
FROM addresses""")
def f15_address_scalars(t):
    """F15-F21, F35, F50. Labels (F17) of six classes in turn."""
    v, k = F.col("v"), F.col("company_id")
    name = F.concat(F.lit("u"), k)
    kind = X.choose((k % 6 < 2, "username"), (k % 6 == 2, "asn"), (k % 6 == 3, "wallet"), (k % 6 == 4, "finding"), otherwise="domain")
    platform = X.choose((k % 6 == 0, "github"), (k % 6 == 1, ""), (k % 6 == 3, "btc"), (k % 6 == 4, "Email"), otherwise=None)
    label = X.entity_label(kind, X.choose((k % 6 < 2, name), (k % 6 == 2, k.cast("string")), otherwise=v), platform)
    return _addresses(t).select(
        "company_id", X.defang(v).alias("defanged"), X.refang(X.defang(v)).alias("refanged"), X.tidy_address(F.replace(v, F.lit("."), F.lit("[.]"))).alias("tidy"),
        X.ip_version(v).alias("version"), X.gravatar(v).alias("gravatar"), label.alias("label"), X.valid_domain(v).alias("valid_domain"),
        F.split_part(v, F.lit("@"), F.lit(2)).alias("provider"), X.slug(v).alias("slug"), X.ellipsis(v, 12).alias("short"),
    )


#: Names whose endings are all those of the tables, one of none, and one in capitals.
_ENDINGS = tuple(X.MIME_OF) + ("webp", "bmp", "ods", "ogg", "flac", "aac", "avi", "mkv", "mov", "webm", "rtf", "md", "html", "htm", "zip", "PDF", "svg", "tsv", "3gp", "odt", "yml")


def _in(endings) -> str:
    return "(" + ", ".join(f"'{e}'" for e in endings) + ")"


@query(f"""
WITH f AS (SELECT file_name || '.' || [{", ".join(f"'{e}'" for e in _ENDINGS)}][1 + (request_id + line) % {len(_ENDINGS)}] AS file_name FROM files),
e AS (SELECT file_name, lower(regexp_extract(file_name, '\\.([A-Za-z0-9]+)$', 1)) AS e FROM f)
SELECT file_name, e AS extension,
  CASE WHEN e = 'pdf' THEN 'pdf' WHEN e IN ('jpg', 'jpeg', 'png', 'gif', 'webp', 'bmp') THEN 'image' WHEN e IN ('xlsx', 'xls', 'csv', 'ods') THEN 'spreadsheet'
    WHEN e IN ('mp3', 'wav', 'ogg', 'm4a', 'flac', 'aac') THEN 'audio' WHEN e IN ('mp4', 'avi', 'mkv', 'mov', 'webm') THEN 'video'
    WHEN e IN ('doc', 'docx', 'txt', 'rtf', 'md') THEN 'document' WHEN e IN ('json', 'xml', 'html', 'htm') THEN 'data' ELSE 'other' END AS kind,
  CASE WHEN e = 'svg' THEN 'image' WHEN e = 'tsv' THEN 'spreadsheet' WHEN e = '3gp' THEN 'video' WHEN e = 'odt' THEN 'document' WHEN e = 'yml' THEN 'data'
    WHEN e = 'zip' THEN 'other' ELSE 'as above' END AS member_kind,
  CASE e WHEN 'pdf' THEN 'application/pdf' WHEN 'jpg' THEN 'image/jpeg' WHEN 'jpeg' THEN 'image/jpeg' WHEN 'png' THEN 'image/png' WHEN 'gif' THEN 'image/gif'
    WHEN 'csv' THEN 'text/csv' WHEN 'xlsx' THEN 'application/vnd.openxmlformats-officedocument.spreadsheetml.sheet' WHEN 'xls' THEN 'application/vnd.ms-excel'
    WHEN 'txt' THEN 'text/plain' WHEN 'json' THEN 'application/json' WHEN 'xml' THEN 'application/xml' WHEN 'mp3' THEN 'audio/mpeg' WHEN 'wav' THEN 'audio/wav'
    WHEN 'm4a' THEN 'audio/mp4' WHEN 'mp4' THEN 'video/mp4' WHEN 'doc' THEN 'application/msword'
    WHEN 'docx' THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' ELSE 'application/octet-stream' END AS mime
FROM e""")
def f24_file_kinds(t):
    """category and type by the ending, and the category of an archive's member."""
    endings = F.element_at(F.array(*map(F.lit, _ENDINGS)), ((F.col("request_id") + F.col("line")) % len(_ENDINGS) + 1).cast("int"))
    f = F.col("file_name")
    wide = F.when(X.member_category(f) == X.file_category(f), F.when(X.extension(f) == "zip", "other").otherwise("as above")).otherwise(X.member_category(f))
    names = files(t).select(F.concat_ws(".", "file_name", endings).alias("file_name"))
    return names.select("file_name", X.extension(f).alias("extension"), X.file_category(f).alias("kind"), wide.alias("member_kind"), X.mime_type(f).alias("mime"))


@query("""
WITH p AS (
  SELECT p_partkey, p_name, p_brand, p_size, ['email', 'username', 'social_profile', 'breach_record', 'domain', 'ip', 'phone', 'website', 'credential', 'document',
    'Wallet'][1 + p_partkey % 11] AS kind,
    ['Data Point', '9 lives!', '', 'RELATES TO', 'a-b'][1 + p_partkey % 5] AS raw, ['crawl', 'breach db', 'leaked', ''][1 + p_partkey % 4] AS source FROM part
)
SELECT p_partkey, CASE raw WHEN 'Data Point' THEN 'DataPoint' WHEN '9 lives!' THEN 'Entity9lives' WHEN '' THEN 'Entity' WHEN 'RELATES TO' THEN 'RELATESTO' ELSE 'ab' END AS label,
  CASE WHEN kind = 'email' THEN 'Email' WHEN kind = 'username' THEN 'Username' WHEN kind = 'social_profile' THEN 'SocialProfile' WHEN kind = 'breach_record' THEN 'BreachRecord'
    WHEN kind = 'domain' THEN 'Domain' WHEN kind = 'ip' THEN 'IP' WHEN kind = 'phone' THEN 'Phone' WHEN kind = 'website' THEN 'Website' WHEN kind = 'credential' THEN 'Credential'
    WHEN kind = 'document' THEN 'PublicDocument' ELSE 'Wallet' END AS mapped,
  CASE raw WHEN 'Data Point' THEN 'DATA_POINT' WHEN 'RELATES TO' THEN 'RELATES_TO' WHEN 'a-b' THEN 'A_B' ELSE 'RELATES_TO' END AS relation,
  regexp_replace(upper(p_brand), '[^A-Z_]', '_', 'g') AS letters,
  CASE p_size % 3 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' ELSE 'low' END AS risk,
  CASE p_size % 4 WHEN 0 THEN 'Email' WHEN 1 THEN 'Company' WHEN 2 THEN 'Thing' ELSE 'Unknown' END AS shown_type,
  CASE p_size % 4 WHEN 0 THEN p_name WHEN 1 THEN 'at ' || p_size WHEN 2 THEN 'user' ELSE 'Company' END AS shown_label,
  CASE WHEN kind IN ('breach_record', 'credential') THEN 'critical' WHEN kind IN ('social_profile', 'phone') THEN 'medium'
    WHEN source IN ('breach db', 'leaked') THEN 'high' ELSE 'low' END AS inferred,
  CASE kind WHEN 'email' THEN 'Email address found: ' || p_name WHEN 'username' THEN 'Username "' || p_name || '" found on social platforms'
    WHEN 'social_profile' THEN 'Social media profile discovered'
    WHEN 'breach_record' THEN 'Found in data breach' WHEN 'domain' THEN 'Domain ' || p_name || ' analyzed' WHEN 'ip' THEN 'IP address ' || p_name || ' associated'
      WHEN 'phone' THEN 'Phone number ' || p_name || ' found'
    WHEN 'website' THEN 'Website ' || p_name || ' crawled' WHEN 'credential' THEN 'Credential exposure detected' WHEN 'document' THEN 'Public document found'
      ELSE 'Wallet: ' || p_name END AS description,
  CASE p_size % 2 WHEN 0 THEN 'Social Profile' ELSE 'Data Point' END AS spaced, CASE p_size % 2 WHEN 0 THEN 'Policy Analyzed' ELSE 'Data Point NAME' END AS title
FROM p""")
def f26_labels(t):
    """Labels, relations, risks, descriptions and what is shown of a node."""
    size, key, name = F.col("p_size"), F.col("p_partkey"), F.col("p_name")
    pick = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))
    kind = pick(("email", "username", "social_profile", "breach_record", "domain", "ip", "phone", "website", "credential", "document", "Wallet"), key)
    raw, source = pick(("Data Point", "9 lives!", "", "RELATES TO", "a-b"), key), pick(("crawl", "breach db", "leaked", ""), key)
    labels = X.choose(
        (size % 4 == 0, F.array(F.lit("Thing"), F.lit("Email"))), (size % 4 == 1, F.array(F.lit("Email"), F.lit("Company"))),
        (size % 4 == 2, F.array(F.lit("Thing"), F.lit("Other"))), otherwise=F.array().cast("array<string>"),
    )
    props = X.choose(
        (size % 4 == 0, F.create_map(F.lit("address"), F.lit("no"), F.lit("name"), name)), (size % 4 == 1, F.create_map(F.lit("name"), F.lit(""), F.lit("address"), F.concat(F.lit("at "), size))),
        (size % 4 == 2, F.create_map(F.lit("number"), F.lit("7"), F.lit("username"), F.lit("user"))), otherwise=F.create_map(F.lit("title"), F.lit("x")),
    )
    return t.part.select(
        "p_partkey", X.clean_label(raw).alias("label"), X.label_of(F.initcap(kind)).alias("mapped"), X.relation_type(raw).alias("relation"), X.relation_letters(F.col("p_brand")).alias("letters"),
        X.risk_level(X.choose((size % 3 == 0, "CRITICAL"), (size % 3 == 1, "High"), otherwise="unheard")).alias("risk"), X.display_type(labels).alias("shown_type"),
        X.display_label(props, F.lit("Company")).alias("shown_label"), X.inferred_risk(kind, source).alias("inferred"), X.description(kind, name).alias("description"),
        X.spaced_words(F.when(size % 2 == 0, "SocialProfile").otherwise("DataPoint")).alias("spaced"), X.title_case(F.when(size % 2 == 0, "policy_analyzed").otherwise("data_point_NAME")).alias("title"),
    )


_SEARCH_WORDS = "('" + "', '".join(X.SEARCH_STOPWORDS) + "')"
_ORACLE_WORDS = "('" + "', '".join(X.ORACLE_STOPWORDS) + "')"


@query(f"""
WITH w AS (SELECT conv_id, turn, regexp_split_to_array(replace(lower(text), '?', ''), '[ \\t\\n\\r\\f\\v]+') AS w FROM conversations)
SELECT conv_id, turn, array_to_string([x FOR x IN w IF len(x) > 2 AND x NOT IN {_SEARCH_WORDS}], ' ') AS keywords,
  array_to_string([x FOR x IN w IF len(x) > 2 AND x NOT IN {_ORACLE_WORDS}], ' ') AS oracle_keywords FROM w""")
def f36_keywords(t):
    """with the stop words of the hybrid search, and with those of the oracle."""
    text = F.col("text")
    return t.conversations.select("conv_id", "turn", F.array_join(X.keywords(text), " ").alias("keywords"), F.array_join(X.keywords(text, X.ORACLE_STOPWORDS), " ").alias("oracle_keywords"))


@query("""
WITH RECURSIVE o AS (
  SELECT doc_id, text, 0 AS k, 1 AS start, instr(lower(text), 'the') AS pos FROM documents WHERE text IS NOT NULL
  UNION ALL
  SELECT doc_id, text, k + 1, pos + 3, CASE WHEN instr(substr(lower(text), pos + 3), 'the') = 0 THEN 0 ELSE pos + 2 + instr(substr(lower(text), pos + 3), 'the') END
    FROM o WHERE pos > 0 AND k < 5
),
x AS (
  SELECT doc_id, k, substr(text, pos, 3) AS said, trim(substr(text, greatest(pos - 1 - 150, 0) + 1, pos + 152 - greatest(pos - 1 - 150, 0)),
    chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS part
  FROM o WHERE pos > 0 AND k < 5
)
SELECT doc_id, count(*) AS n, string_agg(regexp_replace(part, '(?i)the', '**' || said || '**', 'g'), '|' ORDER BY k) AS excerpts FROM x GROUP BY doc_id""")
def f38_excerpts(t):
    """up to five excerpts around a term, with the term in bold."""
    found = X.excerpts(F.col("text"), "the")
    return t.documents.select("doc_id", found.alias("x")).filter("size(x) > 0").select("doc_id", F.size("x").cast("long").alias("n"), F.array_join("x", "|").alias("excerpts"))


@query("""
WITH q AS (
  SELECT p_partkey, ['Consent', 'how do children give consent', 'transfer data', 'the right to have it erased', 'zebra', 'breach notification rules'][1 + p_partkey % 6] AS q,
    CASE WHEN p_partkey % 2 = 0 THEN 'see Article 5 and article 12.' ELSE 'nothing' END AS found FROM part
)
SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'Article 6(1)(a), Article 7, Recital 32' WHEN 1 THEN 'Article 6(1)(a), Article 7, Recital 32' WHEN 2 THEN 'Article 20 GDPR'
    WHEN 3 THEN 'Article 17 GDPR' WHEN 5 THEN 'Article 33, Article 34' END AS reference,
  CASE p_partkey % 6 WHEN 0 THEN '5,6,7,12' WHEN 1 THEN '6,7,8' WHEN 2 THEN '5,12,20' WHEN 3 THEN '15,17' WHEN 4 THEN '5,12' ELSE '15,17' END AS articles
FROM q""")
def f40_topics(t):
    """the reference text that a question is about, and the articles that it and found texts name."""
    key = F.col("p_partkey")
    questions = ("Consent", "how do children give consent", "transfer data", "the right to have it erased", "zebra", "breach notification rules")
    q = F.element_at(F.array(*map(F.lit, questions)), (key % 6 + 1).cast("int"))
    found = F.array(F.when(key % 2 == 0, "see Article 5 and article 12.").otherwise("nothing"))
    return t.part.select("p_partkey", X.topic_articles(q).alias("reference"), F.array_join(X.articles(q, found), ",").alias("articles"))


@query("""SELECT doc_id, substr(text, greatest(instr(lower(text), 'that') - 1 - 250, 0) + 1, 500) AS excerpt,
round((CAST(contains(lower(text), 'that') AS INT) + CAST(contains(lower(text), 'with') AS INT) + CAST(contains(lower(text), 'privacy') AS INT)) / 3.0,
  6)::DOUBLE AS ratio FROM documents""")
def f37_excerpts(t):
    """F37, F39."""
    text = F.col("text")
    return t.documents.select("doc_id", X.excerpt(text, "that").alias("excerpt"), F.round(X.match_ratio(text, F.array(*map(F.lit, ("that", "with", "privacy")))), 6).alias("ratio"))


@query("""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ',
  'g'), '(?s)<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS plain,
array_to_string([h FOR h IN [trim(regexp_replace(regexp_replace(x, '(?s)<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) FOR x IN regexp_extract_all(html,
  '(?is)<h[1-6][^>]*>(.*?)</h[1-6]>', 1)] IF h <> ''][1:50], '|') AS headings,
regexp_matches(html, '(?i)</?[a-z][\\s\\S]*>') AND regexp_matches(html, '(?i)</(html|body|div|table|p|section|article|script)>') AS looks_html FROM pages""")
def f42_html(t):
    """text, headings and a test for HTML."""
    h = F.col("html")
    return t.pages.select("page_id", X.strip_html(h).alias("plain"), F.array_join(X.headings(h), "|").alias("headings"), X.is_html(h).alias("looks_html"))


@query("""SELECT page_id, array_to_string(regexp_extract_all(html, '(?i)<(?:a|link)\\s[^>]*?href=["'']([^"''>]*)["'']', 1), ' ') AS links,
  CAST(len(regexp_extract_all(html, '(?i)<script[^>]*?src=["'']?([^\\s>"'']+)', 1)) AS INT) AS n_scripts FROM pages""")
def f46_links(t):
    h = F.col("html")
    return t.pages.select("page_id", F.array_join(X.hrefs(h), " ").alias("links"), F.size(X.script_sources(h)).alias("n_scripts"))


@query(f"""WITH s AS (SELECT id, CAST(epoch(TIMESTAMP '{EVENT_NOW}' - ts) AS DOUBLE) AS s FROM messages WHERE ts < TIMESTAMP '{EVENT_NOW}')
SELECT id, CASE WHEN floor(s / 60) < 60 THEN CAST(CAST(floor(s / 60) AS BIGINT) AS VARCHAR) || ' minutes ago'
  WHEN floor(s / 3600) < 24 THEN CAST(CAST(floor(s / 3600) AS BIGINT) AS VARCHAR) || ' hours ago'
WHEN floor(s / 86400) = 1 THEN 'Yesterday' ELSE CAST(CAST(floor(s / 86400) AS BIGINT) AS VARCHAR) || ' days ago' END AS ago FROM s""")
def f48_relative_time(t):
    now = F.lit(EVENT_NOW).cast("timestamp_ntz")
    seconds = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1_000_000
    return messages(t).filter(F.col("ts") < now).select("id", X.relative_time(seconds).alias("ago"))


@query("""SELECT company_id, 'mail.' || domain || ',10.0.0.1' AS spf, 'dmarc@' || domain || ',b@' || domain AS dmarc, lower(regexp_replace(company_name || ' Ltd',
  '\\s+', '', 'g')) || '.com' AS default_domain FROM companies""")
def f22_mail_policies(t):
    """F11, F22, F23."""
    spf = F.concat(F.lit("v=spf1 include:mail."), "domain", F.lit(" a:10.0.0.1 ~all"))
    dmarc = F.concat(F.lit("v=DMARC1; p=none; rua=mailto:dmarc@"), "domain", F.lit(",mailto:b@"), "domain", F.lit("; pct=100"))
    return companies(t).select("company_id", F.array_join(X.spf_targets(spf), ",").alias("spf"), F.array_join(X.dmarc_emails(dmarc), ",").alias("dmarc"), X.default_domain(F.concat("company_name", F.lit(" Ltd"))).alias("default_domain"))


@query("SELECT id, CASE status WHEN 'processing' THEN 40 WHEN 'completed' THEN 100 WHEN 'action_required' THEN 60 ELSE 0 END AS progress, strftime(CAST(created_at AS DATE) + 30, '%Y-%m-%d') AS deadline, d AS days_passed, CAST(least(100, floor(d * 100 / 30)) AS BIGINT) AS share, CAST(greatest(0, 30 - d) AS BIGINT) AS days_left "
       f"FROM (SELECT *, CAST(floor(epoch(TIMESTAMP '{REQUEST_NOW}' - created_at) / 86400) AS BIGINT) AS d FROM requests)")
def d02_deadlines(t):
    """D01-D03, D13, D27."""
    now = F.lit(REQUEST_NOW).cast("timestamp_ntz")
    days = V.days_between(F.col("created_at"), now)
    share, left = V.progress_of(days)
    progress = V.progress(F.col("status"))
    return requests(t).select("id", progress.alias("progress"), F.date_format(V.deadline(F.col("created_at")), "yyyy-MM-dd").alias("deadline"), days.alias("days_passed"), share.alias("share"), left.alias("days_left"))


@query("""WITH m AS (SELECT id, 'seen 2024-01-' || lpad(CAST(id % 28 + 1 AS VARCHAR), 2,
  '0') || 'T10:00Z and 3/' || (id % 9 + 1) || '/2024, at 51.' || (1000 + id % 9000) || ', -0.' || (1000 + id % 7000) || ' ; 95.123, 10.123' AS x FROM messages)
SELECT id, '2024-01-' || lpad(CAST(id % 28 + 1 AS VARCHAR), 2, '0') || 'T10:00Z|3/' || (id % 9 + 1) || '/2024' AS dates, 1 AS n_points, printf('%.5f',
  CAST('51.' || (1000 + id % 9000) AS DOUBLE)) || ',' || printf('%.5f', CAST('-0.' || (1000 + id % 7000) AS DOUBLE)) AS points FROM m""")
def d04_dates_coordinates(t):
    """Dates and coordinates in text; coordinates out of range are left out."""
    k = F.col("id")
    text = F.concat(F.lit("seen 2024-01-"), F.lpad((k % 28 + 1).cast("string"), 2, "0"), F.lit("T10:00Z and 3/"), k % 9 + 1, F.lit("/2024, at 51."), 1000 + k % 9000, F.lit(", -0."), 1000 + k % 7000, F.lit(" ; 95.123, 10.123"))
    points = V.coordinates(text)
    shown = F.transform(points, lambda p: F.concat(F.format_string("%.5f", p["lat"]), F.lit(","), F.format_string("%.5f", p["lon"])))
    return messages(t).select("id", F.array_join(V.dates(text), "|").alias("dates"), F.size(points).alias("n_points"), F.array_join(shown, " ").alias("points"))


@query("""SELECT doc_id, CAST(len(text) // 4 AS BIGINT) AS tokens, CAST(n AS BIGINT) AS words, CAST(CASE WHEN n <= 100 THEN 1
  ELSE greatest(1, floor((n - 20) / 80) + 1) END AS BIGINT) AS chunks, least(1.0, 0.3 + 0.2 * (n % 5))::DOUBLE AS score
FROM (SELECT doc_id, text, len(regexp_extract_all(text, '\\S+')) AS n FROM documents)""")
def d11_size_estimates(t):
    """D10-D12, T06."""
    n = F.size(chunking.words(F.col("text")))
    return t.documents.select("doc_id", V.token_estimate(F.col("text")).alias("tokens"), n.cast("long").alias("words"), V.chunk_estimate(n, 100, 20).alias("chunks"), V.document_score(n % 5).alias("score"))


@query("""SELECT id, 'b' AS kept, CAST(json_extract(content, '$.k') AS VARCHAR) AS k, CAST(json_extract(content, '$.k') AS BIGINT) AS n, true AS bad_is_null FROM messages""")
def d16_json_and_maps(t):
    """Map merge (right wins), JSON fields, and null where JSON does not parse."""
    merged = V.merged_map(F.create_map(F.lit("x"), F.lit("a"), F.lit("y"), F.lit("c")), F.create_map(F.lit("x"), F.lit("b")))
    doc = V.json_or_null(F.col("content"))
    return messages(t).select("id", F.try_element_at(merged, F.lit("x")).alias("kept"), F.try_variant_get(doc, "$.k", "string").alias("k"), F.try_variant_get(doc, "$.k", "long").alias("n"), V.json_or_null(F.lit("{broken")).isNull().alias("bad_is_null"))


@query("""SELECT n_regionkey, CAST(row_number() OVER (PARTITION BY n_regionkey
  ORDER BY n_nationkey) AS INT) - 1 AS row, CAST(n_nationkey AS VARCHAR) AS id, n_name AS name FROM nation""")
def d22_delimited_text(t):
    """Delimited text as rows; the delimiter is found in the header."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: F.concat(x["n_nationkey"].cast("string"), F.lit(' ; "'), x["n_name"], F.lit('"'))), "\n")
    text = t.nation.groupBy("n_regionkey").agg(F.concat(F.lit("id;name\n"), lines).alias("text"))
    return text.select("n_regionkey", F.posexplode(V.delimited_rows(F.col("text"))).alias("row", "m")).select("n_regionkey", "row", F.col("m.id").alias("id"), F.col("m.name").alias("name"))


# ---------------------------------------------------------------- chunks


@query("""WITH w AS (SELECT doc_id, text, regexp_extract_all(text, '\\S+') AS w
  FROM documents), n AS (SELECT *, len(w) AS n, greatest(1, CAST(ceil(len(w) / 80) AS INT) - 1) AS last FROM w WHERE len(w) > 0),
k AS (SELECT *, unnest(CASE WHEN n <= 100 THEN [0] ELSE CAST(range(0, last + 1) AS INT[]) END) AS k FROM n),
s AS (SELECT *, CASE WHEN k < last THEN k * 80 ELSE least(last * 80, n - 20) END AS a, CASE WHEN k < last THEN least(k * 80 + 100, n) ELSE n END AS b FROM k)
SELECT doc_id, k AS chunk_index, CASE WHEN n <= 100 THEN text ELSE array_to_string(w[a + 1:b], ' ') END AS text, CAST(CASE WHEN n <= 100 THEN n
  ELSE b - a END AS INT) AS word_count FROM s""")
def t01_word_chunks(t):
    """Word chunks of 100 with 20 words in common."""
    return chunking.word_chunks(t.documents, 100, 20)


@query("""WITH w AS (SELECT doc_id, text, regexp_extract_all(text, '\\s*\\S+') AS w FROM documents), n AS (SELECT *, len(w) AS n FROM w WHERE len(w) > 0),
k AS (SELECT *, unnest(CASE WHEN n <= 100 THEN [0] ELSE CAST(range(0, CAST(ceil((n - 100) / 80) AS INT) + 1) AS INT[]) END) AS k FROM n),
s AS (SELECT *, CASE WHEN n <= 100 THEN 0 ELSE len(array_to_string(w[1:k * 80], '')) + len(regexp_extract(w[k * 80 + 1], '^\\s*')) END AS a, CASE
  WHEN n <= 100 THEN len(text) ELSE len(array_to_string(w[1:least(k * 80 + 100, n)], '')) END AS b FROM k)
SELECT doc_id, k AS chunk_index, CAST(a AS INT) AS start_offset, CAST(b AS INT) AS end_offset, CASE WHEN n <= 100 THEN regexp_replace(text, '^\\s+|\\s+$', '', 'g')
  ELSE substr(text, a + 1, b - a) END AS text,
CAST(CASE WHEN n <= 100 THEN n ELSE least(k * 80 + 100, n) - k * 80 END AS INT) AS word_count FROM s""")
def t02_offset_chunks(t):
    return chunking.offset_chunks(t.documents, 100, 20)


@query("SELECT doc_id, CAST(len(s) AS INT) AS n, sha256(array_to_string(s, '|')) AS digest FROM (SELECT doc_id, [x FOR x IN [trim(y, ' ') FOR y IN string_split(regexp_replace(text, '([.!?])\\s+([A-Z])', '\\1\x01\\2', 'g'), '\x01')] IF x <> ''] AS s FROM documents)")
def t03_sentences(t):
    """Sentences end at . ! or ? before white space and A-Z."""
    s = chunking.sentences(F.col("text"))
    return t.documents.select("doc_id", F.size(s).alias("n"), F.sha2(F.array_join(s, "|"), 256).alias("digest"))


#: A sentence ends at . ! or ? before white space and A-Z. From chunk to chunk: c has the words before each sentence, i and j are a chunk's ends.
SENTENCE_CHUNKS_SQL = """
WITH RECURSIVE q AS (SELECT doc_id, text, string_split(regexp_replace(text, '([.!?])(\\s+)([A-Z])', '\\1\x01\\2\x02\\3', 'g'), '\x01') AS p FROM documents WHERE text <> ''),
u AS (SELECT doc_id, text, unnest(p) AS x, generate_subscripts(p, 1) AS i, len(p) AS m FROM q),
w AS (SELECT *, substr(x, instr(x, '\x02') + 1) AS s, CAST(sum(len(x) - CAST(instr(x, '\x02') > 0 AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS stop FROM u),
v AS (SELECT *, len(regexp_extract_all(s, '\\S+')) AS n, CAST(sum(len(regexp_extract_all(s, '\\S+'))) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS total FROM w WHERE m > 2),
d AS (SELECT doc_id, any_value(text) AS text, any_value(m) AS m, list(stop - len(s) ORDER BY i) AS a, list(stop ORDER BY i) AS e, list(n ORDER BY i) AS n,
  list_prepend(0, list(total ORDER BY i)) AS c FROM v GROUP BY doc_id),
r AS (
  SELECT doc_id, 0::BIGINT AS k, 0::BIGINT AS i, len([t FOR t IN range(0, m) IF c[t + 1] < 120 AND (t = 0 OR c[t + 2] <= 200)])::BIGINT AS j FROM d
  UNION ALL
  SELECT doc_id, k + 1, i, i + len([t FOR t IN range(i, m) IF c[t + 1] - c[i + 1] < 120 AND (t = i OR c[t + 2] - c[i + 1] <= 200)]) FROM (
    SELECT doc_id, k, m, c, greatest(i + 1, [t FOR t IN range(0, j + 1) IF c[j + 1] - c[t + 1] <= 20][1],
      [t FOR t IN range(0, j + 1) IF t = j OR c[j + 1] - c[t + 1] + n[j + 1] <= 200][1]) AS i FROM r JOIN d USING (doc_id) WHERE j < m)
), few AS (SELECT doc_id, text, regexp_extract_all(text, '\\s*\\S+') AS w FROM q WHERE len(p) <= 2), f AS (SELECT *, len(w) AS n FROM few WHERE len(w) > 0),
g AS (SELECT *, unnest(CASE WHEN n <= 120 THEN [0] ELSE CAST(range(0, CAST(ceil((n - 120) / 100) AS INT) + 1) AS INT[]) END) AS k FROM f),
h AS (SELECT doc_id, text, k, CASE WHEN n <= 120 THEN 0 ELSE len(array_to_string(w[1:k * 100], '')) + len(regexp_extract(w[k * 100 + 1], '^\\s*')) END AS a, CASE
  WHEN n <= 120 THEN len(text) ELSE len(array_to_string(w[1:least(k * 100 + 120, n)], '')) END AS b FROM g),
every AS (SELECT doc_id, text, k, a[i + 1] AS a, e[j] AS b FROM r JOIN d USING (doc_id) UNION ALL SELECT doc_id, text, k, a, b FROM h)
SELECT doc_id, CAST(k AS INT) AS chunk_index, CAST(a AS INT) AS start_offset, CAST(b AS INT) AS end_offset, substr(text, a + 1, b - a) AS text,
  CAST(len(regexp_extract_all(substr(text, a + 1, b - a), '\\S+')) AS INT) AS word_count FROM every"""


@query(SENTENCE_CHUNKS_SQL)
def t04_sentence_chunks(t):
    """Sentences packed into chunks of about 120 words."""
    return chunking.sentence_chunks(t.documents, 120, 20, 200)


@query()
def t05_token_chunks(t):
    return chunking.token_chunks(t.documents, 200, 20)


#: p has the characters up to the end of each line with its break; a chunk begins with line i.
LINE_CHUNKS_SQL = """
WITH RECURSIVE u AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text <> ''),
v AS (SELECT doc_id, text, i, CAST(sum(len(x) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS total FROM u),
d AS (SELECT doc_id, any_value(text) AS text, list_prepend(0, list(total ORDER BY i)) AS p, count(*) AS m FROM v GROUP BY doc_id),
r AS (
  SELECT doc_id, 0::BIGINT AS k, 0::BIGINT AS i, greatest(1, len([t FOR t IN range(0, m) IF p[t + 2] <= 600]))::BIGINT AS j FROM d
  UNION ALL
  SELECT doc_id, k + 1, j, greatest(j + 1, j + len([t FOR t IN range(j, m) IF p[t + 2] - p[j + 1] <= 600])) FROM r JOIN d USING (doc_id) WHERE j < m
), s AS (SELECT doc_id, k, p[i + 1] AS a, p[j + 1] - 1 AS b, text FROM r JOIN d USING (doc_id))
SELECT doc_id, CAST(k AS INT) AS chunk_index, CAST(a AS INT) AS start_offset, CAST(b AS INT) AS end_offset, substr(text, a + 1, b - a) AS text,
  CAST(len(regexp_extract_all(substr(text, a + 1, b - a), '\\S+')) AS INT) AS word_count FROM s"""


@query(LINE_CHUNKS_SQL)
def t08_line_chunks(t):
    """Lines packed into chunks of 600 characters."""
    return chunking.line_chunks(t.documents, 600)


@query("""WITH c AS (SELECT conv_id, turn, text FROM conversations) SELECT conv_id, turn, array_to_string(list(text) OVER (PARTITION BY conv_id
  ORDER BY turn ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), ' ') AS context FROM c""")
def t07_context(t):
    """A chunk with its neighbours."""
    chunks = t.conversations.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk_index"), "text")
    return chunking.with_context(chunks, 1).select(F.col("doc_id").alias("conv_id"), F.col("chunk_index").alias("turn"), "context")


def _regulations(t):
    """Documents with headers put in: every third line starts an article, numbered anew after four."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 3 == 2, F.concat(F.lit("Article "), (i / 3).cast("int") % 4, F.lit(" "), x)).otherwise(x))
    return t.documents.select("doc_id", F.array_join(lines, "\n").alias("text"))


_REGULATIONS_SQL = """l AS (SELECT doc_id, i - 1 AS line, CASE WHEN (i - 1) % 3 = 2 THEN 'Article ' || ((i - 1) // 3 % 4) || ' ' || x ELSE x END AS text
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
h AS (SELECT *, lower(nullif(regexp_extract(text, '(?i)^\\s*((?:Article|Section|Chapter)\\s+\\d+)', 1), '')) AS head FROM l),
s AS (SELECT *, coalesce(last_value(head IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING), 'preamble') AS section,
  count(head) OVER (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS number FROM h)"""


@query(f"""WITH {_REGULATIONS_SQL}, g AS (SELECT doc_id, section, number, count(*) AS n_lines, string_agg(text, chr(10) ORDER BY line) AS text FROM s GROUP BY ALL)
SELECT doc_id, section, n_lines, text FROM g QUALIFY row_number() OVER (PARTITION BY doc_id, section ORDER BY number DESC) = 1""")
def t09_sections(t):
    """Text by section; a header that comes again replaces the section."""
    return chunking.sections(_regulations(t))


@query(f"""WITH {_REGULATIONS_SQL}, c AS (SELECT *, array_to_string(list(text) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN 5 PRECEDING
  AND 5 FOLLOWING), chr(10)) AS context,
(CAST(contains(lower(text), 'that') AS INT) + CAST(contains(lower(text), 'with') AS INT)) / 2.0 AS score FROM s),
f AS (SELECT *, greatest(line - 5, 0) // 10 AS a, (line + 5) // 10 AS b FROM c WHERE score >= 0.5), d AS (SELECT * FROM f
  QUALIFY row_number() OVER (PARTITION BY doc_id, a, b ORDER BY score DESC, line) = 1)
SELECT doc_id, CAST(line AS INT) AS line, section, score::DOUBLE AS score, context, CAST(row_number() OVER (PARTITION BY doc_id
  ORDER BY score DESC, line) AS INT) AS rank FROM d QUALIFY rank <= 10""")
def t10_line_search(t):
    """T10, W06."""
    return chunking.line_search(_regulations(t), ["that", "with"])
