"""Queries that infer triples, group entities, weigh nodes and keep records of what is decided."""

from __future__ import annotations

from pyspark.sql import functions as F

from subjectlens.functions import replies as P
from subjectlens.functions import text as X
from subjectlens.operators import betweenness as B
from subjectlens.operators import communities as L
from subjectlens.operators import graph as G
from subjectlens.operators import merge as M
from subjectlens.operators import relational as R
from subjectlens.operators import validation as V
from subjectlens.plans.cases import companies, edges, files, messages, requests
from subjectlens.plans.registry import query
from subjectlens.streaming import incremental

# ---------------------------------------------------------------- inference


@query("""
WITH m AS (SELECT c_name AS node, 'c' || c_nationkey AS community FROM customer), big AS (SELECT community FROM m GROUP BY 1 HAVING count(*) >= 3)
SELECT community, string_agg(node, ',' ORDER BY node) AS entities FROM (SELECT * FROM m SEMI JOIN big USING (community)
  QUALIFY row_number() OVER (PARTITION BY community ORDER BY node) <= 10) GROUP BY 1""")
def g07_asked_members(t):
    """The members of larger communities that a model is asked about, ten at most."""
    members = t.customer.select(F.col("c_name").alias("node"), F.concat(F.lit("c"), "c_nationkey").alias("community"))
    return G.asked_members(members).select("community", F.array_join("entities", ",").alias("entities"))


def _within(t):
    """Replies of a model for each nation: to its region (known), to a new node, without an object, and four more."""
    members = t.customer.select(F.col("c_name").alias("node"), F.concat(F.lit("c"), "c_nationkey").alias("community"))
    grid = t.nation.select(F.concat(F.lit("c"), "n_nationkey").alias("community"), "n_name", F.concat(F.lit("REGION_"), "n_regionkey").alias("near"), F.explode(F.array(*map(F.lit, range(7)))).alias("place"))
    place = F.col("place")
    object_ = F.when(place == 0, F.col("near")).when(place != 2, F.concat(F.lit("node "), place))
    replies = grid.select("community", "place", F.lower("n_name").alias("s"), F.lit("might share the data of").alias("p"), object_.alias("o"), F.when(place == 1, 0.7).alias("confidence"))
    return members, replies


_WITHIN_SQL = """big AS (SELECT c_nationkey FROM customer GROUP BY 1 HAVING count(*) >= 3),
within_ AS (
  SELECT lower(n_name) AS s, 'MIGHT_SHARE' AS p, CASE k WHEN 0 THEN 'REGION_' || n_regionkey ELSE 'node ' || k END AS o, CASE k WHEN 1 THEN 0.7 ELSE 0.5 END::DOUBLE AS confidence
  FROM nation JOIN big ON c_nationkey = n_nationkey, (SELECT unnest([0, 1, 3, 4]) AS k)
  WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE lower(e.s) = lower(n_name) AND lower(e.o) = lower(CASE k WHEN 0 THEN 'REGION_' || n_regionkey ELSE 'node ' || k END))
)"""


@query(f"WITH {_WITHIN_SQL} SELECT s, p, o, confidence, true AS inferred FROM within_")
def g07_within_communities(t):
    """A model's triples within communities; those that link what is linked go, as do incomplete ones and those after the fifth."""
    members, replies = _within(t)
    return G.within_communities(members, replies, edges(t))


def _sharing(t):
    """A chain with one predicate, its case and spaces changed, next to the edges: companies share with the next one."""
    k = F.col("n_nationkey")
    own = t.nation.select(F.concat(F.lit("Firm "), k).alias("s"), F.lit("SHARES_WITH").alias("p"), F.concat(F.lit("Firm "), k + 1).alias("o"), F.lit(1.0).alias("confidence"), (k + 2_000_000_000).cast("long").alias("seq"))
    return edges(t).unionByName(own).unionByName(own.select("s", F.lower("p").alias("p"), F.upper("o").alias("o"), F.lit(0.4).alias("confidence"), (F.col("seq") + 1000).alias("seq")))


_SHARING_SQL = """own AS (SELECT 'Firm ' || n_nationkey AS s, 'SHARES_WITH' AS p, 'Firm ' || (n_nationkey + 1) AS o, 1.0::DOUBLE AS confidence, n_nationkey + 2000000000 AS seq FROM nation),
shared AS (SELECT s, p, o, confidence, seq FROM edges UNION ALL SELECT * FROM own UNION ALL SELECT s, lower(p), upper(o), 0.4::DOUBLE, seq + 1000 FROM own),
pairs AS (SELECT lower(s) AS s, lower(o) AS o, arg_max(p, seq) AS p FROM shared GROUP BY 1, 2),
via AS (
  SELECT a.s, CASE WHEN a.p = b.p THEN 'INDIRECTLY_' || upper(a.p) ELSE 'VIA_' || replace(upper(left(a.o, 10)), ' ', '_') END AS raw, b.o, a.o AS via FROM pairs a
    JOIN pairs b ON a.o = b.s
  WHERE a.s <> b.o AND NOT EXISTS (SELECT 1 FROM pairs c WHERE c.s = a.s AND c.o = b.o)
), inferred AS (SELECT s, raw AS p, o, via FROM via)"""


@query(f"WITH {_SHARING_SQL} SELECT s, p, o, 0.6::DOUBLE AS confidence, via FROM inferred")
def g05_transitive(t):
    """What follows over one node between: with one predicate indirectly, else by way of that node."""
    return G.transitive(_sharing(t))


@query(f"""
WITH {_SHARING_SQL}, {_WITHIN_SQL},
names AS (SELECT DISTINCT lower(x) AS name FROM (SELECT s AS x FROM shared UNION ALL SELECT o
  FROM shared)), w AS (SELECT name, list_distinct(string_split(name, ' ')) AS w FROM names WHERE name LIKE 'firm %'),
alike AS (SELECT a.name AS s, b.name AS o FROM w a JOIN w b ON a.name < b.name WHERE len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) >= 0.3),
every AS (
  SELECT s, p, o, confidence, false AS inferred, 0 AS rank, seq FROM shared UNION ALL SELECT s, 'MIGHT_SHARE', o, confidence, true, 1, 0 FROM within_ UNION ALL
    SELECT s, p, o, 0.6, true, 2, 0 FROM inferred
  UNION ALL SELECT s, 'SIMILAR_TO', o, 1 / 3, true, 3, 0 FROM alike WHERE NOT EXISTS (SELECT 1 FROM pairs c WHERE (c.s = alike.s AND c.o = alike.o) OR (c.s = alike.o
    AND c.o = alike.s))
)
SELECT s, upper(p) AS p, o, round(confidence, 6)::DOUBLE AS confidence, inferred FROM every WHERE lower(s) <> lower(o)
  QUALIFY row_number() OVER (PARTITION BY lower(s), upper(p), lower(o) ORDER BY confidence DESC, rank, seq) = 1""")
def g09_full_inference(t):
    """Direct triples and all that is inferred, each once."""
    members, replies = _within(t)
    model = G.within_communities(members, replies, edges(t))
    return G.fully_inferred(_sharing(t), model, 0.3).withColumn("confidence", F.round("confidence", 6))


@query("""
WITH b AS (SELECT lower(s) AS x, lower(o) AS y FROM edges UNION SELECT lower(o), lower(s) FROM edges), e AS (SELECT DISTINCT n_name AS entity FROM nation UNION ALL
  SELECT 'Nobody'),
r AS (SELECT entity, y FROM e LEFT JOIN b ON x = lower(entity) QUALIFY row_number() OVER (PARTITION BY entity ORDER BY y) <= 3),
g AS (SELECT entity, y AS m FROM r WHERE y IS NOT NULL UNION SELECT entity, lower(entity) FROM e),
i AS (SELECT g1.entity, t.s || ' --[' || t.p || ']--> ' || t.o AS line, t.seq FROM edges t JOIN g g1 ON g1.m = lower(t.s) JOIN g g2 ON g2.m = lower(t.o)
  AND g2.entity = g1.entity QUALIFY row_number() OVER (PARTITION BY g1.entity ORDER BY t.seq) <= 5)
SELECT entity, coalesce(string_agg(y, ',' ORDER BY y), '') AS related, CASE WHEN count(y) > 0 THEN 0.8
  ELSE 0.4 END::DOUBLE AS confidence, coalesce((SELECT string_agg(line, '|' ORDER BY seq) FROM i WHERE i.entity = r.entity), '') AS connections FROM r
  GROUP BY entity""")
def g12_entity_groups(t):
    """Entities with up to three neighbours and the triples among them."""
    entities = t.nation.select(F.col("n_name").alias("entity")).union(t.spark.range(1).select(F.lit("Nobody")))
    out = G.entity_groups(edges(t), entities)
    return out.select("entity", F.array_join("related", ",").alias("related"), "confidence", F.array_join("connections", "|").alias("connections"))


@query("""
WITH p AS (SELECT n_nationkey AS pair, n_name, n_regionkey FROM nation), s AS (SELECT pair, unnest([n_name, 'x' || pair, 'y']) AS m, unnest([0, 1, 2]) AS i
  FROM p), g AS (SELECT pair, unnest(['X' || pair, 'z']) AS m FROM p)
SELECT s.pair, s.m AS source, r AS relation, g.m AS target, ['yes', 'maybe', 'no'][1 + s.pair % 3] AS veracity, s.pair % 3 = 0 AS factual, s.pair % 3 = 2 AS counterfactual
FROM s JOIN g USING (pair), (SELECT unnest(['USES', 'SELLS', 'KEEPS']) AS r) WHERE i < 2 AND lower(s.m) <> lower(g.m)""")
def g14_probes(t):
    """Pairs of group members to ask about, and the replies' labels."""
    k = F.col("n_nationkey")
    source = t.nation.select(k.alias("pair"), F.col("n_name").alias("entity"), F.array(F.concat(F.lit("x"), k), F.lit("y")).alias("related"))
    target = t.nation.select(k.alias("pair"), F.concat(F.lit("X"), k).alias("entity"), F.array(F.lit("z"), F.lit("more")).alias("related"))
    verdict = F.element_at(F.array(F.lit("Yes"), F.lit("unsure"), F.lit("NO")), (F.col("pair") % 3 + 1).cast("int"))
    label, factual, counter = G.veracity(verdict)
    return G.probes(source, target, ["USES", "SELLS", "KEEPS", "MORE"]).select("pair", "source", "relation", "target", label.alias("veracity"), factual.alias("factual"), counter.alias("counterfactual"))


#: On a forest a path is the only one between its ends, so all paths can be written out.
@query("""
WITH RECURSIVE b AS (SELECT lower(s) AS u, lower(o) AS v FROM edges WHERE lower(s) <> lower(o) UNION SELECT lower(o), lower(s) FROM edges WHERE lower(s) <> lower(o)),
p AS (SELECT u AS x, [u] AS path FROM (SELECT DISTINCT u FROM b) UNION ALL SELECT b.v, list_append(path, b.v) FROM p JOIN b ON b.u = p.x WHERE NOT list_contains(path, b.v)),
ends AS (SELECT path[1] AS a, path[-1] AS z, path FROM p WHERE len(path) > 2), short AS (SELECT * FROM ends QUALIFY len(path) = min(len(path)) OVER (PARTITION BY a, z)),
part AS (SELECT unnest(path[2:-2]) AS node, 1.0 / count(*) OVER (PARTITION BY a, z) AS w FROM short), n AS (SELECT DISTINCT u AS node FROM b), t AS (SELECT count(*) AS n FROM n)
SELECT n.node, round(coalesce((SELECT sum(w) FROM part WHERE part.node = n.node), 0) / ((t.n - 1) * (t.n - 2)), 8)::DOUBLE AS centrality FROM n, t""")
def g19_betweenness(t):
    """Betweenness of all nodes."""
    return B.betweenness_centrality(edges(t)).withColumn("centrality", F.round("centrality", 8))


@query()
def g21_weighted_nodes(t):
    """Combined centrality, sizes and colors of communities."""
    e = edges(t)
    sizes = G.node_sizes(B.combined_centrality(e).withColumn("centrality", F.round("centrality", 6)), "centrality")
    return sizes.join(G.colored(L.louvain(e)), "node", "left").select("node", "centrality", "size", "community", "color")


# ---------------------------------------------------------------- decisions


_VOTES = ("CORRECT", "incorrect", "UNKNOWN")


@query("""
WITH v AS (SELECT p_partkey AS id, a, p_brand, CASE (p_partkey + a * (1 + p_partkey % 3)) % 3 WHEN 0 THEN 'CORRECT' WHEN 1 THEN 'INCORRECT' ELSE 'UNKNOWN' END AS v
  FROM part, (SELECT unnest([0, 1, 2, 3]) AS a)),
c AS (SELECT id, p_brand, 1 + id % 3 AS round, count(*) FILTER (v = 'CORRECT') AS y, count(*) FILTER (v = 'INCORRECT') AS n FROM v GROUP BY ALL),
d AS (SELECT *, CASE WHEN y >= 3 OR n >= 3 THEN CASE WHEN y > n THEN 'ACCEPT' ELSE 'REJECT' END WHEN y = 2 AND n = 2 THEN 'TIE' ELSE 'CONTINUE' END AS decision FROM c)
SELECT id, CAST(round AS INT) AS round, decision, NOT (y >= 3 OR n >= 3) AND round < 3 AS go_on, CASE decision WHEN 'TIE' THEN 'NEEDS_REVIEW' ELSE decision END AS final,
  CASE WHEN decision IN ('ACCEPT', 'TIE') THEN '(h' || id || ')-[' || regexp_replace(upper(p_brand), '[^A-Z_]', '_', 'g') || ']->(t)' END AS statement FROM d""")
def v04_council(t):
    """One round of four votes: accepted, rejected, tied or to go on, and what is written."""
    k = F.col("p_partkey")
    grid = t.part.select(k.alias("id"), (1 + k % 3).cast("int").alias("round"), F.col("p_brand").alias("relation"), F.explode(F.array(*map(F.lit, range(4)))).alias("a"))
    said = F.element_at(F.array(*map(F.lit, _VOTES)), ((F.col("id") + F.col("a") * (1 + F.col("id") % 3)) % 3 + 1).cast("int"))
    votes = grid.select("id", "round", said.alias("verdict"), F.concat(F.lit("h"), "id").alias("head"), "relation", F.lit("t").alias("tail"))
    return V.council(votes)


_RELATIONS_SQL = """rel AS (
  SELECT o_orderkey AS id, 'f' || (o_custkey % 3) AS file_id, CASE o_orderkey % 5 WHEN 0 THEN '' ELSE 's' || (o_custkey % 7) END AS s, 'USES' AS p, CASE o_orderkey % 7
    WHEN 1 THEN NULL ELSE 'o' END AS o FROM orders
), dec AS (
  SELECT *, CASE WHEN s = '' OR o IS NULL THEN 'NEEDS_REVIEW' WHEN id % 4 = 0 THEN 'ACCEPT' WHEN id % 4 = 1 THEN 'REJECT' ELSE 'NEEDS_REVIEW' END AS decision FROM rel
)"""


def _relations(t):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = t.orders.select(k.alias("id"), k.alias("seq"), F.concat(F.lit("f"), c % 3).alias("file_id"), F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("s"), c % 7)).alias("s"), F.lit("USES").alias("p"), F.when(k % 7 != 1, "o").alias("o"))
    decided = t.orders.filter(k % 4 < 2).select(k.alias("id"), F.when(k % 4 == 0, "ACCEPT").otherwise("REJECT").alias("decision"))
    return V.relation_decisions(rows, decided)


@query(f"WITH {_RELATIONS_SQL} SELECT id, decision, CASE WHEN s = '' OR o IS NULL THEN 'Incomplete relationship' WHEN decision <> 'ACCEPT' THEN 'MAKGED did not accept inferred relationship' END AS reason FROM dec")
def v07_relation_decisions(t):
    """Incomplete relations and those without a decision need review."""
    return _relations(t).select("id", "decision", "reason")


@query(f"""
WITH {_RELATIONS_SQL} SELECT file_id, s AS source_value, p AS predicate, coalesce(o, '') AS target_value, arg_max(decision, id) AS decision, arg_max(CASE WHEN s = ''
  OR o IS NULL THEN 'Incomplete relationship' ELSE 'MAKGED did not accept inferred relationship' END, id) AS reason,
  'high' AS risk_level, 'makged_review' AS alert_type FROM dec WHERE decision <> 'ACCEPT' GROUP BY ALL""")
def v06_review_alerts(t):
    """An alert for each relation of a file that was not accepted, as it was decided last."""
    return V.review_alerts(_relations(t))


# ---------------------------------------------------------------- upserts


def _items(t):
    k = F.col("o_orderkey")
    kind = F.element_at(F.array(*map(F.lit, ("email", "phone", "handle", "datapoint"))), (k % 4 + 1).cast("int"))
    value = F.when(k % 4 == 0, F.concat(F.lit("User"), F.col("o_custkey") % 20, F.lit("@X.org"))).otherwise(F.concat(F.lit("v"), F.col("o_custkey") % 30))
    return t.orders.select(
        k.alias("seq"), F.concat(F.lit("c"), F.col("o_custkey") % 5).alias("company"), F.concat(F.lit("r"), F.col("o_custkey") % 5).alias("request_id"), F.lit("mail").alias("source"), kind.alias("type"),
        F.lit("IDENTITY").alias("category"), value.alias("value"), F.when(k % 3 == 0, "high").otherwise("Low").alias("risk"), F.lit("accepted").alias("status"),
    )


_ITEMS_SQL = """items AS (
  SELECT o_orderkey AS seq, 'c' || (o_custkey % 5) AS company, ['email', 'phone', 'handle', 'datapoint'][1 + o_orderkey % 4] AS type, CASE
    WHEN o_orderkey % 4 = 0 THEN 'User' || (o_custkey % 20) || '@X.org' ELSE 'v' || (o_custkey % 30) END AS value,
    CASE WHEN o_orderkey % 3 = 0 THEN 'HIGH' ELSE 'LOW' END AS risk, 'r' || (o_custkey % 5) AS request_id FROM orders
), pts AS (SELECT *, 'IDENTITY|' || value || '|' || request_id AS point, CASE type WHEN 'email' THEN 'Email' WHEN 'phone' THEN 'Phone'
  WHEN 'handle' THEN 'Username' END AS kind, CASE type WHEN 'email' THEN lower(value) ELSE value END AS ident FROM items)"""


@query(f"""
WITH {_ITEMS_SQL} SELECT 'DataPoint' AS label, point AS key, arg_max(type, seq) || '/' || arg_max(risk, seq) AS shown FROM pts GROUP BY point
UNION ALL SELECT DISTINCT 'Company', company, '/' FROM pts UNION ALL SELECT DISTINCT kind, ident, '/' FROM pts WHERE kind IS NOT NULL""")
def m07_ingested_nodes(t):
    """Nodes of ingested items: companies, data points with their last properties, identifiers."""
    nodes, _ = M.ingested(_items(t))
    at = lambda k: F.coalesce(F.try_element_at("props", F.lit(k)), F.lit(""))
    return nodes.select("label", "key", F.concat_ws("/", at("type"), at("risk_level")).alias("shown"))


@query(f"WITH {_ITEMS_SQL} SELECT DISTINCT company AS src, 'COLLECTS' AS type, point AS dst FROM pts UNION ALL SELECT DISTINCT point, 'DERIVED_IDENTIFIER', ident FROM pts WHERE kind IS NOT NULL")
def m07_ingested_edges(t):
    """What companies collect and which identifiers are derived."""
    return M.ingested(_items(t))[1]


def _accounts(t):
    k = F.col("c_custkey")
    mail = F.when(k % 4 == 0, F.lit("")).otherwise(F.concat(F.lit(" User"), k % 10, F.lit("@X.org ")))
    data = F.map_from_arrays(
        F.array(*map(F.lit, ("username", "Email", "phone", "ip_address", "plan"))),
        F.array(F.when(k % 5 == 0, F.lit("")).otherwise(F.col("c_name")), mail, F.when(k % 3 == 0, F.concat(F.lit(" +44 "), k % 10)), F.when(k % 2 == 0, F.lit("10.0.0.1")), F.lit("free")),
    )
    ident = lambda kind, v: F.struct(F.lit(kind).cast("string").alias("type"), v.cast("string").alias("value"))
    ids = F.array(ident("handle", F.concat(F.lit("h"), k % 3)), ident("badge", F.lit("7")), ident("username", F.lit("")), ident(None, F.lit("x")))
    return t.customer.select(F.concat(F.lit("p"), k % 6).alias("persona"), F.lower("c_mktsegment").alias("platform"), data.alias("data"), ids.alias("identifiers"))


@query("""
WITH a AS (SELECT 'p' || (c_custkey % 6) AS persona, lower(c_mktsegment) || '/' || CASE WHEN c_custkey % 5 = 0 THEN 'unknown_user' ELSE c_name END AS account, CASE
  WHEN c_custkey % 4 <> 0 THEN 'user' || (c_custkey % 10) || '@x.org' END AS email,
  CASE WHEN c_custkey % 3 = 0 THEN '+44 ' || (c_custkey % 10) END AS phone, CASE
    WHEN c_custkey % 2 = 0 THEN '10.0.0.1' END AS ip, 'handle:h' || (c_custkey % 3) AS handle FROM customer)
SELECT DISTINCT persona AS src, 'OWNS_ACCOUNT' AS type, account AS dst FROM a UNION ALL SELECT DISTINCT account, 'REGISTERED_WITH', email FROM a WHERE email IS NOT NULL
  UNION ALL SELECT DISTINCT persona, 'USES_EMAIL', email FROM a WHERE email IS NOT NULL
UNION ALL SELECT DISTINCT account, 'VERIFIED_BY', phone FROM a WHERE phone IS NOT NULL UNION ALL SELECT DISTINCT account, 'ACCESSED_FROM', ip FROM a
  WHERE ip IS NOT NULL UNION ALL SELECT DISTINCT account, 'HAS_IDENTIFIER', handle FROM a""")
def m08_account_edges(t):
    """An account's owner, e-mail, phone, address and handles as edges."""
    return M.account_graph(_accounts(t))[1]


@query("""
SELECT 'p' || c_custkey AS src, 'HAS_NAME' AS type, trim(CASE WHEN c_custkey % 2 = 0 THEN 'Ann ' ELSE '' END || c_name) AS dst FROM customer UNION ALL
  SELECT 'p' || c_custkey, 'USES_EMAIL', 'a' || c_custkey || '@b.org' FROM customer
UNION ALL SELECT 'p' || c_custkey, 'HAS_PHONE', c_phone FROM (SELECT c_custkey, '+1 ' || c_custkey AS c_phone FROM customer) UNION ALL
  SELECT 'p' || c_custkey, 'HAS_IDENTIFIER', 'nick' FROM customer WHERE c_custkey % 3 = 0
UNION ALL SELECT 'root', 'HAS_PERSONA', 'p' || c_custkey FROM customer""")
def m09_identity_edges(t):
    """Names, e-mails, phones and user names of a persona; blanks are left out."""
    k = F.col("c_custkey")
    name = lambda a, b: F.struct(a.cast("string").alias("first"), b.cast("string").alias("last"))
    names = F.array(name(F.when(k % 2 == 0, "Ann").otherwise(""), F.col("c_name")), name(F.lit(None), F.lit("")))
    rows = t.customer.select(
        F.concat(F.lit("p"), k).alias("persona"), names.alias("names"), F.array(F.concat(F.lit(" A"), k, F.lit("@B.org ")), F.lit(" "), F.lit(None).cast("string")).alias("emails"),
        F.array(F.concat(F.lit("+1 "), k)).alias("phones"), F.when(k % 3 == 0, F.array(F.lit(" nick"))).alias("usernames"),
    )
    return M.identity_graph(rows)[1]


@query("""
WITH b AS (SELECT n_nationkey AS seq, CASE WHEN n_nationkey % 5 = 0 THEN '' ELSE 'node ' || (n_nationkey % 8) END AS label, CASE
  WHEN n_nationkey % 2 = 0 THEN 'ip_address' END AS type, CASE n_nationkey % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'odd' END AS risk FROM nation)
SELECT label, 'onsit' AS source, CASE type WHEN 'ip_address' THEN 'IPAddress' ELSE 'Entity' END AS kind, arg_min(CASE risk WHEN 'HIGH' THEN 'high'
  ELSE 'low' END, seq) AS risk, NULL AS error FROM b WHERE label <> '' GROUP BY 1, 3
UNION ALL SELECT 'unknown', NULL, NULL, NULL, 'Label is required' FROM b WHERE label = ''""")
def m10_bulk_nodes(t):
    """Nodes of a bulk upload, and an error for each row without a label."""
    k = F.col("n_nationkey")
    rows = t.nation.select(
        k.alias("seq"), F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("node "), k % 8)).alias("label"), F.when(k % 2 == 0, "ip_address").alias("type"), F.lit(None).cast("string").alias("source"),
        F.when(k % 3 == 0, "HIGH").when(k % 3 == 1, "odd").alias("risk"),
    )
    nodes, errors = M.bulk_nodes(rows)
    return nodes.withColumn("error", F.lit(None).cast("string")).unionByName(errors.select("label", "error"), allowMissingColumns=True)


@query("""
WITH e AS (SELECT user_id AS id, ts AS t, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'fail' ELSE 'start' END AS action FROM events),
l AS (SELECT id, min(t) FILTER (action = 'start') AS started_at, arg_max(action, (t, seq)) FILTER (action <> 'start') AS a,
  max(t) FILTER (action <> 'start') AS completed_at, arg_max('e' || seq, (t, seq)) FILTER (action = 'fail') AS error_message, arg_max(seq, (t, seq)) AS last,
  count(*) AS n FROM e GROUP BY id)
SELECT id, CASE WHEN a IS NULL THEN 'running' WHEN a = 'complete' THEN 'completed'
  ELSE 'error' END AS status, started_at, completed_at, error_message, CAST(last AS VARCHAR) AS last FROM l WHERE started_at IS NOT NULL""")
def m16_workflow_logs(t):
    """Starts and ends of workflows as one row each, details merged in order."""
    action = F.when(F.col("sender") == "purchase", "complete").when(F.col("sender") == "error", "fail").otherwise("start")
    rows = messages(t).select(F.col("request_id").alias("id"), F.col("ts").alias("at"), F.col("id").alias("seq"), action.alias("action"), F.create_map(F.lit("last"), F.col("id").cast("string")).alias("details"), F.concat(F.lit("e"), "id").alias("error"))
    return M.workflow_logs(rows).select("id", "status", "started_at", "completed_at", "error_message", F.try_element_at("details", F.lit("last")).alias("last"))


# ---------------------------------------------------------------- mail


def _mail(t):
    """Mail from companies' own hosts, from hosts that hold their root, from a part of it, from elsewhere and from nowhere."""
    k = F.col("id")
    number = F.lpad((F.col("request_id") % 40).cast("string"), 9, "0")
    sender = F.element_at(
        F.array(F.concat(F.lit("dpo@mail.Customer-"), number, F.lit(".example.com")), F.concat(F.lit("Team <x@customer-"), number, F.lit(">")), F.lit("a@cust.org"), F.lit("b@elsewhere.net"), F.lit("no address")), (k % 5 + 1).cast("int")
    )
    label = F.element_at(F.array(F.lit("DATA_READY"), F.lit("UNRELATED"), F.lit("EXTENSION")), (k % 3 + 1).cast("int"))
    return messages(t).select("id", sender.alias("sender"), label.alias("label"))


def _open_requests(t):
    rows = requests(t).filter("status <> 'completed'").join(companies(t), "company_id")
    return rows.select("id", F.concat(F.lit("https://www."), "domain", F.lit("/privacy")).alias("company"), "created_at")


_MAIL_SQL = """mail AS (
  SELECT id, ['dpo@mail.Customer-' || lpad(CAST(request_id % 40 AS VARCHAR), 9, '0') || '.example.com', 'Team <x@customer-' || lpad(CAST(request_id % 40 AS VARCHAR), 9,
    '0') || '>', 'a@cust.org', 'b@elsewhere.net', 'no address'][1 + id % 5] AS sender,
    ['DATA_READY', 'UNRELATED', 'EXTENSION'][1 + id % 3] AS label FROM messages
), open_ AS (SELECT r.id, 'customer-' || lpad(CAST(r.company_id AS VARCHAR), 9, '0') AS root, created_at FROM requests r WHERE status <> 'completed'),
roots AS (SELECT root, id, created_at FROM open_ QUALIFY row_number() OVER (PARTITION BY root ORDER BY created_at DESC, id) = 1),
dom AS (SELECT DISTINCT coalesce(split_part(split_part(sender, '@', 2), '>', 1), '') AS domain FROM mail),
hit AS (SELECT domain, id FROM dom JOIN roots ON contains(lower(domain), root) OR contains(root, split_part(domain, '.', 1))
  QUALIFY row_number() OVER (PARTITION BY domain ORDER BY created_at DESC, id) = 1),
matched AS (SELECT m.id AS mail_id, h.id AS request_id, label FROM mail m JOIN hit h ON h.domain = coalesce(split_part(split_part(m.sender, '@', 2), '>', 1), ''))"""


@query(f"WITH {_MAIL_SQL} SELECT mail_id, request_id FROM matched")
def j18_inbox_match(t):
    """Mail to open requests by parts of the sender's domain and of the company's host; the newest request counts."""
    return M.matched_mail(_mail(t), _open_requests(t))


@query(f"WITH {_MAIL_SQL} SELECT mail_id, request_id, CASE label WHEN 'DATA_READY' THEN 'data_available' WHEN 'EXTENSION' THEN 'extended' END AS status FROM matched")
def st2_inbox_updates(t):
    """ST2: what new mail changes: its request and the status that its class leads to."""
    return incremental.inbox_updates(_mail(t), _open_requests(t))


@query("""
WITH p AS (SELECT page_id, url, regexp_extract(url, '^https?://([^/?#]*)', 1) AS domain FROM pages), r AS (SELECT page_id AS id, CASE page_id % 3 WHEN 0 THEN domain
  WHEN 1 THEN split_part(domain, '.', 1) ELSE 'none.such' END AS company_url FROM p WHERE page_id % 10 = 0)
SELECT r.id, r.company_url, p.url AS policy_url, 'policy ' || p.page_id AS summary FROM r LEFT JOIN p ON p.domain = r.company_url OR (r.company_url <> ''
  AND contains(p.url, r.company_url))""")
def j26_policies_of_requests(t):
    """Requests with the policies of their domain, or whose address holds the company's."""
    domain = F.regexp_extract("url", r"^https?://([^/?#]*)", 1)
    policies = t.pages.select("page_id", "url", domain.alias("domain"), F.concat(F.lit("policy "), "page_id").alias("summary"))
    company = F.when(F.col("page_id") % 3 == 0, F.col("domain")).when(F.col("page_id") % 3 == 1, F.substring_index("domain", ".", 1)).otherwise("none.such")
    asked = policies.filter("page_id % 10 = 0").select(F.col("page_id").alias("id"), company.alias("company_url"))
    return M.with_policies(asked, policies.drop("page_id"))


@query("SELECT id, request_id, CAST(count(*) FILTER (value > 5) OVER (PARTITION BY request_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS DOUBLE) / count(*) OVER (PARTITION BY request_id) AS progress FROM messages")
def st5_progress(t):
    """ST5: the share of a request's items that are done, item by item."""
    return incremental.progress_of(messages(t), "request_id", F.col("value") > 5, F.col("ts"), F.col("id")).select("id", "request_id", "progress")


# ---------------------------------------------------------------- graphs of cases


@query("""
SELECT n_name AS company, c_name AS value FROM nation JOIN (SELECT c_nationkey, c_name, CASE c_mktsegment WHEN 'BUILDING' THEN 'PERSON' WHEN 'MACHINERY' THEN 'EMAIL' ELSE 'OTHER' END AS type,
  CASE c_mktsegment WHEN 'FURNITURE' THEN 'IDENTITY' ELSE 'X' END AS category FROM customer) ON c_nationkey = n_nationkey WHERE type IN ('PERSON', 'EMAIL') OR category = 'IDENTITY'""")
def j17_company_links(t):
    """Every company linked to the persons, e-mails and identities of its files."""
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "PERSON").when(F.col("c_mktsegment") == "MACHINERY", "EMAIL").otherwise("OTHER")
    category = F.when(F.col("c_mktsegment") == "FURNITURE", "IDENTITY").otherwise("X")
    entities = t.customer.select("c_nationkey", F.col("c_name").alias("value"), kind.alias("type"), category.alias("category"))
    found = entities.filter(F.col("type").isin("PERSON", "EMAIL") | (F.col("category") == "IDENTITY"))
    return found.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("company"), "value")


@query("""
SELECT type, n, (SELECT count(*) FROM edges) AS n_edges, (SELECT count(*) FROM edges WHERE p = 'LOCATED_IN' AND (seq % 10 = 0 OR confidence > 0.8)) AS high_risk
  FROM (SELECT 'Account' AS type, count(*) AS n FROM supplier UNION ALL SELECT 'Company', count(*) FROM nation)""")
def a14_graph_counts(t):
    """Nodes by their first label, edges, and inferences of high risk or score."""
    label = lambda df, *names: df.select(F.array(*map(F.lit, names)).alias("labels"))
    nodes = label(t.supplier, "Account", "Entity").unionByName(label(t.nation, "Company"))
    risk = F.when(F.col("seq") % 10 == 0, "high").otherwise("low")
    counts = R.count_where(edges(t), n_edges=F.lit(True), high_risk=(F.col("p") == "LOCATED_IN") & ((risk == "high") | (F.col("confidence") > 0.8)))
    return nodes.groupBy(F.get("labels", F.lit(0)).alias("type")).agg(F.count("*").alias("n")).join(F.broadcast(counts))  # one row


@query("""
WITH r AS (SELECT n_regionkey AS key, n_nationkey AS seq, [n_nationkey % 7, 15] AS articles, ['f' || (n_nationkey % 4), 'g' || n_regionkey] AS findings FROM nation),
f AS (SELECT key, x, min(seq * 10 + i) AS pos FROM (SELECT key, seq, unnest(findings) AS x, unnest([0, 1]) AS i FROM r) GROUP BY 1, 2)
SELECT key, (SELECT string_agg(DISTINCT CAST(a AS VARCHAR), ',' ORDER BY lpad(CAST(a AS VARCHAR), 3, '0')) FROM (SELECT r2.key AS k2, unnest(articles) AS a FROM r r2)
  WHERE k2 = f.key) AS articles, string_agg(x, ',' ORDER BY pos) AS findings,
  (SELECT count(*) FROM r r3 WHERE r3.key = f.key) AS n_sources, CAST(greatest(0, 100 - 10 * count(*)) AS INT) AS compliance FROM f GROUP BY key""")
def a21_aggregated(t):
    """Sub-results as one: sorted articles, distinct findings in order, the score they leave."""
    k = F.col("n_nationkey")
    rows = t.nation.select(F.col("n_regionkey").alias("key"), k.alias("seq"), F.array((k % 7).cast("int"), F.lit(15)).alias("articles"), F.array(F.concat(F.lit("f"), k % 4), F.concat(F.lit("g"), "n_regionkey")).alias("findings"))
    out = R.aggregated(rows, "key")
    return out.select("key", F.array_join(F.transform("articles", lambda a: a.cast("string")), ",").alias("articles"), F.array_join("findings", ",").alias("findings"), "n_sources", "compliance")


@query("""
WITH f AS (SELECT 'Email' AS type, 'label ' || (o_custkey % 50) AS label, o_orderkey AS seq, o_custkey AS seed FROM orders)
  SELECT type, label, min(seq) AS seq, arg_min(seed, seq) AS seed FROM f GROUP BY 1, 2""")
def w08_entities_across_seeds(t):
    """Entities that several seeds bring, each once, as the first one brought it."""
    rows = t.orders.select(F.lit("Email").alias("type"), F.concat(F.lit("label "), F.col("o_custkey") % 50).alias("label"), F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("seed"))
    best = F.min(F.struct("seq", "seed")).alias("x")
    return rows.groupBy("type", "label").agg(best).select("type", "label", "x.seq", "x.seed")


@query("""
WITH s AS (SELECT c_custkey AS id, [' a' || c_custkey || '@b.org', 'https://u:p@www.Shop' || c_custkey || '.com:80/x', 'shop' || c_custkey || '.org',
  'nick' || c_custkey, 'two words', 'a@b', ''][1 + c_custkey % 7] AS seed FROM customer)
SELECT id, CASE id % 7 WHEN 0 THEN 'email' WHEN 1 THEN 'domain' WHEN 2 THEN 'domain' WHEN 3 THEN 'username' WHEN 5 THEN 'username' END AS kind, CASE id % 7
  WHEN 0 THEN trim(seed) WHEN 1 THEN 'www.shop' || id || '.com' WHEN 2 THEN seed WHEN 3 THEN seed WHEN 5 THEN seed END AS value FROM s""")
def p22_seed_kinds(t):
    """What a seed is: an e-mail, a domain or URL, a user name, or nothing."""
    k = F.col("c_custkey")
    seeds = (F.concat(F.lit(" a"), k, F.lit("@b.org")), F.concat(F.lit("https://u:p@www.Shop"), k, F.lit(".com:80/x")), F.concat(F.lit("shop"), k, F.lit(".org")), F.concat(F.lit("nick"), k), F.lit("two words"), F.lit("a@b"), F.lit(""))
    rows = t.customer.select(k.alias("id"), F.element_at(F.array(*seeds), (k % 7 + 1).cast("int")).alias("seed"))
    s = F.trim("seed")
    mail = s.rlike(X.EMAIL) & F.contains(F.get(F.split(s, "@"), F.lit(1)), F.lit("."))
    url, host = s.rlike("^https?://"), X.host_name(s)
    plain = ~F.contains(s, F.lit(" ")) & (s != "")
    domain = plain & F.contains(s, F.lit(".")) & s.rlike(X.DOMAIN)
    kind = F.when(mail, "email").when(url & (host != ""), "domain").when(domain, "domain").when(plain, "username")
    value = F.when(mail, s).when(url & (host != ""), host).when(plain, F.when(domain, F.lower(s)).otherwise(s))
    return rows.select("id", kind.alias("kind"), value.alias("value"))


@query("""
WITH r AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'a@b.org' ELSE '' END AS email, CASE WHEN c_custkey % 3 = 0 THEN ['nick', ''] END AS users, CASE
  WHEN c_custkey % 5 = 0 THEN ['b.org'] ELSE [] END AS domains, ['quick', 'standard', 'deep'][1 + c_custkey % 3] AS depth FROM customer)
SELECT id, array_to_string([x FOR x IN list_concat([email], coalesce(users, []), ['+1'], domains) IF x <> ''], ',') AS seeds,
  array_to_string([x FOR x IN [CASE WHEN email <> '' THEN 'email' END, CASE WHEN users IS NOT NULL THEN 'username' END, CASE WHEN id % 7 <> 0 THEN 'breach' END, CASE
    WHEN depth <> 'quick' THEN 'social' END, CASE WHEN depth <> 'quick' AND len(domains) > 0 THEN 'domain,dns,whois' END,
    CASE WHEN depth = 'deep' THEN 'subdomain,technology,crawler' END] IF x IS NOT NULL], ',') AS enrichers FROM r""")
def p24_seed_lists(t):
    """The seeds of a search, blanks left out, and the lookups that its depth calls for."""
    k = F.col("c_custkey")
    none = F.array().cast("array<string>")
    email, users = F.when(k % 2 == 0, "a@b.org").otherwise(""), F.when(k % 3 == 0, F.array(F.lit("nick"), F.lit("")))
    domains = F.when(k % 5 == 0, F.array(F.lit("b.org"))).otherwise(none)
    depth = F.element_at(F.array(F.lit("quick"), F.lit("standard"), F.lit("deep")), (k % 3 + 1).cast("int"))
    seeds = F.filter(F.concat(F.array(email), F.coalesce(users, none), F.array(F.lit("+1")), domains), lambda x: F.coalesce(x, F.lit("")) != "")
    wide = depth != "quick"
    rules = (
        (email != "", ("email",)), (F.size(F.coalesce(users, none)) > 0, ("username",)), (k % 7 != 0, ("breach",)), (wide, ("social",)),
        (wide & (F.size(domains) > 0), ("domain", "dns", "whois")), (depth == "deep", ("subdomain", "technology", "crawler")),
    )
    lookups = F.array_distinct(F.concat(*[F.when(c, F.array(*map(F.lit, names))).otherwise(none) for c, names in rules]))
    return t.customer.select(k.alias("id"), F.array_join(seeds, ",").alias("seeds"), F.array_join(lookups, ",").alias("enrichers"))


@query("SELECT request_id, line, status FROM files WHERE status <> 'error'")
def n04_staged_files(t):
    """Stages that can be switched off, each a function of a table: the filter is on, the renaming off."""
    stages = (("filter", True, lambda df: df.filter("status <> 'error'")), ("rename", False, lambda df: df.withColumnRenamed("line", "number")), ("cut", True, lambda df: df.select("request_id", "line", "status")))
    out = files(t)
    for _, on, stage in stages:
        out = out.transform(stage) if on else out
    return out


@query("""SELECT p_partkey AS id, 'Unknown' AS s FROM part WHERE p_partkey % 50 = 0""")
def d25_missing_parts(t):
    """What stands for a missing part."""
    rows = t.part.filter("p_partkey % 50 = 0").select(F.col("p_partkey").alias("id"), F.explode(P.triples_of(F.lit('[{"relation": "x"}]'))).alias("x"))
    return rows.select("id", "x.s")
