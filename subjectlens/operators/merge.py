"""Keyed upserts and changes as pure functions: old x delta -> new. Writing the result is the caller's job."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subjectlens.functions.text import label_of, risk_level, without_first
from subjectlens.functions.values import merged_map
from subjectlens.operators.patterns import best_in_texts, best_of_patterns, held_pairs
from subjectlens.operators.tables import written


def _aside(delta: DataFrame, keys: Sequence[str]) -> DataFrame:
    return delta.select(*[F.col(c).alias(f"__{c}") for c in delta.columns]).withColumn("__here", F.lit(True))


def _on(keys: Sequence[str]):
    out = F.lit(True)
    for k in keys:
        out = out & (F.col(k) == F.col(f"__{k}"))
    return out


def upsert(old: DataFrame, delta: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of delta replace those with their key, others are added."""
    kept = old.join(delta.select(*keys).distinct(), list(keys), "left_anti")
    return kept.select(*old.columns).unionByName(delta.select(*old.columns))


def insert_missing(old: DataFrame, delta: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of delta whose key is new are added."""
    return old.unionByName(delta.join(old.select(*keys).distinct(), list(keys), "left_anti").select(*old.columns))


def replace_groups(old: DataFrame, delta: DataFrame, group: str) -> DataFrame:
    """All old rows of the groups that delta names go, delta's rows come in."""
    return upsert(old, delta, [group])


def merge_node(old: DataFrame, delta: DataFrame, keys: Sequence[str], on_match: Sequence[str], keep_first: Sequence[str] = ()) -> DataFrame:
    """A new key brings all columns; a known one changes `on_match` only, and `keep_first` where it was null."""
    joined = old.join(_aside(delta, keys), _on(keys), "full_outer")
    new = F.coalesce(F.col("__here"), F.lit(False))
    known = F.col(keys[0]).isNotNull()
    out = []
    for c in old.columns:
        if c in keys or c in keep_first:
            out.append(F.coalesce(c, f"__{c}").alias(c))
        elif c in on_match:
            out.append(F.when(new, F.col(f"__{c}")).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.when(known, F.col(c)).otherwise(F.col(f"__{c}")).alias(c))
    return joined.select(*out)


def update_present(old: DataFrame, delta: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Values of delta that are not null replace old ones; delta adds no rows."""
    joined = old.join(_aside(delta, keys), _on(keys), "left")
    return joined.select(*[F.col(c) if c in keys or c not in delta.columns else F.coalesce(f"__{c}", c).alias(c) for c in old.columns])


def cascade_delete(ids: DataFrame, **tables: tuple[DataFrame, str]) -> dict[str, DataFrame]:
    """Each table (frame, key column) without the rows of the ids in ids(id)."""
    return {name: df.join(ids.select(F.col("id").alias("__id")), F.col(key) == F.col("__id"), "left_anti") for name, (df, key) in tables.items()}


def split_valid(rows: DataFrame, valid) -> tuple[DataFrame, DataFrame]:
    """Rows to create, and the others."""
    ok = F.coalesce(valid, F.lit(False))
    return rows.filter(ok), rows.filter(~ok)


def thread_states(events: DataFrame) -> DataFrame:
    """(thread, status, n, history) from events(thread, ts, seq, action): the last status and all actions in time order."""
    status = F.max_by("action", F.struct("ts", "seq")).alias("status")
    history = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "seq", "action"))), lambda x: x["action"]), ">").alias("history")
    return events.groupBy("thread").agg(status, F.count("*").alias("n"), history)


def bulk_nodes(rows: DataFrame, most: int = 100) -> tuple[DataFrame, DataFrame]:
    """rows(seq, label, type, source, risk) as (nodes, errors). More than `most` rows fail as a whole.

    Nodes are one for each label and source; a row without a label is an error of its own.
    """
    if rows.limit(most + 1).count() > most:
        raise ValueError(f"Maximum batch size is {most} nodes")
    good, bad = split_valid(rows, F.col("label") != "")
    kind = label_of(F.coalesce("type", F.lit("Entity"))).alias("kind")
    made = good.select("seq", "label", kind, F.coalesce("source", F.lit("onsit")).alias("source"), risk_level(F.coalesce("risk", F.lit("low"))).alias("risk"))
    nodes = made.groupBy("label", "source", "kind").agg(F.min_by("risk", "seq").alias("risk"))
    return nodes, bad.select("seq", F.lit("unknown").alias("label"), F.lit("Label is required").alias("error"))


#: Types of an item that have a node of their own, with the node's label.
IDENTIFIERS = {"email": "Email", "person_email": "Email", "phone": "Phone", "telephone": "Phone", "mobile": "Phone", "username": "Username", "handle": "Username"}


def ingested(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """items(seq, company, request_id, source, type, category, value, risk, status) as (nodes, edges).

    A data point is one by category, value and request, the last item's properties count; its company collects it; of
    e-mails, phones and user names a node is derived. nodes(label, key, props), edges(src, type, dst): each once.
    """
    point = F.concat_ws("|", "category", "value", "request_id")
    props = F.create_map(*[x for c, v in (("type", "type"), ("risk_level", None), ("source", "source"), ("status", "status")) for x in (F.lit(c), F.upper("risk") if v is None else F.col(v))])
    kind = F.try_element_at(F.create_map(*[F.lit(x) for kv in IDENTIFIERS.items() for x in kv]), F.lower("type"))
    ident = F.when(kind == "Email", F.lower("value")).otherwise(F.col("value"))
    rows = items.select("seq", "company", point.alias("point"), props.alias("props"), kind.alias("kind"), ident.alias("ident"), "source")
    none = F.create_map().cast("map<string,string>")
    node = lambda df, label, key, p: df.select(label.alias("label"), key.alias("key"), p.alias("props"), "seq")
    every = node(rows, F.lit("Company"), F.col("company"), none).unionByName(node(rows, F.lit("DataPoint"), F.col("point"), F.col("props")))
    named = rows.filter("kind is not null")
    every = every.unionByName(node(named, F.col("kind"), F.col("ident"), F.create_map(F.lit("source"), F.col("source"))))
    nodes = every.groupBy("label", "key").agg(F.max_by("props", "seq").alias("props"))
    links = rows.select(F.col("company").alias("src"), F.lit("COLLECTS").alias("type"), F.col("point").alias("dst"))
    derived = named.select(F.col("point").alias("src"), F.lit("DERIVED_IDENTIFIER").alias("type"), F.col("ident").alias("dst"))
    return nodes, links.unionByName(derived).distinct()


#: Keys of an account's data that become nodes of their own.
LINKED = ("email", "phone", "ip", "ip_address", "device", "device_id")


def account_graph(accounts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """accounts(persona, platform, data, identifiers) as (nodes, edges).

    data is a map; empty values don't count. Keys of LINKED become nodes, the others properties of the account, which
    goes by its user name, else its id. identifiers(type, value) of user names and handles become nodes.
    """
    value = lambda k: F.nullif(F.try_element_at("low", F.lit(k)), F.lit(""))
    filled = F.map_filter("data", lambda _, v: F.coalesce(v, F.lit("")) != "")
    rows = accounts.withColumn("filled", filled)
    rows = rows.withColumn("low", F.map_from_entries(F.transform(F.filter(F.map_entries("filled"), lambda e: F.lower(e["key"]).isin(*LINKED)), lambda e: F.struct(F.lower(e["key"]), e["value"]))))
    rows = rows.withColumn("props", F.map_filter("filled", lambda k, _: ~F.lower(k).isin(*LINKED)))
    name = F.coalesce(F.try_element_at("props", F.lit("username")), F.try_element_at("props", F.lit("id")), F.lit("unknown_user"))
    account = F.concat_ws("/", "platform", name)
    known = F.filter("identifiers", lambda i: (F.coalesce(i["type"], F.lit("")) != "") & (F.coalesce(i["value"], F.lit("")) != ""))
    rows = rows.select(
        "persona", account.alias("account"), "props", F.lower(F.trim(value("email"))).alias("email"), F.trim(value("phone")).alias("phone"),
        F.trim(F.coalesce(value("ip"), value("ip_address"))).alias("ip"), F.filter(known, lambda i: i["type"].isin("username", "handle")).alias("ids"),
    )
    link = lambda src, type_, label, dst: F.struct(src.alias("src"), F.lit(type_).alias("type"), F.lit(label).alias("label"), dst.alias("dst"))
    persona, acc = F.col("persona"), F.col("account")
    fixed = F.array(
        link(persona, "OWNS_ACCOUNT", "Account", acc), link(acc, "REGISTERED_WITH", "Email", F.col("email")), link(persona, "USES_EMAIL", "Email", F.col("email")),
        link(acc, "VERIFIED_BY", "Phone", F.col("phone")), link(acc, "ACCESSED_FROM", "IPAddress", F.col("ip")),
    )
    links = F.concat(fixed, F.transform("ids", lambda i: link(acc, "HAS_IDENTIFIER", "Identifier", F.concat_ws(":", i["type"], i["value"]))))
    found = rows.select("props", "account", "persona", F.explode(F.filter(links, lambda x: F.coalesce(x["dst"], F.lit("")) != "")).alias("x"))
    edges = found.select("x.src", "x.type", "x.dst").distinct()
    ends = found.select(F.col("x.label").alias("label"), F.col("x.dst").alias("key")).union(found.select(F.lit("Persona"), "persona")).distinct()
    own = rows.groupBy(F.lit("Account").alias("label"), F.col("account").alias("key")).agg(F.max_by("props", F.to_json("props")).alias("props"))
    return ends.join(own, ["label", "key"], "left"), edges


def identity_graph(identities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """identities(persona, names, emails, phones, usernames) as (nodes, edges): blanks are left out, e-mails in lower case.

    names is an array of (first, last), the others are arrays of text.
    """
    full = F.transform("names", lambda n: F.trim(F.concat_ws(" ", F.nullif(n["first"], F.lit("")), F.nullif(n["last"], F.lit("")))))
    kinds = (("HAS_NAME", "Name", full), ("USES_EMAIL", "Email", F.transform("emails", lambda x: F.lower(F.trim(x)))), ("HAS_PHONE", "Phone", F.transform("phones", lambda x: F.trim(x))), ("HAS_IDENTIFIER", "Identifier", F.transform("usernames", lambda x: F.trim(x))))
    none = F.array().cast("array<string>")
    tagged = lambda t, k, v: F.transform(F.coalesce(v, none), lambda x: F.struct(F.lit(t).alias("type"), F.lit(k).alias("label"), x.alias("dst")))
    every = F.flatten(F.array(*[tagged(t, k, v) for t, k, v in kinds]))
    found = identities.select("persona", F.explode(F.filter(every, lambda x: F.coalesce(x["dst"], F.lit("")) != "")).alias("x"))
    edges = found.select(F.col("persona").alias("src"), "x.type", "x.dst").distinct()
    root = identities.select(F.lit("root").alias("src"), F.lit("HAS_PERSONA").alias("type"), F.col("persona").alias("dst")).distinct()
    nodes = found.select("x.label", F.col("x.dst").alias("key")).union(identities.select(F.lit("Persona"), "persona")).distinct()
    return nodes, edges.unionByName(root)


def workflow_logs(events: DataFrame) -> DataFrame:
    """(id, status, started_at, completed_at, error_message, details) from events(id, at, seq, action, details, error).

    action: start, complete or fail; the last end of a log counts, details are merged in order. Ends without a start have no row.
    """
    place = F.struct("at", "seq")
    start = F.col("action") == "start"
    end = F.when(~start, place)
    last = F.max_by(F.struct("action", "at"), end)
    steps = F.transform(F.array_sort(F.collect_list(F.struct("at", "seq", F.to_json(F.coalesce("details", F.create_map().cast("map<string,string>"))).alias("d")))), lambda x: F.from_json(x["d"], "map<string,string>"))
    by = events.groupBy("id").agg(F.min(F.when(start, F.col("at"))).alias("started_at"), last.alias("e"), F.max_by("error", F.when(F.col("action") == "fail", place)).alias("error_message"), steps.alias("steps"))
    merged = F.aggregate("steps", F.create_map().cast("map<string,string>"), merged_map)
    status = F.when(F.col("e").isNull(), "running").when(F.col("e.action") == "complete", "completed").otherwise("error")
    return by.filter("started_at is not null").select("id", status.alias("status"), "started_at", F.col("e.at").alias("completed_at"), "error_message", merged.alias("details"))


def root_of(company: Column) -> Column:
    """The first label of a company's host or name, in lower case."""
    host = F.regexp_replace(F.lower(company), r"^https?://", "")
    return F.substring_index(F.substring_index(without_first(host, "www."), "/", 1), ".", 1)


def matched_mail(mail: DataFrame, requests: DataFrame, least: int = 3) -> DataFrame:
    """(mail_id, request_id) of mail(id, sender) and requests(id, company, created_at).

    A sender's domain matches if it holds the company's root (at least three characters), or the root holds the
    domain's first label, which an empty domain always does; of several requests the newest counts, then the smallest id.
    Automata look for all roots in the distinct domains, and for all labels in the distinct roots; tasks keep the newest
    request of each, so long addresses and short labels make no more rows.
    """
    domain = F.coalesce(F.substring_index(F.get(F.split("sender", "@"), F.lit(1)), ">", 1), F.lit(""))
    sent = mail.select("id", domain.alias("domain"))
    domains = written(sent.select("domain", F.lower("domain").alias("low"), F.substring_index("domain", ".", 1).alias("label")).distinct(), "mail")
    at, back = F.coalesce(F.unix_micros(F.col("created_at").cast("timestamp")), F.lit(-(1 << 62))), -F.col("id").cast("long")
    ranked = requests.select(root_of(F.col("company")).alias("root"), at.alias("a"), back.alias("b")).filter(F.length("root") >= least)
    roots = written(ranked.groupBy("root").agg(F.max(F.struct("a", "b")).alias("x")).select("root", "x.a", "x.b"), "mail")
    held = best_in_texts(domains.select(F.col("low").alias("text")), roots.withColumnRenamed("root", "pattern"))
    holding = best_of_patterns(roots.withColumnRenamed("root", "text"), domains.select(F.col("label").alias("pattern")))
    newest = roots.agg(F.max(F.struct("a", "b")).alias("x")).filter("x is not null").select("x.a", "x.b")
    every = (
        domains.join(held, F.col("low") == F.col("text")).select("domain", "a", "b")
        .unionByName(domains.join(holding, F.col("label") == F.col("pattern")).select("domain", "a", "b"))
        .unionByName(domains.filter("label = ''").select("domain").join(F.broadcast(newest)))  # one row
    )
    best = every.groupBy("domain").agg(F.max(F.struct("a", "b")).alias("x"))
    return sent.join(best, "domain").select(F.col("id").alias("mail_id"), (-F.col("x.b")).alias("request_id"))


#: Rows of a company's requests and policies that are made in one piece, about.
ROWS_A_PIECE = 8_000_000


def with_policies(requests: DataFrame, policies: DataFrame) -> DataFrame:
    """requests(id, company_url) left joined to policies(domain, url, summary): one row for each policy of the domain or whose
    address holds the company's.

    Automata look for all companies in the distinct addresses, so work follows the lengths of the addresses and the
    matches; a policy that fits both ways counts once. Where many requests meet many policies the rows are their product:
    the policies of such a company are dealt out in pieces, and the rows come policy by policy, so that a column format
    keeps an address and a summary once for all requests of the company.
    """
    pairs = held_pairs(policies.select(F.col("url").alias("text")), requests.select(F.col("company_url").alias("pattern")))
    rows = policies.select("url", "domain", "summary")
    holds = rows.join(pairs.select(F.col("text").alias("url"), F.col("pattern").alias("company_url")), "url").select("url", "summary", "company_url")
    inside = F.coalesce((F.col("domain") != "") & F.contains("url", "domain"), F.lit(False))
    same = rows.filter(F.col("domain").isNotNull() & ~inside).select("url", "summary", F.col("domain").alias("company_url"))
    asked = requests.groupBy("company_url").agg(F.count("*").cast("double").alias("r"))
    held = written(holds.unionByName(same).join(asked, "company_url", "left_semi"), "policies")
    offered = held.groupBy("company_url").agg(F.count("*").alias("n"))
    sizes = written(asked.join(offered, "company_url").select("company_url", (F.col("r") * F.col("n")).alias("rows")), "policies")
    parts = math.ceil((sizes.agg(F.sum("rows")).first()[0] or 0) / ROWS_A_PIECE) + int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    large = sizes.select("company_url", F.ceil(F.col("rows") / ROWS_A_PIECE).cast("int").alias("pieces")).filter("pieces > 1")
    dealt = lambda df, piece: df.join(large, "company_url", "left").withColumn("pieces", F.coalesce("pieces", F.lit(1))).withColumn("piece", piece).drop("pieces")
    policy = dealt(held, F.pmod(F.xxhash64("url", "summary"), F.col("pieces")).cast("int"))
    request = dealt(requests.select("id", "company_url"), F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    by = ("company_url", "piece")
    met = policy.repartition(parts, *by).join(request.repartition(parts, *by), list(by), "left")  # all are asked for; as a left join it takes policy by policy
    none = requests.join(offered, "company_url", "left_anti").select("id", "company_url", *[F.lit(None).cast(held.schema[c].dataType).alias(c) for c in ("url", "summary")])
    return met.select("id", "company_url", "url", "summary").unionByName(none).withColumnRenamed("url", "policy_url")
