"""Model replies as columns: JSON out of prose and code fences, triples under other key names, defaults, categories as items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names that a triple's parts go by, in order, and what stands for a missing part.
PARTS = {"s": ("subject", "head"), "p": ("predicate", "relation"), "o": ("object", "tail")}
MISSING = {"s": "Unknown", "p": "UNKNOWN", "o": "Unknown"}


def once(value: Column, use) -> Column:
    """use(value) with value bound to a name: it is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def unfenced(reply: Column) -> Column:
    """What stands in the first code fence, else the reply."""
    inside = F.regexp_extract(reply, r"```(?:json)?\s*([\s\S]*?)```", 1)
    return F.when(reply.rlike(r"```(?:json)?\s*[\s\S]*?```"), F.trim(F.regexp_replace(inside, r"^\s+|\s+$", ""))).otherwise(reply)


def bracketed(text: Column) -> Column:
    """From the first [ to the ] that closes it, counting brackets; null if none does."""
    parts = F.filter(F.split(F.substring(text, F.instr(text, "["), F.length(text)), r"(?=[\[\]])"), lambda x: x != "")
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("done"), F.lit("").alias("out"))

    def add(state: Column, part: Column) -> Column:
        depth = state["depth"] + F.when(F.startswith(part, F.lit("[")), 1).otherwise(-1)
        closed = depth == 0
        kept = F.concat(state["out"], F.when(closed, F.lit("]")).otherwise(part))
        return F.when(state["done"], state).otherwise(F.struct(depth.alias("depth"), closed.alias("done"), kept.alias("out")))

    found = F.aggregate(parts, start, add, lambda x: F.when(x["done"], x["out"]))
    return F.when(F.contains(text, F.lit("[")), found)


def repaired(json: Column) -> Column:
    """Quotes around bare keys, no commas before closing brackets."""
    return F.regexp_replace(F.regexp_replace(json, r"(\s*)(\w+)(\s*):(\s*)", r'$1"$2"$3:$4'), r",(\s*[\]}])", "$1")


def json_of(reply: Column) -> Column:
    """The JSON in a reply as text: the whole, else its first array, else that array repaired; null if none parses."""
    good = lambda c: F.when(F.try_parse_json(c).isNotNull(), c)
    return once(unfenced(reply), lambda t: F.coalesce(good(t), once(bracketed(t), lambda a: F.coalesce(good(a), good(repaired(a))))))


def object_or(reply: Column, defaults: Column) -> Column:
    """The JSON object in a reply as text, else the defaults (a struct)."""
    body = F.regexp_extract(reply, r"(\{[\s\S]*\})", 1)
    return F.when(F.try_parse_json(body).isNotNull(), body).otherwise(F.to_json(defaults))


ITEMS = "array<map<string,string>>"


def triples_of(json: Column) -> Column:
    """(s, p, o, confidence) of the objects of a JSON array, under any of the parts' names."""
    items = F.from_json(json, ITEMS)
    part = lambda m, c: F.coalesce(*[F.nullif(F.try_element_at(m, F.lit(k)), F.lit("")) for k in PARTS[c]], F.lit(MISSING[c])).alias(c)
    confidence = lambda m: F.try_element_at(m, F.lit("confidence")).try_cast("double").alias("confidence")
    return F.transform(F.filter(items, lambda m: m.isNotNull()), lambda m: F.struct(part(m, "s"), part(m, "p"), part(m, "o"), confidence(m)))


def flattened(requests: DataFrame) -> DataFrame:
    """(id, type, category, value, risk) from requests(id, categories, extracted).

    categories: map of a name to (examples, riskLevel); extracted: array of (type, category, value, riskLevel).
    """
    default = lambda c, v: F.coalesce(c, F.lit(v))
    by = requests.select("id", F.explode("categories").alias("category", "c")).select("id", "category", "c.riskLevel", F.explode("c.examples").alias("value"))
    points = by.select("id", F.lit("datapoint").alias("type"), "category", "value", default(F.col("riskLevel"), "MEDIUM").alias("risk"))
    named = requests.select("id", F.explode("extracted").alias("e"))
    entities = named.select(
        "id", default(F.col("e.type"), "entity").alias("type"), default(F.col("e.category"), "UNKNOWN").alias("category"),
        default(F.col("e.value"), "").alias("value"), default(F.col("e.riskLevel"), "MEDIUM").alias("risk"),
    )
    return points.unionByName(entities)


def plain_props(props: Column) -> Column:
    """a VARIANT object as a map of text: nulls go, objects and arrays of objects become JSON text, other values stay as they are."""
    entries = F.from_json(F.to_json(props), "map<string,string>")
    return F.map_filter(entries, lambda _, v: v.isNotNull())


def grounded(text: Column, item: Column, classes: tuple[str, ...]) -> Column:
    """(class, text, start, end, confidence) of a model's item(class, text, start_offset, confidence) in a text.

    The place where the text is found counts, the model's own where it isn't; null for unknown classes and empty texts.
    """
    at = F.instr(text, item["text"]) if isinstance(item["text"], str) else F.position(item["text"], text)
    start = F.when(at > 0, at - 1).otherwise(F.coalesce(item["start_offset"].try_cast("int"), F.lit(0)))
    valid = item["class"].isin(*classes) & (F.coalesce(item["text"], F.lit("")) != "")
    found = F.struct(
        item["class"].alias("class"), item["text"].alias("text"), start.cast("int").alias("start"), (start + F.length(item["text"])).cast("int").alias("end"),
        F.coalesce(item["confidence"].try_cast("double"), F.lit(0.8)).alias("confidence"),
    )
    return F.when(valid, found)
