"""Triples and entities: checks, deduplication, entity resolution, merging of nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subjectlens.functions.text import entity_key
from subjectlens.operators.relational import first_per


def is_valid(s: str = "s", p: str = "p", o: str = "o") -> Column:
    """All three parts are there and not blank."""
    out = F.lit(True)
    for c in (s, p, o):
        out = out & F.coalesce(F.trim(F.col(c)) != "", F.lit(False))
    return out


def dedup_triples(triples: DataFrame, trim: bool = True) -> DataFrame:
    """One row per triple whatever its case: the highest confidence, then the first in input order (seq).

    Taken as a maximum with partial aggregation, so a triple repeated very often is no hot key.
    """
    tidy = F.trim if trim else lambda c: F.col(c)
    keys = [F.lower(tidy("s")).alias("__s"), F.upper(tidy("p")).alias("__p"), F.lower(tidy("o")).alias("__o")]
    columns = triples.columns
    best = F.max_by(F.struct(*columns), F.struct("confidence", -F.col("seq"))).alias("__best")
    return triples.groupBy(*keys).agg(best).select(*[F.col(f"__best.{c}").alias(c) for c in columns])


def gate(triples: DataFrame, least: float = 0.5) -> DataFrame:
    """Direct triples stay, inferred ones from a confidence on."""
    return triples.filter(~F.col("inferred") | (F.col("confidence") >= least))


def uses(triples: DataFrame) -> DataFrame:
    """(name, n): lower-cased entities of both ends with their uses."""
    ends = triples.select(F.explode(F.array(F.lower("s"), F.lower("o"))).alias("name"))
    return ends.groupBy("name").agg(F.count("*").alias("n"))


def canonical_names(names: DataFrame) -> DataFrame:
    """(name, canonical) for names(name, n). Names with one key take the most used, then shortest, then first form; names without a key are left out."""
    keyed = names.withColumn("key", entity_key(F.col("name"))).filter("key <> ''")
    best = F.min_by("name", F.struct((-F.col("n")).alias("a"), F.length("name").alias("b"), F.col("name").alias("c"))).alias("canonical")
    return keyed.join(keyed.groupBy("key").agg(best), "key").select("name", "canonical")


def root_merged(mapping: DataFrame, least: int = 4) -> DataFrame:
    """Canonical names with one root (the first word, or the whole if that is shorter than `least`) take the shortest of them."""
    word = F.substring_index("canonical", " ", 1)
    root = F.when(F.length(word) >= least, word).otherwise(F.col("canonical"))
    rooted = mapping.withColumn("root", root)
    best = F.min_by("canonical", F.struct(F.length("canonical").alias("a"), F.col("canonical").alias("b"))).alias("short")
    shortest = rooted.filter(F.length("root") >= least).groupBy("root").agg(best)
    return rooted.join(shortest, "root", "left").select("name", F.coalesce("short", "canonical").alias("canonical"))


def renamed(triples: DataFrame, mapping: DataFrame) -> DataFrame:
    """Both ends by the mapping (name, canonical); ends that it lacks stay as they are."""
    out = triples
    for c in ("s", "o"):
        m = mapping.select(F.col("name").alias("__name"), F.col("canonical").alias("__canonical"))
        out = out.join(m, F.lower(F.col(c)) == F.col("__name"), "left").withColumn(c, F.coalesce("__canonical", c)).drop("__name", "__canonical")
    return out


def resolve(triples: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Triples with canonical entities. overrides(name, canonical), such as a model's groups, come first."""
    mapping = root_merged(canonical_names(uses(triples)))
    if overrides is not None:
        given = overrides.select(F.col("name").alias("__name"), F.col("canonical").alias("__given"))
        mapping = mapping.join(given, F.col("name") == F.col("__name"), "full_outer").select(F.coalesce("name", "__name").alias("name"), F.coalesce("__given", "canonical").alias("canonical"))
    return renamed(triples, mapping)


def merge_nodes(nodes: DataFrame, edges: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """pairs(source, target): source nodes go into their targets.

    nodes(id, props): a target keeps its own values and gains the source's others, with the ids merged into it in
    `merged_from`. edges(src, dst, type, seq): ends move to the target, edges between the two go, and of equal edges
    the first stays.
    """
    moved = nodes.join(pairs, F.col("id") == F.col("source"))
    gained = moved.groupBy("target").agg(F.collect_list(F.struct("source", "props")).alias("g"))
    joined = F.aggregate("g", F.create_map().cast("map<string,string>"), lambda acc, x: F.map_concat(acc, F.map_filter(x["props"], lambda k, _: ~F.array_contains(F.map_keys(acc), k))))
    gained = gained.withColumn("g", F.array_sort("g", lambda a, b: F.when(a["source"] < b["source"], -1).when(a["source"] > b["source"], 1).otherwise(0)))
    gained = gained.select(F.col("target").alias("__t"), joined.alias("__more"), F.array_join(F.transform("g", lambda x: x["source"].cast("string")), ",").alias("merged_from"))
    kept = nodes.join(pairs.select(F.col("source").alias("id")), "id", "left_anti").join(gained, F.col("id") == F.col("__t"), "left")
    more = F.map_filter("__more", lambda k, _: ~F.array_contains(F.map_keys("props"), k))
    new_nodes = kept.select("id", F.when(F.col("__more").isNull(), F.col("props")).otherwise(F.map_concat("props", more)).alias("props"), "merged_from")
    out = edges
    for c in ("src", "dst"):
        m = pairs.select(F.col("source").alias("__s"), F.col("target").alias("__t"))
        out = out.join(m, F.col(c) == F.col("__s"), "left").withColumn(c, F.coalesce("__t", c)).withColumn(f"__{c}", F.col("__s").isNotNull()).drop("__s", "__t")
    out = out.filter(~((F.col("__src") | F.col("__dst")) & (F.col("src") == F.col("dst")))).drop("__src", "__dst")
    return new_nodes, first_per(out, ["src", "dst", "type"], F.col("seq"))
