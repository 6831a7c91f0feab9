"""How far the sources of a language differ in their words: wide term vectors, contributions of pairs, exact sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from subjectlens.llm.shared import need, read, salted_join, stash, text_of

#: What stands between terms.
OTHER = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: A language keeps terms that so many of its documents hold.
LEAST_DOCUMENTS = 10
#: Added to each count, and the whole to which shares are scaled.
PRIOR, SCALE = 2, 1_000_000_000
#: Terms reported for each source.
TOP_TERMS = 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    """A-Z in lower case, nothing else; the quick built-in does it where all is ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, d): occurrences, and rows that hold the term, added up within tasks before the shuffle.

    A row's terms are laid out twice, all of them and each of them once.
    """
    terms = docs.select("lang", "source", F.split(lowered(F.col("text")), OTHER).alias("all"))
    twice = F.array(F.struct(F.lit(False).alias("once"), F.col("all").alias("terms")), F.struct(F.lit(True).alias("once"), F.array_distinct("all").alias("terms")))
    each = terms.select("lang", "source", F.explode(twice).alias("x")).select("lang", "source", "x.once", F.explode("x.terms").alias("term"))
    return each.filter("term <> ''").groupBy("lang", "source", "term").agg(F.count_if(~F.col("once")).alias("n"), F.count_if("once").alias("d"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * terms)), exactly: in longs where they hold it, else in decimals."""
    top, below = count + PRIOR, total + PRIOR * terms
    wide = F.call_function("div", top.cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)"), below.cast("decimal(20,0)"))
    return 1 + F.when(top <= (1 << 62) // SCALE, F.call_function("div", top * SCALE, below)).otherwise(wide)


def _gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); shares are at most SCALE + 1, so longs hold it."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """Rows (lang, source, part, item, value, rank) for docs(text, lang, source).

    `pair`: for each source of a language, each other source and the sum over all kept terms of floor((p-q)^2 / (p+q)),
    p and q their shares of the term. `term`: the source's terms that stand out most against the whole language.

    Counts become one row for each kept term with an array over the language's sources. Higher-order functions turn it
    into shares and into the contributions of all pairs of sources, which are summed within tasks first, so what is
    shuffled is pairs a task at most. Terms are spread by hash; the sources of a language meet its terms in a join that
    deals large languages out in pieces. The best terms are cut to `top` a source within each task before the shuffle. A
    term's array and a source's list of others are as long as the language has sources, as the result is.

    Null text, lang and source count as empty strings; a source without terms has shares of the prior alone, a language
    without kept terms has pairs of value 0, a language of one source has no pairs. Rows that repeat an id are documents
    of their own. Ties rank by item. An empty table gives an empty result; further columns are ignored.
    """
    docs = need(docs, "text", "lang", "source").select(text_of("text").alias("text"), text_of("lang").alias("lang"), text_of("source").alias("source"))
    counts = stash(term_counts(docs), "divergence-counts")
    entry = F.collect_list(F.struct("source", "n"))
    kept = stash(counts.groupBy("lang", "term").agg(F.sum("d").alias("d"), F.map_from_entries(entry).alias("by_source")).filter(F.col("d") >= least).drop("d"), "divergence-terms")

    used = kept.select("lang", F.explode("by_source").alias("source", "n")).groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sources = docs.select("lang", "source").distinct().join(used, ["lang", "source"], "left")
    sized = sources.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", F.coalesce("total", F.lit(0)).alias("total")))).alias("sources"))
    langs = stash(sized.join(kept.groupBy("lang").agg(F.count("*").alias("terms")), "lang", "left").withColumn("terms", F.coalesce("terms", F.lit(0))), "divergence-langs")

    size = langs.agg(F.sum("terms")).first()[0] or 0
    wide = salted_join(kept, langs, ["lang"], ["term"], "terms", size)
    count = F.transform("sources", lambda s: F.coalesce(F.try_element_at("by_source", s["source"]), F.lit(0)))
    wide = wide.withColumn("counts", count)
    vectors = wide.select(
        "lang", "term", "sources", "counts",
        F.transform("sources", lambda s, i: share(F.get("counts", i), s["total"], F.col("terms"))).alias("p"),
        share(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x), F.aggregate("sources", F.lit(0).cast("long"), lambda a, s: a + s["total"]), F.col("terms")).alias("q"),
    )
    vectors = stash(vectors, "divergence-vectors")

    later = lambda i: F.slice("p", i + 2, F.size("p"))
    given = F.flatten(F.transform("p", lambda p, i: F.transform(later(i), lambda q, j: F.struct(i.alias("i"), (i + 1 + j).alias("j"), _gap(p, q).alias("f")))))
    half = vectors.select("lang", F.explode(given).alias("x")).groupBy("lang", "x.i", "x.j").agg(F.sum("x.f").alias("value"))
    sums = half.select("lang", "i", "j", "value").union(half.select("lang", F.col("j"), F.col("i"), "value"))
    named = langs.select("lang", "sources", F.posexplode("sources").alias("i", "s")).select("lang", "i", F.col("s.source").alias("source"), F.posexplode("sources").alias("j", "other")).filter("i <> j")
    pairs = named.join(sums, ["lang", "i", "j"], "left").select("lang", "source", F.lit("pair").alias("part"), F.col("other.source").alias("item"), F.coalesce("value", F.lit(0)).cast("long").alias("value"))

    above = F.filter(
        F.transform("p", lambda p, i: F.struct(F.get("sources", i)["source"].alias("source"), F.get("counts", i).alias("n"), p.alias("p"))),
        lambda x: (x["n"] > 0) & (x["p"] > F.col("q")),
    )
    stands = vectors.select("lang", "term", "q", F.explode(above).alias("x")).select("lang", "x.source", F.lit("term").alias("part"), F.col("term").alias("item"), _gap(F.col("x.p"), F.col("q")).alias("value"))

    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = pairs.withColumn("rank", F.row_number().over(order))
    best = stands.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.unionByName(best)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(read(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), w AS (SELECT row_id, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT row_id) >= 10),
size AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT lang, source, term, count(*) AS c FROM w JOIN kept USING (lang, term) GROUP BY ALL),
total AS (SELECT lang, source, sum(c) AS t FROM n GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(n.c, 0) AS c,
         (1 + (1000000000::HUGEINT * (coalesce(n.c, 0) + 2)) // (coalesce(t.t, 0)::HUGEINT + 2 * size.v)) AS p
  FROM groups g JOIN kept k USING (lang) JOIN size USING (lang)
  LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term
  LEFT JOIN total t ON t.lang = g.lang AND t.source = g.source
), q AS (
  SELECT lang, term, (1 + (1000000000::HUGEINT * (sum(c)::HUGEINT + 2)) // (sum(sum(c)) OVER (PARTITION BY lang)::HUGEINT + 2 * any_value(v))) AS q
  FROM p JOIN size USING (lang) GROUP BY lang, term
), pair AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), every AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pair x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
), term AS (
  SELECT lang, source, 'term' AS part, term AS item, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) AS value
  FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q
)
SELECT lang, source, part, item, value, CAST(rank AS INT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM every UNION ALL SELECT * FROM term))
WHERE part = 'pair' OR rank <= 10
"""
