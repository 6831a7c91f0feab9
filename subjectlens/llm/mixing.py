"""Mixing sources to target weights along a time-varying curriculum."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from subjectlens.llm.shared import need, read, stash, text_of

#: The longest use of a document, in times its size.
MOST_REPEATS = 3
#: Weights of the sources in code-point order, null last, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Schedule of each weight as (time, factor) knots over [0, 1]: heavy sources fade out, light ones grow; each integrates to 1.
RAMPS = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))
#: About so many documents share one bucket of the running sum.
BUCKET_ROWS = 1000


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def cycled_schedule(rank: Column, weights=WEIGHTS, ramps=RAMPS) -> Column:
    """Knots (t, w) of the source with this rank (0, 1, ...)."""
    n = len(weights)
    choices = [F.array(*[F.struct(F.lit(t).alias("t"), F.lit(w * f).alias("w")) for t, f in ramp]) for w, ramp in zip(weights, ramps, strict=True)]
    out = choices[-1]
    for i in range(n - 2, -1, -1):
        out = F.when(rank % n == i, choices[i]).otherwise(out)
    return out


def _segments(knots: Column) -> Column:
    """Of the piecewise linear schedule: start, length, weights at both ends, and the area before each segment."""
    pieces = F.transform(
        F.sequence(F.lit(1), F.size(knots) - 1),
        lambda i: F.struct(
            F.element_at(knots, i)["t"].alias("t"),
            (F.element_at(knots, i + 1)["t"] - F.element_at(knots, i)["t"]).alias("d"),
            F.element_at(knots, i)["w"].alias("w0"),
            F.element_at(knots, i + 1)["w"].alias("w1"),
        ),
    )
    area = lambda s: (s["w0"] + s["w1"]) / 2.0 * s["d"]
    return F.transform(
        pieces,
        lambda s, i: F.struct(
            s["t"].alias("t"), s["d"].alias("d"), s["w0"].alias("w0"), s["w1"].alias("w1"),
            F.aggregate(F.slice(pieces, F.lit(1), i), F.lit(0.0), lambda a, x: a + area(x)).alias("before"),
            area(s).alias("area"),
        ),
    )


def _time_at(segments: Column, weight: Column, share: Column) -> Column:
    """The time by which this share of the schedule's whole integral has been demanded."""
    want = share * weight
    s = F.element_at(F.filter(segments, lambda x: (x["before"] <= want) | (x["before"] == 0.0)), -1)
    need_ = F.least(want - s["before"], s["area"])
    slope = (s["w1"] - s["w0"]) / s["d"]
    return s["t"] + 2.0 * need_ / (s["w0"] + F.sqrt(F.greatest(s["w0"] * s["w0"] + 2.0 * slope * need_, F.lit(0.0))))


def targets(sizes: DataFrame, schedule=cycled_schedule) -> DataFrame:
    """Per source of sizes(source, size): its size, weight (the schedule's integral), target and schedule segments.

    Sources share the whole size by weight; a target stops at MOST_REPEATS times its source's size and the excess is
    shared by weight among the others until none is above: the water level is found with one sorted pass.
    """
    every = W.partitionBy()
    by_name = W.orderBy(F.col("source").isNull(), "source")
    by_ratio = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    out = (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("segments", _segments(schedule(F.row_number().over(by_name) - 1)))
        .withColumn("weight", F.aggregate("segments", F.lit(0.0), lambda a, s: a + s["area"]))
        .withColumn("cap", F.col("source_size") * MOST_REPEATS)
        .withColumn("filled", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("rest", F.sum("weight").over(by_ratio.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("level", (F.sum("source_size").over(every) - F.col("filled")).cast("double") / F.col("rest"))
        .withColumn("level", F.max(F.when(F.col("level") * F.col("weight") < F.col("cap"), F.col("level"))).over(every))
    )
    return out.select("source", "source_size", "weight", "segments", F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap").cast("double"))).alias("target"))


def mix(docs: DataFrame, schedule=cycled_schedule, row: str | None = None) -> DataFrame:
    """One row per row of docs(doc_id, text, source): what the mix takes of it and when.

    doc_id, size (words), source_size, target, taken (words, repeats counted), position (training time in [0, 1] of its
    first use, null if unused), positions (of each use), sorted by position over range partitions unless `row` is given.

    A source's documents line up by a hash of their id and text and are used in turn, again and again, until its target is met;
    the last one used is cut there, so the source gives its rounded target exactly. The line is cut into buckets by a
    prefix of that hash: bucket sums are added up first, then documents inside each bucket, so a source of any size is
    spread over tasks. The n-th word demanded of a source is due at the time when its schedule's integral reaches
    n / target.

    A null source is a source of its own, after all others; null or empty text has size 0 and takes 0; rows that repeat
    an id, or have none, stand in the line by their texts, each with uses of its own; an empty table gives an empty
    result; further columns are ignored. Reruns agree. row: a column to hand on, such as a row's number.
    """
    kept = [F.col(f"`{row}`").alias("row")] if row else []
    docs = docs.select(*need(docs, "doc_id", "text", "source").columns, *kept)
    digits = max(0, math.ceil(math.log(max(1, docs.count() / BUCKET_ROWS), 16)))
    line = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(text_of())))
    sizes = stash(docs.select("doc_id", "source", word_count(text_of()).alias("size"), line.alias("line"), *["row"] * bool(row)), "mix-sizes")
    sizes = sizes.withColumn("bucket", F.substring("line", 1, digits)).withColumn("key", F.when(F.col("source").isNull(), "0").otherwise(F.concat(F.lit("1"), "source")))
    goal = targets(sizes, schedule).withColumn("key", F.when(F.col("source").isNull(), "0").otherwise(F.concat(F.lit("1"), "source"))).drop("source")
    goal = goal.withColumn("words", F.floor(F.col("target") + 0.5).cast("long"))
    before = (
        sizes.groupBy("key", "bucket")
        .agg(F.sum("size").alias("s"))
        .withColumn("bucket_start", F.coalesce(F.sum("s").over(W.partitionBy("key").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .drop("s")
        .join(goal, "key")
    )
    inside = W.partitionBy("key", "bucket").orderBy("line", F.col("doc_id"), "size").rowsBetween(W.unboundedPreceding, -1)
    out = (
        sizes.withColumn("ahead", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(before, ["key", "bucket"])
        .withColumn("at", F.col("ahead") + F.col("bucket_start"))
        .withColumn("rounds", F.when(F.col("source_size") > 0, F.expr("words div source_size")).otherwise(F.lit(0)))
        .withColumn("last", F.greatest(F.lit(0), F.least("size", F.col("words") - F.col("rounds") * F.col("source_size") - F.col("at"))))
        .withColumn("taken", F.when(F.col("size") > 0, F.col("rounds") * F.col("size") + F.col("last")).otherwise(F.lit(0)).cast("long"))
        .withColumn("uses", F.when(F.col("size") > 0, F.col("rounds") + (F.col("last") > 0).cast("long")).otherwise(F.lit(0)))
    )
    due = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("uses") - 1),
        lambda j: F.round(_time_at(F.col("segments"), F.col("weight"), (j * F.col("source_size") + F.col("at")).cast("double") / F.col("words")), 9),
    )
    out = out.withColumn("positions", F.when(F.col("uses") > 0, due).otherwise(F.array().cast("array<double>"))).withColumn("position", F.get("positions", F.lit(0)))
    out = out.select("doc_id", "size", "source_size", "target", "taken", "position", "positions", *["row"] * bool(row))
    if row:  # for a join, which has no order
        return out
    return out.orderBy(F.col("position").asc_nulls_last(), "doc_id")


def mixed_documents(docs: DataFrame, schedule=cycled_schedule, ordered: bool = True) -> DataFrame:
    """The rows of docs as the mix uses them: one row per use, with all columns of docs, in training order or, if not `ordered`, in any.

    Documents that the mix leaves out go. A last use that stops inside a document counts if it holds half of it or more,
    so texts stay whole. Rows are numbered and written once, and joined to their uses by number: rows that repeat an id,
    or have none, have uses of their own. Null and empty texts, which have no words, are never used. An empty table gives
    an empty result; columns may have any names.
    """
    own = "row"
    while own in docs.columns:
        own = f"_{own}"
    rows = stash(docs.withColumn(own, F.monotonically_increasing_id()), "mix-rows")
    plan = mix(rows, schedule, own).filter("taken > 0").withColumn("whole", F.expr("coalesce(taken div nullif(size, 0) + cast((taken % nullif(size, 0)) * 2 >= size as int), 0)")).filter("whole > 0")
    uses = plan.select(F.col("row").alias("used_row"), F.expr("slice(positions, 1, cast(whole as int))").alias("due"))
    met = rows.join(uses, rows[own] == uses["used_row"])
    out = met.select(*[rows[f"`{c}`"] for c in docs.columns], F.explode(uses["due"]).alias(f"{own}_at"), rows[own])
    if not ordered:  # the texts move once, for the join
        return out.select(*[f"`{c}`" for c in docs.columns])
    return out.orderBy(f"{own}_at", own).select(*[f"`{c}`" for c in docs.columns])


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).drop("positions")


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))) AS line
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS kind
  FROM d GROUP BY source
), w AS (
  SELECT *, CASE kind WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
         CASE kind WHEN 0 THEN 7.5::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 0.5::DOUBLE END AS w0,
         CASE kind WHEN 0 THEN 2.5::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.5::DOUBLE END AS w1,
         source_size * 3 AS cap FROM s
), v AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
         / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv
  FROM w
), t AS (
  SELECT *, least(CAST(cap AS DOUBLE), coalesce(max(CASE WHEN lv * weight < cap THEN lv END) OVER () * weight, CAST(cap AS DOUBLE))) AS target FROM v
), g AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS words FROM t),
a AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, g.words, g.weight, g.w0, g.w1,
         CASE WHEN g.source_size > 0 THEN g.words // g.source_size ELSE 0 END AS rounds,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.line, d.doc_id, d.size
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ahead
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
), b AS (SELECT *, greatest(0, least(size, words - rounds * source_size - ahead)) AS tail FROM a),
c AS (SELECT *, ahead::DOUBLE / words * weight AS need FROM b)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN size > 0 THEN rounds * size + tail ELSE 0 END AS BIGINT) AS taken,
       CASE WHEN size > 0 AND rounds + CAST(tail > 0 AS BIGINT) > 0
            THEN round(2.0 * need / (w0 + sqrt(greatest(w0 * w0 + 2.0 * (w1 - w0) * need, 0.0))), 9) END AS position
FROM c
"""
