"""Exact deduplication: group by a 128-bit content hash, keep the smallest id, compare bytes inside groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from subjectlens.llm.shared import need, read, salted_join, stash, text_of

#: Bits of the map of repeated hashes: at most SLOTS / 64 rows of two longs (16 MB) are broadcast at any input size.
SLOTS = 1 << 24


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; runs that are one space already need no change."""
    return F.regexp_replace(text, r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def content_hash(text: Column) -> Column:
    """128 bits."""
    return F.unhex(F.md5(text))


def exact_dedup(docs: DataFrame, hash128: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their normalised bytes are; null counts as empty. Hashes find the groups with partial
    aggregation, and large groups are joined in pieces, so a group of any size is spread over tasks. Then the bytes of every repeated row are compared with
    those of the row that stays; rows that only share the hash form groups of their own. Text is moved for repeated
    rows only: a fixed-size bit map of repeated hashes is broadcast and filters the second scan.

    A null doc_id counts as larger than any other. Of rows that repeat both id and text, one is kept. An empty table
    gives an empty result. Further columns are ignored.
    """
    docs = need(docs, "doc_id", "text")
    whole = docs.select("doc_id", normalised(text_of()).alias("body")).withColumn("h", hash128(F.col("body")))
    rows = stash(whole.groupBy("h", F.sha2("body", 256).alias("sha"), "doc_id").agg(F.count("*").alias("c")), "dedup-rows")
    group = rows.groupBy("h").agg(F.sum("c").alias("n"))
    repeated = stash(group.filter("n > 1").select("h"), "dedup-repeated")
    total = rows.agg(F.sum("c")).first()[0] or 0

    slot = F.pmod(F.xxhash64("h"), F.lit(SLOTS))
    one = F.lit(1).cast("long")
    bits = repeated.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(xxhash64(h), {SLOTS}L) & 63 as int))")).alias("bits"))
    suspects = (
        whole.withColumn("slot", slot)
        .join(F.broadcast(bits), F.shiftright("slot", 6) == F.col("word"))
        .filter(F.expr("shiftrightunsigned(bits, cast(slot & 63 as int))").bitwiseAND(one) == 1)
        .select("doc_id", "body", "h")
    )
    suspects = stash(suspects, "dedup-suspects")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "body")).alias("first")
    stays = suspects.groupBy("h").agg(first, F.count("*").alias("n")).select("h", F.col("first.body").alias("reference"), "n")
    odd = (
        salted_join(suspects, stays, ["h"], ["doc_id"], "n", total)
        .filter(F.col("body") != F.col("reference"))
        .select("h", F.sha2("body", 256).alias("sha"))
        .distinct()
        .withColumn("variant", F.col("sha"))
    )
    odd = stash(odd, "dedup-odd")
    if odd.isEmpty():  # no two texts share a hash, as a rule: nothing to look up
        rows = rows.withColumn("variant", F.lit(""))
    else:
        rows = rows.join(odd, ["h", "sha"], "left").withColumn("variant", F.coalesce("variant", F.lit("")))
    final = rows.groupBy("h", "variant").agg(F.min("doc_id").alias("keep_id"), F.sum("c").alias("group_size"), F.count("*").alias("n"))
    return (
        salted_join(rows, final, ["h", "variant"], ["doc_id"], "n", total)
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("c").cast("int"))))
        .select(
            "doc_id",
            "keep_id",
            F.col("group_size").cast("long").alias("group_size"),
            (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
            F.col("sha").alias("text_sha256"),
        )
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id) = 1 AS kept, text_sha256
FROM n WINDOW g AS (PARTITION BY text_sha256)
"""
