"""Chat formatting as a prefix tree: shared initial turns are written once, depth first, with position ids and attention intervals."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from subjectlens.llm.shared import need, read, salted_join, stash, text_of

#: Control strings. All begin with "<|"; escaped text never holds "<|".
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
LEARNT = "assistant"
#: Turns of a conversation are added up in buckets of so many turn numbers.
BUCKET = 64
_NO_ID = -(1 << 63)
_PIECE = re.compile(r"<\|turn\|>(.*?)<\|text\|>(.*)<\|end\|>", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def piece(role: Column, text: Column) -> Column:
    """A turn as it is written."""
    return F.concat(F.lit(TURN), escaped(role), F.lit(TEXT), escaped(text), F.lit(END))


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv, k, piece, n, lead, learnt, pos, p1, p2) per turn.

    k counts a conversation's turns from 0 by turn number, nulls last, ties by role and text. pos is where the turn
    starts in its conversation, in code points. (p1, p2, k) names the prefix that ends with the turn: the exclusive or
    of 128-bit hashes of each turn with its place. Running values are added up by bucket first, so a conversation of
    any length is spread over tasks.
    """
    rows = need(conversations, "conv_id", "turn", "role", "text").select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(_NO_ID)).alias("conv"),
        F.coalesce(F.col("turn").cast("long"), F.lit((1 << 63) - 1)).alias("turn"),
        text_of("role").alias("role"),
        text_of().alias("text"),
    )
    rows = rows.withColumn("bucket", F.floor(F.col("turn") / BUCKET)).withColumn("piece", piece(F.col("role"), F.col("text"))).withColumn("n", F.length("piece").cast("long"))
    rows = rows.withColumn("lead", F.length(escaped(F.col("role"))) + len(TURN) + len(TEXT)).withColumn("learnt", F.col("role") == LEARNT)
    inside = W.partitionBy("conv", "bucket").orderBy("turn", "role", "text")
    ahead = W.partitionBy("conv").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sizes = rows.groupBy("conv", "bucket").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    sizes = sizes.select("conv", "bucket", F.coalesce(F.sum("c").over(ahead), F.lit(0)).alias("k0"), F.coalesce(F.sum("s").over(ahead), F.lit(0)).alias("s0"))
    rows = rows.withColumn("i", F.row_number().over(inside) - 1).withColumn("s", F.sum("n").over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.col("n"))
    rows = rows.join(sizes, ["conv", "bucket"]).withColumn("k", F.col("k0") + F.col("i")).withColumn("pos", F.col("s0") + F.col("s"))
    rows = stash(rows.select("conv", "bucket", "k", "pos", "piece", "n", "lead", "learnt", F.xxhash64(F.lit(1), "k", "piece").alias("h1"), F.xxhash64(F.lit(2), "piece", "k").alias("h2")), "chat-turns")
    upto = W.partitionBy("conv", "bucket").orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    marks = rows.groupBy("conv", "bucket").agg(F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2"))
    marks = marks.select("conv", "bucket", *[F.coalesce(F.bit_xor(f"x{j}").over(ahead), F.lit(0)).cast("long").alias(f"b{j}") for j in (1, 2)])
    out = rows.withColumn("w1", F.bit_xor("h1").over(upto)).withColumn("w2", F.bit_xor("h2").over(upto)).join(marks, ["conv", "bucket"])
    return out.select("conv", "k", "pos", "piece", "n", "lead", "learnt", *[F.col(f"w{j}").bitwiseXOR(F.col(f"b{j}")).alias(f"p{j}") for j in (1, 2)])


def packed_offsets(runs: DataFrame) -> DataFrame:
    """(run, offset) for runs(run, key, size) laid end to end in key order: running sums over range partitions."""
    n = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = runs.repartitionByRange(n, "key").withColumn("part", F.spark_partition_id())
    placed = stash(placed, "chat-runs")
    starts = placed.groupBy("part").agg(F.sum("size").alias("s"))
    starts = starts.select("part", F.coalesce(F.sum("s").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("s0"))
    inside = W.partitionBy("part").orderBy("key").rowsBetween(W.unboundedPreceding, -1)
    return placed.withColumn("s", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(starts, "part").select("run", (F.col("s0") + F.col("s")).alias("offset"))


def chat_tree(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Writes the tree of conversations(conv_id, turn, role, text): (nodes, members), both kept in the shared folder.

    nodes has a row per distinct prefix, in depth-first order of `start`: run, k, start (in the packed output), length,
    position (id of its first code point along its conversation), attention (packed intervals of all that comes before
    it on its path; adjoining ones are one), piece, loss_start and loss_end (the learnt part of piece, null if none).
    members has a row per turn of a conversation: conv, k and the run whose node it is.

    A node belongs to the smallest conversation with its prefix; the nodes of one conversation form a run, which goes
    straight down the tree. A run's sort key is the list of branchings above it, deepest branch first, which orders
    runs depth first. Attention intervals are runs' first parts, one for each branching, so they stay short. Nothing
    but a sort, joins and aggregates with partial sums looks at a shared prefix, and one that very many conversations
    share is joined in pieces.

    Null text or role counts as empty; a null conv_id is a conversation of its own; a null turn comes last; rows that
    repeat conversation and turn follow each other by role and text; an empty table gives empty tables.
    """
    turns = stash(turns_of(conversations), "chat-prefixes")
    owner = turns.groupBy("p1", "p2", "k").agg(F.min("conv").alias("run"), F.count("*").alias("shared"))
    placed = salted_join(turns.drop("piece", "lead", "learnt"), owner, ["p1", "p2", "k"], ["conv"], "shared", turns.count())
    members = stash(placed.select("conv", "k", "run", "pos", "n"), "chat-members")
    segments = stash(members.groupBy("conv", "run").agg(F.min("k").alias("branch"), F.min("pos").alias("from"), F.sum("n").alias("size")), "chat-segments")
    own = segments.filter("conv = run").select("run", "from", "size")
    key = F.transform(F.array_sort(F.collect_list(F.struct("branch", "run"))), lambda s: F.struct((-s["branch"]).alias("b"), s["run"].alias("r")))
    keys = segments.groupBy("conv").agg(key.alias("key"))
    offsets = stash(packed_offsets(own.join(keys.withColumnRenamed("conv", "run"), "run").select("run", "key", "size")), "chat-offsets")
    above = segments.join(own.select(F.col("run").alias("conv")), "conv").join(offsets, "run").groupBy("conv")
    spans = above.agg(F.array_sort(F.collect_list(F.when(F.col("run") != F.col("conv"), F.struct("offset", (F.col("offset") + F.col("size")).alias("end"))))).alias("spans"), F.max(F.when(F.col("run") == F.col("conv"), F.col("from"))).alias("from"))
    spans = spans.withColumnRenamed("conv", "run").join(offsets, "run")
    mine = turns.join(members.filter("conv = run").select("conv", "k", "run"), ["conv", "k"])
    start = F.col("offset") + F.col("pos") - F.col("from")
    before = F.when(start > F.col("offset"), F.concat("spans", F.array(F.struct("offset", start.alias("end"))))).otherwise(F.col("spans"))
    nothing = F.expr("cast(array() as array<struct<offset:bigint,end:bigint>>)")
    joined = F.aggregate(
        before,
        nothing,
        lambda acc, x: F.when((F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["end"] == x["offset"]), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(F.get(acc, F.size(acc) - 1)["offset"].alias("offset"), x["end"].alias("end"))))).otherwise(F.concat(acc, F.array(x))),
    )
    loss = lambda c: F.when(F.col("learnt"), c)
    nodes = mine.join(spans, "run").select(
        "run", "k", start.alias("start"), F.col("n").alias("length"), F.col("pos").alias("position"), joined.alias("attention"), "piece",
        loss(F.col("lead")).cast("long").alias("loss_start"), loss(F.col("n") - len(END)).cast("long").alias("loss_end"),
    )
    return stash(nodes.orderBy("start"), "chat-nodes"), members.select("conv", "k", "run")


def conversations_from(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """(conv_id, turns) read back is conv_digest's input: (conv, k, piece, loss_start, loss_end) with each node at its members."""
    return members.join(nodes.select("run", "k", "piece", "loss_start", "loss_end"), ["run", "k"]).select("conv", "k", "piece", "loss_start", "loss_end")


def conversation_digests(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """Per conversation, from the written tree: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Turns of a conversation pass through one task in order and are hashed as they come, so its length takes no memory.
    """
    rows = conversations_from(nodes, members)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    typed = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done = None, None, []

        def close():
            if state is not None:
                done.append((None if now == _NO_ID else now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        for b in batches:
            for conv, _, text, a, e in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if state is None or conv != now:
                    close()
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                if not (m := _PIECE.fullmatch(text)):
                    raise ValueError(f"conversation {conv}: damaged turn")
                state[0] += 1
                state[1].update(f"{unescaped(m[1])}\n{unescaped(m[2])}\n".encode("utf-8", "surrogatepass"))
                if a is not None:
                    learnt = unescaped(text[a:e])
                    state[2] += len(learnt)
                    state[3].update(learnt.encode("utf-8", "surrogatepass"))
                state[4] += len(text)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), typed.types, strict=True)], schema=typed)
                done.clear()
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), typed.types, strict=True)], schema=typed)

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return rows.repartition(n, "conv").sortWithinPartitions("conv", "k").mapInArrow(run, schema)


def op8_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = need(read(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return conversation_digests(*chat_tree(rows.unionByName(more)))


OP8_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), n AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         len('<|turn|><|text|><|end|>') + len(replace(replace(coalesce(role, ''), '\', '\\'), '<|', '<\|'))
         + len(replace(replace(coalesce(text, ''), '\', '\\'), '<|', '<\|')) AS chars
  FROM c
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN len(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM n GROUP BY conv_id
"""
