"""Log-likelihood of whole documents under a gated recurrent model learnt from the corpus, beside a unigram base."""

from __future__ import annotations

import itertools
import math
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from subjectlens.llm import gru
from subjectlens.llm.shared import by_bytes, need, read, stash, text_of

#: Documents with crc32(id) mod FOLDS equal to HELD_OUT are not learnt from.
FOLDS, HELD_OUT = 7, 2
#: Words with an output of their own; the most words whose counts every worker holds (rarer ones are looked up by a join).
WORDS, DICTIONARY = 1024, 262_144
#: Models averaged in one step; shards that train a model each: SHARDS, unless they would have fewer or more tokens than this.
FAN_IN, SHARDS, LEAST_SHARD, MOST_SHARD = 64, 64, 1_000_000, 16_000_000
#: Text bytes that are tokenised, and tokens that are scored, at once.
TEXT_BYTES, TOKENS = 16 << 20, 4_000_000
END = "\n"  # no word holds white space, so the end can be counted beside the words


def shape(word: str) -> int:
    """0 to 5: whether a word has non-ASCII characters, and whether it ends in stops, in other marks or in neither."""
    last = word[-1]
    return 3 * (not word.isascii()) + (0 if last.isalnum() else 1 if last in ".,;:!?" else 2)


SHAPES = 6


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(text, word, distinct words): for each word of the texts, in order, the text and the word by number.

    Words stand between ASCII white space, A-Z in lower case.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts).cast(pa.large_string()))  # in this order: a cast slice is lowered wrongly
    coded = lists.flatten().dictionary_encode()
    word, distinct = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
    text = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    if "" in distinct:  # before and after white space at the ends
        kept = word != distinct.index("")
        word, text = word[kept], text[kept]
    return text, word, distinct


class Base(NamedTuple):
    """What scoring needs of the corpus: all of bounded size."""

    tokens: int  # N
    types: int  # V
    words: list[str]  # the dictionary, most frequent first
    counts: np.ndarray
    group_tokens: np.ndarray  # by group: SHAPES of dictionary words that have no output, SHAPES of all other words
    group_types: np.ndarray
    ends: int

    def layout(self) -> gru.Layout:
        return gru.Layout(min(WORDS, len(self.words)), 2 * SHAPES)

    def symbol_counts(self) -> np.ndarray:
        return np.r_[self.counts[: WORDS], self.ends, self.group_tokens + self.group_types * (np.arange(2 * SHAPES) >= SHAPES)].astype(float)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def word_counts(docs: DataFrame) -> DataFrame:
    """(w, s, c): each word of docs(text) with its shape and count, and the end with the number of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in by_bytes(b, 0, TEXT_BYTES):
                _, word, distinct = split_words(part.column(0))
                counts = np.bincount(word, minlength=len(distinct))
                used = np.flatnonzero(counts)
                words = [distinct[k] for k in used.tolist()]
                kind = [shape(w) for w in words]
                yield pa.RecordBatch.from_arrays([pa.array([*words, END], pa.string()), pa.array([*kind, -1], pa.int32()), pa.array([*counts[used].tolist(), part.num_rows], pa.int64())], names=["w", "s", "c"])

    return docs.select(text_of().alias("text")).mapInArrow(run, "w string, s int, c long").groupBy("w", "s").agg(F.sum("c").alias("c"))


def base_of(counts: DataFrame) -> Base:
    """Totals, dictionary and groups. The dictionary holds all words that are frequent enough for it to have DICTIONARY words at most."""
    words = counts.filter(F.col("s") >= 0)
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.sum(F.when(F.col("s") < 0, F.col("c"))).alias("e")).first()
    level = words.groupBy("c").agg(F.count("*").alias("n")).withColumn("m", F.sum("n").over(W.orderBy(F.desc("c")).rowsBetween(W.unboundedPreceding, 0)))
    least = level.filter(F.col("m") <= DICTIONARY).agg(F.min("c")).first()[0]
    known = words.filter(F.col("c") >= (least if least is not None else (1 << 62)))
    table = known.select("w", "s", "c").toArrow()  # at most DICTIONARY rows
    w, c, s = table["w"].to_pylist(), table["c"].to_numpy(), table["s"].to_numpy()
    order = sorted(range(len(w)), key=lambda k: (-int(c[k]), w[k]))
    c, s, w = (c[order], s[order], [w[k] for k in order]) if w else (np.zeros(0, np.int64), np.zeros(0, np.int32), [])
    tokens, types = np.zeros(2 * SHAPES, np.int64), np.zeros(2 * SHAPES, np.int64)
    tokens[:SHAPES] = np.bincount(s[WORDS:], c[WORDS:], SHAPES).astype(np.int64)
    types[:SHAPES] = np.bincount(s[WORDS:], minlength=SHAPES)
    for r in words.filter(F.col("c") < (least if least is not None else (1 << 62))).groupBy("s").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():
        tokens[SHAPES + r.s], types[SHAPES + r.s] = r.n, r.v
    types[SHAPES:] += 1  # a place for words that were never seen
    return Base(total.n or 0, total.v or 0, w, c, tokens, types, total.e or 0)


class Coder:
    """Texts as symbols, with the parts of both scores that need no model."""

    def __init__(self, base: Base):
        self.base, self.layout = base, base.layout()
        k = self.layout.words
        group = np.array([shape(w) for w in base.words[k:]], np.int64)
        self.place = {w: i for i, w in enumerate(base.words)}
        self.symbol = np.r_[np.arange(k), k + 1 + group].astype(np.int64)
        self.count = np.log10(base.counts + 1.0)
        self.inside = np.r_[np.zeros(k), np.log10(base.counts[k:]) - np.log10(np.maximum(base.group_tokens[group], 1))]
        self.end_count = math.log10(base.ends + 1.0)
        self.unit = math.log10(base.tokens + base.types + 1.0)
        self.tail = -np.log10(base.group_tokens[SHAPES:] + base.group_types[SHAPES:])

    def encode(self, texts: pa.Array) -> tuple:
        """For each text: symbols; tokens; known dictionary tokens; base score and inner score so far; words to look up with their number.

        Words to look up add log10(count + 1) to both scores.
        """
        n, (text, word, distinct) = len(texts), split_words(texts)
        place = np.fromiter((self.place.get(w, -1) for w in distinct), np.int64, len(distinct))
        unknown = np.flatnonzero(place < 0)
        kinds = np.array([shape(distinct[k]) if distinct[k] else 0 for k in unknown.tolist()], np.int64)
        symbol, count, inside = (np.zeros(len(distinct), x.dtype) for x in (self.symbol, self.count, self.inside))
        known = place >= 0
        for out, table in ((symbol, self.symbol), (count, self.count), (inside, self.inside)):
            out[known] = table[place[known]]
        symbol[unknown], inside[unknown] = self.layout.words + 1 + SHAPES + kinds, self.tail[kinds]
        size = np.bincount(text, minlength=n)
        ends = np.cumsum(size + 1)
        ids = np.full(int(ends[-1]) if n else 0, self.layout.end, "<u2")
        ids[np.arange(len(word)) + text] = symbol[word]
        data, cuts = ids.tobytes(), (2 * np.r_[0, ends]).tolist()
        new = ~known[word]
        pairs, times = np.unique(text[new] * max(1, len(distinct)) + word[new], return_counts=True)
        rare = pairs // max(1, len(distinct)), [distinct[k] for k in (pairs % max(1, len(distinct))).tolist()], times
        return (
            [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], size + 1, size - np.bincount(text[new], minlength=n) + (self.base.ends > 0),
            np.bincount(text, count[word], n) + self.end_count - self.unit * (size + 1), np.bincount(text, inside[word], n), rare,
        )


_coders: dict[str, Coder] = {}


def _coder(key: str, base) -> Coder:
    """A worker keeps the coder of its latest query."""
    if key not in _coders:
        _coders.clear()
        _coders[key] = Coder(base.value)
    return _coders[key]


def encoded(docs: DataFrame, base) -> DataFrame:
    """(doc_id, held_out, ids, n, known, base, inner, rare) per row of docs."""
    key = uuid.uuid4().hex
    typed = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("ids", pa.binary()), ("n", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("inner", pa.float64()), ("rare", pa.list_(pa.struct([("w", pa.string()), ("m", pa.int64())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(key, base)
        for b in batches:
            for part in by_bytes(b, 2, TEXT_BYTES // 2):
                ids, n, known, score, inner, (owner, words, times) = coder.encode(part.column(2))
                flat = pa.StructArray.from_arrays([pa.array(words, pa.string()), pa.array(times, pa.int64())], names=["w", "m"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(part.num_rows + 1)), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(ids, pa.binary()), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(score), pa.array(inner), lists], schema=typed)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), text_of().alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, ids binary, n long, known long, base double, inner double, rare array<struct<w:string,m:long>>")


def shards_for(tokens: int) -> int:
    """How many shards so many training tokens are cut into; nothing but the corpus decides."""
    return max(1, min(SHARDS, tokens // LEAST_SHARD), -(-tokens // MOST_SHARD))


def trained(table: DataFrame, base: Base) -> np.ndarray:
    """Weights: documents are dealt into shards by a hash of id and symbols, each shard trains on all symbols of its
    documents in the order of that hash, and the models are averaged by their size, FAN_IN at a time in the order of the
    shards.

    So the same corpus gives the same weights on any cluster, and what moves is symbols once and a model for each shard.
    """
    spark, layout = table.sparkSession, base.layout()
    flat = gru.initial(layout, base.symbol_counts())
    n = shards_for(base.tokens)
    now = spark.sparkContext.broadcast(flat)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((shard, np.frombuffer(data, "<u2").astype(np.int32)) for b in batches for shard, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        for shard, docs in itertools.groupby(rows, lambda r: r[0]):
            w, seen = gru.train(now.value, layout, (ids for _, ids in docs))
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([seen], pa.int64()), pa.array([w.tobytes()], pa.binary())], names=["shard", "n", "w"])

    place = F.xxhash64("doc_id", "ids")
    rows = table.filter(~F.col("held_out")).select(F.pmod(place, F.lit(n)).cast("int").alias("shard"), place.alias("place"), "ids")
    rows = rows.repartitionById(n, "shard").sortWithinPartitions("shard", "place", "ids").select(F.col("shard").cast("long").alias("shard"), "ids")
    models, left = stash(rows.mapInArrow(run, "shard long, n long, w binary"), "lm-models"), n
    while left > FAN_IN:
        models, left = stash(_averaged(models), "lm-models"), -(-left // FAN_IN)
    total, size = None, 0
    for r in models.orderBy("shard").toLocalIterator():  # at most FAN_IN models, one at a time
        w = np.frombuffer(r.w, np.float32).astype(np.float64) * r.n
        total, size = w if total is None else total + w, size + r.n
    return (total / size).astype(np.float32) if size else flat


def _averaged(models: DataFrame) -> DataFrame:
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, size = None, 0
        rows = sorted(((s, n, w) for b in batches for s, n, w in zip(*(b.column(c).to_pylist() for c in ("shard", "n", "w")), strict=True)), key=lambda r: r[0])
        for _, n, w in rows:  # at most FAN_IN models
            x = np.frombuffer(w, np.float32).astype(np.float64) * n
            total, size = x if total is None else total + x, size + n
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([size], pa.int64()), pa.array([(total / max(size, 1)).astype(np.float32).tobytes()], pa.binary())], names=["shard", "n", "w"])

    return models.groupBy(F.floor(F.col("shard") / FAN_IN).cast("long").alias("g")).applyInArrow(run, "shard long, n long, w binary")


def scored(table: DataFrame, base: Base, flat: np.ndarray) -> DataFrame:
    """The rows of table without ids, and lp: the natural log-probability of their symbols."""
    layout, weights = base.layout(), table.sparkSession.sparkContext.broadcast(flat)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = gru.unpack(weights.value, layout)
        rest, docs, size = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            lp, at = gru.score(p, layout, docs), 0
            for b in rest:
                yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(lp[at : at + b.num_rows])], names=[*b.schema.names[1:], "lp"])
                at += b.num_rows

        for whole in batches:
            for b in by_bytes(whole, 0, 2 * TOKENS):
                rest.append(b)
                docs += [np.frombuffer(data, "<u2").astype(np.int32) for data in b.column(0).to_pylist()]
                size += sum(map(len, docs[-b.num_rows :]))
                if size >= TOKENS:
                    yield from flush()
                    rest, docs, size = [], [], 0
        yield from flush()

    return table.select("ids", "uid", "doc_id", "held_out", "n", "known", "base", "inner").mapInArrow(run, "uid long, doc_id long, held_out boolean, n long, known long, base double, inner double, lp double")


def score_documents(docs: DataFrame) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    score is log10 of the model's probability of the text and its end. The model predicts the class of each token from
    a recurrent state that runs from the document's start to its end; a frequent word is then predicted within its
    class, a rarer one follows the counts within its group, (c + 1) / (tokens + types + 1) for words outside the
    dictionary, so the probabilities of all words, known or not, add up to 1.

    Null counts as empty: such a text is its end alone. A null doc_id is learnt from. Rows that repeat an id are scored
    one by one; an empty table gives an empty result; further columns are ignored.
    """
    docs = need(docs, "doc_id", "text")
    spark = docs.sparkSession
    counts = stash(word_counts(docs.filter(~held_out(F.col("doc_id")))), "lm-counts")
    base = base_of(counts)
    table = encoded(docs, spark.sparkContext.broadcast(base)).withColumn("uid", F.monotonically_increasing_id())
    table = stash(table, "lm-symbols")
    weights = trained(table, base)
    rare = table.select("uid", F.explode("rare").alias("r")).select("uid", F.col("r.w").alias("w"), F.col("r.m").alias("m"))
    found = rare.join(counts.filter(F.col("s") >= 0).select("w", "c"), "w", "left").groupBy("uid").agg(F.sum(F.col("m") * F.log10(F.coalesce("c", F.lit(0)) + 1.0)).alias("log"), F.sum(F.when(F.col("c").isNotNull(), F.col("m")).otherwise(0)).alias("seen"))
    out = stash(scored(table, base, weights), "lm-scores").join(found, "uid", "left")
    more = F.coalesce("log", F.lit(0.0))
    return out.select(
        "doc_id",
        "held_out",
        F.col("n").alias("n_tokens"),
        (F.col("known") + F.coalesce("seen", F.lit(0))).cast("long").alias("n_known"),
        F.lit(base.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"),
        (F.col("lp") / math.log(10) + F.col("inner") + more).alias("score"),
    )


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read(spark, sf_dir, "documents"))
