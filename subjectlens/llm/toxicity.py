"""Toxicity by classifier chains: each category's linear model also sees the probabilities of the categories before it."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from functools import reduce
from operator import add
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from subjectlens.llm.decontaminate import words_of
from subjectlens.llm.shared import by_bytes, need, read, stash, text_of

#: Label columns in the order of the chain.
CATEGORIES = ("quality", "toxic")
#: The models are fitted on at most so many labelled documents, chosen by a hash of their id.
MOST_LABELLED = 16_000
#: Folds for the probabilities that later models are trained with.
FOLDS = 5
#: Features of each model: the words and word beginnings that tell its category apart best, at least LEAST_Z standard errors.
MOST_FEATURES, LEAST_Z, LEAST_DOCUMENTS = 4096, 3.0, 2
#: A document is toxic from this probability of the last category.
THRESHOLD = 0.5
#: Text bytes that become features at once; documents whose features are counted at once.
TEXT_BYTES, COUNTED = 2 << 20, 1000
#: A word of at least LONG letters also counts by its first STEM bytes.
LONG, STEM = 6, 4


def features_of(text: str) -> set[bytes]:
    """Distinct words, and beginnings of long words (marked by a space)."""
    words = set(words_of(text))
    return words | {b" " + w[:STEM] for w in words if len(w) >= LONG}


def fit_logistic(rows: Sequence[np.ndarray], extra: np.ndarray, y: np.ndarray, n_features: int, l2: float = 0.2, steps: int = 200) -> np.ndarray:
    """Weights of a logistic model: one per binary feature, one per extra column, the intercept last.

    Accelerated gradient steps, each coordinate scaled by how often its feature occurs.
    """
    flat = np.concatenate(rows) if len(rows) else np.empty(0, np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    k, n = extra.shape[1], max(1, len(rows))
    weights = np.zeros(n_features + k + 1)
    curve = np.r_[np.bincount(flat, minlength=n_features), (extra**2).sum(0), n] * 0.25
    share = max(1, int(np.percentile([len(r) for r in rows], 95))) + k + 1 if len(rows) else 1
    rate = 1.0 / (curve * np.sqrt(share) + l2)
    look, momentum = weights.copy(), 1.0
    for _ in range(steps):
        z = np.bincount(owner, look[flat], minlength=len(rows)) + extra @ look[n_features:-1] + look[-1]
        off = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        grad = np.r_[np.bincount(flat, off[owner], minlength=n_features), off @ extra, off.sum()]
        grad[:-1] += l2 * look[:-1]
        after, m = look - rate * grad, (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        look, weights, momentum = after + (momentum - 1) / m * (after - weights), after, m
    return weights


def probability(rows: Sequence[np.ndarray], extra: np.ndarray, weights: np.ndarray) -> np.ndarray:
    k = extra.shape[1]
    base = weights[: len(weights) - k - 1]
    z = np.array([base[r].sum() for r in rows]) + extra @ weights[len(base) : -1] + weights[-1]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


class Chain:
    """The fitted models. A category's rows hold feature numbers; `models` has (features, weights) in chain order.

    `shares`: how many of the labelled documents have each label; the probability for a text without any known feature.
    """

    def __init__(self, categories: Sequence[str], models: list[tuple[dict[bytes, int], np.ndarray]], shares: np.ndarray):
        self.categories, self.models, self.shares = tuple(categories), models, shares
        self.every = set().union(*(m[0] for m in models))

    def predict(self, features: list[set[bytes]]) -> np.ndarray:
        """A column of probabilities per category."""
        out = np.zeros((len(features), 0))
        features = [f & self.every for f in features]
        for at, weights in self.models:
            rows = [np.fromiter((at[f] for f in fs if f in at), np.int64) for fs in features]
            out = np.c_[out, probability(rows, log_odds(out), weights)]
        out[[not f for f in features]] = self.shares
        return out


def _sample(docs: DataFrame, labels: DataFrame, categories: Sequence[str]) -> DataFrame:
    """(fold, y, features) of the labelled documents that are learnt from, written to the shared folder."""
    known = labels.select("doc_id", *[F.col(c).cast("int").alias(c) for c in categories]).na.drop()
    known = known.groupBy("doc_id").agg(*[F.max(c).alias(c) for c in categories])
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_LABELLED)
    text = docs.select("doc_id", text_of().alias("text"))
    joined = text.join(F.broadcast(chosen), "doc_id")  # at most MOST_LABELLED rows of a few integers
    y = F.array(*[F.col(c) for c in categories])
    schema = "doc_id long, fold int, y array<int>, features array<binary>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in by_bytes(whole, 3, TEXT_BYTES)):
            found = [sorted(features_of(x)) for x in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(found, pa.list_(pa.binary()))], names=["doc_id", "fold", "y", "features"])

    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS)).cast("int")
    return stash(joined.select(F.col("doc_id").cast("long").alias("doc_id"), fold.alias("fold"), y.alias("y"), "text").mapInArrow(run, schema), "toxicity-sample")


class Counts(NamedTuple):
    """A feature with the number of documents, and of positives by category, in each fold."""

    f: bytes
    n: np.ndarray
    c: np.ndarray


def _feature_counts(sample: DataFrame, n: int) -> list[Counts]:
    """Counts of the features that some model may choose: for each model the best MOST_FEATURES by what its own folds say."""
    typed = pa.schema([("f", pa.binary()), ("fold", pa.int32()), ("n", pa.int64()), *[(f"c{i}", pa.int64()) for i in range(n)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(i, COUNTED) for whole in batches for i in range(0, whole.num_rows, COUNTED)):
            counts = [Counter() for _ in range(n + 1)]
            for fold, y, fs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                keys = [(f, fold) for f in fs]
                counts[0].update(keys)
                for i in range(n):
                    if y[i]:
                        counts[i + 1].update(keys)
            keys = list(counts[0])
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.binary()), pa.array([k[1] for k in keys], pa.int32()), *[pa.array([c[k] for k in keys], pa.int64()) for c in counts]], schema=typed)

    sums = [F.sum(c).alias(c) for c in ("n", *[f"c{i}" for i in range(n)])]
    parts = sample.select("fold", "y", "features").mapInArrow(run, "f binary, fold int, n long, " + ", ".join(f"c{i} long" for i in range(n)))
    sized = {r.fold: r for r in sample.groupBy("fold").agg(F.count("*").alias("n"), *[F.sum(F.get("y", F.lit(i))).alias(f"c{i}") for i in range(n)]).collect()}
    known = lambda c, use: float(sum(sized[k][c] or 0 for k in use if k in sized))
    counted = lambda c, use: reduce(add, [F.coalesce(F.try_element_at(c, F.lit(k)), F.lit(0)) for k in use])

    def z(i: int, skip: int | None):
        use = [k for k in range(FOLDS) if k != skip]
        size, one = known("n", use), known(f"c{i}", use)
        zero = size - one
        if not one or not zero:
            return F.lit(0.0)
        docs, hits = counted("n", use), counted(f"c{i}", use)
        p = docs / size
        spread = F.greatest(F.sqrt(p * (1 - p) * (1 / one + 1 / zero)), F.lit(1e-9))
        return F.when(docs >= LEAST_DOCUMENTS, F.abs(hits / one - (docs - hits) / zero) / spread).otherwise(0.0)

    by_fold = parts.groupBy("f", "fold").agg(*sums).groupBy("f")
    whole = by_fold.agg(*[F.map_from_entries(F.collect_list(F.struct("fold", c))).alias(c) for c in ("n", *[f"c{i}" for i in range(n)])])
    models = [(i, skip) for i in range(n) for skip in [*(range(FOLDS) if i < n - 1 else ()), None]]
    rated = F.filter(F.array(*[F.struct(F.lit(m).alias("m"), z(*k).alias("z")) for m, k in enumerate(models)]), lambda x: x["z"] >= LEAST_Z)
    best = whole.select("*", F.explode(rated).alias("r")).withColumn("place", F.row_number().over(W.partitionBy("r.m").orderBy(F.desc("r.z"), "f")))
    kept = best.filter(F.col("place") <= MOST_FEATURES).groupBy("f").agg(*[F.first(c).alias(c) for c in ("n", *[f"c{i}" for i in range(n)])])
    out = []
    for r in kept.orderBy("f").collect():  # MOST_FEATURES rows at most for each of the models
        out.append(Counts(bytes(r.f), np.array([r.n.get(k, 0) for k in range(FOLDS)], float), np.array([[r[f"c{i}"].get(k, 0) for i in range(n)] for k in range(FOLDS)], float)))
    return out


def _chosen(counts: list[Counts], sizes: np.ndarray, ones: np.ndarray, i: int, skip: int | None) -> list[int]:
    """Numbers of the features of category i's model trained without fold `skip`."""
    use = [k for k in range(FOLDS) if k != skip]
    size, one = sizes[use].sum(), ones[use, i].sum()
    zero = size - one
    if not one or not zero or not counts:
        return []
    n = np.array([r.n[use].sum() for r in counts])
    c = np.array([r.c[use, i].sum() for r in counts])
    p = n / size
    z = np.abs(c / one - (n - c) / zero) / np.maximum(np.sqrt(p * (1 - p) * (1 / one + 1 / zero)), 1e-9)
    z[n < LEAST_DOCUMENTS] = 0
    return sorted(np.flatnonzero(z >= LEAST_Z).tolist(), key=lambda k: (-z[k], counts[k].f))[:MOST_FEATURES]


def fit_chain(docs: DataFrame, labels: DataFrame, categories: Sequence[str] = CATEGORIES) -> Chain:
    """Fits the chain on a bounded sample of labelled documents.

    Each model's features are chosen from counts made by Spark. The first category's out-of-fold probabilities (from
    models, features included, that have not seen the document) are inputs when the second model is trained, and so
    on. Without labels, or with labels of one kind only, the probability is the share of that kind. A document whose
    labels contradict each other has a label if one of them says so.
    """
    n = len(categories)
    sample = _sample(docs, labels, categories)
    counts = _feature_counts(sample, n)
    names = [r.f for r in counts]
    known = sample.sparkSession.sparkContext.broadcast({f: k for k, f in enumerate(names)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = known.value
            kept = [np.array(sorted(at[f] for f in fs if f in at), np.int32).tobytes() for fs in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(kept, pa.binary())], names=["doc_id", "fold", "y", "features"])

    # numbers of features only: 4 bytes for each of the few a document has, MOST_LABELLED rows at most
    got = sample.mapInArrow(run, "doc_id long, fold int, y array<int>, features binary").toArrow()
    got = got.take(np.argsort(got["doc_id"].to_numpy(), kind="stable")) if got.num_rows else got
    fold = got["fold"].to_numpy().astype(int)
    y = (np.array(got["y"].to_pylist(), float).reshape(got.num_rows, n) > 0).astype(float)
    rows = [np.frombuffer(x, np.int32) for x in got["features"].to_pylist()]
    del got
    sizes = np.bincount(fold, minlength=FOLDS) if len(rows) else np.zeros(FOLDS, int)
    ones = np.array([[y[fold == k, i].sum() for i in range(n)] for k in range(FOLDS)])
    models, held = [], np.zeros((len(rows), 0))
    for i in range(n):
        out = np.zeros(len(rows))
        for skip in [*(range(FOLDS) if i < n - 1 else ()), None]:
            chosen = _chosen(counts, sizes, ones, i, skip)
            local = np.full(len(names), -1, np.int64)
            local[chosen] = np.arange(len(chosen))
            sets = [x[x >= 0] for x in (local[r] for r in rows)]
            train = np.flatnonzero(fold != skip) if skip is not None else np.arange(len(rows))
            extra = log_odds(held)
            weights = fit_logistic([sets[k] for k in train], extra[train], y[train, i], len(chosen)) if len(train) else np.r_[np.zeros(len(chosen) + i), -30.0]
            if skip is None:
                models.append(({names[k]: j for j, k in enumerate(chosen)}, weights))
            elif (test := np.flatnonzero(fold == skip)).size:
                out[test] = probability([sets[k] for k in test], extra[test], weights)
        held = np.c_[held, out]
    return Chain(categories, models, y.mean(0) if len(rows) else np.zeros(n))


def toxicity(docs: DataFrame, chain: Chain) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, p_<category> for each category of the chain, and toxic.

    Null text counts as empty. A text without a feature of the models, such as an empty one, has the shares of the labels
    among the documents learnt from as its probabilities. Rows that repeat an id are rated one by one; a null doc_id is kept;
    an empty table gives an empty result; further columns are ignored.
    """
    docs = need(docs, "doc_id", "text")
    names = [f"p_{c}" for c in chain.categories]
    model = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in by_bytes(whole, 1, TEXT_BYTES)):
            p = model.value.predict([features_of(x) for x in b.column(1).to_pylist()])
            toxic = pa.array(p[:, -1] >= THRESHOLD)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(p[:, i]) for i in range(p.shape[1])), toxic], names=["doc_id", *names, "toxic"])

    schema = "doc_id long, " + ", ".join(f"{c} double" for c in names) + ", toxic boolean"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, schema)


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all columns, without those that the chain calls toxic. Each row is judged by its own text, whatever its id."""
    model = docs.sparkSession.sparkContext.broadcast(fit_chain(docs, labels))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in by_bytes(whole, at, TEXT_BYTES)):
            p = model.value.predict([features_of(x or "") for x in b.column(at).to_pylist()])
            yield b.filter(pa.array(p[:, -1] < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity(docs, fit_chain(docs, read(spark, sf_dir, "labels")))
