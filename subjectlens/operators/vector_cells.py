"""Nearest vectors by cosine: cells around centroids, searched where the triangle inequality can't rule them out."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from subjectlens.operators.tables import written

#: Vectors that the centroids are fitted to, and centroids, at most.
SAMPLE, MOST_CELLS = 20_000, 1024
FIT_ROUNDS = 8
#: Vectors and queries that meet in a task, and rows of scores that it makes at once, at most.
PIECE, SLICE, AT_ONCE = 20_000, 5_000, 256
#: Angles are compared with this much room, scores at so many digits.
ROOM, DIGITS = 1e-6, 9


def units(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors that have a direction, and their unit vectors."""
    rows = column.to_pylist()
    norms = np.array([np.linalg.norm(x) if x is not None and len(x) and None not in x else 0.0 for x in rows])
    kept = np.flatnonzero((norms > 0) & np.isfinite(norms))
    return kept, np.array([rows[i] for i in kept], float) / norms[kept, None] if len(kept) else np.empty((0, 0))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat if isinstance(flat, pa.Array) else flat.chunk(0)
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel()))


def centroids(sample: np.ndarray, cells: int) -> np.ndarray:
    """Unit centroids: k-means by angle from the first rows of the sample, which is in no particular order."""
    out = sample[:cells].copy()
    for _ in range(FIT_ROUNDS):
        near = (sample @ out.T).argmax(1)
        total = np.zeros_like(out)
        np.add.at(total, near, sample)
        norm = np.linalg.norm(total, axis=1)
        moved = norm > 0
        out[moved] = total[moved] / norm[moved, None]
    return out


def _best(query_rows: np.ndarray, unit_q: np.ndarray, vec_ids: np.ndarray, unit_v: np.ndarray, floor: np.ndarray, k: int) -> pa.Table:
    """The k best vectors of each query that score its floor at least."""
    found = []
    for i in range(0, len(query_rows), AT_ONCE):
        score = np.round(unit_q[i : i + AT_ONCE] @ unit_v.T, DIGITS)
        score[score < floor[i : i + AT_ONCE, None]] = -np.inf
        if score.shape[1] > 4 * k:  # the k-th best score of each row first; all that tie with it are sorted out below
            score[score < np.partition(score, -k, axis=1)[:, -k, None]] = -np.inf
        q, v = np.nonzero(score > -np.inf)
        s = score[q, v]
        order = np.lexsort((vec_ids[v], -s, q))
        q, v, s = q[order], v[order], s[order]
        first = np.searchsorted(q, q)
        kept = np.arange(len(q)) - first < k
        found.append((query_rows[i + q[kept]], vec_ids[v[kept]], s[kept]))
    columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
    return pa.Table.from_arrays([pa.array(c) for c in columns], names=["query", "vec_id", "score"])


def _searched(visits: DataFrame, vectors: DataFrame, pieces: DataFrame, k: int) -> DataFrame:
    """(query, vec_id, score) for visits(query, unit, floor, cell): pieces of a cell's vectors meet slices of its queries."""
    slices = visits.groupBy("cell").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("slices"))
    sizes = F.broadcast(written(slices.join(pieces, "cell"), "cells"))  # MOST_CELLS rows at most
    left = visits.join(sizes, "cell").withColumn("slice", F.pmod(F.xxhash64("query"), "slices").cast("int")).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    right = vectors.join(sizes, "cell").withColumn("piece", F.pmod(F.xxhash64("row"), "pieces").cast("int")).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))

    def run(q: pa.Table, v: pa.Table) -> pa.Table:
        if not len(q) or not len(v):
            return _best(np.empty(0, np.int64), np.empty((0, 1)), np.empty(0, np.int64), np.empty((0, 1)), np.empty(0), k)
        numpy = lambda c: c.combine_chunks().to_numpy(zero_copy_only=False)
        return _best(numpy(q["query"]), _matrix(q["unit"]), numpy(v["vec_id"]), _matrix(v["unit"]), numpy(q["floor"]), k)

    keys = ["cell", "piece", "slice"]
    by = left.select(*keys, "query", "unit", "floor").groupBy(*keys).cogroup(right.select(*keys, "vec_id", "unit").groupBy(*keys))
    return by.applyInArrow(run, "query long, vec_id long, score double")


def nearest_of_each(queries: DataFrame, vectors: DataFrame, k: int = 10, least: float | None = None, cells: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k vectors nearest to each query by cosine, ties by vec_id; with `least`, those that score it.

    Exact. Vectors(vec_id, embedding) are put into cells around centroids, which are fitted to a sample of SAMPLE vectors;
    each cell knows its widest angle. A query first searches the cells next to it that hold k vectors, then only those
    cells that may hold a better one than its k-th so far: a vector in a cell is no nearer to the query than the angle to the centroid
    less the cell's widest angle. Large cells are cut into pieces, and the queries of a cell into slices, so nothing is
    gathered by size; the plan is the same for any number of queries. Only centroids are broadcast, MOST_CELLS at most.

    Null and zero vectors, and vectors that hold nulls, have no cosine and are left out, as are vectors without an id. Rows
    that repeat an id are vectors, or queries, of their own. Scores are compared at nine digits.
    """
    spark = vectors.sparkSession
    ids = F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")

    def directed(batches):
        for b in batches:
            kept, unit = units(b.column(2))
            if len(kept):
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(kept)), b.column(1).take(pa.array(kept)), _lists(unit)], names=["row", "vec_id", "unit"])

    shape = "row long, vec_id long, unit array<double>"
    number = lambda df: df.select(F.monotonically_increasing_id().alias("row"), *ids).mapInArrow(directed, shape)
    found = written(number(vectors.filter("vec_id is not null")), "vectors")
    asked = written(number(queries), "queries")
    sample = found.orderBy(F.xxhash64("row")).limit(SAMPLE).select("unit").toArrow()["unit"]
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    n = cells or min(MOST_CELLS, math.isqrt(found.count()))
    sent = spark.sparkContext.broadcast(centroids(_matrix(sample), min(n, len(sample))))

    def placed(batches):
        for b in batches:
            if b.num_rows:
                cos = _matrix(pa.chunked_array([b.column(2)])) @ sent.value.T
                cell = cos.argmax(1)
                angle = np.arccos(np.clip(cos[np.arange(len(cell)), cell], -1, 1))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32()), pa.array(angle)], names=["row", "vec_id", "unit", "cell", "angle"])

    found = written(found.mapInArrow(placed, f"{shape}, cell int, angle double"), "vectors")
    sizes = found.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("widest")).toArrow()  # MOST_CELLS rows at most
    held, widest = np.zeros(len(sent.value), np.int64), np.full(len(sent.value), -np.inf)
    at = sizes["cell"].to_numpy()
    held[at], widest[at] = sizes["n"].to_numpy(), sizes["widest"].to_numpy()
    pieces = spark.createDataFrame([(int(c), int(-(-held[c] // PIECE))) for c in np.flatnonzero(held)], "cell int, pieces int")
    filled = np.flatnonzero(held)

    def angles(b: pa.RecordBatch, column: int) -> np.ndarray:
        return np.arccos(np.clip(_matrix(pa.chunked_array([b.column(column)])) @ sent.value[filled].T, -1, 1))

    def near(batches):
        """Cells next to the query, nearest first, until they hold k vectors."""
        for b in batches:
            if b.num_rows:
                order = np.argsort(angles(b, 2), axis=1, kind="stable")
                enough = (np.cumsum(held[filled][order], axis=1) < k).sum(1) + 1
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([filled[o[:m]].tolist() for o, m in zip(order, enough.tolist(), strict=True)], pa.list_(pa.int32()))], names=["row", "vec_id", "unit", "cells"])

    def further(batches):
        """Cells not searched yet that may hold a vector which scores the floor."""
        for b in batches:
            if b.num_rows:
                nearest = np.cos(np.maximum(0, angles(b, 2) - widest[filled] - ROOM))
                may = nearest >= b.column(4).to_numpy()[:, None] - 10.0**-DIGITS
                cells_ = [np.setdiff1d(filled[m], c).tolist() for m, c in zip(may, b.column(3).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns[:3], b.column(4), pa.array(cells_, pa.list_(pa.int32()))], names=["row", "vec_id", "unit", "floor", "cells"])

    low = -2.0 if least is None else float(least)
    order = W.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    best = lambda df: df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    asked = written(asked.mapInArrow(near, f"{shape}, cells array<int>"), "queries")
    visits = written(asked.select(F.col("row").alias("query"), "unit", F.lit(low).alias("floor"), F.explode("cells").alias("cell")), "visits")
    first = written(best(_searched(visits, found, pieces, k)), "nearest")
    floors = first.filter(F.col("rank") == k).select(F.col("query").alias("row"), F.col("score").alias("floor"))
    rest = asked.join(floors, "row", "left").select("row", "vec_id", "unit", "cells", F.coalesce("floor", F.lit(low)).alias("floor"))
    rest = rest.mapInArrow(further, f"{shape}, floor double, cells array<int>")
    visits = written(rest.select(F.col("row").alias("query"), "unit", "floor", F.explode("cells").alias("cell")), "visits")
    every = first.drop("rank").unionByName(_searched(visits, found, pieces, k))
    return best(every).join(asked.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id")), "query").select("query_id", "rank", "vec_id", "score")
