"""Vector searches with many queries, and with none."""

import math
import random

import numpy as np
import pytest

from subjectlens.catalog import queries
from subjectlens.operators import vector_cells

SCHEMA = "vec_id long, embedding array<float>, label string"


@pytest.mark.parametrize("cells, piece, slice_, at_once", [(None, 20_000, 5_000, 256), (1, 7, 3, 2), (13, 5, 2, 1), (60, 20_000, 5_000, 256)])
@pytest.mark.parametrize("least", (None, 0.3))
def test_nearest_of_each(spark, monkeypatch, cells, piece, slice_, at_once, least):
    for name, value in (("PIECE", piece), ("SLICE", slice_), ("AT_ONCE", at_once)):
        monkeypatch.setattr(vector_cells, name, value)
    rng = random.Random(5)
    rows = [(i, [float(rng.randrange(-9, 10)) for _ in range(4)], "x") for i in range(60)] + [(60, None, "x"), (70, [0.0] * 4, "x"), (None, [1.0] * 4, "x")]
    vectors = spark.createDataFrame(rows, SCHEMA).repartition(3)
    good = [(i, v) for i, v, _ in rows if i is not None and v and any(v)]
    want = {}
    for i, q in good:
        if i % 10 == 0:
            score = lambda v, q=q: round(sum(a * b for a, b in zip(q, v, strict=True)) / math.hypot(*q) / math.hypot(*v), 9)
            want[i] = [n for s, n in sorted((-score(v), n) for n, v in good if least is None or score(v) >= least)[:3]]
    got: dict = {}
    for r in sorted(vector_cells.nearest_of_each(vectors.filter("vec_id % 10 = 0"), vectors, 3, least, cells).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == want and len(got) > 4


def test_equal_vectors_and_few_cells_searched(spark):
    """A third of all vectors are equal; clusters far apart don't meet each other's queries."""
    rng = np.random.default_rng(2)
    middle = rng.normal(size=(8, 16))
    rows = [(i, [1.0, *[0.0] * 15] if i % 3 == 0 else (middle[i % 8] + 0.01 * rng.normal(size=16)).tolist(), "x") for i in range(600)]
    vectors = spark.createDataFrame(rows, SCHEMA)
    got = vector_cells.nearest_of_each(vectors.filter("vec_id % 50 = 0"), vectors, 5).collect()
    unit = {i: np.float32(v) / np.linalg.norm(np.float32(v)) for i, v, _ in rows}
    for i in range(0, 600, 50):
        want = sorted((-round(float(unit[i] @ u), 6), j) for j, u in unit.items())[:5]
        mine = [(-round(r.score, 6), r.vec_id) for r in sorted((r for r in got if r.query_id == i), key=lambda r: r.rank)]
        assert [s for s, _ in mine] == pytest.approx([s for s, _ in want], abs=2e-6) and (i % 3 or mine == want)


@pytest.mark.parametrize("name", ["r01_vector_search", "r02_vector_searches", "p15_vector_threshold"])
def test_no_vectors(spark, tmp_path, name):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert queries()[name](spark, str(tmp_path)).count() == 0
