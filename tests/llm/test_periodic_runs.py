"""op11 against each period at each place."""

import random

import brute_force
import numpy as np
import pytest

from subjectlens.llm import periodic_runs
from subjectlens.llm.shared import read

SF = "/root/testdata/sf0.001"


def _texts() -> list[str | None]:
    rng, out = random.Random(7), [None, "", " \t\n", "a", "a " * 23, "a " * 24, "a " * 1000, "\x0b x  y\r\n" * 40, "é ü " * 30, "ab c d " * 30]
    for k in range(400):
        letters = "abcdefghij"[: rng.choice((1, 2, 2, 3, 10))]
        words = [rng.choice(letters) for _ in range(rng.randrange(150))]
        for _ in range(rng.randrange(4)):
            at, p = rng.randrange(len(words) + 1), rng.choice((1, 2, 3, 5, 8, 13, 30))
            piece = [rng.choice(letters) for _ in range(p)] * rng.randrange(2, 12)
            words[at:at] = piece[: len(piece) - rng.randrange(p)]
        out.append(rng.choice((" ", "\n")).join(words))
    return out


def test_same_as_brute_force(spark):
    texts = _texts()
    rows = [*enumerate(texts), (None, texts[6]), (3, "a " * 50), (3, "a " * 50)]
    docs = spark.createDataFrame([(i, x, "extra", i) for i, x in rows], "doc_id long, text string, h string, n_runs long")
    got = periodic_runs.collapse_runs(docs, periodic_runs.with_repeat).collect()
    key = lambda r: (str(r[0]), r[-1])
    assert sorted((tuple(r) for r in got), key=key) == sorted(brute_force.run_rows(rows), key=key)
    assert sum(r.n_runs for r in got) > 300


def test_documents(spark):
    docs = read(spark, SF, "documents")
    got = {tuple(r) for r in periodic_runs.op11_periodic_runs(spark, SF).collect()}
    short = [(r.doc_id, r.text) for r in docs.collect() if len((r.text or "").split()) <= 700]
    assert len(short) > 100 and got >= set(brute_force.run_rows(short)) and len(got) == docs.count()


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert periodic_runs.collapse_runs(none).collect() == [] and periodic_runs.collapse_runs(none).columns == [c.split()[0] for c in periodic_runs.COLUMNS.split(", ")]


@pytest.mark.parametrize("p", (1, 7, 450, 30_000))
def test_long_texts(p):
    rng = np.random.default_rng(p)
    w = np.r_[rng.integers(0, 50, 5000), np.tile(rng.integers(0, 50, p), 100_000 // p + 1)[: max(100_000, 3 * p + 1)], np.arange(100, 400)]
    runs = [r for r in periodic_runs.periodic_runs(w) if r[1] > 50_000]
    assert len(runs) == 1 and runs[0][2] == p and runs[0][0] <= 5000 and runs[0][0] + runs[0][1] >= len(w) - 300
