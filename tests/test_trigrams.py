"""The index finds what a scan of all texts finds."""

import random

import numpy as np
import pytest

from subjectlens.operators import trigrams
from subjectlens.operators.trigrams import TrigramIndex


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(6)
    out = ["".join(rng.choice("abcAé 日") for _ in range(rng.randrange(40))) for _ in range(150)]
    return dict(enumerate([*out, "", "a", "ab", "É", None, "x" * 5000 + "needle", "emoji 🙂🙃 here", "line\none"]))


@pytest.fixture(scope="module")
def index(spark, texts):
    return TrigramIndex(spark.createDataFrame([(i, x, "extra") for i, x in texts.items()], "id long, text string, gram string"))


def test_search(spark, texts, index):
    rng = random.Random(7)
    cut = lambda x: x[(a := rng.randrange(len(x) + 1)) : a + rng.randrange(6)]
    needles = [cut(x) for x in texts.values() if x] + ["", "a", "b", "É", "ab", "Ab", "日", "xxx", "xxneedle", "none at all", "🙂", "🙂🙃", "e\no", None]
    got = [tuple(r) for r in index.search(spark.createDataFrame([(n,) for n in needles * 2], "needle string")).collect()]
    want = {(n, i) for n in needles if n for i, x in texts.items() if x is not None and n.lower() in x.lower()}
    assert set(got) == want and len(got) == len(want) > 500


@pytest.mark.parametrize("words", [["abc"], ["ABC", "a"], ["é"], ["needle", "xxxxx"], ["abc", "none"], ["ab", "ba"], [], [""], ["aé", "日a", "bca"]])
def test_holding(texts, index, words):
    want = {i for i, x in texts.items() if x is not None and words and all(w and w.lower() in x.lower() for w in words)}
    got = [r.id for r in index.holding(words).collect()]
    assert set(got) == want and len(got) == len(want)


def test_only_the_words_folders_are_read(index):
    plan = index.holding(["needle"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [", 1)[1][:200]
    assert "PushedFilters: [In(gram" in plan or "EqualTo(gram" in plan


def test_nothing(spark):
    empty = TrigramIndex(spark.createDataFrame([], "id long, text string"))
    assert empty.search(spark.createDataFrame([("abc",), ("a",)], "needle string")).collect() == [] and empty.holding(["abc"]).collect() == []


@pytest.mark.parametrize("table, cells", [(1 << 24, 1 << 26), (10, 1 << 26), (1 << 24, 200), (10, 1)])
def test_pieces_of_a_block(monkeypatch, texts, table, cells):
    """By tables and by sorting, whole and in parts: the pieces of every text, none across two texts."""
    monkeypatch.setattr(trigrams, "TABLE", table)
    monkeypatch.setattr(trigrams, "CELLS", cells)
    rows = [(i * 3, x.lower() + "\0" * (i % 2)) for i, x in texts.items() if x is not None]
    got = []
    for grams, bits in trigrams._pieces_of(np.array([i for i, _ in rows]), [x for _, x in rows]):
        got += [(g, int(i)) for g, b in zip(grams, bits, strict=True) for i in np.flatnonzero(b)]
    want = {(x[a : a + k], i) for i, x in rows for k in (1, 2, 3) for a in range(len(x) - k + 1)}
    assert set(got) == want and len(got) == len(want)


def test_postings_are_bits_of_blocks(spark, monkeypatch):
    """Short needles are pieces themselves, and the index has a row for a piece and a block, not one for each text."""
    monkeypatch.setattr(trigrams, "BLOCK_CHARS", 400)
    index = TrigramIndex(spark.range(500).selectExpr("id", "'same text' as text").coalesce(1))
    assert index.rows.select("block").distinct().count() == 16
    assert index.postings.filter("gram = 'sam'").count() == 16 and index.counts.filter("gram = 'sa'").first().n == 500
    assert index.search(spark.createDataFrame([("e t",), ("e",)], "needle string")).count() == 1000
