"""The pipeline's stages by row: near copies down to a similarity of 0.8, null and repeated ids."""

import random

import brute_force

from subjectlens.llm import decontaminate, near_copies, toxicity


def _words(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def _near_rows():
    """Texts of 100 words with 1 to 6 words changed (Jaccard 0.9 down to below 0.8), short texts, copies, null and repeated ids."""
    rng, rows = random.Random(7), []
    for i in range(40):
        w = _words(rng, 100)
        rows.append((10 * i, " ".join(w)))
        for k in range(1, 4):
            c = list(w)
            for at in rng.sample(range(100), 2 * k - i % 2):
                c[at] = "changed"
            rows.append((None if i % 4 == 0 else 10 * (i // 3) + k, " ".join(c)))
    return rows + [(None, f"one of its kind {i}") for i in range(5)] + [(7, "first of two"), (7, "second text of one id"), (8, ""), (9, None), (None, " ")]


def test_near_copies_as_by_brute_force(spark):
    rows = _near_rows()
    got = near_copies.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    want = brute_force.rows_that_stay(rows)
    assert len(want) < len(rows) - 30
    assert sorted(r[0] or -1 for r in got) == sorted(r[0] or -1 for r in want)
    assert {key(r) for r in got if r.doc_id is not None and r.text} <= {key(r) for r in rows}
    assert len([r for r in got if r.text and r.text.startswith("one of its kind")]) == 5
    assert near_copies.one_of_each(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_changed_word_in_a_hundred(spark):
    w = _words(random.Random(1), 100)
    rows = [(i, " ".join([*w[: 5 + i], f"new{i}", *w[6 + i :]])) for i in range(0, 80, 10)]
    assert [r.doc_id for r in near_copies.one_of_each(spark.createDataFrame([(100, " ".join(w)), *rows], "doc_id long, text string")).collect()] == [0]


def test_clean_rows_stay_beside_bad_ones_of_their_id(spark):
    rows = [(i, "you are a horrid idiot" if i % 3 == 0 else f"the weather is fine and mild today {i % 5}") for i in range(300)]
    more = [(None, "you are a horrid idiot"), (None, "the weather is fine today"), (0, "the weather is mild today"), (None, None)]
    docs = spark.createDataFrame([*rows, *more], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(1, 200)], "doc_id long, quality int, toxic int")
    got = toxicity.without_toxic(docs.filter("text is not null"), labels).collect()
    assert sorted(map(str, got)) == sorted(str(r) for r in docs.collect() if "horrid" not in (r.text or "horrid"))
    items = spark.createDataFrame([(1, "horrid idiot"), (2, "fine today"), (3, None)], "item_id long, text string")
    left = [r for r in docs.collect() if not any(x in (r.text or "") for x in ("horrid idiot", "fine today"))]
    assert sorted(map(str, decontaminate.decontaminated(docs, items).collect())) == sorted(map(str, left))
