"""The mix by row: null and repeated ids, clashing names."""

import random
from collections import defaultdict

from subjectlens.llm import mixing


def _rows():
    rng = random.Random(11)
    text = lambda: " ".join(f"w{rng.randrange(999)}" for _ in range(rng.randrange(60)))
    rows = [(None if k % 3 == 0 else k // 4 if k % 3 == 1 else 1000 + k, text() if k % 10 else rng.choice((None, "")), rng.choice("aaabc") if k % 7 else None, k, "x", 0.5) for k in range(600)]
    return [*rows, *rows[:20]]


SCHEMA = "doc_id long, text string, source string, row long, __due string, __at double"


def test_each_source_comes_near_its_target(spark):
    rows = _rows()
    docs = spark.createDataFrame(rows, SCHEMA)
    targets = {r.source_size: r.target for r in mixing.mix(docs).collect()}
    size, longest, used = defaultdict(int), defaultdict(int), defaultdict(int)
    for _, text, source, *_ in rows:
        n = len((text or "").split())
        size[source] += n
        longest[source] = max(longest[source], n)
    got = mixing.mixed_documents(docs).collect()
    assert got[0].asDict().keys() == {c.split()[0] for c in SCHEMA.split(", ")}
    uses = defaultdict(int)
    for r in got:
        used[r.source] += len(r.text.split())
        uses[tuple(r)] += 1
    assert all(abs(used[s] - targets[n]) <= longest[s] for s, n in size.items()), (dict(used), targets)
    copies = defaultdict(int)
    for r in rows:
        copies[r] += 1
    assert all(n <= mixing.MOST_REPEATS * copies[r] for r, n in uses.items())


def test_rows_without_an_id_are_used_as_often_as_others(spark):
    """30 rows without an id and 30 with ids in one source: uses of one row are not those of another."""
    rows = [(None if k < 30 else k, f"text {k} " + "word " * (80 + k), "b") for k in range(60)] + [(100, "a " * 9000, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = [r for r in mixing.mix(docs).collect() if r.doc_id != 100]
    used = [r for r in mixing.mixed_documents(docs).collect() if r.source == "b"]
    assert abs(sum(len(r.text.split()) for r in used) - plan[0].target) <= 142
    lines = {len([r for r in plan if r.doc_id is None and r.position == p]) for p in {r.position for r in plan if r.position is not None}}
    assert lines <= {0, 1}


def test_empty_table(spark):
    assert mixing.mixed_documents(spark.createDataFrame([], SCHEMA)).collect() == []


def test_the_mix_in_any_order_moves_texts_once(spark):
    docs = spark.createDataFrame([(i, f"w{i} " * (i % 5 + 1), "ab"[i % 2], "x") for i in range(40)], "doc_id long, text string, source string, more string")
    free, sorted_ = mixing.mixed_documents(docs, ordered=False), mixing.mixed_documents(docs)
    assert sorted(map(tuple, free.collect())) == sorted(map(tuple, sorted_.collect()))
    assert "Sort [" not in free._jdf.queryExecution().optimizedPlan().toString().split("Join", 1)[0]
