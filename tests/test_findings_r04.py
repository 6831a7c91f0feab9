"""Small cases that earlier versions got wrong or left incomplete."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from subjectlens.functions import content, table_functions
from subjectlens.operators import communities, graph, merge, trigrams


def test_all_rows_of_a_json_text(spark):
    """Neither the table function nor the column function stops at 250 rows."""
    text = json.dumps({"n": 1, "items": [{"id": i, "who": {"name": f"x{i}"}} for i in range(1000)]})
    texts = spark.createDataFrame([(1, text), (2, '[{"a": null}]'), (3, "none")], "id long, content string")
    table_functions.register(spark)
    rows = spark.sql("SELECT d.id, r.* FROM {d} d, LATERAL json_rows(d.content) r", d=texts).collect()
    want = [(1, i, k, n, v) for i in range(1000) for k, (n, v) in enumerate([("id", str(i)), ("who.name", f"x{i}")])] + [(2, 0, 0, "a", None)]
    assert sorted(map(tuple, rows)) == want
    sizes = texts.select(F.size(content.json_rows(F.col("content"))).alias("n")).collect()
    assert [r.n for r in sizes] == [1000, 1, None]


def _clusters(spark, sizes: list[int]):
    """A component of two dense halves with a few links between them, for each size."""
    rng, edges = random.Random(4), {}
    for k, n in enumerate(sizes):
        name = lambda i: f"c{k}n{i}"  # noqa: B023, E731
        edges |= {(name(i), name(j)): 1.0 for i in range(n) for j in range(i) if (i < n // 2) == (j < n // 2) and rng.random() < 0.7}
        edges |= {(name(i), name(n - 1)): 1.0 for i in (0, n // 2, n - 2)}
        edges |= {(name(i), name(i + 1)): 0.5 for i in range(n - 1)}
    return spark.createDataFrame([(a, "P", b, w, i) for i, ((a, b), w) in enumerate(edges.items())], "s string, p string, o string, confidence double, seq long")


def test_communities_of_whole_components_are_found_in_tasks(spark, monkeypatch):
    """A graph of more links than a task takes is split into components; no round is a join."""
    rows = _clusters(spark, [12] * 5)
    monkeypatch.setattr(communities, "_level", lambda *_: pytest.fail("a component that fits was worked on by joins"))
    links = communities.both_ways(communities.weighted_pairs(rows)).collect()
    plain = communities.local_communities([tuple(r) for r in links], float(sum(r.w for r in links)))
    groups = lambda d: sorted(sorted(v for v in d if d[v] == c) for c in set(d.values()))
    for local in (150, 10_000):
        got = {r.node: r.community for r in communities.louvain(rows, local).collect()}
        assert groups(got) == groups(plain) and all(got[v] == min(g) for g in groups(got) for v in g)


def test_only_components_that_no_task_takes_go_by_joins(spark, monkeypatch):
    rows, joined, level = _clusters(spark, [8, 40, 8, 8]), [], communities._level
    monkeypatch.setattr(communities, "_level", lambda links, twice: (joined.append({r.u[:2] for r in links.select("u").collect()}), level(links, twice))[1])
    got = {r.node: r.community for r in communities.louvain(rows, 200).collect()}
    assert joined and set().union(*joined) == {"c1"}
    assert len(got) == 64 and {(v[:2], c[:2]) for v, c in got.items()} == {(f"c{k}",) * 2 for k in range(4)}


def test_labels_pass_in_tasks_as_by_joins(spark):
    rows = _clusters(spark, [8, 20, 9, 11]).union(spark.createDataFrame([("X", "P", "y", 0.3, 1), ("y", "P", "x", 0.4, 2), ("x", "P", "x", 1.0, 3), (None, "P", "x", 1.0, 4)], "s string, p string, o string, confidence double, seq long"))
    ways = [{r.node: r.community for r in graph.label_propagation(rows, local=n).collect()} for n in (0, 120, graph.LOCAL_LINKS)]
    assert ways[0] == ways[1] == ways[2] and len(ways[0]) == 50


@pytest.mark.parametrize("rows, broadcast", [(8_000_000, "10m"), (300, "10m"), (300, "-1")])
def test_policies_come_one_by_one(spark, monkeypatch, rows, broadcast):
    """The product of many requests and policies keeps a policy's rows together, in one piece or in several."""
    monkeypatch.setattr(merge, "ROWS_A_PIECE", rows)
    requests = spark.range(70).selectExpr("id", "case when id < 60 then 'a.com' when id < 65 then 'b.org' when id = 69 then null else 'none' end as company_url")
    policies = spark.range(90).selectExpr("case when id < 80 then 'a.com' else 'b.org' end as domain", "concat('https://', case when id < 80 then 'a.com' else 'b.org' end, '/', id) as url", "concat('s', id) as summary")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        got = [tuple(r) for r in merge.with_policies(requests, policies).collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    host = lambda i: "a.com" if i < 60 else "b.org" if i < 65 else None if i == 69 else "none"
    want = [(i, host(i), f"https://{host(i)}/{k}", f"s{k}") for i in range(65) for k in (range(80) if i < 60 else range(80, 90))]
    want += [(i, host(i), None, None) for i in range(65, 70)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(a[2] != b[2] for a, b in zip(got, got[1:], strict=False)) <= 91


class _Read(str):
    """A text that counts how often a word is looked for in it."""

    looks = 0

    def __contains__(self, word):
        _Read.looks += 1
        return str.__contains__(self, word)


@pytest.mark.parametrize("words", [[[f"{i:04d}"] for i in range(500)], [[f"{i:04d}", "é\0", "🙂x"] for i in range(400)], [["12", "99"], []]])
def test_many_words_are_found_in_one_pass_over_a_text(words):
    """Words whose pieces are in every text are not looked for in each of them."""
    rng = random.Random(3)
    texts = {p: _Read("".join(rng.choice("0123456789é\0🙂x") for _ in range(300))) for p in range(24)}
    bits = np.full((len(words), 3), 255, np.uint8)
    _Read.looks = 0
    got = [x.tolist() for x in trigrams._holding(texts, bits, words)]
    assert got == [[p for p, x in texts.items() if all(str.__contains__(x, w) for w in own)] for own in words]
    assert _Read.looks <= 2 * len(texts)


@pytest.mark.parametrize("looks", [0, 10_000])
def test_searches_agree_in_one_pass_and_one_by_one(spark, monkeypatch, looks):
    monkeypatch.setattr(trigrams, "MOST_LOOKS", looks)
    rng = random.Random(8)
    texts = {i: "".join(rng.choice("abcAé 日🙂") for _ in range(rng.randrange(60))) for i in range(80)}
    needles = {texts[i][a : a + n] for i in texts for a, n in ((0, 8), (3, 4), (5, 2))} - {""}
    index = trigrams.TrigramIndex(spark.createDataFrame(list(texts.items()), "id long, text string"))
    got = sorted((r.needle, r.id) for r in index.search(spark.createDataFrame([(n,) for n in needles], "needle string")).collect())
    assert got == sorted((n, i) for n in needles for i, x in texts.items() if n.lower() in x.lower())


@pytest.mark.parametrize("links", [1, 7, 1_000_000])
def test_moves_do_not_depend_on_slices(spark, monkeypatch, links):
    """Links are taken in slices, so that a task holds little beside the graph; a node of more links is a slice."""
    rows = communities.both_ways(communities.weighted_pairs(_clusters(spark, [12, 30]))).collect()
    twice = float(sum(r.w for r in rows))
    want = communities.local_communities([tuple(r) for r in rows], twice)
    monkeypatch.setattr(graph, "LINKS_A_SLICE", links)
    monkeypatch.setattr(communities, "LINKS_A_SLICE", links)
    assert communities.local_communities([tuple(r) for r in rows[::-1]], twice) == want
    u = np.array([0, 0, 0, 1, 2, 2, 5, 5, 5, 5])
    cuts = [u[x].tolist() for x in graph.slices(u)]
    assert sum(cuts, []) == u.tolist() and not any(set(a) & set(b) for a, b in zip(cuts, cuts[1:], strict=False))
