"""Communities and betweenness against plain Python."""

import itertools
import random
from collections import Counter, defaultdict, deque

import pytest

from subjectlens.operators import betweenness, communities, graph

TRIPLES = "s string, p string, o string, confidence double, seq long"


def _triples(spark, edges):
    """edges: (s, o) or (s, o, confidence)."""
    return spark.createDataFrame([(e[0], "P", e[1], float(e[2]) if len(e) > 2 else 1.0, k) for k, e in enumerate(edges)], TRIPLES)


def _between(edges):
    """Shares of shortest paths by enumeration."""
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out, n = dict.fromkeys(near, 0.0), len(near)
    for s in near:
        far, count, order, todo = {s: 0}, {s: 1.0}, [], deque([s])
        while todo:
            v = todo.popleft()
            order.append(v)
            for w in near[v]:
                if w not in far:
                    far[w], count[w] = far[v] + 1, 0.0
                    todo.append(w)
                if far[w] == far[v] + 1:
                    count[w] += count[v]
        part = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in near[w]:
                if far.get(v) == far[w] - 1:
                    part[v] += count[v] / count[w] * (1 + part[w])
            if w != s:
                out[w] += part[w]
    return {v: x / ((n - 1) * (n - 2)) for v, x in out.items()}


def _random_graph(seed: int, n: int, links: int, parts: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    return [(f"n{k % parts}-{rng.randrange(n)}", f"N{k % parts}-{rng.randrange(n)}", rng.choice((0.2, 0.5, 1.0))) for k in range(links)]


def _same(got: dict, want: dict) -> bool:
    return got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


# ---------------------------------------------------------------- betweenness

GRAPHS = {
    "small": [("a", "b"), ("b", "c"), ("c", "d"), ("a", "e"), ("e", "c"), ("d", "f"), ("x", "y")],
    "awkward": [("a", "B"), ("b", "A"), ("b", "b"), ("b", "c"), ("c", "b"), (None, "c"), ("z", "z"), ("é", "ü"), ("ü", "日")],
    "parts": _random_graph(1, 12, 150, 7),
    "one": _random_graph(2, 60, 150),
}


@pytest.mark.parametrize("name, way", [("small", "tasks"), ("small", "levels"), ("awkward", "tasks"), ("awkward", "levels"), ("parts", "tasks"), ("parts", "blocks"), ("one", "blocks")])
def test_betweenness(spark, monkeypatch, name, way):
    if way == "blocks":  # each component alone, several blocks of sources, few sources at once
        for what, value in (("LINKS_A_TASK", 20), ("STEPS_A_TASK", 500), ("LEAST_SOURCES", 3), ("CELLS", 300)):
            monkeypatch.setattr(betweenness, what, value)
    
    edges = GRAPHS[name]
    want = _between([(a.lower(), b.lower()) for a, b, *_ in edges if a and b])
    got = betweenness.betweenness_centrality(_triples(spark, edges), 0 if way == "levels" and name != "parts" else 30 if way == "levels" else betweenness.MOST_LINKS)
    assert _same({r.node: r.centrality for r in got.collect()}, want)


def test_betweenness_of_nothing(spark):
    assert betweenness.betweenness_centrality(_triples(spark, []).limit(0)).collect() == []
    assert {r.centrality for r in betweenness.betweenness_centrality(_triples(spark, [("a", "b")])).collect()} == {0.0}


# ---------------------------------------------------------------- communities


def _matrix(edges: list[tuple]) -> dict[tuple, int]:
    last = {}
    for a, b, *w in edges:
        if a and b:
            last[tuple(sorted((a.lower(), b.lower())))] = round((w[0] if w else 1.0) * communities.UNIT)
    out = defaultdict(int)
    for (a, b), w in last.items():
        out[a, b] += w
        out[b, a] += w
    return out


def _modularity(links: dict[tuple, int], c: dict) -> float:
    k = Counter()
    for (a, _), w in links.items():
        k[c[a]] += w
    twice = sum(k.values())
    return sum(w for (a, b), w in links.items() if c[a] == c[b]) / twice - sum((x / twice) ** 2 for x in k.values())


def _sequential(links: dict[tuple, int]) -> dict:
    """Louvain as it is usually written: one node after the other, level by level."""
    found = {a: a for a, _ in links}
    while True:
        k, near = Counter(), defaultdict(dict)
        for (a, b), w in links.items():
            k[a] += w
            if a != b:
                near[a][b] = w
        twice, c, total, moved, ever = sum(k.values()), {a: a for a in k}, Counter(k), True, False
        while moved:
            moved = False
            for a in sorted(k):
                by = Counter()
                for b, w in near[a].items():
                    by[c[b]] += w
                total[c[a]] -= k[a]
                best = min(by.keys() | {c[a]}, key=lambda x: (-(by[x] - k[a] * total[x] / twice), x != c[a], x))
                moved |= best != c[a]
                c[a] = best
                total[best] += k[a]
            ever |= moved
            ever |= any(c[a] != a for a in c)
        if not ever:
            return found
        found = {a: c[x] for a, x in found.items()}
        joined = Counter()
        for (a, b), w in links.items():
            joined[c[a], c[b]] += w
        links = joined


def _groups(members: dict) -> set[frozenset]:
    out = defaultdict(set)
    for v, c in members.items():
        out[c].add(v)
    return set(map(frozenset, out.values()))


CLIQUES = [(*p, 1.0) for g in ("abcd", "wxyz", "mnop") for p in itertools.combinations(g, 2)] + [("d", "w", 0.1), ("z", "m", 0.1)]
HUBS = [(f"leaf{k}", f"hub{k % 5}", 0.5 + k % 50 / 100) for k in range(400)] + [(f"hub{k}", f"root{k % 2}", 0.9) for k in range(5)]


@pytest.mark.parametrize("edges", [CLIQUES, HUBS, _random_graph(3, 40, 120), GRAPHS["awkward"]], ids=("cliques", "hubs", "random", "awkward"))
def test_communities(spark, edges):
    links, rows = _matrix(edges), _triples(spark, edges)
    plain = communities.local_communities([(a, b, w) for (a, b), w in links.items()], float(sum(links.values())))
    joins = () if edges is HUBS else (0,)
    for local in (*joins, communities.LOCAL_LINKS):  # by joins, and in one task
        got = {r.node: r.community for r in communities.louvain(rows, local).collect()}
        assert _groups(got) == _groups(plain), local
        assert all(got[v] == min(g) for g in _groups(got) for v in g)
    found = _modularity(links, got)
    labels = {r.node: r.community for r in graph.label_propagation(rows.filter("s is not null")).collect()}
    assert found >= _modularity(links, {v: labels.get(v, v) for v in got}) - 1e-12
    assert found >= _modularity(links, _sequential(links)) - 0.03
    row = communities.modularity(rows, spark.createDataFrame(list(got.items()), "node string, community string")).first()
    assert row.n_communities == len(_groups(got)) and abs(row.modularity - found) < 1e-9


def test_communities_are_those_of_the_sequential_way_where_they_are_plain():
    for edges in (CLIQUES, HUBS):
        links = _matrix(edges)
        assert abs(_modularity(links, communities.local_communities([(a, b, w) for (a, b), w in links.items()], float(sum(links.values())))) - _modularity(links, _sequential(links))) < 1e-9


def test_every_round_raises_modularity(monkeypatch):
    """Large random graphs: what each level returns is never worse than the level before."""
    for seed in range(20):
        links = _matrix(_random_graph(seed, 30, 200))
        twice = float(sum(links.values()))
        c = communities.local_level([(a, b, w) for (a, b), w in links.items()], twice)
        assert _modularity(links, c) > _modularity(links, {a: a for a, _ in links})


def test_communities_of_nothing(spark):
    none = _triples(spark, [("a", "b")]).limit(0)
    assert communities.louvain(none).collect() == [] and communities.louvain(none, 0).collect() == []
    assert communities.modularity(none, spark.createDataFrame([], "node string, community string")).first().modularity is None


# ---------------------------------------------------------------- paths


@pytest.mark.parametrize("most, hub", [(1, 10_000), (2, 3), (3, 3), (3, 10_000)])
def test_paths(spark, monkeypatch, most, hub):
    """The smallest of the shortest paths, by writing out all of them; a node of many links in pieces."""
    monkeypatch.setattr(graph, "HUB_LINKS", hub)
    edges = [*_random_graph(9, 40, 45), *((f"hub{k % 2}", f"N0-{k}") for k in range(12)), ("same", "same"), (None, "x")]
    near = defaultdict(set)
    for a, b, *_ in edges:
        if a and b and a.lower() != b.lower():
            near[a.lower()].add(b.lower())
            near[b.lower()].add(a.lower())
    names = sorted(near)
    starts, goals = [*names[:15], "nowhere", "hub0"], [*names[5:], "hub1"]
    want = {}
    for s in set(starts):
        level, seen = {s: (s,)}, {s}
        for hop in range(1, most + 1):
            after = {}
            for v, p in level.items():
                for w in near[v] - seen:
                    after[w] = min(after.get(w, (*p, w)), (*p, w))
            seen |= after.keys()
            level = after
            want |= {(s, g): (hop, after[g]) for g in set(goals) if g in after}
    frame = lambda names: spark.createDataFrame([(n,) for n in names], "node string")
    got = graph.paths(_triples(spark, edges), frame(starts * 2), frame(goals), most).collect()
    assert {(r.start, r.goal): (r.hops, tuple(r.path)) for r in got} == want and len(got) == len(want)


def test_rounds_are_few(monkeypatch):
    """A random graph without communities: half of the wishes are met at once, so a level is a few dozen rounds."""
    rng = random.Random(5)
    links = _matrix([(f"s{rng.randrange(60)}", f"p{rng.randrange(1500)}") for _ in range(12_000)])
    rounds, drawn = [], communities.hashlib.md5
    monkeypatch.setattr(communities.hashlib, "md5", lambda x: (rounds.append(x.split()[0]), drawn(x))[1])
    c = communities.local_level([(a, b, w) for (a, b), w in links.items()], float(sum(links.values())))
    assert len(set(rounds)) < 80 and _modularity(links, c) > 0.05
