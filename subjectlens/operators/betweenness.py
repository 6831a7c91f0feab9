"""Betweenness centrality: shortest paths counted on compact arrays, component by component."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subjectlens.operators.graph import CENTRALITY_WEIGHTS, components, degree_centrality, eigenvector_centrality
from subjectlens.operators.tables import written

#: A component of more links (both ways) is not gathered in a task; its levels are joins.
MOST_LINKS = 4_000_000
#: Links of the small components that share a task, and steps along links that a task makes, about.
LINKS_A_TASK, STEPS_A_TASK = 1_000_000, 500_000_000
#: Sources of a block at least, so that the links which come with it are few against its steps.
LEAST_SOURCES = 256
#: (source, node) and (source, link) pairs that a task holds at once.
CELLS = 4_000_000


def dependencies(start: np.ndarray, to: np.ndarray, sources: np.ndarray) -> np.ndarray:
    """By node, the sum over the sources of the share of their shortest paths that run through it.

    The graph's links go from node x to to[start[x] : start[x + 1]]. All sources advance together: levels outwards, each
    with its number of shortest paths, then back, each node passing on its share of the paths of those after it.
    """
    n, k = len(start) - 1, len(sources)
    degree = np.diff(start)
    depth, paths = np.full(n * k, -1, np.int32), np.zeros(n * k)
    front = np.arange(k) * n + sources
    depth[front], paths[front] = 0, 1.0
    steps = []
    while len(front):
        node = front % n
        d = degree[node]
        link = np.arange(int(d.sum())) - np.repeat(np.cumsum(d) - d - start[node], d)
        near, far = np.repeat(front, d), np.repeat(front - node, d) + to[link]
        new = depth[far] < 0
        near, far = near[new], far[new]
        front, place = np.unique(far, return_inverse=True)
        depth[front] = len(steps) + 1
        paths[front] = np.bincount(place, paths[near], len(front)) if len(front) else 0
        steps.append((near, far))
    passed = np.zeros(n * k)
    for near, far in reversed(steps):
        np.add.at(passed, near, paths[near] / paths[far] * (1 + passed[far]))
    passed[np.arange(k) * n + sources] = 0
    return passed.reshape(k, n).sum(0)


def _in_tasks(links: DataFrame, sizes: DataFrame) -> DataFrame:
    """(node, part) of components that fit into a task; links(u, v, root), sizes(root, nodes, links)."""
    total = sizes.filter(F.col("links") < LINKS_A_TASK).agg(F.sum("links")).first()[0] or 0
    packs = max(1, math.ceil(total / LINKS_A_TASK))
    share = F.greatest(F.lit(float(LEAST_SOURCES)), F.lit(float(STEPS_A_TASK)) / F.col("links"))
    blocks = F.when(F.col("links") < LINKS_A_TASK, F.lit(None)).otherwise(F.ceil(F.col("nodes") / share)).cast("long")
    dealt = sizes.select("root", blocks.alias("blocks")).select("root", "blocks", F.when(F.col("blocks").isNull(), F.pmod(F.xxhash64("root"), F.lit(packs))).alias("pack"))
    small = sizes.filter(F.col("links") < LINKS_A_TASK).select(F.pmod(F.xxhash64("root"), F.lit(packs)).alias("pack"), "nodes", "links").groupBy("pack").agg(F.sum("nodes").alias("nodes"), F.sum("links").alias("links"))
    small = small.select("pack", F.ceil(F.col("nodes") / share).cast("long").alias("pack_blocks"))
    rows = links.join(dealt, "root").join(small, "pack", "left")
    rows = rows.withColumn("blocks", F.coalesce("blocks", "pack_blocks", F.lit(1).cast("long")))
    rows = rows.select("u", "v", "blocks", F.when(F.col("pack").isNull(), F.col("root")).otherwise(-1 - F.col("pack")).alias("pack"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        names, codes = np.unique(np.r_[rows.u.to_numpy(), rows.v.to_numpy()], return_inverse=True)
        n, u, v = len(names), codes[: len(rows)], codes[len(rows) :]
        order = np.argsort(u, kind="stable")
        start, to = np.r_[0, np.cumsum(np.bincount(u, minlength=n))], v[order]
        own = np.flatnonzero(names % int(rows.blocks.iloc[0]) == int(rows.block.iloc[0]))
        at_once, part = max(1, CELLS // max(n, len(to))), np.zeros(n)
        for i in range(0, len(own), at_once):
            part += dependencies(start, to, own[i : i + at_once])
        through = np.flatnonzero(part)
        return pd.DataFrame({"node": names[through], "part": part[through]})

    return rows.groupBy("pack", "block").applyInPandas(run, "node long, part double")


def _by_levels(links: DataFrame, nodes: DataFrame, block: int, blocks: int) -> DataFrame:
    """(node, part) from one block of sources, every step a join: for components that no task can hold."""
    own = nodes.filter(F.pmod("node", F.lit(blocks)) == block)
    levels = [written(own.select(F.col("node").alias("source"), "node", F.lit(1.0).alias("paths")), "between")]
    seen = levels[0].select("source", "node")
    while True:
        step = levels[-1].join(links, F.col("node") == F.col("u")).groupBy("source", F.col("v").alias("node")).agg(F.sum("paths").alias("paths"))
        front = written(step.join(seen, ["source", "node"], "left_anti"), "between")
        if front.isEmpty():
            break
        levels.append(front)
        seen = seen.unionByName(front.select("source", "node"))
    passed, total = None, nodes.limit(0).select("node", F.lit(0.0).alias("part"))
    for depth in range(len(levels) - 1, 0, -1):
        front = levels[depth]
        own = front.withColumn("part", F.lit(0.0)) if passed is None else front.join(passed, ["source", "node"], "left").withColumn("part", F.coalesce("got", F.lit(0.0)))
        own = written(own.select("source", "node", "paths", "part"), "between")
        total = total.unionByName(own.select("node", "part"))
        before = levels[depth - 1].select(F.col("source").alias("from"), F.col("node").alias("near"), F.col("paths").alias("less"))
        back = own.join(links, F.col("node") == F.col("v")).join(before, (F.col("source") == F.col("from")) & (F.col("u") == F.col("near")))
        passed = back.groupBy("source", F.col("u").alias("node")).agg(F.sum(F.col("less") / F.col("paths") * (1 + F.col("part"))).alias("got"))
    return written(total.groupBy("node").agg(F.sum("part").alias("part")), "between")


def betweenness_centrality(triples: DataFrame, most_links: int = MOST_LINKS) -> DataFrame:
    """(node, centrality): the share of shortest paths between other nodes that run through a node, undirected.

    Exact. Only nodes of one component have paths, so components are found first. A task gets whole components as
    numbers: small ones together, a large one with one block of its nodes as sources, whose parts are summed; it counts
    paths on compact arrays for as many sources at once as CELLS allows. A component of more than `most_links` links
    is never gathered: there every level is a join over (source, node) pairs, one block of sources after the other.

    Names are compared in lower case; directions, repeats, loops and nulls don't count. Up to two nodes: all zero.
    """
    e = triples.filter("s is not null and o is not null").select(F.lower("s").alias("a"), F.lower("o").alias("b"))
    names = written(e.select(F.explode(F.array("a", "b")).alias("name")).distinct().withColumn("node", F.monotonically_increasing_id()), "between")
    of = lambda name, node: names.select(F.col("name").alias(name), F.col("node").alias(node))
    apart = e.filter("a <> b").distinct().join(of("a", "u"), "a").join(of("b", "v"), "b").select("u", "v")
    both = written(apart.union(apart.select("v", "u")).distinct(), "between")
    roots = components(both)
    links = written(both.join(roots.withColumnRenamed("node", "u"), "u").select("u", "v", "root"), "between")
    sizes = written(links.groupBy("root").agg(F.count_distinct("u").alias("nodes"), F.count("*").alias("links")).filter("nodes > 2"), "between")
    parts = _in_tasks(links.join(sizes.filter(F.col("links") <= most_links).select("root"), "root", "left_semi"), sizes.filter(F.col("links") <= most_links))
    huge = sizes.filter(F.col("links") > most_links)
    if steps := huge.agg(F.sum(F.col("nodes").cast("double") * F.col("links"))).first()[0]:
        rest = written(links.join(huge.select("root"), "root", "left_semi").select("u", "v"), "between")
        nodes = rest.select(F.col("u").alias("node")).distinct()
        blocks = max(1, math.ceil(steps / STEPS_A_TASK / 1000))
        for block in range(blocks):
            parts = parts.unionByName(_by_levels(rest, nodes, block, blocks))
    n = names.count()
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    through = parts.groupBy("node").agg(F.sum("part").alias("part"))
    return names.join(through, "node", "left").select(F.col("name").alias("node"), (F.coalesce("part", F.lit(0.0)) * scale).alias("centrality"))


def combined_centrality(triples: DataFrame) -> DataFrame:
    """(node, centrality) from degree, betweenness and eigenvector centrality."""
    parts = degree_centrality(triples), betweenness_centrality(triples), eigenvector_centrality(triples)
    out = parts[1].select("node", F.col("centrality").alias("c1"))
    for k in (0, 2):
        out = out.join(parts[k].select("node", F.col("centrality").alias(f"c{k}")), "node", "left")
    weighted = sum((w * F.coalesce(f"c{k}", F.lit(0.0)) for k, w in enumerate(CENTRALITY_WEIGHTS)), F.lit(0.0))
    return out.select("node", weighted.alias("centrality"))
