"""Graph operators over triples or edge tables: neighbours, components, inference, paths, centrality."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from subjectlens.functions.text import short_predicate
from subjectlens.operators.relational import batched
from subjectlens.operators.tables import written


def adjacency(triples: DataFrame, directed: bool = True) -> DataFrame:
    """(node, neighbours): sorted sets of lower-cased names."""
    links = triples.select(F.lower("s").alias("node"), F.lower("o").alias("other"))
    if not directed:
        links = links.union(links.select("other", "node"))
    return links.groupBy("node").agg(F.array_sort(F.collect_set("other")).alias("neighbours"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges(u, v); root is the smallest node that can be reached.

    Star contraction: each round links every node to the smallest in reach, so rounds grow with the logarithm of the
    largest component, and each starts from files in the shared folder. Minima are partial aggregates joined back, one
    row a node, so a node with very many neighbours is never gathered; the join's partitions that it makes large are
    split by adaptive execution. Nulls are ignored; a loop of a node to itself keeps it as its own root.
    """
    e = edges.filter("u is not null and v is not null").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    nodes = written(e.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "nodes")
    e = written(e.filter("u <> v"), "edges")
    before = None
    while True:
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).withColumnRenamed("u", "x")
        large = both.join(low, F.col("u") == F.col("x")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "x")
        small = large.join(low, F.col("u") == F.col("x")).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e = written(small.filter("u <> v").distinct(), "edges")
        after = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if after == before:
            break
        before = after
    root = e.groupBy("u").agg(F.min("v").alias("root"))
    return nodes.join(root, F.col("node") == F.col("u"), "left").select("node", F.coalesce("root", "node").alias("root"))


#: Links (both ways) of the small components that share a task, about.
LINKS_A_TASK = 1_000_000


def parted(pairs: DataFrame, most: int, roots: DataFrame | None = None) -> tuple[DataFrame | None, DataFrame | None]:
    """A table of pairs(u, v, ...), u <= v, in two: whole components of up to `most` links (both ways) with the part that a task takes, and the others.

    Either is None if there are none. Components are found only where there are more links in all; roots(node, root) are
    they, if known.
    """
    n = 2 * pairs.count()
    if n <= most:
        return pairs.withColumn("part", F.lit("")), None
    if not most:
        return None, pairs
    roots = components(pairs) if roots is None else roots
    rows = written(pairs.join(roots.withColumnRenamed("node", "u"), "u"), "parts")
    sizes = written(rows.groupBy("root").agg((2 * F.count("*")).alias("links")), "parts")
    small, packs = F.col("links") < min(LINKS_A_TASK, most), max(1, n // LINKS_A_TASK)
    part = F.when(small, F.concat(F.lit("small "), F.pmod(F.xxhash64("root"), F.lit(packs)))).otherwise(F.concat(F.lit("one "), "root"))
    kept = sizes.filter(F.col("links") <= most).select("root", part.alias("part"))
    within = rows.join(kept, "root").drop("root")
    if sizes.filter(F.col("links") > most).isEmpty():
        return within, None
    return within, rows.join(kept, "root", "left_anti").drop("root")


def numbered(rows: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct names of rows(u, v) in their order, and the numbers of u and v."""
    ends = pa.chunked_array([*rows["u"].chunks, *rows["v"].chunks], pa.string())
    names = pc.unique(ends)
    names = names.take(pc.sort_indices(names))
    codes = np.asarray(pc.index_in(ends, value_set=names))
    return names, codes[: len(rows)], codes[len(rows) :]


#: Links that a task has in its hands at once, about, beside the graph itself.
LINKS_A_SLICE = 1_000_000


def slices(u: np.ndarray) -> Iterator[slice]:
    """Slices of the sorted u of links, each with all links of its nodes."""
    a = 0
    while a < len(u):
        b = min(len(u), a + LINKS_A_SLICE)
        if b < len(u) and (b := int(np.searchsorted(u, u[b]))) <= a:
            b = int(np.searchsorted(u, u[a], "right"))
        yield slice(a, b)
        a = b


def weak_components(edges: DataFrame) -> DataFrame:
    """(node, component) for edges(s, o): the smallest name that can be reached."""
    return components(edges.select(F.lower("s").alias("u"), F.lower("o").alias("v"))).withColumnRenamed("root", "component")


def transitive(triples: DataFrame, confidence: float = 0.6) -> DataFrame:
    """A to c by way of b where no edge from a to c is known: INDIRECTLY_p if both predicates agree, else VIA_b.

    The predicate of a pair is its last in input order.
    """
    e = triples.groupBy(F.lower("s").alias("s"), F.lower("o").alias("o")).agg(F.max_by("p", "seq").alias("p"))
    a, b = e.select(F.col("s").alias("a"), F.col("o").alias("b"), F.col("p").alias("p1")), e.select(F.col("s").alias("b"), F.col("o").alias("c"), F.col("p").alias("p2"))
    found = a.join(b, "b").filter("a <> c").join(e.select(F.col("s").alias("a"), F.col("o").alias("c")), ["a", "c"], "left_anti")
    p = F.when(F.col("p1") == F.col("p2"), F.concat(F.lit("INDIRECTLY_"), "p1")).otherwise(F.concat(F.lit("VIA_"), F.left("b", F.lit(10))))
    return found.select(F.col("a").alias("s"), short_predicate(p).alias("p"), F.col("c").alias("o"), F.lit(confidence).alias("confidence"), F.col("b").alias("via"))


def similar_names(names: DataFrame, existing: DataFrame, least: float = 0.8) -> DataFrame:
    """(s, o, confidence): pairs of names(name) whose word sets have a Jaccard similarity of at least `least`, s < o.

    Prefix filter: words are numbered by rarity, and similar names share words among their first, rarest ones. Above a
    similarity of one half two words at least are shared, so names meet under pairs of words, which are far rarer than
    words. Sizes are compared before names meet, candidates are numbers, and the words come back once to verify them.
    Pairs that existing(s, o) links either way are left out.
    """
    words = F.array_distinct(F.filter(F.split(F.lower("name"), r"\s+"), lambda w: w != ""))
    rows = names.select("name", words.alias("w")).filter(F.size("w") > 0).distinct()
    flat = rows.select("name", F.explode("w").alias("x"))
    counts = flat.groupBy("x").agg(F.count("*").alias("c"))
    ordered = flat.join(counts, "x").groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", F.xxhash64("x").alias("h")))), lambda x: x["h"]).alias("w"))
    ordered = written(ordered.select(F.xxhash64("name", F.lit("name")).alias("id"), "name", "w"), "names")
    n, share = F.size("w"), 2 if least > 0.5 else 1
    head = F.slice("w", F.lit(1), F.least(n, (n - F.ceil(least * n) + share).cast("int")))
    if share == 2:
        pairs_of = F.flatten(F.transform(head, lambda a, i: F.transform(F.slice(head, i + 2, F.size(head)), lambda b: F.xxhash64(F.least(a, b), F.greatest(a, b)))))
        keys = F.when(n == 1, head).otherwise(pairs_of)
    else:
        keys = head
    keyed = ordered.select("id", n.alias("n"), F.explode(keys).alias("key"))
    left = keyed.select("key", F.col("id").alias("i"), F.col("n").alias("m"))
    right = keyed.select("key", F.col("id").alias("j"), "n")
    met = left.join(right, "key").filter((F.col("i") < F.col("j")) & (F.col("n") >= least * F.col("m")) & (F.col("m") >= least * F.col("n")))
    met = met.select("i", "j").distinct()
    of = lambda i, name, w: ordered.select(F.col("id").alias(i), F.col("name").alias(name), F.col("w").alias(w))
    both = met.join(of("i", "x", "a"), "i").join(of("j", "y", "b"), "j")
    shared = F.size(F.array_intersect("a", "b"))
    both = both.withColumn("confidence", shared / (F.size("a") + F.size("b") - shared)).filter(F.col("confidence") >= least)
    pairs = both.select(F.least("x", "y").alias("s"), F.greatest("x", "y").alias("o"), "confidence")
    known = existing.select(F.lower("s").alias("s"), F.lower("o").alias("o"))
    return pairs.join(known.union(known.select("o", "s")).distinct(), ["s", "o"], "left_anti")


#: Links of a node that one piece of it holds, about; a node with more is dealt out in pieces.
HUB_LINKS = 10_000


def _reached(links: DataFrame, hubs: DataFrame, ends: DataFrame, depth: int, key: str, forward: bool) -> DataFrame:
    """(key, at, hops, path): the nodes up to `depth` hops from ends(node), each at its first hop with the smallest path.

    Forward paths lead from the end to the node, backward ones from the node to the end.
    """
    front = ends.select(F.col("node").alias(key), F.col("node").alias("at"), F.array("node").alias("path")).distinct()
    seen = front.select(key, "at", F.lit(0).alias("hops"), "path")
    for hop in range(1, depth + 1):
        dealt = front.join(hubs, "at", "left").withColumn("piece", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("pieces"), F.lit(1)) - 1)))
        met = dealt.join(links, (F.col("at") == F.col("x")) & (F.col("piece") == F.col("part")))
        step = met.select(key, F.col("y").alias("at"), (F.concat("path", F.array("y")) if forward else F.concat(F.array("y"), "path")).alias("path"))
        front = step.groupBy(key, "at").agg(F.min("path").alias("path")).join(seen.select(key, "at"), [key, "at"], "left_anti")
        front = written(front, "paths")
        seen = seen.unionByName(front.withColumn("hops", F.lit(hop)))
    return seen


def paths(triples: DataFrame, starts: DataFrame, goals: DataFrame, most: int = 3) -> DataFrame:
    """(start, goal, hops, path): the first shortest undirected path of at most `most` hops from each start to each goal.

    Searched from both sides: half of the hops from the starts, half from the goals, and where the two meet the hops add
    up; so with three hops neither side goes further than two. Frontiers keep one path, the smallest, for each end and
    node. A node with very many links is cut into pieces, and frontiers that reach it are copied to each.
    """
    e = triples.select(F.lower("s").alias("x"), F.lower("o").alias("y"))
    e = e.union(e.select("y", "x")).filter("x <> y").distinct()
    pieces = F.ceil(F.count("*") / HUB_LINKS).cast("int")
    links = written(e, "paths")
    hubs = written(links.groupBy(F.col("x").alias("at")).agg(pieces.alias("pieces")).filter("pieces > 1"), "paths")
    number = hubs.select(F.col("at").alias("hub"), "pieces")
    part = F.pmod(F.xxhash64("y"), F.coalesce(F.col("pieces"), F.lit(1))).cast("int").alias("part")
    links = written(links.join(number, F.col("x") == F.col("hub"), "left").select("x", "y", part), "paths")
    there = _reached(links, hubs, starts, most - most // 2, "start", True).withColumnRenamed("hops", "h1")
    back = _reached(links, hubs, goals, most // 2, "goal", False).withColumnRenamed("hops", "h2").withColumnRenamed("path", "rest")
    met = there.join(back, "at").select("start", "goal", (F.col("h1") + F.col("h2")).alias("hops"), F.concat("path", F.slice("rest", 2, F.size("rest"))).alias("path"))
    best = F.min(F.struct("hops", "path")).alias("x")
    return met.filter("hops > 0 and start <> goal").groupBy("start", "goal").agg(best).select("start", "goal", "x.hops", "x.path")


def chain_edges(found: DataFrame, confidence: float = 0.8) -> DataFrame:
    """Paths as CONNECTS_TO edges; (start, goal, step, s, o, confidence)."""
    steps = F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.struct(F.element_at("path", i).alias("s"), F.element_at("path", i + 1).alias("o")))
    return found.select("start", "goal", F.posexplode(steps).alias("step", "x")).select("start", "goal", "step", "x.s", "x.o", F.lit(confidence).alias("confidence"))


def degree_centrality(triples: DataFrame) -> DataFrame:
    """Degree / (n - 1) on the simple undirected graph."""
    e = triples.select(F.lower("s").alias("u"), F.lower("o").alias("v")).filter("u <> v")
    both = e.union(e.select("v", "u")).distinct()
    degree = both.groupBy("u").agg(F.count("*").alias("degree"))
    n = degree.agg(F.count("*").alias("n"))
    return degree.join(F.broadcast(n)).select(F.col("u").alias("node"), "degree", F.try_divide(F.col("degree").cast("double"), F.col("n") - 1).alias("centrality"))


def eigenvector_centrality(triples: DataFrame, rounds: int = 100, tolerance: float = 1e-6, together: int = 4) -> DataFrame:
    """Power iteration by joins; stops when the mean change is below the tolerance, 0 for all if it never is.

    Nodes with one neighbour that hang on the same node have the same score in every round, so that node carries their
    score and number, and rounds pass over the links of the others only. `together` rounds make one job, which writes its
    result; one more reads the norm and the change of the last round.
    """
    e = triples.select(F.lower("s").alias("u"), F.lower("o").alias("v")).filter("u <> v")
    both = written(e.union(e.select("v", "u")).distinct(), "eigen")
    ends = both.groupBy("u").agg(F.count("*").alias("degree"), F.min("v").alias("hub"))
    hubs = ends.select(F.col("u").alias("hub"), F.col("degree").alias("other"))
    # of a pair that is linked to nothing else, one hangs on the other
    hangs = (F.col("degree") == 1) & ((F.col("other") > 1) | (F.col("u") > F.col("hub")))
    nodes = written(ends.join(hubs, "hub").select(F.col("u").alias("node"), "hub", hangs.alias("hangs")), "eigen")
    leaves, core = nodes.filter("hangs").select("node", "hub"), nodes.filter("not hangs").select("node")
    one = F.lit(1.0)
    x = core.join(leaves.groupBy(F.col("hub").alias("node")).agg(F.count("*").alias("m")), "node", "left")
    x = written(x.select("node", one.alias("x"), one.alias("leaf"), F.coalesce("m", F.lit(0)).alias("m")), "eigen")
    links = written(both.join(core, F.col("u") == F.col("node"), "left_semi").join(core, F.col("v") == F.col("node"), "left_semi"), "eigen")
    n = x.agg(F.sum(F.col("m") + 1)).first()[0] or 0

    def step(x: DataFrame) -> DataFrame:
        """x: a node's score; leaf, m: the score and number of the nodes that hang on it."""
        sent = links.join(x.select("node", "x"), F.col("v") == F.col("node")).select(F.col("u").alias("node"), "x", F.lit(0.0).alias("leaf"), F.lit(0).cast("long").alias("m"))
        own = x.select("node", (F.col("x") + F.col("m") * F.col("leaf")).alias("x"), (F.col("leaf") + F.col("x")).alias("leaf"), "m")
        return own.unionByName(sent).groupBy("node").agg(F.sum("x").alias("x"), F.sum("leaf").alias("leaf"), F.sum("m").alias("m"))

    norm_of = lambda x, leaf: F.sqrt(F.sum(F.col(x) * F.col(x) + F.col("m") * F.col(leaf) * F.col(leaf)))
    moved = lambda y, x: F.abs(F.col(y) / F.col("b") - F.col(x) / F.col("a"))
    for _ in range(0, rounds, together):
        for _ in range(together - 1):
            x = step(x)
        y = written(step(x).select("node", F.col("x").alias("y"), F.col("leaf").alias("y_leaf")).join(x, "node"), "eigen")
        norms = F.broadcast(y.agg(norm_of("x", "leaf").alias("a"), norm_of("y", "y_leaf").alias("b")))  # one row
        last = y.join(norms).agg(F.first("b").alias("norm"), F.sum(moved("y", "x") + F.col("m") * moved("y_leaf", "leaf")).alias("off")).first()
        norm = last.norm or 1.0
        x = y.select("node", (F.col("y") / norm).alias("x"), (F.col("y_leaf") / norm).alias("leaf"), "m")
        if (last.off or 0.0) < n * tolerance:
            break
    else:
        return nodes.select("node", F.lit(0.0).alias("centrality"))
    hung = leaves.join(x.select(F.col("node").alias("hub"), "leaf"), "hub").select("node", F.col("leaf").alias("centrality"))
    return x.select("node", F.col("x").alias("centrality")).unionByName(hung)


#: Links (both ways) of a component up to which its labels pass in one task.
LOCAL_LINKS = 8_000_000


def _labels(rounds: int):
    def run(rows: pa.Table) -> pa.Table:
        names, u, v = numbered(rows)
        u, v, w, n = np.r_[u, v], np.r_[v, u], np.tile(np.asarray(rows["w"]), 2), len(names)
        order = np.argsort(u, kind="stable")
        u, v, w, label = u[order], v[order], w[order], np.arange(n)
        for _ in range(rounds):
            best = []
            for part in slices(u):  # every node has a link
                key = u[part] * np.int64(n) + label[v[part]]
                order = np.argsort(key, kind="stable")
                key = key[order]
                first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                votes, key = np.round(np.add.reduceat(w[part][order], first), 6), key[first]
                at, to = key // n, key % n
                first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                most = np.repeat(np.maximum.reduceat(votes, first), np.diff(np.r_[first, len(at)]))
                best.append(np.minimum.reduceat(np.where(votes == most, to, n), first))
            label = np.concatenate(best)
        return pa.table({"node": names, "community": names.take(pa.array(label))})

    return run


def label_propagation(triples: DataFrame, rounds: int = 5, local: int = LOCAL_LINKS, roots: DataFrame | None = None) -> DataFrame:
    """(node, community), a quicker and coarser way than louvain: each round a node takes the label with the largest total confidence around it, ties to the smaller.

    Tasks work on whole components as arrays, in a component of more than `local` links each round is a join. roots(node,
    root) are the components, if known.
    """
    a, b = F.lower("s"), F.lower("o")
    pairs = triples.filter("s is not null and o is not null").select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"), "confidence").filter("u <> v")
    pairs = written(pairs.groupBy("u", "v").agg(F.coalesce(F.sum("confidence"), F.lit(0.0)).alias("w")), "labels")
    small, huge = parted(pairs, local, roots)
    found = None if small is None else small.groupBy("part").applyInArrow(_labels(rounds), "node string, community string")
    if huge is not None:
        e = written(huge.union(huge.select("v", "u", "w")), "labels")
        label = e.select(F.col("u").alias("node")).distinct().withColumn("community", F.col("node"))
        for _ in range(rounds):
            votes = e.join(label, F.col("v") == F.col("node")).groupBy("u", "community").agg(F.round(F.sum("w"), 6).alias("w"))
            best = votes.groupBy("u").agg(F.min_by("community", F.struct((-F.col("w")).alias("a"), F.col("community").alias("b"))).alias("community"))
            label = written(best.withColumnRenamed("u", "node"), "labels")
        found = label if found is None else found.unionByName(label)
    return found


# ---- fixed values

COMMUNITY_COLORS = ("#1f77b4", "#ff7f0e", "#2ca02c", "#d62728", "#9467bd", "#8c564b", "#e377c2", "#7f7f7f", "#bcbd22", "#17becf")
#: Weights of degree, betweenness and eigenvector centrality.
CENTRALITY_WEIGHTS = (0.4, 0.4, 0.2)

# ---- end of fixed values


def colored(members: DataFrame) -> DataFrame:
    """members(node, community) with a color by the community's place in the order of communities."""
    number = batched(members.select("community").distinct(), 1, F.col("community")).withColumnRenamed("batch", "number")
    color = F.element_at(F.array(*map(F.lit, COMMUNITY_COLORS)), (F.col("number") % len(COMMUNITY_COLORS) + 1).cast("int"))
    return members.join(number, "community").select("node", "community", color.alias("color"))


def entity_groups(triples: DataFrame, entities: DataFrame, most: int = 3, connections: int = 5) -> DataFrame:
    """(entity, related, confidence, connections) for entities(entity).

    related: up to `most` neighbours, the first by name; confidence 0.8 with some, else 0.4; connections: the first of
    the triples with both ends in the group, in input order, as text.
    """
    e = triples.select(F.lower("s").alias("x"), F.lower("o").alias("y"))
    both = e.union(e.select("y", "x"))
    named = entities.select("entity", F.lower("entity").alias("low")).distinct()
    near = named.join(both, F.col("low") == F.col("x"), "left").groupBy("entity", "low").agg(F.slice(F.array_sort(F.collect_set("y")), 1, most).alias("related"))
    members = near.select("entity", F.explode(F.array_union("related", F.array("low"))).alias("m"))
    inner = members.withColumnRenamed("m", "m1").join(triples, F.col("m1") == F.lower("s")).join(members.select(F.col("entity").alias("same"), F.col("m").alias("m2")), (F.col("entity") == F.col("same")) & (F.lower("o") == F.col("m2")))
    first = F.row_number().over(W.partitionBy("entity").orderBy("seq"))
    inner = inner.withColumn("r", first).filter(F.col("r") <= connections)
    shown = F.concat("s", F.lit(" --["), "p", F.lit("]--> "), "o")
    lines = inner.groupBy("entity").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", shown.alias("x")))), lambda z: z["x"]).alias("connections"))
    confidence = F.when(F.size("related") > 0, 0.8).otherwise(0.4)
    return near.join(lines, "entity", "left").select("entity", "related", confidence.alias("confidence"), F.coalesce("connections", F.array().cast("array<string>")).alias("connections"))


def probes(sources: DataFrame, targets: DataFrame, relations: list[str], ends: int = 2, most: int = 3) -> DataFrame:
    """(source, relation, target) to ask about: the first entities of each pair of groups, equal ones left out.

    sources and targets: groups (pair, entity, related); groups with one `pair` are asked about together.
    """
    members = lambda df, name: df.select("pair", F.posexplode(F.slice(F.concat(F.array("entity"), "related"), 1, ends)).alias(f"{name}_at", name))
    grid = members(sources, "source").join(members(targets, "target"), "pair").filter(F.lower("source") != F.lower("target"))
    return grid.select("pair", "source", F.explode(F.array(*map(F.lit, relations[:most]))).alias("relation"), "target")


def veracity(verdict) -> tuple:
    """A reply's verdict as yes, no or maybe, and whether the edge is factual or counterfactual."""
    low = F.lower(F.coalesce(verdict, F.lit("maybe")))
    label = F.when(low.isin("yes", "no"), low).otherwise("maybe")
    return label, label == "yes", label == "no"


def within_communities(members: DataFrame, replies: DataFrame, triples: DataFrame, least: int = 3, most: int = 5) -> DataFrame:
    """A model's replies(community, place, s, p, o, confidence) as inferred triples.

    Only communities of at least `least` members are asked; the first `most` replies of each count, and those whose ends
    a triple links either way are dropped.
    """
    asked = members.groupBy("community").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("community")
    known = triples.select(F.lower("s").alias("a"), F.lower("o").alias("b"))
    known = known.union(known.select("b", "a")).distinct()
    whole = F.col("s").isNotNull() & F.col("p").isNotNull() & F.col("o").isNotNull()
    kept = replies.filter(F.col("place") < most).filter(whole).join(asked, "community", "left_semi")
    fresh = kept.join(known, (F.lower("s") == F.col("a")) & (F.lower("o") == F.col("b")), "left_anti")
    return fresh.select("s", short_predicate(F.col("p")).alias("p"), "o", F.coalesce("confidence", F.lit(0.5)).alias("confidence"), F.lit(True).alias("inferred"))


def asked_members(members: DataFrame, least: int = 3, most: int = 10) -> DataFrame:
    """The members, up to `most` of each community of at least `least`, that a model is asked about."""
    placed = members.withColumn("r", F.row_number().over(W.partitionBy("community").orderBy("node")))
    sizes = members.groupBy("community").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return placed.filter(F.col("r") <= most).join(sizes, "community").groupBy("community").agg(F.array_sort(F.collect_list("node")).alias("entities"))


def fully_inferred(triples: DataFrame, replies: DataFrame, least: float = 0.8) -> DataFrame:
    """Direct triples(s, p, o, confidence, seq) and what follows from them, from alike names and from a model's
    replies(s, p, o, confidence): each once, predicates in short form, without self-references."""
    direct = triples.select("s", "p", "o", "confidence", F.lit(False).alias("inferred"), F.lit(0).alias("rank"), "seq")
    none = F.lit(0).cast("long").alias("seq")
    added = lambda df, rank: df.select("s", "p", "o", "confidence", F.lit(True).alias("inferred"), F.lit(rank).alias("rank"), none)
    names = triples.select(F.explode(F.array(F.lower("s"), F.lower("o"))).alias("name"))
    alike = similar_names(names, triples, least).withColumn("p", F.lit("SIMILAR_TO"))
    every = direct.unionByName(added(replies, 1)).unionByName(added(transitive(triples), 2)).unionByName(added(alike, 3))
    columns = ["s", "p", "o", "confidence", "inferred"]
    best = F.max_by(F.struct(*columns), F.struct("confidence", -F.col("rank"), -F.col("seq"), F.col("s"), F.col("o"))).alias("x")
    once = every.groupBy(F.lower("s").alias("a"), F.upper("p").alias("b"), F.lower("o").alias("c")).agg(best).select("x.*")
    return once.withColumn("p", short_predicate(F.col("p"))).filter(F.lower("s") != F.lower("o"))


def node_sizes(scores: DataFrame, score: str, low: int = 10, high: int = 50) -> DataFrame:
    """Scores scaled to whole sizes between low and high."""
    ends = scores.agg(F.min(score).alias("__low"), F.max(score).alias("__high"))
    scaled = F.when(F.col("__high") > F.col("__low"), (F.col(score) - F.col("__low")) / (F.col("__high") - F.col("__low"))).otherwise(0.5)
    return scores.join(F.broadcast(ends)).withColumn("size", (low + scaled * (high - low)).cast("int")).drop("__low", "__high")


def cross_pairs(members: DataFrame, most: int = 3, communities: int = 5) -> DataFrame:
    """Up to `most` representatives of each of the `communities` largest communities of members(node, community)."""
    sizes = members.groupBy("community").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "community").limit(communities)
    rows = members.join(F.broadcast(sizes), "community")
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("community").orderBy("node"))).filter(F.col("rank") <= most)
