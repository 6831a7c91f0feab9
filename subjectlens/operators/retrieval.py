"""Retrieval: exact vector search, keyword search, fusion of ranked results."""

from __future__ import annotations

from collections.abc import Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from subjectlens.functions.text import SEARCH_STOPWORDS, excerpt, excerpts
from subjectlens.functions.values import cosine
from subjectlens.operators.relational import first_per


def vector_search(vectors: DataFrame, query: list[float], k: int = 10, least: float | None = None) -> DataFrame:
    """The k vectors(vec_id, embedding) nearest to the query by cosine; each task keeps k rows."""
    score = cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in query]))
    out = vectors.withColumn("score", score)
    return (out if least is None else out.filter(F.col("score") >= least)).orderBy(F.desc("score"), "vec_id").limit(k)


def keyword_hit(words: list[str], columns: list[str]) -> Column:
    """Whether every word is in some of the columns, whatever its case."""
    hit = F.lit(True)
    for w in words:
        some = F.lit(False)
        for c in columns:
            some = some | F.coalesce(F.contains(F.lower(F.col(c)), F.lit(w.lower())), F.lit(False))
        hit = hit & some
    return hit


def long_words(question: str, most: int | None = None) -> list[str]:
    """The words of more than two characters."""
    return [w for w in question.split() if len(w) > 2][:most]


def document_search(files: DataFrame, question: str, category: str | None = None, k: int = 10) -> DataFrame:
    """(id, title, type, content, score) of files whose texts hold all long words of the question.

    files(id, file_name, category, extracted_text, ai_summary, transcript, entities, created_at): those with a summary
    come first, then those with a text, then the newest. Content is made of what is filled, the score grows with it.
    """
    words = long_words(question)
    texts = ["extracted_text", "ai_summary", "transcript", "entities"]
    found = files.filter(keyword_hit(words, texts) if words else F.lit(False))
    if category:
        found = found.filter(F.lower("category") == category.lower())
    top = found.orderBy(F.col("ai_summary").isNull(), F.col("extracted_text").isNull(), F.desc("created_at"), "id").limit(k)
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    near = lambda c: F.concat(F.lit("..."), excerpt(F.col(c), _first_found(words, c), 500), F.lit("..."))
    parts = F.array_compact(
        F.array(
            F.concat(F.lit("AI Summary: "), filled("ai_summary")),
            F.concat(F.lit("Entities: "), F.left(filled("entities"), F.lit(500))),
            F.when(filled("extracted_text").isNotNull(), F.concat(F.lit("Extracted Text: "), near("extracted_text"))),
            F.when(filled("transcript").isNotNull(), F.concat(F.lit("Transcript: "), near("transcript"))),
        )
    )
    score = F.least(F.lit(1.0), F.lit(0.3) + F.size("parts") * 0.2)
    content = F.coalesce(F.nullif(F.array_join("parts", "\n\n"), F.lit("")), F.lit("No extracted content available."))
    return top.withColumn("parts", parts).select("id", F.col("file_name").alias("title"), F.coalesce("category", F.lit("document")).alias("type"), content.alias("content"), score.alias("score"))


def _first_found(words: list[str], column: str) -> Column:
    """The first of the words that a column holds."""
    low = F.lower(F.col(column))
    return F.coalesce(*[F.when(F.contains(low, F.lit(w.lower())), F.lit(w.lower())) for w in words], F.lit("\0"))


def holding(nodes: DataFrame, word: str, fold: bool = True) -> Column:
    """Whether some property of nodes(props), the embedding apart, holds the word."""
    shown = (lambda v: F.lower(v)) if fold else (lambda v: v)
    return F.exists(F.map_entries(nodes["props"]), lambda e: (e["key"] != "embedding") & F.coalesce(F.contains(shown(e["value"]), F.lit(word)), F.lit(False)))


def node_name(props: Column, labels: Column, *keys: str) -> Column:
    return F.coalesce(*[F.nullif(F.try_element_at(props, F.lit(k)), F.lit("")) for k in keys], F.get(labels, F.lit(0)))


#: Properties that results don't show.
HIDDEN = ("embedding", "updated_at", "created_at")


def shown_props(props: Column, hidden: Sequence[str] = ()) -> Column:
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.map_filter(props, lambda k, v: v.isNotNull() & ~k.isin(*hidden) if hidden else v.isNotNull())))))


def graph_search(nodes: DataFrame, edges: DataFrame, question: str, relation: str | None = None, k: int = 20) -> DataFrame:
    """(source, type, title, content, score) from nodes(id, labels, props) and edges(src, dst, type, seq).

    Each of the first three long words brings up to k nodes that hold it; a node counts once. Edges come in where a
    relation is asked for, or from nodes that hold the first word where fewer than five nodes were found.
    """
    low = question.lower()
    words = long_words(low)
    if not words:
        words, empty = [low], True
    else:
        empty = False
    hits = None
    for i, w in enumerate(words[:3]):
        score = 1.0 if w == low else 0.7
        part = nodes.filter(holding(nodes, w)).orderBy("id").limit(k).select("id", "labels", "props", F.lit(score).alias("score"), F.lit(i).alias("i"))
        hits = part if hits is None else hits.unionByName(part)
    if empty:
        hits = hits.limit(0)
    name = node_name(F.col("props"), F.col("labels"), "name", "username")
    key = F.concat_ws("-", F.array_join("labels", "-"), name, F.left(shown_props(F.col("props")), F.lit(50)))
    first = first_per(hits.withColumn("key", key), ["key"], F.col("i"), F.col("id"))
    found = first.select(
        F.lit("graph").alias("source"), F.array_join("labels", ", ").alias("type"), name.alias("title"), shown_props(F.col("props"), HIDDEN).alias("content"), "score",
    )
    if empty:
        return found
    ends = lambda p: nodes.select(F.col("id").alias(p), F.col("labels").alias(f"{p}_labels"), F.col("props").alias(f"{p}_props"))
    start = nodes if relation else nodes.filter(holding(nodes, words[0]))
    links = edges.filter(F.col("type") == relation) if relation else edges.join(start.select(F.col("id").alias("src")), "src", "left_semi")
    if not relation:  # one count decides, and joins to every link
        few = found.agg((F.count("*") < 5).alias("few"))
        links = links.join(F.broadcast(few)).filter("few")
    links = links.orderBy("seq").limit(min(k, 10)).join(ends("src"), "src").join(ends("dst"), "dst")
    a = node_name(F.col("src_props"), F.col("src_labels"), "name", "username")
    b = node_name(F.col("dst_props"), F.col("dst_labels"), "name", "username", "address", "value")
    side = lambda p: F.concat(F.array_join(f"{p}_labels", ","), F.lit(" ("), shown_props(F.col(f"{p}_props")), F.lit(")"))
    related = links.select(
        F.lit("graph").alias("source"), F.lit("Relationship").alias("type"), F.concat(a, F.lit(" —["), "type", F.lit("]→ "), b).alias("title"),
        F.concat(side("src"), F.lit(" -["), "type", F.lit("]-> "), side("dst")).alias("content"), F.lit(0.9 if relation else 0.5).alias("score"),
    )
    return found.unionByName(related)


def expanded_search(nodes: DataFrame, edges: DataFrame, question: str, k: int = 10) -> DataFrame:
    """(keyword, id, relationship, connected, score): nodes that hold one of the first three keywords, one hop on.

    Each keyword brings k // 3 rows; a node without edges has a row of its own.
    """
    words = [w for w in question.lower().replace("?", "").split() if len(w) > 2 and w not in SEARCH_STOPWORDS][:3]
    both = edges.select("src", "dst", "type").union(edges.select("dst", "src", "type"))
    out = None
    for i, w in enumerate(words):
        rows = nodes.filter(holding(nodes, w)).select("id").join(both, F.col("id") == F.col("src"), "left")
        rows = rows.select(F.lit(w).alias("keyword"), "id", F.col("type").alias("relationship"), F.col("dst").alias("connected"), F.lit(0.8).alias("score"))
        part = rows.orderBy("id", F.col("connected").asc_nulls_first(), "relationship").limit(k // 3)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else nodes.limit(0).select(F.lit("").alias("keyword"), "id", F.lit("").alias("relationship"), F.col("id").alias("connected"), F.lit(0.8).alias("score"))


def fused(results: DataFrame, k: int = 20) -> DataFrame:
    """results(content, score, seq, source) once per first hundred characters, the best k."""
    return first_per(results, [F.left("content", F.lit(100))], F.desc("score"), F.col("seq")).orderBy(F.desc("score"), "seq").limit(k)


def hybrid(results: DataFrame, graph: bool = True, vectors: bool = True, k: int = 10) -> DataFrame:
    """Fused results of the searches that are switched on."""
    wanted = [name for name, on in (("graph", graph), ("vector", vectors)) if on]
    return fused(results.filter(F.col("source").isin(*wanted) if wanted else F.lit(False)), k)


NOTHING_FOUND = "No relevant results found in documents or knowledge graph."


def context_text(results: DataFrame, most: int = 8000, k: int = 20) -> DataFrame:
    """One row (context, n, chars) from results(source, type, title, content, score, seq).

    The best k results in order, each as an entry, until the next one would pass `most` characters.
    """
    entry = F.concat(F.lit("["), F.upper("source"), F.lit(": "), "type", F.lit("] "), "title", F.lit("\n"), "content", F.lit("\n\n"))
    top = results.withColumn("entry", entry).orderBy(F.desc("score"), "seq").limit(k)
    total = F.sum(F.length("entry")).over(W.orderBy(F.desc("score"), "seq").rowsBetween(W.unboundedPreceding, 0))
    kept = top.withColumn("total", total).filter(F.col("total") <= most)
    lines = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("a"), "seq", "entry"))), lambda x: x["entry"])
    context = F.coalesce(F.nullif(F.array_join(lines, ""), F.lit("")), F.lit(NOTHING_FOUND))
    return kept.agg(context.alias("context"), F.count("*").alias("n"), F.coalesce(F.max("total"), F.lit(0)).cast("long").alias("chars"))


def prompt_context(results: DataFrame, vectors: int = 3, graph: int = 10, percent: bool = False) -> DataFrame:
    """One row with the best vector hits and the first graph rows; scores as percent if asked for."""
    place = F.row_number().over(W.partitionBy("source").orderBy(F.desc("score"), "seq"))
    limit = F.when(F.col("source") == "vector", vectors).otherwise(graph)
    kept = results.filter(F.col("source").isin("vector", "graph")).withColumn("r", place).filter(F.col("r") <= limit)
    score = F.concat(F.format_string("%.1f", F.round(F.col("score") * 100, 6)), F.lit("%")) if percent else F.col("score").cast("string")
    kept = kept.withColumn("line", F.when(F.col("source") == "vector", F.concat(score, F.lit(" "), "content")).otherwise(F.col("content")))
    part = lambda name: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("source") == name, F.struct("r", "line")))), lambda x: x["line"]), "\n")
    return kept.agg(part("vector").alias("vector_context"), part("graph").alias("graph_context"))


def found_in_documents(files: DataFrame, name: str, term: str, k: int = 5) -> DataFrame:
    """(id, file_name, answer): the newest files with `name` in their name and where the term stands in their texts."""
    top = files.filter(F.contains(F.lower("file_name"), F.lit(name.lower()))).orderBy(F.desc("received_at"), "id").limit(k)
    parts = []
    for column, title in (("extracted_text", "Extracted Text"), ("ai_summary", "AI Summary"), ("transcript", "Transcript")):
        found = excerpts(F.col(column), term.lower())
        quoted = F.array_join(F.transform(found, lambda x: F.concat(F.lit("> ..."), x, F.lit("...\n\n"))), "")
        parts.append(F.when(F.size(found) > 0, F.concat(F.lit(f"\n**In {title}:**\n"), quoted)).otherwise(F.lit("")))
    body = F.concat(*[F.coalesce(p, F.lit("")) for p in parts])
    head = F.concat(F.lit("### "), "file_name", F.lit("\n"))
    answer = F.when(body != "", F.concat(head, body)).otherwise(F.concat(head, F.lit(f'No matches for "{term}" found in this document\'s content.')))
    return top.select("id", "file_name", answer.alias("answer"))


def graph_context(nodes: DataFrame) -> DataFrame:
    """One row: how many distinct nodes(labels, props) there are, and a line for each."""
    name = F.coalesce(*[F.nullif(F.try_element_at("props", F.lit(k)), F.lit("")) for k in ("name", "value", "address", "username")], F.lit("unknown"))
    line = F.concat(F.coalesce(F.get("labels", F.lit(0)), F.lit("Node")), F.lit(": "), name)
    lines = nodes.select(line.alias("line")).distinct().agg(F.array_sort(F.collect_list("line")).alias("lines"))
    said = F.concat(F.lit("Found "), F.size("lines"), F.lit(" relevant items in the graph:\n"), F.array_join("lines", "\n"))
    return lines.select(F.when(F.size("lines") == 0, "The knowledge graph is empty or no relevant data was found.").otherwise(said).alias("context"))


def match_parts(sentence: Column, s: Column, p: Column, o: Column) -> Column:
    """What a sentence scores for the ends of a triple and one word of its predicate."""
    low = F.lower(sentence)
    words = F.filter(F.split(F.replace(F.lower(p), F.lit("_"), F.lit(" ")), r"\s+"), lambda w: F.length(w) > 3)
    held = lambda c, n: F.when(F.contains(low, F.lower(c)), F.lit(n)).otherwise(F.lit(0.0))
    return held(s, 0.4) + held(o, 0.4) + F.when(F.exists(words, lambda w: F.contains(low, w)), 0.1).otherwise(0.0)


@F.pandas_udf(DoubleType())
def _alike(a: pd.Series, b: pd.Series) -> pd.Series:
    """The share of matching blocks of two texts; the built-in functions have no such measure."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


def restored_context(triples: DataFrame, sentences: DataFrame, around: int = 1) -> DataFrame:
    """triples(doc_id, triple_id, s, p, o) with the best sentence of their document and those around it.

    sentences(doc_id, place, sentence, start). A document's triples meet its own sentences only; the first of equals
    wins. Only sentences that score as much by their parts as the best one can be ahead by more than the measure of
    likeness adds, so that measure is taken for those alone.
    """
    template = F.lower(F.concat("s", F.lit(" "), F.replace(F.lower("p"), F.lit("_"), F.lit(" ")), F.lit(" "), "o"))
    pairs = triples.join(sentences, "doc_id").withColumn("base", match_parts(F.col("sentence"), F.col("s"), F.col("p"), F.col("o")))
    best = F.max("base").over(W.partitionBy("doc_id", "triple_id"))
    near = pairs.withColumn("top", best).filter(F.col("base") + 0.2 >= F.col("top"))
    near = near.withColumn("score", F.least(F.lit(1.0), F.col("base") + 0.2 * _alike(template, F.lower("sentence"))))
    picked = first_per(near.filter("score > 0"), ["doc_id", "triple_id"], F.desc("score"), F.col("place"))
    picked = picked.select("doc_id", "triple_id", "place", "sentence", "start", "score")
    other = sentences.select("doc_id", F.col("place").alias("at"), F.col("sentence").alias("beside"))
    joined = picked.join(other, "doc_id", "left").filter(F.col("at").between(F.col("place") - around, F.col("place") + around))
    context = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("at") != F.col("place"), F.struct("at", "beside")))), lambda x: x["beside"]), " ")
    return joined.groupBy("doc_id", "triple_id", "place", "sentence", "start", (F.col("start") + F.length("sentence")).cast("int").alias("end"), "score").agg(context.alias("context"))


def gap_triples(gaps: DataFrame, replies: DataFrame, most: int = 3) -> DataFrame:
    """Inferred triples from a model's replies(gap_id, place, s, p, o, confidence) to gaps(gap_id, question, priority) of high priority."""
    whole = F.col("s").isNotNull() & F.col("p").isNotNull() & F.col("o").isNotNull()
    kept = gaps.filter("priority = 'high'").join(replies.filter(F.col("place") < most).filter(whole), "gap_id")
    predicate = F.replace(F.upper("p"), F.lit(" "), F.lit("_"))
    return kept.select("gap_id", "s", predicate.alias("p"), "o", F.coalesce("confidence", F.lit(0.6)).alias("confidence"), F.col("question").alias("source_text"), F.lit(True).alias("inferred"))
