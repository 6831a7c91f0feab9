"""Results as files: JSON lines, CSV cells, marked-up texts, graph pages, vector points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Colours (background, border) of marked classes.
CLASS_COLORS = {
    "data_collection": ("#e3f2fd", "#1976d2"),
    "data_sharing": ("#fff3e0", "#f57c00"),
    "data_right": ("#e8f5e9", "#388e3c"),
    "third_party": ("#fce4ec", "#c2185b"),
    "personal_data": ("#f3e5f5", "#7b1fa2"),
    "legal_basis": ("#e0f7fa", "#0097a7"),
}


def json_lines(rows: DataFrame, path: str) -> None:
    """One JSON object a line."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def csv_cell(value: Column) -> Column:
    """Quoted, with quotes doubled, where it holds a comma or a quote; nulls are the text null."""
    v = F.coalesce(value.cast("string"), F.lit("null"))
    quoted = F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(F.contains(v, F.lit(",")) | F.contains(v, F.lit('"')), quoted).otherwise(v)


def export_rows(findings: DataFrame, discovery: str | None = None, since: str | None = None, until: str | None = None, most: int | None = None) -> DataFrame:
    """findings(id, type, value, source, riskLevel, discoveredAt, discovery) in the filters, newest first; with `most`, the newest so many."""
    out = findings
    if discovery is not None:
        out = out.filter(F.col("discovery") == discovery)
    if since is not None:
        out = out.filter(F.col("discoveredAt") >= since)
    if until is not None:
        out = out.filter(F.col("discoveredAt") <= until)
    out = out.orderBy(F.desc("discoveredAt"), "id")
    return (out if most is None else out.limit(most)).select("id", "type", "value", "source", "riskLevel", "discoveredAt")


def csv_lines(rows: DataFrame) -> DataFrame:
    """(line) of a CSV export; the header is the names of the columns."""
    return rows.select(F.concat_ws(",", *[csv_cell(F.col(c)) for c in rows.columns]).alias("line"))


def csv_files(rows: DataFrame, path: str) -> None:
    csv_lines(rows).write.mode("overwrite").text(path)


def html_text(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\n", "<br>")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def marked_text(text: Column, spans: Column) -> Column:
    """A text as HTML with spans (start, end, class, text, title) marked in order of their start.

    A span that begins inside the one before it is shown whole, after it; the text between spans is shown once.
    """
    state = F.struct(F.lit("").alias("out"), F.lit(0).alias("last"))

    def add(s: Column, x: Column) -> Column:
        gap = F.when(x["start"] > s["last"], html_text(F.substring(text, s["last"] + 1, x["start"] - s["last"]))).otherwise("")
        mark = F.concat(F.lit('<span class="extraction '), x["class"], F.lit('" title="'), x["class"], F.lit(": "), x["title"], F.lit('">'), html_text(x["text"]), F.lit("</span>"))
        return F.struct(F.concat(s["out"], gap, mark).alias("out"), x["end"].cast("int").alias("last"))

    rest = lambda s: F.concat(s["out"], F.when(s["last"] < F.length(text), html_text(F.substring(text, s["last"] + 1, F.length(text)))).otherwise(""))
    return F.aggregate(F.array_sort(spans), state, add, rest)


def marked_pages(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, html) of docs(doc_id, text) with their spans(doc_id, start, end, class, text, title)."""
    by = spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "class", "text", "title")).alias("spans"))
    styles = "".join(f".{c} {{ background: {a}; border: 1px solid {b}; }}" for c, (a, b) in CLASS_COLORS.items())
    none = F.array().cast("array<struct<start:int,end:int,class:string,text:string,title:string>>")
    body = marked_text(F.col("text"), F.coalesce("spans", none))
    page = F.concat(F.lit(f"<!DOCTYPE html><html><head><style>{styles}</style></head><body><div id=\"content\">"), body, F.lit("</div></body></html>"))
    return docs.join(by, "doc_id", "left").select("doc_id", page.alias("html"))


def graph_elements(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(kind, line): a JSON object for each of nodes(node, color, size) and links(s, o, p, inferred), for a graph page."""
    dashed = F.col("inferred")
    shown_nodes = nodes.select(F.lit("node").alias("kind"), F.to_json(F.struct(F.col("node").alias("id"), "color", "size")).alias("line"))
    shown_links = links.select(F.lit("link").alias("kind"), F.to_json(F.struct(F.col("s").alias("from"), F.col("o").alias("to"), F.col("p").alias("label"), dashed.alias("dashes"))).alias("line"))
    return shown_nodes.unionByName(shown_links)


def vector_points(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """(id, vector, text, start_offset, end_offset, chunk_index, source) of chunks and their vectors by source and number.

    Fails where a source has another number of vectors than of chunks: the counts are compared in the same job.
    """
    both = chunks.join(vectors.select("source", "chunk_index", F.col("embedding").alias("vector")), ["source", "chunk_index"], "full_outer")
    whole = F.col("vector").isNotNull() & F.col("text").isNotNull()
    id_ = F.when(whole, F.concat_ws("_", "source", "chunk_index")).otherwise(F.raise_error(F.lit("chunks and vectors must have the same length")).cast("string"))
    return both.select(id_.alias("id"), "vector", "text", "start_offset", "end_offset", "chunk_index", "source")
