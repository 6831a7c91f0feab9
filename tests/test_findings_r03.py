"""Small cases that earlier versions got wrong."""

import numpy as np
from pyspark.sql import functions as F

from subjectlens.functions import table_functions, text, values
from subjectlens.operators import chunking, graph
from subjectlens.sources import writers


def test_sentences_keep_their_digits(spark):
    rows = spark.createDataFrame([("00 first 0. 1 Not new. Second 10. Ten 2",)], "text string")
    assert rows.select(chunking.sentences(F.col("text"))).first()[0] == ["00 first 0. 1 Not new.", "Second 10.", "Ten 2"]


def test_exports_hold_all_findings(spark):
    found = spark.range(12_000).select("id", F.lit("Email").alias("type"), F.lit("v").alias("value"), F.lit("s").alias("source"), F.lit("low").alias("riskLevel"), F.lit("2024-01-05").alias("discoveredAt"), F.lit("d1").alias("discovery"))
    assert writers.export_rows(found, "d1").count() == 12_000
    assert [r.id for r in writers.export_rows(found, "d1", most=3).collect()] == [0, 1, 2]


def test_table_functions_pass_row_by_row(spark):
    """A batch of texts with all their chunks is not held at once."""
    table_functions.register(spark)
    plan = spark.sql("SELECT d.id, c.* FROM {docs} d, LATERAL line_chunks(d.text, 600) c", docs=spark.createDataFrame([(1, "a\nb")], "id long, text string"))
    shown = plan._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPythonUDTF" in shown and "ArrowEvalPythonUDTF" not in shown
    assert [r.text for r in plan.collect()] == ["a\nb"]


def test_timeline_reads_a_text_once_for_each_pattern(spark):
    rows = spark.createDataFrame([("seen 2024-01-05 and 5/6/2023,\n again 2024-01-05",), ("none",), (None,)], "text string").select(values.timeline(F.col("text")).alias("t"))
    assert rows._jdf.queryExecution().analyzed().toString().count("regexp_extract_all") == 2
    assert [[tuple(x) for x in r.t] if r.t is not None else None for r in rows.collect()] == [
        [("2024-01-05", "seen 2024-01-05 and 5/6/2023, again 2024-01-05"), ("5/6/2023", "seen 2024-01-05 and 5/6/2023, again 2024-01-05")], [], None]


def test_entropy_splits_a_value_once(spark):
    rows = spark.createDataFrame([("aab",), ("",), ("é€é€",)], "v string").select(text.entropy(F.col("v")).alias("e"))
    assert rows._jdf.queryExecution().analyzed().toString().count("split(") == 1
    assert [round(r.e, 6) for r in rows.collect()] == [0.918296, 0.0, 1.0]


def test_nodes_that_hang_on_one_node_take_no_part_in_rounds(spark, monkeypatch):
    edges = [(f"l{k}", f"h{k % 3}") for k in range(40)] + [("h0", "h1"), ("h1", "h2"), ("p", "q"), ("l0", "l0"), ("L1", "h1")]
    names = sorted({x for e in edges for x in e if x != "L1"})
    a = np.zeros((len(names), len(names)))
    for u, v in edges:
        if u != v:
            a[names.index(u.lower()), names.index(v)] = a[names.index(v), names.index(u.lower())] = 1
    x = np.ones(len(names))
    for r in range(400):
        y = x + a @ x
        off, x = np.abs(y / np.linalg.norm(y) - x / np.linalg.norm(x)).sum(), y / np.linalg.norm(y)
        if r % 4 == 3 and off < len(names) * 1e-6:
            break
    sizes, kept = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df, name: (t := kept(df, name), sizes.append(t.count()))[0])
    rows = spark.createDataFrame([(u, v) for u, v in edges], "s string, o string")
    got = {r.node: r.centrality for r in graph.eigenvector_centrality(rows, rounds=400).collect()}
    assert sorted(got) == names and all(abs(got[n] - x[i]) < 1e-9 for i, n in enumerate(names))
    assert max(sizes[2:]) == 4  # three hubs and one of the pair, four links between the hubs
