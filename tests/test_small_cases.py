"""Operators that SQL can't say, on small tables against plain Python."""

import itertools
import re
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from subjectlens.functions import content, replies
from subjectlens.functions import text as X
from subjectlens.operators import chunking, graph, indicators, merge, retrieval, tables
from subjectlens.sources import readers, writers
from subjectlens.streaming import incremental

TRIPLES = "s string, p string, o string, confidence double, seq long"


def _triples(spark, pairs, weight=1.0):
    return spark.createDataFrame([(a, "P", b, weight, i) for i, (a, b) in enumerate(pairs)], TRIPLES)


def _value(spark, make, *values):
    """make of each value, in order."""
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(make(F.col("v"))).collect()]


# ---------------------------------------------------------------- graphs


def test_eigenvector(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")]
    names = "abcd"
    a = np.eye(4)
    for u, v in edges:
        a[names.index(u), names.index(v)] = a[names.index(v), names.index(u)] = 1
    want = np.linalg.eigh(a)[1][:, -1]
    got = {r.node: r.centrality for r in graph.eigenvector_centrality(_triples(spark, edges)).collect()}
    assert all(abs(got[k] - abs(want[i])) < 1e-4 for i, k in enumerate(names))
    assert {r.centrality for r in graph.eigenvector_centrality(_triples(spark, edges), rounds=4, tolerance=0.0).collect()} == {0.0}


def test_communities_of_two_groups(spark):
    groups = ["abcd", "wxyz"]
    edges = [p for g in groups for p in itertools.combinations(g, 2)]
    rows = _triples(spark, edges).unionByName(_triples(spark, [("d", "w")], 0.1))
    got = {r.node: r.community for r in graph.label_propagation(rows).collect()}
    assert [len({got[v] for v in g}) for g in groups] == [1, 1] and got["a"] != got["z"]
    colors = {r.node: r.color for r in graph.colored(graph.label_propagation(rows)).collect()}
    assert colors["a"] == graph.COMMUNITY_COLORS[0] and colors["z"] == graph.COMMUNITY_COLORS[1]


def test_similar_names_of_all_sizes(spark):
    rng = np.random.default_rng(1)
    names = sorted({" ".join(f"w{k}" for k in rng.integers(0, 9, rng.integers(1, 8))) for _ in range(150)})
    for least in (0.4, 0.6, 0.8, 1.0):
        got = {(r.s, r.o) for r in graph.similar_names(spark.createDataFrame([(n,) for n in names], "name string"), _triples(spark, [("w1", "w1 w2")]), least).collect()}
        sets = {n: set(n.split()) for n in names}
        want = {(a, b) for a, b in itertools.combinations(names, 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least and {a, b} != {"w1", "w1 w2"}}
        assert got == want, least


# ---------------------------------------------------------------- chunks


def test_sentence_chunks_have_offsets_and_no_chunk_in_another(spark):
    text = " ".join(f"Sentence {i} has {'some ' * (i % 9)}words." for i in range(120))
    rows = chunking.sentence_chunks(spark.createDataFrame([(1, text), (2, None), (3, "Only one. Two here."), (4, "")], "doc_id long, text string"), 60, 10, 100).orderBy("doc_id", "chunk_index").collect()
    mine = [r for r in rows if r.doc_id == 1]
    assert all(text[r.start_offset : r.end_offset] == r.text and r.word_count == len(r.text.split()) for r in mine)
    assert all(a.end_offset < b.end_offset and a.start_offset < b.start_offset for a, b in itertools.pairwise(mine))
    assert mine[0].start_offset == 0 and mine[-1].end_offset == len(text) and all(b.start_offset <= a.end_offset + 1 for a, b in itertools.pairwise(mine))
    assert [(r.start_offset, r.end_offset) for r in rows if r.doc_id == 3] == [(0, 19)] and {r.doc_id for r in rows} == {1, 3}
    for bad in ((49, 10, 200), (60, 60, 200), (60, 10, 99), (2001, 10, 3000)):
        with pytest.raises(ValueError):
            chunking.check_bounds(*bad)


def test_packed_never_stays_inside():
    assert chunking.packed([25, 20, 40], 30, 20, 50) == [(0, 2), (2, 3)]
    assert chunking.packed([0, 0, 22], 1, 0, 21) == [(0, 2), (2, 3)]


def test_line_and_token_chunks(spark):
    text = "\n".join("x" * n for n in (10, 30, 5, 200, 1, 2))
    rows = chunking.line_chunks(spark.createDataFrame([(1, text)], "doc_id long, text string"), 50).orderBy("chunk_index").collect()
    assert [r.text for r in rows] == ["x" * 10 + "\n" + "x" * 30 + "\n" + "x" * 5, "x" * 200, "x\nxx"] and all(text[r.start_offset : r.end_offset] == r.text for r in rows)
    long = " ".join("word" * (1 + i % 3) for i in range(900))
    rows = chunking.token_chunks(spark.createDataFrame([(1, long)], "doc_id long, text string"), 200, 20).orderBy("chunk_index").collect()
    assert [r.chunk_index for r in rows] == list(range(len(rows))) and rows[-1].end_offset == len(long)
    assert all(long[r.start_offset : r.end_offset] == r.text for r in rows)


# ---------------------------------------------------------------- findings


def test_findings_by_python_patterns(spark):
    """Every pattern finds what Python's own engine finds, first pattern first, each value once."""
    texts = [
        "see http://a.example.com/x?y=1, hxxp://b[.]example[.]com and c[.]d[.]org end", "mail me at a.b@c.org or joe [at] x.org, ip 10.1.2.3 and 8[.]8[.]8[.]8 end",
        "aHR0cDovL2V4YW1wbGUuY29tL2E= and SFRUUDovL0VYQU1QTEUuQ09N ;", "%s %s %s" % ("a" * 32, "0f" * 20, "ab" * 32), "fe80::1:2 and 2001:db8::ff00:42:8329 end", "4111 1111 1111 1111 no 4111 1111 1111 1112",
        '/* c */ import "pe"\nrule x : tag { meta: a = "b" condition: true }\n', "http%3A%2F%2Fexample.com%2Fa end", "687474703a2f2f6578616d706c652e636f6d end", "key Zx9Qw3Lk7Vb2Nm5Tr8Yp4Hd6 end",
    ]
    rows = indicators.findings(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()
    for i, text in enumerate(texts):
        seen, want = set(), []
        for p in indicators.PATTERNS:
            for v in re.findall(p.regex, text):
                v = v.strip()
                if not v or v in seen or p.name == "HIGH_ENTROPY" and not (len(v) >= 23 and _entropy(v) > 4.5) or p.name == "CREDIT_CARD" and not v.endswith("1"):
                    continue
                seen.add(v)
                want.append((p.name, v))
        got = [(r.pattern, r.value) for r in sorted(rows, key=lambda r: (r.doc_id, r.position)) if r.doc_id == i]
        assert got == want, (i, got, want)
    assert {r.pattern for r in rows} >= {"GENERIC_URL", "BRACKET_URL", "HEXENCODED_URL", "URLENCODED_URL", "B64ENCODED_URL", "IPV4", "IPV6", "EMAIL", "MD5", "SHA1", "SHA256", "CREDIT_CARD", "YARA", "HIGH_ENTROPY"}


def _entropy(v):
    p = np.array([v.count(c) for c in set(v)]) / len(v)
    return float(-(p * np.log2(p)).sum())


# ---------------------------------------------------------------- text and replies


def test_rules_by_their_own_words(spark):
    assert _value(spark, X.company_of, "https://www.data-co.com:8080/a", "https://shop.example.org", "http://u@www.x.com.au") == ["Data-co", "Shop example.org", "X au"]
    assert _value(spark, X.file_category, "a.PDF", "b.csv", "c.zip", "noext", "d.md") == ["pdf", "spreadsheet", "other", "other", "document"]
    assert _value(spark, X.mime_type, "a.jpeg", "b.docx", "c.m4a", "d.webm") == ["image/jpeg", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "audio/mp4", "application/octet-stream"]
    assert _value(spark, X.clean_label, "9a", "", "a b-c") == ["Entity9a", "Entity", "abc"]
    assert _value(spark, X.relation_type, "1x", "a b", None) == ["RELATES_TO", "A_B", "RELATES_TO"]
    assert _value(spark, lambda v: X.inferred_risk(v, F.lit("a leak")), "Password", "phone", "email") == ["critical", "medium", "high"]
    assert _value(spark, X.is_html, "<div>a</div>", "<div>", "a < b </p>", "plain") == [True, False, True, False]
    assert _value(spark, lambda v: F.to_json(X.outline(v)), "# A\n##  B ", "lower\nTitle Case: Line", "#") == ['[{"level":1,"text":"A"},{"level":2,"text":"B"}]', '[{"level":2,"text":"Title Case: Line"}]', "[]"]
    assert _value(spark, lambda v: X.relative_time(v.cast("long")), "3540", "7200", "90000", "200000") == ["59 minutes ago", "2 hours ago", "Yesterday", "2 days ago"]
    assert _value(spark, lambda v: X.excerpts(v, "cat", 3), "a Cat and a cat$ here") == [["a **Cat** an", "a **cat**$ h"]]
    assert _value(spark, lambda v: X.resolved(v, F.lit("https://h.org/a/b?q")), "../c/./d", "e/..", "x?y#z") == ["https://h.org/c/d", "https://h.org/a/", "https://h.org/a/x?y"]


def test_broken_replies(spark):
    said = ['```json\n[{"a": 1}]\n```', 'no [{"a": "]"}] yes', "[{a: 1,}]", "[1, [2, 3]", "nothing", None, "{}"]
    assert _value(spark, replies.json_of, *said) == ['[{"a": 1}]', None, '[{"a": 1}]', None, None, None, "{}"]
    rows = spark.createDataFrame([("[]",), ('{"a": [1, {"b": 2}]}',), ("x",), (None,)], "v string").select(content.json_rows(F.col("v")).alias("r")).collect()
    assert [None if r.r is None else len(r.r) for r in rows] == [0, 1, None, None]


# ---------------------------------------------------------------- files, merges, streams


def test_marked_text_and_cells(spark):
    assert _value(spark, writers.csv_cell, 'a,"b"', "plain", None, 'q"') == ['"a,""b"""', "plain", "null", '"q"""']
    robots = spark.createDataFrame([("h", "Disallow: /early\nUser-agent: *\nDisallow: /a:b\nUser-agent: z\nDisallow: /c\nCrawl-delay: 9"), ("i", "")], "host string, text string")
    assert sorted((r.host, r.disallowed, r.crawl_delay) for r in readers.robots_rules(robots).collect()) == [("h", ["/a:b"], 0.0), ("i", [], 0.0)]


def test_bulk_upload_has_a_limit(spark):
    rows = lambda n: spark.createDataFrame([(i, f"l{i}", None, None, None) for i in range(n)], "seq long, label string, type string, source string, risk string")
    assert merge.bulk_nodes(rows(100))[0].count() == 100
    with pytest.raises(Exception, match="Maximum batch size"):
        merge.bulk_nodes(rows(101))[0].collect()


def test_mail_without_requests_and_short_roots(spark):
    mail = spark.createDataFrame([(1, "a@ab.org"), (2, "x"), (3, None)], "id long, sender string")
    asked = spark.createDataFrame([(7, "ab.org", 1), (8, "https://www.abc.de/x", 2)], "id long, company string, created_at int")
    assert sorted(tuple(r) for r in merge.matched_mail(mail, asked).collect()) == [(1, 8), (2, 8), (3, 8)]
    assert merge.matched_mail(mail, asked.limit(0)).count() == 0


def test_crawl_takes_pages_as_they_come(spark):
    """As a queue would: pages by the place of their first link on the page that came first."""
    pages = {"s2": ["z", "b"], "s1": ["b", "a", "z"], "z": ["q", "a"], "b": ["c", "q"], "a": ["d"]}
    links = [(src, dst, k) for src, to in pages.items() for k, dst in enumerate(to)]
    seeds = ["s2", "s1"]
    queue, order = list(seeds), []
    while queue:
        page = queue.pop(0)
        if page not in order:
            order.append(page)
            queue += pages.get(page, [])
    frame = spark.createDataFrame(links, "src string, dst string, place int")
    start = spark.createDataFrame([(u, k) for k, u in enumerate(seeds)], "url string, place int")
    for most in range(1, len(order) + 1):
        assert {r.url for r in incremental.frontier(frame, start, 3, most).collect()} == set(order[:most])


def test_crawl_stops_at_its_page_limit(spark):
    links = spark.createDataFrame([("a", f"p{i}") for i in range(50)], "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "url string")
    assert incremental.frontier(links, seeds, 2, 10).count() == 10 and incremental.frontier(links, seeds, 0).count() == 1


def test_restored_context_scores(spark):
    from difflib import SequenceMatcher

    sentences = spark.createDataFrame([(1, 0, "Acme stores data.", 0), (1, 1, "Acme sells data to Beta.", 18), (1, 2, "Nothing.", 43)], "doc_id long, place int, sentence string, start int")
    triples = spark.createDataFrame([(1, 1, "Acme", "SELLS_TO", "Beta"), (1, 2, "Zeta", "X", "Y")], "doc_id long, triple_id long, s string, p string, o string")
    rows = {r.triple_id: r for r in retrieval.restored_context(triples, sentences).collect()}
    want = min(1.0, 0.4 + 0.4 + 0.1 + 0.2 * SequenceMatcher(None, "acme sells to beta", "acme sells data to beta.").ratio())
    assert abs(rows[1].score - want) < 1e-9 and rows[1].sentence == "Acme sells data to Beta." and rows[1].context == "Acme stores data. Nothing." and (rows[1].start, rows[1].end) == (18, 42)
    assert rows[2].score < 0.2
