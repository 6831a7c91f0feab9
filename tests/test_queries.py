"""Every query of the library against its SQL on the smallest tables; literal cases for what SQL can't say."""

import oracle
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from subjectlens import catalog
from subjectlens.functions import text as X
from subjectlens.operators import chunking, entities, graph, indicators, validation

SF = "/root/testdata/sf0.001"
#: Fixed ids and names that the smallest tables lack: no rows on either side.
MAY_BE_EMPTY = {"p01_request_search", "p11_domain_match", "l08_history", "r12_locate_file", "x07_ip_addresses", "x14_credit_cards"}


@pytest.fixture(scope="module")
def con():
    return oracle.database(SF)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_as_sql(spark, con, name):
    what = oracle.difference(spark, con, name, catalog.queries()[name], catalog.oracle_sql()[name], SF)
    assert not what or (what == "no rows at all" and name in MAY_BE_EMPTY), what


@given(st.lists(st.integers(0, 60), max_size=40), st.integers(1, 100), st.integers(0, 99))
def test_packed_sentences_end_and_cover(lengths, size, overlap):
    overlap = min(overlap, size - 1)
    out = chunking.packed(lengths, size, overlap, size + 20)
    assert {i for a, b in out for i in range(a, b)} == set(range(len(lengths)))
    assert all(x[1] < y[1] for x, y in zip(out, out[1:], strict=False))


def test_packed_known_cases():
    assert chunking.packed([8, 9, 7], 500, 50, 800) == [(0, 3)]
    assert chunking.packed([20] * 60, 500, 50, 800) == [(0, 25), (23, 48), (46, 60)]


def test_overlap_must_be_smaller():
    with pytest.raises(ValueError):
        chunking.check_sizes(50, 50)


@pytest.mark.parametrize("n, plain, offsets", [(10, [(0, 10)], [(0, 10)]), (23, [(0, 10), (7, 17), (14, 23), (20, 23)], [(0, 10), (7, 17), (14, 23)]), (24, [(0, 10), (7, 17), (14, 24), (21, 24)], [(0, 10), (7, 17), (14, 24)])])
def test_word_ranges(spark, n, plain, offsets):
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(n)))], "doc_id long, text string")
    ranges = lambda df: [(int(r.text.split()[0][1:]), int(r.text.split()[-1][1:]) + 1) for r in df.orderBy("chunk_index").collect()]
    assert ranges(chunking.word_chunks(docs, 10, 3)) == plain
    assert ranges(chunking.offset_chunks(docs, 10, 3)) == offsets


def test_names(spark):
    row = lambda f, v: spark.createDataFrame([(v,)], "v string").select(f(F.col("v"))).first()[0]
    for a, b in (("shares with", "SHARES_WITH"), ("provides access to the data", "PROVIDES_ACCESS"), ("is - of", "IS_OF"), ("to the of users", "TO_THE_OF")):
        assert row(X.short_predicate, a) == b
    assert row(X.entity, "für die Büros") == "für die büros" and row(X.entity, "of the") == "" and row(X.entity, "Google, Inc.") == "google inc"
    assert row(X.email, "John.Q.Doe+news@Gmail.com") == "johnqdoe@gmail.com" and row(X.email, "a.b+c@example.org") == "a.b+c@example.org"
    assert row(X.luhn, "4111 1111 1111 1111") and not row(X.luhn, "4111 1111 1111 1112")
    assert row(X.entropy, "a" * 16) == 0 and round(row(X.entropy, "Zx9Qw3Lk7Vb2Nm5Tr8Yp4Hd6"), 6) == 4.584963


def test_findings_of_all_kinds(spark):
    text = 'see hxxp://evil[.]example[.]com/x and mail bob@example.com now, host 10.1.2.3 end 4111 1111 1111 1111 token "Zx9Qw3Lk7Vb2Nm5Tr8Yp4Hd6" ' + "ab" * 20 + " bob@example.com "
    rows = indicators.findings(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")).collect()
    got = {(r.pattern, r.value) for r in rows}
    assert {("EMAIL", "bob@example.com"), ("IPV4", "10.1.2.3"), ("CREDIT_CARD", "4111 1111 1111 1111"), ("HIGH_ENTROPY", "Zx9Qw3Lk7Vb2Nm5Tr8Yp4Hd6"), ("SHA1", "ab" * 20)} <= got
    assert {r.doc_id for r in rows} == {1} and len(rows) == len({r.value for r in rows})
    assert {r.risk_level for r in rows if r.pattern == "CREDIT_CARD"} == {"critical"}


def test_votes(spark):
    def decide(*rounds):
        rows = [(1, k + 1, f"a{i}", v) for k, (yes, no) in enumerate(rounds) for i, v in enumerate(["CORRECT"] * yes + ["INCORRECT"] * no + ["UNKNOWN"] * (4 - yes - no))]
        r = validation.decisions(spark.createDataFrame(rows, "id long, round int, agent string, verdict string")).first()
        return r.decision, r.round

    assert decide((4, 0)) == ("ACCEPT", 1) and decide((2, 2), (3, 1)) == ("ACCEPT", 2)
    assert decide((2, 2), (2, 2), (2, 2)) == ("NEEDS_REVIEW", 3) and decide((1, 2), (1, 2), (1, 2)) == ("REJECT", 3)


def test_inference_and_components(spark):
    rows = [("Acme", "SHARES_WITH", "AdCo"), ("AdCo", "SHARES_WITH", "DataHub"), ("AdCo", "STORES", "logs"), ("Beta", "COLLECTS", "email list")]
    e = spark.createDataFrame([(*r, 1.0, i) for i, r in enumerate(rows)], "s string, p string, o string, confidence double, seq long")
    assert {(r.s, r.p, r.o) for r in graph.transitive(e).collect()} == {("acme", "INDIRECTLY_SHARES_WITH", "datahub"), ("acme", "VIA_ADCO", "logs")}
    assert {r.node: r.component for r in graph.weak_components(e).collect()} == {"acme": "acme", "adco": "acme", "datahub": "acme", "logs": "acme", "beta": "beta", "email list": "beta"}
    names = spark.createDataFrame([("a b c d",), ("a b c d e",), ("a b x",)], "name string")
    assert [(r.s, r.o, r.confidence) for r in graph.similar_names(names, e).collect()] == [("a b c d", "a b c d e", 0.8)]


def test_dedup_keeps_best_then_first(spark):
    rows = [(" Acme ", "shares_with", "X", 0.5, 0), ("acme", "SHARES_WITH", "x", 0.5, 1)]
    make = lambda r: spark.createDataFrame(r, "s string, p string, o string, confidence double, seq long")
    assert entities.dedup_triples(make(rows)).first().seq == 0
    assert entities.dedup_triples(make([*rows, ("ACME", "SHARES_WITH", "X", 0.9, 2)])).first().confidence == 0.9
