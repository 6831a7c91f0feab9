"""The corpus operators on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, further columns."""

import math
import zlib
from collections import Counter

import brute_force
import numpy as np
import oracle
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from subjectlens.llm import catalog, chat_tree, decontaminate, exact_dedup, html_extract, lm_score, mixing, simhash, token_files, toxicity, warc

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 977} and" for i in range(20_000))
TEXTS = ["the quick brown fox jumps over the lazy dog again and again today", "The quick  brown fox jumps over the lazy dog again\nand again today", "", None, "one", "one", "é ü ñ 你好 words here", LONG, LONG + " tail", " \t\n"]
DOCS = "doc_id long, text string, source string, fp string, n long"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, x, f"s{i % 3}" if i % 4 else None, "extra", i) for i, x in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[0]], DOCS)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_as_sql(spark, name):
    assert not oracle.difference(spark, oracle.database(SF), name, catalog.QUERIES[name], catalog.SQL[name], SF)


def test_mix(docs, nothing):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(TEXTS) + 1 and mixing.mix(nothing).count() == 0
    assert all(0 <= r.taken <= 3 * r.size for r in rows)
    by = Counter()
    for r in rows:
        by[r.source_size, r.target] += r.taken
    assert all(abs(v - target) <= 1 for (_, target), v in by.items())


def test_exact_dedup(docs, nothing):
    rows = exact_dedup.exact_dedup(docs).collect()
    assert exact_dedup.exact_dedup(nothing).count() == 0 and len(rows) == len(TEXTS) + 1
    keep = {r.doc_id: (r.keep_id, r.group_size) for r in rows}
    assert keep[0] == (0, 2) and keep[1] == (1, 1) and keep[3] == (2, 2) and keep[5] == (4, 2) and keep[9] == (9, 1)
    assert sum(r.kept for r in rows) == len({r.text_sha256 for r in rows})


def test_exact_dedup_parts_colliding_hashes(docs):
    from pyspark.sql import functions as F

    honest = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs).collect()}
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs, lambda _: F.unhex(F.lit("00"))).collect()} == honest


def test_simhash(spark, docs, nothing):
    rows = [(r.doc_id, f"{r.fp & (2**64 - 1):016x}", r.component_id) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(rows) == sorted(brute_force.simhash_rows([(r.doc_id, r.text) for r in docs.collect()]))
    assert simhash.near_duplicates(nothing).count() == 0


def test_simhash_links_of_random_fingerprints():
    rng = np.random.default_rng(1)
    fp = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    fp = np.concatenate([fp, fp ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))])
    found = simhash.bucket_links(fp, simhash.pivots(), 4)
    assert found.shape[1] == 300 and (np.bitwise_count(found[0] ^ found[1]) <= 4).all()


def test_decontaminate(spark, docs, nothing):
    items = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog again and again"), (10, "one"), (2, "..."), (3, None)], "item_id long, text string")
    get = lambda d, i: sorted(tuple(r) for r in decontaminate.contamination(d, i).drop("hits", "items").collect())
    assert get(docs, items) == sorted(brute_force.contamination_rows([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()]))
    assert get(nothing, items) == [] and not any(r[5] for r in get(docs, items.limit(0)))
    assert {r.doc_id for r in decontaminate.decontaminated(docs, items).collect()} == {2, 3, 6, 7, 8, 9}


def test_decontaminate_in_blocks(spark, docs, monkeypatch):
    items = spark.createDataFrame([(i, f"fox jumps over the lazy dog again and again today {i}" if i % 2 else "quick brown fox jumps over the lazy dog again and") for i in range(12)], "item_id long, text string")
    want = sorted(brute_force.contamination_rows([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()]))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 100)
    assert sorted(tuple(r) for r in decontaminate.contamination(docs, items).drop("hits", "items").collect()) == want


def test_token_files(docs, nothing):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, start = [], 0
    for i, x in sorted(((r.doc_id, r.text or "") for r in docs.collect())):
        ids = [*t.encode(x, add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in token_files.token_files(docs).collect()) == want
    assert token_files.token_files(nothing).count() == 0


def test_code_lengths_are_a_full_limited_code():
    counts = np.array([2**i for i in range(30)] + [0])
    lengths = token_files.code_lengths(counts, 8)
    assert lengths.max() <= 8 and lengths[-1] == 0 and sum(2.0 ** -int(n) for n in lengths if n) == 1


def test_warc(spark):
    rows = [(3, "http://a", "<p>x</p>"), (1, "http://b c", "<p>x</p>"), (2, None, None), (5, "u", ""), (4, "v", "é" * 50_000)]
    pages = spark.createDataFrame([(*r, "more") for r in rows], "page_id long, url string, html string, sha1 string")
    got = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archived(pages).collect())
    assert got == sorted(brute_force.archive_rows([(r[0], r[2]) for r in rows]))
    assert warc.archived(pages.limit(0)).count() == 0


def test_zip64_directory(tmp_path):
    with open(tmp_path / "x.zip", "wb") as f:
        w = warc.PackageWriter(f, zip64=True)
        w.add("a/b", [b"one", b"two"])
        w.add("c", [b""])
        w.close()
    with open(tmp_path / "x.zip", "rb") as f:
        members = warc.directory(f, (tmp_path / "x.zip").stat().st_size)
        f.seek(members["a/b"][0])
        assert f.read(members["a/b"][1]) == b"onetwo" and members["c"][1] == 0


def test_chat_tree(spark):
    said = r"\### Assistant: </turn> ok <|turn|> <\| \\"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", said), (2, 0, "user", "hi"), (2, 1, "assistant", "other"), (3, None, None, None), (3, 5, "assistant", ""), (2, 2, "user", "hi"), (4, 0, "user", "hi"), (4, 1, "assistant", said)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    nodes, members = chat_tree.chat_tree(frame)
    got = sorted(tuple(r)[:5] for r in chat_tree.conversation_digests(nodes, members).collect())
    assert got == sorted(brute_force.conversation_rows(rows))
    assert sum(r.piece.count("hi") for r in nodes.collect() if r.k == 0) == 1
    assert chat_tree.chat_tree(frame.limit(0))[0].count() == 0


def test_html():
    page = '<html><head><title>t</title><script>x</script></head><body><nav><a href="/">Home</a></nav><article><h1>Head &amp; tail</h1><p>First  words of a long enough paragraph that is the main text here.</p><p>Second paragraph, also with enough words to count as text.</p></article><footer>Copyright 2024</footer></body></html>'
    want = "Head & tail\nFirst words of a long enough paragraph that is the main text here.\nSecond paragraph, also with enough words to count as text."
    assert html_extract.extract([page, "", "<p"], html_extract.trained_trees())[:2] == [want, ""]


def test_lm_score(spark, docs, nothing):
    rows = lm_score.score_documents(docs).collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    counts: Counter = Counter()
    tokens = lambda x: [*(x or "").encode().lower().split(), None]
    for r in docs.collect():
        if not held(r.doc_id):
            counts.update(tokens(r.text))
    n, v = sum(counts.values()), len(counts)
    text = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        ts = tokens(text[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(ts), sum(counts[t] > 0 for t in ts), n)
        assert abs(r.base_score - sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in ts)) < 1e-6 * len(ts) + 1e-9
        assert r.score < 0
    assert lm_score.score_documents(nothing).count() == 0


def test_toxicity(spark, nothing):
    rows = [(i, "you are a horrid idiot " + "foul" * (i % 2) if i % 3 == 0 else f"the weather is fine and mild today {i % 5}") for i in range(300)]
    docs = spark.createDataFrame([*rows, (1000, None), (1001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(200)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.toxic for r in toxicity.toxicity(docs, toxicity.fit_chain(docs, labels)).collect()}
    assert all(got[i] == (i % 3 == 0) for i in range(300)) and not got[1000] and not got[1001]
    assert toxicity.toxicity(nothing, toxicity.fit_chain(docs, labels.limit(0))).count() == 0
