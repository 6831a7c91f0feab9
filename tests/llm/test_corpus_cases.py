"""Small tables with every awkward case: null, repeated and hot keys, long texts, further columns, empty tables."""

import json
import random
import zlib

import brute_force
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from subjectlens.llm import chat_tree, gru, html_dom, html_extract, lm_score, shared, simhash, toxicity, warc


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# ---------------------------------------------------------------- joins of hot keys


def test_salted_join_equals_a_plain_join(spark):
    left = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 50}") for i in range(3000)], "id long, key string")
    right = left.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("low"))
    got = shared.salted_join(left, right, ["key"], ["id"], "n", 3000).select("id", "key", "n", "low")
    assert _rows(got) == _rows(left.join(right, "key").select("id", "key", "n", "low"))
    dealt = shared.salted_join(left, right, ["key"], ["id"], "n", 3000)
    assert dealt.columns == ["key", "id", "n", "low"]
    assert shared.salted_join(left.limit(0), right.limit(0), ["key"], ["id"], "n", 0).count() == 0


# ---------------------------------------------------------------- language model


def _model(words=40, groups=12, seed=0):
    layout = gru.Layout(words, groups, 8)
    rng = np.random.default_rng(seed)
    counts = rng.integers(1, 50, layout.symbols).astype(float)
    p = gru.unpack(gru.initial(layout, counts, seed), layout)
    for k in ("P", "U", "bn", "Wc", "Ww"):
        p[k] = rng.standard_normal(p[k].shape).astype(np.float32) * 0.3
    return layout, p


def _forward(p, layout, doc):
    """log P of a document by the definition, one symbol at a time in float64; also the distributions that it met."""
    q = {k: v.astype(float) for k, v in p.items()}
    n, h, before, total, met = gru.HIDDEN, np.zeros(gru.HIDDEN), layout.end, 0.0, []
    for y in doc.tolist():
        if before == layout.end:
            h = np.zeros(n)
        else:
            x, u = q["P"][before], h @ q["U"]
            z, r = (1 / (1 + np.exp(-(x[a : a + n] + u[a : a + n]))) for a in (0, n))
            c = np.tanh(x[2 * n :] + r * (u[2 * n :] + q["bn"]))
            h = (1 - z) * c + z * h
        cls = np.exp(h @ q["Wc"] + q["bc"])
        cls /= cls.sum()
        every = np.zeros(layout.symbols)
        k = layout.per_class
        for c in range(layout.word_classes):
            inside = np.exp(q["Ww"][c * k : (c + 1) * k] @ h + q["bw"][c * k : (c + 1) * k])
            share = cls[c] * inside / inside.sum()
            every[c * k : min((c + 1) * k, layout.words)] = share[: max(0, min(k, layout.words - c * k))]
        every[layout.words :] = cls[layout.word_classes :]
        met.append(every.sum())
        total, before = total + np.log(every[y]), y
    return total, met


def test_scores_by_definition_with_state_from_start_to_end():
    layout, p = _model()
    rng = np.random.default_rng(2)
    docs = [np.r_[rng.integers(0, layout.words, n), layout.end].astype(np.int32) for n in (0, 1, 5, 70, 333)]
    docs[2][1] = layout.words + 3  # a group
    want = [_forward(p, layout, d) for d in docs]
    assert np.allclose(gru.score(p, layout, docs), [w[0] for w in want], rtol=1e-4, atol=1e-3)
    assert all(abs(s - 1) < 1e-6 for w in want for s in w[1])  # all symbols add up to 1 at every place


def test_gradients_by_difference():
    layout, p = _model(16, 4)
    rng = np.random.default_rng(4)
    x = rng.integers(0, layout.symbols, (6, 5)).astype(np.int32)
    x[0] = -1
    caught = {}

    class Keep:
        def update(self, _, g, share):
            caught.update({k: v.copy() for k, v in g.items()})

    def loss(q):
        h, total = np.zeros((5, gru.HIDDEN), np.float64), 0.0
        for t in range(5):
            fresh = (x[t] < 0) | (x[t] == layout.end)
            h = gru.step(q, h, q["P"][np.maximum(x[t], 0)], fresh)
            total -= gru.output(q, layout, h, x[t + 1])[0].astype(float).sum()
        return total / 25

    gru._train_window(p, layout, x, np.zeros((5, gru.HIDDEN), np.float32), Keep())
    q = {k: v.astype(float) for k, v in p.items()}
    for name in ("P", "U", "bn", "Wc", "bc", "Ww", "bw"):
        flat, got = q[name].reshape(-1), caught[name].reshape(-1)
        for i in rng.choice(len(flat), min(12, len(flat)), replace=False):
            old = flat[i]
            if old < -1e3:
                continue
            flat[i] = old + 1e-4
            up = loss(q)
            flat[i] = old - 1e-4
            down = loss(q)
            flat[i] = old
            assert abs((up - down) / 2e-4 - got[i]) < 2e-3, (name, i)


def test_model_beats_the_base_on_held_out_texts_and_ignores_the_layout(spark):
    rng = random.Random(5)
    ring = [f"w{i}" for i in range(60)]

    def text():
        i = rng.randrange(60)
        return " ".join(ring[(i + k) % 60] for k in range(rng.randrange(20, 60)))  # each word follows from the one before

    rows = [(i, text(), "x") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, base string")
    one, other = (lm_score.score_documents(docs.repartition(n)).collect() for n in (1, 5))
    scores = {r.doc_id: r.score for r in one}
    assert all(abs(scores[r.doc_id] - r.score) < 1e-6 * abs(r.score) + 1e-9 for r in other)
    held = [r for r in one if r.held_out]
    assert {r.doc_id for r in held} == {i for i in range(3000) if zlib.crc32(str(i).encode()) % 7 == 2}
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.05 * abs(sum(r.base_score for r in held))


def test_long_and_odd_texts_are_scored(spark):
    rows = [(1, "a b " * 60_000), (None, "a é b \x1c c"), (2, None), (2, " \t"), (3, "unseen " * 3)]
    rows += [(i, "a b c") for i in range(10, 60)]
    got = lm_score.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    tokens = {(r.doc_id, r.n_tokens) for r in got}
    assert {(1, 120_001), (None, 5), (2, 1), (3, 4)} <= tokens and len(got) == len(rows)
    assert all(np.isfinite(r.score) and np.isfinite(r.base_score) for r in got)


def test_words_of_slices():
    """Texts are split alike wherever their slice begins; white space is ASCII's."""
    rng = random.Random(1)
    texts = ["".join(rng.choice("aAbZ \t\n\x0b\x0c\r\x1c\x1fé 你Ü .,") for _ in range(rng.randrange(14))) for _ in range(3000)]
    whole = pa.array(texts)
    for part in (whole, whole.slice(1, 900), whole.slice(1700), whole.slice(5, 0)):
        text, word, distinct = lm_score.split_words(part)
        want = [(i, w.decode()) for i, t in enumerate(part.to_pylist()) for w in t.encode().lower().split()]
        assert [(i, distinct[k]) for i, k in zip(text.tolist(), word.tolist(), strict=True)] == want


def test_shards_depend_on_the_corpus_alone():
    assert [lm_score.shards_for(n) for n in (0, 999_999, 3_500_000, 70_000_000, 10**9, 10**12)] == [1, 1, 3, 64, 64, 62_500]


# ---------------------------------------------------------------- toxicity


def test_toxicity_of_awkward_rows(spark):
    rows = [(i, "you are a horrid idiot" if i % 3 == 0 else f"the weather is fine {i % 5}", "p") for i in range(300)]
    rows += [(0, "you are a horrid idiot", "p"), (None, "the weather is fine", "p"), (7, "zzz qqq", "p")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, p_toxic string")
    labels = [(i, 0, int(i % 3 == 0)) for i in range(1, 300)] + [(3, 0, 0), (4, 0, None)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    chain = toxicity.fit_chain(docs, labels)
    got = [(r.doc_id, r.toxic) for r in toxicity.toxicity(docs, chain).collect()]
    assert len(got) == len(rows) and got.count((0, True)) == 2 and (None, False) in got
    share = toxicity.toxicity(docs.filter("text = 'zzz qqq'"), chain).first()
    assert abs(share.p_toxic - 1 / 3) < 0.02 and not share.toxic  # no known feature: the label's share
    long = spark.createDataFrame([(1, "horrid idiot " * 200_000)], "doc_id long, text string")
    assert toxicity.toxicity(long, chain).first().toxic
    nothing = toxicity.fit_chain(docs.limit(0), labels)
    assert not any(r.toxic for r in toxicity.toxicity(docs, nothing).collect())


def test_out_of_fold_features_have_not_seen_their_fold(spark):
    """A word that only one fold's toxic texts hold is no feature of the model that rates this fold."""
    fold = lambda i: zlib.crc32(str(i).encode()) % toxicity.FOLDS
    ids = range(400)
    docs = spark.createDataFrame([(i, ("marker " if fold(i) == 0 and i % 2 else "") + f"word{i % 7}") for i in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in ids], "doc_id long, quality int, toxic int")
    sample = toxicity._sample(docs, labels, toxicity.CATEGORIES)
    counts = toxicity._feature_counts(sample, 2)
    names = [c.f for c in counts]
    sizes = np.array([sum(fold(i) == k for i in ids) for k in range(toxicity.FOLDS)])
    ones = np.array([[sum(fold(i) == k and i % 2 for i in ids)] * 2 for k in range(toxicity.FOLDS)])
    marker = names.index(b"marker")
    assert marker not in toxicity._chosen(counts, sizes, ones, 0, 0) and marker in toxicity._chosen(counts, sizes, ones, 0, None)


# ---------------------------------------------------------------- SimHash


@pytest.mark.parametrize("radius", [4, 6])
@pytest.mark.parametrize("n", [10, 10**6, 10**9])
def test_keys_miss_no_pair(radius, n):
    blocks, groups = simhash.blocks_of(n, radius)
    assert sum(w for _, w in blocks) == 64 and [s for s, _ in blocks] == list(np.cumsum([0] + [w for _, w in blocks])[:-1])
    rng = random.Random(n)
    for _ in range(300):
        touched = {next(k for k, (s, w) in enumerate(blocks) if s <= b < s + w) for b in rng.sample(range(64), radius)}
        assert any(not touched & set(g) for g in groups)


@pytest.mark.parametrize("hot, n", [(16, 0), (1024, 10**8)])
def test_simhash_links_of_crowded_and_of_long_keys(spark, monkeypatch, hot, n):
    monkeypatch.setattr(simhash, "HOT_BUCKET", hot)
    rng = np.random.default_rng(3)
    center = int(rng.integers(0, 1 << 62))
    fps = {center ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 63, (120, 2))} | {int(x) for x in rng.integers(0, 1 << 62, 80)}
    frame = spark.createDataFrame([(x,) for x in fps], "fp long")
    if n:
        blocks = simhash.blocks_of
        monkeypatch.setattr(simhash, "blocks_of", lambda _, radius: blocks(n, radius))
    links = simhash.fingerprint_links(frame).collect()
    label = {x: x for x in fps}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for r in links:
        assert bin((r.u ^ r.v) & (2**64 - 1)).count("1") <= 4
        label[root(r.u)] = root(r.v)
    todo = list(fps)
    assert all(root(a) == root(b) for i, a in enumerate(todo) for b in todo[i + 1 :] if bin(a ^ b).count("1") <= 4)


def test_simhash_of_null_ids(spark):
    rows = [(None, "a b c d e"), (None, "a b c d e"), (5, "A b  c d e"), (None, None), (9, "")]
    got = _rows(simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "component_id"))
    assert got == sorted([(None, 5), (None, 5), (5, 5), (None, 9), (9, 9)], key=str)


# ---------------------------------------------------------------- web pages


def test_pages_of_all_kinds(spark):
    deep = "<div>" * 3000 + "<p>The words at the bottom of a very deep page are kept as text.</p>" + "</div>" * 3000
    long = "<article>" + "<p>This paragraph is one of very many and has enough words to be read.</p>" * 20_000 + "</article>"
    rows = [(1, "u", None), (2, None, ""), (3, "u", deep), (4, "u", long), (4, "u", long), (None, "u", "no tags at all &amp; one line"), (5, "u", "<p" * 1000)]
    pages = spark.createDataFrame([(*r, "more") for r in rows], "page_id long, url string, html string, text string")
    got = html_extract.main_texts(pages).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    by = {(r.page_id, r.url): r.text for r in got}
    assert by[1, "u"] == "" and by[2, None] == "" and by[4, "u"].count("\n") == 19_999
    assert html_extract.main_texts(pages.limit(0)).count() == 0


def _other_pages(rng, n=60):
    """Pages of another make than those that the trees are trained on: other frames, names and words."""
    nouns = "river garden window market letter winter engine harbour teacher forest music painter kitchen valley journey".split()

    def sentence(k):
        w = " ".join(rng.choice(nouns) + rng.choice(["", "s", " of the", " and", " near"]) for _ in range(k))
        return w[:1].upper() + w[1:] + "."

    for _ in range(n):
        body = [sentence(rng.randrange(8, 40)) for _ in range(rng.randrange(3, 9))]
        links = lambda: "".join(f'<li><a href="/t{i}">{rng.choice(nouns).title()}</a></li>' for i in range(6))
        junk = [
            f'<nav class="topnav"><ul>{links()}</ul></nav>', f'<div id="cookie-bar">We use cookies. <a href="/p">{rng.choice(nouns)}</a></div>',
            f'<aside class="rail"><h4>Popular</h4><ul>{links()}</ul></aside>', '<form class="search"><input name=q><button>Go</button></form>',
            f'<section class="comments"><div class="comment"><p>{sentence(6)}</p></div></section>', f'<footer class="site-foot"><p>Copyright {sentence(3)}</p></footer>',
        ]
        head, tail = junk[:2], junk[2:]
        rng.shuffle(tail)
        main = f'<main id="primary"><article class="story-text"><h1>{sentence(4)}</h1>' + "".join(f"<p>{s}</p>" for s in body) + "</article></main>"
        yield f"<html><body>{''.join(head)}<div class=grid>{main}{''.join(tail[:-1])}</div>{tail[-1]}</body></html>", body


def test_quality_on_pages_of_another_make():
    """Precision and recall by words: both are stated in the README."""
    kept = found = wanted = 0
    for html, body in _other_pages(random.Random(11)):
        text = html_extract.extract([html], html_extract.trained_trees())[0].split("\n")
        good = set(body)
        kept += sum(len(x.split()) for x in text)
        found += sum(len(x.split()) for x in text if x in good)
        wanted += sum(len(x.split()) for x in body)
    assert found / wanted > 0.9 and found / max(1, kept) > 0.85


def test_labelling_is_consistent():
    rng = random.Random(3)
    page = html_dom.read_page(html_extract.Maker(rng).page())
    log_p = np.log(np.random.default_rng(1).dirichlet([1, 1, 1], len(page.kind)))
    keep = html_extract.decode(log_p, page.parent, page.tag)
    assert len(keep) == len(page.kind)


# ---------------------------------------------------------------- archives and conversations


def test_archives_of_repeated_and_null_ids(spark):
    rows = [(1, "u", "same"), (1, "u", "same"), (2, "u", "same"), (None, "u", "same"), (3, "u", "other"), (None, "u", None)]
    got = warc.archived(spark.createDataFrame(rows, "page_id long, url string, html string")).select("page_id", "record_type", "refers_to")
    assert _rows(got) == sorted([(1, "response", None), (1, "response", None), (2, "revisit", 1), (None, "revisit", 1), (3, "response", None), (None, "response", None)], key=str)


def test_tree_attends_to_what_comes_before(spark):
    """Start, position and attention of each node against the prefix tree by hand; a long conversation; a null id."""
    rows = [(c, k, "user" if k % 2 == 0 else "assistant", f"t{k}" if k < c + 1 else f"c{c} t{k}") for c in (1, 2, 3) for k in range(6)]
    rows += [(4, k, "user", f"long {k}") for k in range(150)] + [(None, 0, "user", "t0"), (None, 1, "assistant", "t1")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    nodes, members = chat_tree.chat_tree(frame)
    got = {(r.run, r.k): r for r in nodes.collect()}
    paths = {}
    for r in members.collect():
        paths.setdefault(r.conv, {})[r.k] = got[r.run, r.k]
    assert len(got) == len({tuple(rows[i][2:] for i in range(len(rows)) if rows[i][0] == c)[: k + 1] for c in (1, 2, 3, 4, None) for k in range(150)})
    total = sum(n.length for n in got.values())
    assert sorted(x for n in got.values() for x in range(n.start, n.start + n.length)) == list(range(total))
    for path in paths.values():
        before, at = set(), 0
        for k in sorted(path):
            n = path[k]
            assert n.position == at
            assert {x for a in n.attention for x in range(a["offset"], a["end"])} == before
            before |= set(range(n.start, n.start + n.length))
            at += n.length
    digests = sorted((tuple(r)[:5] for r in chat_tree.conversation_digests(nodes, members).collect()), key=str)
    assert digests == sorted(brute_force.conversation_rows(rows), key=str)
    json.dumps([r.piece for r in got.values()])
