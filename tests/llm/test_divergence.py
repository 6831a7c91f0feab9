"""op12 against plain sums over all pairs and terms."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from subjectlens.llm import divergence

COLUMNS = "doc_id long, text string, lang string, source string, term string, value long, rank long"


def plain(docs: list[tuple], least: int, top: int = divergence.TOP_TERMS) -> set[tuple]:
    count, held = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in docs:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        count[lang or "", source or ""].update(terms)
        held[lang or ""].update(set(terms))
    out = set()
    for lang, own in held.items():
        kept = [t for t, d in own.items() if d >= least]
        groups = {s: c for (x, s), c in count.items() if x == lang}
        whole = sum(groups.values(), Counter())
        total = lambda c: sum(c[t] for t in kept)
        part = lambda c, t: 1 + 10**9 * (c[t] + 2) // (total(c) + 2 * len(kept))
        gap = lambda p, q: (p - q) ** 2 // (p + q)
        shares = {s: {t: part(c, t) for t in kept} for s, c in groups.items()}
        for s, p in shares.items():
            pairs = sorted((-sum(gap(p[t], q[t]) for t in kept), o.encode()) for o, q in shares.items() if o != s)
            out |= {(lang, s, "pair", o.decode(), -v, k) for k, (v, o) in enumerate(pairs, 1)}
            terms = sorted((-gap(p[t], part(whole, t)), t.encode()) for t in kept if groups[s][t] and p[t] > part(whole, t))
            out |= {(lang, s, "term", t.decode(), -v, k) for k, (v, t) in enumerate(terms[:top], 1)}
    return out


def test_same_as_plain_sums(spark):
    rng = random.Random(3)
    words = [*"abcdefghijklmnopqrstuvwxyz", "É", "éa", "AB", "ab", "x1y", "日本", ""]
    rows = [(" ".join(rng.choice(words[rng.randrange(3) :]) for _ in range(rng.randrange(30))), rng.choice(("en", "en", "en", "de", None)), rng.choice(("s", "t", "t", "t", "t", "", None, "ü"))) for _ in range(300)]
    rows += [(None, "en", "no text"), ("?!", "fr", "a"), ("", "fr", "b"), ("word " * 30, "it", "one"), ("tie " * 5 + "eit " * 5, "en", "same"), ("tie " * 5 + "eit " * 5, "en", "same")]
    docs = spark.createDataFrame([(1, *r, "extra", 1, 1) for r in rows], COLUMNS)
    for least in (1, 5):
        got = divergence.divergence(docs, least).collect()
        assert {tuple(r) for r in got} == plain(rows, least) and len(got) == len(plain(rows, least))
    assert {("fr", "a", "pair", "b", 0, 1), ("fr", "b", "pair", "a", 0, 1)} <= {tuple(r) for r in got}


def test_empty_table(spark):
    assert divergence.divergence(spark.createDataFrame([], COLUMNS)).collect() == []


@pytest.mark.parametrize("count, total, terms", [(0, 0, 1), (5, 10, 3), (4 * 10**9, 9 * 10**12, 10**6), (10**12, 10**15, 10**9), (4611686016, 4611686018, 1), (4611686017, 4611686018, 1)])
def test_share_is_exact(spark, count, total, terms):
    got = spark.range(1).select(divergence.share(F.lit(count).cast("long"), F.lit(total).cast("long"), F.lit(terms).cast("long")).alias("p"))
    assert got.dtypes == [("p", "bigint")] and got.first().p == 1 + 10**9 * (count + 2) // (total + 2 * terms)
