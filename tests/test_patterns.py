"""Substring matches by automata against plain Python."""

import random
import time

import pytest
from pyspark.sql import functions as F

from subjectlens.operators import merge, patterns


@pytest.mark.parametrize("small", (False, True))
def test_pairs_and_best(spark, monkeypatch, small):
    if small:  # many blocks and slices
        monkeypatch.setattr(patterns, "PATTERN_CHARS", 20)
        monkeypatch.setattr(patterns, "TEXT_CHARS", 100)
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcé") for _ in range(rng.randrange(n)))
    texts = {word(30): (rng.randrange(3), rng.randrange(9)) for _ in range(80)} | {"": (9, 9), "a" * 500: (1, 1)}
    words = {word(6): (rng.randrange(3), rng.randrange(9)) for _ in range(60)} | {"": (9, 9), "a" * 400: (2, 2)}
    t = spark.createDataFrame([(x, *ab) for x, ab in texts.items()] + [(None, 9, 9)], "text string, a long, b long")
    p = spark.createDataFrame([(x, *ab) for x, ab in words.items()] + [(None, 9, 9)], "pattern string, a long, b long")
    want = {(x, w) for x in texts for w in words if w and w in x}
    twice = t.select("text").union(t.select("text"))
    got = [tuple(r) for r in patterns.held_pairs(twice, p.select("pattern").union(p.select("pattern"))).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    assert {tuple(r) for r in patterns.best_in_texts(t, p).collect()} == {(x, *max(words[w] for y, w in want if y == x)) for x, _ in want}
    assert {tuple(r) for r in patterns.best_of_patterns(t, p).collect()} == {(w, *max(texts[x] for x, v in want if v == w)) for _, w in want}
    assert patterns.held_pairs(t.limit(0), p).collect() == [] and patterns.held_pairs(t, p.limit(0)).collect() == []


def test_mail(spark):
    mail = spark.createDataFrame([(1, "a@shop.acme-corp.com"), (2, "b@ACME.org"), (3, "none"), (4, "x@zz.net"), (5, None), (6, "t@me.io"), (7, "q@>")], "id long, sender string")
    rows = [(10, "https://www.acme-corp.com/x", "2024-01-01"), (11, "ACME.org", "2024-01-02"), (12, "acme.com", "2024-01-02"), (13, "it", "2024-05-01"), (14, "other.example", None)]
    requests = spark.createDataFrame(rows, "id long, company string, created_at string").withColumn("created_at", F.to_date("created_at"))
    # "me" is in acme and acme-corp; an empty domain is in every root; roots under three characters don't count
    assert {tuple(r) for r in merge.matched_mail(mail, requests).collect()} == {(1, 11), (2, 11), (3, 11), (5, 11), (6, 11), (7, 11)}
    assert merge.matched_mail(mail, requests.limit(0)).collect() == []


def test_policies(spark):
    requests = spark.createDataFrame([(1, "a.com"), (2, "b"), (3, ""), (4, None), (5, "zzz"), (6, "a.com")], "id long, company_url string")
    policies = spark.createDataFrame([("a.com", "https://a.com/b", "p"), ("a.com", None, "q"), ("", "u", "r"), (None, "b", "s"), ("a.com", "https://a.com/b", "p")], "domain string, url string, summary string")
    got = sorted((r.id, r.policy_url or "", r.summary or "") for r in merge.with_policies(requests, policies).collect())
    a = [("https://a.com/b", "p"), ("https://a.com/b", "p"), ("", "q")]
    assert got == sorted([(i, *x) for i in (1, 6) for x in a] + [(2, "https://a.com/b", "p")] * 2 + [(2, "b", "s"), (3, "u", "r"), (4, "", ""), (5, "", "")])


def test_long_addresses(spark):
    """Addresses of 2000 characters: all their substrings would be two million each."""
    rng = random.Random(8)
    urls = ["https://" + "".join(rng.choice("abcdefgh./") for _ in range(2000)) + f"/{k}" for k in range(1000)]
    policies = spark.createDataFrame([(f"d{k}", u, "s") for k, u in enumerate(urls)], "domain string, url string, summary string")
    requests = spark.createDataFrame([(k, urls[k][500:520]) for k in range(0, 1000, 50)] + [(-1, "d7")], "id long, company_url string")
    merge.with_policies(requests, policies).count()
    began = time.time()
    assert merge.with_policies(requests, policies).count() == 21 and time.time() - began < 15
