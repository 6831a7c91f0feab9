"""The near-copy stage by keys: shingles that occur once need no row, half-alike texts don't meet, and no link is lost."""

import random

import brute_force
import numpy as np
import pytest

from subjectlens.llm import near_copies


def _families(rng, families=6, texts=30, words=120):
    """Texts of one family share all but 4 to 30 words of a hundred: near copies, half-alike texts and chains of both."""
    rows = []
    for f in range(families):
        w = [f"w{rng.randrange(9000)}" for _ in range(words)]
        for _ in range(texts):
            c = list(w)
            at = rng.randrange(words)
            for k in range(rng.choice([1, 2, 4, 8, 14, 20, 30])):
                c[(at + k) % words] = f"n{rng.randrange(10**6)}"
            rows.append((len(rows) * 7 % 1009, " ".join(c)))
    return rows + [(5000, ""), (5001, None), (5002, "one word"), (5003, "one  WORD")]


@pytest.mark.parametrize("small", [False, True])
def test_families_as_by_brute_force(spark, monkeypatch, small):
    if small:  # many slices, keys in pieces
        monkeypatch.setattr(near_copies, "SLICE", 512)
        monkeypatch.setattr(near_copies, "HOT", 8)
    rows = _families(random.Random(11))
    got = near_copies.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in brute_force.rows_that_stay(rows))


def test_shingles_of_one_text_have_no_row(spark):
    texts = [" ".join(f"a{i}x{k}" for k in range(100)) for i in range(200)]
    texts += [" ".join([*(f"b{k}" for k in range(100)), *(f"c{i}x{k}" for k in range(100))]) for i in range(20)]  # alike by a half
    texts += [" ".join([*(f"d{k}" for k in range(90)), f"e{i}"]) for i in range(2)]
    sets = [near_copies.shingles(x) for x in texts]
    keys = near_copies._keys(spark.createDataFrame(list(enumerate(texts)), "sid long, text string").repartition(3), sum(map(len, sets))).collect()
    assert {r.sid for r in keys} == {220, 221}
    assert all(r.place >> 32 == len(sets[r.sid]) and 1 <= (r.place & 0xFFFFFFFF) < 18 and r.parity == near_copies.parity(sets[r.sid]) for r in keys)


def test_half_alike_texts_fall_away_inside_a_task(spark):
    rng = np.random.default_rng(1)
    base, sets = np.sort(rng.integers(0, 1 << 63, 400).astype(np.uint64)), []
    for k in range(40):
        sets.append(np.unique(np.r_[base[: 320 if k else 396], rng.integers(0, 1 << 63, 80 if k else 4).astype(np.uint64)]))
    sets.append(base)
    rows = [(key, i, len(s) << 32 | key, near_copies.parity(s), i) for i, s in enumerate(sets) for key in range(3)]
    got = near_copies._met(spark.createDataFrame([(k, i, p, bytearray(b), r) for k, i, p, b, r in rows], "key long, sid long, place long, parity binary, root long")).collect()
    near = {(i, j) for j in range(41) for i in range(j) if near_copies.near(sets[i], sets[j])}
    assert near <= {(r.x, r.y) for r in got} and len({(r.x, r.y) for r in got}) <= 2 * len(near) + 40 and len(near) > 0


def test_entries_come_back():
    rng = np.random.default_rng(2)
    for n in (0, 1, 1000):
        entries = np.sort(rng.integers(0, 1 << 64, n, np.uint64))
        assert (near_copies.unpacked(near_copies.packed(entries), n) == entries).all()
