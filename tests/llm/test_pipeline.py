"""The pipeline's run() on a small fixture, stage by stage against the plainest way, and on empty tables."""

import random
import zlib
from collections import Counter

import brute_force
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from subjectlens.llm import mixing, toxicity

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def _documents():
    """Clean texts, toxic ones, exact copies, near copies at 0.8 to 0.95, benchmark passages, null and repeated ids, empty texts."""
    rng = random.Random(9)
    words = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    passage = " ".join(f"bench{i}" for i in range(14))
    rows = []
    for i in range(60):
        rows.append((10 * i, words(120)))
    for i in range(0, 60, 3):
        for k in (1, 2):
            w = list(rows[i][1])
            for at in rng.sample(range(120), k):
                w[at] = "other"
            rows.append((10 * i + k, w))
    rows += [(1000 + i, [*words(40), "you", "horrid", "idiot", "vile", f"x{i}"]) for i in range(12)]
    rows += [(2000 + i, [*words(30), *passage.split()[i : i + 11], *words(30)]) for i in range(3)]
    rows += [(None, words(50)), (None, words(50)), (5, words(60)), (5, words(60)), (7000, rows[4][1])]
    texts = [(i, " ".join(w), "en", f"s{(i or 0) % 3}" if i != 5 else None) for i, w in rows] + [(8000, "", "en", "s1"), (8001, None, "en", "s2")]
    return [(i, t, lang, source, len(t or "")) for i, t, lang, source in texts], passage


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    docs, passage = _documents()
    at = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(docs, COLUMNS).repartition(3).write.parquet(f"{at}/documents.parquet")
    known = [(i, 1, int(1000 <= i < 1012)) for i, *_ in docs if i is not None]
    spark.createDataFrame(known, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, passage), (2, "")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def _key(r):
    return (r[0] is None, r[0] or 0, r[1] or "")


def test_run_stage_by_stage(spark, folder):
    docs, passage = _documents()
    frame, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, frame, folder)
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(path := f"{folder}/stage-{n}.parquet")
        frame = spark.read.parquet(path)
        kept[name] = [tuple(r) for r in frame.collect()]
    clean = [r for r in docs if r[0] is None or not 1000 <= r[0] < 1012]
    assert sorted(kept["toxicity"], key=_key) == sorted(clean, key=_key)
    stay = brute_force.rows_that_stay(clean)
    assert sorted(kept["near_duplicates"], key=_key) == sorted(stay, key=_key) and len(stay) < len(clean) - 40
    rated = brute_force.contamination_rows([(r[0], r[1]) for r in stay], [(1, passage), (2, "")])
    left = [r for r, b in zip(stay, rated, strict=True) if not b[5]]
    assert sorted(kept["decontamination"], key=_key) == sorted(left, key=_key) and len(left) == len(stay) - 3
    mixed = Counter(kept["mixing"])
    assert set(mixed) <= set(left)
    plan = {(r.doc_id, r.size): (r.target, r.source_size) for r in mixing.mix(spark.read.parquet(f"{folder}/stage-2.parquet")).collect()}
    size = lambda r: len((r[1] or "").split())
    for source in {r[3] for r in left}:
        target, whole = plan[next((r[0], size(r)) for r in left if r[3] == source and size(r))]
        taken = sum(n * size(r) for r, n in mixed.items() if r[3] == source)
        assert whole == sum(size(r) for r in left if r[3] == source) and abs(taken - target) <= 130
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, start = [], 0
    for r in sorted(mixed.elements(), key=lambda r: (r[0] is None, r[0] or 0, len(t.encode(r[1] or "", add_special_tokens=False).ids))):
        ids = [*t.encode(r[1] or "", add_special_tokens=False).ids, 2]
        want.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = [tuple(r) for r in corpus_pipeline.run(spark, folder).collect()]
    assert Counter(r[:1] + r[2:] for r in got) == Counter(r[:1] + r[2:] for r in want)
    assert sorted(r[1] for r in got) == sorted(r[1] for r in want)


def test_run_on_empty_tables(spark, folder, tmp_path):
    for table in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    spark.read.parquet(f"{folder}/documents.parquet").limit(20).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0  # no labels, no items: nothing is rejected for them


def test_every_stage_calls_an_operator():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "token_files"]
    assert toxicity.THRESHOLD == 0.5 and corpus_pipeline.ORACLE_SQL is None
