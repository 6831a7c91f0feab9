"""op13: ids against the public tokenizer, sequences without gaps, and few of them."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from subjectlens.llm import best_fit
from subjectlens.llm.shared import read

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, piece string, length string"


def wrong(rows: list, docs: list[tuple], capacity: int = best_fit.CAPACITY) -> str:
    """Empty if rows are the pieces of docs, cut as they must be, in sequences without gaps."""
    plain = Tokenizer.from_file(public_tokenizers.path(best_fit.TOKENIZER))
    want = []
    for doc_id, text in docs:
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, best_fit.END_ID], "<u4")
        first = len(ids) % capacity or min(len(ids), capacity)
        cut = [0, *range(first, len(ids) + 1, capacity)]
        want += [(doc_id, k, a, e - a, zlib.crc32(ids[a:e])) for k, (a, e) in enumerate(zip(cut, cut[1:], strict=False))]
    key = lambda r: tuple(map(str, r))
    if sorted((tuple(r)[:5] for r in rows), key=key) != sorted(want, key=key):
        return "other pieces"
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for pieces in held.values():
        at = 0
        for offset, length in sorted(pieces):
            if offset != at:
                return "gap or overlap"
            at += length
        if at > capacity:
            return "too long"
    return ""


def fewest(sizes: list[int], capacity: int) -> int:
    """Sequences of best-fit decreasing with all bins open: what a single machine that holds everything gets."""
    bins = best_fit.Bins(capacity, len(sizes) + 1)
    closed = sum(bins.put(s, s) is not None for s in sorted(sizes, reverse=True))
    return closed + len(bins.rest())


def test_documents(spark):
    docs = [(r.doc_id, r.text) for r in read(spark, SF, "documents").collect()]
    rows = best_fit.op13_best_fit_packing(spark, SF).collect()
    assert not wrong(rows, docs)
    assert len({r.sequence_id for r in rows}) <= fewest([r.length for r in rows], best_fit.CAPACITY)


def test_awkward_rows(spark):
    long = " ".join(f"word{k % 977}" for k in range(30_000))
    docs = [(1, None), (2, ""), (None, "no id"), (None, "no id"), (3, long), (3, long), (3, "a"), (4, "one " * 2047), (5, "one " * 2048), (6, "é 日本 \x00\n\n  x")]
    rows = best_fit.pack(spark.createDataFrame([(*d, "extra", "extra") for d in docs], COLUMNS)).collect()
    assert not wrong(rows, docs)
    assert best_fit.pack(spark.createDataFrame([], COLUMNS)).collect() == []


@pytest.mark.parametrize("most, a_task", [(2, 50), (16, 100), (8192, 100), (8192, 16_384)])
def test_rounds(spark, monkeypatch, most, a_task):
    monkeypatch.setattr(best_fit, "PIECES_A_TASK", a_task)
    rng = random.Random(5)
    docs = [(k, " ".join("ab cd e fgh".split()[rng.randrange(4)] for _ in range(int(rng.lognormvariate(2.5, 1))))) for k in range(2000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(16, F.col("doc_id"))
    rows = best_fit.pack(frame, capacity=64, most=most).collect()
    assert not wrong(rows, docs, 64)
    used, least = len({r.sequence_id for r in rows}), -(-sum(r.length for r in rows) // 64)
    assert used <= {2: 1.15, 16: 1.05, 8192: 1.0}[most] * least + 1


def test_texts_that_never_share_a_sequence(spark, monkeypatch):
    """All are longer than half a sequence: no round can mend that, so there are two."""
    monkeypatch.setattr(best_fit, "PIECES_A_TASK", 20)
    docs = [(k, "ab cd " * (20 + k % 5)) for k in range(300)]
    rows = best_fit.pack(spark.createDataFrame(docs, "doc_id long, text string").repartition(7), capacity=64).collect()
    assert not wrong(rows, docs, 64) and len({r.sequence_id for r in rows}) == len(rows) == 300


def test_full_sequences_never_wait():
    bins = best_fit.Bins(8, 2)
    assert bins.put(8, "a") == (["a"], 0) and bins.put(5, "b") is None and bins.put(4, "c") is None
    assert bins.put(3, "d") == (["b", "d"], 0)  # best fit: 3 free, not 4
    assert bins.put(7, "e") is None and bins.put(6, "f") == (["e"], 1)  # one too many: the fullest closes
    assert bins.rest() == [(["f"], 2), (["c"], 4)] and not bins.free and not bins.n
