"""Models of more shards than one step averages come together by size, in one step or in several."""

import numpy as np

from subjectlens.llm import lm_score


def test_averages_in_several_steps(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "FAN_IN", 2)
    models = [np.full(3, k, np.float32) for k in range(5)]
    rows = spark.createDataFrame([(k, k + 1, w.tobytes()) for k, w in enumerate(models)], "shard long, n long, w binary")
    found = {r.shard: (r.n, np.frombuffer(r.w, np.float32).tolist()) for r in lm_score._averaged(rows).collect()}
    assert {k: n for k, (n, _) in found.items()} == {0: 3, 1: 7, 2: 5}
    for g, (n, w) in found.items():
        mine = range(2 * g, min(2 * g + 2, 5))
        assert np.allclose(w, sum((k + 1) * models[k] for k in mine) / n)


def test_many_shards_give_scores(spark, monkeypatch):
    rows = [(k, " ".join(f"w{(k * j) % 11}" for j in range(40))) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(lm_score, "FAN_IN", 2)
    monkeypatch.setattr(lm_score, "MOST_SHARD", 400)
    found = lm_score.score_documents(docs).collect()
    assert sorted(r.doc_id for r in found) == list(range(60)) and all(np.isfinite(r.score) and r.score < 0 for r in found)
