"""The recurrent model of op5 is trained on every symbol of every document it may learn from."""

import numpy as np

from subjectlens.llm import gru


def _docs(layout, n=700):
    rng = np.random.default_rng(3)
    return [np.r_[np.cumsum(rng.integers(1, 3, size)) % layout.words, layout.end].astype(np.int32) for size in rng.integers(0, 300, n)]


def test_every_symbol_is_trained_on():
    layout = gru.Layout(64, 12)
    docs = _docs(layout)
    counts = np.bincount(np.concatenate(docs), minlength=layout.symbols).astype(float)
    flat = gru.initial(layout, counts)
    after, seen = gru.train(flat, layout, iter(docs))
    assert seen == sum(map(len, docs))
    assert gru.train(flat, layout, iter([]))[1] == 0
    before, now = (gru.score(gru.unpack(w, layout), layout, docs).sum() for w in (flat, after))
    assert now > before
