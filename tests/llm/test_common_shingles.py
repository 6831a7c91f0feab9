"""The order of keys of the near-copy stage comes from all texts."""

from collections import Counter

import numpy as np

from subjectlens.llm import near_copies


def test_counts_are_of_all_texts(spark):
    texts = [f"one two three four five six w{i} x{i} y{i}" if i % 3 else f"a{i} b{i} c{i} d{i} e{i} f{i}" for i in range(45_000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "sid long, text string")
    keys, counts = near_copies._common(rows)
    want = Counter(k for x in texts for k in near_copies.shingles(x).tolist())
    want = {k: n for k, n in want.items() if n >= near_copies.LEAST}
    assert dict(zip(keys.tolist(), counts.tolist(), strict=True)) == want and np.all(keys[1:] > keys[:-1])
