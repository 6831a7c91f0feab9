"""op7 on texts that hold the string of an added token, against an untouched tokenizer."""

import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from subjectlens.llm import token_files


def test_added_tokens_in_texts(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    added = [x.content for x in t.get_added_tokens_decoder().values()]
    assert added
    texts = ["plain words here", *[f"one {x} two{x}\nthree  {x}" for x in added], *added, None, "more words"]
    want, start = [], 0
    for i, x in enumerate(texts):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(tuple(r) for r in token_files.token_files(docs).collect()) == want
