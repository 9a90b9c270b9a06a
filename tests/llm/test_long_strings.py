"""Repeats of strings on both sides of 255 bytes, against all substrings."""

import numpy as np
import pytest
from test_brute_force import cut_repeats

from respeval.llm import substrings


@pytest.mark.parametrize("length", [64, 255, 256, 300, 400])
def test_lengths(spark, length):
    rng = np.random.default_rng(length)
    made = lambda n: "".join(rng.choice(list("abcdefgh é"), n))
    passage = made(420)
    texts = ["", None, "ab" * 500, made(90) + passage, passage + made(70), passage[:280] + made(40), made(50) + passage]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    expected = list(cut_repeats([(t or "").encode() for t in texts], length))
    rows = substrings.without_repeats(docs, length=length).collect()
    assert len(rows) == len(texts) and sum(r["n_removed"] > 400 for r in rows) >= 4
    for r in rows:
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == expected[r["doc_id"]]
