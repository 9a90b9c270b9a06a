"""The prefix-tree join against all pairs."""

import itertools
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from respeval.llm import prefixtree
from respeval.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


def grams(text, k=3):
    folded = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", folded)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}


def plain(rows, percent=90):
    """Size and smallest reachable id of each row; all rows of an id are one document."""
    sets = [(i, grams(t)) for i, t in rows]
    root = {i: i for i, _ in sets if i is not None}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    named = sorted(((len(s), i, s) for i, s in sets if i is not None and s), key=lambda x: x[:2])
    for at, (n, i, s) in enumerate(named):
        for m, j, t in itertools.islice(named, at + 1, None):
            if percent * m > 100 * n:
                break
            both = len(s & t)
            if 100 * both >= percent * (n + m - both):
                low, high = sorted((top(i), top(j)))
                root[high] = low
    return sorted(((i, len(s), None if i is None else top(i)) for i, s in sets), key=str)


def rows_of(frame):
    return [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]


def found(frame):
    return sorted(map(tuple, frame.collect()), key=str)


@pytest.mark.parametrize("folder", [SMALL, MEDIUM])
def test_query(spark, folder):
    expected = plain(rows_of(spark.read.parquet(f"{folder}/documents.parquet")))
    assert sum(i != c for i, _, c in expected) > 10
    assert found(QUERIES["op11_prefix_tree_join"](spark, folder)) == expected


def loose_copies(n, words=150, most=14, seed=3):
    """A base and copies with ever more of it replaced, some by what other copies have too."""
    rng = np.random.default_rng(seed)
    base = [f"b{i}" for i in range(words)]
    made = []
    for i in range(n):
        copy = list(base)
        for at in rng.choice(words, size=i % most, replace=False):
            copy[at] = f"n{rng.integers(30)}"
        made.append((i, " ".join(copy[: words - int(rng.integers(4))])))
    return made


@pytest.mark.parametrize("block", [1 << 20, 3000, 300])
def test_large_family(spark, monkeypatch, block):
    """A family within a block, of several blocks, and of blocks that hold one set each."""
    monkeypatch.setattr(prefixtree, "BLOCK", block)
    made = loose_copies(60) + [(100 + i, t) for i, t in loose_copies(40, 80, 5, 4)]
    docs = spark.createDataFrame(made, "doc_id long, text string")
    expected = plain(made)
    assert len({c for _, _, c in expected}) > 5
    assert found(prefixtree.similar_documents(docs)) == expected


def test_odd_rows(spark, odd_docs, no_docs):
    assert found(prefixtree.similar_documents(odd_docs)) == plain(rows_of(odd_docs))
    assert found(prefixtree.similar_documents(no_docs)) == []


def test_rows_that_share_an_id(spark):
    """Different texts under one id join what each of them is linked with."""
    one, two = " ".join(f"a{i}" for i in range(40)), " ".join(f"c{i}" for i in range(40))
    made = [(1, one), (9, one), (9, two), (5, two + " tail"), (7, "x y"), (7, "x y"), (7, None)]
    docs = spark.createDataFrame(made, "doc_id long, text string")
    expected = sorted([(1, 38, 1), (9, 38, 1), (9, 38, 1), (5, 39, 1), (7, 1, 7), (7, 1, 7), (7, 0, 7)], key=str)
    assert found(prefixtree.similar_documents(docs)) == expected


@settings(max_examples=150, deadline=None)
@given(
    st.lists(st.sets(st.integers(0, 25), min_size=1, max_size=22), min_size=1, max_size=14),
    st.sampled_from([50, 80, 90]),
    st.sampled_from([2, 32]),
)
def test_tree_finds_every_partner(sets, percent, stride):
    prefixtree.STRIDE, before = stride, prefixtree.STRIDE
    try:
        arrays = [np.array(sorted(s), dtype=np.int64) for s in sets]
        tree = prefixtree.Tree(arrays, np.array([len(s) for s in sets]))
    finally:
        prefixtree.STRIDE = before
    for x in range(len(sets)):
        mine = sets[tree.order[x]]
        others = [sets[i] for i in tree.order]
        expected = {y for y, o in enumerate(others) if 100 * len(mine & o) >= percent * len(mine | o)}
        assert set(tree.partners(x, np.ones(len(sets), dtype=bool), percent).tolist()) == expected
