"""Phrase collocations against plain counting over whole tables."""

import collections
import re

import numpy as np
import pytest

from respeval.llm import collocations
from respeval.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


def plain(rows, least=30, top=2000, percent=80):
    counts, words = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        folded = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", folded):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(w)
            for k in range(1, 5):
                counts[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    expected = []
    for lang, f in counts.items():
        candidates = {g: a for g, a in f.items() if len(g) >= 2 and a >= least}
        longest = collections.Counter()
        for g, a in candidates.items():
            for k in range(2, len(g)):
                for i in range(len(g) - k + 1):
                    longest[g[i : i + k]] = max(longest[g[i : i + k]], a)
        rows = []
        for g, a in candidates.items():
            if longest[g] and 100 * longest[g] >= percent * a:
                continue
            cuts = [(2000000 * a // (f[g[:k]] + f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g))]
            score, _, left, right = min(cuts)
            rows.append((-score, -a, " ".join(g).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            expected.append((lang, rank, phrase.decode(), -a, left, right, words[lang], -score))
    return sorted(expected)


def held(frame):
    return [(r["lang"], r["text"]) for r in frame.select("lang", "text").collect()]


def found(frame):
    return sorted(map(tuple, frame.collect()))


@pytest.mark.parametrize("folder", [SMALL, MEDIUM])
def test_query(spark, folder):
    expected = plain(held(spark.read.parquet(f"{folder}/documents.parquet")))
    assert expected and found(QUERIES["op13_collocations"](spark, folder)) == expected


@pytest.mark.parametrize("tables", [(7, 5), (0, 0), (7, 1000)])
def test_units_beyond_the_tables(spark, tables):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    made = collocations.collocations(docs, word_table=tables[0], pair_table=tables[1])
    assert found(made) == plain(held(docs))


def test_top_and_borders(spark):
    """Ties, pieces, folding, blanks that are not separators, and overlapping phrases."""
    texts = ["A b\tC  d, a b c d! A B. c d\nx\x0by x y", "a a a a a a", "z\xa0z z\xa0z", "p:q;r?s", " ", "a b c d"]
    rows = [(lang, t) for lang in ("en", None, "und", "") for t in texts * 3]
    docs = spark.createDataFrame(rows, "lang string, text string")
    for top in (1, 3, 100):
        assert found(collocations.collocations(docs, least=4, top=top)) == plain(rows, 4, top)


def test_odd_rows(spark, odd_docs, no_docs):
    assert found(collocations.collocations(odd_docs, least=3)) == plain(held(odd_docs), 3)
    assert found(collocations.collocations(no_docs)) == []


def test_tiles_count_like_a_counter(monkeypatch):
    monkeypatch.setattr(collocations, "CROWDED", 50)
    rng = np.random.default_rng(5)
    a = np.concatenate([rng.integers(0, 40, 500), rng.integers(0, 5000, 300), -rng.integers(1, 5, 60)])
    b = np.concatenate([rng.integers(0, 40, 500), rng.integers(0, 5000, 300), rng.integers(-3, 3, 60)])
    x, y, n = collocations.tile_counts(a, b)
    expected = collections.Counter(zip(a.tolist(), b.tolist()))
    assert dict(zip(zip(x.tolist(), y.tolist()), n.tolist())) == expected


def test_scores_pass_64_bits(spark):
    """Counts so large that the product of count and scale needs more than 64 bits."""
    large = 10**16
    vocabulary = spark.createDataFrame([(0, "en", "a", large + 3), (1, "en", "b", large + 7)], "unit long, lang string, word string, n long")
    pairs = spark.createDataFrame([(0, 0, 1, large)], "unit long, a long, b long, n long")
    phrases = collocations._longer(collocations._single(vocabulary), pairs)
    totals = spark.createDataFrame([("en", 2 * large + 10)], "lang string, n long")
    (row,) = collocations.ranked_phrases(totals, vocabulary, phrases).collect()
    assert row["score"] == 2000000 * large // (2 * large + 10)
