"""Token alignment against a plain version over a whole table."""

import collections
import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from respeval.llm import alignment
from respeval.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizers():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(alignment.BYTE_BPE)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=alignment.PIECE_BPE)


def plain(rows, tokenizers):
    """Every pair of tokens is compared by its byte range's end."""
    a, b = tokenizers
    letters = alignment._bytes_of_letters()
    documents, counts = [], collections.Counter()
    for key, text in rows:
        one, two = [], []
        if text:
            for at in a.encode(" " + text, add_special_tokens=False).ids:
                one.append((at, bytes(letters[c] for c in a.id_to_token(at))))
            for at in b.encode(text):
                piece = b.id_to_piece(at)
                raw = bytes([int(piece[3:5], 16)]) if b.is_byte(at) else piece.replace("▁", " ").encode()
                two.append((at, raw))
            whole = (" " + text).encode()
            if b"".join(r for _, r in one) != whole or b"".join(r for _, r in two) != whole:
                one, two = [], []
        ends = [np.cumsum([len(r) for _, r in side]).tolist() for side in (one, two)]
        places = [{end: i + 1 for i, end in enumerate(side)} for side in ends]
        common = sorted(set(ends[0]) & set(ends[1]))
        groups, links, at = [], [], [0, 0]
        for end in common:
            to = [side[end] for side in places]
            cut = [[i for i, _ in side[x:y]] for side, x, y in zip((one, two), at, to)]
            groups.append("|".join(",".join(map(str, ids)) for ids in cut))
            links.append((one[to[0] - 1][0], two[to[1] - 1][0]))
            at = to
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        documents.append((key, len(one), len(two), len(groups), links, digest))
        counts.update(links)
    top = collections.Counter()
    for (_, second), n in counts.items():
        top[second] = max(top[second], n)
    return sorted(
        (
            (key, n_a, n_b, n, len(links), sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links), digest)
            for key, n_a, n_b, n, links, digest in documents
        ),
        key=str,
    )


def rows_of(frame):
    return [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]


def found(frame):
    return sorted(map(tuple, frame.collect()), key=str)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab Z9é.,'s\n\t\xa0\u2003▁漢ﬁ\x85<>|\U0001f600"), max_size=25), min_size=1, max_size=5))
def test_pieces_give_the_ids_of_the_whole_text(tokenizers, texts):
    a, b = alignment.byte_level(alignment.BYTE_BPE), alignment.word_pieces(alignment.PIECE_BPE)
    assert a.pieces and b.pieces
    for mine, whole in ((a, lambda t: tokenizers[0].encode(" " + t, add_special_tokens=False).ids), (b, tokenizers[1].encode)):
        ids, bounds = mine(texts, [alignment._CUT.split(t) for t in texts])
        assert [ids[x:y].tolist() for x, y in zip(bounds[:-1], bounds[1:])] == [whole(t) for t in texts]


def test_query(spark, tokenizers):
    expected = plain(rows_of(spark.read.parquet(f"{SMALL}/documents.parquet")), tokenizers)
    assert found(QUERIES["op12_token_alignment"](spark, SMALL)) == expected


def test_many_blocks_and_split_ids(spark, tokenizers):
    """Blocks and parts so small that runs are merged and crowded ids divided."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where(F.length("text") < 3000).repartition(7)
    made = alignment.alignment(docs, links=500, records=40)
    assert found(made) == plain(rows_of(docs), tokenizers)


def test_odd_rows(spark, odd_docs, no_docs, tokenizers):
    odd = spark.createDataFrame(
        [
            (20, "a▁b"), (21, "<|endoftext|> and <s> </s> <unk> <0x41>"), (22, "  two  blanks "),
            (23, "é\U0001f600漢字 é"), (24, "\x00\x01\t\r\n"), (25, "ﬁ ① 　"), (26, " "),
        ],
        "doc_id long, text string",
    )
    docs = odd_docs.select("doc_id", "text").unionAll(odd)
    assert found(alignment.alignment(docs)) == plain(rows_of(docs), tokenizers)
    assert found(alignment.alignment(no_docs)) == []
    named = docs.select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "text")
    assert alignment.alignment(named).schema["doc_id"].dataType.simpleString() == "string"
    assert found(alignment.alignment(named)) == plain(rows_of(named), tokenizers)


def test_parts_hold_what_they_may():
    records = np.array([5, 1000, 3, 3, 4, 90])
    radix = alignment.Radix(np.array([0, 1, 4, 5, 6, 9]), records, 100)
    codes = np.concatenate([(np.int64(i) << 32) + np.arange(n) for i, n in zip([0, 1, 4, 5, 6, 9], records)])
    sizes = np.bincount(radix(codes))
    assert sizes.sum() == len(codes) and sizes.max() < 150 and len(sizes) == 12


def test_merge_of_runs():
    rng = np.random.default_rng(2)
    runs, total = [], collections.Counter()
    for _ in range(9):
        codes = np.unique(rng.integers(0, 6, 30) << 32 | rng.integers(0, 9, 30))
        counts = rng.integers(1, 5, len(codes))
        runs.append((codes, counts))
        for c, n in zip(codes.tolist(), counts.tolist()):
            total[c] += n
    totals, sides, tops = alignment.merged([*runs, (codes[:0], counts[:0])])
    for (codes, _), made in zip(runs, totals):
        assert made.tolist() == [total[c] for c in codes.tolist()]
    assert dict(zip(sides.tolist(), tops.tolist())) == {
        s: max(n for c, n in total.items() if c >> 32 == s) for s in {c >> 32 for c in total}
    }
