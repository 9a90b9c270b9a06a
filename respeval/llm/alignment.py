"""How the tokens of two tokenizers line up, with corpus-wide counts by external spill counting.

Both tokenizers cut a space and the text into byte ranges. Where a token of each ends at the
same byte, the two are linked, and the tokens up to there form a group.

The count of a linked pair of ids is taken over the corpus in these steps, each stored:

* Tasks tokenize whole texts in blocks of about ``LINKS`` links. A block's row holds its
  documents, their links, and its *run*: the block's distinct pairs in the order of the second
  tokenizer's id, then the first's, with their number in the block, zstd-compressed.
* Runs are dealt by radix: ranges of the second id (a crowded id is divided further by the
  first id), laid so that each part holds about ``RECORDS`` records, however common an id is.
* One task per part merges its runs with a heap by the second id. Side by side in that
  order lie all first ids of a second id, so their totals and the largest of them are known
  when the heap moves on. Each record's total streams back, in the order it came in, to
  the block that sent it.
* Blocks meet their totals and sum them up per document.

A pair that stands in every document is one record per block. What is held back for a block,
a part or a task is bounded; the largest totals per second id are a table of at most one row
per entry of that tokenizer's vocabulary, as is the plan of the parts.

Tokens never reach over a blank from a letter before it (where a tokenizer's file says so), so
texts are cut there and each task keeps the ids of the pieces it has seen, up to a bound.

Texts that are null or empty, or that a tokenizer does not give back byte for byte (such as
texts with U+2581), have no tokens: their numbers are 0 and their digest is ''. Rows that
share an id each count; rows without an id are kept, with their numbers, under null. Other
columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from respeval.llm.tables import stored, text_or_empty

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_BPE = "/opt/tokenizers/piece_bpe_32k.model"
#: Links in a block (one longer text makes a block of its own), and records in a part.
LINKS = 1 << 21
RECORDS = 1 << 21
#: Bytes of text that are tokenized at once.
SLICE = 1 << 20
_SIDE = 32


#: Blanks that follow a character which is certainly none, and do not end the text.
_CUT = re.compile("(?<=[!-~\u00c0-\u00ff]) (?=.)", re.DOTALL)
#: Pieces, and ids of pieces, that a task keeps.
KEPT = 1 << 17


class Tokens:
    """A tokenizer's ids for texts, and the bytes of every id.

    ``encode`` gives the ids of texts that each stand after a blank. With ``pieces`` a text's
    ids are those of its pieces, which are looked up first.
    """

    def __init__(self, encode, spellings: list[bytes], pieces: bool):
        self.encode = encode
        self.pieces = pieces
        self.known, self.ids, self.bounds = {}, np.empty(0, dtype=np.int64), np.zeros(1, dtype=np.int64)
        self.lengths = np.array([len(p) for p in spellings], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.data = np.frombuffer(b"".join(spellings), dtype=np.uint8)

    def __call__(self, texts: list[str], cut: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (which are ``cut`` into pieces), and the texts' bounds among them."""
        cut = cut if self.pieces else [[t] for t in texts]
        flat = list(chain.from_iterable(cut))
        if len(self.known) > KEPT or len(self.ids) > 8 * KEPT:
            self.known, self.ids, self.bounds = {}, self.ids[:0], self.bounds[:1]
        new = [p for p in dict.fromkeys(flat) if p not in self.known]
        if new:
            made = self.encode(new)
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(made), dtype=np.int64)])
            self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum([len(x) for x in made])])
        at = np.fromiter(map(self.known.__getitem__, flat), dtype=np.int64, count=len(flat))
        sizes = np.diff(self.bounds)[at]
        ends = np.cumsum(sizes)
        ids = self.ids[np.repeat(self.bounds[at] - ends + sizes, sizes) + np.arange(sizes.sum())]
        return ids, np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum([len(c) for c in cut])])]

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        """The joined bytes of the tokens."""
        lengths = self.lengths[ids]
        before = np.cumsum(lengths) - lengths
        return self.data[np.repeat(self.starts[ids] - before, lengths) + np.arange(lengths.sum())]


def _bytes_of_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for.

    Printable Latin-1 characters stand for themselves, the other bytes, in order, for the
    characters from U+0100 on.
    """
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(others)}


@lru_cache(maxsize=4)
def byte_level(path: str) -> Tokens:
    """A byte-level tokenizer, given a space before the text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    letters = _bytes_of_letters()
    pieces = [b""] * tokenizer.get_vocab_size()
    for piece, at in tokenizer.get_vocab().items():
        pieces[at] = bytes(letters[c] for c in piece) if all(c in letters for c in piece) else piece.encode()

    def encode(texts):
        return [e.ids for e in tokenizer.encode_batch([f" {t}" for t in texts], add_special_tokens=False)]

    # Such a splitter lets no token hold a blank after anything else.
    splitter = json.loads(tokenizer.to_str())["pre_tokenizer"] or {}
    return Tokens(encode, pieces, splitter.get("type") == "ByteLevel" and splitter.get("use_regex", False))


@lru_cache(maxsize=4)
def word_pieces(path: str) -> Tokens:
    """A sentence-piece tokenizer, which adds the space itself."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)

    def spelling(at: int) -> bytes:
        piece = model.id_to_piece(at)
        return bytes([int(piece[3:5], 16)]) if model.is_byte(at) else piece.replace("▁", " ").encode()

    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    # No piece holds a blank after anything else, and blanks and letters are left as they are.
    apart = not any("▁" in name.lstrip("▁") for name in names) and model.normalize("  ﬁ  x ") == "▁▁▁ﬁ▁▁x▁"
    return Tokens(lambda texts: model.encode(texts, num_threads=1), [spelling(i) for i in range(len(names))], apart)


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    first, size = 0, 0
    for at, text in enumerate(texts):
        size += len(text)
        if size >= SLICE:
            yield first, at + 1
            first, size = at + 1, 0
    if first < len(texts):
        yield first, len(texts)


def _usable(tokens: Tokens, ids: np.ndarray, bounds: np.ndarray, raw: list[bytes]) -> np.ndarray:
    """Which texts the tokens spell byte for byte."""
    spelled = tokens.spelled(ids)
    ends = np.concatenate([[0], np.cumsum(tokens.lengths[ids])])[bounds].tolist()
    made = spelled.tobytes()
    return np.array([made[a:b] == r for a, b, r in zip(ends[:-1], ends[1:], raw)], dtype=bool)


def _taken(ids: np.ndarray, bounds: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.where(keep, np.diff(bounds), 0)
    return ids[np.repeat(keep, np.diff(bounds))], np.concatenate([[0], np.cumsum(sizes)])


@lru_cache(maxsize=2)
def _numerals(count: int) -> list[str]:
    """Every id with each of the signs that may follow it."""
    return [f"{i}{sign}" for sign in (",", "|", ";", "") for i in range(count)]


def aligned(texts: list[str], a: Tokens, b: Tokens):
    """Per text: numbers of tokens and groups, digest of the groups; and all links in order.

    Links come as (second id, first id) in one number, with each text's bounds among them.
    """
    raw = [f" {t}".encode() if t else b"" for t in texts]
    cut = [_CUT.split(t) for t in texts]
    ids_a, bounds_a = a(texts, cut)
    ids_b, bounds_b = b(texts, cut)
    keep = np.array([bool(t) for t in texts], dtype=bool)
    keep &= _usable(a, ids_a, bounds_a, raw) & _usable(b, ids_b, bounds_b, raw)
    ids_a, bounds_a = _taken(ids_a, bounds_a, keep)
    ids_b, bounds_b = _taken(ids_b, bounds_b, keep)
    ends_a, ends_b = np.cumsum(a.lengths[ids_a]), np.cumsum(b.lengths[ids_b])
    at = np.searchsorted(ends_b, ends_a)
    met = np.flatnonzero(ends_b[np.minimum(at, len(ends_b) - 1)] == ends_a) if len(ends_b) else at
    other = at[met]
    links = ids_b[other] << _SIDE | ids_a[met]
    bounds = np.searchsorted(met, bounds_a)

    # All ids in written order: by group, first tokenizer first, each with the sign after it.
    group_a, group_b = np.searchsorted(met, np.arange(len(ids_a))), np.searchsorted(other, np.arange(len(ids_b)))
    size = max(len(a.lengths), len(b.lengths))
    sign_a, sign_b = np.zeros(len(ids_a), dtype=np.int64), np.zeros(len(ids_b), dtype=np.int64)
    sign_a[met], sign_b[other] = 1, 2
    sign_b[bounds_b[1:][bounds_b[1:] > bounds_b[:-1]] - 1] = 3
    order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
    written = np.concatenate([ids_a + sign_a * size, ids_b + sign_b * size])[order].tolist()
    numerals, digests = _numerals(size), []
    for first, end in zip((bounds_a[:-1] + bounds_b[:-1]).tolist(), (bounds_a[1:] + bounds_b[1:]).tolist()):
        spelled = "".join([numerals[i] for i in written[first:end]])
        digests.append(hashlib.sha256(spelled.encode()).hexdigest() if end > first else "")
    return np.diff(bounds_a), np.diff(bounds_b), np.diff(bounds), digests, links, bounds


def _packed(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).tobytes())


def _unpacked(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=kind)


def _run(codes: np.ndarray, counts: np.ndarray) -> bytes:
    """A sorted run of pairs with their counts."""
    return _packed(np.concatenate([np.diff(codes, prepend=0), counts]).astype(np.int64))


def _run_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps, counts = _unpacked(data, np.int64).reshape(2, -1)
    return np.cumsum(steps), counts


_PER_TEXT = ("n_a", "n_b", "n_groups")


def token_blocks(docs: DataFrame, key: str, text: str, byte_bpe: str, piece_bpe: str, links: int = LINKS) -> DataFrame:
    """Rows of ``links`` links or more: documents with their numbers, links, and sorted run."""
    source = docs.select(F.col(key).alias("key"), text_or_empty(text).alias("text"))
    schema = StructType(
        [StructField("keys", ArrayType(docs.schema[key].dataType))]
        + StructType.fromDDL(
            "block long, n_a array<long>, n_b array<long>, n_groups array<long>, digests array<string>,"
            " links binary, n_records long, run binary"
        ).fields
    )

    def run(batches):
        a, b = byte_level(byte_bpe), word_pieces(piece_bpe)
        number = TaskContext.get().partitionId() << 32
        held, size = [], 0
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for first, end in _slices(texts):
                *columns, codes, _ = aligned(texts[first:end], a, b)
                held.append((batch.column(0).slice(first, end - first).to_pylist(), *columns, codes))
                size += len(codes)
                if size >= links:
                    yield _block(held, number, batch.schema.field(0).type)
                    held, size, number = [], 0, number + 1
        if held:
            yield _block(held, number, batch.schema.field(0).type)

    return source.mapInArrow(run, schema)


def _block(held: list, number: int, key_type: pa.DataType) -> pa.RecordBatch:
    keys, *numbers, digests, codes = zip(*held)
    codes = np.concatenate(codes)
    distinct, place, counts = np.unique(codes, return_inverse=True, return_counts=True)
    columns = [
        pa.array([[k for part in keys for k in part]], pa.list_(key_type)),
        pa.array([number], pa.int64()),
        *[pa.array([np.concatenate(n).astype(np.int64)], pa.list_(pa.int64())) for n in numbers],
        pa.array([[d for part in digests for d in part]], pa.list_(pa.string())),
        pa.array([_packed(place.astype(np.uint32))], pa.binary()),
        pa.array([len(distinct)], pa.int64()),
        pa.array([_run(distinct, counts)], pa.binary()),
    ]
    names = ["keys", "block", *_PER_TEXT, "digests", "links", "n_records", "run"]
    return pa.RecordBatch.from_arrays(columns, names=names)


class Radix:
    """Which part a pair belongs to: ranges of second ids, a crowded one split by first id."""

    def __init__(self, ids: np.ndarray, records: np.ndarray, most: int):
        """``records`` counts the records of each second id of ``ids`` over all runs."""
        self.first, self.split, part, filled = {}, {}, 0, 0
        for at, count in zip(ids.tolist(), records.tolist()):
            pieces = -(-count // most)
            if pieces > 1 or filled + count > most:
                part, filled = part + (filled > 0), 0
            self.first[at], self.split[at] = part, pieces
            part, filled = (part + pieces, 0) if pieces > 1 else (part, filled + count)
        size = max(self.first, default=-1) + 1
        self.part = np.zeros(size, dtype=np.int64)
        self.pieces = np.ones(size, dtype=np.int64)
        for at in self.first:
            self.part[at], self.pieces[at] = self.first[at], self.split[at]

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        second, first = codes >> _SIDE, codes & 0xFFFFFFFF
        return self.part[second] + first * 0x9E3779B1 % 0xFFFFFFFB % self.pieces[second]


def _records_per_id(blocks: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Records of each second id; one row per entry of a vocabulary at most."""

    def run(batches):
        held = []
        for batch in batches:
            for data in batch.column(0):
                held.append(np.unique(_run_of(data.as_py())[0] >> _SIDE, return_counts=True))
            if held:
                ids, counts = (np.concatenate(side) for side in zip(*held))
                distinct, place = np.unique(ids, return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(distinct), pa.array(np.bincount(place, weights=counts).astype(np.int64))],
                    names=["id", "n"],
                )
                held = []

    counted = blocks.select("run").mapInArrow(run, "id long, n long").groupBy("id")
    found = counted.agg(F.sum("n").alias("n")).orderBy("id").toArrow()
    return found.column("id").to_numpy(), found.column("n").to_numpy()


def _dealt(blocks: DataFrame, radix: Radix) -> DataFrame:
    def run(batches):
        for batch in batches:
            for number, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                codes, counts = _run_of(data.as_py())
                parts = radix(codes)
                order = np.argsort(parts, kind="stable")
                names, starts = np.unique(parts[order], return_index=True)
                pieces = np.split(order, starts[1:]) if len(names) else []
                runs = [_run(codes[piece], counts[piece]) for piece in pieces]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names), pa.array([number] * len(names), pa.int64()), pa.array(runs, pa.binary())],
                    names=["part", "block", "run"],
                )

    return blocks.select("block", "run").mapInArrow(run, "part long, block long, run binary")


def merged(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Totals of every record of every run; second ids, and the largest total of each.

    A heap holds the next second id of every run. What the runs have for the smallest one
    is added up together.
    """
    totals, heap, sides, tops = [np.empty(len(c), dtype=np.int64) for c, _ in runs], [], [], []
    borders = []
    for at, (codes, _) in enumerate(runs):
        second = codes >> _SIDE
        starts = np.flatnonzero(np.diff(second, prepend=-1))
        borders.append((np.append(starts, len(codes)).tolist(), second[starts].tolist()))
        if len(codes):
            heap.append((borders[at][1][0], at, 0))
    heapq.heapify(heap)
    while heap:
        side, taken = heap[0][0], []
        while heap and heap[0][0] == side:
            _, at, place = heap[0]
            bounds, names = borders[at]
            taken.append((at, bounds[place], bounds[place + 1]))
            if place + 1 < len(names):
                heapq.heapreplace(heap, (names[place + 1], at, place + 1))
            else:
                heapq.heappop(heap)
        firsts = np.concatenate([runs[at][0][x:y] for at, x, y in taken])
        counts = np.concatenate([runs[at][1][x:y] for at, x, y in taken])
        _, place = np.unique(firsts, return_inverse=True)
        sums = np.zeros(place.max() + 1, dtype=np.int64)
        np.add.at(sums, place, counts)
        back, done = sums[place], 0
        for at, x, y in taken:
            totals[at][x:y] = back[done : done + y - x]
            done += y - x
        sides.append(side)
        tops.append(int(sums.max()))
    return totals, np.array(sides, dtype=np.int64), np.array(tops, dtype=np.int64)


def _totals(dealt: DataFrame) -> DataFrame:
    """Per part and block the totals of its records; one row more per part with the maxima."""

    def merge(group: pa.Table) -> pa.Table:
        runs = [_run_of(data.as_py()) for data in group.column("run")]
        totals, sides, tops = merged(runs)
        n = len(runs)
        return pa.table(
            {
                "part": pa.array(group.column("part").to_pylist() + [None], pa.int64()),
                "block": pa.array(group.column("block").to_pylist() + [None], pa.int64()),
                "totals": pa.array([_packed(t) for t in totals] + [None], pa.binary()),
                "sides": pa.array([None] * n + [sides], pa.list_(pa.int64())),
                "tops": pa.array([None] * n + [tops], pa.list_(pa.int64())),
            }
        )

    schema = "part long, block long, totals binary, sides array<long>, tops array<long>"
    return dealt.groupBy("part").applyInArrow(merge, schema)


def _largest(totals: DataFrame) -> np.ndarray:
    """The largest total of each second id; as long as a vocabulary at most."""
    each = totals.where("block IS NULL").select(F.inline(F.arrays_zip("sides", "tops")))
    found = each.groupBy("sides").agg(F.max("tops").alias("top")).toArrow()
    sides = found.column("sides").to_numpy()
    largest = np.zeros(int(sides.max()) + 1 if len(sides) else 0, dtype=np.int64)
    largest[sides] = found.column("top").to_numpy()
    return largest


def alignment(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    byte_bpe: str = BYTE_BPE,
    piece_bpe: str = PIECE_BPE,
    links: int = LINKS,
    records: int = RECORDS,
) -> DataFrame:
    """Per row: ``key``, tokens of both, groups, links, and what the corpus says of the links.

    ``n_best`` counts the links whose pair is the most frequent one of its second id, ties
    included, ``count_sum`` adds up the counts of all links' pairs. The paths must lead to the
    tokenizers' files on every executor.
    """
    blocks = stored(token_blocks(docs, key, text, byte_bpe, piece_bpe, links), "token-blocks")
    radix = Radix(*_records_per_id(blocks), records)
    totals = stored(_totals(_dealt(blocks, radix)), "pair-totals")
    largest = _largest(totals)
    returned = totals.where("block IS NOT NULL").groupBy("block")
    returned = returned.agg(F.collect_list(F.struct("part", "totals")).alias("returned"))
    met = blocks.join(returned, "block", "left").select(
        "keys", *_PER_TEXT, "digests", "links", "run", "returned"
    )
    schema = StructType(
        [StructField(key, docs.schema[key].dataType)]
        + StructType.fromDDL(
            "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
        ).fields
    )

    def run(batches):
        for batch in batches:
            for row in batch.to_struct_array():
                yield _per_document(row, radix, largest, schema.names)

    return met.mapInArrow(run, schema)


def _per_document(row, radix: Radix, largest: np.ndarray, names: list[str]) -> pa.RecordBatch:
    codes, _ = _run_of(row["run"].as_py())
    parts = radix(codes)
    counts = np.zeros(len(codes), dtype=np.int64)
    for piece in row["returned"].as_py() or []:
        counts[parts == piece["part"]] = _unpacked(piece["totals"], np.int64)
    best = counts == largest[codes >> _SIDE]
    place = _unpacked(row["links"].as_py(), np.uint32)
    n_links = row["n_groups"].values.to_numpy()
    bounds = np.concatenate([[0], np.cumsum(n_links)])
    sums = [np.concatenate([[0], np.cumsum(x[place].astype(np.int64))])[bounds] for x in (best, counts)]
    return pa.RecordBatch.from_arrays(
        [
            row["keys"].values,
            *[row[name].values for name in _PER_TEXT],
            pa.array(n_links),
            *[pa.array(np.diff(s)) for s in sums],
            row["digests"].values,
        ],
        names=names,
    )
