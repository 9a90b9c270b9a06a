"""Benchmark decontamination by size-partitioned MinHash containment search.

A short test item inside a long document has a tiny Jaccard similarity with the whole
document, but not with a window of about its own size. Items are therefore partitioned by
the number of their distinct shingles, in powers of two. For each partition a document is
cut into windows that overlap by half, wide enough for any passage that holds enough of an
item of that size to lie in one of them. Windows and items have one-permutation MinHash
signatures: a hash value falls into one of ``BINS`` bins and the bin keeps its smallest. A
window is a candidate for an item when any bin agrees. Candidates are then verified by the
exact containment of the item's shingles in the whole document.

Words are runs of letters and digits (any byte beyond ASCII is one), A-Z in lower case;
shingles have five words. With ``c`` of an item's shingles in a window, all ``c`` must lose
their bin to other shingles for a miss; the bins outnumber the window's shingles by far
where items are short, so a miss needs odds below one in a million from ``c`` = 3 on.
Items of fewer than four shingles keep every shingle.

Items are searched for in blocks of at most ``BLOCK`` shingles, one pass over the documents
each, so what tasks receive has a fixed bound however many items there are. Documents are
read once per block and never moved. Items shorter than five words have no shingle and are
never found, as are items and documents that are null or empty. Rows with the same id are
searched one by one. Repeated items give the same rows as one. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from respeval.llm.tables import stored, text_or_empty
from respeval.llm.text import byte_ranges, long_lists, map_texts, sequence_hashes, signed, word_hashes

WORDS = 5
SIMILARITY = 0.8
BINS = 1024
BLOCK = 1 << 19
_KEEP_ALL = 4


def item_shingles(items: DataFrame, key: str = "item_id", words: int = WORDS) -> DataFrame:
    """``key`` and the distinct shingle hashes of every item that has one."""

    def kernel(data, offsets):
        hashes, starts = word_hashes(data, offsets, letters_only=True)
        runs = sequence_hashes(hashes, words)
        sets = [
            np.unique(runs[a : max(b - words + 1, a)])
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())
        ]
        sizes = np.array([len(s) for s in sets])
        joined = np.concatenate(sets)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        return [sizes > 0, long_lists(signed(joined), bounds)]

    return map_texts(items, [key], "shingles array<long>", kernel).where(F.col(key).isNotNull())


def _signature(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of each bin; short items keep all their shingles."""
    if len(shingles) < _KEEP_ALL:
        return shingles
    bins = shingles % np.uint64(BINS)
    order = np.lexsort((shingles, bins))
    first = np.concatenate([[True], bins[order][1:] != bins[order][:-1]])
    return shingles[order][first]


class ItemBlock:
    """Signatures of some items by size class, and their shingles for verification."""

    def __init__(self, ids: Sequence[int], sets: Sequence[np.ndarray], similarity: float):
        self.ids = np.array(ids, dtype=np.int64)
        self.sizes = np.array([len(s) for s in sets])
        self.similarity = similarity
        self.all, self.owner = self._indexed(sets, range(len(sets)))
        self.classes = {}
        level = np.ceil(np.log2(np.maximum(self.sizes, 1))).astype(int)
        for k in np.unique(level).tolist():
            members = np.flatnonzero(level == k).tolist()
            self.classes[k] = self._indexed([_signature(sets[i]) for i in members], members)

    @staticmethod
    def _indexed(sets, owners):
        values = np.concatenate(sets)
        owner = np.repeat(np.array(list(owners)), [len(s) for s in sets])
        order = np.argsort(values, kind="stable")
        return values[order], owner[order]

    def candidates(self, runs: np.ndarray, hits: dict[int, np.ndarray]) -> np.ndarray:
        """Items one of whose signature bins agrees with that of a window of ``runs``.

        ``hits`` has, per size class, where ``runs`` equals a signature value: only there
        can a bin agree, and only there is it looked at.
        """
        found = []
        for k, places in hits.items():
            values, owner = self.classes[k]
            half = max(2 << k, 8)
            for at in places.tolist():
                value, agreed = runs[at], (1 << k) < _KEEP_ALL
                block = at // half
                for begin in ((block - 1) * half, block * half):
                    if agreed:
                        break
                    window = runs[max(begin, 0) : begin + 2 * half]
                    rivals = window[window % np.uint64(BINS) == value % np.uint64(BINS)]
                    agreed = rivals.min() == value
                if agreed:
                    a, b = np.searchsorted(values, value), np.searchsorted(values, value, "right")
                    found.append(owner[a:b])
        return np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)

    def search(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items that a text with these shingles contains, and how many shingles are shared."""
        none = np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.searchsorted(self.all, runs)
        present = np.flatnonzero(self.all[np.minimum(at, len(self.all) - 1)] == runs)
        if not len(present):
            return none
        hits = {}
        for k, (values, _) in self.classes.items():
            near = np.minimum(np.searchsorted(values, runs[present]), len(values) - 1)
            hits[k] = present[values[near] == runs[present]]
        candidates = self.candidates(runs, hits)
        if not len(candidates):
            return none
        mine = np.unique(runs[present])
        low, high = np.searchsorted(self.all, mine), np.searchsorted(self.all, mine, "right")
        owners = np.concatenate([self.owner[a:b] for a, b in zip(low, high)])
        shared = np.bincount(owners, minlength=len(self.ids))[candidates]
        # In whole percent, so that the border case is decided exactly.
        enough = 100 * shared >= round(100 * self.similarity) * self.sizes[candidates]
        return candidates[enough], shared[enough]

    def search_texts(self, data: np.ndarray, offsets: np.ndarray, words: int):
        """Text, item and shared shingles of every match among joined texts."""
        hashes, starts = word_hashes(data, offsets, letters_only=True)
        runs = sequence_hashes(hashes, words)
        # A look at all texts at once; most hold no shingle of any item.
        near = np.minimum(np.searchsorted(self.all, runs), len(self.all) - 1)
        places = np.flatnonzero(self.all[near] == runs)
        rows, items, shared = [], [], []
        for row in np.unique(np.searchsorted(starts, places, "right") - 1).tolist():
            a, b = starts[row], starts[row + 1]
            if b - a >= words:
                which, count = self.search(runs[a : b - words + 1])
                rows.append(np.full(len(which), row))
                items.append(which)
                shared.append(count)
        if not rows:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(rows), np.concatenate(items), np.concatenate(shared)


def item_blocks(
    items: DataFrame,
    similarity: float = SIMILARITY,
    words: int = WORDS,
    item_key: str = "item_id",
    block: int = BLOCK,
) -> Iterator[ItemBlock]:
    """The items in blocks of bounded size, dealt out by a hash.

    The first step runs a job that stores the items' shingles.
    """
    distinct = items.select(item_key, text_or_empty().alias("text")).distinct()
    table = stored(item_shingles(distinct, item_key, words), "benchmark-items")
    total = table.agg(F.sum(F.size("shingles"))).first()[0] or 0
    parts = 1 if total <= block else 2 * total // block + 1
    for part in range(parts):
        rows = table.where(F.pmod(F.xxhash64(item_key, "shingles"), F.lit(parts)) == part).collect()
        if rows:
            sets = [np.sort(np.array(r["shingles"], dtype=np.int64).view(np.uint64)) for r in rows]
            yield ItemBlock([r[item_key] for r in rows], sets, similarity)


def find_items(
    docs: DataFrame,
    items: DataFrame,
    similarity: float = SIMILARITY,
    words: int = WORDS,
    key: str = "doc_id",
    item_key: str = "item_id",
    block: int = BLOCK,
) -> DataFrame:
    """``key``, ``item_key``, the item's shingles, those shared, and their ratio.

    One row for every document and item whose containment is at least ``similarity``.
    """
    schema = StructType(
        [docs.schema[key], items.schema[item_key]]
        + [StructField(n, LongType()) for n in ("n_shingles", "n_shared")]
        + [StructField("containment", DoubleType())]
    )
    texts = docs.select(key, text_or_empty().alias("_text_"))
    found = [
        _search(texts, held, words, schema)
        for held in item_blocks(items, similarity, words, item_key, block)
    ]
    if not found:
        return docs.sparkSession.createDataFrame([], schema)
    # Texts under one id, of a document or an item, count once, with what they share most.
    best = F.max(F.struct("containment", "n_shingles", "n_shared")).alias("best")
    pairs = reduce(DataFrame.unionAll, found).groupBy(key, item_key).agg(best)
    return pairs.select(key, item_key, "best.n_shingles", "best.n_shared", "best.containment")


def _search(texts: DataFrame, held: ItemBlock, words: int, schema: StructType) -> DataFrame:
    shared_block = texts.sparkSession.sparkContext.broadcast(held)

    def run(batches):
        held = shared_block.value
        for batch in batches:
            for first, _, data, offsets in byte_ranges(batch.column(1)):
                rows, which, count = held.search_texts(data, offsets, words)
                if len(rows):
                    size = held.sizes[which]
                    columns = [
                        batch.column(0).take(pa.array(first + rows)),
                        pa.array(held.ids[which]),
                        pa.array(size.astype(np.int64)),
                        pa.array(count.astype(np.int64)),
                        pa.array(count / size),
                    ]
                    columns = [c.cast(t) for c, t in zip(columns, types)]
                    yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    types = to_arrow_schema(schema).types
    return texts.mapInArrow(run, schema)


def without_items(
    docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, words: int = WORDS
) -> DataFrame:
    """The documents that contain no item, columns unchanged; rows are filtered as read."""
    for held in item_blocks(items, similarity, words):
        docs = map_texts(docs, docs.columns, "", _clean_rows(docs, held, words))
    return docs


def _clean_rows(docs: DataFrame, held: ItemBlock, words: int):
    shared_block = docs.sparkSession.sparkContext.broadcast(held)

    def kernel(data, offsets):
        stay = np.ones(len(offsets) - 1, dtype=bool)
        stay[shared_block.value.search_texts(data, offsets, words)[0]] = False
        return [stay]

    return kernel
