"""Phrases whose words keep company, per language, by direct-address tiles of ranked pairs.

Words are ranked by frequency. A pair of ranked units has an address: the tile of the two
ranks, and the cell in it. In every task the cells of a crowded tile are counted with one
dense ``bincount``, those of all other tiles as sorted coordinates with counts; Spark adds up
the tasks' partial counts, one row per cell, so neither a frequent pair nor a frequent tile
meets in one place uncounted. Pairs found often enough are ranked in turn and are the units of
the next round: two pairs that overlap in a word are a phrase of three, two of these that
overlap in two words one of four. Only phrases whose parts are frequent are ever counted.

The ranks that tasks need are tables of at most ``WORD_TABLE`` words and ``PAIR_TABLE`` phrases.
Where more units are frequent, those beyond the table are counted under their 64-bit keys,
always as sorted coordinates, so the result is whole at every size.

Null texts are empty. A null language is ``und``. Equal rows count each time. Other columns,
ids included, are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from respeval.llm.tables import stored, text_or_empty
from respeval.llm.text import byte_ranges, mix, signed, word_table

LEAST = 30
TOP = 2000
PERCENT = 80
LONGEST = 4
SCALE = 2_000_000
WORD_TABLE = 1 << 16
PAIR_TABLE = 1 << 19
#: Pairs that a task holds before it counts them.
HELD = 1 << 19
#: Ranks along the side of a tile, as a power of two, and what makes a tile crowded.
SIDE = 10
CROWDED = 1 << 16

_ENDS = np.zeros(256, dtype=bool)
_ENDS[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_INSIDE = ~_ENDS
_INSIDE[[0x20, 0x09]] = False
_KEY = np.uint64(1 << 63)
_ODD = np.uint64(0x9FB21C651E98DF25)


def _keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Keys of pairs of units: negative numbers, which no rank is."""
    return signed(mix(left.view(np.uint64) * _ODD + mix(right.view(np.uint64))) | _KEY)


class Ranks:
    """The rank of a key, or the key itself where the table does not hold every frequent one."""

    def __init__(self, keys: np.ndarray, complete: bool):
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.complete = complete

    def __call__(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A unit per key, and whether it may be frequent."""
        if not len(self.keys):
            return keys, np.full(len(keys), not self.complete)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        known = self.keys[at] == keys
        return np.where(known, self.order[at], keys), known | (not self.complete)


def _words(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Word keys of some texts, which words follow their predecessor in a piece, and more."""
    langs = batch.column(0)
    lang_names, lang_of = np.unique(np.asarray(langs.to_pylist(), dtype=object), return_inverse=True)
    salts = np.array([hash_of(name) for name in lang_names], dtype=np.uint64)
    for first, end, data, offsets in byte_ranges(batch.column(1)):
        hashes, at, _, starts = word_table(data, offsets, table=_INSIDE)
        text = np.repeat(np.arange(end - first), np.diff(starts))
        lang = lang_of[first:end][text]
        piece = np.searchsorted(np.flatnonzero(_ENDS[data]), at)
        follows = np.zeros(len(at), dtype=bool)
        follows[1:] = (piece[1:] == piece[:-1]) & (text[1:] == text[:-1])
        keys = signed(mix(hashes + salts[lang] if len(at) else hashes) | _KEY)
        yield keys, follows, lang, at, text, data, offsets, lang_names


def hash_of(name: str) -> int:
    """A number for a language, the same on every machine."""
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little")


def _texts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    name = F.coalesce(F.col(lang).cast("string"), F.lit("und"))
    return docs.select(name.alias("lang"), text_or_empty(text).alias("text"))


def word_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang``, ``word``, its ``key`` and how often it occurs (``n``)."""

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            for keys, _, lang_at, at, owner, data, offsets, names in _words(batch):
                distinct, index, counts = np.unique(keys, return_index=True, return_counts=True)
                outside = np.flatnonzero(~_INSIDE[data])
                starts = at[index]
                ends = np.append(outside, len(data))[np.searchsorted(outside, starts)]
                ends = np.minimum(ends, offsets[1:][owner[index]])
                raw = data.tobytes()
                words = [raw[a:b].decode().translate(_FOLD) for a, b in zip(starts.tolist(), ends.tolist())]
                held.append(
                    pa.table([names[lang_at[index]].tolist(), words, distinct, counts], schema=_COUNTED)
                )
                rows += len(words)
                if rows >= HELD:
                    yield from _merged(held)
                    held, rows = [], 0
        if held:
            yield from _merged(held)

    counted = _texts(docs, text, lang).mapInArrow(run, "lang string, word string, key long, n long")
    return counted.groupBy("lang", "word", "key").agg(F.sum("n").alias("n"))


_FOLD = {code: code + 32 for code in range(65, 91)}
_COUNTED = pa.schema(
    [("lang", pa.string()), ("word", pa.string()), ("key", pa.int64()), ("n", pa.int64())]
)


def _merged(tables: list[pa.Table]) -> list[pa.RecordBatch]:
    summed = pa.concat_tables(tables).group_by(["lang", "word", "key"]).aggregate([("n", "sum")])
    return summed.rename_columns(_COUNTED.names).to_batches(max_chunksize=1 << 16)


def tile_counts(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of units, and how often each occurs."""
    ranked = (a >= 0) & (b >= 0)
    parts = []
    if ranked.any():
        x, y = a[ranked], b[ranked]
        low = (1 << SIDE) - 1
        tile = (x >> SIDE) << 32 | (y >> SIDE)
        cell = (x & low) << SIDE | (y & low)
        tiles, tile_of, sizes = np.unique(tile, return_inverse=True, return_counts=True)
        crowded = sizes >= CROWDED
        for t in np.flatnonzero(crowded):
            dense = np.bincount(cell[tile_of == t], minlength=1 << (2 * SIDE))
            cells = np.flatnonzero(dense)
            base_x, base_y = (tiles[t] >> 32) << SIDE, (tiles[t] & 0xFFFFFFFF) << SIDE
            parts.append((base_x + (cells >> SIDE), base_y + (cells & low), dense[cells]))
        rest = ~crowded[tile_of]
        codes, counts = np.unique(x[rest] << 32 | y[rest], return_counts=True)
        parts.append((codes >> 32, codes & 0xFFFFFFFF, counts))
    if not ranked.all():
        x, y = a[~ranked], b[~ranked]
        order = np.lexsort((y, x))
        x, y = x[order], y[order]
        first = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
        parts.append((x[first], y[first], np.diff(np.append(first, len(x)))))
    return tuple(np.concatenate(columns) for columns in zip(*parts))


def _counted(texts: DataFrame, ladder: list[Ranks]) -> DataFrame:
    """How often two units of the ladder's last step follow each other: (a, b, n)."""

    def emit(held):
        if held:
            a, b, n = tile_counts(*(np.concatenate(side) for side in zip(*held)))
            yield from pa.table({"a": a, "b": b, "n": n}).to_batches(max_chunksize=1 << 16)

    def run(batches):
        held, pairs = [], 0
        for batch in batches:
            for keys, follows, *_ in _words(batch):
                a, b = _climbed(ladder, keys, follows)
                held.append((a, b))
                pairs += len(a)
                if pairs >= HELD:
                    yield from emit(held)
                    held, pairs = [], 0
        if pairs:
            yield from emit(held)

    counted = texts.mapInArrow(run, "a long, b long, n long")
    # A fixed number of parts, which is not merged into few large ones: each adds up in little memory.
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return counted.repartition(parts, "a", "b").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _climbed(ladder: list[Ranks], keys: np.ndarray, follows: np.ndarray):
    """All pairs of units that may be frequent, units being what the ladder makes of words."""
    units, usable = ladder[0](keys)
    fits = usable[:-1] & usable[1:] & follows[1:]
    for ranks in ladder[1:]:
        units, usable = ranks(_keys(units[:-1], units[1:]))
        usable &= fits
        fits = usable[:-1] & usable[1:]
    return units[:-1][fits], units[1:][fits]


def _ranked(frequent: DataFrame, most: int, *ties: str) -> tuple[Ranks, DataFrame]:
    """Ranks for the ``most`` most frequent keys, and the frame with each row's unit."""
    order = [F.desc("n"), *ties]
    top = frequent.select("key", "n", *ties).orderBy(*order).limit(most).select("key").toArrow()
    keys = top.column("key").to_numpy()
    ranks = Ranks(keys, frequent.count() <= most)
    table = pa.table({"key": keys, "rank": np.arange(len(keys), dtype=np.int64)})
    known = frequent.sparkSession.createDataFrame(table)
    unit = F.coalesce("rank", "key").alias("unit")
    return ranks, frequent.join(known, "key", "left").select(unit, *frequent.columns)


def _keyed(pairs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            a, b = (batch.column(name).to_numpy(zero_copy_only=False) for name in ("a", "b"))
            yield batch.append_column("key", pa.array(_keys(a, b)))

    return pairs.select("a", "b", "n").mapInArrow(run, "a long, b long, n long, key long")


def frequent_phrases(
    docs: DataFrame,
    least: int = LEAST,
    text: str = "text",
    lang: str = "lang",
    word_table: int = WORD_TABLE,
    pair_table: int = PAIR_TABLE,
    longest: int = LONGEST,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Languages with their words in all (``lang``, ``n``), frequent words and frequent phrases.

    Phrases have ``lang``, the units ``u`` of their words, ``f``, and the counts of their first
    1, 2, ... words (``heads``) and of their last ones (``tails``).
    """
    texts = _texts(docs, text, lang)
    counts = stored(word_counts(docs, text, lang), "words")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("n"))
    often = F.col("n") >= least
    ranks, vocabulary = _ranked(counts.where(often), word_table, "lang", "word")
    vocabulary = stored(vocabulary, "vocabulary")
    ladder, level, levels = [ranks], _single(vocabulary), []
    for size in range(2, longest + 1):
        pairs = stored(_keyed(_counted(texts, ladder).where(often)), f"phrases-{size}")
        ranks, pairs = _ranked(pairs, pair_table, "a", "b")
        ladder.append(ranks)
        level = stored(_longer(level, pairs), f"ranked-{size}")
        levels.append(level)
    phrases = reduce(DataFrame.unionAll, levels)
    return totals, vocabulary, phrases


def _single(vocabulary: DataFrame) -> DataFrame:
    none = F.array().cast("array<long>")
    return vocabulary.select(
        "unit", "lang", F.array("unit").alias("u"), F.col("n").alias("f"), none.alias("heads"), none.alias("tails")
    )


def _longer(level: DataFrame, pairs: DataFrame) -> DataFrame:
    """Phrases one word longer, each from the two of ``level`` that it begins and ends with."""
    first = level.select(
        F.col("unit").alias("a"), "lang", F.col("u").alias("first"), F.concat("heads", F.array("f")).alias("heads")
    )
    last = level.select(
        F.col("unit").alias("b"), F.slice("u", -1, 1).alias("last"), F.concat("tails", F.array("f")).alias("tails")
    )
    return (
        pairs.join(first, "a")
        .join(last, "b")
        .select("unit", "lang", F.concat("first", "last").alias("u"), F.col("n").alias("f"), "heads", "tails")
    )


def _whole(phrases: DataFrame, percent: int) -> DataFrame:
    """Phrases that do not mostly occur as a part of one longer phrase."""
    sizes = F.sequence(F.lit(2), F.size("u") - 1)
    places = lambda size: F.sequence(F.lit(1), F.size("u") - size + 1)
    parts = F.flatten(F.transform(sizes, lambda k: F.transform(places(k), lambda at: F.slice("u", at, k))))
    longer = phrases.where(F.size("u") > 2).select("f", F.explode(parts).alias("u"))
    longer = longer.groupBy("u").agg(F.max("f").alias("longest"))
    within = F.coalesce(100 * F.col("longest") >= percent * F.col("f"), F.lit(False))
    return phrases.join(longer, "u", "left").where(~within).drop("longest")


def collocations(
    docs: DataFrame,
    least: int = LEAST,
    top: int = TOP,
    percent: int = PERCENT,
    text: str = "text",
    lang: str = "lang",
    word_table: int = WORD_TABLE,
    pair_table: int = PAIR_TABLE,
) -> DataFrame:
    """Each language's ``top`` phrases of two to four words by score.

    ``a`` is how often a phrase occurs, ``l`` and ``r`` the counts of its parts at the cut
    with the lowest score ``floor(2000000 a / (l + r))``. A phrase is left out where a longer
    one holds it in ``percent`` per cent of its places or more.
    """
    totals, vocabulary, phrases = frequent_phrases(docs, least, text, lang, word_table, pair_table)
    return ranked_phrases(totals, vocabulary, stored(phrases, "phrases"), top, percent)


def ranked_phrases(
    totals: DataFrame, vocabulary: DataFrame, phrases: DataFrame, top: int = TOP, percent: int = PERCENT
) -> DataFrame:
    """The best phrases of ``frequent_phrases``, in words."""
    # Decimals, since the product may pass 64 bits; the quotient is at most half the scale.
    score = (
        f"CAST((CAST(f AS DECIMAL(20,0)) * CAST({SCALE} AS DECIMAL(7,0)))"
        " div (CAST(x.l AS DECIMAL(20,0)) + CAST(x.r AS DECIMAL(20,0))) AS BIGINT)"
    )
    cuts = "transform(heads, (l, k) -> struct(k + 1 AS k, l AS l, reverse(tails)[k] AS r))"
    lowest = F.expr(f"array_min(transform({cuts}, x -> struct({score} AS score, x.k AS k, x.l AS l, x.r AS r)))")
    kept = _whole(phrases, percent).withColumn("cut", lowest)
    names = (
        kept.select("u", F.posexplode("u").alias("at", "unit"))
        .join(vocabulary.select("unit", "word"), "unit")
        .groupBy("u")
        .agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("words"))
        .select("u", F.array_join("words.word", " ").alias("phrase"))
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (
        kept.join(names, "u")
        .select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "cut.score")
        .withColumn("rank", F.row_number().over(order).cast("long"))
        .where(F.col("rank") <= top)
        .join(totals, "lang")
        .select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    )

