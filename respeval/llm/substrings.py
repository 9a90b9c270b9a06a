"""Repeated passages of any text, by a Burrows-Wheeler transform of many documents.

Every byte covered by a ``LENGTH``-byte string that also starts anywhere else is found. A
transform of all texts at once would need one place that holds them. Here Spark first
brings together only what can be equal:

1. Each string of ``LENGTH`` bytes has an anchor: its 64-byte gram with the smallest hash (the
   first of equal ones). Equal strings have equal anchors at the same place. The strings of a
   text that share an anchor form one segment. Grams are counted over all texts, and
   segments whose gram occurs once are dropped.
2. Equal segments are counted with partial sums. All strings of a segment found twice repeat.
3. Only grams with several different segments are left in doubt. The bytes of these segments,
   each once however often it occurs, are fetched and dealt to tasks by gram. There each is
   narrowed to the part whose strings may be in another one.
4. Tasks build the transform of their segments column by column, over blocks of bounded
   size: each round inserts one symbol of every segment, from the last to the first, and
   rewrites the transform and its common prefixes in one sequential pass. Neighbours with a
   common prefix of ``LENGTH`` bytes are repeats.
5. Repeats are mapped to all places of their segment and the texts are cut.

A gram with more than ``MAX_SEGMENTS`` different segments is not given to one task: its strings
are counted one by one by their hash, which spreads over any number of tasks.

Segments and strings are compared by 64-bit hashes within equal 64-bit grams. Texts are
told apart by 128 bits of hash, so rows need no id: null and repeated ids do no harm, and
repeated rows are repeats of each other. A null text is empty; texts shorter than ``LENGTH``
stay whole. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from respeval.llm.tables import stored, text_or_empty
from respeval.llm.text import CHUNK, byte_ranges, mix, powers

LENGTH = 200
GRAM = 64
MAX_SEGMENTS = 1 << 14
#: Bytes of segments whose transform is built at once, unless one gram has more.
BLOCK = 1 << 17
_PLACE_BITS = 24
_QUARTERS = 4
_KEY = ["text_a", "text_b"]


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes (a power of two) from every place on."""
    out, width = mix(data.astype(np.uint64) + np.uint64(1)), 1
    while width < gram:
        out = out[:-width] * np.uint64(0xD6E8FEB86659FD93) + out[width:]
        out ^= out >> np.uint64(29)
        width *= 2
    return mix(out)


def _window_minima(values: np.ndarray, width: int) -> np.ndarray:
    covered = 1
    while covered < width:
        step = min(covered, width - covered)
        values = np.minimum(values[:-step], values[step:])
        covered += step
    return values


def segments(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Text, first and end byte, place of the anchor in it, gram hash and hash of every
    segment of joined texts."""
    none = [np.empty(0, np.int64)] * 4 + [np.empty(0, np.uint64)] * 2
    strings = len(data) - length + 1
    if strings <= 0:
        return none
    hashes = _gram_hashes(data, gram)
    low = np.uint64((1 << _PLACE_BITS) - 1)
    places = np.arange(len(hashes), dtype=np.uint64)
    anchors = (_window_minima((hashes & ~low) | places, length - gram + 1) & low).astype(np.int64)
    ends = np.repeat(offsets[1:], np.diff(offsets))[:strings]
    start = np.flatnonzero(np.arange(strings) + length <= ends)
    if not len(start):
        return none
    anchor = anchors[start]
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    begin, end = start[first], start[last] + length
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data)), out=sums[1:])
    body = mix((sums[end] - sums[begin]) * powers(len(data) + 1, "inverse")[begin])
    row = np.searchsorted(offsets, begin, side="right") - 1
    at = anchor[first] - begin
    return row, begin - offsets[row], end - offsets[row], at, hashes[anchor[first]], body


def _pieces(data: np.ndarray, offsets: np.ndarray, length: int):
    """Joined texts in parts short enough for place bits; a long text overlaps by a string."""
    limit = 8 * CHUNK
    if len(data) <= limit:
        yield 0, data, offsets
        return
    for at in range(0, len(data) - length + 1, limit):
        part = data[at : at + limit + length - 1]
        yield at, part, np.array([0, len(part)])


def _found(docs: DataFrame, length: int) -> DataFrame:
    """One row per segment; a text that a task meets again is left out."""
    names = [*_KEY, "gram", "body", "begin", "end", "at"]

    def run(batches):
        seen = set()
        for batch in batches:
            a, b = (batch.column(i).to_numpy() for i in (0, 1))
            for first, _, data, offsets in byte_ranges(batch.column(2)):
                for at, part, bounds in _pieces(data, offsets, length):
                    row, begin, end, anchor, gram, body = segments(part, bounds, length)
                    row += first
                    fresh = np.zeros(len(a), dtype=bool)
                    for r in np.unique(row).tolist():
                        text = (a[r], b[r], at)
                        if text not in seen:
                            seen.add(text)
                            fresh[r] = True
                    keep = fresh[row]
                    row = row[keep]
                    columns = [a[row], b[row], gram[keep].view(np.int64), body[keep].view(np.int64)]
                    columns += [(x[keep] + at).astype(np.int64) for x in (begin, end)]
                    columns.append(anchor[keep].astype(np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    source = docs.select(*_KEY, "text")
    return source.mapInArrow(run, ", ".join(f"{n} long" for n in names))


class Transform:
    """Burrows-Wheeler transform and common prefixes of some documents, column by column.

    ``places`` holds, in suffix order, where each suffix begins; a suffix's transform symbol is
    the one before it. ``common`` is the prefix it shares with the suffix above, up to ``most``.
    """

    def __init__(self, documents: Sequence[bytes], most: int):
        self.most = most
        joined = np.frombuffer(b"\0" + b"\0".join(documents), dtype=np.uint8)
        sizes = np.array([len(d) for d in documents])
        self.begins = 1 + np.concatenate([[0], np.cumsum(sizes[:-1] + 1)])
        ends = (self.begins + sizes).astype(np.int32)
        #: UTF-8 bytes plus one; 0 stands before the first of each document.
        self.symbols = joined + np.uint8(1)
        self.symbols[self.begins - 1] = 0
        #: The symbol before each place.
        self.ahead = np.concatenate([self.symbols[:1], self.symbols])
        #: The empty suffixes come first. ``fresh`` marks those inserted last.
        self.places = self.ends = ends
        self.fresh = np.ones(len(ends), dtype=bool)
        #: Wide enough for ``most``.
        self.kind = np.min_scalar_type(most)
        self.common = np.zeros(len(ends), dtype=self.kind)
        for _ in range(int(sizes.max(initial=0))):
            self._insert()

    def _insert(self) -> None:
        """The next symbol of every document that has one."""
        before = self.ahead[self.places]
        order = np.argsort(before, kind="stable")[np.count_nonzero(before == 0) :]
        places, fresh = self.places[order], self.fresh[order]
        places -= np.int32(1)
        # Old suffixes keep their order, and what they share with each other.
        heads = len(self.ends)
        common = np.empty(len(order), dtype=self.kind)
        common[~fresh] = self.common[heads:]
        changed = fresh.copy()
        changed[1:] |= fresh[:-1]
        at = np.flatnonzero(changed)
        below = np.zeros(len(at), dtype=self.kind)
        # Symbols are looked at only where something changed.
        pair = np.flatnonzero((at > 0) & (before[order[at]] == before[order[at - 1]]))
        if len(pair):
            # What two suffixes share is what their tails share, plus one symbol.
            low, high = order[at[pair] - 1] + 1, order[at[pair]] + 1
            down = np.argsort(-low, kind="stable")
            edges = np.stack([low[down], high[down]], axis=1).reshape(-1)
            tails = np.minimum.reduceat(np.append(self.common, 0), edges)[::2]
            below[pair[down]] = np.minimum(tails.astype(np.int64) + 1, self.most)
        common[at] = below
        self.places = np.concatenate([self.ends, places])
        self.fresh = np.concatenate([np.zeros(heads, bool), fresh])
        self.common = np.concatenate([np.zeros(heads, self.kind), common])

    def repeats(self) -> list[np.ndarray]:
        """For each document, where strings of ``most`` bytes begin that occur again."""
        near = self.common >= self.most
        near[:-1] |= near[1:].copy()
        found = np.sort(self.places[near])
        owner = np.searchsorted(self.begins, found, "right") - 1
        bounds = np.searchsorted(owner, np.arange(len(self.begins) + 1))
        return [found[a:b] - s for a, b, s in zip(bounds[:-1], bounds[1:], self.begins)]


def _runs(starts: np.ndarray) -> tuple[list[int], list[int]]:
    """First and last of each run of successive numbers."""
    breaks = np.flatnonzero(np.diff(starts) != 1)
    first = np.concatenate([[0], breaks + 1])
    last = np.append(breaks, len(starts) - 1)
    return starts[first].tolist(), starts[last].tolist()


def _in_doubt(doubtful: DataFrame, length: int, gram_size: int = GRAM) -> DataFrame:
    """Repeating strings of segments that share a gram: ``gram``, ``body``, ``first``, ``last``."""

    def by_gram(batches) -> Iterator[list]:
        held = []
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if held and row[0] != held[0][0]:
                    yield held
                    held = []
                held.append(row)
        if held:
            yield held

    def blocks(batches) -> Iterator[list]:
        held, size = [], 0
        for group in by_gram(batches):
            for gram, body, cut, part in _narrowed(group, length, gram_size):
                held.append((gram, body, cut, part))
                size += len(part)
            if size > BLOCK:
                yield held
                held, size = [], 0
        if held:
            yield held

    def run(batches):
        for block in blocks(batches):
            grams, bodies, firsts, lasts = [], [], [], []
            found = Transform([part for *_, part in block], length).repeats()
            for (gram, body, cut, _), starts in zip(block, found):
                if len(starts):
                    first, last = _runs(starts + cut)
                    grams += [gram] * len(first)
                    bodies += [body] * len(first)
                    firsts += first
                    lasts += last
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in (grams, bodies, firsts, lasts)],
                names=["gram", "body", "first", "last"],
            )

    dealt = doubtful.select("gram", "body", "at", "bytes")
    dealt = dealt.repartition("gram").sortWithinPartitions("gram")
    return dealt.mapInArrow(run, "gram long, body long, first long, last long")


def _narrowed(group: list, length: int, gram: int) -> Iterator[tuple]:
    """The part of each segment of one gram whose strings may be in another segment.

    The strings of a segment are told apart by how far they begin before the anchor. All that
    begin within a quarter of that range have a core in common; where no other segment has
    the same core, none of them repeats.
    """
    step = -(-(length - gram + 1) // _QUARTERS)
    cores: dict[tuple, int] = {}
    keys = []
    for _, _, at, data in group:
        own = []
        farthest, nearest = at, at - (len(data) - length)
        for low in range(0, length - gram + 1, step):
            high = min(low + step - 1, length - gram)
            if low <= farthest and high >= nearest:
                core = (low, data[max(at - low, 0) : at - high + length])
                own.append((low, high, core))
                cores[core] = cores.get(core, 0) + 1
        keys.append(own)
    for (name, body, at, data), own in zip(group, keys):
        shared = [(low, high) for low, high, core in own if cores[core] > 1]
        if shared:
            begin = max(at - max(high for _, high in shared), 0)
            end = min(at - min(low for low, _ in shared) + length, len(data))
            yield name, body, begin, data[begin:end]


def _one_by_one(crowded: DataFrame, length: int) -> DataFrame:
    """The same for grams with very many segments, by counting each string."""

    def run(batches):
        for batch in batches:
            gram, body = batch.column(0), batch.column(1)
            for i, text in enumerate(batch.column(2).to_pylist()):
                hashes = [hashlib.blake2b(text[p : p + length], digest_size=16).digest() for p in range(len(text) - length + 1)]
                rows = pa.array([i] * len(hashes), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [gram.take(rows), body.take(rows), pa.array(range(len(hashes)), pa.int64()), pa.array(hashes, pa.binary())],
                    names=["gram", "body", "first", "string"],
                )

    strings = crowded.select("gram", "body", "bytes").mapInArrow(run, "gram long, body long, first long, string binary")
    again = strings.groupBy("string").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("string")
    return strings.join(again, "string", "left_semi").select("gram", "body", "first", F.col("first").alias("last"))


def _bytes_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` with the bytes from ``begin`` to ``end`` of a text with the given key."""

    def run(batches):
        for batch in batches:
            texts, begin, end = (batch.column(i) for i in (4, 2, 3))
            cut = [
                t.encode()[s:e] for t, s, e in zip(texts.to_pylist(), begin.to_pylist(), end.to_pylist())
            ]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in (0, 1, 5, 6)), pa.array(cut, pa.binary())],
                names=["gram", "body", "crowded", "at", "bytes"],
            )

    joined = docs.select(*_KEY, "text").join(wanted, _KEY)
    joined = joined.select("gram", "body", "begin", "end", "text", "crowded", "at")
    return joined.mapInArrow(run, "gram long, body long, crowded boolean, at long, bytes binary")


def repeated_ranges(docs: DataFrame, length: int = LENGTH, max_segments: int = MAX_SEGMENTS) -> DataFrame:
    """``text_a``, ``text_b`` (a text's key) and ``ranges``: byte ranges that repeat."""
    grams = _found(docs, length).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # Stored, so that both sides of the join come from a shuffle and a hot gram can be split.
    grams = stored(grams.select("gram"), "grams")
    places = stored(_found(docs, length).join(grams, "gram", "left_semi"), "segments")
    where = F.struct(*_KEY, "begin", "end", "at")
    bodies = stored(
        places.groupBy("gram", "body").agg(F.count(F.lit(1)).alias("n"), F.min(where).alias("where")),
        "bodies",
    )
    kinds = bodies.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    wanted = bodies.join(kinds, "gram").select(
        "gram", "body", "where.*", (F.col("kinds") > max_segments).alias("crowded")
    )
    # Texts with equal keys are equal, so any of them gives the bytes.
    doubtful = stored(_bytes_of(docs, wanted).dropDuplicates(["gram", "body"]), "doubtful")
    some = _in_doubt(doubtful.where("not crowded"), length).unionAll(
        _one_by_one(doubtful.where("crowded"), length)
    )
    always = bodies.where("n > 1").select("gram", "body", F.lit(True).alias("whole"), F.lit(0).cast("long").alias("first"), F.lit(0).cast("long").alias("last"))
    repeats = stored(
        some.join(bodies.where("n > 1"), ["gram", "body"], "left_anti")
        .select("gram", "body", F.lit(False).alias("whole"), "first", "last")
        .unionAll(always),
        "repeats",
    )
    hit = places.join(repeats, ["gram", "body"])
    begin = F.when(F.col("whole"), F.col("begin")).otherwise(F.col("begin") + F.col("first"))
    end = F.when(F.col("whole"), F.col("end")).otherwise(F.col("begin") + F.col("last") + length)
    ranges = hit.select(*_KEY, F.struct(begin.alias("begin"), end.alias("end")).alias("range"))
    size = F.octet_length("text").cast("long")
    copies = docs.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n"), F.max(size).alias("end"))
    copies = copies.where((F.col("n") > 1) & (F.col("end") >= length)).select(
        *_KEY, F.struct(F.lit(0).cast("long").alias("begin"), "end").alias("range")
    )
    # A text has no more ranges than bytes, however many copies it has.
    return ranges.unionAll(copies).groupBy(*_KEY).agg(F.collect_set("range").alias("ranges"))


def without_repeats(
    docs: DataFrame,
    keep: Sequence[str] = ("doc_id",),
    text: str = "text",
    length: int = LENGTH,
    max_segments: int = MAX_SEGMENTS,
    with_text: bool = False,
) -> DataFrame:
    """``keep`` plus what is left of every text.

    ``n_bytes``, ``n_removed`` and ``n_spans`` (maximal removed runs), and ``kept_sha256`` of the
    bytes that are left; with ``with_text`` also ``kept_text``, where a cut inside a letter
    leaves a replacement character.
    """
    keep = list(keep)
    whole = text_or_empty(text)
    keyed = docs.select(
        F.xxhash64(whole).alias("text_a"), F.xxhash64(F.lit(3), whole).alias("text_b"), whole.alias("text")
    )
    ranges = repeated_ranges(keyed, length, max_segments)
    rows = docs.select(
        F.xxhash64(whole).alias("text_a"),
        F.xxhash64(F.lit(3), whole).alias("text_b"),
        *[F.col(k).alias(f"_keep_{i}") for i, k in enumerate(keep)],
        whole.alias("_text_"),
    ).join(ranges, _KEY, "left")
    rows = rows.select(
        *[f"_keep_{i}" for i in range(len(keep))],
        "_text_",
        F.transform("ranges", lambda r: r["begin"]).alias("_begins_"),
        F.transform("ranges", lambda r: r["end"]).alias("_ends_"),
    )
    names = ["n_bytes", "n_removed", "n_spans"]
    schema = StructType(
        [docs.schema[k] for k in keep]
        + [StructField(n, LongType()) for n in names]
        + [StructField("kept_sha256", StringType())]
        + ([StructField("kept_text", StringType())] if with_text else [])
    )

    def cut(text: str, begins, ends):
        data = text.encode()
        if not begins:
            return len(data), 0, 0, data
        order = np.argsort(begins)
        begins, ends = np.array(begins)[order], np.maximum.accumulate(np.array(ends)[order])
        first = np.concatenate([[True], begins[1:] > ends[:-1]])
        starts, stops = begins[first], ends[np.append(np.flatnonzero(first)[1:] - 1, len(ends) - 1)]
        kept = [data[a:b] for a, b in zip([0, *stops.tolist()], [*starts.tolist(), len(data)])]
        return len(data), int((stops - starts).sum()), len(starts), b"".join(kept)

    def run(batches):
        for batch in batches:
            texts, begins, ends = (batch.column(len(keep) + i).to_pylist() for i in range(3))
            done = [cut(*row) for row in zip(texts, begins, ends)]
            columns = [batch.column(i) for i in range(len(keep))]
            columns += [pa.array([d[i] for d in done], pa.int64()) for i in range(3)]
            columns.append(pa.array([hashlib.sha256(d[3]).hexdigest() for d in done]))
            if with_text:
                columns.append(pa.array([d[3].decode("utf-8", "replace") for d in done]))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema)
