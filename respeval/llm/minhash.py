"""Near-duplicate documents by min-max MinHash, confirmed on full shingle sets.

Each of ``PERMUTATIONS`` hash functions gives a text both its smallest and its largest
value, so half as many hash evaluations fill a signature; both agree between two texts
with a probability equal to their Jaccard similarity. Minima and maxima are banded apart,
``ROWS`` values to a band. At the similarity 0.8 a pair shares none of the 32 bands with a
probability of 5e-8.

Texts with equal shingle sets are one class, found by a digest; the rest of the work is on
one document per class. In each band bucket one member is the centre and all others are
compared with it, which is linear in the bucket. After the links found so far have been
joined into components, only buckets that still hold several components go on. In those of
at most ``SMALL`` members, all pairs of different components are compared. A larger one is
dealt into blocks of bounded size, every two of which meet in a group that looks up its
members' shingles in each other and returns only links that join components. So no pairs
of a large group are ever listed, and no link between different components is left out.
Before sets are fetched, pairs
whose sizes cannot reach the similarity are dropped, and so are pairs whose 128 signature
bits differ more than six standard deviations beyond what the similarity allows (one true
pair in a billion).

Rows without a document id take no part: they keep their size, and have no component.
Rows that share an id count as one document with the links of all of them. Texts without a
word are linked with nothing. Equal texts are linked through their class. An empty table
gives no rows. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from respeval.llm.components import components
from respeval.llm.tables import stored, text_or_empty
from respeval.llm.text import byte_ranges, long_lists, map_texts, mix, shingle_sets, signed, word_hashes

WORDS = 5
PERCENT = 80
PERMUTATIONS = 64
ROWS = 4
SMALL = 32
#: Shingles in a block of a large bucket.
BLOCK = 1 << 20
_SIGMAS = 6


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    numbers = mix(np.arange(1, 2 * PERMUTATIONS + 1, dtype=np.uint64))
    return numbers[:PERMUTATIONS] | np.uint64(1), numbers[PERMUTATIONS:]


def signatures(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest value of every non-empty set under each permutation."""
    scale, shift = _coefficients()
    starts = offsets[:-1]
    low = np.empty((PERMUTATIONS, len(starts)), dtype=np.uint64)
    high = np.empty_like(low)
    for j in range(PERMUTATIONS):
        permuted = values * scale[j] + shift[j]
        low[j] = np.minimum.reduceat(permuted, starts)
        high[j] = np.maximum.reduceat(permuted, starts)
    return low, high


def _bands(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    keys = []
    for rows in (low, high):
        for at in range(0, PERMUTATIONS, ROWS):
            key = np.full(rows.shape[1], len(keys) + 1, dtype=np.uint64)
            for row in rows[at : at + ROWS]:
                key = mix(key * np.uint64(0xD6E8FEB86659FD93) + row)
            keys.append(key)
    return np.stack(keys, axis=1)


def _bits(rows: np.ndarray) -> np.ndarray:
    bit = (rows >> np.uint64(7)) & np.uint64(1)
    return np.bitwise_or.reduce(bit << np.arange(PERMUTATIONS, dtype=np.uint64)[:, None], axis=0)


def fingerprints(docs: DataFrame, words: int, key: str) -> DataFrame:
    """Per row: set size, digest of the set, signature bits and band buckets."""

    def kernel(data, offsets):
        hashes, starts = word_hashes(data, offsets)
        values, bounds = shingle_sets(hashes, starts, words)
        sizes = np.diff(bounds)
        some = np.flatnonzero(sizes)
        columns = np.zeros((4, len(sizes)), dtype=np.uint64)
        buckets = np.empty((0, 2 * PERMUTATIONS // ROWS), dtype=np.uint64)
        if len(some):
            solid = np.concatenate([[0], np.cumsum(sizes[some])])
            columns[0, some] = np.add.reduceat(mix(values), solid[:-1])
            columns[1, some] = np.bitwise_xor.reduceat(
                mix(values * np.uint64(0x9FB21C651E98DF25)), solid[:-1]
            )
            low, high = signatures(values, solid)
            columns[2, some], columns[3, some] = _bits(low), _bits(high)
            buckets = _bands(low, high)
        per = np.concatenate([[0], np.cumsum(np.where(sizes > 0, buckets.shape[1], 0))])
        lists = long_lists(signed(np.ascontiguousarray(buckets.reshape(-1))), per)
        return [sizes.astype(np.int64), *[signed(c) for c in columns], lists]

    return map_texts(
        docs,
        [key],
        "n_shingles long, digest_a long, digest_b long, bits_a long, bits_b long, bands array<long>",
        kernel,
    )


def _sets(texts: DataFrame, words: int) -> DataFrame:
    """``a``, ``b`` and the shingle set of the text of ``b``."""

    def run(batches):
        for batch in batches:
            for first, end, data, offsets in byte_ranges(batch.column(2)):
                values, bounds = shingle_sets(*word_hashes(data, offsets), words)
                a, b = (batch.column(i).slice(first, end - first) for i in (0, 1))
                yield pa.RecordBatch.from_arrays(
                    [a, b, long_lists(signed(values), bounds)], names=["a", "b", "shingles"]
                )

    return texts.mapInArrow(run, "a long, b long, shingles array<long>")


def confirmed(docs: DataFrame, pairs: DataFrame, words: int, percent: int, key: str) -> DataFrame:
    """The pairs ``a``, ``b`` whose full shingle sets are similar enough.

    A set travels once per pair to the pair's ``a``; a hot ``a`` is split by the join.
    """
    wanted = pairs.select("a", "b").unionAll(
        pairs.select("a", F.col("a").alias("b")).distinct()
    )
    texts = docs.select(F.col(key).cast("long").alias("b"), text_or_empty().alias("text"))
    # Texts are always met by a shuffle join, so that the plan is the same at every size.
    fetched = texts.join(wanted.hint("merge"), "b").select("a", "b", "text")
    sets = stored(_sets(fetched, words), "shingle-sets")
    centres = sets.where("a = b").select("a", F.col("shingles").alias("of_a"))
    both = sets.where("a <> b").join(centres, "a")
    return both.where(_similar("of_a", "shingles", percent))


def _possible(pairs: DataFrame, info: DataFrame, percent: int) -> DataFrame:
    """Pairs that sizes and signature bits do not rule out."""
    for end in ("a", "b"):
        pairs = pairs.join(info.select(*[F.col(c).alias(f"{end}_{c}" if c != "node" else end) for c in info.columns]), end)
    n_a, n_b = F.col("a_n"), F.col("b_n")
    agree = (1 + percent / 100) / 2
    slots = 2 * PERMUTATIONS
    most = slots * (1 - agree) + _SIGMAS * (slots * agree * (1 - agree)) ** 0.5
    apart = sum(F.bit_count(F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}"))) for c in ("bits_a", "bits_b"))
    fits = 100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)
    return pairs.where(fits & (apart <= most)).select("a", "b")


def near_duplicates(
    docs: DataFrame, words: int = WORDS, percent: int = PERCENT, key: str = "doc_id"
) -> DataFrame:
    """``key``, ``n_shingles``, ``component_id`` and ``kept`` of every row.

    Documents are linked when ``100 * intersection >= percent * union`` holds for their sets
    of ``words``-word shingles. ``component_id`` is the smallest linked id, the document's
    own included; ``kept`` says that it is the document's own.
    """
    marks = stored(fingerprints(docs, words, key), "fingerprints")
    digest = ["digest_a", "digest_b"]
    usable = marks.where(F.col(key).isNotNull() & (F.col("n_shingles") > 0))
    names = {"n_shingles": "n", "bits_a": "bits_a", "bits_b": "bits_b", "bands": "bands"}
    classes = stored(
        usable.groupBy(*digest).agg(
            F.min(key).cast("long").alias("node"),
            *[F.first(c).alias(name) for c, name in names.items()],
        ),
        "classes",
    )
    labels = _links_joined(docs, classes, words, percent, key)
    named = classes.select(*digest, "node").join(labels, "node", "left")
    named = named.select(*digest, F.coalesce("component", "node").alias("component_id"))
    result = marks.select(key, "n_shingles", *digest).join(named, digest, "left")
    own = F.when(F.col(key).isNotNull(), F.coalesce("component_id", F.col(key).cast("long")))
    result = result.withColumn("component_id", own)
    return result.select(
        key,
        "n_shingles",
        "component_id",
        F.coalesce(F.col(key) == F.col("component_id"), F.lit(False)).alias("kept"),
    )


def _links_joined(docs: DataFrame, classes: DataFrame, words: int, percent: int, key: str):
    """Components of the classes that are linked with another one."""
    info = classes.select("node", "n", "bits_a", "bits_b")
    spread = classes.select("node", F.explode("bands").alias("bucket"))
    first = F.min_by("node", F.xxhash64("node"))
    shared = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), first.alias("centre"))
    hits = stored(spread.join(shared.where("size > 1"), "bucket"), "buckets")

    pairs = hits.where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b"))
    tested = stored(_possible(pairs.distinct(), info, percent), "pairs")
    links = stored(confirmed(docs, tested, words, percent, key).select("a", "b"), "confirmed")
    labels = stored(components(links), "labels")

    mixed = stored(_unsettled(hits, labels), "unsettled")
    few = _across(mixed.where(F.col("size") <= SMALL))
    few = stored(_possible(few, info, percent).join(tested, ["a", "b"], "left_anti"), "pairs")
    many = mixed.where(F.col("size") > SMALL)
    wanted = many.select("node").unionAll(few.select(F.explode(F.array("a", "b")))).distinct()
    sets = stored(_sets_of(docs, wanted, words, key), "shingle-sets")
    links = links.unionAll(stored(_linked(few, sets, percent), "confirmed"))

    joining = _joining(many.select("bucket", "node", "component"), sets, info, percent)
    links = links.unionAll(stored(joining, "confirmed"))
    return components(links)


def _unsettled(hits: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of the buckets that hold more than one component, with their component."""
    placed = hits.join(labels, "node", "left").select(
        "bucket", "node", "size", F.coalesce("component", "node").alias("component")
    )
    mixed = placed.groupBy("bucket").agg(
        F.min("component").alias("low"), F.max("component").alias("high")
    )
    return placed.join(mixed.where("low < high").select("bucket"), "bucket")


def _sets_of(docs: DataFrame, nodes: DataFrame, words: int, key: str) -> DataFrame:
    texts = docs.select(F.col(key).cast("long").alias("node"), text_or_empty().alias("text"))
    texts = texts.join(nodes.hint("merge"), "node").select("node", F.col("node").alias("b"), "text")
    return _sets(texts, words).select(F.col("a").alias("node"), "shingles")


def _joining(members: DataFrame, sets: DataFrame, info: DataFrame, percent: int) -> DataFrame:
    """Links that join different components inside large buckets.

    A bucket is dealt into blocks of about ``BLOCK`` shingles, and every two blocks meet in a
    group of their own, so a group has a bound and a bucket of any size is spread out.
    Inside a group only members outside the largest component are looked up, and only
    links that join two components so far apart are returned: fewer than members.
    """
    sized = members.join(info.select("node", "n"), "node")
    blocks = sized.groupBy("bucket").agg((F.sum("n") / BLOCK).cast("int").alias("last"))
    dealt = members.join(blocks, "bucket").withColumn(
        "own", F.pmod(F.xxhash64("node"), F.col("last") + 1).cast("int")
    )
    other = F.explode(F.sequence(F.lit(0), F.col("last")))
    met = dealt.select("bucket", "node", "component", "own", other.alias("other"))
    groups = met.select(
        "bucket",
        F.least("own", "other").alias("low"),
        F.greatest("own", "other").alias("high"),
        "component",
        "node",
    ).join(sets, "node")

    def links(group: pa.Table) -> pa.Table:
        nodes = group.column("node").to_numpy()
        component = group.column("component").to_numpy()
        lists = group.column("shingles").combine_chunks()
        bounds, values = lists.offsets.to_numpy(), lists.values.to_numpy()
        a, b = _joining_links(nodes, component, values, bounds, percent)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    keyed = groups.select("bucket", "low", "high", "node", "component", "shingles")
    return keyed.groupBy("bucket", "low", "high").applyInArrow(links, "a long, b long")


def _joining_links(nodes, component, values, bounds, percent: int):
    """Pairs of similar sets that together join all components that have one."""
    n = len(nodes)
    sizes = np.diff(bounds)
    owners = np.repeat(np.arange(n), sizes)
    values = values[bounds[0] : bounds[-1]]
    order = np.argsort(values, kind="stable")
    posting = owners[order]
    ordered = values[order]
    first = np.searchsorted(ordered, values, "left")
    size = np.searchsorted(ordered, values, "right") - first
    names, group = np.unique(component, return_inverse=True)
    root = np.arange(len(names))

    def top(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    largest = np.bincount(group).argmax()
    start = bounds - bounds[0]
    a, b = [], []
    for x in np.flatnonzero(group != largest).tolist():
        mine = slice(start[x], start[x + 1])
        lengths = size[mine]
        steps = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        shared = np.bincount(posting[np.repeat(first[mine], lengths) + steps], minlength=n)
        near = np.flatnonzero(100 * shared >= percent * (sizes[x] + sizes - shared))
        for y in near[group[near] != group[x]].tolist():
            one, two = top(group[x]), top(group[y])
            if one != two:
                root[one] = two
                a.append(nodes[x])
                b.append(nodes[y])
    return a, b


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose stored sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b"))
    both = pairs.join(left, "a").join(right, "b")
    return both.where(_similar("of_a", "of_b", percent)).select("a", "b")


def _similar(of_a: str, of_b: str, percent: int) -> Column:
    shared = F.size(F.array_intersect(of_a, of_b)).cast("long")
    return 100 * shared >= percent * (F.size(of_a) + F.size(of_b) - shared)


def _across(members: DataFrame) -> DataFrame:
    """All pairs of members of one bucket that are in different components."""
    other = members.select("bucket", F.col("node").alias("b"), F.col("component").alias("other"))
    pairs = members.join(other, "bucket").where("component < other")
    return pairs.select(F.col("node").alias("a"), "b").distinct()


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One document of each group of near-duplicates, columns unchanged.

    Of rows that share an id the first by text stays. Rows without an id stay.
    """
    kept = near_duplicates(docs, words, percent).where("kept").select("doc_id").distinct()
    chosen = docs.join(kept, "doc_id", "left_semi")
    first = Window.partitionBy("doc_id").orderBy(*[F.col(c) for c in docs.columns if c != "doc_id"])
    chosen = chosen.withColumn("_first_row_", F.row_number().over(first)).where("_first_row_ = 1")
    return chosen.select(*docs.columns).unionAll(docs.where(F.col("doc_id").isNull()))
