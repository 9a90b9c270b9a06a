"""Similarity join of n-gram sets by prefix trees.

Texts with equal sets are one class, found by a digest; the work is on one text per class.

1. *Who can have a partner.* In any order of the n-grams, two linked sets share a number of
   n-grams of their first ``2d + 1``, where ``d`` is how many n-grams a linked set may lack.
   In the order of the hashes, a class stays only if enough of these occur elsewhere too.
   Only these few are written for all texts; whole sets are made for those that stay.
2. *Global order.* The n-grams of the classes that stay are counted. Those that occur once
   can be in no overlap: they only use up what the set may lack. The others are ordered by the
   logarithm of their frequency, rare ones first, then by hash.
3. *Who can be partners.* Linked sets share one of their first n-grams in this order. Classes
   that share one, directly or through others, are put in one family. A class travels once,
   to its family, or to its block of a family larger than ``BLOCK``.
4. *Prefix tree.* A task stores the ordered sets of a family in a tree in which equal
   beginnings are one path. Every set is looked up: a path's overlap is counted once for all
   sets below it, and a subtree is left when the overlap so far and what remains of both sides
   cannot reach the similarity. Subtrees already linked with the set are left too.
5. *Large families.* Where an n-gram's classes are still in several components, every two
   blocks of its classes meet in a tree of their own, and only links between components count.

Every link between different components is found by full overlaps of 57-bit hashes of the
shared n-grams, so the components are those of all links. A group in a task is bounded by
``BLOCK`` (two blocks in step 5), and by a single longer set.

Rows without an id take no part: they keep their size, and have no component. Rows that share
an id count as one document with the links of all of them. Texts without a word are linked
with nothing. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from respeval.llm.components import components
from respeval.llm.tables import stored, text_or_empty
from respeval.llm.text import long_lists, map_texts, mix, shingle_sets, signed, word_hashes

WORDS = 3
PERCENT = 90
#: N-grams of a block of sets; a set counts for ``LIGHTEST`` at least.
BLOCK = 1 << 20
LIGHTEST = 256
#: N-grams of a path that are looked at together.
STRIDE = 32
_CLASS = ("node", "digest")
_HASH_BITS = 57


def _lacking(n: Column, percent: int) -> Column:
    """How many n-grams of a set of ``n`` may be missing from a linked one."""
    return F.floor((100 - percent) * n / 100).cast("long")


def _digests(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sizes = np.diff(bounds)
    some = np.flatnonzero(sizes)
    digests = np.zeros((2, len(sizes)), dtype=np.uint64)
    if len(some):
        solid = bounds[:-1][some]
        digests[0, some] = np.add.reduceat(mix(values), solid)
        digests[1, some] = np.bitwise_xor.reduceat(mix(values * np.uint64(0x9FB21C651E98DF25)), solid)
    return digests


def set_marks(docs: DataFrame, words: int, percent: int, key: str) -> DataFrame:
    """Per row: size and digests of its set, and its first n-grams by hash."""

    def kernel(data, offsets):
        values, bounds = shingle_sets(*word_hashes(data, offsets), words)
        sizes = np.diff(bounds)
        digests = _digests(values, bounds)
        counts = np.where(sizes > 0, 2 * ((100 - percent) * sizes // 100) + 1, 0)
        counts = np.minimum(counts, sizes)
        ends = np.cumsum(counts)
        first = values[np.repeat(bounds[:-1] - ends + counts, counts) + np.arange(counts.sum())]
        lists = long_lists(signed(first), np.concatenate([[0], ends]))
        return [sizes.astype(np.int64), signed(digests[0]), signed(digests[1]), lists]

    return map_texts(docs, [key], "n long, digest long, digest_b long, first array<long>", kernel)


def gram_sets(texts: DataFrame, words: int) -> DataFrame:
    """Size, digest and whole set of every ``node``'s text."""

    def kernel(data, offsets):
        values, bounds = shingle_sets(*word_hashes(data, offsets), words)
        return [np.diff(bounds).astype(np.int64), signed(_digests(values, bounds)[0]), long_lists(signed(values), bounds)]

    return map_texts(texts, ["node"], "n long, digest long, grams array<long>", kernel)


def _can_have_partners(marks: DataFrame, percent: int) -> DataFrame:
    """Nodes whose first n-grams by hash occur often enough at other nodes."""
    # The smallest partner may lack fewer n-grams, so fewer shared ones are asked for.
    smallest = F.ceil(F.lit(percent) * F.col("n") / 100)
    least = marks.groupBy("node").agg(F.min(_lacking(smallest, percent)).alias("least"))
    # Only node and n-gram travel: every n-gram of every text is a row here.
    first = marks.select("node", F.explode("first").alias("gram"))
    again = first.groupBy("gram").agg(F.count(F.lit(1)).alias("f")).where("f > 1").select("gram")
    shared = first.join(again, "gram").groupBy("node").agg(F.count(F.lit(1)).alias("shared"))
    return shared.join(least, "node").where("shared > least").select("node")


def ordered_sets(sets: DataFrame, percent: int) -> DataFrame:
    """Sets without the n-grams that occur once, in the global order, if they can have a link."""
    several = sets.groupBy("node").agg(F.min("digest").alias("low"), F.max("digest").alias("high"))
    several = stored(several.where("low < high").select("node", F.lit(True).alias("several")), "several-texts")
    # A digest tells the texts of one id apart; where an id has one text, it need not travel.
    own = F.when(F.col("several"), F.col("digest")).otherwise(F.lit(0)).alias("digest")
    sets = sets.join(several, "node", "left").select("node", own, "n", "grams")
    grams = sets.select(*_CLASS, F.explode("grams").alias("gram"))
    often = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    rank = F.length(F.bin("f")).cast("long")
    place = F.shiftleft(rank, _HASH_BITS).bitwiseOR(F.col("gram").bitwiseAND(F.lit((1 << _HASH_BITS) - 1)))
    shared = grams.join(often.select("gram", place.alias("place")), "gram")
    whole = shared.groupBy(*_CLASS).agg(F.sort_array(F.collect_set("place")).alias("grams"))
    whole = whole.join(sets.select(*_CLASS, "n").distinct(), [*_CLASS])
    spare = _lacking(F.col("n"), percent) - (F.col("n") - F.size("grams"))
    return whole.withColumn("spare", spare).where("spare >= 0")


def _families(first: DataFrame) -> DataFrame:
    """``node`` and the smallest node of its family, where it has one."""
    centre = first.groupBy("gram").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b")
    star = first.join(centre.select("gram", "a"), "gram").select("a", F.col("node").alias("b"))
    return components(star).withColumnRenamed("component", "family")


def _weight() -> Column:
    return F.greatest(F.size("grams"), F.lit(LIGHTEST)).cast("long")


class Tree:
    """Ordered sets as a tree of paths. ``below`` are ranges of the sets in sorted order."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
        self.order = np.array(order, dtype=np.int64)
        self.sets = [sets[i] for i in order]
        self.lengths = np.array([len(s) for s in self.sets], dtype=np.int64)
        self.tokens = np.concatenate(self.sets) if self.sets else np.empty(0, np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.lengths)])
        self._build()
        self._measure(sizes[self.order])

    def _build(self) -> None:
        """Paths from the top down; a long path is a chain of pieces of ``STRIDE``."""
        n, rows = len(self.sets), []
        common = np.zeros(n, dtype=np.int64)
        for i in range(1, n):
            a, b = self.sets[i - 1], self.sets[i]
            m = min(len(a), len(b))
            apart = np.flatnonzero(a[:m] != b[:m])
            common[i] = apart[0] if len(apart) else m
        ranges = [(0, n, 0, -1)] if n else []
        while ranges:
            low, high, depth, up = ranges.pop()
            inner = common[low + 1 : high]
            end = int(inner.min()) if len(inner) else int(self.lengths[low])
            for at in range(depth, end, STRIDE):
                rows.append((at, min(at + STRIDE, end), low, high, up))
                up = len(rows) - 1
            borders = [low, *(np.flatnonzero(inner == end) + low + 1).tolist(), high]
            for a, b in zip(borders[:-1], borders[1:]):
                if self.lengths[a] > end:
                    ranges.append((a, b, end, up))
        columns = np.array(rows, dtype=np.int64).reshape(-1, 5).T
        self.start, self.stop, self.first, self.last, self.parent = columns

    def _measure(self, sizes: np.ndarray) -> None:
        """Sets that end at a piece, and the bounds of what lies below each piece."""
        self.sizes = sizes
        self.children = [[] for _ in range(len(self.start) + 1)]
        for piece, up in enumerate(self.parent.tolist()):
            self.children[up].append(piece)
        self.children = [np.array(c, dtype=np.int64) for c in self.children]
        self.longest = np.array([self.lengths[a:b].max() for a, b in zip(self.first, self.last)], dtype=np.int64)
        self.smallest = np.array([sizes[a:b].min() for a, b in zip(self.first, self.last)], dtype=np.int64)
        self.ending = [
            np.flatnonzero(self.lengths[a:b] == stop) + a
            for a, b, stop in zip(self.first.tolist(), self.last.tolist(), self.stop.tolist())
        ]
        self.base = self.at[:-1][self.first]

    def partners(self, x: int, open_to: np.ndarray, percent: int) -> np.ndarray:
        """Sets (sorted places) similar to set ``x`` among those ``open_to`` it."""
        mine, n = self.sets[x], self.sizes[x]
        waiting = np.concatenate([[0], np.cumsum(open_to)])
        found, frontier = [], self.children[-1]
        overlap = np.zeros(len(frontier), dtype=np.int64)
        while len(frontier):
            useful = waiting[self.last[frontier]] > waiting[self.first[frontier]]
            frontier, overlap = frontier[useful], overlap[useful]
            if not len(frontier):
                break
            begin, end = self.start[frontier], self.stop[frontier]
            lengths = end - begin
            where = np.repeat(self.base[frontier] + begin - np.cumsum(lengths) + lengths, lengths)
            tokens = self.tokens[where + np.arange(len(where))]
            place = np.searchsorted(mine, tokens)
            hit = mine[np.minimum(place, len(mine) - 1)] == tokens
            borders = np.cumsum(lengths) - lengths
            overlap = overlap + np.add.reduceat(hit.astype(np.int64), borders)
            left = len(mine) - np.searchsorted(mine, tokens[borders + lengths - 1], side="right")
            most = overlap + np.minimum(left, self.longest[frontier] - end)
            reach = (100 + percent) * most >= percent * (n + self.smallest[frontier])
            frontier, overlap = frontier[reach], overlap[reach]
            following, carried = [], []
            for piece, shared in zip(frontier.tolist(), overlap.tolist()):
                ends = self.ending[piece]
                if len(ends):
                    near = (100 + percent) * shared >= percent * (n + self.sizes[ends])
                    found.append(ends[near & open_to[ends]])
                down = self.children[piece]
                if len(down):
                    following.append(down)
                    carried.append(np.full(len(down), shared))
            frontier = np.concatenate(following) if following else frontier[:0]
            overlap = np.concatenate(carried) if carried else overlap[:0]
        return np.concatenate(found) if found else np.empty(0, dtype=np.int64)


def joining_links(nodes, components_, sets, sizes, percent: int) -> tuple[list[int], list[int]]:
    """Links that join different components, as few as join all of them."""
    tree = Tree(sets, sizes)
    nodes = nodes[tree.order]
    _, group = np.unique(components_[tree.order], return_inverse=True)
    a, b = [], []
    alone = group.max(initial=0)
    for x in range(len(nodes)):
        if alone == 0:
            break
        open_to = group != group[x]
        for y in tree.partners(x, open_to, percent).tolist():
            if group[y] != group[x]:
                a.append(int(nodes[x]))
                b.append(int(nodes[y]))
                group[group == group[y]] = group[x]
                alone -= 1
    return a, b


_MEMBER = ("node", "component", "n", "grams")


def _tree_links(members: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """Links between components inside the trees of each task's group."""

    def links(table: pa.Table) -> pa.Table:
        nodes, component, tree, n = (
            table.column(c).to_numpy() for c in ("node", "component", "tree", "n")
        )
        lists = table.column("grams").combine_chunks()
        bounds, values = lists.offsets.to_numpy(), lists.values.to_numpy()
        order = np.argsort(tree, kind="stable")
        starts = np.flatnonzero(np.diff(tree[order], prepend=tree[order][0] - 1))
        a, b = [], []
        for rows in np.split(order, starts[1:]):
            sets = [values[bounds[i] : bounds[i + 1]] for i in rows.tolist()]
            more = joining_links(nodes[rows], component[rows], sets, n[rows], percent)
            a += more[0]
            b += more[1]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return members.select(*keys, "tree", *_MEMBER).groupBy(*keys).applyInArrow(links, "a long, b long")


def _links(ordered: DataFrame, percent: int) -> DataFrame:
    grams = F.expr("slice(grams, 1, CAST(spare AS INT) + 1)")
    first = stored(ordered.select("node", F.explode(grams).alias("gram")).distinct(), "first-grams")
    family = stored(_families(first), "families")
    weights = ordered.select("node", _weight().alias("weight"))
    sizes = weights.join(family, "node").groupBy("family").agg(F.sum("weight").alias("total"))
    sizes = stored(sizes, "family-sizes")
    last = F.floor(F.col("total") / BLOCK)
    # Small families share a task, about as many as fill a block; large ones have blocks.
    total = sizes.agg(F.sum("total")).head()[0] or 0
    block = F.when(last > 0, F.pmod(F.xxhash64("node"), last + 1)).otherwise(
        F.pmod(F.xxhash64("family"), F.lit(total // BLOCK + 1))
    )
    own = F.when(last > 0, F.col("family"))
    # Where a set goes is known before the sets move.
    places = family.join(sizes, "family").select("node", own.alias("own"), block.alias("block"), F.col("family").alias("tree"))
    blocks = ordered.join(stored(places, "places"), "node").withColumn("component", F.col("node"))
    links = stored(_tree_links(blocks, ["own", "block"], percent), "links")
    large = stored(sizes.where(last > 0).select("family"), "large-families")
    if large.isEmpty():
        return links
    inside = family.join(large, "family").select("node")
    members = ordered.withColumn("weight", _weight()).join(inside, "node")
    return links.unionAll(stored(_across_blocks(members, first, links, percent), "links"))


def _across_blocks(members: DataFrame, first: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """Links between components that share a first n-gram: every two blocks of its sets meet."""
    found = components(links)
    sets = members.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sets = stored(sets.select(*_MEMBER, "weight"), "members")
    placed = first.join(sets.select("node", "component", "weight"), "node")
    groups = placed.groupBy("gram").agg(
        F.min("component").alias("low"),
        F.max("component").alias("high"),
        F.sum("weight").alias("total"),
        # Equal groups of sets need to meet once only.
        F.count(F.lit(1)).alias("size"),
        F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sum"),
        F.bit_xor(F.xxhash64("node", F.lit(1))).alias("xor"),
    )
    mixed = groups.where("low < high").groupBy("size", "sum", "xor").agg(
        F.min("gram").alias("gram"), F.first("total").alias("total")
    )
    last = F.floor(F.col("total") / BLOCK).cast("int")
    met = placed.join(mixed.select("gram", last.alias("last")), "gram")
    met = met.withColumn("own", F.pmod(F.xxhash64("node"), F.col("last") + 1).cast("int"))
    met = met.select("gram", "node", "own", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("other"))
    met = met.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))
    dealt = met.join(sets, "node").withColumn("tree", F.lit(0).cast("long"))
    return _tree_links(dealt, ["gram", "low", "high"], percent)


def similar_documents(
    docs: DataFrame, words: int = WORDS, percent: int = PERCENT, key: str = "doc_id"
) -> DataFrame:
    """``key``, ``n_shingles`` and ``component_id`` of every row.

    Documents are linked when ``100 * intersection >= percent * union`` holds for their sets of
    ``words``-word n-grams (with fewer words, the whole sequence). ``component_id`` is the
    smallest id reachable by links, the document's own included. Ids are whole numbers.
    """
    marks = stored(set_marks(docs, words, percent, key), "set-marks")
    digests = ["digest", "digest_b"]
    usable = marks.where(F.col(key).isNotNull() & (F.col("n") > 0))
    classes = stored(usable.groupBy(*digests).agg(F.min(key).cast("long").alias("node")), "classes")
    chosen = usable.withColumn("node", F.col(key).cast("long")).join(classes, ["node", *digests], "left_semi")
    able = stored(_can_have_partners(chosen.select("node", "n", "first"), percent), "able")
    texts = docs.select(F.col(key).cast("long").alias("node"), text_or_empty().alias("text"))
    sets = stored(gram_sets(texts.join(able, "node", "left_semi"), words), "sets")
    ordered = stored(ordered_sets(sets, percent), "ordered-sets")
    marks = marks.drop("first")
    rows = marks.join(classes, digests, "left")
    labels = components(_links(ordered, percent).unionAll(_same_id(rows, key)))
    of_class = classes.join(labels, "node", "left").select(*digests, F.coalesce("component", "node").alias("component"))
    own = F.when(F.col(key).isNotNull(), F.coalesce("component", F.col(key).cast("long")))
    result = marks.join(of_class, digests, "left")
    return result.select(key, F.col("n").alias("n_shingles"), own.alias("component_id"))


def _same_id(rows: DataFrame, key: str) -> DataFrame:
    """Links between the classes of one id, where its rows differ."""
    named = rows.where(F.col(key).isNotNull() & F.col("node").isNotNull()).select(key, "node")
    several = named.groupBy(key).agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z")
    return named.join(several, key).select("a", F.col("node").alias("b"))
