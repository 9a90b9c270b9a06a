"""Connected components of a link table, by rounds of contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from respeval.llm.tables import stored


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component``, the smallest node it is linked with, for every linked node.

    ``links`` has the columns ``a`` and ``b``. In each round every node joins the neighbour
    that comes first in a hashed order, and the graph is contracted; the hashed order makes
    long chains shrink by a constant factor per round. A node with very many neighbours is
    only ever aggregated with partial sums or on the split side of a join. Each round is
    stored, so that no lineage grows and a lost executor costs one round.
    """
    links = stored(links.where("a <> b").select("a", "b").distinct(), "links")
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    labels = ends.withColumn("label", F.col("node"))
    order = lambda c: F.struct(F.xxhash64(c), F.col(c))
    while not links.isEmpty():
        both = links.select("a", "b").unionAll(links.select(F.col("b"), F.col("a")))
        first = both.groupBy("a").agg(F.min(order("b")).alias("first"))
        parents = first.where(F.col("first") < order("a"))
        parents = stored(
            parents.select(F.col("a").alias("label"), F.col("first.b").alias("parent")), "parents"
        )
        up = F.coalesce("parent", "label")
        labels = stored(
            labels.join(parents, "label", "left").select("node", up.alias("label")), "labels"
        )
        for end in ("a", "b"):
            links = links.withColumnRenamed(end, "label").join(parents, "label", "left")
            links = links.withColumn(end, up).drop("label", "parent")
        links = stored(links.where("a <> b").select("a", "b").distinct(), "links")
    smallest = labels.groupBy("label").agg(F.min("node").alias("component"))
    return labels.join(smallest, "label").select("node", "component")
