"""Seeded fixed-size samples that do not depend on how the data is partitioned."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from respeval import constants as C
from respeval.session import stored

BUCKET_DIGITS = 3


def draw_order(seed: int, columns: Sequence[str]) -> Column:
    """Pseudo-random text order that depends only on the seed and the values."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))


def fixed_size_sample(
    items: DataFrame,
    n: int = C.SAMPLE_SIZE,
    strata: Sequence[str] = ("dataset",),
    id_cols: Sequence[str] = ("item_id",),
    seed: int = C.SAMPLE_SEED,
) -> DataFrame:
    """Exactly ``min(n, rows)`` rows of every stratum, with their ``sample_index``.

    The order is uniform, so its leading hex digits cut each stratum into equal
    ranges. A first pass, run at once, reads the key columns, counts the ranges and
    stores those that begin before row ``n``. Only their rows go on to be ranked, each
    range on its own, so no task ever ranks a whole stratum. The stored table tells the
    planner its size: small, it filters the scan as a broadcast; large, it is joined by
    shuffle.
    """
    strata, id_cols = list(strata), list(id_cols)
    keyed = items.where(_all_present(strata)).withColumn(
        "_order", draw_order(seed, [*strata, *id_cols])
    )
    keyed = keyed.withColumn("_range", F.substring("_order", 1, BUCKET_DIGITS))
    earlier = (
        Window.partitionBy(*strata)
        .orderBy("_range")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow - 1)
    )
    starts = stored(
        keyed.groupBy(*strata, "_range")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
        .where(F.col("_before") < n)
        .drop("_rows"),
        "sample-ranges",
    )
    within = Window.partitionBy(*strata, "_range", "_before").orderBy("_order", *id_cols)
    ranked = (
        keyed.join(starts, [*strata, "_range"])
        .withColumn("_rank", F.row_number().over(within))
        .where(F.col("_rank") <= n)
        .withColumn("sample_index", F.col("_before") + F.col("_rank") - 1)
        .where(F.col("sample_index") < n)
    )
    return ranked.select(*items.columns, "sample_index")


def default_item_id(sample: DataFrame, id_col: str = "item_id") -> DataFrame:
    """Fill missing ids with the row's position inside the sample."""
    return sample.withColumn(
        id_col, F.coalesce(F.col(id_col).cast("string"), F.col("sample_index").cast("string"))
    )


def sample_manifest(
    items: DataFrame,
    n: int = C.SAMPLE_SIZE,
    strata: Sequence[str] = ("dataset",),
    id_col: str = "item_id",
    seed: int = C.SAMPLE_SEED,
) -> DataFrame:
    """Sorted list of sampled ids per stratum; a list never exceeds ``n`` ids."""
    sample = fixed_size_sample(items, n, strata, [id_col], seed)
    return sample.groupBy(*strata).agg(
        F.array_sort(F.collect_list(F.col(id_col).cast("string"))).alias("item_ids")
    )


def select_by_manifest(
    items: DataFrame,
    manifest: DataFrame,
    strata: Sequence[str] = ("dataset",),
    id_col: str = "item_id",
) -> DataFrame:
    """Only the items that a stored manifest lists."""
    listed = manifest.select(*strata, F.explode("item_ids").alias("_listed"))
    matched = [items[s] == listed[s] for s in strata]
    matched.append(items[id_col].cast("string") == listed["_listed"])
    return items.join(listed, matched, "left_semi")


def _all_present(columns: Sequence[str]) -> Column:
    present = F.lit(True)
    for name in columns:
        present = present & F.col(name).isNotNull()
    return present
