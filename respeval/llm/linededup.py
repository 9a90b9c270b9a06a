"""Line de-duplication by site-relative frequency.

A line that a large share of a site's pages holds is boilerplate. For every host the pages
that hold a line are counted, each page once, and divided by the host's pages; lines above
the ratio are dropped from that host's pages, in every place.

Only DataFrame functions are used. Lines are counted with partial sums per task before the
shuffle, so a line on very many pages or a host with a third of all pages is not gathered
anywhere. A host can have at most (lines per page / ratio) lines above the ratio, whatever
the number of its pages, so the list that is joined back to the pages is small; a host's
pages are spread over ``SALTS`` join keys. Lines are told apart by 128 bits of hash.

Lines are compared without blanks at either end; blank lines are never dropped. Pages
without a host (null) have a site of their own kind, the null host. Null texts have no
lines and stay null. Repeated rows are pages of their own. The ratio holds for every host; on
small ones a line must stand on ``LEAST`` pages, so a host with fewer pages loses nothing. Other
columns are kept, whatever their names; ``n_chars``, where it exists, follows the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from respeval.functions.once import computed_once
from respeval.llm.tables import stored

RATIO = 0.1
#: Pages that must hold a line, whatever the host's size.
LEAST = 3
SALTS = 32
_BLANKS = "\t\r\x0b\x0c"


def _mark(line: Column) -> Column:
    """128 bits that stand for a line."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(7), line).alias("b"))


def _bare(text: Column) -> Column:
    """The lines as they are compared. Few texts have blanks other than spaces."""
    odd = F.lit(False)
    for blank in _BLANKS:
        odd |= F.contains(text, F.lit(blank))
    plain = F.when(odd, F.translate(text, _BLANKS, " " * len(_BLANKS))).otherwise(text)
    return F.transform(F.split(plain, "\n"), lambda x: F.trim(x))


def boilerplate(
    pages: DataFrame,
    host: str = "source",
    text: str = "text",
    ratio: float = RATIO,
    least: int = LEAST,
) -> DataFrame:
    """``host``, ``line`` (its hash), ``n_pages`` that hold it and ``host_pages``."""
    own = pages.select(F.col(host).alias("host"), F.col(text).cast("string").alias("text"))
    totals = own.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))
    lines = F.array_except(_bare(F.col("text")), F.array(F.lit("")))
    counts = (
        own.select("host", F.explode(lines).alias("line"))
        .select("host", _mark(F.col("line")).alias("line"))
        .groupBy("host", "line")
        .agg(F.count(F.lit(1)).alias("n_pages"))
        .where(F.col("n_pages") >= least)
    )
    both = counts.join(totals, counts["host"].eqNullSafe(totals["host"])).drop(totals["host"])
    return both.where(F.col("n_pages") > F.lit(ratio) * F.col("host_pages"))


def without_boilerplate(
    pages: DataFrame,
    host: str = "source",
    text: str = "text",
    ratio: float = RATIO,
    least: int = LEAST,
    salts: int = SALTS,
    counts: bool = False,
) -> DataFrame:
    """The pages without their hosts' boilerplate lines; same rows and columns.

    With ``counts``, ``_lines_`` and ``_dropped_`` say how many lines with text a page had
    and how many of them went.
    """
    listed = boilerplate(pages, host, text, ratio, least)
    listed = listed.groupBy(F.col("host").alias("_host_")).agg(
        F.collect_set("line").alias("_frequent_")
    )
    # Stored, so that its size is known where the pages are joined to it.
    listed = stored(listed, "boilerplate").select(
        "*",
        F.col("_frequent_.a").alias("_first_"),
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt_"),
    )
    spread = pages.withColumn("_salt_of_", F.pmod(F.xxhash64(F.col(text)), F.lit(salts)).cast("int"))
    on = F.col(host).eqNullSafe(F.col("_host_")) & (F.col("_salt_of_") == F.col("_salt_"))
    whole = F.col(text).cast("string")
    joined = computed_once(
        spread.join(listed, on, "left"), {"_given_": F.split(whole, "\n"), "_bare_": _bare(whole)}
    )
    goes = F.transform(
        "_bare_",
        lambda x: F.array_contains("_first_", F.xxhash64(x)) & F.array_contains("_frequent_", _mark(x)),
    )
    joined = computed_once(joined, {"_goes_": F.when(F.col("_frequent_").isNotNull(), goes)})
    stays = F.filter("_given_", lambda x, at: ~F.get("_goes_", at))
    left = F.when(F.col("_frequent_").isNull(), F.col(text)).otherwise(F.array_join(stays, "\n"))
    columns = [F.col(c) if c != text else left.alias(text) for c in pages.columns]
    if counts:
        had = F.size(F.filter("_bare_", lambda x: x != ""))
        gone = F.size(F.filter("_goes_", lambda x: x))
        columns += [
            F.when(F.col("_bare_").isNotNull(), had).otherwise(0).cast("long").alias("_lines_"),
            F.when(F.col("_goes_").isNotNull(), gone).otherwise(0).cast("long").alias("_dropped_"),
        ]
    result = joined.select(*columns)
    if "n_chars" in pages.columns and text != "n_chars":
        size = F.length(text).cast(dict(pages.dtypes)["n_chars"])
        result = result.withColumn("n_chars", F.when(F.col(text).isNull(), F.col("n_chars")).otherwise(size))
    return result
