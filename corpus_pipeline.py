"""From raw documents to a weighted training set: five stages over the whole table.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept, and
returns a frame; all but the last return the columns of documents. ``run`` writes each
stage's rows and reads them again before the next. Rows without an id pass the stages that
decide by id. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from respeval.llm import decontam, linededup, minhash, mixing, toxicity
from respeval.llm.tables import read, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxicity threshold."""
    return toxicity.without_toxic(docs, read(spark, sf_dir, "labels"))


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that are frequent on their source."""
    return linededup.without_boilerplate(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8."""
    return minhash.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontam.without_items(docs, read(spark, sf_dir, "benchmark"))


def weigh(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the ``rate`` at which to draw them; those at rate 0 have no share."""
    domains = mixing.labelled_domains(read(spark, sf_dir, "labels"))
    return mixing.mixed(docs, domains, mixing.TARGETS)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", weigh),
]

#: The learned scores and the fitted rates cannot be had from SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
