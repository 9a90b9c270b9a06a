"""Rows no operator may fail on."""

from pyspark.sql.types import LongType, StringType, StructField, StructType

SCHEMA = StructType(
    [
        StructField("doc_id", LongType()),
        StructField("text", StringType()),
        StructField("lang", StringType()),
        StructField("source", StringType()),
        StructField("n_chars", LongType()),
        # Names the operators use themselves, or might.
        StructField("score", StringType()),
        StructField("component_id", StringType()),
        StructField("n_words", StringType()),
        StructField("rate2", StringType()),
        StructField("bucket", StringType()),
        StructField("kept", StringType()),
    ]
)

LONG = " ".join(f"w{i % 5000}x{i % 7}" for i in range(60_000))


def rows(texts):
    return [(i, t, "en", "s0", len(t or ""), "a", "b", "c", "d", "e", "f") for i, t in enumerate(texts)]
