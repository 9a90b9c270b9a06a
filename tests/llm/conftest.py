import pytest
from odd_rows import LONG, SCHEMA, rows


@pytest.fixture
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows."""
    plain = "The quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak tree."
    made = rows([plain, plain, "", " \n\t ", None, "word", LONG, LONG + " tail", "é ü 漢字 \U0001f600 text", "\n".join([plain] * 4)])
    made += [made[0], made[0], (None,) * len(SCHEMA), (None, plain, None, None, None, *["x"] * 6)]
    return spark.createDataFrame(made, SCHEMA)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def labels(spark):
    return spark.createDataFrame(
        [(0, 1, 0), (1, 0, 1), (1, 1, 0), (5, 1, None), (6, None, 0), (None, 1, 1), (7, 0, 0), (99, 1, 1)],
        "doc_id long, quality int, toxic int",
    )
