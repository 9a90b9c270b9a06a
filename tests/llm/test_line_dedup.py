"""Boilerplate on hosts of every size, under the shipped rule."""

import duckdb
import pytest

from respeval.llm import linededup
from respeval.llm.oracles import LINE_DEDUP
from respeval.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
SIZES = {"two": 2, "three": 3, "nineteen": 19, "forty": 40, "large": 200, None: 12}


@pytest.fixture(scope="module")
def made(spark):
    """Each page has its own line, a footer with odd blanks, and a line on every eighth page."""
    rows = []
    for host, size in SIZES.items():
        for page in range(size):
            footer = ["All\trights reserved", "  All rights reserved\r", "All rights\x0breserved "][page % 3]
            lines = [f"page {page} of {host}", "", footer, *["one in eight"] * (page % 8 == 0), footer]
            rows.append((len(rows), "\n".join(lines), host, 1))
        rows.append((len(rows), None, host, None))
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int")


def test_every_host_loses_its_footer(made):
    rows = linededup.without_boilerplate(made, counts=True).collect()
    assert len(rows) == made.count()
    for r in rows:
        if r["text"] is None:
            assert (r["_lines_"], r["_dropped_"], r["n_chars"]) == (0, 0, None)
            continue
        size = SIZES[r["source"]] + 1
        assert ("rights" in r["text"]) == (r["source"] == "two")
        eighths = -(-(size - 1) // 8)
        goes = eighths >= 3 and eighths > 0.1 * size
        assert not (goes and "eight" in r["text"])
        assert r["text"].startswith("page ") and r["n_chars"] == len(r["text"])
    assert {r["source"] for r in rows if r["_dropped_"]} == set(SIZES) - {"two"}
    assert any("eight" in (r["text"] or "") for r in rows if r["source"] == "nineteen") is False
    assert any("eight" in (r["text"] or "") for r in rows if r["source"] is None)


def test_made_pages_against_sql(made):
    given = made.toArrow()  # noqa: F841
    sql = LINE_DEDUP.format(documents="given") + (
        "SELECT doc_id, kept, n_lines, n_dropped FROM pages JOIN rebuilt USING (page) WHERE text IS NOT NULL"
    )
    expected = sorted(duckdb.sql(sql).fetchall())
    rows = linededup.without_boilerplate(made, counts=True).where("text IS NOT NULL").collect()
    assert sorted((r["doc_id"], r["text"], r["_lines_"], r["_dropped_"]) for r in rows) == expected


def test_small_table_loses_lines(spark):
    assert any(r["n_dropped"] for r in QUERIES["op1_line_dedup"](spark, SMALL).collect())
