"""DuckDB SQL that gives the same rows as the queries, where SQL can express them."""

#: ``documents`` without boilerplate lines, and the counts, for a table named in its place.
LINE_DEDUP = r"""
WITH pages AS (
    SELECT row_number() OVER () AS page, * FROM {documents}
), lines AS (
    SELECT page, source, unnest(string_split(text, chr(10))) AS line,
        generate_subscripts(string_split(text, chr(10)), 1) AS line_no
    FROM pages
), keyed AS (
    SELECT *, trim(translate(line, chr(9) || chr(13) || chr(11) || chr(12), '    ')) AS bare FROM lines
), totals AS (
    SELECT source, count(*) AS host_pages FROM pages GROUP BY source
), frequent AS (
    SELECT k.source, k.bare
    FROM (SELECT DISTINCT page, source, bare FROM keyed WHERE bare <> '') k
    JOIN totals t ON k.source IS NOT DISTINCT FROM t.source
    GROUP BY k.source, k.bare, t.host_pages
    HAVING count(*) > 0.1::DOUBLE * t.host_pages AND count(*) >= 3
), marked AS (
    SELECT k.*, f.bare IS NOT NULL AS dropped
    FROM keyed k LEFT JOIN frequent f
        ON k.bare = f.bare AND k.source IS NOT DISTINCT FROM f.source
), rebuilt AS (
    SELECT page, count(*) FILTER (bare <> '') AS n_lines, count(*) FILTER (dropped) AS n_dropped,
        coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT dropped), '') AS kept
    FROM marked GROUP BY page
)
"""

ORACLES: dict[str, str] = {
    "op1_line_dedup": LINE_DEDUP.format(documents="documents")
    + """
SELECT p.doc_id, coalesce(r.n_lines, 0) AS n_lines, coalesce(r.n_dropped, 0) AS n_dropped,
    length(r.kept) AS kept_chars, sha256(r.kept) AS kept_sha256
FROM pages p LEFT JOIN rebuilt r USING (page)
""",
}

#: Words are runs of letters and digits, A-Z in lower case; shingles have five words.
ORACLES["op9_decontamination"] = r"""
WITH texts AS (
    SELECT 'd' AS kind, doc_id AS id, text FROM documents
    UNION ALL SELECT 'b', item_id, text FROM benchmark
), words AS (
    SELECT kind, id, regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
    FROM texts
), shingles AS (
    SELECT DISTINCT kind, id, array_to_string(w[i:i + 4], ' ') AS shingle
    FROM (SELECT *, unnest(range(1, len(w) - 3)) AS i FROM words)
), sizes AS (
    SELECT id, count(*) AS n_shingles FROM shingles WHERE kind = 'b' GROUP BY id
), shared AS (
    SELECT d.id AS doc_id, b.id AS item_id, count(*) AS n_shared
    FROM shingles d JOIN shingles b USING (shingle)
    WHERE d.kind = 'd' AND b.kind = 'b' GROUP BY ALL
)
SELECT doc_id, item_id, n_shingles, n_shared, n_shared / n_shingles AS containment
FROM shared JOIN sizes ON item_id = id
WHERE 100 * n_shared >= 80 * n_shingles
"""


def registered() -> dict[str, str]:
    import corpus_pipeline

    own = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return ORACLES | own
