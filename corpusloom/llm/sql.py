"""SQL equivalents of the queries of this subpackage, where SQL can express them on whole tables."""

_GRAMS = """w AS (SELECT row_id, list_filter(regexp_split_to_array(lower(text), '[^\\pL\\pN]+'), lambda x: x <> '') AS w FROM chunks WHERE text IS NOT NULL),
g AS (SELECT DISTINCT row_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT row_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 20)),
n AS (SELECT row_id, count(*) AS n FROM g GROUP BY row_id)"""

_FOLDED = "list_filter(regexp_split_to_array(lower(strip_accents(replace({0}, chr(173), ''))), '[^\\pL\\pN]+'), lambda x: x <> '')"
_TWELVE = "array_to_string(w[i : i + 11], ' ')"

ORACLE: dict[str, str] = {
    "p1_found": """SELECT 'chunk' AS record_kind, row_id AS record_id FROM chunks WHERE coalesce(length(text), 0) + CASE WHEN len(headings) > 0 THEN length(array_to_string(headings, ' > ')) + 1 ELSE 0 END > 1024
UNION ALL SELECT 'element', element_id FROM elements WHERE length(text) > 1024""",
    "p7_found": f"""WITH {_GRAMS}, b AS (SELECT x.row_id AS a, y.row_id AS b, count(*) AS c FROM g x JOIN g y ON x.g = y.g AND x.row_id < y.row_id GROUP BY ALL)
SELECT a AS row_id_a, b AS row_id_b FROM b JOIN n m ON m.row_id = a JOIN n ON n.row_id = b WHERE c >= 0.6 * (m.n + n.n - c)""",
    "p9_found": f"""WITH d AS (SELECT doc_id, {_FOLDED.format('text')} AS w FROM documents WHERE text IS NOT NULL), p AS (SELECT item_id, {_FOLDED.format('passage')} AS w FROM golden_cases WHERE passage IS NOT NULL),
dg AS (SELECT DISTINCT doc_id, {_TWELVE} AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM d WHERE len(w) >= 12)), pg AS (SELECT DISTINCT item_id, {_TWELVE} AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM p WHERE len(w) >= 12))
SELECT DISTINCT doc_id, item_id FROM dg JOIN pg USING (g)""",
}
