"""SQL equivalents of the catalogue, over views named like the tables."""

from __future__ import annotations

from corpusloom.functions.text import ACRONYMS, FUNCTION_WORDS
from corpusloom.plans.catalogue import DEPTH, FACTOR, MAPPING, MARKERS, PER_FILE, SUFFIXES, THRESHOLD, TOKENS, TOPK

WS = r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def collapse(c: str) -> str:
    return f"trim(regexp_replace({c}, '{WS}', ' ', 'g'))"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}|{WS}$', '', 'g')"


def name(c: str) -> str:
    return f"nfc_normalize(list_extract(string_split({strip(f'split_part({c}, ' + chr(39) + '#' + chr(39) + ', 1)')}, '/'), -1))"


def words(c: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({c}), '[^\\pL\\pN]+'), lambda x: x <> '')"


def tokens(c: str) -> str:
    return f"greatest(1, coalesce(length({c}), 0) // 4)"


BASE = "list_extract(string_split(file_path, '/'), -1)"
URL = f"'/docs/' || CASE WHEN coalesce(topic, '') <> '' THEN topic || '/' ELSE '' END || url_encode({BASE}) || '#page=' || page"
SANITISED = f"left({collapse('regexp_replace(query, ' + chr(39) + r'[#@$%&*(){}\[\]<>|\\]+' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')}, 200)"
SANITISED = f"CASE WHEN length(trim({SANITISED})) < 3 THEN '' ELSE {SANITISED} END"
QTOKENS = f"CASE WHEN coalesce({collapse('query')}, '') = '' THEN 0 ELSE len(string_split({collapse('query')}, ' ')) END"
LEGIBLE = (
    "CASE WHEN len(regexp_extract_all(lower(text), '[a-záéíóúñü]+')) > 0 THEN len(list_filter(regexp_extract_all(lower(text), '[a-záéíóúñü]+'), lambda w: w IN ("
    + ", ".join(f"'{w}'" for w in FUNCTION_WORDS)
    + "))) / len(regexp_extract_all(lower(text), '[a-záéíóúñü]+')) ELSE 0 END"
)
TOTALS = "SELECT file_path, max(total_pages) AS total_pages FROM extractions WHERE total_pages IS NOT NULL GROUP BY file_path"
AT = "CASE WHEN regexp_matches(trim(timestamp), '(?i)(z|[+-][0-9]{2}:?[0-9]{2})$') THEN try_cast(trim(timestamp) AS TIMESTAMPTZ) ELSE try_cast(trim(timestamp) || 'Z' AS TIMESTAMPTZ) END"
LOG = f"SELECT *, {AT} AS tried FROM file_state WHERE path IS NOT NULL"
ARM = "CASE WHEN source IS NOT DISTINCT FROM 'retrieve' THEN 'retrieve' ELSE 'chat' END"


STOP = ", ".join(f"'{w}'" for w in FUNCTION_WORDS)


def bm25(queries: str, k: int) -> str:
    """CTEs up to ``hits`` (query_id, doc_id, score, rank)."""
    return f"""
q0 AS ({queries}),
q AS (SELECT * FROM (SELECT DISTINCT query_id, topic, unnest({words(SANITISED)}) AS term FROM q0) WHERE term NOT IN ({STOP})),
w AS (SELECT topic, row_id AS doc_id, {words('text')} AS w FROM chunks WHERE text IS NOT NULL),
d AS (SELECT topic, doc_id, w, len(w) AS dl FROM w WHERE len(w) > 0),
st AS (SELECT topic, count(*) AS n, avg(dl) AS avgdl FROM d GROUP BY topic),
p AS (SELECT topic, doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT topic, doc_id, dl, unnest(w) AS term FROM d) GROUP BY ALL),
f AS (SELECT topic, term, count(*) AS df FROM p GROUP BY ALL),
sc AS (SELECT q.query_id, p.doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * p.dl / avgdl))), 4) AS score
  FROM q JOIN p ON q.topic = p.topic AND q.term = p.term JOIN f ON f.topic = p.topic AND f.term = p.term JOIN st ON st.topic = p.topic GROUP BY ALL),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc) WHERE rank <= {k})"""


ASKED = "SELECT retrieval_id AS query_id, topic, query FROM retrievals WHERE retrieval_id % 50 = 0 AND query IS NOT NULL AND topic IS NOT NULL"


def dense(which: str, k: int) -> str:
    return f"""
e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
dn AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 6) AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE {which}),
close AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM dn) WHERE rank <= {k})"""


def fused(depth: int) -> str:
    return (
        bm25(ASKED, depth)
        + ","
        + dense("a.vec_id IN (SELECT query_id FROM q0)", depth)
        + """,
u AS (SELECT query_id, doc_id, rank AS dense_rank, NULL::BIGINT AS bm25_rank FROM close UNION ALL SELECT query_id, doc_id, NULL, rank FROM hits),
fu AS (SELECT query_id, doc_id, max(dense_rank) AS dense_rank, max(bm25_rank) AS bm25_rank FROM u GROUP BY ALL),
fz AS (SELECT *, round(coalesce(1.0::DOUBLE / (60 + dense_rank), 0) + coalesce(1.0::DOUBLE / (60 + bm25_rank), 0), 8) AS rrf FROM fu)"""
    )


FORDER = "rrf DESC, dense_rank NULLS LAST, bm25_rank NULLS LAST, doc_id"
FACTS = f"fx AS (SELECT fz.*, file_path, page, topic, text, {tokens('text')} AS tokens FROM fz JOIN chunks ON row_id = doc_id)"
CAPPED = f"""cp AS (SELECT *, row_number() OVER (PARTITION BY query_id, file_path ORDER BY {FORDER}) AS inf FROM fx),
ck AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {FORDER}) AS rank FROM cp WHERE inf <= {PER_FILE}),
ct AS (SELECT *, sum(tokens) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM ck WHERE rank <= {TOPK})"""

ALIAS = f"""dg AS (SELECT file_path AS path, sum(('0x' || substr(md5(coalesce(text, '')), 1, 8))::BIGINT)::VARCHAR || '-' || count(*) AS h FROM (SELECT DISTINCT file_path, page, text FROM elements WHERE file_path IS NOT NULL) GROUP BY 1),
al0 AS (SELECT DISTINCT {name('path')} AS file, h FROM dg),
alg AS (SELECT h, min(file) AS canonical FROM al0 GROUP BY h HAVING count(*) > 1),
al AS (SELECT file, min(canonical) AS canonical FROM al0 JOIN alg USING (h) GROUP BY file)"""
GOLDEN_RUN = bm25("SELECT item_id AS query_id, topic, query FROM golden_cases", 10) + f", run AS (SELECT query_id, rank, {name('file_path')} AS file, page FROM hits JOIN chunks ON row_id = doc_id)"
TRUTH = f"""tr0 AS (SELECT item_id AS query_id, unnest(relevant_pages) AS r FROM golden_cases),
tr AS (SELECT query_id, {name('r')} AS file, try_cast(CASE WHEN contains(r, '#') AND regexp_matches(trim(list_extract(string_split(r, '#'), -1)), '^-?[0-9]{{1,9}}$') THEN trim(list_extract(string_split(r, '#'), -1)) END AS INTEGER) AS page FROM tr0),
trc AS (SELECT query_id, coalesce(canonical, tr.file) AS file, page, tr.file || '#' || coalesce(page::VARCHAR, '?') AS ref FROM tr LEFT JOIN al ON al.file = tr.file)"""
PREDICTED = """pc AS (SELECT query_id, coalesce(canonical, run.file) AS file, page, rank FROM run LEFT JOIN al ON al.file = run.file),
pf AS (SELECT query_id, file, page, min(rank) AS r FROM pc GROUP BY ALL),
pp AS (SELECT query_id, file, page, row_number() OVER (PARTITION BY query_id ORDER BY r, file, page NULLS FIRST) AS rank, file || '#' || coalesce(page::VARCHAR, '?') AS ref FROM pf)"""
MATCH = """pm AS (SELECT query_id, rank FROM pp WHERE EXISTS (SELECT 1 FROM trc t WHERE t.query_id = pp.query_id AND t.file = pp.file
  AND CASE WHEN t.page IS NULL OR pp.page IS NULL THEN t.ref = pp.ref ELSE abs(t.page - pp.page) <= 1 END))"""
SCORED = """sr AS (SELECT g.item_id, g.topic, m.f FROM golden_cases g LEFT JOIN (SELECT query_id, min(rank) AS f FROM pm GROUP BY ALL) m ON m.query_id = g.item_id)"""
EVAL = f"WITH {GOLDEN_RUN}, {ALIAS}, {TRUTH}, {PREDICTED}, {MATCH}, {SCORED}"


def hit(k: int, f: str = "f") -> str:
    return f"CASE WHEN {f} <= {k} THEN 1.0 ELSE 0.0 END"


def fam(ks: tuple[int, ...], f: str = "f") -> str:
    means = ", ".join(f"round(avg(({hit(k, f)})::DOUBLE), 4) AS recall_at_{k}" for k in ks)
    return f"count(*) AS n, {means}, round(avg(coalesce(1.0::DOUBLE / {f}, 0)), 4) AS mrr"


BY_TOPIC = f"SELECT topic, {fam((1, 3, 5, 10))} FROM sr GROUP BY topic"

ACRONYM_QUERY = "(query || ' según ' || list_extract([" + ", ".join(f"'{a}'" for a in [*ACRONYMS, "ITC-BT-44", "objecte"]) + "], (retrieval_id % 10 + 1)::INTEGER))"
EXPANDED = " || ".join(
    [ACRONYM_QUERY, *[f"CASE WHEN regexp_matches({ACRONYM_QUERY}, '(?i)(^|[^\\pL\\pN_-]){a}($|[^\\pL\\pN_-])') THEN ' {x}' ELSE '' END" for a, x in ACRONYMS.items()]]
)
BOILER = f"""r AS (SELECT file_path, page, text FROM elements WHERE page IS NOT NULL AND text IS NOT NULL),
c AS (SELECT file_path, count(DISTINCT page) AS n FROM r GROUP BY ALL),
l0 AS (SELECT file_path, page, unnest(string_split(text, chr(10))) AS l FROM r),
l AS (SELECT DISTINCT file_path, page, lower({collapse('l')}) AS line FROM l0),
b AS (SELECT l.file_path, line, count(*) AS pages FROM l JOIN c USING (file_path) WHERE line <> '' AND length(line) <= 100 AND n >= 4 GROUP BY l.file_path, line, n HAVING count(*) >= greatest(3, floor(n * 0.3)))"""
CURRENT = f"""lg AS ({LOG}),
la AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY tried DESC, logged_at DESC, state_id DESC) AS k FROM lg) WHERE k = 1),
ok AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY tried DESC, logged_at DESC, state_id DESC) AS k FROM lg WHERE status = 'success') WHERE k = 1),
fl AS (SELECT lg.path, count(*) AS retries FROM lg LEFT JOIN ok USING (path) WHERE lg.status = 'failed' AND (ok.path IS NULL OR (lg.tried, lg.logged_at, lg.state_id) > (ok.tried, ok.logged_at, ok.state_id)) GROUP BY lg.path),
cur AS (SELECT la.path, la.status, la.hash, la.topic, coalesce(retries, 0) AS retries FROM la LEFT JOIN fl USING (path))"""
GEOM = """g AS (SELECT file_path, page, min(bbox[2]) AS top, max(bbox[4]) AS bottom FROM elements WHERE len(bbox) = 4 AND page > 0 GROUP BY ALL),
ru AS (SELECT file_path, page, coalesce(sum(greatest(bottom, 1.0)) OVER (PARTITION BY file_path ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s, greatest(bottom, 1.0) AS h FROM g),
en AS (SELECT file_path, page, s, s + h AS e FROM ru),
spot AS (SELECT element_id, x.file_path, x.page, en.s + x.bbox[2] AS y FROM elements x JOIN en ON en.file_path = x.file_path AND en.page = x.page WHERE len(x.bbox) = 4)"""
PER_REQUEST = f"CASE {' '.join(f'WHEN lower(topic) LIKE {chr(39)}%{s}{chr(39)} THEN left(topic, length(topic) - {len(s)})' for s in SUFFIXES)} ELSE topic END"
MAPPED = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in MAPPING.items()) + "}"

_L = "[A-Za-zÀ-ÿ]"
#: Letters beside a letter are marked by a control character; overlapping ones take a pass each.
_BEHIND = f"regexp_replace({{0}}, '({_L})([ÆØœæŒ])', '\\1' || chr(1) || '\\2', 'g')"
_AHEAD = f"regexp_replace({{0}}, '(^|[^' || chr(1) || '])([ÆØœæŒ])(' || chr(1) || '?{_L})', '\\1' || chr(1) || '\\2\\3', 'g')"


def _marked(c: str) -> str:
    for _ in range(4):
        c = _BEHIND.format(c)
    for _ in range(4):
        c = _AHEAD.format(c)
    return f"replace({c}, chr(1) || chr(1), chr(1))"


_CP1252 = "[" + ", ".join(f"'{bytes([c]).decode('cp1252', 'ignore')}'" for c in range(128, 160)) + "]"
_CODE = "regexp_extract(p, '^([0-9]{1,7})>', 1)::INTEGER"
REPAIRED = f"""WITH g0 AS (SELECT element_id, file_path, text AS was, string_split(text, 'GLYPH<') AS ps FROM elements WHERE text IS NOT NULL),
g1 AS (SELECT element_id, file_path, was, ps[1] AS first, list_transform(ps[2:], lambda p: CASE WHEN NOT regexp_matches(p, '^[0-9]{{1,7}}>') THEN {{'n': 0, 't': 'GLYPH<' || p}}
WHEN {_CODE} > 1114111 OR {_CODE} BETWEEN 55296 AND 57343 THEN {{'n': 0, 't': 'GLYPH<' || p}}
ELSE {{'n': 1, 't': CASE WHEN {_CODE} < 32 OR {_CODE} = 127 THEN '' WHEN {_CODE} BETWEEN 128 AND 159 THEN {_CP1252}[{_CODE} - 127] ELSE chr({_CODE}) END || regexp_replace(p, '^[0-9]+>', '')}} END) AS ts FROM g0),
g2 AS (SELECT element_id, file_path, was, {_marked("(replace(first, chr(1), '') || array_to_string(list_transform(ts, lambda x: replace(x.t, chr(1), '')), ''))")} AS m, coalesce(list_sum(list_transform(ts, lambda x: x.n)), 0)::BIGINT AS glyph_decimal FROM g1),
repaired AS (SELECT element_id, file_path, was, replace(replace(replace(replace(replace(m, chr(1) || 'Æ', 'á'), chr(1) || 'Ø', 'é'), chr(1) || 'œ', 'ú'), chr(1) || 'æ', 'ñ'), chr(1) || 'Œ', 'Í') AS text, glyph_decimal,
(length(m) - length(replace(m, chr(1), '')))::BIGINT AS standard_encoding, len(regexp_extract_all(was, 'GLYPH<c=[0-9]+,font=[^>]*>'))::BIGINT AS unrecoverable FROM g2)"""

ORACLE: dict[str, str] = {
    "p2_found": f"""WITH s AS (SELECT nfc_normalize(path) AS k, nullif(lower(trim(hash)), '') AS h, {AT} AS tried, logged_at, state_id FROM file_state WHERE status = 'success' AND path IS NOT NULL),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY tried DESC NULLS LAST, logged_at DESC, state_id DESC) AS n FROM s) WHERE n = 1),
l AS (SELECT * FROM (SELECT nfc_normalize(path) AS k, path, nullif(lower(trim(hash)), '') AS h, row_number() OVER (PARTITION BY nfc_normalize(path) ORDER BY seen_at DESC, listing_id DESC) AS n FROM file_listing WHERE path IS NOT NULL) WHERE n = 1)
SELECT l.path FROM l LEFT JOIN t ON t.k = l.k WHERE t.k IS NULL OR (l.h IS NOT NULL AND l.h IS DISTINCT FROM t.h)""",
    "p2_stored_target": f"""WITH s AS (SELECT nfc_normalize(path) AS k, nullif(lower(trim(hash)), '') AS h, {AT} AS tried, logged_at, state_id FROM file_state WHERE status = 'success' AND path IS NOT NULL),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY tried DESC NULLS LAST, logged_at DESC, state_id DESC) AS n FROM s) WHERE n = 1),
l AS (SELECT * FROM (SELECT nfc_normalize(path) AS k, path, nullif(lower(trim(hash)), '') AS h, row_number() OVER (PARTITION BY nfc_normalize(path) ORDER BY seen_at DESC, listing_id DESC) AS n FROM file_listing WHERE path IS NOT NULL) WHERE n = 1)
SELECT l.path FROM l LEFT JOIN t ON t.k = l.k WHERE t.k IS NULL OR (l.h IS NOT NULL AND l.h IS DISTINCT FROM t.h)""",
    "p3_pages_beyond": f"SELECT f AS key_value, count(*) AS n_rows, count(*) FILTER (page > last) AS n_beyond FROM (SELECT {name('file')} AS f, page FROM citations WHERE file IS NOT NULL) JOIN (SELECT {name('file_path')} AS e, max(total_pages) AS last FROM extractions WHERE file_path IS NOT NULL GROUP BY e) ON e = f GROUP BY f",
    "p3_found": f"""SELECT 'topic' AS field, topic AS key_value FROM retrievals WHERE topic IS NOT NULL GROUP BY topic HAVING count(*) * 100 >= 4 * (SELECT count(topic) FROM retrievals)
UNION ALL SELECT 'file', f FROM (SELECT {name('file')} AS f FROM citations WHERE file IS NOT NULL) GROUP BY f HAVING count(*) * 100 >= 4 * (SELECT count(file) FROM citations)""",
    "p3_topic_results": """SELECT topic AS key_value, count(*) AS n_rows, coalesce(any_value(p), 0) AS n_pages, arg_max(retrieval_id, ts::HUGEINT * 100000000 + retrieval_id) AS last_request, max(ts) AS last_at FROM retrievals
LEFT JOIN (SELECT topic AS t, count(DISTINCT concat_ws('#', u.file_path, u.page::VARCHAR)) AS p FROM (SELECT topic, unnest(retrieved) AS u FROM retrievals) GROUP BY topic) ON t = topic WHERE topic IS NOT NULL GROUP BY topic""",
    "p3_file_results": f"SELECT f AS key_value, count(*) AS n_rows, count(DISTINCT page) AS n_pages, max(retrieval_id) AS last_request, max(retrieval_id) AS last_at FROM (SELECT {name('file')} AS f, page, retrieval_id FROM citations WHERE file IS NOT NULL) GROUP BY f",
    "text_normalize": f"SELECT row_id, lower({collapse('text')}) AS norm, sha1(lower({collapse('text')})) AS text_sha1 FROM chunks",
    "query_sanitize": f"SELECT retrieval_id, {SANITISED} AS sanitized FROM retrievals",
    "acronym_expand": f"SELECT retrieval_id, {EXPANDED} AS expanded FROM retrievals",
    "repair_counts": r"""SELECT file_path, sum(g)::BIGINT AS glyphs, sum(u)::BIGINT AS lost, sum(e)::BIGINT AS odd_letters, count(*) FILTER (g + u > 0) AS touched FROM (SELECT file_path, len(regexp_extract_all(t, 'GLYPH<[0-9]{1,7}>')) AS g, len(regexp_extract_all(t, 'GLYPH<c=[0-9]+,font=[^>]*>')) AS u,
len(regexp_extract_all(t, '[ÆØœæŒ]')) AS e FROM (SELECT file_path, coalesce(text, '') AS t FROM elements)) GROUP BY file_path""",
    "token_count": f"SELECT row_id, {tokens('text')} AS tokens FROM chunks",
    "point_ids": """SELECT row_id, left(h, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || list_extract(['8', '9', 'a', 'b'], (instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid
FROM (SELECT row_id, sha1(unhex('6f9619ff8b86d011b42d00c04fc964ff') || encode(file_path || ':' || chunk_id)) AS h FROM chunks)""",
    "page_clamp": f"SELECT row_id, CASE WHEN total_pages > 0 THEN least(greatest(coalesce(page, 1), 1), total_pages) ELSE greatest(coalesce(page, 1), 1) END AS page FROM chunks LEFT JOIN ({TOTALS}) USING (file_path)",
    "page_marker": r"""SELECT element_id, marker FROM (SELECT element_id, coalesce(CASE WHEN a BETWEEN 1 AND 10000 THEN a END, CASE WHEN b BETWEEN 1 AND 10000 THEN b END, CASE WHEN c BETWEEN 1 AND 10000 THEN c END, CASE WHEN e BETWEEN 1 AND 10000 THEN e END) AS marker
FROM (SELECT element_id, try_cast(regexp_extract(t, 'page\s+([0-9]+)', 1) AS INTEGER) AS a, try_cast(regexp_extract(t, 'página\s+([0-9]+)', 1) AS INTEGER) AS b, try_cast(regexp_extract(t, 'pág\.\s*([0-9]+)', 1) AS INTEGER) AS c,
try_cast(regexp_extract(t, '(^|[^\pL\pN_])pg\.\s*([0-9]+)', 2) AS INTEGER) AS e FROM (SELECT element_id, lower(left(text, 100)) AS t FROM elements))) WHERE marker IS NOT NULL""",
    "page_resolved": r"""SELECT element_id, coalesce(CASE WHEN page > 0 THEN page END, CASE WHEN m > 0 THEN m END, CASE WHEN a BETWEEN 1 AND 10000 THEN a END, CASE WHEN b BETWEEN 1 AND 10000 THEN b END, CASE WHEN c BETWEEN 1 AND 10000 THEN c END, CASE WHEN e BETWEEN 1 AND 10000 THEN e END, elem_no // 8 + 1) AS page
FROM (SELECT element_id, elem_no, page, try_cast(metadata['page_number'] AS INTEGER) AS m, try_cast(regexp_extract(t, 'page\s+([0-9]+)', 1) AS INTEGER) AS a, try_cast(regexp_extract(t, 'página\s+([0-9]+)', 1) AS INTEGER) AS b, try_cast(regexp_extract(t, 'pág\.\s*([0-9]+)', 1) AS INTEGER) AS c,
try_cast(regexp_extract(t, '(^|[^\pL\pN_])pg\.\s*([0-9]+)', 2) AS INTEGER) AS e FROM (SELECT *, lower(left(text, 100)) AS t FROM elements))""",
    "vector_validate": """SELECT vec_id, 64 AS dim, round(sqrt(list_sum(list_transform(u, lambda x: x * x))), 4) AS norm, round(u[1], 4) AS first, round(u[64], 4) AS last FROM (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS u
FROM (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN list_resize(embedding[1:40]::DOUBLE[], 64, 0.0) ELSE embedding::DOUBLE[] END AS v FROM embeddings))""",
    "citation_urls": f"SELECT row_id, {URL} AS url, '[' || {BASE} || ', p.' || page || '](' || {URL} || ')' AS label FROM chunks WHERE page IS NOT NULL",
    "user_hashes": "SELECT DISTINCT user_id, left(sha256('user' || user_id || '@example.org'), 12) AS user_hash FROM events",
    "heading_paths": "SELECT row_id, CASE WHEN headings IS NULL THEN NULL ELSE coalesce(array_to_string(headings, ' > '), '') END AS heading_path FROM chunks",
    "embed_inputs": "SELECT retrieval_id, 'query: ' || query AS plain, 'Instruct: Retrieve relevant documents' || chr(10) || 'Query: ' || query AS instructed, query AS bare FROM retrievals WHERE query IS NOT NULL",
    "passage_inputs": "SELECT row_id, 'passage: ' || text AS plain, text AS instructed FROM chunks WHERE text IS NOT NULL",
    "context_limits": "SELECT retrieval_id, CASE WHEN coalesce(generative, false) THEN 12000 ELSE 6000 END AS tokens FROM retrievals",
    "collection_names": "SELECT DISTINCT topic, 'rag_' || lower(topic) || '_v2' AS collection FROM retrievals WHERE topic IS NOT NULL",
    "text_repair": f"{REPAIRED} SELECT element_id, text, glyph_decimal, standard_encoding, unrecoverable FROM repaired",
    "repair_totals": f"{REPAIRED} SELECT file_path, sum(glyph_decimal)::BIGINT AS glyphs, sum(standard_encoding)::BIGINT AS letters, count(*) FILTER (text <> was) AS touched, count(*) FILTER (unrecoverable > 0) AS lost FROM repaired GROUP BY file_path",
    "structured_chunks": """WITH o AS (SELECT *, coalesce(page, 1) AS pg FROM elements QUALIFY row_number() OVER (PARTITION BY file_path, elem_no ORDER BY element_id) = 1),
t AS (SELECT *, last_value(CASE WHEN type = 'Title' THEN trim(text) END IGNORE NULLS) OVER (PARTITION BY file_path, pg ORDER BY elem_no) AS ti FROM o),
c AS (SELECT file_path, pg AS page, type, source, elem_no AS seq, CASE WHEN ti <> '' THEN ti || chr(10) ELSE '' END || trim(text) AS text FROM t WHERE type IS DISTINCT FROM 'Title' AND length(trim(text)) > 0) SELECT * FROM c WHERE length(text) >= 40""",
    "file_pages": """WITH p AS (SELECT file_path, page, count(*) AS n FROM chunks WHERE file_path IS NOT NULL GROUP BY ALL)
SELECT file_path, page, n, count(page) OVER w = 1 AS single_page, count(*) FILTER (page IS NULL) OVER w > 0 AS lacks_page FROM p WINDOW w AS (PARTITION BY file_path)""",
    "dry_run_totals": """WITH z AS (SELECT file_path FROM elements WHERE file_path IS NOT NULL GROUP BY 1 HAVING sum(CASE WHEN page <= 10 THEN coalesce(length(text), 0) ELSE 0 END) < 200),
p AS (SELECT file_path, max(total_pages) AS t FROM extractions WHERE total_pages IS NOT NULL GROUP BY 1) SELECT count(*) AS files, coalesce(sum(t), 0)::BIGINT AS pages FROM z LEFT JOIN p USING (file_path) WHERE coalesce(t, 0) <= 60""",
    "error_cut": "SELECT state_id, left(error, 12) AS short, coalesce(hash, '?') || '-' || left(sha1(status), 8) AS cache_key FROM file_state WHERE error IS NOT NULL",
    "legibility": f"SELECT element_id, round(({LEGIBLE})::DOUBLE, 4) AS legibility FROM elements WHERE text IS NOT NULL",
    "ref_split": f"SELECT item_id, {name('r')} AS file, try_cast(list_extract(string_split(r, '#'), -1) AS INTEGER) AS page FROM (SELECT item_id, unnest(relevant_pages) AS r FROM golden_cases)",
    "file_names": f"SELECT {name('file')} AS name, count(*) AS n FROM citations GROUP BY 1",
    "postings": f"SELECT topic, term, sum(tf)::BIGINT AS cf, count(*) AS df FROM (SELECT topic, row_id, term, count(*) AS tf FROM (SELECT topic, row_id, unnest({words('text')}) AS term FROM chunks WHERE text IS NOT NULL) GROUP BY ALL) GROUP BY topic, term",
    "idf_table": f"""WITH p AS (SELECT DISTINCT topic, row_id, unnest({words('text')}) AS term FROM chunks WHERE text IS NOT NULL), n AS (SELECT topic, count(DISTINCT row_id) AS n FROM p GROUP BY topic)
SELECT p.topic, term, count(*) AS df, round(ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)), 6) AS idf FROM p JOIN n USING (topic) GROUP BY p.topic, term""",
    "bm25_topk": f"WITH {bm25(ASKED, TOPK)} SELECT query_id, doc_id, score, rank FROM hits",
    "dense_topk": f"WITH {dense('a.vec_id % 50 = 0', TOPK)} SELECT query_id, doc_id, score, rank FROM close",
    "rrf_fusion": f"WITH {fused(DEPTH)} SELECT query_id, doc_id, rrf, dense_rank, bm25_rank FROM fz",
    "per_file_cap": f"WITH {fused(DEPTH)}, {FACTS}, {CAPPED} SELECT query_id, doc_id, rank FROM ct",
    "soft_trim": f"WITH {fused(DEPTH)}, {FACTS}, {CAPPED} SELECT query_id, doc_id, rank, used::BIGINT AS used FROM ct WHERE used <= {TOKENS}",
    "hybrid_topk": f"WITH {fused(DEPTH)}, {FACTS}, {CAPPED} SELECT query_id, rank, doc_id, rrf, {BASE} AS file, page, {URL} AS url FROM ct WHERE used <= {TOKENS}",
    "rerank_order": f"""WITH {bm25(ASKED, TOPK)}, s AS (SELECT h.query_id, h.doc_id, h.rank, list_distinct({words('q0.query')}) AS qw, {words('c.text')} AS tw FROM hits h JOIN q0 USING (query_id) JOIN chunks c ON c.row_id = h.doc_id),
z AS (SELECT query_id, doc_id, rank, round(len(list_intersect(qw, tw)) / greatest(len(qw), 1), 6) AS rerank_score FROM s)
SELECT query_id, doc_id, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank) AS rerank FROM z""",
    "strategy_route": f"SELECT retrieval_id, CASE WHEN {QTOKENS} < {THRESHOLD} THEN 'lexical' ELSE 'hybrid' END AS strategy, coalesce(final_topk, CASE WHEN coalesce(generative, false) THEN {TOPK * FACTOR} ELSE {TOPK} END) AS depth FROM retrievals",
    "context_build": f"""WITH {bm25(ASKED, 3)}, x AS (SELECT query_id, rank, coalesce(text, '') || chr(10) || chr(10) || 'FUENTE:' || chr(10) || '[' || {BASE} || ', p.' || page || '](' || {URL} || ')' AS b FROM hits JOIN chunks ON row_id = doc_id WHERE page IS NOT NULL),
y AS (SELECT query_id, string_agg(b, chr(10) || chr(10) ORDER BY rank) AS c FROM x GROUP BY query_id) SELECT query_id, length(c) AS chars, sha1(c) AS context_sha1 FROM y""",
    "citation_list": f"WITH {bm25(ASKED, 3)} SELECT query_id, rank, {BASE} AS file, page, chunk_id::VARCHAR AS chunk_id, {URL} AS url FROM hits JOIN chunks ON row_id = doc_id WHERE page IS NOT NULL",
    "citation_parse": f"WITH {bm25(ASKED, 3)} SELECT query_id, {BASE} AS file, count(*) AS n FROM hits JOIN chunks ON row_id = doc_id WHERE page IS NOT NULL GROUP BY ALL",
    "extract_chain": """WITH e AS (SELECT file_path, page, coalesce(length(text), 0) AS n, CASE WHEN source IN ('docling_gpu', 'docling_cpu', 'docling') THEN 'docling' WHEN source IN ('pypdf', 'pdfplumber') THEN 'text' WHEN source = 'docling_vlm' THEN 'vlm' WHEN source IN ('easyocr', 'tesseract') THEN 'ocr' WHEN source = 'unstructured' THEN 'unstructured' END AS extractor FROM elements),
s AS (SELECT file_path, extractor, sum(n)::BIGINT AS chars, count(DISTINCT page) AS pages FROM e WHERE extractor IS NOT NULL GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY list_position(['docling', 'text', 'vlm', 'ocr', 'unstructured'], extractor)) AS r FROM s WHERE CASE WHEN extractor = 'unstructured' THEN chars >= 10 ELSE chars >= 500 AND chars / greatest(pages, 1) >= 80 END)
SELECT file_path, extractor, chars, pages FROM k WHERE r = 1""",
    "text_layer_probe": "SELECT file_path, coalesce(sum(CASE WHEN page <= 5 THEN length(trim(text)) END), 0)::BIGINT AS chars, coalesce(sum(CASE WHEN page <= 5 THEN length(trim(text)) END), 0) >= 100 AS has_text FROM elements GROUP BY file_path",
    "boilerplate_lines": f"WITH {BOILER} SELECT file_path, line, pages FROM b",
    "boilerplate_strip": f"""WITH {BOILER}, dr AS (SELECT file_path, list(line) AS dl FROM b GROUP BY file_path)
SELECT element_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT coalesce(list_contains(dl, lower({collapse('x')})), false)), chr(10)) AS text FROM elements LEFT JOIN dr USING (file_path)""",
    "hard_split": f"""SELECT doc_id, k AS piece_no, array_to_string(w[k * 48 + 1 : k * 48 + 48], ' ') AS piece FROM (SELECT doc_id, w, unnest(range(0, (len(w) - 1) // 48 + 1)) AS k FROM (SELECT doc_id, string_split({collapse('text')}, ' ') AS w FROM documents WHERE {collapse('text')} <> ''))""",
    "chunk_dedupe": f"SELECT row_id, file_path FROM (SELECT row_id, file_path, row_number() OVER (PARTITION BY file_path, sha1(lower({collapse('text')})) ORDER BY chunk_id NULLS FIRST, row_id) AS k FROM chunks WHERE text IS NOT NULL) WHERE k = 1",
    "upsert_merge": """WITH a AS (SELECT *, indexed_at >= TIMESTAMP '2025-10-01' AS late FROM chunks WHERE indexed_at IS NOT NULL), b AS (SELECT point_id, row_id, file_path, chunk_id, late, row_number() OVER (PARTITION BY point_id, late ORDER BY indexed_at DESC, row_id DESC) AS k FROM a)
SELECT point_id, row_id, file_path, chunk_id FROM b x WHERE k = 1 AND (late OR NOT EXISTS (SELECT 1 FROM b y WHERE y.late AND y.point_id = x.point_id))""",
    "replace_file": "SELECT row_id, file_path, chunk_id FROM chunks x WHERE indexed_at >= TIMESTAMP '2025-10-01' OR (indexed_at < TIMESTAMP '2025-10-01' AND NOT EXISTS (SELECT 1 FROM chunks y WHERE y.indexed_at >= TIMESTAMP '2025-10-01' AND y.file_path = x.file_path))",
    "delete_by_file": "SELECT topic, count(*) AS points FROM chunks WHERE file_path IS DISTINCT FROM (SELECT file_path FROM chunks WHERE file_path IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) GROUP BY topic",
    "reconcile": "SELECT path, 'missing' AS side FROM (SELECT path FROM file_state WHERE path IS NOT NULL EXCEPT SELECT path FROM file_listing) UNION ALL SELECT path, 'new' FROM (SELECT path FROM file_listing WHERE path IS NOT NULL EXCEPT SELECT path FROM file_state)",
    "chunk_totals": f"SELECT file_path, sum(coalesce(length(text), 0))::BIGINT AS chars, sum({tokens('text')})::BIGINT AS tokens, count(DISTINCT page) AS pages, round(sum(coalesce(length(text), 0)) / greatest(count(DISTINCT page), 1), 4) AS chars_per_page FROM elements GROUP BY file_path",
    "incremental_scan": f"""WITH {CURRENT}, li AS (SELECT * FROM (SELECT path, lower(trim(hash)) AS h, row_number() OVER (PARTITION BY path ORDER BY seen_at DESC, listing_id DESC) AS k FROM file_listing) WHERE k = 1)
SELECT li.path, CASE WHEN cur.path IS NULL THEN 'process' WHEN status = 'failed' AND retries < 3 THEN 'retry' WHEN status = 'failed' THEN 'quarantine' WHEN status = 'processing' THEN 'retry' WHEN h IS NOT NULL AND h <> coalesce(lower(trim(cur.hash)), '') THEN 'changed' ELSE 'skip' END AS decision FROM li LEFT JOIN cur USING (path)""",
    "ordered_pages": f"WITH {GOLDEN_RUN} SELECT query_id, file, page, row_number() OVER (PARTITION BY query_id ORDER BY min(rank), file, page NULLS FIRST) AS rank FROM run GROUP BY query_id, file, page",
    "alias_map": "SELECT 'doc-' || doc_id AS file, min('doc-' || doc_id) OVER (PARTITION BY md5(text)) AS canonical FROM documents WHERE text IS NOT NULL QUALIFY count(*) OVER (PARTITION BY md5(text)) > 1",
    "page_match": f"WITH {GOLDEN_RUN}, {ALIAS}, {TRUTH}, {PREDICTED}, {MATCH} SELECT query_id, rank FROM pm",
    "recall_at_k": f"{EVAL} SELECT item_id, " + ", ".join(f"({hit(k)})::DOUBLE AS hit_at_{k}" for k in (1, 3, 5, 10)) + " FROM sr",
    "mrr": f"{EVAL} SELECT item_id, round(coalesce(1.0::DOUBLE / f, 0), 6) AS rr FROM sr",
    "eval_aggregate": f"{EVAL} {BY_TOPIC}",
    "eval_files": f"""WITH {GOLDEN_RUN}, {ALIAS}, {TRUTH}, pc AS (SELECT query_id, coalesce(canonical, run.file) AS file, min(rank) AS r FROM run LEFT JOIN al ON al.file = run.file GROUP BY 1, 2),
pr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY r, file) AS rank FROM pc), h AS (SELECT query_id, min(rank) AS f FROM pr WHERE EXISTS (SELECT 1 FROM trc t WHERE t.query_id = pr.query_id AND t.file = pr.file) GROUP BY query_id)
SELECT {fam((1, 3, 5))} FROM golden_cases LEFT JOIN h ON h.query_id = item_id""",
    "eval_warnings": f"WITH {GOLDEN_RUN}, {ALIAS}, {TRUTH} SELECT DISTINCT file FROM trc WHERE file NOT IN (SELECT coalesce(canonical, run.file) FROM run LEFT JOIN al ON al.file = run.file)",
    "weighted_mrr": f"{EVAL}, bt AS ({BY_TOPIC}) SELECT coalesce(topic, 'total') AS label, round(sum(mrr * n) / sum(n), 4) AS mrr FROM bt WHERE topic <> 'Laboratorio' GROUP BY GROUPING SETS ((topic), ())",
    "run_compare": f"""{EVAL}, bt AS ({BY_TOPIC}), s3 AS (SELECT g.topic, m.f FROM golden_cases g LEFT JOIN (SELECT query_id, min(rank) AS f FROM pm WHERE rank <= 3 GROUP BY ALL) m ON m.query_id = g.item_id), b3 AS (SELECT topic, round(avg(coalesce(1.0::DOUBLE / f, 0)), 4) AS mrr FROM s3 GROUP BY topic)
SELECT coalesce(b3.topic, bt.topic) AS topic, b3.mrr AS mrr_a, bt.mrr AS mrr_b, round(bt.mrr - b3.mrr, 4) AS delta, CASE WHEN b3.topic IS NULL THEN 'only_b' WHEN bt.topic IS NULL THEN 'only_a' ELSE 'both' END AS state FROM b3 FULL JOIN bt ON b3.topic = bt.topic""",
    "extractor_mix": "SELECT coalesce(source, '?') AS source, count(*) AS points, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM chunks), 4) AS pct FROM chunks GROUP BY 1",
    "missing_extractor_files": "SELECT file_path, count(*) AS points FROM chunks WHERE file_path IS NOT NULL GROUP BY 1 HAVING count(*) FILTER (source = 'docling') = 0",
    "reingest_targets": """SELECT file_path, count(*) AS points FROM chunks WHERE file_path IN (SELECT path FROM file_state WHERE status = 'success' AND topic IN ('Algoritmia', 'Laboratorio')) AND file_path NOT IN (SELECT path FROM file_state WHERE coalesce(retry_count, 0) >= 3 AND path IS NOT NULL)
GROUP BY 1 HAVING count(*) FILTER (source = 'docling') = 0""",
    "file_diversity": "SELECT retrieval_id, count(DISTINCT file) AS files, CASE WHEN count(DISTINCT file) = 1 THEN 'critical' WHEN count(DISTINCT file) < 3 THEN 'warning' ELSE 'ok' END AS verdict FROM citations WHERE file IS NOT NULL GROUP BY retrieval_id",
    "points_per_file": "SELECT file_path, count(*) AS points, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM chunks WHERE file_path IS NOT NULL), 4) AS pct FROM chunks WHERE file_path IS NOT NULL GROUP BY 1 ORDER BY points DESC, 1 LIMIT 5",
    "page_diagnostics": """WITH p AS (SELECT file_path, page, count(*) AS n FROM chunks WHERE file_path IS NOT NULL GROUP BY ALL) SELECT file_path, count(page) AS pages, min(page) AS low, max(page) AS high, sum(CASE WHEN page <= 0 THEN n ELSE 0 END)::BIGINT AS bad, sum(CASE WHEN page > 2000 THEN n ELSE 0 END)::BIGINT AS far,
sum(CASE WHEN n > 100 THEN 1 ELSE 0 END)::BIGINT AS crowded, max(CASE WHEN page IS NOT NULL THEN n END) AS fullest FROM p GROUP BY file_path""",
    "page_gaps": "SELECT file_path, p AS page_from, page AS page_to FROM (SELECT file_path, page, lag(page) OVER (PARTITION BY file_path ORDER BY page) AS p FROM (SELECT DISTINCT file_path, page FROM chunks WHERE page > 0)) WHERE page - p > 10",
    "page_sequence_issues": f"""WITH r AS (SELECT file_path, page, total_pages, lag(page) OVER (PARTITION BY file_path ORDER BY chunk_id NULLS FIRST, row_id) AS prev FROM chunks LEFT JOIN ({TOTALS}) USING (file_path)),
k AS (SELECT file_path, 'invalid' AS kind FROM r WHERE page IS NULL OR page < 1 OR page > 50000 UNION ALL SELECT file_path, 'overflow' FROM r WHERE page > total_pages UNION ALL SELECT file_path, 'out_of_order' FROM r WHERE page < prev) SELECT file_path, kind, count(*) AS n FROM k GROUP BY ALL""",
    "contiguous_runs": "SELECT file_path, min(page) AS first_page, max(page) AS last_page FROM (SELECT file_path, page, page - row_number() OVER (PARTITION BY file_path ORDER BY page) AS g FROM (SELECT DISTINCT file_path, page FROM elements WHERE page > 0)) GROUP BY file_path, g",
    "page_by_height": f"WITH {GEOM} SELECT element_id, spot.page, coalesce(en.page, l.m) AS placed FROM spot LEFT JOIN en ON en.file_path = spot.file_path AND spot.y >= en.s AND spot.y < en.e JOIN (SELECT file_path, max(page) AS m FROM en GROUP BY ALL) l ON l.file_path = spot.file_path",
    "legibility_by_source": f"SELECT coalesce(source, '?') AS source, count(*) AS n, round(avg(({LEGIBLE})::DOUBLE), 4) AS legibility FROM elements WHERE length(text) > 0 GROUP BY 1",
    "reader_comparison": f"""SELECT reader, count(*) AS elements, count(*) FILTER (length(text) >= 50) AS covered, sum(length(text))::BIGINT AS chars, round(avg(({LEGIBLE})::DOUBLE), 4) AS legibility
FROM (SELECT CASE WHEN source = 'docling_vlm' THEN 'vlm' WHEN source IN ('easyocr', 'tesseract') THEN 'ocr' END AS reader, coalesce(text, '') AS text FROM elements) WHERE reader IS NOT NULL GROUP BY reader""",
    "topic_stats": "SELECT topic, count(*) AS points, count(DISTINCT file_path) AS files, count(*) FILTER (coalesce(trim(text), '') = '') AS empty FROM chunks GROUP BY topic",
    "latency_summary": "SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 4) AS median, round(avg(value), 4) AS mean, max(value) AS max FROM events WHERE value IS NOT NULL GROUP BY 1",
    "short_queries": f"SELECT topic, count(*) AS n, count(*) FILTER (t < 4) AS short, round(quantile_cont(t::DOUBLE, 0.5), 4) AS median_tokens FROM (SELECT topic, {QTOKENS} AS t FROM retrievals WHERE query IS NOT NULL) GROUP BY topic",
    "seeded_sample": "SELECT path FROM (SELECT DISTINCT path FROM file_listing WHERE path IS NOT NULL) ORDER BY md5('7' || path), path LIMIT 20",
    "middle_page": "SELECT file_path, page FROM (SELECT file_path, page, row_number() OVER (PARTITION BY file_path ORDER BY page) - 1 AS i, count(*) OVER (PARTITION BY file_path) AS n FROM (SELECT DISTINCT file_path, page FROM chunks WHERE page > 0)) WHERE i = n // 2",
    "arm_summary": f"""WITH r AS (SELECT *, {ARM} AS arm, coalesce(len(retrieved), 0) AS c, coalesce(len(list_distinct(list_transform(retrieved, lambda x: x.file_path))), 0) AS fs FROM retrievals)
SELECT arm, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, count(*) FILTER (c = 0) AS empty, count(generative) AS generative_known, count(*) FILTER (generative) AS generative_true, round(avg(CASE WHEN c > 0 THEN c END), 4) AS mean_chunks, round(avg(CASE WHEN c > 0 THEN fs END), 4) AS mean_files,
count(*) FILTER (translated_query IS NOT NULL AND translated_query <> query) AS translated, count(*) FILTER (coalesce(original_language, 'en') <> 'en') AS "foreign", round(100.0::DOUBLE * count(*) FILTER (c = 0) / count(*), 2) AS empty_pct, CASE WHEN count(generative) > 0 THEN round(100.0::DOUBLE * count(*) FILTER (generative) / count(generative), 2) END AS generative_pct FROM r GROUP BY arm""",
    "arm_topic_counts": f"SELECT {ARM} AS arm, topic, count(*) AS n FROM retrievals GROUP BY ALL",
    "arm_mode_counts": f"SELECT {ARM} AS arm, mode, count(*) AS n FROM retrievals GROUP BY ALL",
    "dormant_arms": "SELECT arm, days FROM (SELECT user_id::VARCHAR AS arm, floor((epoch_us((SELECT max(ts) FROM events)) - epoch_us(max(ts))) / 86400000000)::BIGINT AS days FROM events GROUP BY user_id) WHERE days >= 1",
    "since_filter": "SELECT retrieval_id, ts FROM retrievals WHERE coalesce(ts, 1760000000000) >= 1760000000000",
    "monthly_retention": "SELECT strftime(logged_at, '%Y-%m') AS month, count(*) AS n, date_diff('day', max(logged_at)::DATE, DATE '2025-11-15') <= 31 AS keep FROM retrievals WHERE logged_at IS NOT NULL GROUP BY 1",
    "scan_counters": f"""WITH {CURRENT}, li AS (SELECT * FROM (SELECT path, lower(trim(hash)) AS h, row_number() OVER (PARTITION BY path ORDER BY seen_at DESC, listing_id DESC) AS k FROM file_listing) WHERE k = 1),
x AS (SELECT status = 'failed' AND retries >= 3 AS bad, cur.path IS NULL OR status IN ('failed', 'processing') OR (h IS NOT NULL AND h <> coalesce(lower(trim(cur.hash)), '')) AS due FROM li LEFT JOIN cur USING (path))
SELECT count(*) FILTER (due AND NOT coalesce(bad, false)) AS processed, count(*) FILTER (NOT due) AS skipped, count(*) FILTER (bad) AS errors FROM x""",
    "reset_failed": f"WITH {CURRENT} SELECT path, 0 AS retries, retries > 0 AS was_reset FROM cur",
    "remove_topic": f"WITH {CURRENT} SELECT path, status FROM cur WHERE NOT coalesce(CASE status WHEN 'success' THEN topic = 'Algoritmia' WHEN 'failed' THEN contains(path, 'topics/Algoritmia') ELSE false END, false)",
    "quarantine": f"WITH {CURRENT} SELECT path, retries, retries >= 3 AS quarantined FROM cur WHERE status = 'failed'",
    "latest_state": f"WITH {CURRENT} SELECT path, status, hash, retries FROM cur",
    "interruptions": "SELECT path, count(*) FILTER (lower(coalesce(error, '')) LIKE '%interrump%') AS interruptions, count(*) FILTER (NOT lower(coalesce(error, '')) LIKE '%interrump%') AS other_failures FROM file_state WHERE status = 'failed' AND path IS NOT NULL GROUP BY path",
    "hard_death": f"WITH {CURRENT} SELECT path, state_id FROM la WHERE status = 'processing'",
    "kill_attribution": """WITH m AS (SELECT state_id AS marker_id, list_extract(string_split(path, '/'), -1) AS b FROM file_state WHERE lower(error) LIKE '%interrump%'), p AS (SELECT DISTINCT path, list_extract(string_split(path, '/'), -1) AS b FROM file_state), w AS (SELECT DISTINCT marker_id, unnest(regexp_split_to_array('extract ' || b || ' page 3', '[\\s/]+')) AS w FROM m)
SELECT marker_id, min(path) AS path FROM w JOIN p ON p.b = w.w GROUP BY marker_id""",
    "state_stats": f"WITH {CURRENT} SELECT topic, count(*) AS total, count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'failed') AS failed FROM cur GROUP BY topic",
    "unknown_topics": "SELECT topic, count(*) AS n FROM retrievals WHERE topic IS NOT NULL AND topic NOT IN (SELECT topic FROM chunks WHERE topic IS NOT NULL) GROUP BY topic",
    "last_user_message": "SELECT topic, retrieval_id, query FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY ts DESC, retrieval_id DESC) AS k FROM retrievals WHERE ts IS NOT NULL AND topic IS NOT NULL AND trim(query) <> '') WHERE k = 1",
    "topic_resolve": f"SELECT DISTINCT topic, coalesce({MAPPED}[topic], {MAPPED}[regexp_replace({PER_REQUEST}, '[ \\t\\-–—]+$', '')], nullif(regexp_replace({PER_REQUEST}, '[ \\t\\-–—]+$', ''), ''), 'General') AS resolved FROM retrievals WHERE topic IS NOT NULL",
    "generative_flag": "SELECT retrieval_id, " + " OR ".join(f"contains(lower(coalesce(query, '')), '{m}')" for m in MARKERS) + " AS is_generative FROM retrievals",
    "request_dedupe": "SELECT min(retrieval_id) AS retrieval_id FROM retrievals GROUP BY ts, query, topic, mode",
    "telemetry_tail": "SELECT retrieval_id, ts, topic FROM retrievals WHERE ts IS NOT NULL ORDER BY ts DESC, retrieval_id DESC LIMIT 50",
    "stale_gaps": "SELECT user_id, count(*) AS gaps, round(max(g), 3) AS longest FROM (SELECT user_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1000000 AS g FROM events) WHERE g > 43200 GROUP BY user_id",
    "scanned_sieve": "SELECT file_path, sum(CASE WHEN page <= 10 THEN coalesce(length(text), 0) ELSE 0 END)::BIGINT AS chars, sum(CASE WHEN page <= 10 THEN coalesce(length(text), 0) ELSE 0 END) < 200 AS scanned FROM elements WHERE file_path IS NOT NULL GROUP BY 1",
    "table_shapes": """SELECT element_id, len(l) AS lines, list_max(list_transform(l, lambda x: len(string_split(x, chr(9))))) AS columns, len(list_filter(flatten(list_transform(l, lambda x: string_split(x, chr(9)))), lambda c: c = '')) AS empty_cells
FROM (SELECT element_id, string_split(text, chr(10)) AS l FROM elements WHERE type = 'Table' AND text IS NOT NULL)""",
    "citation_integrity": f"""WITH c AS (SELECT {name('file')} AS f, try_cast(chunk_id AS INTEGER) AS k, page FROM citations WHERE file IS NOT NULL), s AS (SELECT {name('file_path')} AS f, chunk_id AS k, list(page) AS pages FROM chunks WHERE file_path IS NOT NULL GROUP BY ALL)
SELECT CASE WHEN s.f IS NULL THEN 'missing' WHEN list_contains(pages, page) THEN 'same_page' ELSE 'other_page' END AS state, count(*) AS n FROM c LEFT JOIN s ON s.f = c.f AND s.k = c.k GROUP BY 1""",
    "short_golden": "SELECT item_id, array_to_string(string_split(trim(regexp_replace(query, '\\s+', ' ', 'g')), ' ')[1:3], ' ') AS query, query AS long_query, len(relevant_pages) AS n_pages FROM golden_cases WHERE query IS NOT NULL",
    "truth_union": """SELECT item_id, string_agg(f, '|' ORDER BY p) AS files FROM (SELECT item_id, f, min(p) AS p FROM (SELECT item_id, unnest(v) AS f, generate_subscripts(v, 1) AS p FROM (SELECT item_id, list_concat(coalesce(relevant_files, []), list_transform(relevant_pages, lambda r: split_part(r, '#', 1))) AS v FROM golden_cases)) GROUP BY ALL) GROUP BY item_id""",
    "missing_collections": "SELECT topic, count(*) AS requests, topic NOT IN (SELECT topic FROM chunks WHERE topic IS NOT NULL) AS missing_collection FROM retrievals WHERE topic IS NOT NULL GROUP BY topic",
    "ocr_retries": "SELECT file_path FROM extractions WHERE file_path IS NOT NULL GROUP BY 1 HAVING count(*) FILTER (extractor = 'ocr') = 0 AND file_path NOT IN (SELECT file_path FROM chunks WHERE file_path IS NOT NULL)",
    "result_counts": f"WITH {fused(DEPTH)} SELECT query_id, count(dense_rank) AS dense, count(bm25_rank) AS lexical, count(*) AS merged, count(DISTINCT file_path) AS files FROM fz JOIN chunks ON row_id = doc_id GROUP BY query_id",
}
