"""Repair of text, and chunk building from elements."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import analytics as A
from corpusloom.operators import ingest as G
from corpusloom.operators import telemetry as T

CASES = [
    ("MaGLYPH<237>z GLYPH<151> fin", "Maíz — fin", 2, 0, 0), ("GLYPH<7>aGLYPH<127>bGLYPH<129>c", "abc", 3, 0, 0), ("GLYPH<55296> GLYPH<1114112>", "GLYPH<55296> GLYPH<1114112>", 0, 0, 0),
    ("GLYPH<128578>", "🙂", 1, 0, 0), ("MÆs gØrmenes Nœmero Espaæol RODRŒGUEZ", "Más gérmenes Número Español RODRÍGUEZ", 0, 5, 0), ("Ø 90 mm, Æ-12", "Ø 90 mm, Æ-12", 0, 0, 0),
    ("ÆØa œŒ œØ", "áéa œŒ úØ", 0, 3, 0), ("mGLYPH<198>s", "más", 1, 1, 0), ("aGLYPH<c=56,font=/A+B>b", "aGLYPH<c=56,font=/A+B>b", 0, 0, 1), ("", "", 0, 0, 0), (None, None, 0, 0, 0),
]


def test_repaired(spark):
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, text string")
    got = [tuple(r.r) for r in rows.orderBy("i").select(X.repaired(F.col("text")).alias("r")).collect()]
    assert got == [c[1:] for c in CASES]


words = st.integers(0, 30).map(lambda n: "palabra " * n)


@given(st.lists(words, max_size=12), st.integers(5, 40))
@settings(max_examples=80, deadline=None)
def test_packing_keeps_order_and_budget(texts, budget):
    rows = [(1, "Text", f"s{i}", t) for i, t in enumerate(texts)]
    out = G.pack_page(rows, budget, 1)
    assert "".join(" ".join(t[3].split()) for t in out).replace(" ", "") == "".join(texts).replace(" ", "")
    for (_, _, source, text), following in zip(out, [*out[1:], None]):
        parts = text.split("\n\n")
        cost = sum(max(1, len(p) // 4) for p in parts)
        assert cost <= budget or len(parts) == 1
        if following and len(parts) > 1:
            assert cost + max(1, len(following[3].split("\n\n")[0]) // 4) > budget or len(following[3]) // 4 <= budget


def test_packing_of_known_elements():
    long = "Una frase corta. " * 30
    got = G.pack_page([(1, "A", "x", "uno" * 10), (1, "B", "y", "dos" * 10), (1, "C", "z", long), (1, "D", "w", None), (1, "E", "v", "tres" * 10)], 20, 5)
    assert [g[:3] for g in got[:1]] == [(1, "A", "x")] and got[0][3] == "uno" * 10 + "\n\n" + "dos" * 10
    assert got[-1] == (1, "E", "v", "tres" * 10) and all(g[1] == "C" and len(g[3]) // 4 <= 20 for g in got[1:-1]) and len(got) > 4


def test_build_chunks(spark):
    body = "El régimen del motor se mantiene durante toda la prueba del banco."
    e = [
        (1, "s.pdf", 0, "Capítulo", "Title", 1, "docling"), (2, "s.pdf", 1, body, "Text", 1, "docling"), (3, "s.pdf", 2, body.upper(), "Text", 1, "docling"), (4, "s.pdf", 3, "a\tb", "Table", 1, "docling"),
        (5, "p.pdf", 0, "MØtodo: " + body, "Text", None, "pypdf"), (6, "p.pdf", 1, "Método: " + body + " GLYPH<151> fin de la primera parte del curso", "Text", 2, "pypdf"), (7, "p.pdf", 1, "otra", "Text", 2, "pypdf"),
        (8, "p.pdf", 2, "método:  " + body, "Text", 3, "pypdf"), (9, None, 0, body, "Text", 1, "pypdf"), (10, "n.pdf", 0, None, "Text", 1, None),
    ]
    elements = spark.createDataFrame(e, "element_id long, file_path string, elem_no int, text string, type string, page int, source string")
    extractions = spark.createDataFrame([("s.pdf", True), ("n.pdf", True), ("p.pdf", None)], "file_path string, has_structure boolean")
    got = sorted((r.file_path, r.page, r.text) for r in G.build_chunks(elements, extractions).collect())
    # Of the two on p.pdf that are equal once repaired, the first stays.
    assert got == [("p.pdf", 1, "Método: " + body), ("p.pdf", 2, "Método: " + body + " — fin de la primera parte del curso"), ("s.pdf", 1, f"Capítulo\n{body}")]
    assert G.build_chunks(elements.limit(0), extractions.limit(0)).count() == 0


def test_fixed_pages(spark):
    rows = [("a", i, i, p) for i, p in enumerate([None, 3, 0, 60, 61, 7, 900, None])] + [("b", 100, 0, 5), ("b", 101, 1, 99), (None, 200, 0, None)]
    df = spark.createDataFrame(rows, "file_path string, row_id long, chunk_id int, page int")
    totals = spark.createDataFrame([("a", 500), ("b", 0)], "file_path string, total_pages int")
    got = {r.row_id: r.fixed for r in A.fixed_pages(df, totals).collect()}
    assert got == {0: 1, 1: 3, 2: 3, 3: 4, 4: 5, 5: 7, 6: 8, 7: 9, 100: 5, 101: 6, 200: 1}


@pytest.mark.parametrize("model, query, passage", [("multilingual-e5-base", "query: q", "passage: q"), ("E5-large-INSTRUCT", "Instruct: Retrieve relevant documents\nQuery: q", "q"), ("gte", "q", "q")])
def test_prefixes(spark, model, query, passage):
    r = spark.range(1).select(X.embed_query(F.lit("q"), F.lit(model)).alias("q"), X.embed_passage(F.lit("q"), F.lit(model)).alias("p")).first()
    assert (r.q, r.p) == (query, passage)


def test_state_commands(spark):
    s = spark.createDataFrame([("topics/T/a", "success", "T", 0), ("topics/T/b", "failed", None, 2), ("topics/U/c", "success", "U", 1), ("topics/T/d", "processing", "T", 0), (None, "failed", "T", None)], "path string, status string, topic string, retries int")
    assert {r.path for r in T.remove_topic(s, "T", "topics").collect()} == {"topics/U/c", "topics/T/d", None}
    assert {r.path for r in T.remove_file(s, "topics/T/a").collect()} == {"topics/T/b", "topics/U/c", "topics/T/d", None}
    got = T.reset_failed(s).collect()
    assert sum(r.was_reset for r in got) == 2 and all(r.retries == 0 for r in got)
    begun = spark.createDataFrame([("topics/T/a", "x", 1), ("topics/T/d", "old", 1), ("topics/T/d", "new", 2), ("gone", None, 1), (None, "y", 1)], "path string, context string, at int")
    assert sorted(tuple(r) for r in T.consume_inflight(begun, s).collect()) == [("gone", None, True), ("topics/T/a", "x", False), ("topics/T/d", "new", True)]
