"""Operators that SQL doesn't express, and cases the tables don't hold."""

import unicodedata
import urllib.parse
import uuid

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.functions.unicode import file_key
from corpusloom.operators import analytics as A
from corpusloom.operators import evaluation as E
from corpusloom.operators import ingest as G
from corpusloom.operators import search as S
from corpusloom.operators import telemetry as T


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize("query, want", [("a#b  c", "a b c"), ("x", ""), ("", ""), (None, None), ("  motor [1] ", "motor 1"), ("z" * 300, "z" * 200)])
def test_sanitised_query(spark, query, want):
    assert one(spark, query, X.sanitised_query) == want


@pytest.mark.parametrize("query, added", [("qué dice el REBT", 1), ("rebt y rite", 2), ("ITC-BT-44", 0), ("PREBT", 0), ("ITC-BT", 1), ("", 0), (None, 0), ("REBT rebt", 1)])
def test_acronyms(spark, query, added):
    got = one(spark, query, X.expanded_acronyms)
    assert got == query if not added else got.startswith(query + " ") and sum(x in got for x in X.ACRONYMS.values()) == added


@pytest.mark.parametrize("path, n", [("topics/A/x.pdf", 0), ("ñ/á.pdf", 12), ("", 3)])
def test_point_id_is_uuid5(spark, path, n):
    df = spark.createDataFrame([(path, n)], "p string, n int").select(X.point_id(F.col("p"), F.col("n")).alias("u"))
    assert df.first().u == str(uuid.uuid5(uuid.UUID(X.POINT_NAMESPACE), f"{path}:{n}"))


@given(st.text(alphabet=st.characters(blacklist_categories=("Cs",), blacklist_characters="/"), min_size=1, max_size=12))
@settings(max_examples=15, deadline=None)
def test_quoted_is_percent_encoding(spark, name):
    assert one(spark, name, X.quoted) == urllib.parse.quote(name, safe=".")


@pytest.mark.parametrize("page, total, want", [(None, 5, 1), (0, 5, 1), (9, 5, 5), (3, None, 3), (-2, 0, 1), (7, 0, 7)])
def test_clamped_page(spark, page, total, want):
    assert spark.createDataFrame([(page, total)], "p int, t int").select(X.clamped_page(F.col("p"), F.col("t")).alias("r")).first().r == want


@pytest.mark.parametrize("text, want", [("Page 12 of", 12), ("página 3", 3), ("PÁG. 4", 4), ("pg. 8", 8), ("page 0", None), ("x" * 100 + "page 5", None), ("", None), (None, None), ("page 99999999999", None)])
def test_page_marker(spark, text, want):
    assert one(spark, text, X.page_marker) == want


def test_file_key_spellings(spark):
    assert one(spark, " a/b/" + unicodedata.normalize("NFD", "guía.pdf") + " #page=2", file_key) == "guía.pdf"
    assert one(spark, None, file_key) is None


hits = st.lists(st.tuples(st.sampled_from("abc"), st.integers(0, 40)), max_size=12)


@given(hits, st.integers(0, 3), st.integers(0, 6))
@settings(max_examples=20, deadline=None)
def test_per_file_cap(spark, rows, per_file, k):
    df = spark.createDataFrame([(1, f, s, i) for i, (f, s) in enumerate(rows)], "query_id int, file string, score int, doc_id int")
    got = [r.doc_id for r in S.per_file_cap(df, "file", [F.desc("score"), F.asc("doc_id")], per_file, k).orderBy("rank").collect()]
    want, seen = [], {}
    for i, (f, _) in sorted(enumerate(rows), key=lambda x: (-x[1][1], x[0])):
        if not per_file or seen.get(f, 0) < per_file:
            seen[f] = seen.get(f, 0) + 1
            want.append(i)
    assert got == (want[:k] if k else want)


def test_soft_trim_stops_at_first_overflow(spark):
    df = spark.createDataFrame([(1, 1, 5), (1, 2, 9), (1, 3, 1), (2, 1, 99)], "query_id int, rank int, tokens int")
    assert [(r.query_id, r.rank) for r in S.soft_trim(df, "tokens", 10).collect()] == [(1, 1)]


def test_dense_passes_over_bad_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, None), (3, [1.0]), (4, [0.0, 0.0]), (5, [2.0, 0.0])], "vec_id long, embedding array<double>")
    got = [(r.doc_id, r.score) for r in S.dense(df, df.where("vec_id = 0"), 3).orderBy("rank").collect()]
    assert got == [(5, 1.0), (1, 0.707107), (4, 0.0)]
    assert S.dense(df, df.limit(0), 3).count() == 0


def test_token_chunks_keep_to_pages_and_budget(spark):
    rows = [(i, "f", i, "Una frase corta que se repite. " * 30 if i % 4 == 0 else f"Elemento número {i} con bastante texto para contar.", "Text", 1 + i // 5, "x") for i in range(20)]
    rows += [(20, "f", 20, "palabra " * 4000, "Text", None, "x"), (21, "f", 0, "otra vez", "Text", 1, "x"), (22, "g", 0, None, "Text", 1, "x")]
    df = spark.createDataFrame(rows, "element_id long, file_path string, elem_no int, text string, type string, page int, source string")
    got = G.numbered(G.token_chunks(df, 64, 10)).collect()
    assert all(len(r.text) // 4 <= 64 or " " not in r.text or len(r.text.split()) <= 48 for r in got)
    assert sorted(r.chunk_id for r in got) == list(range(len(got)))
    assert sum(r.text.count("palabra") for r in got) == 4000
    assert not any("otra vez" in r.text for r in got)  # delivered twice: the first one counts
    assert G.token_chunks(df.limit(0)).count() == 0


def test_fixed_pages_is_the_fold(spark):
    pages = [1, 30, 31, 60, None, -4, 70000, 61, 5]
    df = spark.createDataFrame([(i, "f", i, p) for i, p in enumerate(pages)], "row_id long, file_path string, chunk_id int, page int")
    totals = spark.createDataFrame([("f", 61)], "file_path string, total_pages int")
    got = [r.fixed for r in A.fixed_pages(df, totals).orderBy("row_id").collect()]
    valid, out = 1, []
    for p in pages:
        valid = p if p is not None and 1 <= p <= 50000 else valid
        out.append(min(valid, 61))
    for i in range(1, len(out)):
        out[i] = out[i - 1] + 1 if out[i] - out[i - 1] > 20 else out[i]
    assert got == out


def test_crash_counter_fold(spark):
    log = [("p", s, e) for s, e in [("processing", None), ("failed", "otro"), ("processing", None), ("processing", None), ("failed", "Interrumpido"), ("success", None), ("processing", None), ("failed", "x"), ("failed", "x")]]
    df = spark.createDataFrame([(i, p, s, None, None, e, 0, f"2025-01-{i + 1:02d}T00:00:00", None) for i, (p, s, e) in enumerate(log)], "state_id long, path string, status string, hash string, topic string, error string, retry_count int, timestamp string, logged_at timestamp")
    assert T.crash_counter(df).first().crashes == 0
    assert T.crash_counter(df.where("state_id < 5")).first().crashes == 3


def test_page_hits_tolerate_neighbours(spark):
    pred = spark.createDataFrame([(1, 1, "a.pdf", 346, "a.pdf#346"), (1, 2, "a.pdf", 349, "a.pdf#349"), (2, 1, "b.pdf", None, "b.pdf#?")], "query_id int, rank int, file string, page int, ref string")
    truth = spark.createDataFrame([(1, "a.pdf", 345, "a.pdf#345"), (2, "b.pdf", None, "b.pdf#?")], "query_id int, file string, page int, ref string")
    assert sorted((r.query_id, r.rank) for r in E.page_hits(pred, truth).collect()) == [(1, 1), (2, 1)]
    assert [(r.query_id) for r in E.page_hits(pred, truth, 0).collect()] == [2]


@pytest.mark.parametrize("name, want", [("algoritmia", "Algoritmia"), ("Quimia", "Quim"), ("Álgebra", "Algoritmia"), ("ia", "General"), ("Red - ia", "Red")])
def test_resolved_topic(spark, name, want):
    assert one(spark, name, lambda c: T.resolved_topic(c, {"algoritmia": "Algoritmia", "Álgebra": "Algoritmia"}, ["ia", "ación"], "General")) == want


def test_upsert_and_replace(spark):
    old = spark.createDataFrame([("a", 1, "f"), ("b", 2, "f"), (None, 3, "g")], "k string, v int, file_path string")
    new = spark.createDataFrame([("a", 9, "f"), ("c", 4, "h")], "k string, v int, file_path string")
    assert sorted(r.v for r in G.upsert(old, new, "k").collect()) == [2, 3, 4, 9]
    assert sorted(r.v for r in G.replace_file(old, new).collect()) == [3, 4, 9]
