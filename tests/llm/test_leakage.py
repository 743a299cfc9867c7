import random

from corpusloom.llm import leakage as L


def brute(docs, items, n):
    out = set()
    for d, t in docs:
        w = L.fold_words(t)
        grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        for i, p in items:
            q = L.fold_words(p)
            if any(tuple(q[k : k + n]) in grams for k in range(len(q) - n + 1)):
                out.add((d, i))
    return out


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, passage string")


def test_against_brute_force(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(12)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.randint(3, 25))) for i in range(12)]
    docs = []
    for d in range(60):
        p = rng.choice(items)[1].split()
        a = rng.randint(0, len(p))
        docs.append((d, f"{text(8)} {' '.join(p[a:a + rng.randint(1, 14)])} {text(8)}"))
    got = {(r.doc_id, r.item_id) for r in L.found(*frames(spark, docs, items), 6).collect()}
    assert got == brute(docs, items, 6) and got


def test_case_accents_and_punctuation_do_not_count(spark):
    passage = "Si el método de Ágata gira la palanca hasta 527 grados, el disco pierde 41 gramos"
    docs = [(1, "antes: SI EL METODO DE AGATA - gira la palanca\nhasta «527» grados; el disco"), (2, "si el metodo de agata gira la palanca hasta 527 gramos"), (3, None), (4, "")]
    got = {(r.doc_id, r.item_id) for r in L.found(*frames(spark, docs, [(7, passage), (8, None), (9, "corto")])).collect()}
    assert got == {(1, 7)}


def test_table_against_brute_force(spark, small):
    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{small}/golden_cases.parquet").select("item_id", "passage").collect()]
    assert {tuple(r) for r in L.p9_found(spark, small).collect()} == brute(docs, items, 12)


def test_proximity_and_empty(spark):
    docs, items = frames(spark, [(1, "a b c d x f g h")], [(1, "a b c d e f g h")])
    near = L.leaks(docs, items, 6, near_words=6).collect()
    assert near and not any(r.exact for r in near)
    assert L.found(docs.limit(0), items).count() == 0 and L.found(docs, items.limit(0)).count() == 0


def test_terms_beyond_the_broadcast_are_joined(spark, monkeypatch):
    rows = [(1, "uno dos tres cuatro cinco seis"), (2, "dos tres cuatro uno")], [(1, "cero dos tres cuatro cinco")]
    want = {tuple(r) for r in L.found(*frames(spark, *rows), 3).collect()}
    monkeypatch.setattr(L, "BROADCAST_ROWS", 1)
    assert {tuple(r) for r in L.found(*frames(spark, *rows), 3).collect()} == want == {(1, 1), (2, 1)}


def test_repeated_items_columns_and_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d e", 5), (1, "a b c d e", 5), (None, "a b c", 1)], "doc_id long, text string, item_id long")
    items = spark.createDataFrame([(1, "x b c d", "t"), (2, "b c d", "t"), (2, "b c d", "t")], "item_id long, passage string, text string")
    assert sorted(tuple(r) for r in L.found(docs, items, 3).collect()) == [(1, 1), (1, 2)]
