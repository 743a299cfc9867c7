"""Lexical search at sizes and in shapes where every document matches."""

import math
import random
import re

from corpusloom.functions.text import FUNCTION_WORDS
from corpusloom.operators import search as S


def frames(spark, seed, n_docs, n_queries, terms):
    rng = random.Random(seed)
    docs = [(i, rng.choice(["A", "B", None, "C"]), rng.choice([None, "", "de la", *[" ".join(rng.choices(terms, k=rng.randint(1, 9))) for _ in range(6)]])) for i in range(n_docs)]
    queries = [(i, rng.choice(["A", "B", "Z", None]), rng.choice([None, "", "de la", *[" ".join(rng.choices(terms, k=rng.randint(1, 5))) for _ in range(6)]])) for i in range(n_queries)]
    return docs, queries, spark.createDataFrame(docs, "row_id long, topic string, text string"), spark.createDataFrame(queries, "query_id long, topic string, query string")


def looped(docs, queries, k):
    split = lambda x: re.findall(r"[^\W_]+", (x or "").lower())
    out = []
    for qid, topic, query in queries:
        own = [(i, split(x)) for i, t, x in docs if topic is not None and t == topic and split(x)]
        score = {}
        for i, w in own:
            for term in {x for x in split(query) if x not in FUNCTION_WORDS} if len((query or "").strip()) >= 3 else ():
                if term in w:
                    df = sum(term in x for _, x in own)
                    tf, mean = w.count(term), sum(len(x) for _, x in own) / len(own)
                    score[i] = score.get(i, 0) + math.log(1 + (len(own) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
        best = sorted((-round(s, 4), i) for i, s in score.items())[:k]
        out += [(qid, i, -s, n + 1) for n, (s, i) in enumerate(best)]
    return sorted(out)


def test_the_best_of_each_query_by_score_and_id_over_several_runs_of_documents(spark, monkeypatch):
    docs, queries, d, q = frames(spark, 1, 300, 40, ["motor", "gas", "válvula", "eje", "ácido"])
    want = looped(docs, queries, 4)
    monkeypatch.setattr(S, "LEXICAL_BLOCK", 7)
    for at_once in (20, 10**6):
        got = sorted((r.query_id, r.doc_id, r.score, r["rank"]) for r in S.bm25(q, d, 4, at_once=at_once).collect())
        assert got == want and len(want) > 50


def test_nothing_asked_or_nothing_to_search(spark):
    _, _, d, q = frames(spark, 2, 20, 20, ["motor"])
    for a, b in ((q.limit(0), d), (q, d.limit(0)), (q.where("query = 'de la'"), d)):
        assert S.bm25(a, b, 3).collect() == []


def test_scores_of_matching_pairs_are_not_passed_on(spark, monkeypatch):
    # 200 queries match all of 2,000 documents: 400,000 pairs.
    d = spark.range(2000).selectExpr("id AS row_id", "'A' AS topic", "concat('motor de gas ', id % 7) AS text")
    q = spark.range(200).selectExpr("id AS query_id", "'A' AS topic", "concat('motor ', id) AS query")
    monkeypatch.setattr(S, "top", lambda scores, *a: scores)
    parts = 3 * spark.sparkContext.defaultParallelism
    assert 200 * 5 <= S.bm25(q, d, 5).count() <= 200 * 5 * parts < 200 * 2000
