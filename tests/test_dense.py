"""Dense search where stated queries differ in length."""

from corpusloom.operators import search as S


def test_each_query_is_matched_with_vectors_of_its_length(spark):
    rows = [(0, [1.0]), (1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 1.0]), (4, [1.0, 0.0, 0.0]), (5, [1.0, 0.0, 0.0]), (6, None), (7, []), (8, [2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.doc_id): r.score for r in S.dense(df, df.where("vec_id IN (0, 1, 4, 6, 7)"), 2).collect()}
    assert got == {(0, 8): 1.0, (1, 2): 0.707107, (1, 3): 0.0, (4, 5): 1.0}
