from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.operators import skewed_keys as K


@given(st.dictionaries(st.text("abc", min_size=1, max_size=3), st.integers(1, 10_000), min_size=1, max_size=12), st.integers(2, 20))
@settings(max_examples=60, deadline=None)
def test_packing_balances(loads, tasks):
    total = sum(loads.values())
    heavy = [(k, n) for k, n in loads.items() if n >= K.HEAVY * total / tasks]
    placed = K.pack(heavy, total, tasks)
    assert set(placed) == {k for k, _ in heavy}
    per = Counter()
    for k, n in heavy:
        for t in placed[k]:
            assert 0 <= t < tasks
            per[t] += n / len(placed[k])
    assert max(per.values(), default=0) <= 2 * total / tasks + 1


def test_per_key_with_a_third_on_one_key(spark):
    rows = [("hot", i % 7, i, i) for i in range(900)] + [(f"k{i % 300}", None if i % 5 == 0 else i % 3, i, i) for i in range(1800)] + [(None, 1, 1, 1)]
    df = spark.createDataFrame(rows, "key string, page int, rid long, at long")
    got = {r.key_value: r for r in K.per_key(df, "key", "page", F.col("rid"), F.col("at"), F.col("rid"), tasks=6).collect()}
    assert set(got) == {r[0] for r in rows if r[0]}
    assert (got["hot"].n_rows, got["hot"].n_pages, got["hot"].last_request, got["hot"].total) == (900, 7, 899, 2700)
    assert got["hot"].n_shards > 1
    want = [r for r in rows if r[0] == "k15"]
    assert got["k15"].n_rows == len(want) and got["k15"].n_pages == len({r[1] for r in want} - {None})


def test_null_times_and_empty_input(spark):
    df = spark.createDataFrame([("a", None, 5, None)], "key string, page int, rid long, at long")
    r = K.per_key(df, "key", "page", F.col("rid"), F.col("at"), F.col("rid")).first()
    assert (r.n_rows, r.n_pages, r.last_request) == (1, 0, None)
    assert K.per_key(df.limit(0), "key", "page", F.col("rid"), F.col("at"), F.col("rid")).count() == 0


def test_skew_join_equals_join(spark):
    left = spark.createDataFrame([("hot" if i % 3 else f"k{i}", i) for i in range(300)], "key string, i long")
    right = spark.createDataFrame([("hot", "x"), ("hot", "y"), ("k3", "z"), ("none", "w")], "key string, v string")
    p = K.place(K.key_loads(left, "key"), "key", 4)
    got = sorted((r.i, r.v) for r in K.skew_join(left, right, "key", p, F.col("i")).collect())
    assert got == sorted((r.i, r.v) for r in left.join(right, "key").collect())


def test_file_names(spark):
    rows = spark.createDataFrame([(" topics/A/guía.pdf#page=3 ",), ("guía.pdf",), ("",), (None,)], "file string")
    assert [r.name for r in K.named_citations(rows).collect()] == ["guía.pdf", "guía.pdf", "", None]
