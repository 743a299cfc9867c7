"""Order within files whose rows are windowed in blocks."""

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusloom.operators import analytics as A
from corpusloom.operators import ingest as G


def test_previous_across_blocks(spark):
    rows = [("a", (i * 7) % 50, i, i % 4 or None) for i in range(60)] + [("b", None, 1, 5), ("b", 3, 2, 6), ("b", None, 0, 4), (None, 1, 1, 1), (None, 9, 1, 2)]
    df = spark.createDataFrame(rows, "f string, c int, r long, v int")
    want = df.withColumn("prev", F.lag("v").over(W.partitionBy("f").orderBy("c", "r"))).collect()
    for span in (1, 3, 10, 1000):
        assert sorted(map(repr, A.with_previous(df, "f", "c", "r", "v", span).select(*df.columns, "prev").collect())) == sorted(map(repr, want))


def test_numbered(spark):
    rows = [("a", 2, 0), ("a", 1, 0), ("a", 1, 1), ("a", 5, 0), (None, 1, 0), (None, 3, 0)]
    got = G.numbered(spark.createDataFrame(rows, "file_path string, page int, seq int")).collect()
    assert {(r.file_path, r.page, r.seq): r.chunk_id for r in got} == {("a", 1, 0): 0, ("a", 1, 1): 1, ("a", 2, 0): 2, ("a", 5, 0): 3, (None, 1, 0): 0, (None, 3, 0): 1}
