"""Rows of skewed keys lie in the tasks that packing gives them."""

from collections import Counter

from pyspark.sql import functions as F

from corpusloom.operators import skewed_keys as K


def test_rows_lie_in_their_packed_task(spark):
    rows = [("hot", i) for i in range(900)] + [(f"k{i % 300}", i) for i in range(900)] + [(None, 1)]
    df = spark.createDataFrame(rows, "key string, i long")
    p = K.place(K.key_loads(df, "key"), "key", 6)
    got = K.packed(df, "key", p, F.col("i")).withColumn("_part", F.spark_partition_id()).collect()
    assert len(got) == 1800 and all(r._part == r._task for r in got)
    assert {r._task for r in got if r.key == "hot"} == set(p.shards["hot"])
    assert max(Counter(r._part for r in got).values()) < 2 * 1800 / 6


def test_topics_count_requests_and_pages_in_one_pass(spark):
    hit = "array<struct<file_path:string,page:int,chunk_id:int>>"
    rows = [(i, i, "hot", [("a", i % 7, 0), ("a", i % 7, 1), ("b", 1, 0)]) for i in range(50)] + [(90, 9, "few", []), (91, None, "few", None), (92, 1, None, [("a", 1, 1)])]
    got = {r.key_value: r for r in K.topic_results(spark.createDataFrame(rows, f"retrieval_id long, ts long, topic string, retrieved {hit}")).collect()}
    assert (got["hot"].n_rows, got["hot"].n_pages, got["hot"].last_request, got["hot"].total) == (50, 8, 49, 52)
    assert (got["few"].n_rows, got["few"].n_pages, got["few"].last_request) == (2, 0, 90)
