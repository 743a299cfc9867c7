import json

import pytest
from pyspark.sql import functions as F

from corpusloom.sources import readers as R
from corpusloom.sources import sinks as S


def test_documents_on_disk(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for n in ("x.pdf", "a/y.PDF", "z.txt"):
        (tmp_path / n).write_bytes(b"data")
    rows = R.documents_on_disk(spark, str(tmp_path), content=True)
    assert sorted(r.path.rsplit("/", 1)[1] for r in rows.collect()) == ["x.pdf", "y.PDF"]
    assert {r.hash for r in R.file_hashes(rows).collect()} == {"8d777f385d3dfec8815d20f7496026dc"}


def test_telemetry_lines(spark, tmp_path):
    p = tmp_path / "t.jsonl"
    p.write_text('{"query": "a", "ts": 5}\n\n{broken\n{"query": "b", "generative": false, "retrieved": [{"file_path": "f", "page": 2}]}\n')
    got = R.telemetry(spark, [str(p), str(tmp_path / "none.jsonl")]).orderBy("query").collect()
    assert [(r.query, r.ts, r.generative) for r in got] == [("a", 5, None), ("b", None, False)]
    assert [r.value for r in R.malformed_lines(spark, [str(p)]).collect()] == ["{broken"]
    assert R.telemetry(spark, [str(tmp_path / "none*.jsonl")]).count() == 0


def test_golden(spark, tmp_path):
    p = tmp_path / "g.json"
    p.write_text(json.dumps([{"query": "q", "topic": "T", "relevant_pages": ["a.pdf#1", "a.pdf#2", "b.pdf#1"]}, {"query": "r", "relevant_pages": ["c#1"], "relevant_files": ["d"]}]))
    assert [r.relevant_files for r in R.golden_cases(spark, [str(p)]).orderBy("query").collect()] == [["a.pdf", "b.pdf"], ["d"]]


def test_state_falls_back(spark, tmp_path):
    p = tmp_path / "state.json"
    assert R.processing_state(spark, str(p)).count() == 0
    (tmp_path / "state.json.bak").write_text(json.dumps({"processed": {"a": {"hash": "h", "topic": "T"}}, "failed": {"b": {"error": "e", "retry_count": 2}}}))
    p.write_text('{"processed": {"a"')
    got = {r.path: (r.status, r.hash, r.retry_count) for r in R.processing_state(spark, str(p)).collect()}
    assert got == {"a": ("success", "h", 0), "b": ("failed", None, 2)}


def test_heartbeat(spark, tmp_path):
    p = tmp_path / "hb"
    p.write_text("12.5\nfile.pdf")
    assert R.heartbeat(spark, str(p)).collect() == [(12.5, "file.pdf")]
    p.write_text("soon")
    assert R.heartbeat(spark, str(p)).count() == 0 == R.heartbeat(spark, str(tmp_path / "no")).count()


def test_settings():
    s = R.Settings.read({"FINAL_TOPK": " 9 ", "RRF_K": "x", "TRANSLATE": "Yes", "PER_FILE": ""})
    assert (s.final_topk, s.rrf_k, s.translate, s.per_file) == (9, 60, True, 3)


def test_months(spark, tmp_path):
    root = str(tmp_path / "t")
    rows = spark.createDataFrame([(1735689600000, "a"), (1740787200000, "b"), (None, "c")], "ts long, query string")
    S.append_telemetry(rows, root)
    assert S.purge_months(spark, root, 0, "2025-04-10") == []
    assert S.purge_months(spark, root, 2, "2025-04-03") == []  # 62 days
    assert S.purge_months(spark, root, 2, "2025-04-04") == ["2025-01"]
    assert sorted(r.query for r in spark.read.json(root).collect()) == ["b", "c"]


def test_cache_makes_each_key_once(spark, tmp_path):
    root, schema, made = str(tmp_path / "c"), "key string, text string", []

    def make(d):
        made.append(sorted(r.key for r in d.collect()))
        return d.select("key", F.upper("key").alias("text"))

    w = lambda *k: spark.createDataFrame([(x,) for x in k], "key string")
    S.fill_cache(w("a", "b"), root, schema, "key", make)
    got = S.fill_cache(w("b", "c"), root, schema, "key", make)
    assert made == [["a", "b"], ["c"]] and sorted(r.text for r in got.collect()) == ["B", "C"]


def test_scores_and_backfill(spark, tmp_path):
    df = spark.createDataFrame([(1, "hola mundo"), (2, " ")], "id long, text string")
    S.write_scores(df, str(tmp_path / "s"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "s")).count() == 2
    assert S.backfill(df, {"n": F.length("text")}, str(tmp_path / "b")) == {"rows": 2, "empty": 1}
    with pytest.raises(ValueError):
        S.backfill(df, {"n": F.lit(None).cast("int")}, str(tmp_path / "b2"))


def test_cache_removal(spark, tmp_path):
    root, schema = str(tmp_path / "c"), "key string, text string"
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "key string")
    S.fill_cache(keys("a", "b"), root, schema, "key", lambda d: d.selectExpr("key", "upper(key) AS text"))
    assert S.remove_cached(keys("x"), root, schema, "key") == 0 and S.remove_cached(keys("a", "a"), root, schema, "key") == 1
    assert [r.key for r in S.cached(spark, root, schema).collect()] == ["b"]
    assert S.clear_cache(spark, root) and not S.clear_cache(spark, root) and S.cached(spark, root, schema).count() == 0


def test_collections(spark):
    points = spark.createDataFrame([("f", "T", [1.0, 2.0]), (None, "U", [0.0, 1.0]), ("g", None, [1.0, 1.0])], "file_path string, topic string, v array<double>")
    assert S.ensure_collection(points, "v", 2).count() == 3
    for bad in ([1.0], None):
        with pytest.raises(Exception, match="another length"):
            S.ensure_collection(spark.createDataFrame([("f", bad)], "file_path string, v array<double>"), "v", 2).collect()
    rest, n = S.delete_by_file(points, "f")
    assert n == 1 and rest.count() == 2 and S.delete_by_file(points, None)[1] == 0
    a, b = S.drop_topic(points, points, "T")
    assert a.count() == b.count() == 2
