import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import evaluation as E
from corpusloom.operators import extractors as X


def shouting(batches):
    for pdf in batches:
        yield pd.DataFrame({"file_path": pdf["file_path"], "elem_no": 0, "text": pdf["content"].fillna("").str.upper(), "type": "Text", "page": 1})


def short_only(batches):
    for pdf in X.plain_text(batches):
        yield pdf[pdf["text"].str.len() < 30]


REGISTRY = {"plain": X.plain_text, "shout": shouting, "short": short_only}


def test_chain(spark):
    long = "Un párrafo con texto suficiente para contar. " * 14
    rows = [("a", f"{long}\n\n{long}\fcorta"), ("b", "apenas un texto"), ("c", None), ("d", "x"), (None, long), ("a", f"{long}\n\n{long}\fcorta")]
    files = spark.createDataFrame(rows, "file_path string, content string")
    got = X.extract(files, ["short", "plain", "shout"], REGISTRY).groupBy("file_path", "extractor").agg(F.count(F.lit(1)).alias("n")).collect()
    assert {(r.file_path, r.extractor): r.n for r in got} == {("a", "plain"): 2, ("b", "shout"): 1}
    assert X.extract(files, [], REGISTRY).count() == 0 and X.extract(files.limit(0), ["plain"], REGISTRY).count() == 0


def test_an_unknown_extractor_is_an_error(spark):
    with pytest.raises(ValueError, match="unknown extractor 'ocr'; there are plain, short, shout"):
        X.extract(spark.createDataFrame([], "file_path string, content string"), ["ocr"], REGISTRY)


def test_plain_text():
    pdf = pd.DataFrame({"file_path": ["f", "g"], "content": ["corto\n\nesto es un párrafo\fa b c d\n\ne f g h\n\ni j k l m n o\n\np q r s t", " \n\n "]})
    got = pd.concat(X.plain_text(iter([pdf])))
    assert got[["file_path", "elem_no", "page"]].values.tolist() == [["f", 0, 1], ["f", 1, 2]] and got["text"].iloc[0] == "esto es un párrafo"


def test_evaluation_summary(spark):
    cases = spark.createDataFrame([(1,), (2,)], "query_id long")
    hits = lambda *r: spark.createDataFrame(list(r), "query_id long, rank int")
    aliases = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "c"), ("d", "c")], "file string, canonical string")
    r = E.summary(cases, hits((1, 2), (1, 5)), hits((1, 1), (2, 4)), aliases).first()
    assert (r.n, r.page_tolerance, r.duplicate_groups) == (2, 1, 2)
    assert (r.page_recall_at_1, r.page_recall_at_3, r.page_mrr) == (0.0, 0.5, 0.25)
    assert (r.file_recall_at_1, r.file_recall_at_3, r.file_recall_at_5, r.file_mrr) == (0.5, 0.5, 1.0, 0.625)
