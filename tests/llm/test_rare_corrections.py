"""A misread word whose right form is rare in a large corpus."""

from corpusloom.llm import scans
from corpusloom.session import table


def test_rare_right_form_is_a_correction_in_a_large_corpus(spark, small):
    known = scans.vocabulary(table(spark, small, "elements"))
    vocab = known.unionByName(spark.createDataFrame([("zarnoquilado", 8), ("zamoquilado", 1)], "word string, n long"))
    read = spark.createDataFrame([(["zamoquilado"],)], "words array<string>")
    assert [(r.word, r.printed) for r in scans.corrections(read, vocab).collect()] == [("zamoquilado", "zarnoquilado")]
