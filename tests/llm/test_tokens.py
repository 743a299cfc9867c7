import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpusloom.llm import tokens as T

ENC = T.Encoder(T.vocabulary_path(), public_tokenizers.PATTERN)
REF = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
REF.encode_special_tokens = True


@given(st.text(alphabet=st.characters(blacklist_categories=("Cs",)), max_size=80))
@settings(max_examples=300, deadline=None)
def test_equals_the_public_tokenizer(text):
    assert ENC.encode(text) == REF.encode(text, add_special_tokens=False).ids


def test_whole_table(spark, small):
    got = {r.doc_id: r.ids for r in T.p8_ids(spark, small).collect()}
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        assert got[r.doc_id] == (REF.encode(r.text, add_special_tokens=False).ids if r.text else [])


def test_long_runs_and_special_strings():
    for text in ("a" * 20000, "老" * 3000, "<|endoftext|>", "\n" * 500):
        assert ENC.encode(text) == REF.encode(text, add_special_tokens=False).ids


def test_null_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (2, "hola", "z")], "doc_id long, text string, ids string")
    got = [(r.doc_id, r.ids) for r in T.encode_corpus(df).collect()]
    assert got == [(1, []), (2, []), (2, ENC.encode("hola"))]
    assert T.encode_corpus(df.limit(0)).count() == 0
