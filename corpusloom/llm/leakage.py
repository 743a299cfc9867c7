"""Evaluation passages that leak into training documents.

A positional inverted index of the training side: a posting is a term, a document and a position, and
postings are stored for every term that occurs in a passage. Of every window of ``min_words`` words of a passage the term with the
fewest postings gives the alignments at which the passage can lie in a document; their lists are
intersected, adjusted by the offset, with those of the window's second rarest term, and what is
left with those of all other terms of the passage. A run of ``min_words`` consecutive positions is an exact phrase
match. No document's words are read again.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import ArrayType, StringType

from corpusloom.session import cut, spread, table

#: Tables of passage terms, alignments and documents are broadcast up to so many rows, beyond that they are shuffled.
BROADCAST_ROWS = 200_000


class _Fold(dict):
    """A character's letters and digits without accents and letter case, other characters as a space."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        if c == "\xad" or unicodedata.combining(c):
            v = ""
        else:
            bare = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).casefold()
            v = "".join(x if x.isalnum() else " " for x in bare)
        self[code] = v
        return v


_fold = _Fold()


def fold_words(text: str | None) -> list[str]:
    """Words as runs of letters and digits, without accents and letter case."""
    return text.translate(_fold).split() if text else []


@F.pandas_udf(ArrayType(StringType()))
def words(s: pd.Series) -> pd.Series:
    return s.map(fold_words)


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def passage_terms(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((item_id, item_pos, term), (term, word)) of passages; terms are hashes of words."""
    each = cut(items.select("item_id", F.posexplode(words("passage")).alias("item_pos", "word")).select("item_id", "item_pos", F.xxhash64("word").alias("term"), "word").distinct())
    return each.select("item_id", "item_pos", "term"), each.select("term", "word").distinct()


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, doc_id, doc_pos): every occurrence in ``docs`` (doc_id, text) of the words of ``terms`` (term, word).

    The words of up to BROADCAST_ROWS terms are looked up while a text is split; more are joined.
    """
    known = terms.limit(BROADCAST_ROWS + 1).collect()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.length("text") > 0)
    if len(known) > BROADCAST_ROWS:
        return docs.select("doc_id", F.posexplode(words("text")).alias("doc_pos", "word")).join(terms, "word").select("term", "doc_id", "doc_pos")
    number = {r.word: r.term for r in known}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            term, doc, at = [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                met = [(n, p) for p, n in enumerate(map(number.get, fold_words(t))) if n is not None]
                if met:
                    n, p = zip(*met)
                    term += n
                    at += p
                    doc += [i] * len(n)
            yield pa.RecordBatch.from_arrays([pa.array(term, pa.int64()), pa.array(doc, pa.int64()), pa.array(at, pa.int32())], ["term", "doc_id", "doc_pos"])

    return docs.mapInArrow(run, "term bigint, doc_id bigint, doc_pos int")


def anchors(each: DataFrame, index: DataFrame, min_words: int) -> DataFrame:
    """(item_id, term, item_pos, term2, item_pos2): the rarest and second rarest posted terms of each window of a passage, ties to the left.

    ``whole`` says whether all terms of the window are posted; without that it has no exact match. A window
    with one posted term has no second.
    """
    counted = index.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    window = W.partitionBy("item_id").orderBy("item_pos").rowsBetween(0, min_words - 1)
    at = F.struct("n", "item_pos", "term")
    ranked = each.join(counted, "term", "left").select(
        "item_id", F.sort_array(F.collect_list(F.when(F.col("n").isNotNull(), at)).over(window)).alias("w"), F.count(F.lit(1)).over(window).alias("size")
    )
    ranked = ranked.where((F.col("size") == min_words) & (F.size("w") > 0))
    one, two = F.get("w", F.lit(0)), F.get("w", F.lit(1))
    return ranked.select(
        "item_id", one["term"].alias("term"), one["item_pos"].alias("item_pos"), two["term"].alias("term2"), two["item_pos"].alias("item_pos2"), (F.size("w") == min_words).alias("whole")
    ).distinct()


def leaks(docs: DataFrame, items: DataFrame, min_words: int = 12, near_words: int | None = None) -> DataFrame:
    """(doc_id, item_id, doc_pos, item_pos, shared, exact) of each alignment at which a passage is met.

    ``docs``: (doc_id, text); ``items``: (item_id, passage). The positions are those of the first equal word,
    ``shared`` counts the equal words, and ``exact`` means that ``min_words`` of them are consecutive. With
    ``near_words``, alignments with at least so many equal words among 2 * ``min_words`` - 1 consecutive positions are
    reported too (proximity matches). Passages of fewer words than ``min_words`` match nothing. Documents
    or passages that are null or empty give no rows. An id names one text; its repeated rows count once.
    """
    each, terms = passage_terms(items)
    index = cut(postings(docs, terms))
    anchor = cut(anchors(each, index, min_words))
    if near_words is None:
        anchor = anchor.where("whole")
    met = index.join(_small(anchor), "term").select("doc_id", "item_id", (F.col("doc_pos") - F.col("item_pos")).alias("shift"), "term2", "item_pos2")
    if near_words is None and min_words > 1:
        want = cut(met.select("doc_id", "item_id", "shift", F.col("term2").alias("term"), (F.col("shift") + F.col("item_pos2")).alias("doc_pos")).distinct())
        met = index.join(_small(want), ["doc_id", "term", "doc_pos"])
    aligned = cut(met.select("doc_id", "item_id", "shift").distinct())
    within = index.join(_small(aligned.select("doc_id").distinct()), "doc_id", "left_semi")
    need = aligned.join(_small(each), "item_id").select("doc_id", "item_id", "shift", "item_pos", "term", (F.col("shift") + F.col("item_pos")).alias("doc_pos"))
    equal = need.join(within, ["doc_id", "term", "doc_pos"]).distinct()
    # At most a passage's words stand in a partition of these windows.
    of = W.partitionBy("doc_id", "item_id", "shift").orderBy("item_pos")
    runs = equal.select("doc_id", "item_id", "shift", "doc_pos", "item_pos", (F.col("item_pos") - F.row_number().over(of)).alias("run"), F.count(F.lit(1)).over(of.rangeBetween(0, 2 * min_words - 2)).alias("near"))
    runs = runs.groupBy("doc_id", "item_id", "shift", "run").agg(F.count(F.lit(1)).alias("n"), F.max("near").alias("near"), F.min("item_pos").alias("item_pos"), F.min("doc_pos").alias("doc_pos"))
    out = runs.groupBy("doc_id", "item_id", "shift").agg(
        F.min("doc_pos").alias("doc_pos"), F.min("item_pos").alias("item_pos"), F.sum("n").alias("shared"), (F.max("n") >= min_words).alias("exact"), F.max("near").alias("near")
    )
    keep = F.col("exact") if near_words is None else F.col("exact") | (F.col("near") >= near_words)
    return out.where(keep).select("doc_id", "item_id", "doc_pos", "item_pos", "shared", "exact")


def found(documents: DataFrame, golden: DataFrame, min_words: int = 12) -> DataFrame:
    """(doc_id, item_id) of documents that share ``min_words`` consecutive words with a passage."""
    return leaks(documents.select("doc_id", "text"), golden.select("item_id", "passage"), min_words).select("doc_id", "item_id").distinct()


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", per_core=1)
    return found(docs, table(spark, sf_dir, "golden_cases"))
