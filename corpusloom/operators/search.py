"""Lexical, dense and hybrid search over batches of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusloom.functions.text import FUNCTION_WORDS, citation_label, citation_url, sanitised_query, token_estimate, words
from corpusloom.functions.unicode import base_name
from corpusloom.operators.lexical import NUMBERED, Vocabulary, best, numbered
from corpusloom.session import cut, spread

RRF_K = 60
#: Query vectors, or lexical queries, of one block that is sent to every task; terms of documents that a task scores at once.
QUERY_BLOCK, LEXICAL_BLOCK, POSTINGS = 1024, 50_000, 2_000_000


def postings(docs: DataFrame, key: str = "row_id", text: str = "text", group: str = "topic") -> DataFrame:
    """(topic, doc_id, term, tf, dl): one row per term of a document; documents without words have none."""
    docs = spread(docs.select(group, key, text), key)
    w = docs.select(F.col(group).alias("topic"), F.col(key).alias("doc_id"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    return w.select("topic", "doc_id", F.size("w").alias("dl"), F.explode("w").alias("term")).groupBy("topic", "doc_id", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))


def idf_table(post: DataFrame) -> DataFrame:
    """(topic, term, df, idf) with the number of documents of the topic that hold the term."""
    n = post.select("topic", "doc_id").distinct().groupBy("topic").agg(F.count(F.lit(1)).alias("n"))
    df = post.groupBy("topic", "term").agg(F.count(F.lit(1)).alias("df"))
    return df.join(n, "topic").select("topic", "term", "df", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def bm25(queries: DataFrame, docs: DataFrame, k: int, key: str = "row_id", text: str = "text", group: str = "topic", at_once: int = POSTINGS) -> DataFrame:
    """(query_id, doc_id, score, rank): the ``k`` best documents of the query's topic for each query; exact.

    ``queries`` is (query_id, topic, query); ids are whole numbers and ``key`` is unique and not null. Documents are split
    once and kept as numbers of the terms that any query of their topic has; statistics come from all documents. The stated
    queries go to all tasks in blocks of LEXICAL_BLOCK, and a task passes on the ``k`` best of each among its documents, so the
    scores of matching pairs never leave it.
    Function words of a query match nearly every document for next to no weight and are left out.
    Queries that sanitise to nothing, and topics without documents, give no rows. Ties go to the smaller id.
    """
    terms = queries.where(F.col("topic").isNotNull()).select("query_id", "topic", F.explode(words(sanitised_query(F.col("query")))).alias("term")).where(~F.col("term").isin(*FUNCTION_WORDS))
    asked = terms.groupBy(F.col("query_id").cast("long").alias("query_id"), "topic").agg(F.collect_set("term").alias("terms")).toArrow()
    v = Vocabulary(asked.column("topic"), asked.column("terms"))
    docs = spread(docs.select(group, key, text), key, per_core=1)
    w = docs.select(F.col(group).alias("topic"), F.col(key).cast("long").alias("doc_id"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    index = cut(w.mapInArrow(numbered(v.topics, v.terms, v.pairs), NUMBERED))
    n, avgdl, df = np.ones(len(v.topics)), np.ones(len(v.topics)), np.zeros(len(v.pairs))
    for r in index.groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")).collect():
        n[r.topic], avgdl[r.topic] = r.n, r.avgdl
    held = index.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("df")).toArrow()
    df[held.column("key").to_numpy()] = held.column("df").to_numpy()
    idf = np.log(1 + (n[v.topic_of_key] - df + 0.5) / (df + 0.5))
    ids, out = asked.column("query_id").to_numpy(), None
    for at in range(0, max(1, len(ids)), LEXICAL_BLOCK):
        block = slice(at, at + LEXICAL_BLOCK)
        part = index.mapInArrow(best(ids[block], v.topic_of_query[block], v.keys_of_query[block], idf, avgdl, k, at_once), "query_id bigint, doc_id bigint, score double")
        out = part if out is None else out.unionByName(part)
    return top(out, "query_id", [F.desc("score"), F.asc("doc_id")], k)


def top(df: DataFrame, by: str, order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group by ``order``; limited before the shuffle."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(by).orderBy(*order))).where(F.col(rank) <= k)


def dense(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(query_id, doc_id, score, rank): the ``k`` vectors of highest cosine to each query vector but itself; exact.

    A stated set of queries goes to all tasks in blocks of QUERY_BLOCK; a task multiplies whole batches with
    a block, those of one length at a time, and keeps the best ``k`` of each query, so what is shuffled doesn't grow
    with the vectors. Vectors that are null or of another length than the query's are passed over; zero vectors score 0.
    """
    rows = queries.select(F.col(key).alias("query_id"), F.col(vec).alias("v")).where(F.col("v").isNotNull()).orderBy("query_id").collect()
    out = None
    for at in range(0, max(1, len(rows)), QUERY_BLOCK):
        block = rows[at : at + QUERY_BLOCK]
        part = vectors.select(key, vec).mapInArrow(_best(np.array([r.query_id for r in block], np.int64), [np.array(r.v, np.float64) for r in block], k), "query_id bigint, doc_id bigint, score double")
        out = part if out is None else out.unionByName(part)
    return top(out, "query_id", [F.desc("score"), F.asc("doc_id")], k)


def _best(ids: np.ndarray, vecs: list[np.ndarray], k: int):
    def unit(m: np.ndarray) -> np.ndarray:
        n = np.sqrt((m * m).sum(1, keepdims=True))
        return np.divide(m, n, out=np.zeros_like(m), where=n > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dims = np.array([len(v) for v in vecs], np.int64)
        asked = {d: (ids[dims == d], unit(np.array([v for v in vecs if len(v) == d], np.float64).reshape((dims == d).sum(), d))) for d in np.unique(dims).tolist()}
        best: dict[int, list[list[tuple[float, int]]]] = {d: [[] for _ in own] for d, (own, _) in asked.items()}
        for batch in batches:
            col = batch.column(1)
            lengths = pa.compute.fill_null(pa.compute.list_value_length(col), -1).to_numpy(zero_copy_only=False)
            for dim, (own, q) in asked.items():
                keep = np.flatnonzero(lengths == dim)
                if not len(keep):
                    continue
                part = col.take(pa.array(keep))
                m = unit(np.nan_to_num(np.asarray(part.flatten().to_numpy(zero_copy_only=False), np.float64)).reshape(len(keep), dim))
                doc = batch.column(0).to_numpy(zero_copy_only=False)[keep].astype(np.int64)
                s = np.round(q @ m.T, 6)
                for j in range(len(own)):
                    # All that reach the score of place k + 1, ties included; only these are sorted.
                    few = np.flatnonzero(s[j] >= np.partition(s[j], -k - 1)[-k - 1]) if len(doc) > k + 1 else np.arange(len(doc))
                    order = few[np.lexsort((doc[few], -s[j, few]))][: k + 1]
                    got = [(-s[j, i], int(doc[i])) for i in order if doc[i] != own[j]][:k]
                    best[dim][j] = sorted(best[dim][j] + got)[:k]
        flat = [(int(i), d, -c) for dim, (own, _) in asked.items() for i, b in zip(own, best[dim]) for c, d in b]
        a, b, c = zip(*flat) if flat else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.float64())], ["query_id", "doc_id", "score"])

    return run


def rrf(first: DataFrame, second: DataFrame, k: int = RRF_K) -> DataFrame:
    """(query_id, doc_id, rrf, dense_rank, bm25_rank, score_dense, score_bm25): reciprocal-rank fusion of two rankings.

    Both scores of a document found twice are kept. A union and one aggregation, not an outer join.
    """
    a = first.select("query_id", "doc_id", F.col("rank").alias("dense_rank"), F.lit(None).cast("int").alias("bm25_rank"), F.col("score").alias("score_dense"), F.lit(None).cast("double").alias("score_bm25"))
    b = second.select("query_id", "doc_id", F.lit(None).cast("int").alias("dense_rank"), F.col("rank").alias("bm25_rank"), F.lit(None).cast("double").alias("score_dense"), F.col("score").alias("score_bm25"))
    part = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    merged = a.unionByName(b).groupBy("query_id", "doc_id").agg(*[F.max(c).alias(c) for c in ("dense_rank", "bm25_rank", "score_dense", "score_bm25")])
    return merged.withColumn("rrf", F.round(part("dense_rank") + part("bm25_rank"), 8))


#: Order of fused results: ties keep dense results first, then lexical ones.
FUSED = [F.desc, F.asc_nulls_last, F.asc_nulls_last]


def fused_order() -> list[Column]:
    return [F.desc("rrf"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("bm25_rank"), F.asc("doc_id")]


def per_file_cap(hits: DataFrame, file: str, order: list[Column], per_file: int, k: int) -> DataFrame:
    """At most ``per_file`` rows of a file, then the first ``k`` of a query; 0 means no limit. Adds ``rank`` if limited."""
    if per_file:
        hits = hits.withColumn("_in_file", F.row_number().over(W.partitionBy("query_id", file).orderBy(*order))).where(F.col("_in_file") <= per_file).drop("_in_file")
    ranked = hits.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order)))
    return ranked.where(F.col("rank") <= k) if k else ranked


def soft_trim(hits: DataFrame, tokens: str, limit: int) -> DataFrame:
    """The longest prefix of each query's ranked rows whose tokens stay within ``limit``; the first overflow ends it."""
    w = W.partitionBy("query_id").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    return hits.withColumn("used", F.sum(tokens).over(w)).where(F.col("used") <= limit)


def overlap_rerank(hits: DataFrame, query: str, text: str) -> DataFrame:
    """Ranked rows in the order of the share of the query's words in the text, ties in the order they had.

    The default of the reranker plug: any function of (query, text) may take its place.
    """
    q = F.array_distinct(words(F.col(query)))
    share = F.size(F.array_intersect(q, words(F.col(text)))) / F.greatest(F.size(q), F.lit(1))
    scored = hits.withColumn("rerank_score", F.round(share, 6))
    return scored.withColumn("rerank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("rerank_score"), F.asc("rank"))))


def contexts(hits: DataFrame, topic: str, text: str, file_path: str, page: str) -> DataFrame:
    """(query_id, context): texts with their source links in rank order."""
    body = F.concat(F.coalesce(F.col(text), F.lit("")), F.lit("\n\nFUENTE:\n"), citation_label(F.col(topic), F.col(file_path), F.col(page)))
    parts = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", body.alias("b")))).alias("p"))  # at most k a query
    return parts.select("query_id", F.array_join(F.transform("p", lambda x: x["b"]), "\n\n").alias("context"))


def citation_rows(hits: DataFrame, topic: str, file_path: str, page: str, chunk_id: str) -> DataFrame:
    return hits.select("query_id", "rank", base_name(F.col(file_path)).alias("file"), F.col(page).alias("page"), F.col(chunk_id).cast("string").alias("chunk_id"), citation_url(F.col(topic), F.col(file_path), F.col(page)).alias("url"))


def hybrid(queries: DataFrame, vectors: DataFrame, chunks: DataFrame, k: int, per_file: int, tokens: int, depth: int) -> DataFrame:
    """Hybrid search end to end: both branches at twice the depth, fusion, per-file cap, cut, token budget, citations."""
    lexical = bm25(queries, chunks, 2 * depth)
    asked = vectors.join(queries.select(F.col("query_id").alias("_q")), F.col("vec_id") == F.col("_q"), "left_semi")
    close = dense(vectors, asked, 2 * depth)
    facts = chunks.select(F.col("row_id").alias("doc_id"), F.col("topic").alias("doc_topic"), "file_path", "page", "chunk_id", token_estimate(F.col("text")).alias("tokens"))
    hits = rrf(close, lexical).join(facts, "doc_id")
    kept = soft_trim(per_file_cap(hits, "file_path", fused_order(), per_file, k), "tokens", tokens)
    return kept.select("query_id", "rank", "doc_id", "rrf", base_name(F.col("file_path")).alias("file"), "page", citation_url(F.col("doc_topic"), F.col("file_path"), F.col("page")).alias("url"))
