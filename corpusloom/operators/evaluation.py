"""Offline scoring of retrieval against golden cases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusloom.functions.unicode import file_key

PAGE_KS, FILE_KS = (1, 3, 5, 10), (1, 3, 5)


def page_refs(df: DataFrame, ref: str) -> DataFrame:
    """``df`` with ``file`` and ``page`` of references "file#page"; page is null where there is none or it is no number."""
    number = F.trim(F.when(F.instr(F.col(ref), "#") > 0, F.substring_index(ref, "#", -1)))
    return df.withColumn("file", file_key(F.col(ref))).withColumn("page", F.when(number.rlike(r"^-?\d{1,9}$"), number.try_cast("int")))


def content_digest(elements: DataFrame) -> DataFrame:
    """(path, hash): a digest of the distinct (page, text) of each file, whatever their order; combined before the shuffle."""
    rows = elements.where(F.col("file_path").isNotNull()).select("file_path", "page", "text").distinct()
    digest = F.sha2(F.encode(F.concat_ws("\x1f", F.coalesce(F.col("page").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))), "UTF-8"), 256)
    # The sums of the digests' four parts of sixty bits are the same in any order.
    parts = [F.sum(F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")).cast("string") for i in range(4)]
    return rows.groupBy(F.col("file_path").alias("path")).agg(F.concat_ws("-", *parts, F.count(F.lit(1)).cast("string")).alias("hash"))


def alias_map(listing: DataFrame, path: str = "path", digest: str = "hash") -> DataFrame:
    """(file, canonical): names of byte-identical files and the least name of each group; files alone are left out.

    A group is identified by hash, so a hot hash is a partial minimum and not a window.
    """
    rows = listing.where(F.col(digest).isNotNull() & F.col(path).isNotNull()).select(file_key(F.col(path)).alias("file"), F.lower(F.trim(digest)).alias("h")).distinct()
    groups = rows.groupBy("h").agg(F.min("file").alias("canonical"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # A name seen with several contents takes the least canonical name.
    return rows.join(groups, "h").groupBy("file").agg(F.min("canonical").alias("canonical"))


def canonical(df: DataFrame, aliases: DataFrame, file: str = "file") -> DataFrame:
    """``df`` with the file replaced by its canonical name."""
    a = aliases.select(F.col("file").alias("_alias"), F.col("canonical").alias("_canonical"))
    return df.join(a, F.col(file) == F.col("_alias"), "left").withColumn(file, F.coalesce("_canonical", file)).drop("_alias", "_canonical")


def ordered(predictions: DataFrame, by: list[str]) -> DataFrame:
    """(query_id, *by, rank): distinct values in the order of their first appearance."""
    firsts = predictions.groupBy("query_id", *by).agg(F.min("rank").alias("_r"))
    return firsts.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("_r", *by))).drop("_r")


def page_hits(predicted: DataFrame, truth: DataFrame, tolerance: int = 1) -> DataFrame:
    """(query_id, rank): ranks at which the canonical file is right and the page within ``tolerance``.

    Where either page is no number the references must be equal as they stand. Both sides have
    (query_id, file, page, ref); the join is on query and file, the page a residual condition.
    """
    t = truth.select(F.col("query_id").alias("_q"), F.col("file").alias("_f"), F.col("page").alias("_p"), F.col("ref").alias("_ref"))
    near = F.when(F.col("page").isNull() | F.col("_p").isNull(), F.col("ref").eqNullSafe(F.col("_ref"))).otherwise(F.abs(F.col("page") - F.col("_p")) <= tolerance)
    return predicted.join(t, (F.col("query_id") == F.col("_q")) & (F.col("file") == F.col("_f")) & near, "left_semi").select("query_id", "rank")


def file_hits(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    t = truth.select(F.col("query_id").alias("_q"), F.col("file").alias("_f"))
    return predicted.join(t, (F.col("query_id") == F.col("_q")) & (F.col("file") == F.col("_f")), "left_semi").select("query_id", "rank")


def case_scores(cases: DataFrame, hits: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """(query_id, hit_at_k for each k, rr): whether any hit is within the first k, and the reciprocal rank of the first; 0 without hits."""
    first = hits.groupBy("query_id").agg(F.min("rank").alias("first"))
    rows = cases.select("query_id").join(first, "query_id", "left")
    at = [F.when(F.col("first") <= k, 1.0).otherwise(0.0).alias(f"hit_at_{k}") for k in ks]
    return rows.select("query_id", *at, F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"))


def family(scores: DataFrame, ks: tuple[int, ...], by: list[str] | None = None) -> DataFrame:
    """n, mean hit rate at each k and mean reciprocal rank, to 4 decimals."""
    means = [F.round(F.avg(f"hit_at_{k}"), 4).alias(f"recall_at_{k}") for k in ks]
    return (scores.groupBy(*by) if by else scores).agg(F.count(F.lit(1)).alias("n"), *means, F.round(F.avg("rr"), 4).alias("mrr"))


def summary(cases: DataFrame, pages: DataFrame, files: DataFrame, aliases: DataFrame, tolerance: int = 1) -> DataFrame:
    """One row: n, page_tolerance, duplicate_groups (distinct canonical names), and the scores of pages and of files under ``page_`` and ``file_``.

    ``pages`` and ``files`` are hits (query_id, rank) of the two kinds.
    """
    of_pages = family(case_scores(cases, pages, PAGE_KS), PAGE_KS)
    of_files = family(case_scores(cases, files, FILE_KS), FILE_KS).drop("n")
    groups = aliases.agg(F.countDistinct("canonical").alias("duplicate_groups"))
    both = of_pages.select("n", *[F.col(c).alias(f"page_{c}") for c in of_pages.columns[1:]]).crossJoin(of_files.select(*[F.col(c).alias(f"file_{c}") for c in of_files.columns]))
    return both.crossJoin(groups).withColumn("page_tolerance", F.lit(tolerance))  # one row each


def never_retrieved(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """(file): truth files that no query of the run retrieved."""
    return truth.select("file").distinct().join(predicted.select("file").distinct(), "file", "left_anti")


def weighted_mrr(groups: DataFrame, label: str, without: list[str]) -> DataFrame:
    """(label or 'total', mrr): mean reciprocal rank weighted by the number of cases, for each label and for all but ``without``."""
    use = groups.where(~F.col(label).isin(*without)) if without else groups
    out = use.groupingSets([[label], []], label).agg((F.sum(F.col("mrr") * F.col("n")) / F.sum("n")).alias("mrr"))
    return out.select(F.coalesce(label, F.lit("total")).alias("label"), F.round("mrr", 4).alias("mrr"))


def compare_runs(a: DataFrame, b: DataFrame, label: str) -> DataFrame:
    """(label, mrr_a, mrr_b, delta, state): two runs by label; a label that the other run lacks is reported, not dropped."""
    x, y = a.select(label, F.col("mrr").alias("mrr_a")), b.select(label, F.col("mrr").alias("mrr_b"))
    return x.join(y, label, "full").select(
        label, "mrr_a", "mrr_b", F.round(F.col("mrr_b") - F.col("mrr_a"), 4).alias("delta"),
        F.when(F.col("mrr_a").isNull(), "only_b").when(F.col("mrr_b").isNull(), "only_a").otherwise("both").alias("state"),
    )


def short_cases(cases: DataFrame, max_tokens: int = 3) -> DataFrame:
    """(item_id, query, long_query, relevant_pages): each case with the query of the first ``max_tokens`` words of its own.

    Paired by id, so the two lists can't slip against each other.
    """
    short = F.array_join(F.slice(F.split(F.trim(F.regexp_replace("query", r"\s+", " ")), " "), 1, max_tokens), " ")
    return cases.where(F.col("query").isNotNull()).select("item_id", short.alias("query"), F.col("query").alias("long_query"), F.size("relevant_pages").alias("n_pages"))


def truth_union(cases: DataFrame) -> DataFrame:
    """(item_id, files): the files named by a case and those of its pages, each once, in order; pages stand in where none are named."""
    of_pages = F.transform(F.coalesce("relevant_pages", F.array().cast("array<string>")), lambda r: F.substring_index(r, "#", 1))
    return cases.select("item_id", F.array_union(F.coalesce("relevant_files", F.array().cast("array<string>")), of_pages).alias("files"))
