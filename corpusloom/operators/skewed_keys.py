"""Per-key results when a few keys hold most of the rows.

Fragment-replicate by estimated load. A first, map-side combined count gives every key's load. The
keys heavier than a fraction of one task's share, of which there can only be a bounded number, are
split into shards in proportion to their load, and the shards are packed into tasks, largest first.
All lighter keys are hashed over the tasks. Rows go to the very task their shard is packed on; partial
results are made there per (key, shard, page) and merged per key. For joins a matching side is replicated
only to the shards of its key.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.unicode import file_key
from corpusloom.session import table

#: A key counts as heavy from this fraction of one task's fair share; at most tasks / HEAVY keys can.
HEAVY = 0.5


@dataclass(frozen=True)
class Placement:
    """Where the heavy keys go: key -> the tasks of its shards, one shard each; and the loads' total weight if they have one."""

    tasks: int
    total: int
    shards: dict[str, list[int]]
    weight: int = 0


def key_loads(df: DataFrame, key: str) -> DataFrame:
    """(key, load) for each non-null key. Counts combine before the shuffle, so a heavy key is one row per map task."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("load"))


def pack(heavy: list[tuple[str, int]], total: int, tasks: int) -> dict[str, list[int]]:
    """Shards of each heavy key and their tasks, by largest-first packing onto the least loaded task."""
    share = max(1.0, total / tasks)
    pieces = []
    for key, load in heavy:
        n = min(tasks, max(1, -(-int(load) // max(1, int(share * HEAVY)))))
        pieces += [(load / n, key, i) for i in range(n)]
    pieces.sort(key=lambda p: (-p[0], p[1], p[2]))
    rest = (total - sum(load for _, load in heavy)) / tasks
    heap = [(rest, t) for t in range(tasks)]
    out: dict[str, list[int]] = {}
    for load, key, _ in pieces:
        used, t = heapq.heappop(heap)
        out.setdefault(key, []).append(t)
        heapq.heappush(heap, (used + load, t))
    return out


def place(loads: DataFrame, key: str, tasks: int) -> Placement:
    """Bring the heavy keys, at most ``tasks / HEAVY`` rows, to the driver and place them."""
    total, weight = (x or 0 for x in loads.agg(F.sum("load"), F.sum("weight") if "weight" in loads.columns else F.lit(0)).first())
    if not total:
        return Placement(tasks, 0, {})
    heavy = loads.where(F.col("load") >= F.lit(HEAVY * total / tasks)).select(key, "load").collect()
    return Placement(tasks, total, pack([(r[0], r[1]) for r in heavy], total, tasks), weight)


def _assignments(spark: SparkSession, p: Placement) -> DataFrame:
    rows = [(k, len(ts), ts) for k, ts in sorted(p.shards.items())]
    return spark.createDataFrame(rows, "_k string, _n int, _tasks array<int>")


def shard(df: DataFrame, key: str, placement: Placement, salt: Column) -> DataFrame:
    """Add ``_shard``, ``_task`` to ``df``; rows with a null key are dropped, having no per-key result.

    ``salt`` spreads one key's rows over its shards and must not depend on the key alone.
    """
    df = df.where(F.col(key).isNotNull())
    heavy = F.broadcast(_assignments(df.sparkSession, placement))  # at most tasks / HEAVY rows
    s = F.pmod(F.xxhash64(salt), F.coalesce("_n", F.lit(1))).cast("int")
    return (
        df.join(heavy, F.col(key) == F.col("_k"), "left")
        .withColumn("_shard", s)
        .withColumn("_task", F.coalesce(F.get("_tasks", F.col("_shard")), F.pmod(F.xxhash64(key), F.lit(placement.tasks)).cast("int")))
        .drop("_k", "_n", "_tasks")
    )


def packed(df: DataFrame, key: str, placement: Placement, salt: Column) -> DataFrame:
    """``shard``, each row in the partition that is its ``_task``."""
    return shard(df, key, placement, salt).repartitionById(placement.tasks, F.col("_task"))


def replicate(side: DataFrame, key: str, placement: Placement) -> DataFrame:
    """A matching side, one copy for each shard of its key, with ``_shard``; light keys have one copy."""
    heavy = F.broadcast(_assignments(side.sparkSession, placement))
    copies = F.sequence(F.lit(0), F.coalesce("_n", F.lit(1)) - 1)
    return side.join(heavy, F.col(key) == F.col("_k"), "left").withColumn("_shard", F.explode(copies)).drop("_k", "_n", "_tasks")


def skew_join(left: DataFrame, right: DataFrame, key: str, placement: Placement, salt: Column) -> DataFrame:
    """Equi-join of a skewed ``left`` with ``right``: left rows go to one shard, right rows to all shards of their key."""
    a = shard(left, key, placement, salt).drop("_task")
    b = replicate(right, key, placement).withColumnRenamed(key, "_rk").withColumnRenamed("_shard", "_rs")
    return a.join(b, (F.col(key) == F.col("_rk")) & (F.col("_shard") == F.col("_rs"))).drop("_rk", "_rs", "_shard")


def per_key(df: DataFrame, key: str, page: str, request: Column, at: Column, salt: Column, tasks: int | None = None, weight: Column | None = None) -> DataFrame:
    """Per key: rows, distinct pages, latest request with its time, and the number of shards it took.

    Columns key_value, n_rows, n_pages, last_request, last_at, n_shards, total (rows with a key). Pages
    are reduced to (key, page) pairs before they are counted, so no task holds one key's whole set; null
    pages are not counted. The latest request is the one with the greatest time, ties the greater id;
    where all times are null it is null. A row counts as ``weight`` rows, 1 by default. Empty input gives no rows.
    """
    spark = df.sparkSession
    tasks = tasks or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    weight = F.lit(1) if weight is None else weight
    base = df.select(F.col(key).alias("key_value"), F.col(page).alias("page"), request.alias("request"), at.alias("at"), salt.alias("salt"), weight.cast("long").alias("weight"))
    loads = base.where(F.col("key_value").isNotNull()).groupBy("key_value").agg(F.count(F.lit(1)).alias("load"), F.sum("weight").alias("weight"))
    placement = place(loads, "key_value", tasks)
    rows = packed(base, "key_value", placement, F.col("salt"))
    # One row per (key, shard, page) in the task that the shard is packed on, without another exchange.
    first = rows.groupBy("_task", "key_value", "_shard", "page").agg(
        F.sum("weight").alias("n"), F.max(F.when(F.col("at").isNotNull(), F.struct("at", "request"))).alias("last")
    )
    second = first.groupBy("key_value", "page").agg(F.sum("n").alias("n"), F.max("last").alias("last"), F.max("_shard").alias("s"))
    out = second.groupBy("key_value").agg(
        F.sum("n").alias("n_rows"), F.count("page").alias("n_pages"), F.max("last").alias("last"), (F.max("s") + 1).alias("n_shards")
    )
    return out.select(
        "key_value", "n_rows", "n_pages", F.col("last.request").alias("last_request"), F.col("last.at").alias("last_at"), "n_shards", F.lit(placement.weight).cast("long").alias("total")
    )


def topic_results(retrievals: DataFrame) -> DataFrame:
    """Per exact topic spelling; pages are those of the retrieved chunks of each request (file and page)."""
    # A request without chunks still counts: its page is null.
    pages = F.transform("retrieved", lambda r: F.concat_ws("#", r["file_path"], r["page"].cast("string")))
    pages = F.array_distinct(F.coalesce(pages, F.array().cast("array<string>")))
    rows = retrievals.select("topic", "retrieval_id", "ts", F.posexplode_outer(pages).alias("place", "page"))
    first = F.coalesce(F.col("place"), F.lit(0)) == 0  # a request counts once, at its first page
    return per_key(rows, "topic", "page", F.col("retrieval_id"), F.col("ts"), F.col("retrieval_id"), weight=first.cast("int"))


def named_citations(citations: DataFrame) -> DataFrame:
    return citations.withColumn("name", file_key(F.col("file")))


def file_results(citations: DataFrame) -> DataFrame:
    """Per file name; the latest request is the greatest retrieval_id that cites the file."""
    rows = named_citations(citations)
    return per_key(rows, "name", "page", F.col("retrieval_id"), F.col("retrieval_id"), F.struct("retrieval_id", "cite_no", "chunk_id"))


def dominant(results: DataFrame, field: str, share_percent: int = 4) -> DataFrame:
    """Keys with at least ``share_percent`` % of the rows that have a key."""
    return results.where(F.col("n_rows") * 100 >= F.col("total") * share_percent).select(F.lit(field).alias("field"), "key_value")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    topics = dominant(topic_results(table(spark, sf_dir, "retrievals")), "topic")
    return topics.unionByName(dominant(file_results(table(spark, sf_dir, "citations")), "file"))


def p3_topic_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topic_results(table(spark, sf_dir, "retrievals")).drop("n_shards", "total")


def p3_file_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_results(table(spark, sf_dir, "citations")).drop("n_shards", "total")


def p3_pages_beyond(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key_value, n_rows, n_beyond): citations of each extracted file, and those of pages beyond its end.

    A join of the skewed citations with the files' page counts, replicated to the shards of their names. Several
    extractions of one name count with the most pages; names that were never extracted, and null pages, are not counted as beyond.
    """
    rows = named_citations(table(spark, sf_dir, "citations")).select("name", "page", "retrieval_id", "cite_no")
    ends = table(spark, sf_dir, "extractions").select(file_key(F.col("file_path")).alias("name"), "total_pages").groupBy("name").agg(F.max("total_pages").alias("last"))
    placement = place(key_loads(rows, "name"), "name", max(2, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    met = skew_join(rows, ends.where(F.col("name").isNotNull()), "name", placement, F.struct("retrieval_id", "cite_no"))
    return met.groupBy(F.col("name").alias("key_value")).agg(F.count(F.lit(1)).alias("n_rows"), F.count(F.when(F.col("page") > F.col("last"), 1)).alias("n_beyond"))
