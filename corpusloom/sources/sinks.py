"""Writing results, telemetry and caches."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def append_telemetry(rows: DataFrame, root: str) -> None:
    """Append requests as JSON lines, one folder a month of their time; rows without one go to the null month."""
    month = F.date_format(F.timestamp_millis("ts"), "yyyy-MM")
    rows.withColumn("month", month).write.mode("append").partitionBy("month").json(root)


def purge_months(spark: SparkSession, root: str, months: int, now: str) -> list[str]:
    """Delete the months whose last day lies more than ``months`` times 31 days before ``now`` ("yyyy-MM-dd"); 0 deletes none. Returns what was deleted.

    The rule is that of ``telemetry.retained_months``; rows without a time are never purged.
    """
    if months <= 0:
        return []
    today = dt.date.fromisoformat(now)
    path, fs = _at(spark, root)
    gone = []
    for s in fs.listStatus(path):
        name = s.getPath().getName()
        if name.startswith("month=") and name[6:10].isdigit():
            y, m = map(int, name[6:].split("-"))
            last = dt.date(y + m // 12, m % 12 + 1, 1) - dt.timedelta(days=1)
            if (today - last).days > 31 * months:
                fs.delete(s.getPath(), True)
                gone.append(name[6:])
    return sorted(gone)


def _at(spark: SparkSession, root: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def cache_key(file_hash: Column, options: Column) -> Column:
    """Key of a cached extraction: the file's hash and eight digits of its options'."""
    return F.concat(file_hash, F.lit("-"), F.substring(F.sha1(options.cast("binary")), 1, 8))


def cached(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The cache as a table of ``schema``, empty before the first put."""
    path, fs = _at(spark, root)
    return spark.read.schema(schema).parquet(root) if fs.exists(path) else spark.createDataFrame([], schema)


def fill_cache(wanted: DataFrame, root: str, schema: str, key: str, make) -> DataFrame:
    """Rows of the cache for the wanted keys; those it lacks are made from ``wanted`` by ``make`` and appended first."""
    spark = wanted.sparkSession
    lacking = wanted.join(cached(spark, root, schema).select(key).distinct(), key, "left_anti")
    make(lacking).write.mode("append").parquet(root)
    return cached(spark, root, schema).join(wanted.select(key).distinct(), key, "left_semi")


def remove_cached(gone: DataFrame, root: str, schema: str, key: str) -> int:
    """Drop the rows of the keys in ``gone`` from the cache; returns how many rows that were. The rest is written beside it and then takes its place."""
    spark = gone.sparkSession
    all_ = cached(spark, root, schema)
    kept = all_.join(gone.select(key).distinct(), key, "left_anti")
    n = all_.count() - kept.count()
    if n:
        kept.write.mode("overwrite").parquet(f"{root}.new")
        path, fs = _at(spark, root)
        fs.delete(path, True)
        if not fs.rename(_at(spark, f"{root}.new")[0], path):
            raise OSError(f"could not put the new cache in place of {root}")
    return n


def clear_cache(spark: SparkSession, root: str) -> bool:
    """Delete the whole cache; False if there was none."""
    path, fs = _at(spark, root)
    return fs.delete(path, True)


def ensure_collection(points: DataFrame, vector: str, dim: int) -> DataFrame:
    """``points`` as they are, failing at the first vector that is not of ``dim`` numbers; null vectors fail too."""
    bad = F.raise_error(F.concat(F.lit(f"vector of another length than {dim}: "), F.coalesce(F.size(vector).cast("string"), F.lit("null"))))
    return points.withColumn(vector, F.when(F.coalesce(F.size(vector) == dim, F.lit(False)), F.col(vector)).otherwise(bad.cast(points.schema[vector].dataType)))


def delete_by_file(points: DataFrame, path: str) -> tuple[DataFrame, int]:
    """The points without those of one file, and how many it had; an unknown or null path changes nothing."""
    mine = F.coalesce(F.col("file_path") == F.lit(path), F.lit(False))
    return points.where(~mine), points.where(mine).count()


def drop_topic(points: DataFrame, state: DataFrame, topic: str) -> tuple[DataFrame, DataFrame]:
    """Points and state without a topic, whose collection is then empty."""
    return tuple(d.where(~F.col("topic").eqNullSafe(topic)) for d in (points, state))


def write_scores(scores: DataFrame, path: str, form: str = "json") -> None:
    """A run's scores as JSON lines or as CSV with a header, in one file: a few rows."""
    writer = scores.coalesce(1).write.mode("overwrite")
    writer.json(path) if form == "json" else writer.option("header", True).csv(path)


def backfill(rows: DataFrame, derived: dict[str, Column], path: str, text: str = "text", sample: int = 25) -> dict[str, int]:
    """Copy a table with further columns; fails unless every row came over and a sample of those with text has them.

    Returns how many rows there are and how many have no text.
    """
    spark = rows.sparkSession
    rows.withColumns(derived).write.mode("overwrite").parquet(path)
    out = spark.read.parquet(path)
    n, copied, empty = rows.count(), out.count(), rows.where(F.coalesce(F.trim(text), F.lit("")) == "").count()
    lacking = out.where(F.trim(text) != "").limit(sample)
    bad = lacking.where(" OR ".join(f"`{c}` IS NULL" for c in derived)).count() if derived else 0
    if n != copied or bad:
        raise ValueError(f"{copied} of {n} rows copied, {bad} of the sample without the new columns")
    return {"rows": n, "empty": empty}
