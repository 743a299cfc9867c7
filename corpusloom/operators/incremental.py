"""Processing only new or changed records.

The target is the state: every output row carries the key and the version of the source record it
was made from, so the next run's input is the anti-join of the source against the target on
(key, version). There is no separate bookmark that could run ahead of, or behind, the output. A run's
output becomes visible through one atomic rename of a numbered manifest; a run that breaks off before
that leaves the previous version in force, and the next run finds the same records again.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.unicode import nfc
from corpusloom.session import cut, shared_dir, table

ABSENT = "~absent"


def latest_by(df: DataFrame, keys: list[str], order: list[Column], keep: list[str]) -> DataFrame:
    """One row per key: the one greatest in ``order`` (nulls least), with the columns ``keep``.

    An aggregate with map-side combine, not a window: a key that holds a third of all rows reaches
    its reducer as one row per map task. Ties in ``order`` fall to the greatest ``keep`` values.
    """
    value = F.struct(*[F.col(c) for c in keep])
    rank = F.struct(*order, *[F.col(c) for c in keep])
    out = df.groupBy(*keys).agg(F.max_by(value, rank).alias("_v"))
    return out.select(*keys, *[F.col("_v")[c].alias(c) for c in keep])


def pending(source: DataFrame, target: DataFrame, key: str, version: str) -> DataFrame:
    """Source rows whose (key, version) the target does not hold.

    ``source`` and ``target`` have at most one row per key. A source row without version passes only
    when the target has no row of its key. Null keys match nothing, so such rows are always pending.
    Only the two columns of the target are read, under private names, so that further columns of equal
    names on either side do no harm.
    """
    seen = target.select(F.col(key).alias("_target_key"), F.col(version).alias("_target_version"))
    hit = (F.col(key) == F.col("_target_key")) & (F.col(version).isNull() | (F.col(version) == F.col("_target_version")))
    return source.join(seen, hit, "left_anti")


def attempt_time(text: Column) -> Column:
    """Attempt time from ISO text in any form; without an offset it is UTC; unreadable text gives null."""
    t = F.trim(text)
    zoned = t.rlike(r"(?i)(z|utc|gmt|[+-]\d{2}:?\d{2})$")
    return F.when(zoned, F.try_to_timestamp(t)).otherwise(F.try_to_timestamp(F.concat(t, F.lit("Z"))))


def file_target(file_state: DataFrame) -> DataFrame:
    """The state as target: per canonical path the hash of the latest successful attempt.

    Latest by time of attempt, whatever the order of arrival; ties go to the later arrival, then the
    greater state_id. Failed and unfinished attempts leave the state as it was. A success without a
    hash stands for no version and so never matches a listed one. A null path is dropped: it names
    no file. Letter case and outer blanks of a hash mean nothing.
    """
    done = file_state.where((F.lower(F.trim("status")) == "success") & F.col("path").isNotNull()).select(
        nfc("path").alias("path_key"), "state_id", "logged_at", attempt_time(F.col("timestamp")).alias("at"), _hash("hash").alias("version")
    )
    return latest_by(done, ["path_key"], [F.col("at"), F.col("logged_at"), F.col("state_id")], ["version"])


def _hash(name: str) -> Column:
    h = F.lower(F.trim(name))
    return F.when(h != "", h)


def file_source(file_listing: DataFrame) -> DataFrame:
    """The latest sighting of each canonical path, with the path as that sighting spells it.

    Ties of ``seen_at`` go to the greater listing_id. Rows with a null path are dropped.
    """
    seen = file_listing.where(F.col("path").isNotNull()).select(
        nfc("path").alias("path_key"), "path", _hash("hash").alias("version"), "seen_at", "listing_id", "topic", "size"
    )
    return latest_by(seen, ["path_key"], [F.col("seen_at"), F.col("listing_id")], ["path", "version", "topic", "size"])


def new_or_changed(file_state: DataFrame, file_listing: DataFrame) -> DataFrame:
    """Files the next run must process: (path_key, path, version, topic, size).

    A file is due if its latest sighting has a hash that is not the one of its latest success, or if it
    never succeeded. A file that could not be read (null hash) counts as unchanged once it has
    succeeded, and as new before. Empty inputs give no rows.
    """
    return pending(file_source(file_listing), file_target(file_state), "path_key", "version")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return new_or_changed(table(spark, sf_dir, "file_state"), table(spark, sf_dir, "file_listing")).select("path")


def p2_stored_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paths of ``p2_found``, by a run against a stored target: the successes are published, then the listing is advanced over them."""
    root = f"{shared_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}/target-{uuid.uuid4().hex}"
    schema = "path_key string, version string, path string"
    done = file_target(table(spark, sf_dir, "file_state")).withColumn("path", F.col("path_key"))
    advance(done, root, schema, "path_key", "version", lambda due: due)
    source = file_source(table(spark, sf_dir, "file_listing"))
    seen: list[DataFrame] = []

    def process(due: DataFrame) -> DataFrame:
        seen.append(due.select("path"))
        return due

    advance(source, root, schema, "path_key", "version", process)
    return seen[0]


# ---- a stored target ---------------------------------------------------------------------------
#
# A version of the target is a numbered manifest that names, for each bucket of keys, the folder of its output rows
# and the folder of its state: (key, version, n_rows) of each record processed, whether or not it gave
# rows. A manifest appears by a rename that fails where one of its number stands already.

BUCKETS = 64


class ConcurrentRun(RuntimeError):
    """Another run published the version that this one was about to publish; run again."""


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _manifest(root: str, number: int) -> str:
    return f"{root}/manifest-{number:012d}.json"


def current_version(spark: SparkSession, root: str) -> int:
    """The number of the published version, 0 before the first."""
    jvm, fs = _fs(spark, root)
    folder = jvm.org.apache.hadoop.fs.Path(root)
    if not fs.exists(folder):
        return 0
    names = [f.getPath().getName() for f in fs.listStatus(folder)]
    return max((int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json")), default=0)


def _read_manifest(spark: SparkSession, root: str, number: int) -> dict:
    if not number:
        return {"data": {}, "state": {}}
    jvm, fs = _fs(spark, root)
    stream = fs.open(jvm.org.apache.hadoop.fs.Path(_manifest(root, number)))
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def _write_manifest(spark: SparkSession, root: str, number: int, content: dict) -> None:
    jvm, fs = _fs(spark, root)
    hadoop = jvm.org.apache.hadoop.fs
    uri = hadoop.Path(root).toUri()
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    context = hadoop.FileContext.getFileContext(uri, conf) if uri.getScheme() else hadoop.FileContext.getLocalFSFileContext(conf)
    staged = hadoop.Path(root, f"staged-{uuid.uuid4().hex}")
    stream = fs.create(staged, False)
    stream.write(bytearray(json.dumps(content).encode()))
    stream.close()
    try:
        context.rename(staged, hadoop.Path(_manifest(root, number)), spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0))
    except Exception as e:
        fs.delete(staged, False)
        if "FileAlreadyExists" in str(e) or "already exists" in str(e):
            raise ConcurrentRun(f"version {number} of {root} was published by another run") from e
        raise


def _read(spark: SparkSession, folders: list[str], schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(*sorted(folders)) if folders else spark.createDataFrame([], schema)


def read_target(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The rows of the published version; an empty table of ``schema`` before the first."""
    return _read(spark, list(_read_manifest(spark, root, current_version(spark, root))["data"].values()), schema)


def _bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(BUCKETS)).cast("int")


def _write(df: DataFrame, folder: str, key: str, touched: list[int]) -> dict[str, str]:
    """Write ``df`` by bucket of ``key``; the folder of each touched bucket that has rows."""
    spark = df.sparkSession
    df.withColumn("_bucket", _bucket(key)).repartition("_bucket").write.partitionBy("_bucket").parquet(folder)
    jvm, fs = _fs(spark, folder)
    return {str(b): f"{folder}/_bucket={b}" for b in touched if fs.exists(jvm.org.apache.hadoop.fs.Path(folder, f"_bucket={b}"))}


def publish(df: DataFrame, root: str, key: str, version: str) -> int:
    """Make ``df`` the whole target, its own rows being the state; returns the number of the version."""
    spark = df.sparkSession
    was = current_version(spark, root)
    name = uuid.uuid4().hex
    state = df.where(F.col(key).isNotNull()).groupBy(key, version).agg(F.count(F.lit(1)).alias("n_rows"))
    every = list(range(BUCKETS))
    content = {"data": _write(df.where(F.col(key).isNotNull()), f"{root}/data-{name}", key, every), "state": _write(state, f"{root}/state-{name}", key, every)}
    _write_manifest(spark, root, was + 1, content)
    return was + 1


def advance(source: DataFrame, root: str, schema: str, key: str, version: str, process) -> DataFrame:
    """One run: process what is pending and publish the target with the old rows of the processed keys replaced.

    ``process`` maps the pending rows to output rows of ``schema``, which must keep ``key`` and
    ``version``; it may give none or several rows for a record, which counts as processed all the same. Source rows with a
    null key can't be tracked and are left out; a key must occur once. Only buckets with pending keys are written anew. Readers see
    the old version or the new one, whole. Running again after success finds nothing; running again after
    a failure finds the same rows; of two runs at once the second to finish raises ConcurrentRun and
    publishes nothing. Returns the target as published.
    """
    spark = source.sparkSession
    was = current_version(spark, root)
    manifest = _read_manifest(spark, root, was)
    kind = dict(source.dtypes)
    state_schema = f"`{key}` {kind[key]}, `{version}` {kind[version]}, n_rows bigint"
    state = _read(spark, list(manifest["state"].values()), state_schema)
    due = cut(pending(source.where(F.col(key).isNotNull()), state, key, version))
    made = process(due)
    touched = sorted(r[0] for r in due.select(_bucket(key)).distinct().collect())  # at most BUCKETS
    if not touched:
        return read_target(spark, root, schema)
    done = due.select(F.col(key).alias("_due"))
    old = _read(spark, [manifest["data"][str(b)] for b in touched if str(b) in manifest["data"]], schema)
    kept = old.join(done, F.col(key) == F.col("_due"), "left_anti")
    name = uuid.uuid4().hex
    data = _write(kept.unionByName(made.select(*old.columns)), f"{root}/data-{name}", key, touched)
    fresh = _read(spark, list(data.values()), schema).groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("n_rows"))
    records = due.select(key, version).join(fresh, F.col(key) == F.col("_k"), "left").select(key, version, F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows"))
    before = _read(spark, [manifest["state"][str(b)] for b in touched if str(b) in manifest["state"]], state_schema)
    states = _write(before.join(done, F.col(key) == F.col("_due"), "left_anti").unionByName(records), f"{root}/state-{name}", key, touched)
    keep = {k: {b: f for b, f in manifest[k].items() if int(b) not in touched} for k in ("data", "state")}
    _write_manifest(spark, root, was + 1, {"data": keep["data"] | data, "state": keep["state"] | states})
    return read_target(spark, root, schema)
