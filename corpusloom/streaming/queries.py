"""Structured Streaming: the same answers over files as they arrive.

Each stream reads the files there are (``availableNow``), keeps its state in a checkpoint of the shared
folder, and writes to a sink that is read back. A later run with the same ``root`` takes up new files
only. Files come in any order of time, so no result depends on a watermark: nothing is dropped as late,
and the state, kept on disk, grows with the distinct requests, the sessions, and the days and arms.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from corpusloom.operators.telemetry import arm
from corpusloom.session import shared_dir, table


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table's files as a stream, under the table's own schema."""
    schema = table(spark, sf_dir, name).schema
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 8)
    if fs.exists(path) and fs.getFileStatus(path).isFile():
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return reader.parquet(f"{sf_dir}/{name}.parquet")


#: State that no watermark bounds doesn't fit in memory.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _started(writer: DataStreamWriter, spark: SparkSession) -> StreamingQuery:
    """The query, started with its state on disk; the session's own setting is left as it was."""
    key, provider = STATE_STORE
    before = spark.conf.get(key)
    spark.conf.set(key, provider)
    try:
        return writer.start()
    finally:
        spark.conf.set(key, before)


def run_to_end(stream: DataFrame, mode: str, root: str | None = None) -> DataFrame:
    """Run until all files there are have been taken in, and read the sink back.

    ``root`` keeps the checkpoint and the sink: a later run with the same one takes in new files only. By default both are
    of this run alone.
    """
    spark = stream.sparkSession
    root = root or f"{shared_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{root}/checkpoint")
    if mode == "append":
        _started(writer.outputMode("append").format("parquet").option("path", f"{root}/out"), spark).awaitTermination()
    else:

        def publish(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{root}/out")  # a batch repeated after a failure writes the same

        _started(writer.outputMode("complete").foreachBatch(publish), spark).awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def stream_ingest(spark: SparkSession, sf_dir: str, root: str | None = None) -> DataFrame:
    """New elements with text, appended as they arrive."""
    rows = _stream(spark, sf_dir, "elements").where(F.length(F.trim("text")) > 0).select("element_id", "file_path", F.char_length("text").alias("chars"))
    return run_to_end(rows, "append", root)


def stream_arm_counts(spark: SparkSession, sf_dir: str, root: str | None = None) -> DataFrame:
    """Requests per day and arm by event time; rows without a time have no window."""
    rows = _stream(spark, sf_dir, "retrievals").select(F.timestamp_millis("ts").alias("at"), arm().alias("arm"))
    counts = rows.where("at IS NOT NULL").withWatermark("at", "2 days").groupBy(F.window("at", "1 day"), "arm").agg(F.count(F.lit(1)).alias("n"))
    out = counts.select(F.date_format(F.col("window.start"), "yyyy-MM-dd").alias("day"), "arm", "n")
    return run_to_end(out, "complete", root)


def stream_dedupe(spark: SparkSession, sf_dir: str, root: str | None = None) -> DataFrame:
    """Requests logged twice under a new id, once, however far apart in time their files come."""
    rows = _stream(spark, sf_dir, "retrievals").where("ts IS NOT NULL").select(F.timestamp_millis("ts").alias("at"), "query", "topic", "mode")
    once = rows.dropDuplicates(["at", "query", "topic", "mode"])
    return run_to_end(once.select(F.unix_millis("at").alias("ts"), "query", "topic", "mode"), "append", root)


def stream_sessions(spark: SparkSession, sf_dir: str, root: str | None = None) -> DataFrame:
    """Sessions of each user's events that lie less than six hours apart: events, and whole seconds they span.

    An event that comes late joins, or joins up, the sessions there are.
    """
    rows = _stream(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("at"))
    s = rows.groupBy("user_id", F.session_window("at", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("a"), F.max("at").alias("b"))
    return run_to_end(s.select("user_id", "n", F.floor((F.unix_micros("b") - F.unix_micros("a")) / 1_000_000).alias("seconds")), "complete", root)


ORACLE = {
    "stream_ingest": "SELECT element_id, file_path, length(text) AS chars FROM elements WHERE length(trim(text)) > 0",
    "stream_arm_counts": "SELECT strftime(make_timestamp(ts * 1000), '%Y-%m-%d') AS day, CASE WHEN source IS NOT DISTINCT FROM 'retrieve' THEN 'retrieve' ELSE 'chat' END AS arm, count(*) AS n FROM retrievals WHERE ts IS NOT NULL GROUP BY ALL",
    "stream_dedupe": "SELECT DISTINCT ts, query, topic, mode FROM retrievals WHERE ts IS NOT NULL",
    "stream_sessions": """WITH e AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) < 21600000000 THEN 0 ELSE 1 END AS s FROM events),
g AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, count(*) AS n, ((epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000)::BIGINT AS seconds FROM g GROUP BY user_id, k""",
}


def queries() -> dict:
    return {"stream_ingest": stream_ingest, "stream_arm_counts": stream_arm_counts, "stream_dedupe": stream_dedupe, "stream_sessions": stream_sessions}
