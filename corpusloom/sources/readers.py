"""Reading the files the pipeline works with."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TELEMETRY = (
    "source string, query string, original_language string, translated_query string, topic string, mode string, generative boolean, dense_k int, bm25_k int, final_topk int, "
    "retrieved array<struct<file_path:string,page:int,chunk_id:int>>, ts bigint"
)
GOLDEN = "query string, topic string, relevant_pages array<string>, relevant_files array<string>"
STATE_ENTRY = "struct<hash:string,timestamp:string,topic:string,status:string,size:bigint,mtime_ns:bigint,error:string,retry_count:int>"


def _existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """The paths, globs expanded, that exist."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        found = path.getFileSystem(conf).globStatus(path)
        out += [str(s.getPath()) for s in found] if found else []
    return out


def documents_on_disk(spark: SparkSession, root: str, extension: str = "pdf", content: bool = False) -> DataFrame:
    """(path, length, modificationTime[, content]): files below ``root`` by extension in any letter case. Without ``content`` none is read."""
    glob = "*." + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in extension)
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return rows if content else rows.select("path", "length", "modificationTime")


def file_hashes(files: DataFrame, bits: int = 0) -> DataFrame:
    """(path, hash) of ``content``: md5, or sha-2 of that many bits."""
    digest = F.sha2("content", bits) if bits else F.md5("content")
    return files.select("path", digest.alias("hash"))


def telemetry(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Rows of JSON-lines files; missing files, blank lines and malformed lines are passed over. Absent fields are null."""
    found = _existing(spark, paths)
    if not found:
        return spark.createDataFrame([], TELEMETRY)
    rows = spark.read.schema(f"{TELEMETRY}, _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(found)
    return rows.where(F.col("_corrupt").isNull()).drop("_corrupt")


def malformed_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(value): lines of those files that are neither blank nor JSON objects."""
    found = _existing(spark, paths)
    lines = spark.read.text(found) if found else spark.createDataFrame([], "value string")
    return lines.where((F.trim("value") != "") & F.try_parse_json("value").isNull())


def golden_cases(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Golden cases of JSON arrays; where the files are not named they follow from the pages, in order and once."""
    rows = spark.read.schema(GOLDEN).option("multiLine", True).json(paths)
    derived = F.array_distinct(F.transform("relevant_pages", lambda r: F.substring_index(r, "#", 1)))
    return rows.withColumn("relevant_files", F.coalesce(F.when(F.size("relevant_files") > 0, F.col("relevant_files")), derived))


def processing_state(spark: SparkSession, path: str) -> DataFrame:
    """(path, status, hash, topic, size, mtime_ns, error, retry_count, timestamp) of a state file, else of its ``.bak``, else none."""
    schema = f"processed map<string,{STATE_ENTRY}>, failed map<string,{STATE_ENTRY}>, _corrupt string"
    for p in (path, f"{path}.bak"):
        found = _existing(spark, [p])
        if not found:
            continue
        state = spark.read.schema(schema).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(found)
        if any(r["_corrupt"] is not None for r in state.take(1)):  # one document
            continue
        parts = [state.select(F.explode(c).alias("path", "e"), F.lit(s).alias("kind")) for c, s in (("processed", "success"), ("failed", "failed"))]
        rows = parts[0].unionByName(parts[1])
        return rows.select("path", F.coalesce("e.status", "kind").alias("status"), "e.hash", "e.topic", "e.size", "e.mtime_ns", "e.error", F.coalesce("e.retry_count", F.lit(0)).alias("retry_count"), "e.timestamp")
    return spark.createDataFrame([], "path string, status string, hash string, topic string, size bigint, mtime_ns bigint, error string, retry_count int, timestamp string")


def heartbeat(spark: SparkSession, path: str) -> DataFrame:
    """(at, context) of a heartbeat file: seconds on the first line, context on the second; no row if it can't be read."""
    found = _existing(spark, [path])
    text = spark.read.text(found, wholetext=True) if found else spark.createDataFrame([], "value string")
    lines = F.split("value", "\n")
    return text.select(F.trim(F.get(lines, F.lit(0))).try_cast("double").alias("at"), F.coalesce(F.get(lines, F.lit(1)), F.lit("")).alias("context")).where("at IS NOT NULL")


@dataclass(frozen=True)
class Settings:
    """Depths, limits and switches, each with its default; ``read`` takes them from a mapping of texts."""

    final_topk: int = 5
    dense_k: int = 20
    bm25_k: int = 20
    per_file: int = 3
    rrf_k: int = 60
    short_query: int = 4
    soft_token_limit: int = 4000
    chunk_tokens: int = 256
    translate: bool = False

    @classmethod
    def read(cls, env: dict[str, str]) -> Settings:
        """Blank, absent and unreadable values leave the default; switches are on for 1, true, yes and on."""
        got: dict[str, int | bool] = {}
        for f in fields(cls):
            raw = env.get(f.name.upper(), "").strip()
            if not raw:
                continue
            if f.type == "bool":
                got[f.name] = raw.lower() in ("1", "true", "yes", "on")
            elif raw.lstrip("+-").isdigit():
                got[f.name] = int(raw)
        return cls(**got)
