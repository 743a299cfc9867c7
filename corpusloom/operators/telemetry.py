"""Telemetry of requests, and the state of files over their attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusloom.operators.incremental import attempt_time

MAX_RETRIES = 3
#: Characters that a context and a tracked name must share before they are compared.
GRAM = 8


def arm() -> Column:
    """The arm a request belongs to; rows without a source are chat."""
    return F.when(F.col("source").eqNullSafe("retrieve"), "retrieve").otherwise("chat")


def _pct(n: Column, of: Column) -> Column:
    return F.when(of > 0, F.round(100.0 * n / of, 2))


def arm_summary(rows: DataFrame) -> DataFrame:
    """One row per arm: requests, time span, empty contexts, what is known of the generative flag, result sizes, languages."""
    got = F.coalesce("retrieved", F.array().cast("array<struct<file_path:string,page:int,chunk_id:int>>"))
    rows = rows.select("*", arm().alias("arm"), F.size(got).alias("chunks"), F.size(F.array_distinct(F.transform(got, lambda r: r["file_path"]))).alias("files"))
    full = F.col("chunks") > 0
    foreign = F.coalesce("original_language", F.lit("en")) != "en"
    out = rows.groupBy("arm").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count_if(~full).alias("empty"),
        F.count("generative").alias("generative_known"), F.count_if(F.col("generative")).alias("generative_true"),
        F.round(F.avg(F.when(full, F.col("chunks"))), 4).alias("mean_chunks"), F.round(F.avg(F.when(full, F.col("files"))), 4).alias("mean_files"),
        F.count_if(F.col("translated_query").isNotNull() & (F.col("translated_query") != F.col("query"))).alias("translated"), F.count_if(foreign).alias("foreign"),
    )
    return out.withColumn("empty_pct", _pct(F.col("empty"), F.col("n"))).withColumn("generative_pct", _pct(F.col("generative_true"), F.col("generative_known")))


def arm_counts(rows: DataFrame, by: str) -> DataFrame:
    return rows.groupBy(arm().alias("arm"), F.col(by)).agg(F.count(F.lit(1)).alias("n"))


def dormant(rows: DataFrame, arm_col: str, at: str, stale_days: int) -> DataFrame:
    """(arm, last, days): arms whose last row lies at least ``stale_days`` whole days before the newest of all.

    Measured against the sample, not the clock. Arms without times are never dormant.
    """
    last = rows.where(F.col(at).isNotNull()).groupBy(F.col(arm_col).alias("arm")).agg(F.max(at).alias("last"))
    newest = last.agg(F.max("last").alias("newest"))
    days = F.floor((F.unix_micros(F.col("newest").cast("timestamp")) - F.unix_micros(F.col("last").cast("timestamp"))) / 86_400_000_000)
    return last.crossJoin(F.broadcast(newest)).withColumn("days", days.cast("long")).where(F.col("days") >= stale_days).select("arm", "last", "days")  # one row


def since(rows: DataFrame, ts: str, cutoff: int) -> DataFrame:
    """Rows not before the cutoff; rows without a time pass."""
    return rows.where(F.coalesce(F.col(ts), F.lit(cutoff)) >= cutoff)


def retained_months(rows: DataFrame, at: str, months: int, now: Column) -> DataFrame:
    """(month, n, keep): rows per month, and whether the month is within ``months`` times 31 days of ``now``; 0 keeps all."""
    per = rows.where(F.col(at).isNotNull()).groupBy(F.date_format(at, "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.max(at).alias("last"))
    keep = F.lit(True) if months <= 0 else F.datediff(now, F.col("last")) <= 31 * months
    return per.select("month", "n", keep.alias("keep"))


def attempts(file_state: DataFrame) -> DataFrame:
    """The log with the time of each attempt, in order of time, arrival and id within a path."""
    return file_state.select("path", "status", "hash", "topic", "error", "retry_count", "state_id", "logged_at", attempt_time(F.col("timestamp")).alias("at"))


def current_state(file_state: DataFrame) -> DataFrame:
    """(path, status, hash, topic, error, retries): latest attempt, and the failures since the last success.

    Aggregates only: the time of the last success, then failures after it.
    """
    a = attempts(file_state).where(F.col("path").isNotNull())
    order = F.struct("at", "logged_at", "state_id")
    last = a.groupBy("path").agg(F.max_by(F.struct("status", "hash", "topic", "error"), order).alias("v"), F.max(F.when(F.col("status") == "success", order)).alias("ok"))
    failures = a.where(F.col("status") == "failed").join(last.select(F.col("path").alias("_p"), "ok"), F.col("path") == F.col("_p"))
    after = failures.where(F.col("ok").isNull() | (F.struct("at", "logged_at", "state_id") > F.col("ok"))).groupBy(F.col("path").alias("_p")).agg(F.count(F.lit(1)).alias("retries"))
    return last.join(after, F.col("path") == F.col("_p"), "left").select("path", "v.status", "v.hash", "v.topic", F.substring("v.error", 1, 200).alias("error"), F.coalesce("retries", F.lit(0)).alias("retries"))


def scan_decision(listing: DataFrame, state: DataFrame) -> DataFrame:
    """(path, decision): what a scan does with each listed file.

    New files and failed ones under the retry limit are processed; failed ones at it are in quarantine; a
    processed file is processed again if its hash differs, an unreadable one counts as unchanged.
    ``listing`` has one row per path.
    """
    s = state.select(F.col("path").alias("_p"), "status", F.lower(F.trim("hash")).alias("_h"), "retries")
    h = F.lower(F.trim(F.col("hash")))
    out = (
        F.when(F.col("_p").isNull(), "process")
        .when((F.col("status") == "failed") & (F.col("retries") < MAX_RETRIES), "retry")
        .when(F.col("status") == "failed", "quarantine")
        .when(F.col("status") == "processing", "retry")
        .when(h.isNotNull() & (h != F.coalesce("_h", F.lit(""))), "changed")
        .otherwise("skip")
    )
    return listing.join(s, F.col("path") == F.col("_p"), "left").select("path", out.alias("decision"))


def interrupted(file_state: DataFrame) -> DataFrame:
    """(path, interruptions, other_failures): failures by an interruption and by anything else."""
    hit = F.lower(F.coalesce("error", F.lit(""))).contains("interrump")
    failed = file_state.where((F.col("status") == "failed") & F.col("path").isNotNull())
    return failed.groupBy("path").agg(F.count_if(hit).alias("interruptions"), F.count_if(~hit).alias("other_failures"))


def crash_counter(file_state: DataFrame) -> DataFrame:
    """(path, crashes, banned): attempts begun since the last success and not ended well.

    'processing' adds one, 'failed' with another cause takes one back, down to zero, and a success clears.
    The floor at zero makes it a fold over one path's attempts.
    """
    a = attempts(file_state).where(F.col("path").isNotNull())
    seq = a.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("at", "logged_at", "state_id", "status", "error"))).alias("s"))

    def step(n: Column, x: Column) -> Column:
        crash = F.lower(F.coalesce(x["error"], F.lit(""))).contains("interrump")
        return F.when(x["status"] == "success", 0).when((x["status"] == "processing") | crash, n + 1).otherwise(F.greatest(n - 1, F.lit(0)))

    return seq.select("path", F.aggregate("s", F.lit(0), step).alias("crashes")).withColumn("banned", F.col("crashes") >= MAX_RETRIES)


def hard_deaths(file_state: DataFrame) -> DataFrame:
    """(path, state_id): attempts left in 'processing' after which nothing else was recorded; each counts as a failed attempt."""
    a = attempts(file_state).where(F.col("path").isNotNull())
    last = a.groupBy("path").agg(F.max_by(F.struct("status", "state_id"), F.struct("at", "logged_at", "state_id")).alias("v"))
    return last.where(F.col("v.status") == "processing").select("path", "v.state_id")


def interrupted_spells(file_state: DataFrame) -> DataFrame:
    """(path, since, until): each time from an attempt that was begun or interrupted to the path's next attempt, null if none.

    Between the two the file is tracked and all that is known of it is an interruption. Times are structs
    (at, logged_at, state_id), in the order of attempts.
    """
    a = attempts(file_state).where(F.col("path").isNotNull())
    a = a.withColumn("since", F.struct("at", "logged_at", "state_id"))
    a = a.withColumn("until", F.lead("since").over(W.partitionBy("path").orderBy("since")))
    crash = F.lower(F.coalesce("error", F.lit(""))).contains("interrump")
    return a.where((F.col("status") != "success") & ((F.col("status") == "processing") | crash)).select("path", "since", "until")


def kill_attribution(markers: DataFrame, spells: DataFrame) -> DataFrame:
    """(marker_id, path): for each kill marker the least file whose name its context contains, interrupted-only at that time.

    ``markers`` is (marker_id, context, since), ``spells`` what ``interrupted_spells`` gives. Candidates share a
    name's rarest sequence of GRAM characters (the whole of a shorter name) with the context: an equi-join, and an
    exact comparison of the pairs that are left.
    """
    names = spells.select("path", F.element_at(F.split("path", "/"), -1).alias("name")).distinct().where(F.length("name") > 0)
    grams = names.select("path", "name", F.explode(_grams("name", F.least(F.length("name"), F.lit(GRAM)))).alias("gram"))
    held = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("held"))
    rarest = grams.join(held, "gram").groupBy("path", "name").agg(F.min_by("gram", F.struct("held", "gram")).alias("gram"))
    sizes = names.agg(F.collect_set(F.least(F.length("name"), F.lit(GRAM))).alias("sizes"))  # at most GRAM numbers
    asked = markers.where(F.length("context") > 0).crossJoin(F.broadcast(sizes)).withColumn("size", F.explode("sizes"))
    asked = asked.where(F.length("context") >= F.col("size")).select("marker_id", "context", F.col("since").alias("killed"), F.explode(_grams("context", F.col("size"))).alias("gram"))
    found = asked.join(rarest, "gram").where(F.col("context").contains(F.col("name"))).select("marker_id", "killed", "path")
    then = (F.col("since") <= F.col("killed")) & (F.col("until").isNull() | (F.col("killed") < F.col("until")))
    return found.join(spells, "path").where(then).groupBy("marker_id").agg(F.min("path").alias("path"))


def _grams(text: str, size: Column) -> Column:
    """The distinct sequences of ``size`` characters of a text that has as many."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substring(F.col(text), i, size)))


def state_stats(state: DataFrame) -> DataFrame:
    return state.groupBy("topic").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "success").alias("success"), F.count_if(F.col("status") == "failed").alias("failed"))


def unknown_topics(rows: DataFrame, topics: DataFrame) -> DataFrame:
    """(topic, n): topics of the requests that are not exactly one of the known ones."""
    known = topics.select("topic").where(F.col("topic").isNotNull()).distinct()
    return rows.where(F.col("topic").isNotNull()).groupBy("topic").agg(F.count(F.lit(1)).alias("n")).join(known, "topic", "left_anti")


def routed(rows: DataFrame, tokens: Column, threshold: int, topk: int, factor: int) -> DataFrame:
    """Each request's strategy and depth: few tokens go to lexical search only; generative requests go deeper."""
    mode = F.when(tokens < threshold, "lexical").otherwise("hybrid")
    depth = F.coalesce(F.col("final_topk"), F.when(F.coalesce("generative", F.lit(False)), topk * factor).otherwise(topk))
    return rows.select("retrieval_id", mode.alias("strategy"), depth.alias("depth"))


def resolved_topic(name: Column, mapping: dict[str, str], suffixes: list[str], default: str) -> Column:
    """The topic a name stands for: mapped as it is, mapped without its first matching suffix, itself, or the default."""
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]) if mapping else F.create_map().cast("map<string,string>")
    base = name
    for s in reversed(suffixes):
        base = F.when(F.lower(name).endswith(s.lower()), F.substring(name, F.lit(1), F.char_length(name) - len(s))).otherwise(base)
    base = F.regexp_replace(base, r"[ \t\-–—]+$", "")
    return F.coalesce(F.try_element_at(m, name), F.try_element_at(m, base), F.when(base != "", base), F.lit(default))


def is_generative(text: Column, markers: list[str]) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(False)
    for x in markers:
        out = out | low.contains(x.lower())
    return out


def latest_request(rows: DataFrame, by: str) -> DataFrame:
    """(by, retrieval_id, query): the last request of each group by time, ties the greater id."""
    rows = rows.where(F.col("ts").isNotNull() & F.col(by).isNotNull() & (F.trim("query") != ""))
    return rows.groupBy(by).agg(F.max_by(F.struct("retrieval_id", "query"), F.struct("ts", "retrieval_id")).alias("v")).select(by, "v.retrieval_id", "v.query")


def deduplicated(rows: DataFrame, key: list[str], ident: str) -> DataFrame:
    """(ident): the first id of each set of rows logged again under a new id."""
    return rows.groupBy(*key).agg(F.min(ident).alias(ident)).select(ident)


def tail(rows: DataFrame, n: int) -> DataFrame:
    """The ``n`` newest requests: a top-k."""
    return rows.select("retrieval_id", "ts", "topic").where(F.col("ts").isNotNull()).orderBy(F.desc("ts"), F.desc("retrieval_id")).limit(n)


def stale_gaps(events: DataFrame, seconds: int) -> DataFrame:
    """(user_id, gaps, longest): silences longer than the limit between one user's events."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    gap = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag(F.col("ts").cast("timestamp")).over(w))) / 1_000_000
    return events.select("user_id", gap.alias("gap")).where(F.col("gap") > seconds).groupBy("user_id").agg(F.count(F.lit(1)).alias("gaps"), F.round(F.max("gap"), 3).alias("longest"))


def missing_collections(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """(topic, requests, missing_collection): requests per topic, and whether the topic has nothing indexed; not an error."""
    has = chunks.where(F.col("topic").isNotNull()).select(F.col("topic").alias("_t")).distinct()
    asked = rows.where(F.col("topic").isNotNull()).groupBy("topic").agg(F.count(F.lit(1)).alias("requests"))
    return asked.join(has, F.col("topic") == F.col("_t"), "left").select("topic", "requests", F.col("_t").isNull().alias("missing_collection"))


def scan_counters(decisions: DataFrame) -> DataFrame:
    """(processed, skipped, errors): what a scan does with its files; quarantined ones are errors."""
    d = F.col("decision")
    return decisions.agg(F.count_if(d.isin("process", "retry", "changed")).alias("processed"), F.count_if(d == "skip").alias("skipped"), F.count_if(d == "quarantine").alias("errors"))


def reset_failed(state: DataFrame) -> DataFrame:
    """``state`` with all failure counts at zero, and ``was_reset`` for those that were above; their number is what the command reports."""
    return state.withColumn("was_reset", F.coalesce(F.col("retries") > 0, F.lit(False))).withColumn("retries", F.lit(0))


def remove_file(state: DataFrame, path: str) -> DataFrame:
    """The state without one path, whatever its status; a path that isn't there changes nothing."""
    return state.where(~F.col("path").eqNullSafe(path))


def remove_topic(state: DataFrame, topic: str, folder: str) -> DataFrame:
    """The state without a topic: processed files by their topic, failed ones by the topic's folder in their path, as the reference does."""
    gone = F.when(F.col("status") == "success", F.col("topic").eqNullSafe(topic)).when(F.col("status") == "failed", F.col("path").contains(f"{folder}/{topic}")).otherwise(False)
    return state.where(~F.coalesce(gone, F.lit(False)))


def consume_inflight(begun: DataFrame, state: DataFrame) -> DataFrame:
    """(path, context, counts): attempts in flight that a restart finds, the latest of each path; ``counts`` if it becomes a failed attempt.

    ``begun`` is (path, context, at). A path that has since succeeded is consumed without one.
    """
    last = begun.where(F.col("path").isNotNull()).groupBy("path").agg(F.max_by("context", F.struct("at", "context")).alias("context"))
    s = state.select(F.col("path").alias("_p"), F.col("status").alias("_s"))
    return last.join(s, F.col("path") == F.col("_p"), "left").select("path", "context", (~F.col("_s").eqNullSafe("success")).alias("counts"))
