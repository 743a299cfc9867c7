"""Health of the index: extractors, pages, files, legibility."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusloom.functions.text import legibility, query_tokens


def extractor_mix(chunks: DataFrame) -> DataFrame:
    """(source, points, pct): chunks per source and their share of all."""
    per = chunks.groupBy(F.coalesce("source", F.lit("?")).alias("source")).agg(F.count(F.lit(1)).alias("points"))
    total = per.agg(F.sum("points").alias("t"))
    return per.crossJoin(F.broadcast(total)).select("source", "points", F.round(100.0 * F.col("points") / F.col("t"), 4).alias("pct"))  # one row


def unstructured_files(chunks: DataFrame, structured: str = "docling") -> DataFrame:
    """(file_path, points): files without a single chunk of exactly the structured source."""
    has = F.sum(F.when(F.col("source") == structured, 1).otherwise(0))
    return chunks.where(F.col("file_path").isNotNull()).groupBy("file_path").agg(F.count(F.lit(1)).alias("points"), has.alias("_s")).where("_s = 0").select("file_path", "points")


def reingest_targets(chunks: DataFrame, state: DataFrame, topics: list[str], banned_retries: int = 3) -> DataFrame:
    """(file_path, points): processed files of the topics that have chunks but no structured one and are not banned."""
    done = state.where((F.col("status") == "success") & F.col("topic").isin(*topics)).select(F.col("path").alias("file_path")).distinct()
    banned = state.where(F.coalesce("retry_count", F.lit(0)) >= banned_retries).select(F.col("path").alias("file_path")).distinct()
    return unstructured_files(chunks).join(done, "file_path", "left_semi").join(banned, "file_path", "left_anti")


def file_diversity(citations: DataFrame, per_request: str = "retrieval_id") -> DataFrame:
    """(retrieval_id, files, verdict) of each answered request: one file is critical, fewer than three a warning."""
    n = citations.where(F.col("file").isNotNull()).groupBy(per_request).agg(F.countDistinct("file").alias("files"))
    return n.withColumn("verdict", F.when(F.col("files") == 1, "critical").when(F.col("files") < 3, "warning").otherwise("ok"))


def points_per_file(chunks: DataFrame, k: int = 5) -> DataFrame:
    """(file_path, points, pct): the ``k`` files of most chunks, a top-k report."""
    per = chunks.where(F.col("file_path").isNotNull()).groupBy("file_path").agg(F.count(F.lit(1)).alias("points"))
    total = per.agg(F.sum("points").alias("t"))
    return per.crossJoin(F.broadcast(total)).select("file_path", "points", F.round(100.0 * F.col("points") / F.col("t"), 4).alias("pct")).orderBy(F.desc("points"), "file_path").limit(k)


def page_diagnostics(chunks: DataFrame, most: int = 2000, crowd: int = 100) -> DataFrame:
    """(file_path, pages, low, high, bad, far, fullest): page counts, bounds and doubtful pages per file."""
    per = chunks.where(F.col("file_path").isNotNull()).groupBy("file_path", "page").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("file_path").agg(
        F.count("page").alias("pages"), F.min("page").alias("low"), F.max("page").alias("high"),
        F.sum(F.when(F.col("page") <= 0, F.col("n")).otherwise(0)).alias("bad"),
        F.sum(F.when(F.col("page") > most, F.col("n")).otherwise(0)).alias("far"),
        F.sum(F.when(F.col("n") > crowd, 1).otherwise(0)).alias("crowded"), F.max(F.when(F.col("page").isNotNull(), F.col("n"))).alias("fullest"),
    )


def page_gaps(chunks: DataFrame, gap: int = 10) -> DataFrame:
    """(file_path, page_from, page_to): jumps of more than ``gap`` between a file's distinct valid pages."""
    pages = chunks.where(F.col("page") > 0).select("file_path", "page").distinct()
    prev = F.lag("page").over(W.partitionBy("file_path").orderBy("page"))
    return pages.withColumn("page_from", prev).where(F.col("page") - F.col("page_from") > gap).select("file_path", "page_from", F.col("page").alias("page_to"))


def with_previous(rows: DataFrame, key: str, place: str, tie: str, value: str, span: int = 4096) -> DataFrame:
    """``rows`` with ``prev``, the value of the row before in order of (place, tie) within the key.

    A key's rows are windowed in blocks of ``span`` places; a block's first row takes the last value of the block before, so that a key with
    a large share of all rows is not one task's. A null place comes first, as in an ascending order.
    """
    block = rows.withColumn("_block", F.coalesce(F.floor(F.col(place) / span), F.lit(-(1 << 40))))
    of = W.partitionBy(key, "_block").orderBy(place, tie)
    inner = block.withColumn("prev", F.lag(value).over(of)).withColumn("_first", F.row_number().over(of) == 1)
    ends = block.groupBy(key, "_block").agg(F.max_by(F.struct(value), F.struct(place, tie)).alias("_v"))
    carried = ends.select(F.col(key).alias("_k"), F.col("_block").alias("_b"), F.lag("_v").over(W.partitionBy(key).orderBy("_block")).alias("_carry"))
    out = inner.join(carried, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_block") == F.col("_b")), "left")
    return out.withColumn("prev", F.when(F.col("_first"), F.col("_carry")[value]).otherwise(F.col("prev"))).drop("_block", "_first", "_k", "_b", "_carry")


def page_issues(chunks: DataFrame, totals: DataFrame) -> DataFrame:
    """(file_path, kind, n): chunks with an invalid page, a page beyond the total, or one below the chunk's before."""
    rows = with_previous(chunks.select("file_path", "row_id", "chunk_id", "page"), "file_path", "chunk_id", "row_id", "page").join(totals.select("file_path", "total_pages"), "file_path", "left")
    kinds = F.array(
        F.when(F.col("page").isNull() | (F.col("page") < 1) | (F.col("page") > 50000), "invalid"),
        F.when(F.col("page") > F.col("total_pages"), "overflow"),
        F.when(F.col("page") < F.col("prev"), "out_of_order"),
    )
    return rows.select("file_path", F.explode(F.array_compact(kinds)).alias("kind")).groupBy("file_path", "kind").agg(F.count(F.lit(1)).alias("n"))


def total_pages(extractions: DataFrame) -> DataFrame:
    return extractions.where(F.col("total_pages").isNotNull()).groupBy("file_path").agg(F.max("total_pages").alias("total_pages"))


def fixed_pages(chunks: DataFrame, totals: DataFrame, jump: int = 20) -> DataFrame:
    """(row_id, page, fixed): invalid pages carry the last valid one, none exceeds the total, jumps over ``jump`` become the page before plus one.

    All three passes are one fold over a file's chunks in order. It runs over partitions sorted by file, batch by
    batch, and carries two numbers from chunk to chunk, so no file is held whole.
    """
    rows = chunks.select("file_path", "chunk_id", F.col("row_id").cast("long").alias("row_id"), F.col("page").cast("int").alias("page")).join(totals.select("file_path", "total_pages"), "file_path", "left")
    rows = rows.repartition("file_path").sortWithinPartitions("file_path", "chunk_id", "row_id").select("file_path", "row_id", "page", "total_pages")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, valid, last = object(), 1, None
        for batch in batches:
            out = []
            for f, page, total in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3))):
                if f != file:
                    file, valid, last = f, 1, None
                if page is not None and 1 <= page <= 50000:
                    valid = page
                p = min(valid, total) if total is not None and total > 0 else valid
                last = last + 1 if last is not None and p - last > jump else p
                out.append(last)
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(out, pa.int32())], ["row_id", "page", "fixed"])

    return rows.mapInArrow(run, "row_id bigint, page int, fixed int")


def contiguous_runs(elements: DataFrame) -> DataFrame:
    """(file_path, first_page, last_page): maximal runs of consecutive pages with elements."""
    pages = elements.where(F.col("page") > 0).select("file_path", "page").distinct()
    island = F.col("page") - F.row_number().over(W.partitionBy("file_path").orderBy("page"))
    return pages.withColumn("g", island).groupBy("file_path", "g").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page")).drop("g")


def page_geometry(elements: DataFrame) -> DataFrame:
    """(file_path, page, text_top, text_bottom, height): bounds of the boxes of each page; boxes of other than four numbers are passed over."""
    boxes = elements.where((F.size("bbox") == 4) & (F.col("page") > 0)).select("file_path", "page", F.col("bbox")[1].alias("y0"), F.col("bbox")[3].alias("y1"))
    return boxes.groupBy("file_path", "page").agg(F.min("y0").alias("text_top"), F.max("y1").alias("text_bottom")).withColumn("height", F.greatest(F.col("text_bottom"), F.lit(1.0)))


#: Height of the bands under which positions meet pages: about a page's.
BAND = 1000.0


def page_by_height(elements: DataFrame) -> DataFrame:
    """(element_id, page, placed): the page that holds the element's absolute position, by running page heights.

    Position = heights of the pages before plus the box's top. Positions past the end fall on the last page.
    Both sides of the interval join meet under a band of heights, which a page overlaps in few, and a position lies in one.
    """
    geom = page_geometry(elements)
    w = W.partitionBy("file_path").orderBy("page").rowsBetween(W.unboundedPreceding, -1)
    run = geom.withColumn("start", F.coalesce(F.sum("height").over(w), F.lit(0.0))).withColumn("end", F.col("start") + F.col("height"))
    last = run.groupBy("file_path").agg(F.max("page").alias("last_page"))
    at = elements.where((F.size("bbox") == 4) & (F.col("page") > 0)).join(run.select("file_path", "page", "start"), ["file_path", "page"]).select("file_path", "element_id", "page", (F.col("start") + F.col("bbox")[1]).alias("y"))
    bands = F.explode(F.sequence(F.floor(F.col("start") / BAND), F.floor(F.col("end") / BAND)))
    r = run.select(F.col("file_path").alias("_f"), F.col("page").alias("_p"), F.col("start").alias("_s"), F.col("end").alias("_e"), bands.alias("_b"))
    hit = at.join(r, (F.col("file_path") == F.col("_f")) & (F.floor(F.col("y") / BAND) == F.col("_b")) & (F.col("y") >= F.col("_s")) & (F.col("y") < F.col("_e")), "left")
    return hit.join(last, "file_path").select("element_id", "page", F.coalesce("_p", "last_page").alias("placed"))


def legibility_by_source(elements: DataFrame) -> DataFrame:
    """(source, n, legibility): mean share of function words of the elements with text."""
    return elements.where(F.length("text") > 0).groupBy(F.coalesce("source", F.lit("?")).alias("source")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(legibility(F.col("text"))), 4).alias("legibility"))


def reader_comparison(elements: DataFrame, a: tuple[str, ...], b: tuple[str, ...], least: int = 50) -> DataFrame:
    """(reader, elements, covered, chars, legibility): two groups of sources side by side; covered elements have at least ``least`` characters."""
    s = F.col("source")
    reader = F.when(s.isin(*a), "vlm").when(s.isin(*b), "ocr")
    rows = elements.select(reader.alias("reader"), F.coalesce("text", F.lit("")).alias("text")).where(F.col("reader").isNotNull())
    n = F.char_length("text")
    return rows.groupBy("reader").agg(
        F.count(F.lit(1)).alias("elements"), F.count_if(n >= least).alias("covered"), F.sum(n).cast("long").alias("chars"), F.round(F.avg(legibility(F.col("text"))), 4).alias("legibility")
    )


def topic_stats(chunks: DataFrame) -> DataFrame:
    """(topic, points, files, empty): size of each topic's collection."""
    return chunks.groupBy("topic").agg(F.count(F.lit(1)).alias("points"), F.countDistinct("file_path").alias("files"), F.count_if(F.coalesce(F.trim("text"), F.lit("")) == "").alias("empty"))


def number_summary(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, n, median, mean, max) of a number; nulls are left out."""
    return rows.where(F.col(value).isNotNull()).groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.percentile(value, 0.5), 4).alias("median"), F.round(F.avg(value), 4).alias("mean"), F.max(value).alias("max")
    )


def short_queries(retrievals: DataFrame, under: int = 4) -> DataFrame:
    """(topic, n, short, median_tokens): how many of a topic's queries have few words."""
    rows = retrievals.where(F.col("query").isNotNull()).select("topic", query_tokens(F.col("query")).alias("t"))
    return rows.groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("t") < under).alias("short"), F.round(F.percentile("t", 0.5), 4).alias("median_tokens"))


def seeded_sample(files: DataFrame, key: str, seed: str, k: int) -> DataFrame:
    """The ``k`` keys least by a hash with the seed: the same sample on every run."""
    return files.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_h", F.md5(F.concat(F.lit(seed), F.col(key)).cast("binary"))).orderBy("_h", key).limit(k).drop("_h")


def middle_page(chunks: DataFrame) -> DataFrame:
    """(file_path, page): the middle one of each file's sorted distinct valid pages."""
    pages = chunks.where(F.col("page") > 0).select("file_path", "page").distinct()
    w = W.partitionBy("file_path")
    n = pages.withColumn("i", F.row_number().over(w.orderBy("page")) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    return n.where(F.col("i") == F.floor(F.col("n") / 2)).select("file_path", "page")


def scanned_sieve(elements: DataFrame, pages: int = 10, under: int = 200) -> DataFrame:
    """(file_path, chars, scanned): characters on the first pages; too few mean a scan without text layer."""
    n = F.sum(F.when(F.col("page") <= pages, F.coalesce(F.char_length("text"), F.lit(0))).otherwise(0))
    return elements.where(F.col("file_path").isNotNull()).groupBy("file_path").agg(n.alias("chars")).withColumn("scanned", F.col("chars") < under)


def table_shapes(elements: DataFrame) -> DataFrame:
    """(element_id, lines, columns, empty_cells) of tables kept as tab-separated text."""
    rows = elements.where((F.col("type") == "Table") & F.col("text").isNotNull()).select("element_id", F.split("text", "\n").alias("l"))
    cells = F.flatten(F.transform("l", lambda x: F.split(x, "\t")))
    return rows.select("element_id", F.size("l").alias("lines"), F.array_max(F.transform("l", lambda x: F.size(F.split(x, "\t")))).alias("columns"), F.size(F.filter(cells, lambda c: c == "")).alias("empty_cells"))


def citation_integrity(citations: DataFrame, chunks: DataFrame) -> DataFrame:
    """(state, n): citations whose chunk is stored on the cited page, on another one, or not at all.

    The join is on file and chunk, so a file's other pages give no false mismatch. ``citations`` and
    ``chunks`` have (name, chunk_id, page).
    """
    stored = chunks.where(F.col("name").isNotNull()).groupBy("name", "chunk_id").agg(F.collect_set("page").alias("pages"), F.count(F.lit(1)).alias("_n"))
    c = citations.where(F.col("name").isNotNull()).groupBy("name", "chunk_id", "page").agg(F.count(F.lit(1)).alias("n"))
    s = stored.select(F.col("name").alias("_f"), F.col("chunk_id").alias("_c"), "pages")
    state = F.when(F.col("pages").isNull(), "missing").when(F.array_contains("pages", F.col("page")), "same_page").otherwise("other_page")
    return c.join(s, (F.col("name") == F.col("_f")) & (F.col("chunk_id") == F.col("_c")), "left").groupBy(state.alias("state")).agg(F.sum("n").alias("n"))


def file_pages(chunks: DataFrame) -> DataFrame:
    """(file_path, page, n, single_page, lacks_page): chunks on each page of each file; whether the file has but one page, or chunks without one."""
    per = chunks.where(F.col("file_path").isNotNull()).groupBy("file_path", "page").agg(F.count(F.lit(1)).alias("n"))
    flags = per.groupBy("file_path").agg((F.count("page") == 1).alias("single_page"), (F.count_if(F.col("page").isNull()) > 0).alias("lacks_page"))
    return per.join(flags, "file_path")


def dry_run_totals(sieve: DataFrame, totals: DataFrame, max_pages: int = 60) -> DataFrame:
    """(files, pages): how many scanned files of at most ``max_pages`` pages a run would take, and their pages; files without a total count no page."""
    due = sieve.where("scanned").join(totals, "file_path", "left").where(F.coalesce("total_pages", F.lit(0)) <= max_pages)
    return due.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("total_pages"), F.lit(0)).cast("long").alias("pages"))
