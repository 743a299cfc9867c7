"""From extracted elements to chunks, and keeping the chunk table current."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusloom.functions.text import collapse, normalised, repaired, token_estimate
from corpusloom.operators.incremental import latest_by

#: Extractors in the order they are tried.
CHAIN = ("docling", "text", "vlm", "ocr", "unstructured")
MAX_TOKENS, MIN_CHARS = 256, 40


def sufficient(chars, pages, last):
    """Whether an extraction has enough text: 500 characters and 80 a page, or 10 for the last resort."""
    return F.when(last, chars >= 10).otherwise((chars >= 500) & (chars / F.greatest(pages, F.lit(1)) >= 80))


def extract_chain(elements: DataFrame) -> DataFrame:
    """(file_path, extractor, chars, pages): for each file the first extractor of the chain whose output is sufficient.

    The extractor is read off the elements' source; elements of no known source take no part. Files for
    which none is sufficient are left out.
    """
    s = F.col("source")
    name = (
        F.when(s.isin("docling_gpu", "docling_cpu", "docling"), "docling")
        .when(s.isin("pypdf", "pdfplumber"), "text")
        .when(s == "docling_vlm", "vlm")
        .when(s.isin("easyocr", "tesseract"), "ocr")
        .when(s == "unstructured", "unstructured")
    )
    sums = elements.select("file_path", "page", "text", name.alias("extractor")).where(F.col("extractor").isNotNull()).groupBy("file_path", "extractor").agg(
        F.sum(F.coalesce(F.char_length("text"), F.lit(0))).alias("chars"), F.countDistinct("page").alias("pages")
    )
    place = F.array_position(F.array(*map(F.lit, CHAIN)), F.col("extractor"))
    good = sums.where(sufficient(F.col("chars"), F.col("pages"), F.col("extractor") == CHAIN[-1]))
    best = good.groupBy("file_path").agg(F.min_by(F.struct("extractor", "chars", "pages"), place).alias("b"))
    return best.select("file_path", "b.extractor", "b.chars", "b.pages")


def text_layer_probe(elements: DataFrame, pages: int = 5, least: int = 100) -> DataFrame:
    """(file_path, chars, has_text): characters, without outer blanks, on the first pages."""
    own = F.when(F.col("page") <= pages, F.char_length(F.trim("text")))
    return elements.groupBy("file_path").agg(F.coalesce(F.sum(own), F.lit(0)).alias("chars")).withColumn("has_text", F.col("chars") >= least)


def boilerplate(elements: DataFrame, share: float = 0.3, least: int = 3, min_pages: int = 4, max_chars: int = 100) -> DataFrame:
    """(file_path, line, pages): normalised lines on at least ``max(least, share of the pages)`` pages of a file.

    Files of fewer than ``min_pages`` pages have none. Elements without a page or text are passed over.
    """
    rows = elements.where(F.col("page").isNotNull() & F.col("text").isNotNull()).select("file_path", "page", "text")
    count = rows.groupBy("file_path").agg(F.countDistinct("page").alias("n"))
    lines = rows.select("file_path", "page", F.explode(F.split("text", "\n")).alias("line")).select("file_path", "page", normalised(F.col("line")).alias("line"))
    lines = lines.where((F.col("line") != "") & (F.char_length("line") <= max_chars)).distinct()
    seen = lines.groupBy("file_path", "line").agg(F.count(F.lit(1)).alias("pages"))
    return seen.join(count, "file_path").where((F.col("n") >= min_pages) & (F.col("pages") >= F.greatest(F.lit(least), F.floor(F.col("n") * share)))).select("file_path", "line", "pages")


def strip_boilerplate(elements: DataFrame, lines: DataFrame) -> DataFrame:
    """(element_id, text): the elements' texts without their files' boilerplate lines. A file's list is bounded by its own repetition."""
    per_file = lines.groupBy("file_path").agg(F.collect_set("line").alias("drop"))
    rows = elements.select("element_id", "file_path", "text").join(per_file, "file_path", "left")
    kept = F.filter(F.split("text", "\n"), lambda x: ~F.coalesce(F.array_contains("drop", normalised(x)), F.lit(False)))
    return rows.select("element_id", F.array_join(kept, "\n").alias("text"))


# ---- packing -------------------------------------------------------------------------------------


def split_words(text: str, max_tokens: int) -> list[str]:
    """Windows of three quarters of the budget, in words."""
    w, n = text.split(), max(1, max_tokens * 3 // 4)
    return [" ".join(w[i : i + n]) for i in range(0, len(w), n)]


def split_by_tokens(text: str, max_tokens: int) -> list[str]:
    """Sentences packed greedily within the budget; one longer than it is cut by words."""
    import re

    out, held = [], ""
    for s in re.split(r"(?<=[.!?])\s+", text):
        if max(1, len(s) // 4) > max_tokens:
            out += [held] if held else []
            held = ""
            out += split_words(s, max_tokens)
        elif held and max(1, (len(held) + 1 + len(s)) // 4) > max_tokens:
            out.append(held)
            held = s
        else:
            held = f"{held} {s}" if held else s
    return out + ([held] if held else [])


def pack_page(rows: list[tuple], max_tokens: int, min_chars: int) -> list[tuple]:
    """(page, type, source, text) of one page's elements in order, packed within the budget.

    A chunk takes page, type and source of its first element; elements are joined by a blank line. With the
    running sum of their tokens, each chunk ends at the last element within its start plus the budget, found by
    bisection, or before the next element that exceeds the budget alone; that one is cut up by sentences.
    """
    rows = [(*r[:3], t) for r in rows if (t := (r[3] or "").strip())]
    total = np.concatenate([[0], np.cumsum([max(1, len(r[3]) // 4) for r in rows], dtype=np.int64)])
    single = np.append(np.flatnonzero(np.diff(total) > max_tokens), len(rows))
    chunks, at = [], 0
    while at < len(rows):
        wall = int(single[np.searchsorted(single, at)])
        if wall == at:
            chunks += [(*rows[at][:3], piece) for piece in split_by_tokens(rows[at][3], max_tokens)]
            at += 1
        else:
            end = min(wall, int(np.searchsorted(total, total[at] + max_tokens, side="right")) - 1)
            chunks.append((*rows[at][:3], "\n\n".join(r[3] for r in rows[at:end])))
            at = end
    return [c for c in chunks if len(c[3].strip()) >= min_chars]


def token_chunks(elements: DataFrame, max_tokens: int = MAX_TOKENS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(file_path, page, type, source, seq, text): chunks of whole elements of one page within a token budget.

    A fold, so a Python function; it holds one page of one file at a time, as chunks don't cross pages. ``seq`` orders a page's chunks. A null page counts as page 1, a null text as
    empty; elements delivered twice (same file and number) count once.
    """
    clean = latest_by(elements.withColumn("page", F.coalesce("page", F.lit(1))), ["file_path", "elem_no"], [-F.col("element_id")], ["page", "type", "source", "text"])

    # Pages are far smaller than batches: one pass over sorted partitions, not one call per page.
    rows = clean.select("file_path", "page", "elem_no", "type", "source", "text").repartition("file_path", "page").sortWithinPartitions("file_path", "page", "elem_no")

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, []
        cols = ["file_path", "page", "type", "source", "seq", "text"]

        def flush() -> list[tuple]:
            if not held:
                return []
            return [(key[0], p, k, s, i, t) for i, (p, k, s, t) in enumerate(pack_page(held, max_tokens, min_chars))]

        for pdf in it:
            made = []
            for f, p, k, s, t in zip(pdf["file_path"], pdf["page"], pdf["type"], pdf["source"], pdf["text"]):
                if (f, p) != key:
                    made += flush()
                    key, held = (f, p), []
                held.append((p, k, s, t))
            yield pd.DataFrame(made, columns=cols)
        yield pd.DataFrame(flush(), columns=cols)

    return rows.mapInPandas(run, "file_path string, page int, type string, source string, seq int, text string")


def structured_chunks(elements: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(file_path, page, type, source, seq, text): one chunk of each element that is no title, under the title before it on its page.

    Texts shorter than ``min_chars``, title included, are dropped. A null page counts as page 1; elements delivered twice count once.
    """
    rows = latest_by(elements.withColumn("page", F.coalesce("page", F.lit(1))), ["file_path", "elem_no"], [-F.col("element_id")], ["page", "type", "source", "text"])
    title = F.last(F.when(F.col("type") == "Title", F.trim("text")), True).over(W.partitionBy("file_path", "page").orderBy("elem_no"))
    body = rows.withColumn("_title", title).where(~F.col("type").eqNullSafe("Title") & (F.length(F.trim("text")) > 0))
    text = F.concat_ws("\n", F.when(F.col("_title") != "", F.col("_title")), F.trim("text"))
    return body.select("file_path", "page", "type", "source", F.col("elem_no").alias("seq"), text.alias("text")).where(F.char_length("text") >= min_chars)


def build_chunks(elements: DataFrame, extractions: DataFrame, max_tokens: int = MAX_TOKENS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(file_path, page, seq, type, source, is_table, text): the chunks of every file, in one pipeline.

    Files with a structured extraction that yields chunks are chunked by structure, all others by token packing
    after their boilerplate lines are stripped. Texts are repaired and only then, of those of a file that have
    become equal up to letter case and white space, the first is kept. Elements without a file are left out.
    """
    known = elements.where(F.col("file_path").isNotNull())
    shaped = extractions.where("has_structure").select("file_path").distinct()
    structured = structured_chunks(known.join(shaped, "file_path", "left_semi"), min_chars)
    rest = known.join(structured.select("file_path").distinct(), "file_path", "left_anti")
    bare = strip_boilerplate(rest, boilerplate(rest)).select(F.col("element_id").alias("_id"), F.col("text").alias("_text"))
    packed = token_chunks(rest.join(bare, F.col("element_id") == F.col("_id")).withColumn("text", F.col("_text")), max_tokens, min_chars)
    made = structured.unionByName(packed).withColumn("text", repaired(F.col("text"))["text"])
    place = F.struct("page", "seq", "type", "source", "text")
    firsts = made.groupBy("file_path", F.sha1(F.encode(normalised(F.col("text")), "UTF-8")).alias("_h")).agg(F.min(place).alias("v"))
    return firsts.select("file_path", "v.page", "v.seq", "v.type", "v.source", F.coalesce(F.col("v.type") == "Table", F.lit(False)).alias("is_table"), "v.text")


def numbered(chunks: DataFrame) -> DataFrame:
    """Chunks with their 0-based order in the file: their place on the page, ``seq``, after all chunks of the pages before."""
    per = chunks.groupBy("file_path", "page").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("file_path").orderBy("page").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = per.select(F.col("file_path").alias("_f"), F.col("page").alias("_p"), before.alias("_start"))
    out = chunks.join(starts, F.col("file_path").eqNullSafe(F.col("_f")) & F.col("page").eqNullSafe(F.col("_p")))
    return out.withColumn("chunk_id", (F.col("_start") + F.col("seq")).cast("int")).drop("_f", "_p", "_start")


def sentence_pieces(df: DataFrame, key: str, text: str, max_tokens: int) -> DataFrame:
    """(key, piece_no, piece) by greedy sentence packing; null and blank texts give none."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            made = [(k, i, p) for k, t in zip(pdf[key], pdf[text]) if t and t.strip() for i, p in enumerate(split_by_tokens(t.strip(), max_tokens))]
            yield pd.DataFrame(made, columns=[key, "piece_no", "piece"])

    return df.select(F.col(key).cast("long"), text).mapInPandas(run, f"{key} long, piece_no int, piece string")


def hard_split(df: DataFrame, key: str, text: str, max_tokens: int) -> DataFrame:
    """(key, piece_no, piece): windows of three quarters of the budget in words; built-ins only."""
    n = max(1, max_tokens * 3 // 4)
    w = F.split(collapse(F.col(text)), " ")
    rows = df.where(collapse(F.col(text)) != "").select(key, w.alias("w"))
    rows = rows.select(key, "w", F.posexplode(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / n).cast("int"))).alias("piece_no", "k"))
    return rows.select(key, "piece_no", F.array_join(F.slice("w", F.col("k") * n + 1, F.lit(n)), " ").alias("piece"))


def first_by_text(chunks: DataFrame, key: str = "row_id") -> DataFrame:
    """Of each file's chunks with equal normalised text the first one's id. Map-side combined."""
    rows = chunks.where(F.col("text").isNotNull()).select("file_path", F.sha1(F.encode(normalised(F.col("text")), "UTF-8")).alias("h"), "chunk_id", key)
    return rows.groupBy("file_path", "h").agg(F.min_by(key, F.struct("chunk_id", key)).alias(key)).select(key, "file_path")


# ---- keeping a table current ---------------------------------------------------------------------


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The new rows, and the old ones whose key is not among them. Null keys never match. Columns are those of ``old``."""
    kept = old.join(new.select(F.col(key).alias("_new")), F.col(key) == F.col("_new"), "left_anti")
    return kept.unionByName(new.select(*old.columns))


def delete_file(rows: DataFrame, path: str) -> DataFrame:
    """All rows but those of one file; rows without a file stay."""
    return rows.where(~F.col("file_path").eqNullSafe(path))


def replace_file(rows: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of the files in ``new`` give way to ``new``, so that no chunk of a longer old version stays."""
    kept = rows.join(new.select(F.col("file_path").alias("_file")).distinct(), F.col("file_path") == F.col("_file"), "left_anti")
    return kept.unionByName(new.select(*rows.columns))


def reconcile(on_disk: DataFrame, indexed: DataFrame, key: str = "path") -> DataFrame:
    """(path, side): what is indexed but gone from disk ('missing') and what lies on disk unindexed ('new')."""
    disk, state = (d.select(key).where(F.col(key).isNotNull()).distinct() for d in (on_disk, indexed))
    gone = state.join(disk, key, "left_anti").select(key, F.lit("missing").alias("side"))
    return gone.unionByName(disk.join(state, key, "left_anti").select(key, F.lit("new").alias("side")))


def chunk_totals(elements: DataFrame) -> DataFrame:
    """(file_path, chars, tokens, pages, chars_per_page)."""
    return elements.groupBy("file_path").agg(
        F.sum(F.coalesce(F.char_length("text"), F.lit(0))).alias("chars"), F.sum(token_estimate(F.col("text"))).alias("tokens"), F.countDistinct("page").alias("pages")
    ).withColumn("chars_per_page", F.round(F.col("chars") / F.greatest("pages", F.lit(1)), 4))


def ocr_retries(extracted: DataFrame, chunks: DataFrame) -> DataFrame:
    """(file_path): files that came out without a chunk though their extractor was not OCR already."""
    done = chunks.where(F.col("file_path").isNotNull()).select("file_path").distinct()
    tried = extracted.where(F.col("file_path").isNotNull()).groupBy("file_path").agg(F.max(F.when(F.col("extractor") == "ocr", 1).otherwise(0)).alias("_ocr"))
    return tried.where("_ocr = 0").join(done, "file_path", "left_anti").select("file_path")
