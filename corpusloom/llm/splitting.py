"""Splitting oversized records at natural boundaries.

A record of at most ``limit`` characters, headings included, stays whole. A larger one is cut where its
vocabulary changes most: at each gap between sentences the words before and after it are compared as
blocks, and within each window in which the next cut must fall the gap at the deepest valley of the
similarity is taken. Where a window holds no sentence gap the cut goes to the last clause or word gap,
and where there is none to the last character that is not followed by a combining mark. Each piece but
the first begins 64 to 160 characters before the end of the piece before it, at a sentence or word if
one begins there.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.sentences import sentence_spans
from corpusloom.session import spread, table

LIMIT, MIN_OVERLAP, MAX_OVERLAP = 1024, 64, 160
#: Words on each side of a gap that are compared.
BLOCK = 24
#: Cuts fall in the last part of a window, from this share of its length.
EARLIEST = 0.55

_WORDS = re.compile(r"[぀-ヿ㐀-鿿]|[^\W_぀-ヿ㐀-鿿]+")
_CLAUSE = re.compile(r"[,;:،；：，、]\s*|\s[—–-]\s")
_SPACE = re.compile(r"\s+(?=\S)")


def depths(text: str, gaps: list[int]) -> list[float]:
    """How deep the similarity valley is at each gap: the sum of the rises to the peaks on either side."""
    words, at = [], []
    for m in _WORDS.finditer(text):
        words.append(m.group().lower())
        at.append(m.start())
    sims = []
    for g in gaps:
        i = bisect_left(at, g)
        a, b = Counter(words[max(0, i - BLOCK) : i]), Counter(words[i : i + BLOCK])
        dot = sum(n * b[w] for w, n in a.items() if w in b)
        norm = math.sqrt(sum(n * n for n in a.values()) * sum(n * n for n in b.values()))
        sims.append(dot / norm if norm else 0.0)
    out = []
    for i, s in enumerate(sims):
        left = right = s
        for j in range(i - 1, -1, -1):
            if sims[j] < left:
                break
            left = sims[j]
        for j in range(i + 1, len(sims)):
            if sims[j] < right:
                break
            right = sims[j]
        out.append(left - s + right - s)
    return out


def _starts(pattern: re.Pattern, text: str) -> list[int]:
    return [m.end() for m in pattern.finditer(text)]


def cut_spans(text: str, budget: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of ``text``, which together cover all of it, each of at most ``budget`` characters."""
    n = len(text)
    if n <= budget:
        return [(0, n)]
    sentences = [a for a, _ in sentence_spans(text)][1:]
    depth = depths(text, sentences)
    clauses, spaces = _starts(_CLAUSE, text), _starts(_SPACE, text)
    low, high = min(MIN_OVERLAP, budget // 4), min(MAX_OVERLAP, budget // 2)
    out, a = [], 0
    while n - a > budget:
        first, last = a + max(high + 1, int(budget * EARLIEST)), a + budget
        i, j = bisect_left(sentences, first), bisect_right(sentences, last)
        if i < j:
            b = sentences[max(range(i, j), key=lambda k: (round(depth[k], 9), k))]
        else:
            b = next((c[bisect_right(c, last) - 1] for c in (clauses, spaces) if bisect_left(c, first) < bisect_right(c, last)), last)
            while b > first and unicodedata.combining(text[b]):
                b -= 1
        out.append((a, b))
        earliest, latest = b - high, b - low
        nxt = next((c[k] for c in (sentences, spaces) if (k := bisect_left(c, earliest)) < len(c) and c[k] <= latest), b - (low + high) // 2)
        while nxt > earliest and unicodedata.combining(text[nxt]):
            nxt -= 1
        a = nxt
    out.append((a, n))
    return out


def pieces_of(text: str | None, headings: list[str] | None, limit: int = LIMIT) -> list[tuple[str, int, int]]:
    """(piece, start, end) with the heading path before each piece; positions count from the start of the text.

    A heading path that takes more than half of the limit is not repeated: it precedes the text as text,
    at negative positions, and is cut with it.
    """
    body = text or ""
    prefix = " > ".join(h for h in headings if h is not None) + "\n" if headings else ""
    shift = 0
    if len(prefix) > limit // 2:
        body, shift, prefix = prefix + body, len(prefix), ""
    return [(prefix + body[a:b], a - shift, b - shift) for a, b in cut_spans(body, limit - len(prefix))]


_PIECE = "record_kind string, record_id bigint, page int, headings array<string>, piece_no int, n_pieces int, char_from int, char_to int, piece string"


def record_size(text: Column, headings: Column | None) -> Column:
    """Characters of a record: of its text, and of its heading path and the line break after it if it has any."""
    own = F.coalesce(F.char_length(text), F.lit(0))
    if headings is None:
        return own
    path = F.when(F.coalesce(F.size(headings), F.lit(0)) > 0, F.char_length(F.array_join(headings, " > ")) + 1)
    return own + F.coalesce(path, F.lit(0))


def split_records(rows: DataFrame, kind: str, key: str, text: str = "text", headings: str | None = None, page: str = "page", limit: int = LIMIT) -> DataFrame:
    """The pieces of all records: kind, id, page, headings, order, number of pieces, place in the text, piece.

    Records within the limit, the null, empty and blank ones included, come out as one piece (a null text
    as an empty one) and never leave the JVM. Other columns are dropped. Repeated rows are split each on
    their own.
    """
    head = F.col(headings) if headings else F.lit(None).cast("array<string>")
    base = rows.select(
        F.lit(kind).alias("record_kind"), F.col(key).cast("long").alias("record_id"), F.col(page).alias("page"), head.alias("headings"), F.col(text).alias("text")
    ).withColumn("chars", record_size(F.col("text"), F.col("headings") if headings else None))
    path = F.when(F.coalesce(F.size("headings"), F.lit(0)) > 0, F.concat(F.array_join("headings", " > "), F.lit("\n")))
    whole = base.where(F.col("chars") <= limit).select(
        "record_kind", "record_id", "page", "headings", F.lit(0).alias("piece_no"), F.lit(1).alias("n_pieces"), F.lit(0).alias("char_from"),
        F.coalesce(F.char_length("text"), F.lit(0)).alias("char_to"), F.concat(F.coalesce(path, F.lit("")), F.coalesce("text", F.lit(""))).alias("piece"),
    )
    large = base.where(F.col("chars") > limit).drop("chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _PIECE.split(", ")]
        for batch in batches:
            made: list[dict] = []
            for r in batch.to_pylist():
                parts = pieces_of(r["text"], r["headings"], limit)
                same = {k: r[k] for k in ("record_kind", "record_id", "page", "headings")}
                made += [same | {"piece_no": i, "n_pieces": len(parts), "char_from": a, "char_to": b, "piece": p} for i, (p, a, b) in enumerate(parts)]
            yield pa.RecordBatch.from_pylist(made, schema=_arrow()).select(names)

    return whole.unionByName(large.mapInArrow(run, _PIECE))


def _arrow() -> pa.Schema:
    t = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}
    return pa.schema([(f.split()[0], t[f.split()[1]]) for f in _PIECE.split(", ")])


def pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "chunks").select("row_id", "text", "headings", "page")
    elements = table(spark, sf_dir, "elements").select("element_id", "text", "page")
    return split_records(chunks, "chunk", "row_id", headings="headings").unionByName(split_records(elements, "element", "element_id"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that did not stay whole; each has one piece of number 0."""
    return pieces(spark, sf_dir).where((F.col("n_pieces") > 1) & (F.col("piece_no") == 0)).select("record_kind", "record_id")


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces(spark, sf_dir)
