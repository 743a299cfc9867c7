"""Encoding the corpus with a public byte-level BPE tokenizer.

Merging uses a segment tree over the ranks of adjacent pairs: its root gives the leftmost pair of
lowest rank, and a merge changes two leaves, each in logarithmic time, so a run of n bytes without
a break takes O(n log n), however long it is.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from corpusloom.session import spread, table

#: Merged pieces a worker keeps; the store is emptied when it is full.
CACHE_PIECES = 1 << 18
#: Pieces longer than this are not kept.
CACHE_CHARS = 64


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


class PairTree:
    """Merging one piece. Leaf i holds the rank of the pair that starts at symbol i."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.none = 1 << 40

    def merge(self, piece: bytes) -> list[int]:
        ranks, none = self.ranks, self.none
        n = len(piece)
        if n == 1:
            return [ranks[piece]]
        part: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        size = 1
        while size < n:
            size *= 2
        tree = [none] * (2 * size)
        for i in range(n - 1):
            tree[size + i] = ranks.get(piece[i : i + 2], none)
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a <= b else b

        def put(i: int, value: int) -> None:
            i += size
            tree[i] = value
            i >>= 1
            while i:
                a, b = tree[2 * i], tree[2 * i + 1]
                low = a if a <= b else b
                if tree[i] == low:
                    return
                tree[i] = low
                i >>= 1

        while (low := tree[1]) < none:
            i = 1
            while i < size:  # the left child wins ties: leftmost pair of this rank
                i = 2 * i if tree[2 * i] == low else 2 * i + 1
            i -= size
            j = after[i]
            part[i] += part[j]
            part[j] = None
            k = after[j]
            after[i] = k
            put(j, none)
            if k < n:
                before[k] = i
                put(i, ranks.get(part[i] + part[k], none))
            else:
                put(i, none)
            h = before[i]
            if h >= 0:
                put(h, ranks.get(part[h] + part[i], none))
        out, i = [], 0
        while i < n:
            out.append(ranks[part[i]])
            i = after[i]
        return out


class Encoder:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.find = regex.compile(pattern).findall
        self.tree = PairTree(self.ranks)
        self.kept: dict[str, list[int]] = {}

    def encode(self, text: str | None) -> list[int]:
        """Ids of ``text``; the empty list for an empty or null text."""
        out: list[int] = []
        if not text:
            return out
        kept = self.kept
        for piece in self.find(text):
            ids = kept.get(piece)
            if ids is None:
                ids = self.tree.merge(piece.encode("utf-8", "surrogatepass"))
                if len(piece) <= CACHE_CHARS:
                    if len(kept) >= CACHE_PIECES:
                        kept.clear()
                    kept[piece] = ids
            out += ids
        return out


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def encode_corpus(documents: DataFrame, text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``documents`` with ``ids``, the token ids of ``text``, without special tokens.

    An empty and a null text both give the empty list, so ``ids`` is never null. Strings that spell a
    special token are ordinary text. A column ``ids`` of the input is replaced. Every row is kept.
    """
    import public_tokenizers

    path, pattern = path or vocabulary_path(), pattern or public_tokenizers.PATTERN
    rest = [f for f in documents.schema.fields if f.name != "ids"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest) + ", ids array<int>"
    names = [f.name for f in rest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for batch in batches:
            ids = pa.array([enc.encode(t) for t in batch.column(names.index(text)).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], [*names, "ids"])

    return documents.select(*[f"`{n}`" for n in names]).mapInArrow(run, schema)


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return encode_corpus(docs).select("doc_id", "ids")
