"""Groups of near-duplicate texts by Golay-code fuzzy hashing.

A text's fingerprint has eight segments of 23 bits. A segment's bits say whether any distinct word of
the text falls into a slot, with the share of words that count set so that about half of the slots
are taken; a small edit changes few bits. The perfect Golay code (23, 12, 7) partitions all 23-bit
words into balls of radius 3, and a segment is looked up under the index of every codeword within
distance 4, about 5.3 of them, so that two segments with few errors share a key. By pigeonhole, one of
the eight segments of two similar texts holds at most an eighth of their errors.

Twelve bits can't tell millions of texts apart, so every key also holds an anchor: one of the seven
least-hashed seven-word sequences of the text. Texts are brought together by anchor once, and the keys of
all eight segments are joined there, without another shuffle. An anchor that many texts share, such as a
phrase of a template, would bring together pairs by the square of their number. All texts that hold one are joined
by their rarest word sequences instead: in any common order, two texts as similar as asked share one of the first that
each has, as many as it can lack and one more; pairs are made only of texts of which enough is left from there on. What meets under a key and differs in few bits of a sketch of the
word sequences themselves is verified by the exact similarity of the distinct word sequences.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from corpusloom.session import cut, spread, table

ANCHORS, ANCHOR_WORDS, SEGMENTS, BITS, SKETCH = 7, 7, 8, 23, 63
#: Of the 126 bits of the sketch, texts at a similarity of 0.6 differ in about 21 and at most 35, at 0.2 in about 48.
MAX_BITS = 38
#: An anchor that more texts share is hot, and so is a word sequence in the texts that hold such an anchor.
HOT = 512
#: So many hot word sequences are put in order by how frequent they are, the others by hash; this decides what the join costs, not what it finds.
ORDERED = 200_000
#: Tables of ids and anchors are broadcast up to so many rows of one or two longs, beyond that they are shuffled.
BROADCAST_ROWS = 200_000
#: Copies of one text are written out as all their pairs up to this many rows, beyond as pairs with the least row.
EXPAND = 64

_WORD = re.compile(r"[^\W_]+")
_U = np.uint64
_LOW = _U((1 << 44) - 1)
_GENERATOR = 0b101011100011  # x^11+x^9+x^7+x^6+x^5+x+1, of the (23, 12) Golay code


def split_words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


# ---- the code ----------------------------------------------------------------------------------


def syndrome(x: int) -> int:
    for b in range(BITS - 1, 10, -1):
        if x >> b & 1:
            x ^= _GENERATOR << (b - 11)
    return x


def _tables() -> tuple[list[int], list[list[int]]]:
    """By syndrome: the error of weight at most 3, and the codewords to add to reach all within distance 4."""
    code = [(m << 11) | syndrome(m << 11) for m in range(1 << 12)]
    light = [c for c in code if c.bit_count() in (7, 8)]
    leader = [0] * 2048
    for weight in range(4):
        for at in combinations(range(BITS), weight):
            e = sum(1 << p for p in at)
            leader[syndrome(e)] = e
    return leader, [[0, *(c for c in light if (c ^ e).bit_count() <= 4)] for e in leader]


_TABLES: list = []


def _load() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(errors by syndrome, indices to add by syndrome, how many of them, syndromes of the upper twelve bits)."""
    if not _TABLES:
        leader, adds = _tables()
        count = np.array([len(x) for x in adds])
        padded = np.zeros((len(adds), count.max()), np.int64)
        for i, x in enumerate(adds):
            padded[i, : len(x)] = [c >> 11 for c in x]
        _TABLES.extend((np.array(leader, np.int64), padded, count, np.array([syndrome(m << 11) for m in range(1 << 12)], np.int64)))
    return tuple(_TABLES)


def near_codewords(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For words of 23 bits: (position in ``x``, 12-bit index) of every codeword within distance 4, by position, the nearest first."""
    leader, adds, count, upper = _load()
    s = (x & 2047) ^ upper[x >> 11]
    nearest = (x ^ leader[s]) >> 11
    at = np.repeat(np.arange(len(x)), count[s])
    nth = np.arange(len(at)) - np.repeat(np.cumsum(count[s]) - count[s], count[s])
    return at, nearest[at] ^ adds[s[at], nth]


def codeword_indices(x: int) -> list[int]:
    """The 12-bit indices of all codewords within distance 4 of ``x``, the nearest first."""
    return near_codewords(np.array([x], np.int64))[1].tolist()


# ---- fingerprints, whole batches at a time -----------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _grams(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-word sequences: their documents and 44-bit hashes, ordered by both."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    g = np.zeros(m, _U)
    for j in range(n):
        g = _mix(g * _U(0x9E3779B97F4A7C15) + h[j : m + j])
    inside = doc[:m] == doc[n - 1 :]
    both = np.sort((doc[:m][inside].astype(_U) << _U(44)) | (g[inside] & _LOW))
    both = both[np.concatenate([[True], both[1:] != both[:-1]])]
    return (both >> _U(44)).astype(np.int64), both & _LOW


class _Tokens(dict):
    """The hashes of the words of each run without white space, made when first asked for."""

    def __missing__(self, token: str) -> tuple[int, ...]:
        if len(self) > 1 << 20:
            self.clear()
        v = self[token] = tuple(xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in _WORD.findall(token))
        return v


class Fingerprinter:
    def __init__(self, shingle: int, min_words: int):
        self.shingle, self.min_words = shingle, min_words
        self.tokens = _Tokens()

    def words(self, texts: list[str | None]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Of the texts that have enough words: positions in ``texts``, hashes of all words and whose they are."""
        at, lengths, flat = [], [], []
        for i, t in enumerate(texts):
            if not t:
                continue
            w = list(chain.from_iterable(map(self.tokens.__getitem__, t.lower().split())))
            if len(w) >= self.min_words:
                at.append(i)
                lengths.append(len(w))
                flat.append(np.array(w, _U))
        return at, np.concatenate([np.zeros(0, _U), *flat]), np.repeat(np.arange(len(at)), lengths)

    def grams(self, texts: list[str | None]) -> np.ndarray:
        """The distinct word sequences of each text, one after the other."""
        _, h, doc = self.words(texts)
        with np.errstate(over="ignore"):
            return _grams(h, doc, self.shingle)[1]

    def first_grams(self, texts: list[str | None], hot: np.ndarray, places: np.ndarray, threshold: float) -> dict:
        """Of each text's distinct word sequences the first, as many as a text at the threshold can lack and one more.

        The sorted ``hot`` sequences come last, by their ``places``, the others before by hash.
        """
        at, h, doc = self.words(texts)
        k = len(at)
        if not k:
            return {"at": at}
        with np.errstate(over="ignore"):
            d, g = _grams(h, doc, self.shingle)
            start = np.searchsorted(d, np.arange(k))
            sketch = _sketch(g, d, start, k)
            n = np.bincount(d, minlength=k)
            rank = _mix(g) >> _U(1)
        if len(hot):
            i = np.minimum(np.searchsorted(hot, g), len(hot) - 1)
            rank = np.where(hot[i] == g, (_U(1) << _U(63)) + places[i], rank)
        order, before = np.lexsort((rank, d)), np.arange(len(d)) - start[d]
        first = before < (n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1)[d]
        d, g = d[first], g[order][first]
        return {"at": np.array(at, np.int64)[d], "gram": g.astype(np.int64), "n": n[d], "left": n[d] - before[first], "sketch": [x[d] for x in sketch]}

    def batch(self, texts: list[str | None]) -> dict:
        """Columns for those texts that have enough words; ``at`` gives their positions in ``texts``."""
        at, h, doc = self.words(texts)
        k = len(at)
        if not k:
            return {"at": at}
        with np.errstate(over="ignore"):
            d, g = _grams(h, doc, self.shingle)
            start = np.searchsorted(d, np.arange(k))
            one, two = np.add.reduceat(_mix(g), start), np.add.reduceat(_mix(g ^ _U(0x5851F42D4C957F2D)), start)
            sketch = _sketch(g, d, start, k)
            d, g = _grams(h, doc, 1)
            start = np.searchsorted(d, np.arange(k))
            seg = [_slots(g ^ _U(s * 7919 + 13), d, start, k, BITS, 16) for s in range(SEGMENTS)]
            d, g = _grams(h, doc, ANCHOR_WORDS)
        start = np.searchsorted(d, np.arange(k + 1))
        n = np.minimum(np.diff(start), ANCHORS)
        ends = np.cumsum(n)
        chosen = np.arange(ends[-1]) - np.repeat(ends - n, n) + np.repeat(start[:-1], n)
        return {"at": at, "one": one.view(np.int64), "two": two.view(np.int64), "packed": pack_segments(seg), "sketch": sketch, "anchors": g[chosen].astype(np.int64), "offsets": np.concatenate([[0], ends])}


def _sketch(g: np.ndarray, d: np.ndarray, start: np.ndarray, k: int) -> list[np.ndarray]:
    return [_slots(g ^ _U(seed), d, start, k, SKETCH, SKETCH * 0.69) for seed in (0x2545F4914F6CDD1D, 0x1B873593)]


def _slots(g: np.ndarray, d: np.ndarray, start: np.ndarray, k: int, bits: int, least: float) -> np.ndarray:
    """Per document which of the slots its chosen items fall into; about half of the slots are taken."""
    v = _mix(g)
    limit = bits * 0.69 / np.maximum(np.bincount(d, minlength=k), least)
    bit = np.where((v >> _U(32)) / 2.0**32 < limit[d], _U(1) << (v % _U(bits)), _U(0))
    return np.bitwise_or.reduceat(bit, start).astype(np.int64)


def pack_segments(seg: list[np.ndarray]) -> list[np.ndarray]:
    """The eight segments in four longs, two in each."""
    return [seg[i] | seg[i + 1] << BITS for i in range(0, SEGMENTS, 2)]


def segment(packed: list[np.ndarray], s: int) -> np.ndarray:
    return packed[s // 2] >> BITS * (s % 2) & ((1 << BITS) - 1)


_PRINT = ["f0", "f1", "f2", "f3", "s0", "s1"]
_FINGERPRINT = "row_id bigint, one bigint, two bigint, " + "".join(f"{c} bigint, " for c in _PRINT) + "anchors array<bigint>"


def fingerprints(rows: DataFrame, key: str, text: str, shingle: int, min_words: int) -> DataFrame:
    """Per text of at least ``min_words`` words: a hash of its set of word sequences, the fingerprint (two segments in each of f0 to f3), the sketch and anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Fingerprinter(shingle, min_words)
        for batch in batches:
            got = maker.batch(batch.column(1).to_pylist())
            if not got["at"]:
                continue
            longs = [pa.array(c) for c in (got["one"], got["two"], *got["packed"], *got["sketch"])]
            anchors = pa.ListArray.from_arrays(pa.array(got["offsets"], pa.int32()), pa.array(got["anchors"], pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(got["at"])), *longs, anchors], ["row_id", "one", "two", *_PRINT, "anchors"])

    return rows.select(F.col(key).cast("long"), text).mapInArrow(run, _FINGERPRINT)


# ---- meeting under a key -------------------------------------------------------------------------


def _near(x: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the sketches of rows i and j differ in few bits."""
    return np.bitwise_count(x[0][i] ^ x[0][j]).astype(np.int16) + np.bitwise_count(x[1][i] ^ x[1][j]) <= MAX_BITS


def _runs(keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions with equal keys, in blocks: each position with the one 1, 2, ... places on in the order of keys."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    live, step = np.arange(len(k)), 1
    while True:
        live = live[live + step < len(k)]
        live = live[k[live] == k[live + step]]
        if not len(live):
            return
        yield order[live], order[live + step]
        step += 1


def meet(groups: np.ndarray, packed: list[np.ndarray], sketch: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one group that share a codeword index of a segment and are close in their sketch."""
    found = []
    for s in range(SEGMENTS):
        at, index = near_codewords(segment(packed, s))
        for i, j in _runs(groups[at] << 12 | index):
            i, j = at[i], at[j]
            close = _near(sketch, i, j)
            found.append(np.minimum(i[close], j[close]) << 32 | np.maximum(i[close], j[close]))
    both = np.sort(np.concatenate([np.zeros(0, np.int64), *found]))
    both = both[np.concatenate([[True], both[1:] != both[:-1]])[: len(both)]]
    return both >> 32, both & ((1 << 32) - 1)


def _sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Columns of the rows that share their first one, in which a partition is sorted, with another row, and the groups' numbers; a batch's last group waits for the next batch."""
    held: list[np.ndarray] | None = None

    def shared(cols: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
        group = np.cumsum(np.concatenate([[True], cols[0][1:] != cols[0][:-1]]))
        keep = np.bincount(group)[group] > 1
        return [c[keep] for c in cols], group[keep]

    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            cols = [np.concatenate(c) for c in zip(held, cols)]
        if not len(cols[0]):
            continue
        whole = int(np.searchsorted(cols[0], cols[0][-1]))
        held = [c[whole:] for c in cols]
        if whole:
            yield shared([c[:whole] for c in cols])
    if held is not None and len(held[0]):
        yield shared(held)


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _meet_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of a partition sorted by anchor."""
    for cols, group in _sorted_groups(batches):
        i, j = meet(group, cols[2:6], cols[6:8])
        yield _pairs(cols[1][i], cols[1][j])


def _ranges(counts: np.ndarray, at_once: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of each position with as many of the next ones as ``counts`` says, in blocks."""
    ends, low = np.cumsum(counts), 0
    while low < len(counts):
        done = ends[low] - counts[low]
        high = max(low + 1, int(np.searchsorted(ends, done + at_once, side="right")))
        n = counts[low:high]
        i = np.repeat(np.arange(low, high), n)
        yield i, i + 1 + np.arange(len(i)) - np.repeat(ends[low:high] - n - done, n)
        low = high


def _meet_grams(threshold: float):
    """Candidate pairs of a partition sorted by word sequence and number of sequences: those that can be as similar as asked and are close in their sketch.

    Similar texts have at least the share t / (1 + t) of both their numbers in common. If they first meet here, all that lies before is
    theirs alone, and what is left of either must hold as many; where it doesn't, a similar pair has met before.
    """
    share = threshold / (1 + threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, row, n, left, *sketch), group in _sorted_groups(batches):
            longest = np.floor(np.minimum(n / threshold, left / share - n) + 1e-6).astype(np.int64)
            ends = np.searchsorted(group << 32 | n, group << 32 | np.maximum(longest, 0), side="right")
            for i, j in _ranges(np.maximum(ends - np.arange(len(n)) - 1, 0)):
                able = left[j] >= share * (n[i] + n[j]) - 1e-6
                i, j = i[able], j[able]
                close = _near(sketch, i, j)
                if close.any():
                    yield _pairs(row[i[close]], row[j[close]])

    return run


def _first_grams(texts: DataFrame, shingle: int, threshold: float, min_words: int) -> DataFrame:
    """(gram, row_id, n, left, s0, s1): the first word sequences of each text (row_id, text), those in many texts last, and how many each has from there on."""

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # What stands once in a batch isn't counted: it is that much more frequent at most.
        maker = Fingerprinter(shingle, min_words)
        for batch in batches:
            g, n = np.unique(maker.grams(batch.column(1).to_pylist()), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(g[n > 1].astype(np.int64)), pa.array(n[n > 1])], ["gram", "n"])

    counts = texts.mapInArrow(often, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") > HOT)
    hot = np.array([r.gram for r in counts.orderBy(F.desc("n"), "gram").limit(ORDERED).collect()], _U)[::-1]
    by = np.argsort(hot)
    hot, places = hot[by], by.astype(_U)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Fingerprinter(shingle, min_words)
        for batch in batches:
            got = maker.first_grams(batch.column(1).to_pylist(), hot, places, threshold)
            if len(got["at"]):
                yield pa.RecordBatch.from_arrays([pa.array(got["gram"]), batch.column(0).take(pa.array(got["at"])), *map(pa.array, (got["n"], got["left"], *got["sketch"]))], ["gram", "row_id", "n", "left", "s0", "s1"])

    return texts.mapInArrow(run, "gram bigint, row_id bigint, n bigint, left bigint, s0 bigint, s1 bigint")


def _sets(shingle: int):
    known: dict[str | None, frozenset[int]] = {}

    def of(text: str | None) -> frozenset[int]:
        got = known.get(text)
        if got is None:
            if len(known) > 4096:
                known.clear()
            w = split_words(text)
            got = known[text] = frozenset(zip(*(w[i:] for i in range(shingle))))
        return got

    return of


def _verify(shingle: int):
    @F.pandas_udf(DoubleType())
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        of, out = _sets(shingle), []
        for x, y in zip(map(of, a), map(of, b)):
            both = len(x & y)
            out.append(both / (len(x) + len(y) - both) if x or y else 0.0)
        return pd.Series(out, dtype="float64")

    return score


def classes(prints: DataFrame) -> DataFrame:
    """(row_id, rep, n): each row's class of rows with the same set of word sequences; only classes of two or more."""
    sizes = prints.groupBy("one", "two").agg(F.min("row_id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return prints.select("row_id", "one", "two").join(sizes, ["one", "two"]).select("row_id", "rep", "n")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def candidates_of(reps: DataFrame, rows: DataFrame, key: str, text: str, shingle: int, threshold: float, min_words: int) -> DataFrame:
    """(a, b): pairs of fingerprints that meet under a key, a < b; ``rows`` holds their texts."""
    anchored = reps.select(F.explode("anchors").alias("anchor"), "row_id", *_PRINT)
    hot = cut(anchored.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select("anchor"))
    shared = _small(hot)
    cold = anchored.join(shared, "anchor", "left_anti").repartition("anchor").sortWithinPartitions("anchor")
    out = cold.mapInArrow(_meet_sorted, "a bigint, b bigint")
    if hot.limit(1).count():
        holders = cut(anchored.select("anchor", "row_id").join(shared, "anchor", "left_semi").select("row_id").distinct())
        texts = cut(rows.select(F.col(key).cast("long").alias("row_id"), F.col(text).alias("text")).join(_small(holders), "row_id", "left_semi"))
        grams = _first_grams(texts, shingle, threshold, min_words).repartition("gram").sortWithinPartitions("gram", "n")
        out = out.unionByName(grams.mapInArrow(_meet_grams(threshold), "a bigint, b bigint"))
    return out.distinct()


def class_pairs(rows: DataFrame, prints: DataFrame, copies: DataFrame, key: str, text: str, shingle: int, threshold: float, min_words: int) -> DataFrame:
    """(a, b, similarity): the similar pairs between class representatives, a < b."""
    reps = prints.join(_small(copies.where("row_id <> rep").select("row_id")), "row_id", "left_anti")
    return cut(_verified(rows, cut(candidates_of(reps, rows, key, text, shingle, threshold, min_words)), key, text, shingle, threshold))


def _verified(rows: DataFrame, candidates: DataFrame, key: str, text: str, shingle: int, threshold: float) -> DataFrame:
    """Those of the candidate pairs (a, b) that are as similar as asked; only texts of candidates are read."""
    wanted = candidates.select(F.explode(F.array("a", "b")).alias("_id")).distinct()
    texts = rows.select(F.col(key).cast("long").alias("_id"), F.col(text).alias("_text")).join(wanted, "_id", "left_semi")
    both = (
        candidates.join(texts.select(F.col("_id").alias("a"), F.col("_text").alias("_ta")), "a")
        .join(texts.select(F.col("_id").alias("b"), F.col("_text").alias("_tb")), "b")
        .select("a", "b", _verify(shingle)("_ta", "_tb").alias("similarity"))
    )
    # The tolerance keeps pairs whose ratio equals the threshold but for its last binary digit.
    return both.where(F.col("similarity") >= threshold - 1e-12)


def near_duplicates(rows: DataFrame, key: str, text: str, shingle: int = 5, threshold: float = 0.8, min_words: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(copies, pairs): classes of equal rows and similar pairs of their representatives.

    ``copies`` is (row_id, rep, n) for rows in classes of two or more; ``pairs`` is (a, b, similarity).
    Texts that are null, empty or shorter than ``min_words`` (``shingle`` at least) are in neither.
    ``key`` must be unique and not null.
    """
    rows = rows.select(key, text)
    min_words = max(shingle, min_words or 0)
    prints = cut(fingerprints(rows, key, text, shingle, min_words))
    copies = cut(classes(prints))
    return copies, class_pairs(rows, prints, copies, key, text, shingle, threshold, min_words)


def row_pairs(copies: DataFrame, pairs: DataFrame) -> DataFrame:
    """(row_id_a, row_id_b): pairs of rows, smaller id first.

    Classes of up to EXPAND copies stand in full. A larger class stands as the pairs of each copy with
    the representative, and only the representative carries its pairs with other classes; from
    these every other link follows, as copies have equal links.
    """
    small = copies.where(F.col("n") <= EXPAND)
    within = small.select(F.col("row_id").alias("a"), "rep").join(small.select(F.col("row_id").alias("b"), "rep"), "rep").where("a < b").select("a", "b")
    star = copies.where((F.col("n") > EXPAND) & (F.col("row_id") != F.col("rep"))).select(F.col("rep").alias("a"), F.col("row_id").alias("b"))
    x = small.select(F.col("rep").alias("a"), F.col("row_id").alias("ma"))
    y = small.select(F.col("rep").alias("b"), F.col("row_id").alias("mb"))
    across = pairs.join(x, "a", "left").join(y, "b", "left").select(F.coalesce("ma", "a").alias("a"), F.coalesce("mb", "b").alias("b"))
    out = within.unionByName(star).unionByName(across)
    # Each pair stands once: within a class, with its representative, or across two classes.
    return out.select(F.least("a", "b").alias("row_id_a"), F.greatest("a", "b").alias("row_id_b"))


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 40) -> DataFrame:
    """(id, group_id): connected components by the least id, with label doubling between rounds."""
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y"))
    both = cut(both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    label = cut(both.groupBy("x").agg(F.least("x", F.min("y")).alias("l")).select(F.col("x").alias("id"), "l"))
    for _ in range(max_rounds):
        near = both.join(label.select(F.col("id").alias("y"), "l"), "y").groupBy("x").agg(F.min("l").alias("m"))
        step = label.join(near, F.col("id") == F.col("x"), "left").select("id", F.least("l", "m").alias("l2"), "l")
        jump = label.select(F.col("id").alias("_j"), F.col("l").alias("_jl"))
        new = cut(step.join(jump, F.col("l2") == F.col("_j"), "left").select("id", F.least("l2", "_jl").alias("n"), "l"))
        if not new.where("n <> l").limit(1).count():
            return new.select("id", F.col("n").alias("group_id"))
        label = new.select("id", F.col("n").alias("l"))
    raise RuntimeError("components did not settle")


def groups(copies: DataFrame, pairs: DataFrame) -> DataFrame:
    """(row_id, group_id, n_links): each grouped row with the least row_id of its group and its number of similar rows."""
    pairs = pairs.select("a", "b")
    edges = pairs.unionByName(copies.where("row_id <> rep").select(F.col("rep").alias("a"), F.col("row_id").alias("b")))
    parts = components(edges)
    size = copies.where("row_id = rep").select("rep", "n")
    ends = pairs.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(pairs.select(F.col("b").alias("x"), F.col("a").alias("y")))
    outer = ends.join(size, F.col("y") == F.col("rep"), "left").groupBy("x").agg(F.sum(F.coalesce("n", F.lit(1))).alias("outer"))
    rep_of = parts.join(copies.select(F.col("row_id").alias("id"), "rep", "n"), "id", "left").withColumn("rep", F.coalesce("rep", "id"))
    return rep_of.join(outer, F.col("rep") == F.col("x"), "left").select(
        F.col("id").alias("row_id"), "group_id", (F.coalesce("n", F.lit(1)) - 1 + F.coalesce("outer", F.lit(0))).cast("long").alias("n_links")
    )


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "chunks").select("row_id", "text"), "row_id", per_core=1)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return row_pairs(*near_duplicates(_chunks(spark, sf_dir), "row_id", "text", shingle=3, threshold=0.6, min_words=20))


def p7_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(*near_duplicates(_chunks(spark, sf_dir), "row_id", "text", shingle=5, threshold=0.8))
