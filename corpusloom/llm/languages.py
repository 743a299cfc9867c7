"""Languages of short texts, and of the parts of texts in several languages.

A string kernel: two texts are as similar as the share of blended n-grams (one to four characters,
present or not) that both have. Nyström landmarks make it finite, and one-versus-rest kernel ridge
regression on them is fitted to a bounded sample of the labelled rows, twice: rows whose label the
first fit contradicts are left out of the second, as labels are often wrong. As kernel, projection and
regression are linear in a text's n-grams, a whole batch is scored by one product of its sparse
presence matrix with a (n-grams x languages) matrix.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusloom.session import spread, table

LANGUAGES = ("es", "en", "fr", "de", "pt", "la")
#: Labelled rows used per language, and how many of them are landmarks.
SAMPLE, LANDMARKS = 500, 110
ORDERS, RIDGE = 4, 0.02
#: A part of a text counts as another language from this many words.
MIN_WORDS = 4
#: Least lead of the best language over the next for a text's language to count as told.
MIN_LEAD = 0.02
#: A usable label is contradicted only with at least this confidence.
MIN_CONFIDENCE = 0.85

# Names of languages in label notations, by code.
NAMES = {
    "es": ("es", "spa", "esp", "espanol", "castellano", "spanish", "espagnol", "spanisch", "espanhol", "castilian", "hispanica"),
    "en": ("en", "eng", "english", "ingles", "anglais", "englisch", "inglese", "anglica"),
    "fr": ("fr", "fra", "fre", "french", "frances", "francais", "franzosisch", "francese", "gallica"),
    "de": ("de", "deu", "ger", "german", "aleman", "allemand", "deutsch", "alemao", "tedesco"),
    "pt": ("pt", "por", "portuguese", "portugues", "portugais", "portugiesisch", "portoghese"),
    "la": ("la", "lat", "latin", "latina", "latein", "latim", "latino"),
}
UNUSABLE = frozenset((
    "unknown", "und", "auto", "undefined", "undetermined", "none", "null", "nan", "na", "mul", "mis", "zxx", "xx", "desconocido", "otro", "other",
))


def label_language(label: Column) -> Column:
    """The code a label stands for in any notation; another language's name stays as it is; null if unusable."""
    folded = F.translate(F.lower(F.trim(label)), "áàâãäéèêëíìîïóòôõöúùûüñç", "aaaaaeeeeiiiiooooouuuunc")
    word = F.regexp_extract(folded, "^([a-z]+)", 1)
    code = F.lit(None).cast("string")
    for lang, names in NAMES.items():
        code = F.when(word.isin(*names), lang).otherwise(code)
    return F.when(word.isin(*UNUSABLE) | (word == ""), None).otherwise(F.coalesce(code, word))


class _Letters(dict):
    """Letters and apostrophes as they are, all else as a space."""

    def __missing__(self, code: int) -> str:
        v = self[code] = chr(code) if chr(code).isalpha() or chr(code) in "'’" else " "
        return v


_letters = _Letters()


def normal(text: str | None) -> str:
    """Letters in lower case, all else as single spaces, with a space at either end; '' without letters."""
    if not text:
        return ""
    t = " ".join(unicodedata.normalize("NFC", text).lower().translate(_letters).split())
    return f" {t} " if t.strip(" '’") else ""


# ---- n-grams of whole batches --------------------------------------------------------------------

_U = np.uint64


def _codes(text: str) -> list[np.ndarray]:
    """For each order the hashes of the n-grams at every position of one long string."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(_U)
    out, h = [], np.zeros(len(cp), _U)
    with np.errstate(over="ignore"):
        for n in range(1, ORDERS + 1):
            m = len(cp) - n + 1
            if m <= 0:
                break
            h = h[:m] * _U(0x9E3779B97F4A7C15) + cp[n - 1 :] + _U(1)
            h = (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9)
            out.append(h.copy())
    return out


def presence(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows and hashes of the distinct n-grams of each text, ordered by row and hash."""
    rows, codes = [], []
    joined = "\x00".join(texts)
    owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])[: len(joined)]
    stop = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32) == 0
    crossings = np.concatenate([[0], np.cumsum(stop)])
    for n, h in enumerate(_codes(joined), 1):
        inside = crossings[n : n + len(h)] == crossings[: len(h)]
        rows.append(owner[: len(h)][inside])
        codes.append(h[inside])
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    # Row in the upper 20 bits, 44 bits of the hash below.
    both = np.sort((np.concatenate(rows).astype(_U) << _U(44)) | (np.concatenate(codes) >> _U(20)))
    both = both[np.concatenate([[True], both[1:] != both[:-1]])]
    return (both >> _U(44)).astype(np.int64), both & _U((1 << 44) - 1)


@dataclass(frozen=True)
class Model:
    """Known n-grams in order, and for each the weight it adds to each language's score."""

    grams: np.ndarray
    weights: np.ndarray

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Scores of single words less their mean, within bounds; each distinct word is scored once."""
        number: dict[str, int] = {}
        at = [number.setdefault(w, len(number)) for w in words]
        if not number:
            return np.zeros((0, len(LANGUAGES)))
        single = self.scores([f" {w} " for w in number])
        return np.clip(single - single.mean(1, keepdims=True), -0.6, 0.6)[at]

    def lookup(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.grams, hashes), len(self.grams) - 1)
        return at, self.grams[at] == hashes

    def scores(self, texts: list[str]) -> np.ndarray:
        """(texts x languages) scores of normalised texts; zeros for texts without letters."""
        out = np.zeros((len(texts), len(LANGUAGES)))
        for at in range(0, len(texts), 1 << 12):
            part = texts[at : at + (1 << 12)]
            rows, hashes = presence(part)
            if not len(rows):
                continue
            size = np.bincount(rows, minlength=len(part))
            g, known = self.lookup(hashes)
            r, w = rows[known], self.weights[g[known]]
            for k in range(len(LANGUAGES)):
                out[at : at + len(part), k] = np.bincount(r, w[:, k], len(part))
            out[at : at + len(part)] /= np.sqrt(np.maximum(size, 1))[:, None]
        return out


def fit(texts: list[str], labels: list[str]) -> Model:
    """Fit to normalised texts and their language codes."""
    y = np.array([LANGUAGES.index(v) for v in labels])
    rows, hashes = presence(texts)
    size = np.sqrt(np.maximum(np.bincount(rows, minlength=len(texts)), 1))

    def once(use: np.ndarray) -> Model:
        own = [np.flatnonzero(use & (y == k)) for k in range(len(LANGUAGES))]
        marks = np.concatenate([i[:: max(1, len(i) // LANDMARKS)][:LANDMARKS] for i in own])
        place = np.full(len(texts), -1)
        place[marks] = np.arange(len(marks))
        mine = place[rows] >= 0
        grams = np.unique(hashes[mine])
        at = np.minimum(np.searchsorted(grams, hashes), len(grams) - 1)
        known = grams[at] == hashes
        land = np.zeros((len(marks), len(grams)), np.float32)
        land[place[rows[mine]], at[mine]] = 1
        land /= size[marks][:, None].astype(np.float32)
        kernel = np.zeros((len(texts), len(marks)))
        for a in range(0, len(texts), 256):
            here = known & (rows >= a) & (rows < a + 256)
            block = np.zeros((min(256, len(texts) - a), len(grams)), np.float32)
            block[rows[here] - a, at[here]] = 1
            kernel[a : a + 256] = (block @ land.T) / size[a : a + 256, None]
        values, vectors = np.linalg.eigh(kernel[marks] + 1e-6 * np.eye(len(marks)))
        root = vectors / np.sqrt(np.maximum(values, 1e-6)) @ vectors.T
        z = kernel[use] @ root
        t = np.where(y[use][:, None] == np.arange(len(LANGUAGES)), 1.0, -1.0)
        weight = 1 / np.maximum(np.bincount(y[use], minlength=len(LANGUAGES)), 1)[y[use]]
        weight *= len(weight) / weight.sum()
        zw = z * weight[:, None]
        beta = np.linalg.solve(zw.T @ z + RIDGE * len(z) * np.eye(z.shape[1]) / z.shape[1] * 5, zw.T @ t)
        return Model(grams, (land.T @ (root @ beta)).astype(np.float64))

    use = np.array([len(t) >= 8 for t in texts]) & np.isin(y, np.arange(len(LANGUAGES)))
    first = once(use)
    agrees = first.scores(texts).argmax(1) == y
    return once(use & agrees) if (use & agrees).sum() >= len(LANGUAGES) else first


def confidence(scores: np.ndarray) -> np.ndarray:
    """Shares of the languages: a softmax of the scores, which lie about between -1 and 1."""
    if not len(scores):
        return scores
    e = np.exp(5 * (scores - scores.max(1, keepdims=True)))
    return e / e.sum(1, keepdims=True)


def _path(emission: np.ndarray, switch: float) -> np.ndarray:
    """The best sequence of languages over (texts x words x languages), by Viterbi on whole batches."""
    n, t, k = emission.shape
    best, back = emission[:, 0], np.zeros((n, t, k), np.int8)
    for i in range(1, t):
        top = best.argmax(1)
        stay, move = best, best.max(1) - switch
        moved = move[:, None] > stay
        back[:, i] = np.where(moved, top[:, None], np.arange(k))
        best = np.where(moved, move[:, None], stay) + emission[:, i]
    out = np.zeros((n, t), np.int8)
    out[:, -1] = best.argmax(1)
    for i in range(t - 1, 0, -1):
        out[:, i - 1] = back[np.arange(n), i, out[:, i]]
    return out


#: Cost of changing the language between two words.
SWITCH = 1.6


def segments(model: Model, texts: list[str | None]) -> list[list[tuple[str, float, int, int]]]:
    """For each text its parts as (language, confidence, first word, end word); none if no language can be told."""
    normed = [normal(t) for t in texts]
    words = [t.split() for t in normed]
    total = model.scores(normed)
    single = model.word_scores([w for ws in words for w in ws])
    ends = np.cumsum([0, *map(len, words)])
    out: list[list[tuple[str, float, int, int]]] = [[] for _ in texts]
    parts: list[tuple[int, int, int]] = []
    order = sorted(range(len(texts)), key=lambda i: len(words[i]))
    for at in range(0, len(order), 256):
        group = [i for i in order[at : at + 256] if words[i]]
        if not group:
            continue
        longest = max(len(words[i]) for i in group)
        e = np.zeros((len(group), longest, len(LANGUAGES)))
        for j, i in enumerate(group):
            e[j, : len(words[i])] = single[ends[i] : ends[i + 1]]
        path = _path(e, SWITCH)
        for j, i in enumerate(group):
            p = path[j, : len(words[i])]
            cuts = [0, *(np.flatnonzero(p[1:] != p[:-1]) + 1).tolist(), len(p)]
            parts += [(i, a, b) for a, b in zip(cuts, cuts[1:])]
    by: dict[int, list[tuple[int, int]]] = {}
    for i, a, b in parts:
        by.setdefault(i, []).append((a, b))
    several = [(i, a, b) for i, ps in by.items() if len(ps) > 1 for a, b in ps]
    part_scores = model.scores([" " + " ".join(words[i][a:b]) + " " for i, a, b in several])
    scored: dict[int, list[tuple[int, int, np.ndarray]]] = {}
    for (i, a, b), s in zip(several, part_scores):
        scored.setdefault(i, []).append((a, b, s))
    mixed: list[tuple[int, list[list]]] = []
    shares, best, ordered = confidence(total), total.argmax(1), np.sort(total, 1)
    lead = ordered[:, -1] - ordered[:, -2]
    for i, ws in enumerate(words):
        if not ws:
            continue
        merged: list[list] = []
        for a, b, s in scored.get(i, ()):
            top = np.sort(s)[::-1]
            strong = b - a >= MIN_WORDS and top[0] - top[1] >= 0.4
            k = int(s.argmax()) if strong else -1
            if merged and (k < 0 or merged[-1][2] < 0 or merged[-1][2] == k):
                merged[-1][1] = b
                merged[-1][2] = max(merged[-1][2], k)
            else:
                merged.append([a, b, k])
        if len({m[2] for m in merged}) > 1:
            mixed.append((i, merged))
            continue
        k = int(best[i])
        if lead[i] >= MIN_LEAD and sum(map(len, ws)) >= 5:
            out[i] = [(LANGUAGES[k], float(shares[i, k]), 0, len(ws))]
    again = iter(confidence(model.scores([" " + " ".join(words[i][a:b]) + " " for i, merged in mixed for a, b, _ in merged])))
    for i, merged in mixed:
        out[i] = [(LANGUAGES[k], float(next(again)[k]), a, b) for a, b, k in merged]
    return out


# ---- operators -----------------------------------------------------------------------------------


def train(rows: DataFrame, key: str, text: str, label: str) -> Model:
    """Fit on at most SAMPLE labelled rows of each language, those least by hash of their key."""
    usable = rows.select(F.xxhash64(key).alias("h"), F.col(text).alias("text"), label_language(F.col(label)).alias("lang")).where(
        F.col("lang").isin(*LANGUAGES) & (F.length("text") >= 12)
    )
    rank = F.row_number().over(W.partitionBy("lang").orderBy("h", "text"))  # limited before its shuffle
    got = usable.withColumn("n", rank).where(F.col("n") <= SAMPLE).orderBy("lang", "n").select("text", "lang").collect()
    return train_on([(r.text, r.lang) for r in got])


def train_on(labelled: list[tuple[str, str]]) -> Model:
    pairs = [(normal(t), lang) for t, lang in labelled]
    # Short texts are as common as whole questions: parts of two to four words are learned too.
    for t, lang in list(pairs):
        ws = t.split()
        for k, n in enumerate((2, 3, 4)):
            if len(ws) > n + 1:
                a = (len(ws) * 7 + k * 5) % (len(ws) - n)
                pairs.append((" " + " ".join(ws[a : a + n]) + " ", lang))
    pairs = [p for p in pairs if p[0]]
    if not pairs:
        raise ValueError("no labelled rows to fit the languages on")
    return fit([p[0] for p in pairs], [p[1] for p in pairs])


_OUT = "row_id bigint, part_no int, lang string, confidence double, word_from int, word_to int"


def identify(rows: DataFrame, model: Model, key: str, text: str) -> DataFrame:
    """(row_id, part_no, lang, confidence, word_from, word_to): one row for each part of one language.

    Words are counted from 0 among those with letters. Texts that are null, blank, without letters, or too
    short or undecided for their language to be told give no rows. Foreign parts of fewer than MIN_WORDS words, or
    whose language leads the next by less than 0.4, make no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            ids = batch.column(0).to_pylist()
            for i, parts in zip(ids, segments(model, batch.column(1).to_pylist())):
                made += [(i, n, *p) for n, p in enumerate(parts)]
            cols = list(zip(*made)) if made else [()] * 6
            types = [pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], [f.split()[0] for f in _OUT.split(", ")])

    return rows.select(F.col(key).cast("long"), F.col(text)).mapInArrow(run, _OUT)


def mislabelled(rows: DataFrame, model: Model, key: str, text: str, label: str) -> DataFrame:
    """(row_id, lang): each language of every text whose label is unusable or wrong, or that has several languages."""
    parts = identify(rows, model, key, text).groupBy("row_id").agg(F.collect_set("lang").alias("langs"), F.min("confidence").alias("confidence"))
    known = rows.select(F.col(key).cast("long").alias("row_id"), label_language(F.col(label)).alias("label"))
    sure = (F.col("confidence") >= MIN_CONFIDENCE) | ~F.col("label").isin(*LANGUAGES)
    case = (F.size("langs") > 1) | F.col("label").isNull() | (sure & ~F.array_contains("langs", F.coalesce("label", F.lit(""))))
    return parts.join(known, "row_id").where(case).select("row_id", F.explode("langs").alias("lang"))


def _retrievals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "retrievals").select("retrieval_id", "query", "original_language"), "retrieval_id")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _retrievals(spark, sf_dir)
    model = train(rows, "retrieval_id", "query", "original_language")
    return mislabelled(rows, model, "retrieval_id", "query", "original_language").select(F.col("row_id").alias("retrieval_id"), "lang")


def p6_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _retrievals(spark, sf_dir)
    model = train(rows, "retrieval_id", "query", "original_language")
    return identify(rows, model, "retrieval_id", "query").withColumnRenamed("row_id", "retrieval_id")
