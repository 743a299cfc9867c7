"""Repair of text from scanned pages.

Each page is one element. Headers, footers and page numbers are found by what recurs at the edges of a
file's pages, words broken over two lines by what the whole corpus spells, and misread words by ranking
corrections: a word's padded trigrams are joined with the trigrams of the corpus vocabulary, and
gradient-boosted trees, fitted to words corrupted by known confusions, decide whether the best
candidate is what was printed. A logistic classifier of pairs of adjacent lines, fitted to a bounded
sample of the pages themselves, tells a line that the text runs through from one that stands apart.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from corpusloom.session import cut, spread, table

#: A header or footer recurs on at least so many pages.
RECURS = 3
#: Line pairs and vocabulary words that the two classifiers are fitted to at most.
PAIR_SAMPLE, WORD_SAMPLE = 6000, 1500
#: A correction is at least so many times as frequent as the word it replaces.
RATIO = 6
#: Letters by which a word and its correction differ at most: a confusion is worth two.
MAX_EDITS = 3
#: Tables of files and of words are broadcast up to so many rows, beyond that they are shuffled.
BROADCAST_ROWS = 100_000
#: Elements that a word must appear in to be a correction.
COMMON_COUNT = 3
#: Lines looked at from either edge at a time; pages on which all of them are furniture are looked at again without them.
EDGE_LINES = 3

SCAN_SOURCES = ("easyocr", "tesseract")

# Fixed values: (as recognised, as printed).
CONFUSIONS = (
    ("0", "o"), ("1", "l"), ("1", "i"), ("5", "s"), ("6", "ó"), ("6", "é"), ("6", "o"), ("6", "b"), ("8", "b"), ("9", "g"), ("2", "z"), ("c", "e"),
    ("e", "c"), ("l", "i"), ("i", "l"), ("l", "í"), ("l", "t"), ("í", "l"), ("h", "b"), ("b", "h"), ("ii", "u"), ("u", "ii"), ("ri", "n"),
    ("n", "ri"), ("rn", "m"), ("m", "rn"), ("d", "ci"), ("ci", "d"), ("d", "cl"), ("cl", "d"), ("vv", "w"), ("w", "vv"), ("fi", "ñ"), ("11", "ll"),
    ("n", "u"), ("u", "n"), ("f", "t"), ("t", "f"), ("o", "c"), ("c", "o"), ("li", "h"), ("nn", "m"), ("y", "v"), ("v", "y"), ("q", "g"), ("g", "q"),
)
HYPHENS = "‐‑–¬\xad-"
_BREAK = re.compile(rf"(?<![\w{HYPHENS}])([^\W_]+)[{HYPHENS}][ \t]*$")
_WORD = re.compile(r"[^\W_]+")
_CODE = re.compile(r"[^\W_][._/@\\][^\W_]")
_HEAD_WORD = re.compile(r"\s*([^\W_]+)")
_GAP = re.compile(r"\S\s{2,}\S| · ")
_TERMINAL = re.compile(r"[.!?:;…。][\"'»”)\]]*\s*$")


# ---- which pages are scans -----------------------------------------------------------------------


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def scanned_pages(elements: DataFrame, extractions: DataFrame) -> DataFrame:
    """(element_id, file_path, elem_no, text) of the scanned files' pages with text.

    A file is a scan if its extractor is OCR; where none is recorded, if most of its elements come from an
    OCR source. A single page's source may be missing or wrong and decides nothing.
    """
    recorded = extractions.groupBy(F.col("file_path").alias("_f")).agg(F.max(F.when(F.col("extractor") == "ocr", 1).otherwise(0)).alias("_ocr"), F.count("extractor").alias("_known"))
    by_source = elements.groupBy(F.col("file_path").alias("_g")).agg(F.avg(F.when(F.col("source").isin(*SCAN_SOURCES), 1.0).otherwise(0.0)).alias("_share"))
    files = by_source.join(recorded, F.col("_g") == F.col("_f"), "left")
    scan = F.when(F.coalesce("_known", F.lit(0)) > 0, F.col("_ocr") == 1).otherwise(F.col("_share") > 0.5)
    files = _small(cut(files.where(scan).select("_g")))
    pages = elements.join(files, F.col("file_path") == F.col("_g"), "left_semi")
    return pages.where(F.length("text") > 0).select(F.col("element_id").cast("long").alias("element_id"), "file_path", "elem_no", "text")


# ---- edges: headers, footers, page numbers -------------------------------------------------------

_PAGE_WORD = r"(?:p[áa]g(?:ina|inas|e)?|page|seite|hoja|folio|p|s)\.?"
_NUMERAL = r"(?:[0-9lIOoSsBZi|]{1,4}|[ivxlcdmIVXLCDM]{1,7})"
_OF = r"(?:\s*(?:/|\||de|of|von|sur)\s*[0-9lIOoSB]{1,4})?"
_ALONE = re.compile(rf"^[\s\-–—\[\]()|·.~•*/]*(?:({_PAGE_WORD})\s*)?({_NUMERAL}){_OF}[\s\-–—\[\]()|·.~•*/]*$", re.I)
_BESIDE = re.compile(rf"^(.*\S)(?:\s{{2,}}|\t|\s[|·–—-]\s)[\s\-–—\[(|·]*(?:({_PAGE_WORD})\s*)?({_NUMERAL}){_OF}[\s\-–—\])|·.]*$", re.I)
_BEFORE = re.compile(rf"^[\s\-–—\[(|·]*(?:({_PAGE_WORD})\s*)?({_NUMERAL}){_OF}[\s\-–—\])|·.]*(?:\s{{2,}}|\t|\s[|·–—-]\s)(\S.*)$", re.I)
_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}


def _roman(s: str) -> int | None:
    v = [_ROMAN.get(c) for c in s]
    if not v or None in v:
        return None
    n = sum(-a if b > a else a for a, b in zip(v, [*v[1:], 0]))
    digits = [(1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")]
    out, rest = "", n
    for k, c in digits:
        while rest >= k:
            out, rest = out + c, rest - k
    return n if out == s else None


def numerals(token: str) -> list[int]:
    """What a page number may be, with digits misread as letters and the reverse, decimal or roman."""
    out = []
    t = token.translate(str.maketrans("lIi|OoSsBZ", "1111005582"))
    if t.isdigit():
        out.append(int(t))
    for r in {token.lower().replace("1", "i"), token.lower().replace("1", "i").replace("l", "i")}:
        if (n := _roman(r)) is not None:
            out.append(n)
    return sorted(set(out))


class _Folded(dict):
    """A word's identity, made when first asked for; '' for numbers and what may be one."""

    def __missing__(self, word: str) -> str:
        if len(self) > 1 << 18:
            self.clear()
        t = "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))
        if t.isdigit() or (any(c.isdigit() for c in t) and re.fullmatch(r"[0-9loisbz]{1,3}", t)) or re.fullmatch(r"[l1io0]{1,2}", t):
            t = ""
        for a, b in (("rn", "m"), ("ii", "u"), ("cl", "d"), ("ci", "d"), ("0", "o"), ("1", "l"), ("i", "l"), ("5", "s"), ("6", "o"), ("9", "g"), ("8", "b"), ("h", "b"), ("e", "c")):
            t = t.replace(a, b)
        self[word] = t
        return t


_folded = _Folded()


def fold_line(line: str) -> str:
    """A line's identity up to letter case, accents, numbers and misread letters."""
    t = line.lower()
    if not t.isascii():
        t = unicodedata.normalize("NFC", t)
    return " ".join(filter(None, map(_folded.__getitem__, _WORD.findall(t))))


def line_key(place: str, line: str) -> int | None:
    """A hash of an edge and a line's identity; None for lines of fewer than three letters."""
    t = fold_line(line)
    return int.from_bytes(xxhash.xxh3_64_digest(place + t), "big", signed=True) if sum(map(str.isalpha, t)) >= 3 else None


def pair_features(upper: str, lower: str) -> list[float]:
    """Of two adjacent lines: whether the text seems to run from the upper to the lower one."""
    u, v = upper.strip(), lower.strip()
    first = next((c for c in v if c.isalpha()), "")
    return [
        1.0 if _TERMINAL.search(u) else 0.0,
        1.0 if first.islower() else 0.0,
        1.0 if u[-1:] in HYPHENS and u else 0.0,
        1.0 if _GAP.search(u if len(u) < len(v) else v) else 0.0,
        min(len(u), 90) / 90,
        min(len(v), 90) / 90,
        1.0 if u.isupper() or v.isupper() else 0.0,
        1.0 if u[-1:] == "," or v[:1] in (",", ";") else 0.0,
    ]


def edges_of(text: str) -> list[tuple]:
    """The first and last EDGE_LINES lines of a page: place, identity, page numbers, and features with the inner neighbour."""
    lines = [x for x in text.split("\n") if x.strip()]
    n = len(lines)
    out = []
    for place, i in [("T", i) for i in range(min(EDGE_LINES, n))] + [("B", i) for i in range(n - 1, max(n - 1 - EDGE_LINES, EDGE_LINES - 1), -1)]:
        line = lines[i].strip()
        inner = (line, lines[i + 1]) if place == "T" and i + 1 < n else (lines[i - 1], line) if place == "B" and i > 0 else ("x.", line)
        number, head = "", line
        if len(line) < 3 or line[:6].strip("-–—[]()|·.~•*/ \t")[:1] in _NUMBER_STARTS or _NUMBER_ENDS.search(line):
            alone = _ALONE.match(line)
            if alone and numerals(alone.group(2)):
                number, head = alone.group(2), ""
            elif (m := _BESIDE.match(line)) and numerals(m.group(3)):
                head, number = m.group(1), m.group(3)
            elif (m := _BEFORE.match(line)) and numerals(m.group(2)):
                number, head = m.group(2), m.group(3)
        key = line_key(place, head) if head else None
        found = numerals(number) if number else []
        if key is not None or found:
            out.append((place, key, found, pair_features(*inner)))
    return out


#: What a line with a page number can begin with, and how it can end; others are not matched against the patterns.
_NUMBER_STARTS = frozenset("0123456789lIOoSsBZi|ivxlcdmIVXLCDMpPsShHfF")
_NUMBER_ENDS = re.compile(r"[0-9lIOoSsBZi|ivxlcdmIVXLCDM][\s\-–—\])|·.~•*/]*$")
_EDGE = "element_id bigint, file_path string, elem_no int, place string, key bigint, numbers array<int>, features array<double>, inner boolean"


def _edges(pages: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.bool_()]
        names = ["element_id", "file_path", "elem_no", "place", "key", "numbers", "features", "inner"]
        for batch in batches:
            made = []
            for i, f, n, t in zip(*(c.to_pylist() for c in batch.columns)):
                made += [(i, f, n, *e, False) for e in edges_of(t)]
                lines = [x for x in t.split("\n") if x.strip()]
                if len(lines) >= 7:  # one pair from the middle, for the classifier
                    k = len(lines) // 2
                    made.append((i, f, n, "M", None, [], pair_features(lines[k - 1], lines[k]), True))
            cols = list(zip(*made)) if made else [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    return pages.select("element_id", "file_path", "elem_no", "text").mapInArrow(run, _EDGE)


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Weights of a logistic regression with a constant, by Newton's method with a small ridge."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-1 * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - 1e-1 * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


# Lines that run on and lines that stand apart, always among what the classifier is fitted to.
RUN_ON = (("regula la presión del", "circuito cerrado"), ("the pressure of the", "circuit stays"), ("wird der Druck des", "Kreises"), ("la diso-", "lución salina"), ("del motor,", "según el manual"), ("la mémoire de", "Paris reste"))
APART = (("MANUAL DE TALLER", "El motor gira."), ("Tema 3 · Redes", "Cada equipo tiene"), ("Resumen del curso", "La válvula regula"), ("gira el motor.", "Apuntes de Física"), ("Kursheft 2   12", "Der Druck sinkt"), ("se cierra.", "IES Norte"))


def furniture(edges: DataFrame) -> DataFrame:
    """(file_path, keys, offset, numbered): each file's header and footer identities and what its page numbers exceed page order by.

    A line is furniture if its identity stands at the same edge of at least RECURS pages and the text does
    not run through it on most of them. Page numbers are those whose distance from the page's order is the
    file's most frequent one, on at least RECURS pages.
    """
    named = edges.where(F.col("key").isNotNull())
    counted = named.groupBy("file_path", "place", "key").agg(F.countDistinct("elem_no").alias("pages"), *[F.avg(F.get("features", F.lit(i))).alias(f"f{i}") for i in range(8)]).where(F.col("pages") >= RECURS)
    counted = cut(counted)
    # Weak labels: pairs amid a page run on; those at the edge where a line recurs often do not.
    inside = edges.where("inner").select(F.xxhash64("element_id").alias("h"), "features").orderBy("h").limit(PAIR_SAMPLE // 2).collect()
    apart = counted.where((F.col("pages") >= 2 * RECURS) & (F.col("f1") < 0.5)).orderBy(F.desc("pages"), "file_path", "key").limit(PAIR_SAMPLE // 2).collect()
    on = [pair_features(*p) for p in RUN_ON] + [r.features for r in inside]
    off = [pair_features(*p) for p in APART] + [[r[f"f{i}"] for i in range(8)] for r in apart]
    w = fit_logistic(np.array(on + off), np.array([1.0] * len(on) + [0.0] * len(off)))
    score = F.lit(float(w[8]))
    for i in range(8):
        score = score + F.col(f"f{i}") * F.lit(float(w[i]))
    # A line that mostly ends as a sentence does is text, however often it recurs.
    ends = F.when(F.col("place") == "B", F.lit(0.0)).otherwise(F.col("f0"))
    keys = counted.where((score < 0) & (ends < 0.5)).groupBy("file_path").agg(F.collect_set("key").alias("keys"))
    numbers = edges.where(~F.col("inner") & (F.size("numbers") > 0)).select("file_path", "elem_no", F.explode("numbers").alias("number"))
    offsets = numbers.groupBy("file_path", (F.col("number") - F.col("elem_no")).alias("offset")).agg(F.countDistinct("elem_no").alias("n")).where(F.col("n") >= RECURS)
    best = offsets.groupBy("file_path").agg(F.max_by("offset", F.struct("n", -F.col("offset"))).alias("offset"))
    return keys.join(best, "file_path", "full")


def split_page(text: str, elem_no: int | None, keys: set[int], offset: int | None) -> tuple[list[str], bool, bool, bool]:
    """(body lines, had furniture, had a page number, more may follow): peels furniture and numbers off both edges."""
    lines = text.split("\n")
    drop, head, number, more = set(), False, False, False
    filled = [i for i, x in enumerate(lines) if x.strip()]
    for place, order in (("T", filled), ("B", filled[::-1])):
        for depth, i in enumerate(order[:EDGE_LINES]):
            if i in drop:
                break
            line = lines[i].strip()
            found_head = found_number = False
            # A number stands alone, beside a known header, or is read as none.
            m = _ALONE.match(line)
            if m and _is_page(m.group(2), elem_no, offset, bool(m.group(1)) or line[0] in "-–—[("):
                found_number = True
            elif keys:
                for pattern, h, k, w in ((_BESIDE, 1, 3, 2), (_BEFORE, 3, 2, 1)):
                    b = pattern.match(line)
                    if b and line_key(place, b.group(h)) in keys:
                        found_head = True
                        found_number = _is_page(b.group(k), elem_no, offset, bool(b.group(w)) or bool(re.search(r"[\[(—–]\s*\w+\s*[\])—–]?\s*$", line)))
                        break
                if not found_head and line_key(place, line) in keys:
                    found_head = True
            if not (found_head or found_number):
                break
            head, number = head or found_head, number or found_number
            drop.add(i)
            more = more or depth + 1 == EDGE_LINES
    return [x for i, x in enumerate(lines) if i not in drop], head, number, more and len(drop) < len(filled)


def _is_page(token: str, elem_no: int | None, offset: int | None, marked: bool) -> bool:
    found = numerals(token)
    if not found or offset is None or elem_no is None:
        return False
    return any(n - elem_no == offset for n in found) or marked and any(c.isdigit() for c in token) and len(token) > 1 and any(abs(n - elem_no - offset) <= 30 and len(str(n)) == len(str(elem_no + offset)) and sum(a != b for a, b in zip(str(n), str(elem_no + offset))) <= 1 for n in found)


# ---- words ---------------------------------------------------------------------------------------


def join_lines(body: list[str]) -> tuple[list[tuple[str, str]], list[str]]:
    """(broken words as their two parts, words of the running text with broken words joined)."""
    broken, words, carry = [], [], ""
    for i, line in enumerate(body):
        rest = line
        if carry:
            m = _HEAD_WORD.match(line)
            if m and _continues(m.group(1)):
                broken.append((carry, m.group(1)))
                words.append(carry + m.group(1))
                rest = line[m.end() :]
            else:
                words.append(carry)
            carry = ""
        m = _BREAK.search(rest)
        if m and i + 1 < len(body):
            carry = m.group(1)
            rest = rest[: m.start()]
        words += [x.group() for x in _WORD.finditer(rest) if not _coded(rest, x)] if _CODE.search(rest) else _WORD.findall(rest)
    if carry:
        words.append(carry)
    return broken, words


def _continues(part: str) -> bool:
    """Whether the second part of a broken word may start so: small, or misread as a digit."""
    return part[0].islower() or (part[0] in "01569" and any(c.isalpha() for c in part))


def _coded(line: str, m: re.Match) -> bool:
    """Part of a file name, a version, a call or the like."""
    a, b = m.start(), m.end()
    return (a > 0 and line[a - 1] in "._/@\\" and a > 1 and line[a - 2].isalnum()) or (b + 1 < len(line) and line[b] in "._/@\\" and line[b + 1].isalnum())


def is_suspect(word: str) -> bool:
    """Words worth looking up: of four letters or more, not numbers or measures."""
    return len(word) >= 4 and sum(map(str.isalpha, word)) >= 3


class _Suspects(dict):
    """A word in lower case if it is worth looking up, else ''."""

    def __missing__(self, word: str) -> str:
        if len(self) > 1 << 18:
            self.clear()
        v = self[word] = word.lower() if is_suspect(word) else ""
        return v


_suspects = _Suspects()


@lru_cache(maxsize=1 << 16)
def explain(seen: str, printed: str) -> tuple[int, int]:
    """(confusions, other edits) that turn ``printed`` into ``seen``, fewest others first."""
    i = 0
    while i < min(len(seen), len(printed)) and seen[i] == printed[i]:
        i += 1
    j = 0
    while j < min(len(seen), len(printed)) - i and seen[-1 - j] == printed[-1 - j]:
        j += 1
    i, j = max(0, i - 1), max(0, j - 1)  # confusions of two letters may reach into what is equal
    a, b = seen[i : len(seen) - j], printed[i : len(printed) - j]
    best = {(0, 0): (0, 0)}
    for x in range(len(a) + 1):
        for y in range(len(b) + 1):
            at = best.get((x, y))
            if at is None:
                continue
            moves = []
            if x < len(a) and y < len(b):
                moves.append((1, 1, (0, 0) if a[x] == b[y] else (1, 0)))
            if x < len(a):
                moves.append((1, 0, (1, 0)))
            if y < len(b):
                moves.append((0, 1, (1, 0)))
            moves += [(len(s), len(p), (0, 1)) for s, p in CONFUSIONS if a.startswith(s, x) and b.startswith(p, y)]
            for dx, dy, (o, c) in moves:
                new = (at[0] + o, at[1] + c)
                k = (x + dx, y + dy)
                if k not in best or new < best[k]:
                    best[k] = new
    others, confusions = best[len(a), len(b)]
    return confusions, others


def trigrams(word: str) -> list[str]:
    w = f"^{word}$"
    return sorted({w[i : i + 3] for i in range(len(w) - 2)})


def rank_features(seen: str, printed: str, n_seen: float, n_printed: float) -> list[float]:
    c, o = explain(seen, printed)
    s, p = set(trigrams(seen)), set(trigrams(printed))
    return [float(c), float(o), math.log((n_printed + 1) / (n_seen + 1)), float(len(printed)), abs(len(seen) - len(printed)), float(any(x.isdigit() for x in seen)), len(s & p) / len(s | p), float(seen[0] == printed[0])]


class Boosted:
    """Gradient-boosted trees of depth two on the logistic loss."""

    def __init__(self, rounds: int = 40, rate: float = 0.3):
        self.rounds, self.rate, self.trees, self.base = rounds, rate, [], 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        p0 = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.base = math.log(p0 / (1 - p0))
        f = np.full(len(y), self.base)
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0.03, 0.97, 24))) for j in range(x.shape[1])]

        def split(rows, g, h):
            best = (1e-9, None, None)
            G, H = g[rows].sum(), h[rows].sum()
            for j, cs in enumerate(cuts):
                col = x[rows, j]
                for c in cs:
                    left = col <= c
                    gl, hl = g[rows][left].sum(), h[rows][left].sum()
                    gain = gl * gl / (hl + 1) + (G - gl) ** 2 / (H - hl + 1) - G * G / (H + 1)
                    if gain > best[0]:
                        best = (gain, j, c)
            return best[1:]

        def leaf(rows, g, h):
            return float(g[rows].sum() / (h[rows].sum() + 1))

        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            rows = np.arange(len(y))
            j, c = split(rows, g, h)
            if j is None:
                break
            tree = [j, c]
            for side in (rows[x[:, j] <= c], rows[x[:, j] > c]):
                jj, cc = split(side, g, h) if len(side) > 20 else (None, None)
                if jj is None:
                    tree.append((0, math.inf, leaf(side, g, h), 0.0))
                else:
                    low = x[side, jj] <= cc
                    tree.append((jj, cc, leaf(side[low], g, h), leaf(side[~low], g, h)))
            self.trees.append(tree)
            f = self.score(x)
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.base)
        for j, c, low, high in self.trees:
            a = np.where(x[:, low[0]] <= low[1], low[2], low[3])
            b = np.where(x[:, high[0]] <= high[1], high[2], high[3])
            f += self.rate * np.where(x[:, j] <= c, a, b)
        return f


# Common words, always among what the ranker is fitted to, so that a small vocabulary does not leave it without examples.
SEED_WORDS = (
    "memoria", "presión", "circuito", "motor", "válvula", "temperatura", "proceso", "sistema", "energía", "corriente", "número", "lección", "pressure", "system", "current", "memory",
    "number", "process", "température", "mémoire", "pression", "réseau", "spannung", "leitung", "speicher", "druck", "übung", "pressão", "sistema", "memória", "disciplina", "fortuna",
)


def fit_ranker(words: list[tuple[str, int]]) -> Boosted:
    """Fit to vocabulary words and their corruptions: true pairs against near strangers. Deterministic."""
    rng = np.random.default_rng(7)
    words = [*words, *((w, 400) for w in SEED_WORDS if w not in dict(words))]
    words = [(w, n) for w, n in words if len(w) >= 4 and w.isalpha()]
    by: dict[str, list[int]] = {}
    for i, (w, _) in enumerate(words):
        for t in trigrams(w):
            by.setdefault(t, []).append(i)
    x, y = [], []
    for w, n in words:
        options = [(k, s, p) for s, p in CONFUSIONS for k in range(len(w)) if w.startswith(p, k)]
        bad = w
        if options:
            k, s, p = options[rng.integers(len(options))]
            bad = w[:k] + s + w[k + len(p) :]
            x.append(rank_features(bad, w, max(1.0, n * rng.uniform(0.0005, 0.02)), n))
            y.append(1.0)
        # Strangers: words near the corrupted one, and near the word itself, at any frequency.
        for base in {bad, w}:
            near: dict[int, int] = {}
            for t in trigrams(base):
                for i in by.get(t, ())[:60]:
                    near[i] = near.get(i, 0) + 1
            for i in sorted(near, key=lambda i: (-near[i], i))[:4]:
                if words[i][0] != w:
                    x.append(rank_features(base, words[i][0], float(rng.choice([1, 2, 5, 20])), words[i][1]))
                    y.append(0.0)
        # A name: a random change that no confusion explains.
        k = int(rng.integers(len(w)))
        name = w[:k] + "aeioubrtzk"[int(rng.integers(10))] + w[k + 1 :]
        if name != w and explain(name, w)[1]:
            x.append(rank_features(name, w, float(rng.choice([1, 2, 5])), n))
            y.append(0.0)
    return Boosted().fit(np.array(x), np.array(y))


def vocabulary(elements: DataFrame) -> DataFrame:
    """(word, n): in how many elements each word in lower case occurs; counted over all elements."""
    words = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))
    return elements.where(F.col("text").isNotNull()).select(F.explode(words).alias("word")).where(F.length("word") > 0).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def compounds(elements: DataFrame) -> DataFrame:
    """(compound): words written with a hyphen of their own within a line, in lower case."""
    found = F.regexp_extract_all(F.lower("text"), F.lit(r"(?<![\p{L}\p{N}-])(\p{L}+[-‐‑]\p{L}+)(?![\p{L}\p{N}-])"), 1)
    return elements.where(F.col("text").rlike(r"\p{L}[-‐‑]\p{L}")).select(F.explode(found).alias("c")).select(F.regexp_replace("c", "[‐‑]", "-").alias("compound")).distinct()


_PAGE = "element_id bigint, file_path string, elem_no int, body array<string>, furniture boolean, pageno boolean, more boolean, broken array<struct<a:string,b:string>>, words array<string>"


def read_pages(pages: DataFrame, files: DataFrame) -> DataFrame:
    """Each page without furniture, with its broken words and the words of its running text."""
    rows = pages.join(files, "file_path", "left").select("element_id", "file_path", "elem_no", "text", "keys", "offset")
    pair = pa.struct([("a", pa.string()), ("b", pa.string())])
    types = [pa.list_(pa.string()), pa.bool_(), pa.bool_(), pa.bool_(), pa.list_(pair), pa.list_(pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for n, t, keys, offset in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4, 5))):
                body, head, number, more = split_page(t, n, set(keys or ()), offset)
                broken, words = join_lines(body)
                looked = set(map(_suspects.__getitem__, words))
                looked.discard("")
                made.append((body, head, number, more, broken, sorted(looked)))
            cols = list(zip(*made)) if made else [()] * len(types)
            cols[4] = [[{"a": a, "b": b} for a, b in x] for x in cols[4]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *[pa.array(c, t) for c, t in zip(cols, types)]], ["element_id", "file_path", "elem_no", "body", "furniture", "pageno", "more", "broken", "words"])

    return rows.mapInArrow(run, _PAGE)


def read_all(pages: DataFrame) -> DataFrame:
    """``read_pages`` of pages whose edges are peeled EDGE_LINES lines at a time, until a line of the body stands at each edge."""
    read = cut(read_pages(pages, furniture(cut(_edges(pages)))))
    while read.where("more").limit(1).count():
        was = read.where("more").select(F.col("element_id").alias("_id"), F.col("furniture").alias("_f"), F.col("pageno").alias("_p"))
        rest = cut(read.where("more").select("element_id", "file_path", "elem_no", F.array_join("body", "\n").alias("text")))
        again = read_pages(rest, furniture(cut(_edges(rest)))).join(was, F.col("element_id") == F.col("_id"))
        again = again.withColumn("furniture", F.col("furniture") | F.col("_f")).withColumn("pageno", F.col("pageno") | F.col("_p")).select(*read.columns)
        read = cut(read.where("NOT more").unionByName(again))
    return read


def corrections(read: DataFrame, vocab: DataFrame) -> DataFrame:
    """(word, printed): misread words of the pages and what was printed; null where that can't be told.

    ``vocab`` is (word, n). A word is looked up if it is rare against the count of its correction, which
    need not grow with the corpus. Words with a digit among letters are misread even without one.
    """
    common = vocab.where((F.col("n") >= COMMON_COUNT) & (F.length("word") >= 4) & F.col("word").rlike(r"^\p{L}+$"))
    # The ranker is fitted to words by their share of the vocabulary's occurrences: rare ones seldom come in.
    sample = common.orderBy(F.log(F.pmod(F.xxhash64("word"), F.lit(1 << 30)) / float(1 << 30) + 1e-12) / F.col("n"), ascending=False).limit(WORD_SAMPLE).collect()
    ranker = fit_ranker(sorted((r.word, r.n) for r in sample))
    own = read.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("here"))
    suspects = own.join(vocab, "word", "left").select("word", F.greatest("here", F.coalesce("n", F.lit(0))).alias("m"))

    def gram(c: str):
        w = F.concat(F.lit("^"), F.col(c), F.lit("$"))
        return F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3)))))

    a = suspects.select("word", "m", gram("word").alias("g"))
    b = common.select(F.col("word").alias("printed"), "n", gram("word").alias("g"))
    met = a.join(b, "g").where((F.col("n") >= RATIO * F.col("m")) & (F.abs(F.length("word") - F.length("printed")) <= 2) & (F.col("word") != F.col("printed")))
    near = met.groupBy("word", "printed", "m", "n").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= F.length("printed") - 5)
    near = near.where(F.levenshtein("word", "printed", MAX_EDITS) >= 0)

    @F.pandas_udf(DoubleType())
    def score(w: pd.Series, p: pd.Series, m: pd.Series, n: pd.Series) -> pd.Series:
        if not len(w):
            return pd.Series([], dtype="float64")
        return pd.Series(ranker.score(np.array([rank_features(*r) for r in zip(w, p, m, n)])))

    ranked = near.withColumn("s", score("word", "printed", "m", "n")).groupBy("word").agg(F.max_by("printed", F.struct("s", "n", "printed")).alias("printed"), F.max("s").alias("s")).where("s > 0")
    digits = own.where(F.col("word").rlike(r"\p{L}{2}[01569]\p{L}|\p{L}[01569]\p{L}{2}|\p{L}{4}[0156]$|^[0156]\p{L}{4}")).select("word")
    both = ranked.select("word", "printed").join(digits.withColumn("_d", F.lit(True)), "word", "full")
    return both.select("word", "printed")


def own_hyphen(read: DataFrame, vocab: DataFrame, written: DataFrame) -> DataFrame:
    """(element_id, a, b, own): broken words; ``own`` if the word is spelled with a hyphen of its own."""
    parts = read.select("element_id", F.explode("broken").alias("w")).select("element_id", F.lower("w.a").alias("a"), F.lower("w.b").alias("b"))
    forms = parts.select("a", "b").distinct()
    whole = vocab.select(F.col("word").alias("_w"), F.col("n").alias("_n"))
    seen = forms.join(whole, F.concat("a", "b") == F.col("_w"), "left").join(written, F.concat_ws("-", "a", "b") == F.col("compound"), "left")
    own = F.col("compound").isNotNull() & (F.coalesce("_n", F.lit(0)) <= 1)
    return parts.join(seen.select("a", "b", own.alias("own")), ["a", "b"]).select("element_id", "a", "b", "own")


def analyse(elements: DataFrame, extractions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pages as read, corrections, broken words)."""
    read = read_all(cut(spread(scanned_pages(elements, extractions), "element_id")))
    vocab = cut(vocabulary(elements))
    return read, cut(corrections(read, vocab)), cut(own_hyphen(read, vocab, compounds(elements)))


def noise(elements: DataFrame, extractions: DataFrame) -> DataFrame:
    """(element_id, noise): the kinds of noise on each scanned page.

    Pages that are null, empty or blank have none. Pages delivered twice come out under each id but count
    once towards recurrence. Empty inputs give no rows.
    """
    read, fixes, broken = analyse(elements, extractions)

    def kind(df: DataFrame, name: str) -> DataFrame:
        return df.select("element_id", F.lit(name).alias("noise"))

    out = kind(broken.where("NOT own"), "hyphen").unionByName(kind(read.where("furniture"), "furniture")).unionByName(kind(read.where("pageno"), "pageno"))
    words = read.select("element_id", F.explode("words").alias("word")).join(_small(fixes.select("word")), "word", "left_semi")
    return out.unionByName(kind(words, "misread")).distinct()


def paragraphs_of(body: list[str], fixes: dict[str, str], own: set[tuple[str, str]]) -> str:
    """Running text of a page's body: broken words joined, misread words replaced, lines joined to paragraphs."""

    def fix(m: re.Match) -> str:
        w = m.group()
        p = fixes.get(w.lower())
        if p is None:
            return w
        return p.upper() if w.isupper() and len(w) > 1 else p[:1].upper() + p[1:] if w[:1].isupper() else p

    out = ""
    for k, line in enumerate(body):
        line = line.strip()
        if not line:
            out = out.rstrip() + "\n\n" if out else out
            continue
        m = _BREAK.search(out)
        head = _HEAD_WORD.match(line)
        if m and head and _continues(head.group(1)):
            keep = (m.group(1).lower(), head.group(1).lower()) in own
            out = out[: m.end(1)] + ("-" if keep else "") + line
        else:
            out += (" " if out and not out.endswith("\n") else "") + line
    return _WORD.sub(fix, out).strip()


def repaired(elements: DataFrame, extractions: DataFrame) -> DataFrame:
    """(element_id, file_path, elem_no, text): each scanned page as continuous paragraphs without layout and recognition noise."""
    read, fixes, broken = analyse(elements, extractions)
    of_page = read.select("element_id", F.explode("words").alias("word")).join(fixes.where(F.col("printed").isNotNull()), "word").groupBy("element_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "printed"))).alias("fixes"))
    kept = broken.where("own").groupBy("element_id").agg(F.collect_set(F.struct("a", "b")).alias("own"))
    rows = read.select("element_id", "file_path", "elem_no", "body").join(of_page, "element_id", "left").join(kept, "element_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [paragraphs_of(b, dict(f or ()), {(o["a"], o["b"]) for o in own or ()}) for b, f, own in zip(*(batch.column(k).to_pylist() for k in (3, 4, 5)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(texts, pa.string())], ["element_id", "file_path", "elem_no", "text"])

    return rows.select("element_id", "file_path", "elem_no", "body", "fixes", "own").mapInArrow(run, "element_id bigint, file_path string, elem_no int, text string")


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf_dir, "elements").select("element_id", "file_path", "elem_no", "text", "source"), table(spark, sf_dir, "extractions")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return noise(*_inputs(spark, sf_dir))


def p4_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(*_inputs(spark, sf_dir))
