"""Finding and undoing garbled text from wrong character encodings.

Damage is undone by best-first search over texts: a step re-encodes in the encoding a text was wrongly
read in and decodes in the one it was written in, or unescapes glyph marks. States are kept by hash,
the queue is ordered by a plausibility cost plus a small cost for each step, and the cheapest text
reached is the answer. The cost has two parts: places that no right text has, and a character model fitted to all
texts that look right, which charges every other character than ASCII in surroundings that next to none of
them shows. A text that the model finds less plausible than the damaged one is refused. What a
stand-in character has replaced can be found but not restored.
"""

from __future__ import annotations

import heapq
import html
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import cut, spread, table

STEP = 0.4
#: What a character costs in surroundings that the model has not seen.
UNSEEN = 0.1
#: The share of the texts that look right which must show surroundings: what fewer show may be damage that nothing tells.
SHARE = 1e-4
#: Characters of texts that are counted in one go.
BLOCK = 1 << 20

# ---- plausibility: what each implausible match costs ---------------------------------------------

_LOW = r"[a-zß-öø-ÿœ]"
_COSTS = [
    (regex.compile(r"[\x80-\x84\x86-\x9f]"), 4.0),  # control characters
    (regex.compile(r"GLYPH<[^<>\n]{1,60}>"), 6.0),
    # The first bytes of a multi-byte character, read one by one, with what can follow them.
    (regex.compile(r"[ÂÃÄÅÐÑâãäåæçèéðÎÏ](?![\xad¬–‐]\s*\n)[\x80-\xbf€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]"), 3.0),
    (regex.compile(r"(?<![\p{Lu}])Ã(?=[\s\xa0]|$)"), 3.0),
    (regex.compile(rf"(?<=\p{{Latin}})[√∫∂∆][^\s\p{{N}}]|¬[ª´ø¥°±º¿«»µ≤≥∞](?=\p{{Latin}}|\s|$|√)|√[^\s\d]"), 3.0),
    # One script within another's word.
    (regex.compile(r"(?<=\p{Latin})[\p{Greek}\p{Cyrillic}]|[\p{Greek}\p{Cyrillic}](?=\p{Latin})"), 3.0),
    (regex.compile(r"[─-▟⌐⌠⌡](?![─-▟])"), 3.0),
    (regex.compile(rf"(?<={_LOW})[À-ÖØ-ÞŒŠŽŸ]"), 3.0),  # a capital after a small letter
    (regex.compile(rf"(?<=\p{{Latin}})[÷×≤≥¾¼½¯¸¨´ˆ˜≡∙·¹²³¤¦§¶¢£¥ƒ](?=\p{{Latin}})"), 3.0),
    (regex.compile(rf"(?<=\p{{Ll}})[¾≤≥÷¸¯](?=[\s,.;:!?»)]|$)|½(?=\p{{L}})"), 2.5),
    (regex.compile(r"(?<=\p{Ll})[®©™‡†‰§Ÿ]|(?<=\p{L})[ªº](?=\p{Ll})|[Ā-ŐŔ-şŢ-ŷŹ-ſƀ-ƑƓ-ɏ](?<![šŠžŽ])"), 2.5),
    (regex.compile(r"(?<=(?<!\p{L})\p{Lu})[À-ÖØ-Þ](?=[a-zß-öø-ÿ])"), 2.5),  # a second capital before small letters
    (regex.compile(r"[þÞðÝ](?=[a-zà-ÿ])|(?<=[a-zà-ÿ])[þÞðÝ]"), 2.0),
    (regex.compile(r"[ÆØ](?=[a-zß-öø-ÿ])|(?<=[A-Za-zÀ-ÿ])[ÆØ]|æ(?=[a-zà-ÿ])|(?<=[a-zà-ÿ])æ"), 2.0),
    (regex.compile(r"(?<![fcFC])œ(?![uide])|Œ(?=[a-z])(?!Œ[uid])|(?<=[A-Z])Œ(?![UID])"), 2.0),
    (regex.compile(r"(?<![aeiouäöüyAEIOU])ß(?=\p{L})|(?<=[bcdfghjklmnpqrstvwxz])ß"), 2.0),
    (regex.compile("�"), 2.0),
    (regex.compile(r"&(?:#\d{2,6}|#x[0-9a-fA-F]{2,5}|[A-Za-z]{1,3}(?:acute|grave|uml|circ|tilde|cedil|ring|slash)|laquo|raquo|iquest|iexcl|szlig|nbsp);"), 2.0),
]

#: What no step restores: the replacement character, a question mark within a word, a glyph of a font without a table.
_STAND_INS = regex.compile(r"�|GLYPH<c=\d+,font=[^>]*>|(?<![\w./=&?-])\p{L}+\?\p{Ll}+(?![\w=/])|(?<=[\s(«¿¡])\?(?=\p{Ll}\p{Ll})|\(cid:\d+\)|[-]")

#: Texts without any of this hold nothing that costs: only ASCII, letters and marks of plain prose, none of them after what may be a first byte, and no mark of a lost character.
SUSPICIOUS = (
    "[^\\x00-\\x7Fáéíóúñüàèìòùâêôçãõäöëïîû¿¡«»“”‘’–—…°\\u3000-\\u30FF\\u3400-\\u9FFF]|[âãäåæçèéð][\\x80-\\xBF€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]"
    "|GLYPH<|\\(cid:|&[#A-Za-z]|\\?(?<=[\\p{L}\\s(«¿¡]\\?)\\p{Ll}|[\\x80-\\x9F]"
)


def _range(*spans: str) -> frozenset[str]:
    return frozenset(chr(c) for s in spans for c in range(ord(s[0]), ord(s[-1]) + 1))


_CAPITALS = _range("ÀÖ", "ØÞ") | set("ŒŠŽŸ")
#: By pattern of _COSTS, characters of which every match holds at least one; None where that is no short list.
_TRIGGERS = (
    _range("\x80\x84", "\x86\x9f"), frozenset("<"), frozenset("ÂÃÄÅÐÑâãäåæçèéðÎÏ"), frozenset("Ã"), frozenset("√∫∂∆¬"), None, _range("─▟") | set("⌐⌠⌡"), _CAPITALS,
    frozenset("÷×≤≥¾¼½¯¸¨´ˆ˜≡∙·¹²³¤¦§¶¢£¥ƒ"), frozenset("¾≤≥÷¸¯½"), _range("Āɏ") | set("®©™‡†‰§Ÿªº"), _CAPITALS, frozenset("þÞðÝ"), frozenset("ÆØæ"), frozenset("œŒ"), frozenset("ß"), frozenset("\ufffd"), frozenset("&"),
)
_FIXED = regex.compile(r"\ufffd|GLYPH<c=[^<>\n]{1,58}>")


def plausibility_cost(text: str) -> float:
    """The sum of the costs of all implausible places; 0 for text that looks right."""
    held = set(text)
    return sum(c * len(p.findall(text)) for (p, c), t in zip(_COSTS, _TRIGGERS) if t is None and max(held, default="") > "\u036f" or t and not t.isdisjoint(held))


def fixed_cost(text: str) -> float:
    """The part of the cost that no step takes away."""
    return sum(2.0 if m == "\ufffd" else 6.0 for m in _FIXED.findall(text))


def _places(low: str) -> tuple[np.ndarray, np.ndarray]:
    """Where characters other than ASCII stand, and each with its neighbours as one number; digits are alike. No such character is the first or last."""
    c = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.flatnonzero(c > 0x7F)
    c = np.where((c > 0x30) & (c <= 0x39), 0x30, c).astype(np.int64)
    return at, c[at - 1] << 42 | c[at] << 21 | c[at + 1]


def surroundings(text: str) -> np.ndarray:
    """Each character other than ASCII with its neighbours, in lower case, as a number."""
    return _NOTHING if text.isascii() else _places(f" {text.lower()} ")[1]


_NOTHING = np.zeros(0, np.int64)


def count_surroundings(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(surroundings, n): the distinct ones of the texts, sorted, and how many texts show each."""
    low = [t.lower() for t in texts]
    at, s = _places(f" {' '.join(low)} ")
    doc = np.searchsorted(np.cumsum([len(t) + 1 for t in low]), at)
    order = np.lexsort((doc, s))
    s, doc = s[order], doc[order]
    return np.unique(s[np.concatenate([[True], (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])])[: len(s)]], return_counts=True)


def fit_characters(texts: list[str]) -> np.ndarray:
    """The surroundings that enough of these undamaged texts show, sorted."""
    s, n = count_surroundings(texts)
    return s[n >= SHARE * len(texts)]


def unseen(text: str, model: np.ndarray) -> int:
    """How many characters stand in surroundings that the model has not seen; a mark for a character counts as one."""
    if not len(model):
        return 0
    s = surroundings(text)
    new = np.count_nonzero(model[np.minimum(np.searchsorted(model, s), len(model) - 1)] != s) if len(s) else 0
    return int(new) + len(_MARK.findall(text))


_MARK = regex.compile(r"GLYPH<[^<>\n]{1,60}>|&[#0-9A-Za-z]{2,8};")


# ---- steps ---------------------------------------------------------------------------------------


def _sloppy(name: str) -> dict[str, int]:
    """Character -> byte; bytes that the encoding leaves undefined stand for themselves, as readers do."""
    out = {}
    for b in range(128, 256):
        try:
            out[bytes([b]).decode(name)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    return out


_BYTES = {name: _sloppy(name) for name in ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "cp1250", "iso8859_2", "koi8_r")}
for _c in map(chr, range(0x80, 0xA0)):  # the two are mixed in one text
    _BYTES["cp1252"].setdefault(_c, ord(_c))


def _multibyte(name: str) -> regex.Pattern:
    by: dict[int, str] = {}
    for c, b in _BYTES[name].items():
        by[b] = by.get(b, "") + c

    def cls(a, z):
        return "[" + regex.escape("".join(by.get(b, "") for b in range(a, z + 1)), special_only=False) + "]"

    tail = cls(0x80, 0xBF)
    return regex.compile(f"{cls(0xC2, 0xDF)}{tail}|{cls(0xE0, 0xEF)}{tail}{tail}|{cls(0xF0, 0xF4)}{tail}{tail}{tail}")


_SEQUENCES = {name: _multibyte(name) for name in ("cp1252", "mac_roman", "cp437", "cp850", "cp1250", "iso8859_2", "cp1251", "koi8_r")}
#: What a first byte of a multi-byte character is read as; texts without any of it have no such sequence.
_LEADS = {name: frozenset(c for c, b in _BYTES[name].items() if b >= 0xC2) for name in _SEQUENCES}


def _utf8(name: str):
    table_, pattern = _BYTES[name], _SEQUENCES[name]

    def back(m: regex.Match) -> str:
        try:
            return bytes(table_[c] for c in m.group()).decode("utf-8")
        except UnicodeDecodeError:
            return m.group()

    def step(text: str) -> str:
        if _LEADS[name].isdisjoint(text):
            return text
        out = pattern.sub(back, text)
        if name == "cp1252":  # a no-break space that became a space
            out = regex.sub(r"(?<![\p{Lu}])Ã[ \xa0](?=[\s\p{L}«])", "à", out) if "Ã" in out else out
        return out

    return step


def _single(name: str):
    table_ = {c: bytes([b]).decode("cp1252", "ignore") or c for c, b in _BYTES[name].items() if b >= 0xA0 or name in ("cp1251", "cp1250", "koi8_r")}
    table_ = {ord(c): d for c, d in table_.items() if c != d}
    return lambda text: text.translate(table_)


# Accented letters as an Adobe font's own encoding shows them, and the ligature as French writes it.
STANDARD_FONT = {"Æ": "á", "Ø": "é", "œ": "ú", "æ": "ñ", "Œ": "Í"}
_IN_WORD = regex.compile(r"(?:(?<=[A-Za-zÀ-ÿ])|(?=.[A-Za-zÀ-ÿ]))(?![œŒ][uiUI]\p{L})[ÆØœæŒ]", regex.DOTALL)
# A numbered glyph.
_GLYPH = regex.compile(r"GLYPH<(\d{1,7})>")


def _font(text: str) -> str:
    return _IN_WORD.sub(lambda m: STANDARD_FONT[m.group()], text)


def glyph_char(code: int) -> str | None:
    """The character of a numbered glyph: controls as nothing, 128 to 159 by code page 1252, None if there is none."""
    if code > 0x10FFFF or unicodedata.category(chr(code)) == "Cs":
        return None
    c = bytes([code]).decode("cp1252", "ignore") if 0x80 <= code < 0xA0 else chr(code)
    return "" if unicodedata.category(c or "\0") == "Cc" else c


def _glyphs(text: str) -> str:
    known = {int(n): glyph_char(int(n)) for n in set(_GLYPH.findall(text))}
    return _GLYPH.sub(lambda m: m.group() if (c := known[int(m.group(1))]) is None else c, text)


STEPS = {
    "utf8 read as cp1252": _utf8("cp1252"),
    "utf8 read as mac roman": _utf8("mac_roman"),
    "utf8 read as cp437": _utf8("cp437"),
    "utf8 read as cp850": _utf8("cp850"),
    "utf8 read as cp1250": _utf8("cp1250"),
    "utf8 read as iso8859_2": _utf8("iso8859_2"),
    "utf8 read as cp1251": _utf8("cp1251"),
    "utf8 read as koi8_r": _utf8("koi8_r"),
    "cp1252 read as cp437": _single("cp437"),
    "cp1252 read as cp850": _single("cp850"),
    "cp1252 read as cp1251": _single("cp1251"),
    "cp1252 read as mac roman": _single("mac_roman"),
    "cp1252 read as cp1250": _single("cp1250"),
    "cp1252 read as iso8859_2": _single("iso8859_2"),
    "cp1252 read as koi8_r": _single("koi8_r"),
    "glyph numbers": _glyphs,
    "standard font encoding": _font,
    "entities": html.unescape,
}

#: What a reader does to a file's bytes happens once; only the decoding of UTF-8 repeats and the rest combines with it.
FIRST_ONLY = frozenset(n for n in STEPS if " read as " in n and n != "utf8 read as cp1252")


def restore(text: str | None, model: np.ndarray = _NOTHING) -> tuple[str | None, list[str], int, bool]:
    """The cheapest text reachable, the steps to it, the number of stand-ins left in it, and whether the text is damaged.

    Texts that are null, empty or plausible come back unchanged with no step. So do damaged ones of which no
    step makes a text that the model finds as plausible. The search ends by itself: every step that repeats shortens the text.
    """
    if not text:
        return text, [], 0, False
    start = plausibility_cost(text)
    best, found, damaged_ = (start, text, ()), (start, text, ()), False
    if start > 0:
        strange, fixed = unseen(text, model), fixed_cost(text)
        worth = start + UNSEEN * strange  # of the best text so far
        queue = [(worth, 0, start, strange, text, ())]
        seen, order = {hash(text)}, 0
        while queue:
            _, _, cost, odd, at, path = heapq.heappop(queue)
            total = cost + STEP * len(path)
            if total < found[0]:
                found = (total, at, path)
            if total < start and odd <= strange and total + UNSEEN * odd < worth:
                best, worth = (total, at, path), total + UNSEEN * odd
            # Nothing reached from here can cost less than its steps and what no step takes away.
            if fixed + STEP * (len(path) + 1) >= min(worth, start):
                continue
            for name, step in STEPS.items():
                if path and name in FIRST_ONLY:
                    continue
                new = step(at)
                if new != at and (key := hash(new)) not in seen:
                    seen.add(key)
                    order += 1
                    c, n = plausibility_cost(new), unseen(new, model)
                    heapq.heappush(queue, (c + UNSEEN * n + STEP * (len(path) + 1), order, c, n, new, (*path, name)))
                    if c <= fixed and not n:  # no other step can do better
                        break
        damaged_ = bool(found[2])
    left = len(_STAND_INS.findall(best[1]))
    return best[1], list(best[2]), left, damaged_ or left > 0


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(s, n) of those of the texts (text, odd) that look right, block by block; -1 stands for the texts themselves."""

    def counted(block: list[str]) -> pa.RecordBatch:
        s, n = count_surroundings(block)
        return pa.RecordBatch.from_arrays([pa.array(np.append(s, -1)), pa.array(np.append(n, len(block)))], ["s", "n"])

    block, size = [], 0
    for batch in batches:
        for t, odd in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if odd and plausibility_cost(t) > 0:
                continue
            block.append(t)
            size += len(t)
            if size > BLOCK:
                yield counted(block)
                block, size = [], 0
    yield counted(block)


def character_model(texts: DataFrame) -> np.ndarray:
    """``fit_characters`` of all texts that look right and aren't ASCII alone.

    Counted where the texts are. No more comes to the driver than 1 / SHARE times the surroundings of an average text.
    """
    shown = texts.where(F.col("text").rlike("[^\\x00-\\x7f]")).select("text", F.col("text").rlike(SUSPICIOUS).alias("odd"))
    counts = cut(shown.mapInArrow(_count, "s bigint, n bigint").groupBy("s").agg(F.sum("n").alias("n")))
    least = F.broadcast(counts.where("s = -1").select((F.col("n") * SHARE).alias("least")))
    return np.array(sorted(r.s for r in counts.where("s >= 0").join(least, F.col("n") >= F.col("least")).select("s").collect()), np.int64)


_OUT = "element_id bigint, file_path string, restored string, steps array<string>, stand_ins int"


def damaged(elements: DataFrame, extractions: DataFrame) -> DataFrame:
    """Damaged elements: id, file, extractor, restored text, the steps that restored it, stand-ins left.

    An element is damaged if a step makes its text more plausible or if it holds a stand-in. Null, empty
    and blank texts are not. Where every reachable text is implausible, the text stands as it was, without steps. The
    extractor is the least non-null one recorded for the file, null if none; repeated extractions do not
    repeat rows. Elements delivered twice come out twice, under each id.
    """
    texts = elements.select(F.col("element_id").cast("long").alias("element_id"), "file_path", "text").where(F.length("text") > 0)
    model = character_model(texts)
    suspects = texts.where(F.col("text").rlike(SUSPICIOUS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, texts, steps, left = [], [], [], []
            for i, t in enumerate(batch.column(2).to_pylist()):
                new, path, marks, bad = restore(t, model)
                if bad:
                    keep.append(i)
                    texts.append(new)
                    steps.append(path)
                    left.append(marks)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(texts, pa.string()), pa.array(steps, pa.list_(pa.string())), pa.array(left, pa.int32())],
                ["element_id", "file_path", "restored", "steps", "stand_ins"],
            )

    found = suspects.mapInArrow(run, _OUT)
    extractor = extractions.groupBy(F.col("file_path").alias("_file")).agg(F.min("extractor").alias("extractor"))
    return found.join(extractor, F.col("file_path") == F.col("_file"), "left").select("element_id", "file_path", "extractor", "restored", "steps", "stand_ins")


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    elements = spread(table(spark, sf_dir, "elements").select("element_id", "file_path", "text"), "element_id")
    return elements, table(spark, sf_dir, "extractions")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return damaged(*_tables(spark, sf_dir)).select("element_id")


def p5_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return damaged(*_tables(spark, sf_dir))
