"""Sentence boundaries across languages and scripts.

Text is cut at blank lines and at list items; what is left is paragraphs. A paragraph is a lattice: its
nodes are the places where a sentence may end, an arc between two nodes is a sentence, and the cheapest path
from the start to the end gives the sentences. Each node has a cost for ending there less that for
running on; arcs that hold no letter or digit, or of which one end lies within a quotation or bracket that closes, aren't in the lattice.

In spaced scripts the nodes are runs of terminators with the closing marks after them, and the word before and the
word after decide. Spaceless scripts are segmented by word lattices over a dictionary of final particles,
joining particles and opening words. In Japanese and Chinese a blank or line break is a node too: a final
particle before it ends the sentence, unless the lattice of what follows opens with a joining particle;
and where nothing stands between two words, a final particle followed by an opening word ends it. After a closing quote the lattice
decides by quotatives. In Thai the nodes are the spaces, and only a joiner after one lets the sentence run on.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from corpusloom.session import spread, table

# Abbreviations after which a sentence runs on before a name or a number.
TITLES = frozenset((
    "sr", "sra", "srta", "dr", "dra", "d", "dña", "prof", "profa", "mr", "mrs", "ms", "m", "mme", "mlle", "mm", "mgr", "hr", "hrn", "fr", "st",
    "sto", "sta", "ing", "lic", "univ", "vgl", "vs", "approx", "ca", "ej", "ex", "bzw", "gov", "capt", "col", "gen", "lt", "sgt", "rev", "hon",
    "sen", "maj", "cmdr", "adm", "cpl", "pres", "supt", "gral", "tte", "cnel", "excmo", "excma", "ilmo", "ilma", "exmo", "exma", "avda", "dipl",
    "inkl", "zzgl", "bzgl", "ggf", "evtl", "sog",
))
COUNTERS = frozenset((
    "p", "pp", "pág", "págs", "art", "arts", "fig", "figs", "abb", "núm", "nº", "no", "nr", "n", "s", "cap", "caps", "vol", "vols", "sec", "tab",
    "eq", "ec", "min", "tel", "apdo", "bd", "kap", "e", "g", "i", "q", "ch", "al", "z", "usw", "u",
))
MONTHS = frozenset((
    "januar", "februar", "märz", "april", "mai", "juni", "juli", "august", "september", "oktober", "november", "dezember",
))
# Function words around gaps in scripts without spaces.
QUOTATIVES = ("という", "といい", "と言", "と述", "と話", "って", "とか", "と", "、", "，", "的", "地")
FINALS = ("ました", "ません", "でした", "ください", "です", "ます", "だ", "か", "ね", "よ", "吗", "呢", "吧", "了", "ครับ", "ค่ะ", "คะ", "นะ")
CJK_FINAL = re.compile(r"(?:ました|ません|でした|ください|です|ます)(?:よ?[かね]|よ)?$|[吗呢吧]$")
CJK_FINAL_AT_BLANK = re.compile(r"(?:だ|だった)(?:よ?[かね]|よ)?$|了$")
CJK_JOINERS = ("が", "から", "ので", "のに", "けど", "けれど", "し", "と", "か", "ね", "よ", "って", "とか", "という", "的")
CJK_OPENINGS = ("しかし", "そして", "また", "ただし", "ところが", "ところで", "とても", "とくに", "からだ", "かつ", "的确")
# Final particles that end a sentence with nothing after them, and words that open the next one.
GAP_FINALS = ("ですか", "ますか", "でしたか", "ましたか", "ませんか", "ですよ", "ですね", "ますよ", "ますね", "です", "ます", "ました", "ません", "でした", "だ", "吗", "呢")
GAP_OPENINGS = (
    "それは", "それが", "これは", "これが", "あれは", "そこで", "ここで", "私は", "私が", "私の", "僕は", "彼は", "彼が", "彼女は", "彼女が", "今日は", "明日は", "昨日は", "しかし", "そして", "ただし", "だから", "ところが", "つまり", "例えば", "たとえば",
    "我们", "他们", "她们", "你们", "这是", "那是", "但是", "然后", "所以", "因为", "可是", "不过", "我", "他", "她", "你",
)
THAI_JOINERS = ("และ", "หรือ", "ฯลฯ", "ๆ")

_BLANK = re.compile(r"(?:\r\n|[\n\r\x0b\x0c\x85  ])(?:[^\S\n\r]*(?:\r\n|[\n\r\x0b\x0c\x85  ]))+")
_ITEM = re.compile(r"(?:^|(?<=[\n\r]))[^\S\n\r]*(?:[-•*–‣◦▪·]|\(?\d{1,3}\)|\(?[A-Za-z]\)|\(?[ivxIVX]{1,5}\))[^\S\n\r]+(?=\S)")
_NUMBERED = re.compile(r"\d{1,3}(?:\.\d{1,3})*\.?(?=\s)")
_END = re.compile(r"""([.!?…؟۔।॥]+|[。！？｡．]+)(?:(?<=[。！？｡．”’」』）】》])[”’」』）】》]|\s?[»”](?!\w)|["'“”’»)\]」』）】》](?!\w))*|\s(?=[฀-๿])|(?<=[぀-ヿ㐀-鿿豈-﫿])\s+(?=[぀-ヿ㐀-鿿豈-﫿])""")
_GAP = re.compile(f"(?<=[\u3040-\u30ff\u3400-\u9fff])(?:{'|'.join(GAP_FINALS)})(?={'|'.join(GAP_OPENINGS)})")
_MARKS = re.compile(r"[«»„“”\"「」『』()（）《》\[\]]")
_WORD_BEFORE = re.compile(r"[^\W_]+$")
_CJK = re.compile(r"[぀-ヿ㐀-鿿豈-﫿]")
_CLOSES = {"»": "«", "”": "“„", "」": "「", "』": "『", ")": "(", "）": "（", "》": "《", "]": "["}
_OPENERS = "«“„\"'‘「『([（《"
_THAI = re.compile(r"[฀-๿]")


def word_lattice(text: str, words: tuple[str, ...]) -> list[str]:
    """The cheapest segmentation: a dictionary word costs 1, a run of one character class 2.1, a lone character 3."""

    def kind(c: str) -> int:
        return 1 if "぀" <= c <= "ゟ" else 2 if "゠" <= c <= "ヿ" else 3 if c >= "㐀" else 4 if "฀" <= c <= "๿" else 0

    n = len(text)
    best: list[tuple[float, int]] = [(0, 0)] + [(1e9, 0)] * n
    for i in range(n):
        at = best[i][0]
        j = i + 1
        while j < n and kind(text[j]) == kind(text[i]):
            j += 1
        arcs = [(len(w), 1.0) for w in words if text.startswith(w, i)] + [(j - i, 2.1), (1, 3.0)]
        for length, cost in arcs:
            if at + cost < best[i + length][0]:
                best[i + length] = (at + cost, i)
    out, i = [], n
    while i > 0:
        out.append(text[best[i][1] : i])
        i = best[i][1]
    return out[::-1]


def _spans(text: str) -> list[tuple[int, int]]:
    """The outermost quotations and brackets that close, as (opening, closing) positions."""
    if not _MARKS.search(text):
        return []
    stack: list[tuple[str, int]] = []
    spans: list[tuple[int, int]] = []
    for m in _MARKS.finditer(text):
        c, i = m.group(), m.start()
        if c == '"':
            at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == '"'), -1)
        elif c == "“":
            at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == "„"), -1)
        elif c in _CLOSES:
            at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] in _CLOSES[c]), -1)
            if at < 0:
                continue
        else:
            at = -1
        if at < 0:
            stack.append((c, i))
        else:
            spans.append((stack[at][1], i))
            del stack[at:]
    spans.sort()
    outer: list[tuple[int, int]] = []
    for a, b in spans:
        if not outer or a > outer[-1][1]:
            outer.append((a, b))
    return outer


def _starts(text: str, i: int) -> str:
    """What kind of thing starts at i: upper, lower, digit, sign, other (uncased letters), end."""
    n = len(text)
    while i < n and (text[i] in _OPENERS or text[i] in "¿¡—–"):
        if text[i] in "¿¡":
            return "upper"
        i += 1
    if i >= n:
        return "end"
    c = text[i]
    if c.isdigit():
        return "digit"
    if c.isupper():
        return "upper"
    if c.islower():
        # A name that begins in lower case, such as a measure, may open a sentence.
        return "upper" if i + 1 < n and text[i + 1].isupper() else "lower"
    if c.isalpha():
        return "other"
    if unicodedata.category(c) in ("So", "Sk", "Sm", "Sc"):
        return "sign"
    return "mark"


def _end_cost(text: str, m: re.Match) -> float:
    """The cost of ending at this node less the cost of running on; negative where the sentence ends."""
    run, e = m.group(1), m.end()
    if run is None and _CJK.match(text[e]):
        before = text[max(0, m.start() - 12) : m.start()]
        wrapped = any(c in m.group() for c in "\n\r")  # a lone character may be the first half of a word there
        if not CJK_FINAL.search(before) and (wrapped or not CJK_FINAL_AT_BLANK.search(before)):
            return 1.0
        return 1.0 if word_lattice(text[e : e + 8], CJK_JOINERS + CJK_OPENINGS)[0] in CJK_JOINERS else -1.0
    if run is None:  # a space before Thai
        if m.start() == 0 or not _THAI.match(text[m.start() - 1]) and not text[m.start() - 1].isdigit() and text[m.start() - 1] not in "?!.\"”’)":
            return 1.0
        after = word_lattice(text[e : e + 12], THAI_JOINERS + FINALS)
        return 1.0 if after and after[0] in THAI_JOINERS else -1.0
    k = e
    while k < len(text) and text[k].isspace():
        k += 1
    spaced = k > e
    if k >= len(text):
        return -1.0
    follow = text[k]
    if follow in ",;:，、；：)]）」』”»؛،":
        return 1.0
    before = text[max(0, m.start() - 60) : m.start()]
    if not before.isascii():
        before = unicodedata.normalize("NFC", before)
    closed = e > m.start() + len(run)
    if run[-1] in "。！？｡．" or (run[-1] in "?!…" and _CJK.match(follow) and (before and _CJK.match(before[-1]))):
        if run[-1] == "…":
            return 1.0
        if closed:
            after = word_lattice(text[k : k + 8], QUOTATIVES)
            return 1.0 if after and after[0] in QUOTATIVES else -1.0
        return -1.0
    if run[-1] in "।॥؟۔":
        return -1.0
    if _CJK.match(follow) and run == "…" * len(run):
        return 1.0
    start = _starts(text, k)
    if run[-1] in "!?":
        if start in ("lower",):
            return 1.0
        return -1.0 if spaced or start in ("upper", "other", "sign") else 1.0
    if run in ("…", "...", "....", "……") or run.endswith("..") or run.endswith("…"):
        return -1.0 if start in ("upper", "sign", "digit") and spaced else 1.0
    # One full stop.
    w = _WORD_BEFORE.search(before)
    word = w.group() if w else ""
    if closed:
        return 1.0 if start == "lower" or not spaced else -1.0
    if not spaced:
        # A missing space: a word of small letters, then a word with a capital and a small letter.
        if word and word[-1].isdigit():
            return 1.0
        if not word and before and not before[-1].isspace() and follow.isupper() and before[-1] in "%»”)":
            return -1.0
        glued = len(word) > 1 and word[-1].islower() and follow.isupper() and k + 1 < len(text) and (text[k + 1].islower() or text[k + 1].isspace()) and "." not in before[-len(word) - 1 : -len(word)]
        return -1.0 if glued or (follow in "¿¡«" and len(word) > 1) else 1.0
    if start == "lower":
        return 1.0
    low = word.lower()
    if word and "ऀ" <= word[-1] <= "ॿ" or before and "ऀ" <= before[-1] <= "ॿ":
        return 1.0
    head = before[: len(before) - len(word)].rstrip()
    numbered = bool(head) and head[-1].isdigit()
    if len(word) == 1 and word.isalpha():
        dotted = head.endswith(".") and len(head) > 1 and head[-2].isalpha() and (len(head) < 3 or not head[-3].isalpha())
        if low in ("m", "c") and dotted and head[-2].lower() in "pad":
            return 1.0 if start == "lower" else -1.0  # a.m., p.m.
        if numbered or head.endswith("°"):
            return -1.0 if not (start == "digit" and low in "ps") else 1.0
        if start == "digit" and low not in COUNTERS:
            return 1.0 if dotted else -1.0
        return 1.0
    if word.isupper() and len(word) <= 3 and re.match(r"[^\W\d_a-zà-ÿ]{1,3}\.", text[k : k + 4]):
        return 1.0  # an abbreviation in several parts
    if low in TITLES and not numbered and start in ("upper", "digit", "other"):
        return 1.0
    if start == "digit" and low in COUNTERS and not numbered:
        return 1.0
    if low in COUNTERS and len(low) <= 3 and not numbered and low not in ("no", "al", "min", "sec") and start == "upper" and low in ("fig", "art", "núm", "pág", "abb", "nr", "cap", "vol"):
        return 1.0
    if word.isdigit():
        if len(word) <= 2 and start == "upper":
            after = re.match(r"[^\W\d_]+", text[k:])
            if after and after.group().lower() in MONTHS:
                return 1.0
        if not head:  # the number of a heading or an item
            return 1.0
    return -1.0


def _gaps(text: str) -> list[int]:
    """Places between a final particle and an opening word with nothing between them, as the word lattice around them cuts it."""
    out = []
    for m in _GAP.finditer(text):
        a, e = max(0, m.start() - 6), m.end()
        cuts = {a}
        for w in word_lattice(text[a : e + 4], GAP_FINALS + GAP_OPENINGS + CJK_JOINERS):
            cuts.add(max(cuts) + len(w))
        # Chinese has no change of character class that a lattice could cut at: there the two words decide alone.
        if m.group() in "吗呢" or (m.start() in cuts and e in cuts):
            out.append(e)
    return out


def _cheapest(text: str, nodes: list[tuple[int, float]]) -> list[int]:
    """The nodes of the cheapest path from 0 to the end of ``text`` whose every arc holds a letter or digit.

    ``nodes`` are (position, cost) in order of position; the end is a node of no cost. A text without letters or digits is one arc.
    """
    n = len(text)
    stops = [(0, 0.0), *((e, c) for e, c in nodes if 0 < e < n), (n, 0.0)]
    held = [0]  # letters and digits before each stop, as far as it matters: whether the count grows
    for (a, _), (b, _) in zip(stops, stops[1:]):
        held.append(held[-1] + any(map(str.isalnum, text[a:b])))
    best, back = [0.0], [-1]
    # The cheapest of the stops with a lesser count than each stop's: counts grow along the text, so a pointer finds them.
    lead, top, k = 0, (0.0, 0), 0
    for j in range(1, len(stops)):
        while k < j and held[k] < held[j]:
            top = min(top, (best[k], -k)) if k else (best[0], 0)
            k += 1
        if k and held[-top[1]] < held[j]:
            best.append(top[0] + stops[j][1])
            back.append(-top[1])
        else:
            best.append(float("inf"))
            back.append(0)
    j = len(stops) - 1
    if best[j] == float("inf"):  # what follows the last node holds nothing: it belongs to the sentence before
        j = min(range(len(stops)), key=lambda i: (best[i] if i else float("inf"), -i))
        if best[j] == float("inf"):
            return [0, n]
    path = [n]
    j = back[j]
    while j > 0:
        path.append(stops[j][0])
        j = back[j]
    return [0, *path[::-1]]


def _paragraph(text: str) -> list[tuple[int, int]]:
    """Sentence spans of one paragraph: the arcs of the cheapest path through its lattice."""
    number = _NUMBERED.match(text)
    skip = number.end() if number and number.group().endswith(".") else 0
    spans = _spans(text)
    ends = [(m.end() if m.group(1) is not None else m.start(), m) for m in _END.finditer(text)]
    if _CJK.search(text):
        ends = sorted([*ends, *((e, None) for e in _gaps(text))], key=lambda x: x[0])
    nodes: list[tuple[int, float]] = []
    s = 0
    for e, m in ends:
        if e <= skip:
            continue
        while s < len(spans) and spans[s][1] < e:
            s += 1
        if s < len(spans) and spans[s][0] < e <= spans[s][1]:
            continue  # inside a quotation or bracket
        nodes.append((e, -1.0 if m is None else _end_cost(text, m)))
    at = _cheapest(text, nodes)
    return list(zip(at, at[1:]))


def sentence_spans(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of each sentence, without outer white space; none for null, empty or blank texts."""
    if not text:
        return []
    blocks, at = [], 0
    for m in _BLANK.finditer(text):
        blocks.append((at, m.start()))
        at = m.end()
    blocks.append((at, len(text)))
    out: list[tuple[int, int]] = []

    def add(a: int, b: int) -> None:
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a < b:
            out.append((a, b))

    for a, b in blocks:
        block = text[a:b]
        items = [m.start() for m in _ITEM.finditer(block)]
        head = items[0] if items else len(block)
        lead = len(block[:head]) - len(block[:head].lstrip())
        for x, y in _paragraph(block[lead:head]) if head > lead else ():
            add(a + lead + x, a + lead + y)
        for x, y in zip(items, [*items[1:], len(block)]):
            add(a + x, a + y)
    return out


def split_sentences(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, sentence_no, char_from, char_to, sentence): the sentences of every document in order.

    Positions are 0-based characters, the end exclusive. Null, empty and blank texts give no rows. Other
    columns of the input are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, no, start, end, parts = [], [], [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for k, (a, b) in enumerate(sentence_spans(t)):
                    ids.append(i)
                    no.append(k)
                    start.append(a)
                    end.append(b)
                    parts.append(t[a:b])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(no, pa.int32()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(parts, pa.string())],
                ["doc_id", "sentence_no", "char_from", "char_to", "sentence"],
            )

    schema = "doc_id bigint, sentence_no int, char_from int, char_to int, sentence string"
    return documents.select(f"`{key}`", f"`{text}`").mapInArrow(run, schema)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return split_sentences(docs).select("doc_id", "char_from", "char_to")
