"""Scalar functions on text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.unicode import base_name

# Fixed value: all that Unicode counts as white space, for engines whose \s is ASCII.
SPACES = "[\\x09-\\x0D\\x1C-\\x20\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]+"

# Acronyms and what is appended for them, in this order.
ACRONYMS = {
    "REBT": "Reglamento Electrotécnico para Baja Tensión",
    "ITC-BT": "Instrucción Técnica Complementaria para Baja Tensión",
    "RITE": "Reglamento de Instalaciones Térmicas en los Edificios",
    "CTE": "Código Técnico de la Edificación",
    "MBTS": "Muy Baja Tensión de Seguridad",
    "MBTP": "Muy Baja Tensión de Protección",
    "ICT": "Infraestructura Común de Telecomunicaciones",
    "RETIE": "Reglamento Técnico de Instalaciones Eléctricas",
}

# Spanish function words for the legibility share.
FUNCTION_WORDS = (
    "de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una",
    "su", "para", "es", "al", "lo", "como", "más", "o", "pero", "sus", "le", "ha", "me", "si", "sin", "sobre",
    "este", "ya", "entre", "cuando", "todo", "esta", "ser", "son", "dos", "también", "fue",
)

# Fixed value: the namespace of point ids, 6f9619ff-8b86-d011-b42d-00c04fc964ff.
POINT_NAMESPACE = "6f9619ff8b86d011b42d00c04fc964ff"


def collapse(text: Column) -> Column:
    """White space runs as one space, trimmed; null stays null."""
    return F.trim(F.regexp_replace(text, SPACES, " "))


def normalised(text: Column) -> Column:
    return F.lower(collapse(text))


def text_hash(text: Column) -> Column:
    return F.sha1(F.encode(normalised(text), "UTF-8"))


def sanitised_query(query: Column, max_chars: int = 200) -> Column:
    """A query fit for lexical search: no operators, single spaces, cut; '' when under three characters are left; null stays null."""
    cut = F.substring(collapse(F.regexp_replace(query, r"[#@$%&*(){}\[\]<>|\\]+", " ")), 1, max_chars)
    return F.when(F.length(F.trim(cut)) < 3, "").otherwise(cut)


def expanded_acronyms(query: Column) -> Column:
    """The query with the full terms of its acronyms appended, each once; null and '' stay."""
    terms = [F.when(query.rlike(rf"(?iU)(?<![\w-]){a}(?![\w-])"), F.lit(x)) for a, x in ACRONYMS.items()]
    return F.when(query.isNull() | (query == ""), query).otherwise(F.array_join(F.filter(F.array(query, *terms), lambda t: t.isNotNull()), " "))


# The reference's forms of glyphs of fonts, and of accented letters that a font's own encoding shows as others.
GLYPH, LOST_GLYPH = r"GLYPH<(?=\d{1,7}>)", r"GLYPH<c=\d+,font=[^>]*>"
STANDARD_LETTERS = {"Æ": "á", "Ø": "é", "œ": "ú", "æ": "ñ", "Œ": "Í"}
_MARK = "\x01"


def _glyph(code: Column) -> Column:
    """The character of a numbered glyph: controls as nothing, 128 to 159 by code page 1252; null if there is none."""
    windows = F.array(*[F.lit(bytes([c]).decode("cp1252", "ignore")) for c in range(128, 160)])
    wide = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return (
        F.when((code > 0x10FFFF) | code.between(0xD800, 0xDFFF), None)
        .when((code < 32) | (code == 127), "")
        .when(code.between(128, 159), F.get(windows, code - 128))
        .otherwise(wide)
    )


def repaired(text: Column) -> Column:
    """(text, glyph_decimal, standard_encoding, unrecoverable): text with glyphs and letters repaired, and how many of each.

    Numbered glyphs first, so that a letter that comes of one is repaired in turn; letters only next to a letter. Null
    stays null with counts of 0.
    """
    pieces = F.split(text, GLYPH)
    made = F.transform(
        F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))),
        lambda p: F.struct(_glyph(F.regexp_extract(p, r"^(\d+)>", 1).cast("int")).alias("c"), p.alias("p")),
    )
    tail = F.transform(made, lambda m: F.coalesce(F.concat(m["c"], F.regexp_replace(m["p"], r"^\d+>", "")), F.concat(F.lit("GLYPH<"), m["p"])))
    decoded = F.concat(F.get(pieces, F.lit(0)), F.array_join(tail, ""))
    letters = "".join(STANDARD_LETTERS)
    marked = F.regexp_replace(F.replace(decoded, F.lit(_MARK), F.lit("")), f"(?<=[A-Za-zÀ-ÿ])[{letters}]|[{letters}](?=[A-Za-zÀ-ÿ])", f"{_MARK}$0")
    out = marked
    for seen, meant in STANDARD_LETTERS.items():
        out = F.replace(out, F.lit(_MARK + seen), F.lit(meant))
    count = lambda n: F.coalesce(n, F.lit(0)).cast("long")
    return F.struct(
        out.alias("text"), count(F.size(F.filter(made, lambda m: m["c"].isNotNull()))).alias("glyph_decimal"),
        count(F.length(marked) - F.length(F.replace(marked, F.lit(_MARK), F.lit("")))).alias("standard_encoding"), count(F.regexp_count(text, F.lit(LOST_GLYPH))).alias("unrecoverable"),
    )


def embed_query(query: Column, model: Column) -> Column:
    """The query with the prefix its embedding model asks for; names are told by what they contain, in any letter case."""
    m = F.lower(model)
    return F.when(m.contains("e5") & m.contains("instruct"), F.concat(F.lit("Instruct: Retrieve relevant documents\nQuery: "), query)).when(m.contains("e5"), F.concat(F.lit("query: "), query)).otherwise(query)


def embed_passage(text: Column, model: Column) -> Column:
    m = F.lower(model)
    return F.when(m.contains("e5") & ~m.contains("instruct"), F.concat(F.lit("passage: "), text)).otherwise(text)


def context_limit(generative: Column, configured: int = 12_000, window: int = 16_384, answer: int = 2_048, soft: int = 6_000) -> Column:
    """Tokens of context: for generative requests what the window leaves beside the answer and 1,000 more, at most the configured number; else the soft limit."""
    return F.when(F.coalesce(generative, F.lit(False)), min(configured, window - answer - 1000)).otherwise(soft)


def collection_name(topic: Column, suffix: str = "") -> Column:
    return F.concat(F.lit("rag_"), F.lower(topic), F.lit(suffix))


def token_estimate(text: Column) -> Column:
    """Tokens where no tokenizer is at hand: a quarter of the characters, at least one; null counts as empty."""
    return F.greatest(F.lit(1), F.floor(F.coalesce(F.char_length(text), F.lit(0)) / 4)).cast("long")


def point_id(file_path: Column, chunk_id: Column) -> Column:
    """The version 5 UUID of "path:chunk" in the point namespace; null if either is null."""
    h = F.sha1(F.concat(F.unhex(F.lit(POINT_NAMESPACE)), F.encode(F.concat(file_path, F.lit(":"), chunk_id.cast("string")), "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def clamped_page(page: Column, total: Column) -> Column:
    """A page within [1, total]; null becomes 1; a null or zero total sets no upper bound."""
    low = F.greatest(F.coalesce(page, F.lit(1)), F.lit(1))
    return F.when(total > 0, F.least(low, total)).otherwise(low)


def page_marker(text: Column) -> Column:
    """The page a text names near its start, from 1 to 10,000, by the first pattern that has one; else null."""
    start = F.lower(F.substring(text, 1, 100))
    found = []
    for p in (r"page\s+(\d+)", r"página\s+(\d+)", r"pág\.\s*(\d+)", r"(?U)\bpg\.\s*(\d+)"):
        n = F.try_to_number(F.when(F.regexp_extract(start, p, 1) != "", F.regexp_extract(start, p, 1)), F.lit("999999999")).cast("int")
        found.append(F.when(n.between(1, 10000), n))
    return F.coalesce(*found)


def quoted(name: Column) -> Column:
    """Percent-encoding that leaves letters, digits and ``_.-~``."""
    return F.replace(F.replace(F.replace(F.url_encode(name), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def citation_url(topic: Column, file_path: Column, page: Column) -> Column:
    name = F.concat(quoted(base_name(file_path)), F.lit("#page="), page.cast("string"))
    return F.when(F.coalesce(topic, F.lit("")) != "", F.concat(F.lit("/docs/"), topic, F.lit("/"), name)).otherwise(F.concat(F.lit("/docs/"), name))


def citation_label(topic: Column, file_path: Column, page: Column) -> Column:
    return F.concat(F.lit("["), base_name(file_path), F.lit(", p."), page.cast("string"), F.lit("]("), citation_url(topic, file_path, page), F.lit(")"))


def query_tokens(query: Column) -> Column:
    """Words between white space; 0 for null, empty and blank."""
    c = collapse(query)
    return F.when(F.coalesce(c, F.lit("")) == "", 0).otherwise(F.size(F.split(c, " ")))


def legibility(text: Column) -> Column:
    """Share of function words among the words; 0 where there are none."""
    words = F.regexp_extract_all(F.lower(text), F.lit("([a-záéíóúñü]+)"), 1)
    hits = F.filter(words, lambda w: w.isin(*FUNCTION_WORDS))
    return F.when(F.coalesce(F.size(words), F.lit(0)) > 0, F.size(hits) / F.size(words)).otherwise(F.lit(0.0))


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def user_hash(email: Column) -> Column:
    return F.when(F.coalesce(email, F.lit("")) == "", "anon").otherwise(F.substring(F.sha2(F.encode(email, "UTF-8"), 256), 1, 12))
