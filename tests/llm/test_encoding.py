import pytest

from corpusloom.llm import encoding as C

CLEAN = [
    "El régimen del motor también señala el período de año.", "la marca Æ-12 y Ø 64 mm, método Brøndal-Løve, ångström, chef d'œuvre, cœur",
    "NÃO TOCAR: POSIÇÃO DE PARAFUSO", "Escribe GLYPH en la consola y pulsa Intro.", "5 µL a 20 °C ± 1 °C, R₁ ≈ 33,2 Ω · 10⁻³, ½ kg", "Größe, heiß, Straße", "室温で実験班は記録します。", "🔧🔧🔧", "", "   ", "¿Qué? ¡Sí!",
]
ORIGINAL = "«¿El término químico?», preguntó la mezcla homogénea según el régimen."


@pytest.mark.parametrize("text", CLEAN)
def test_clean_text_stays(text):
    assert C.restore(text) == (text, [], 0, False)


def sloppy(data: bytes, name: str) -> str:
    out = ""
    for b in data:
        try:
            out += bytes([b]).decode(name)
        except UnicodeDecodeError:
            out += chr(b)
    return out


@pytest.mark.parametrize("name", ["cp1252", "latin-1", "mac_roman", "cp1250", "iso8859_2", "cp1251", "koi8_r", "cp437", "cp850"])
def test_utf8_read_wrongly_comes_back(name):
    assert C.restore(sloppy(ORIGINAL.encode(), name))[0] == ORIGINAL


def test_twice():
    assert C.restore(sloppy(sloppy(ORIGINAL.encode(), "cp1252").encode(), "cp1252"))[0] == ORIGINAL


@pytest.mark.parametrize("name", ["cp437", "cp850", "cp1251", "koi8_r"])
def test_one_byte_encodings(name):
    text = "La función recursiva justifica la energía después del término químico."
    assert C.restore(sloppy(text.encode("cp1252"), name))[0] == text


@pytest.mark.parametrize("bad, good", [("MaGLYPH<237>z", "Maíz"), ("mantendrÆ", "mantendrá"), ("gØrmenes", "gérmenes"), ("Nœmero", "Número"), ("Espaæol", "Español"), ("aGLYPH<151>b", "a—b")])
def test_fonts(bad, good):
    assert C.restore(bad)[0] == good


@pytest.mark.parametrize("text", ["mGLYPH<c=56,font=/A+Serif>sculo", "el n?mero de vueltas", "reg�men"])
def test_stand_ins_are_found(text):
    assert C.restore(text)[2] > 0


def test_operator(spark):
    e = spark.createDataFrame([(1, "f", "tÃ©rmino", "x"), (2, "f", "término", "x"), (3, "g", None, "x"), (4, None, "tÃ©rmino", "x"), (5, "f", "tÃ©rmino", "x")], "element_id long, file_path string, text string, extractor string")
    x = spark.createDataFrame([("f", "text"), ("f", "text"), ("f", None), (None, "ocr")], "file_path string, extractor string")
    got = {r.element_id: (r.extractor, r.restored) for r in C.damaged(e, x).collect()}
    assert got == {1: ("text", "término"), 4: (None, "término"), 5: ("text", "término")}
    assert C.damaged(e.limit(0), x.limit(0)).count() == 0


def test_implausible_results_are_refused():
    model = C.fit_characters(["el garçon français a reçu la leçon", "la façon"])
    assert C.restore("le garĂ§on", model)[:2] == ("le garçon", ["utf8 read as cp1250"])
    # Each reading that costs less has characters in surroundings that the model doesn't know.
    model = C.fit_characters(["régimen según término químico", "a‡b"])
    text, steps, _, bad = C.restore("a‡b reg‡men", model)
    assert bad and (steps == [] and text == "a‡b reg‡men" or C.unseen(text, model) <= C.unseen("a‡b reg‡men", model))


def test_model_counts_all_texts(spark):
    texts = ["el régimen", "İ\u0130 ΑΣ", "día 17 é", "día 29 é", "cœur", "室温で実験", "plain", "ÃƒÂ© tÃ©rmino"]
    s, n = C.count_surroundings(texts[:-1])
    want = {}
    for t in texts[:-1]:
        low = f" {t.lower()} ".translate(str.maketrans("123456789", "000000000"))
        for x in {low[i - 1 : i + 2] for i, c in enumerate(low) if c > "\x7f"}:
            want[x] = want.get(x, 0) + 1
    assert {"".join(chr(int(v) >> k & 0x1FFFFF) for k in (42, 21, 0)): m for v, m in zip(s, n)} == want and want[" é "] == 2
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "element_id long, text string")
    right = [t for t in texts if not t.isascii() and C.plausibility_cost(t) == 0]
    assert 5 <= len(right) < len(texts) and C.character_model(df).tolist() == C.fit_characters(right).tolist()


def test_rare_surroundings_are_seen_in_the_whole_table(spark):
    # Two readings cost the same but for the model, and 5 of 30,000 right texts, none of them among the 1,000 least by hash of their ids, show one.
    bad = "El gremio pesa ¢ kg y el m·sculo agonista."
    rows = [(i, "f", "La función") for i in range(30_000)] + [(40_010 + i, "f", f"Palabra{i} pesa ½ kg") for i in range(5)] + [(50_000, "f", "Damaged pesa ¢ kg"), (60_000, "f", bad)]
    e = spark.createDataFrame(rows, "element_id long, file_path string, text string")
    got = {r.element_id: r.restored for r in C.damaged(e, spark.createDataFrame([], "file_path string, extractor string")).collect()}
    assert got == {60_000: "El gremio pesa ½ kg y el músculo agonista."}


def test_whatever_may_cost_is_searched(spark):
    """The filter before the search lets every text pass that costs anything."""
    from pyspark.sql import functions as F

    chars = [chr(c) for c in [*range(0x80, 0x250), *range(0x370, 0x3A0), *range(0x400, 0x480), *range(0x2000, 0x2600), 0xFFFD, 0xE000]]
    texts = [a + c + b for c in chars for a, b in (("a", "a"), ("", "a"), ("a", ""), ("A", "a"), (" ", " "), ("b", "b"))] + ["GLYPH<12>", "a&aacute;", "n?mero", " ?dos", "(cid:3)"]
    costly = [(t,) for t in texts if C.plausibility_cost(t) > 0 or C._STAND_INS.search(t)]
    df = spark.createDataFrame(costly, "text string")
    assert [r.text for r in df.where(~F.col("text").rlike(C.SUSPICIOUS)).collect()] == []


def test_triggers_skip_no_pattern():
    chars = [chr(c) for c in [*range(0x20, 0x250), *range(0x370, 0x480), *range(0x2000, 0x2600), 0xFFFD]]
    for t in (a + c + b + d for c in chars for a, b in (("a", "a"), ("", "a"), ("a", ""), ("A", "a"), ("Ã", " "), ("¬", "x")) for d in ("", "³")):
        assert C.plausibility_cost(t) == sum(c * len(p.findall(t)) for p, c in C._COSTS)
