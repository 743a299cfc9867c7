import pytest

from corpusloom.llm import scans as S


@pytest.mark.parametrize("seen, printed, want", [("mcmoria", "memoria", (1, 0)), ("expansi6n", "expansión", (1, 0)), ("voliimen", "volumen", (1, 0)), ("evaluadón", "evaluación", (1, 0)), ("tagre", "zagre", (0, 1)), ("casa", "casa", (0, 0))])
def test_explain(seen, printed, want):
    assert S.explain(seen, printed) == want


@pytest.mark.parametrize("token, n", [("l8", 18), ("2O", 20), ("xlii", 42), ("7", 7), ("ll", 11)])
def test_numerals(token, n):
    assert n in S.numerals(token)


def test_split_page():
    keys = {S.line_key("T", "Manual Kayotre"), S.line_key("B", "Resumen Orluluca Tema 3")}
    body, head, number, more = S.split_page("MANUAL KAY0TRE   Pag l2\nTexto del cuerpo.\nResumen 0rluluca  Tema 4\n12", 11, keys, 1)
    assert (body, head, number, more) == (["Texto del cuerpo."], True, True, False)
    assert S.split_page("El motor gira 263\nmm.", 3, set(), 1) == (["El motor gira 263", "mm."], False, False, False)
    assert S.split_page("", 0, set(), None) == ([""], False, False, False)


def test_headers_of_many_lines(spark):
    heads = [f"Cabecera {w} Norte" for w in ("alfa", "beta", "gamma", "delta", "kappa")]
    bodies = ["Así sigue\n" + "\n".join(f"la {w} parte {v} sigue en el" for v in "a be ce de e efe ge hache i jota ka ele".split()) for w in "uno dos tres cuatro cinco seis".split()]
    rows = [(i, "f.pdf", i, "\n".join([*heads, b])) for i, b in enumerate(bodies)]
    read = S.read_all(spark.createDataFrame(rows, "element_id long, file_path string, elem_no int, text string"))
    got = {r.element_id: (r.body, r.furniture) for r in read.collect()}
    assert got == {i: (b.split("\n"), True) for i, b in enumerate(bodies)}


def test_a_ranker_of_no_words_still_ranks():
    ranker = S.fit_ranker([])
    good, bad = ranker.score(S.np.array([S.rank_features("mcmoria", "memoria", 1, 300), S.rank_features("tagre", "zagre", 1, 300)]))
    assert good > 0 > bad


def test_join_lines():
    broken, words = S.join_lines(["la diso- ", "lución y el hispano-", "luso de", "casove.v72.pdf."])
    assert broken == [("diso", "lución"), ("hispano", "luso")] and "disolución" in words and "casove" not in words


def test_paragraphs():
    text = S.paragraphs_of(["La mcmoria del", "conduc¬", "to hispano-", "luso.", "", "Otro Mcmoria."], {"mcmoria": "memoria"}, {("hispano", "luso")})
    assert text == "La memoria del conducto hispano-luso.\n\nOtro Memoria."


def pages(spark):
    words = "La válvula de admisión regula la presión del circuito y protege la memoria reservada del motor".split()
    rows, n = [], 0
    for f, ocr in (("scan.pdf", True), ("text.pdf", False)):
        for p in range(30):
            w = words[p % 5 :] + words
            lines = [" ".join(w[i : i + 5]) for i in range(0, len(w), 5)]
            lines[0], lines[-1] = f"Así {lines[0]}", f"{lines[-1]}."
            if ocr:
                if p == 3:
                    lines[0] = lines[0].replace("presión", "presi6n").replace("regula", "re9ula").replace("admisión", "admisi6n")
                    lines[1] = "la rnemoria " + lines[1]
                if p == 4:
                    lines[1:1] = ["protege el cir-", "cuito entero"]
                if p == 5:
                    lines[1:1] = ["acuerdo hispano-", "luso del motor"]
                lines = ["Manual Kayotre", *lines, f"— {p + 1} —"]
            rows.append((n, f, p, "acuerdo hispano-luso\n" + "\n".join(lines) if not ocr and p == 0 else "\n".join(lines), "tesseract" if ocr and p != 7 else "pypdf"))
            n += 1
    rows += [(900, "scan.pdf", 40, None, "tesseract"), (901, "scan.pdf", 41, "  ", None), (902, None, None, "x", None)]
    e = spark.createDataFrame(rows, "element_id long, file_path string, elem_no int, text string, source string")
    x = spark.createDataFrame([("scan.pdf", "ocr"), ("scan.pdf", None), ("text.pdf", "text")], "file_path string, extractor string")
    return e, x


def test_noise(spark):
    e, x = pages(spark)
    got = {}
    for r in S.noise(e, x).collect():
        got.setdefault(r.noise, set()).add(r.element_id)
    scan = set(range(30))
    assert got["furniture"] == scan and got["pageno"] == scan
    assert got["hyphen"] == {4}  # the compound of page 5 has its own
    assert got["misread"] == {3}


def test_repair_and_empty(spark):
    e, x = pages(spark)
    text = {r.element_id: r.text for r in S.repaired(e, x).collect()}
    assert "Kayotre" not in text[4] and "protege el circuito entero" in text[4]
    assert "hispano-luso" in text[5] and "memoria" in text[3] and "rnemoria" not in text[3]
    assert S.noise(e.limit(0), x.limit(0)).count() == 0
