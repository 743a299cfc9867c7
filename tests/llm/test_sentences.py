import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm.sentences import sentence_spans, split_sentences

CASES = [
    "El Sr. Raorve revisó, p. ej., los iones.| La norma núm. 13.898 de EE. UU. no regula nada.",
    "Hay que esperar... y luego el motor para.| Se compran tuercas, etc.| 28.724 alumnos ven cómo.",
    "«¿El plano corrige la línea?», preguntó la tutora Rabri.| ¡Atención: el ácido limita!| ¿Cómo?!, pensó Flaga.",
    "La Dra. Tresofe dijo: «la bobina reúne el punto. Después multiplica el código.»| El verbo sigue.",
    "J. R. Rineza y M. Greta miden a las 9.46 h.| La empresa Dra, S. L., regula la línea...| El árbol crece.",
    "Wait... then the socket blocks.| They meet at 9.52 a.m. to see it at 9 p.m.| The cost rose, i.e. 41.20 % more.| pH 46.33 is where it ends.",
    '"Is it true that it stores?" asked Mr. Soorneca.| "Really?!" said Nokalu.| Sobami Ltd. and Nemi Inc. ship it.',
    "Fr. Dr. Nemaho sagte: „die Ebene dreht. Danach schützt sie.“| Siehe Nr. 26 auf S. 27, denn es gilt.| Am 3. Mai und am 1. Juni, d. h. um 2,47 %.",
    "Mme Zabata a dit : « une œuvre décrit. Puis elle règle. »| La valeur passe ?| L'art. 24 et la p. 20 : oui !",
    "老师说：“劳动合同记录了距离。请再看一遍。”|变压器提高了温度……然后再次检查（见图8.9）。|这个函数限制了吗？|编译器说明了。",
    "先生は「関数は記録します。もう一度見てください。」と言いました。|変圧器は守ります。",
    "डॉ. नया छात्र पैमाना बचाता है।| क्या प्रयोग समूह लिखता है?| यह फलन है।",
    "هل يحدد المعلم جهد الخرج؟| يفحص عقد العمل.",
    "แผงโซลาร์เซลล์เปลี่ยน| กลุ่มทดลองจำกัด",
    "Introducción|\n\n|3.1. Worked examples|\n \n|El motor gira.| ✅ La válvula abre.|\n|- Primero. Sigue.|\n|- Segundo|\n|2) tercero. 4",
    "un salto\nde línea no corta.| Otra frase.El final pegado.".replace("frase.El", "frase.|El"),
]


@pytest.mark.parametrize("case", CASES)
def test_boundaries(case):
    parts = case.split("|")
    text = "".join(parts)
    want, at = [], 0
    for p in parts:
        s = p.strip()
        if s:
            want.append(s)
        at += len(p)
    assert [text[a:b] for a, b in sentence_spans(text)] == want


def test_decomposed_accents():
    import unicodedata

    text = unicodedata.normalize("NFD", "Limita la oración. El técnico núm. 3 y la pág. 4 ven la medición. La válvula abre.")
    assert len(sentence_spans(text)) == 3


@given(st.text(max_size=400))
@settings(max_examples=200, deadline=None)
def test_spans_are_ordered_and_cover_all_but_white_space(text):
    spans = sentence_spans(text)
    assert all(a < b and not text[a].isspace() and not text[b - 1].isspace() for a, b in spans)
    assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
    covered = "".join(text[a:b] for a, b in spans)
    assert "".join(covered.split()) == "".join(text.split())


def test_operator(spark):
    rows = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, " \n", "x"), (4, "Uno. Dos.", "x"), (4, "Uno. Dos.", "x")], "doc_id long, text string, sentence string")
    got = split_sentences(rows).collect()
    assert sorted((r.doc_id, r.char_from, r.char_to) for r in got) == [(4, 0, 4), (4, 0, 4), (4, 5, 9), (4, 5, 9)]
    assert split_sentences(rows.limit(0)).count() == 0


def test_long_text_is_linear():
    assert len(sentence_spans("El motor gira. " * 20000)) == 20000
