import pytest
from pyspark.sql import functions as F

from corpusloom.llm import languages as L

TEXTS = {
    "es": "cómo se calcula cuánto regula la válvula de admisión|necesito saber si el motor protege la memoria reservada|para qué sirve el cuadro de mandos después del mantenimiento",
    "en": "what happens when the unit test blocks the valve|where is it written that the engine returns the previous reading|explain why the boiling point is measured at the end of the term",
    "fr": "que se passe-t-il quand le réservoir limite la pression|explique pourquoi la mémoire est protégée sous contrôle technique|où est-il écrit que la boîte règle le moteur",
    "de": "was passiert, wenn die Kühlpumpe den Druck misst|erkläre, warum die Prüfung wiederholt werden muss|wo steht, dass der Katalysator die Drehzahl begrenzt",
    "pt": "o que acontece quando a válvula mede a tensão de saída|preciso de saber se a função limita a rotação do motor|onde está escrito que o técnico protege a memória",
    "la": "cur agricola fessus quaerit verba difficilia|quando consul prudens docet equum album ante lucem|quid nauta peritus portat trans flumen ut omnes intellegant",
}


@pytest.fixture(scope="module")
def model():
    return L.train_on([(t, k) for k, v in TEXTS.items() for t in v.split("|")])


def langs(model, text):
    return [p[0] for p in L.segments(model, [text])[0]]


@pytest.mark.parametrize("text, want", [("para qué sirve la válvula reservada", ["es"]), ("what is the previous reading of the engine", ["en"]), ("warum die Kühlpumpe die Drehzahl begrenzt", ["de"]), ("", []), (None, []), ("?", []), ("12 V", []), ("   ", [])])
def test_single(model, text, want):
    assert langs(model, text) == want


def test_two_languages(model):
    got = L.segments(model, ["explain why the boiling point is measured / was passiert, wenn die Kühlpumpe den Druck misst"])[0]
    assert [p[0] for p in got] == ["en", "de"] and all(0 < p[1] <= 1 for p in got)


def test_held_out_accuracy_and_cases(spark, small):
    rows = spark.read.parquet(f"{small}/retrievals.parquet")
    m = L.train(rows, "retrieval_id", "query", "original_language")
    got = L.identify(rows, m, "retrieval_id", "query").groupBy("row_id").agg(F.collect_set("lang").alias("langs"))
    labelled = rows.select(F.col("retrieval_id").alias("row_id"), L.label_language(F.col("original_language")).alias("l")).where(F.col("l").isin(*L.LANGUAGES))
    both = got.join(labelled, "row_id").where(F.size("langs") == 1)
    right = both.where(F.array_contains("langs", F.col("l"))).count()
    assert right >= 0.9 * both.count() > 0  # some labels are wrong by design


@pytest.mark.parametrize("label, want", [("es-ES", "es"), ("español", "es"), ("ENG", "en"), ("German", "de"), ("lat", "la"), ("ca", "ca"), ("unknown", None), ("??", None), ("", None), (None, None), (" FR ", "fr")])
def test_labels(spark, label, want):
    assert spark.createDataFrame([(label,)], "l string").select(L.label_language(F.col("l")).alias("r")).first().r == want
