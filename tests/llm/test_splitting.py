from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import splitting as S

SENTENCE = "La válvula de admisión regula la presión del circuito en régimen permanente. "
OTHER = "Agricola fessus servat equum album prope villam ante lucem. "


def check(text, headings, limit=S.LIMIT):
    got = S.pieces_of(text, headings, limit)
    assert all(len(p) <= limit for p, _, _ in got)
    spans = [(a, b) for _, a, b in got]
    prefix = len(" > ".join(h for h in headings if h is not None)) + 1 if headings else 0
    start = -prefix if prefix > limit // 2 else 0
    assert spans[0][0] == start and spans[-1][1] == len(text or "")
    for (a, b), (c, d) in zip(spans, spans[1:]):
        assert c < b and d > b and c > a
        if limit == S.LIMIT:
            assert S.MIN_OVERLAP <= b - c <= S.MAX_OVERLAP
    return got


@given(st.text(alphabet="ab .\n,。é́ñ", max_size=5000), st.none() | st.lists(st.text("xy", max_size=400), max_size=3))
@settings(max_examples=60, deadline=None)
def test_pieces_cover_and_overlap(text, headings):
    check(text, headings)


def test_no_boundary_at_all():
    got = check("x" * 5000, None)
    assert len(got) == 6


def test_cuts_fall_between_sentences():
    text = SENTENCE * 40
    for _, a, b in check(text, ["Uno", "Dos"])[:-1]:
        assert text[b:].startswith("La válvula") or b == len(text)


def test_deepest_valley_wins():
    text = SENTENCE * 9 + OTHER * 12
    first = S.cut_spans(text, 1024)[0][1]
    assert first == len(SENTENCE) * 9


def test_headings_longer_than_the_limit():
    got = check(None, ["h" * 3000])
    assert got[0][1] == -3001 and got[-1][2] == 0
    assert check("", None) == [("", 0, 0)]


def test_records(spark):
    rows = spark.createDataFrame(
        [(1, "a" * 1024, None, 1), (2, "a" * 1025, None, None), (3, "a" * 1020, ["b", "c"], 2), (4, None, None, 3), (5, "", [], 4), (6, "a" * 1024, [], 5), (7, " " * 1030, None, 1)],
        "row_id long, text string, headings array<string>, page int",
    )
    got = S.split_records(rows, "chunk", "row_id", headings="headings").collect()
    assert {r.record_id for r in got if r.n_pieces > 1} == {2, 3, 7}
    assert {r.record_id for r in got} == {1, 2, 3, 4, 5, 6, 7}
    assert [r.piece[:6] for r in got if r.record_id == 3] == ["b > c\n"] * 2
    assert S.split_records(rows.limit(0), "chunk", "row_id", headings="headings").count() == 0


def test_clashing_columns(spark):
    rows = spark.createDataFrame([(1, "x", 1, "piece", 5)], "row_id long, text string, page int, piece string, n_pieces int")
    assert S.split_records(rows, "k", "row_id").first().piece == "x"
