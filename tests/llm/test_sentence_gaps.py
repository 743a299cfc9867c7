"""Japanese and Chinese sentences that end at a gap, without a terminator."""

import random
from itertools import combinations

import pytest

from corpusloom.llm.sentences import _cheapest, sentence_spans

CASES = [
    "変圧器は守ります| 関数は記録しました\n|しかし先生は見ませんでした| 終わりです。",
    "これは関数ですか　|はい、関数です",
    "変圧器は守ります が動きません",
    "先生は見ました\nから記録します。",
    "変圧器\nは守ります。|関数 の記録。",
    "变压器提高了吗| 请再看一遍吧\n|编译器说明了 |我们看",
    "编译器说明了\n解的距离。",
    "劳动合同 记录距离。",
    "これはペンです|それは本ですか|私は学生だ",
    "私は学生ですが、彼は先生です。",
    "你好吗|我很好。",
    "他来了我家。",
]


@pytest.mark.parametrize("case", CASES)
def test_gaps(case):
    text = case.replace("|", "")
    assert [text[a:b] for a, b in sentence_spans(text)] == [p.strip() for p in case.split("|")]


def test_titles_run_on():
    text = "The Gov. Smith met Capt. Jones. Then they left."
    assert [text[a:b] for a, b in sentence_spans(text)] == ["The Gov. Smith met Capt. Jones.", "Then they left."]


def test_cheapest_path_against_all_paths():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice("ab.. ") for _ in range(rng.randint(1, 12)))
        nodes = [(i, rng.choice([-1.0, 1.0, -0.5])) for i in range(1, len(text)) if rng.random() < 0.5]
        got = _cheapest(text, nodes)
        cost = dict(nodes)

        def fits(p):
            return all(any(c.isalnum() for c in text[a:b]) for a, b in zip(p, p[1:]))

        every = [[0, *c, len(text)] for k in range(len(nodes) + 1) for c in combinations([e for e, _ in nodes], k)]
        right = [p for p in every if fits(p)]
        if right:
            assert fits(got) and sum(cost.get(e, 0) for e in got[1:-1]) == min(sum(cost.get(e, 0) for e in p[1:-1]) for p in right)
        else:
            assert got == [0, len(text)]
