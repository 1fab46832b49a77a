import time

import pytest

from quillspark.llm.sentences import Splitter, abbreviation_counts, abbreviations, sentence_ends

CORPUS = {
    "dr": dict(c=50), "p.m": {}, "st": dict(c=40), "г": dict(c=40, l=3), "т": dict(l=50), "е": dict(l=50), "vol": dict(d=40), "p": dict(d=40), "no": dict(d=40), "approx": dict(l=40), "b": dict(l=40), "z": dict(c=40), "ca": dict(d=30), "d": dict(l=30), "h": dict(l=30),
    "extraordinair": dict(l=30, c=40),
}
CORPUS = {w: tuple(n.get(k, 0) for k in "cldpe") for w, n in CORPUS.items()}
CASES = [
    "“走！快走！”阿岫拉着邬不惊，一口气跑到白沙洲。|难道他没有来过？", "白鹭说：“他不在。明天再来吧。”|那本《谁在二楼？》是他留下的。", "她想说……算了，还是等他回来。|好！", "「鍵はどこ。もう行くよ。」と言った。|終わり。",
    "He met Dr. Halloway at 6 p.m. |Nobody asked St. John. |It is approx. an hour (see vol. 2, p. 37. Yes) away.", "He answered, “It is gone. So is he.” |Had he been there? |\"Is it far? I can't see,\" she said.",
    "Nobody asked… not even Nell. |The end… |Then more.", "В 1941 г. Варвара уехала, т. е. рано. |Она ответила: «Да. Нет». |«Стой. Не трогай», — сказала она.", "Am 3. Oktober kam er, z. B. für ca. 3 Mark, d. h. kaum. |„Warte. Ich höre“, sagte sie.",
    "« Attends. Où ? » demanda-t-il. |Il répondit : « Perdue. Tant pis. » |Fin !", "¿De veras? |¡Deja la carta! |Valía 3.5 pesos.", "“रुको। मत छूना,” उसने कहा। |डॉ. वेदांश 40.0 कि.मी. दूर थे।", "เด็ก ๆ วิ่งไป |ราคา 43.91 บาทเท่านั้น |คืนนั้น", "V1.3.5 costs 3.14. |Done", "喜欢本章请分享，编号331 ——", "It was extraordinair. small. |Then it ended.", "水位涨到6.22米｡|小笙退回!|好", "“走！”|“不走。”",
    "قالت: «لا تلمس. انتظر». |هل كانت هنا؟ |نعم.",
]


@pytest.mark.parametrize("marked", CASES)
def test_cases(marked):
    text = marked.replace("|", "")
    want, at = [], 0
    for part in marked.split("|"):
        at += len(part)
        want.append(at - (len(part) - len(part.rstrip())))
    assert Splitter([text], CORPUS).ends(0) == want, [text[a:b] for a, b in zip([0, *Splitter([text], CORPUS).ends(0)], Splitter([text], CORPUS).ends(0), strict=False)]


def test_document_decides():
    doc = ["He came from Fernholt Sq., and then Fernholt Sq. was far. Fernholt Sq. again.", "So"]
    assert len(Splitter(doc, {}).ends(0)) >= 1
    assert Splitter(["The xq. was small, the xq. was old. Then it went."], {}).ends(0)[-1] == 49


def test_names_and_other_words():
    """A capital after a title begins a name, but not where the document knows the word as a common one."""
    assert Splitter(["He met Dr. Lamp at noon. They left."], CORPUS).ends(0) == [24, 35]
    assert Splitter(["He saw the Dr. Lamp in hand he left.", "the lamp was lit"], CORPUS).ends(0) == [14, 36]
    assert Splitter(["He saw the Dr. Lamp in hand he left.", "the lamp was lit, said Lamp"], CORPUS).ends(0) == [36]


@pytest.mark.parametrize("unit", ["He went home. ", "“", "a. ", ". ", "« Oui. ", "ก ข ", "「走。」", "(", "x.y. ", "“a” b ", "… "])
def test_time_is_linear(unit):
    def took(n):
        text = unit * (n // len(unit))
        best = 1e9
        for _ in range(2):
            began = time.process_time()
            Splitter([text], CORPUS).ends(0)
            best = min(best, time.process_time() - began)
        return best

    took(1000)
    assert took(400_000) < 12 * took(100_000) + 0.3


def test_operator(spark):
    rows = [(1, ["One. Two.", "", None, "  ", "x" * 100_000], "e"), (1, ["One. Two."], "e"), (2, None, "e"), (3, [], "e")]
    df = spark.createDataFrame(rows, "id long, ps array<string>, para_no string")
    counts = abbreviation_counts(df, "ps")
    # the join gives what the table on every worker gives
    more = spark.createDataFrame([(i, ["See vol. 3 of it. Then Mr. Bell left.", f"At {i} p.m. Nobody came, approx. ten."], "e") for i in range(30)] + [(None, ["A Mr. B. C."], "e")], df.schema)
    words = abbreviations(abbreviation_counts(more, "ps"))
    both = [sorted(map(tuple, sentence_ends(more, "id", "ps", words, n).collect()), key=str) for n in (100_000, 1)]
    assert both[0] == both[1] and len(both[0]) > 60
    got = sorted((r.id, r.para_no, r.sentence_no, r.end_pos) for r in sentence_ends(df, "id", "ps", abbreviations(counts)).collect())
    assert got == sorted([(1, 0, 0, 4), (1, 0, 1, 9), (1, 0, 0, 4), (1, 0, 1, 9), (1, 4, 0, 100_000)])
    empty = df.limit(0)
    assert sentence_ends(empty, "id", "ps", abbreviations(abbreviation_counts(empty, "ps"))).count() == 0
