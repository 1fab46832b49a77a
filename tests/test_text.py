import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from quillspark.functions import numerals, text, titles
from quillspark.functions.register import register

NUMBERS = {
    "50%": "百分之五十", "3.14": "三点一四", "2024年": "二零二四年", "0": "零", "10": "十", "11": "十一", "20": "二十", "105": "一百零五", "1005": "一千零五", "10000": "一万", "10001": "一万零一", "12345": "一万二千三百四十五",
    "007": "七", "0.05": "零点零五", "12.5%": "十二点五%", "1,234": "一,二百三十四", "3.": "三.", "1.2.3": "一点二.三", "152.143.123.131": "一百五十二点一四三.一百二十三点一三一", "2024": "二千零二十四", "12024年": "一万二千零二十四年",
    "1010": "一千零一十", "10010": "一万零十", "110000": "十一万", "100000001": "一亿零一", "100001000": "一亿一千", "1000000000000": "一兆", "1" + "0" * 16: "一" + "零" * 16, "": "",
}


def column(spark, values, use):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r[0] for r in df.orderBy("i").select(use(F.col("s"))).collect()]


def test_numbers(spark):
    assert column(spark, NUMBERS, numerals.convert_numbers) == list(NUMBERS.values())


def read_back(said):
    """The number that a numeral names."""
    figures, units = {c: i for i, c in enumerate("零一二三四五六七八九")}, {"十": 10, "百": 100, "千": 1000}
    total = group = figure = 0
    for c in said:
        if c in units:
            group, figure = group + (figure or 1) * units[c], 0
        elif c in "万亿兆":
            total, group, figure = total + (group + figure) * {"万": 10**4, "亿": 10**8, "兆": 10**12}[c], 0, 0
        else:
            figure = figures[c]
    return total + group + figure


def test_numerals_name_their_number(spark):
    rng = random.Random(1)
    values = ["".join(rng.choice("00012345") for _ in range(rng.randint(1, 18))) for _ in range(300)]
    for v, said in zip(values, column(spark, values, numerals.number_to_zh), strict=True):
        plain = v.lstrip("0")
        if len(plain) > 16:
            assert said == plain.translate(str.maketrans("0123456789", "零一二三四五六七八九"))
        else:
            assert read_back(said) == int(v), (v, said)
            # a gap within is said once, and none at the end
            assert "零零" not in said and (said == "零" or not said.endswith("零")) and not said.startswith("一十")
            inner = "0" in plain.rstrip("0") and any(g != "0000" and ("0" in g.strip("0") or (k and g[0] == "0")) for k, g in enumerate(plain.zfill(16)[i : i + 4] for i in range(0, 16, 4)) if int(plain.zfill(16)[: 4 * k] or 0) or k == 0 or "0" in g.strip("0"))
            assert not inner or "零" in said, (v, said)


def test_normalisation(spark):
    assert column(spark, ["  你好 \n 世界\t", "　a  b ", None], text.normalize_whitespace) == ["你好 世界", "a b", None]
    assert column(spark, ["２０２４年！，：", "12:30"], numerals.normalize_for_speech) == ["二零二四年！,：", "十二：三十"]
    assert column(spark, ["ｶﾞ①", "abc", None], text.nfkc) == [unicodedata.normalize("NFKC", "ｶﾞ①"), "abc", None]


def test_sentences(spark):
    got = column(spark, ["你好。世界！再见？", "He paid 3.50. Then left…", "「走。」他说。", "  ", "no end"], text.split_sentences)
    assert got == [["你好。", "世界！", "再见？"], ["He paid 3.50.", "Then left…"], ["「走。」", "他说。"], [""], ["no end"]]


def test_soft_break(spark):
    assert column(spark, ["a，b、c", "abc", "a\n,b"], text.last_soft_break) == [4, None, 3]


def brute_pieces(s, n=160):
    out, current = [], ""
    for c in s:
        current += c
        if len(current) == n:
            at = max((i + 1 for i, x in enumerate(current) if x in "，,、；;：:"), default=None)
            out.append((at, current[: at or n]))
            current = current[at or n :]
    return out + ([(None, current)] if current else [])


def test_soft_breaks_of_whole_texts(spark, tmp_path):
    from quillspark.plans import texts

    rng = random.Random(2)
    docs = ["", "a,b", "x" * 159 + ",", "x" * 160 + ",", "x" * 159 + ",\n", "y" * 1000, "，" * 500, "𝒳" * 200 + "：" + "é" * 300]
    docs += ["".join(rng.choice("字a \n𝒳" * 8 + ",，:；" * (k % 3)) for _ in range(rng.randint(1, 3000))) for k in range(40)]
    docs.append("".join(rng.choice("字a，" + "b" * 200) for _ in range(50_000)))
    df = spark.createDataFrame([*enumerate(docs), (len(docs), None)], "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id, r.no, r.position, r.piece) for r in texts.QUERIES["soft_break_pieces"](spark, str(tmp_path)).collect())
    assert got == [(i, k, at, piece) for i, d in enumerate(docs) for k, (at, piece) in enumerate(brute_pieces(d))]
    for r in texts.soft_breaks(spark, str(tmp_path)).collect():
        if r.doc_id < len(docs):
            at = max((i + 1 for i, c in enumerate(docs[r.doc_id]) if c in "，,、；;：:"), default=None)
            assert (r.position, r.before, r.after) == (at, docs[r.doc_id][:at], docs[r.doc_id][at:] if at else "")


def test_titles(spark):
    rows = [("Intro", "id5", ["x"]), ("UNKNOWN", "id5", ["x"]), ("未知", "chapter", ["。你好，世界："]), ("", None, []), (" Untitled ", " ", ["  "]), (None, None, None)]
    df = spark.createDataFrame(rows, "t string, i string, p array<string>")
    got = [r[0] for r in df.select(titles.choose_title(F.col("t"), F.col("i"), F.col("p"))).collect()]
    assert got == ["Intro", "id5", "你好，世界", "Chapter", "Chapter", "Chapter"]


def test_names(spark):
    df = spark.createDataFrame([("test", "x.epub"), (" ", "d/a.b.epub"), ("章:1/2", "x"), (None, ".epub")], "t string, s string")
    assert [r[0] for r in df.select(titles.safe_book_id(F.col("t"), F.col("s"))).collect()] == ["test", "a_b", "章_1_2", "_epub"]
    assert column(spark, ["章:1/2", "..", "Cover"], lambda c: titles.wav_path("o", F.lit(1), c)) == ["o/001_章_1_2.wav", "o/001_chapter.wav", "o/001_Cover.wav"]


def test_sql_functions(spark):
    register(spark)
    assert spark.sql("SELECT quill_widen('a!'), quill_tone_samples(2, 10000), quill_book_id('a b', 'x'), quill_book_id(' ', 'd/a.b.epub'), quill_wav_path('o', 1, '章:1/2')").first() == ("a！", 400, "a_b", "a_b", "o/001_章_1_2.wav")


@pytest.mark.parametrize(("spec", "total", "cores", "want"), [("8", 3, 4, 3), ("2", 3, 1, 2), ("8", 0, 4, 1), ("auto", 3, 8, 3), ("auto", 0, 8, 1)])
def test_jobs(spec, total, cores, want):
    from quillspark.functions.audio import resolve_jobs

    assert resolve_jobs(spec, total, cores) == want
    for bad in ("0", "x", "-1"):
        with pytest.raises(ValueError):
            resolve_jobs(bad, total, cores)
