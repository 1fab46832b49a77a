import numpy as np
import pyarrow as pa
import pytest

from quillspark.llm import encodings as X
from quillspark.llm.text import codepoints

CLEAN = {
    "zh": ["他们走了很远，才望见河边的村庄。", "信上只有一行字，老人看了三遍，折好，放在桌上。", "雨从早上一直下到晚上，街里空无一人。"],
    "ja": ["小さな木箱はどこ。もう行くよ。", "夕方、港町には誰もいなかった。", "ノートの値段は二百円に下がった。"],
    "ru": ["Билет стоил дорого, а компас и того дороже.", "Около полуночи она нашла старый фонарь на чердаке."],
    "de": ["Die Tür am Güterbahnhof kostete für ihn zu viel. Später schrieb Jörg über die Brücke.", "Am nächsten Morgen fand er den Schlüssel."],
    "en": ["The lantern lay at the café, two doors from the CHÂTEAU inn.", "Nobody asked about the ticket… not even Ðorvald Ãsberg."],
}


@pytest.fixture(scope="module")
def model():
    pairs, single = np.zeros(X.BUCKETS, np.int64), np.zeros(X.UNIGRAMS, np.int64)
    texts = [t for ts in CLEAN.values() for t in ts] * 300
    X.count(*codepoints(pa.array(texts)), pairs, single)
    return X.Model(pairs, single)


def best(text, model):
    rows = X.evidence_of([codepoints(pa.array([text]))[0].copy()], model)[0]
    return max(rows) if rows else (0, "", text)


@pytest.mark.parametrize(
    ("lang", "right", "wrong"),
    [("zh", "utf-8", "cp1252"), ("zh", "utf-8", "latin-1"), ("zh", "gbk", "latin-1"), ("zh", "gbk", "big5"), ("ja", "cp932", "latin-1"), ("ru", "utf-8", "cp1251"), ("ru", "koi8-r", "cp1251"), ("ru", "cp1251", "latin-1"), ("de", "utf-8", "cp1252"), ("de", "utf-8", "mac-roman")],
)
def test_round_trip(model, lang, right, wrong):
    back = X.decode_single(wrong) if wrong in X.SINGLE else None
    for t in CLEAN[lang]:
        raw = t.encode(right)
        bad = "".join(chr(back[b]) for b in raw) if back is not None else raw.decode(wrong, "replace")
        gain, chain, fixed = best(bad, model)
        assert gain > 9, (bad, gain)
        if "�" not in bad:
            assert fixed == t, (bad, chain, fixed)
        half = t + " " + bad
        if back is not None and right not in X.SINGLE:  # there a letter at the seam can be either
            assert best(half, model)[2] == t + " " + t


def test_twice_wrong(model):
    table = X.decode_single("cp1252")
    wrong = lambda s: "".join(chr(table[b]) for b in s.encode())
    for t in CLEAN["zh"]:
        assert best(wrong(wrong(t)), model)[2] == t


def test_many_places(model):
    wrong = lambda s: s.encode().decode("cp1251")
    ru = CLEAN["ru"]
    assert best(" ".join(f"{ru[k % 2]} {wrong('фонарь')}" for k in range(12)), model)[2] == " ".join(f"{ru[k % 2]} фонарь" for k in range(12))


def test_clean_texts_stay(model):
    odd = ["CHÂTEAU-BLEU", "SÃO-LIRA", "Ðorvald Ãsberg", "", "铜锟剑", "ｱ", "①②③", "​", "x" * 50_000]
    for t in [t for ts in CLEAN.values() for t in ts] + odd:
        assert best(t, model)[0] < 9, t


def test_lost_characters(model):
    assert best("caf�", model)[1] == "lost"


def test_operator(spark):
    table = X.decode_single("cp1252")
    wrong = lambda s: "".join(chr(table[b]) for b in s.encode())
    clean = [("p", "s", i, [t, None, ""]) for i, t in enumerate([t for ts in CLEAN.values() for t in ts] * 60)]
    bad = [("p", "s", 9000, ["x", wrong(CLEAN["zh"][0])]), ("p", None, 9001, [wrong(CLEAN["ru"][0])]), ("p", "s", 9002, None), ("t", "s", 9003, [wrong(CLEAN["de"][1])])]
    df = spark.createDataFrame([(*r, "extra") for r in clean + bad], "place string, source string, row_id long, texts array<string>, chain string")
    got = {(r.row_id, r.pos): r.repaired for r in X.repair(df).collect()}
    assert got == {(9000, 1): CLEAN["zh"][0], (9001, 0): CLEAN["ru"][0], (9003, 0): CLEAN["de"][1]}
    assert X.repair(df.limit(0)).count() == 0


def test_prior_pools_weak_evidence(spark):
    strong = [("p", "a", i, 0, [("utf-8>cp1252", 40.0, "r")]) for i in range(50)]
    weak = [("p", s, 900, 0, [("utf-8>cp1252", 6.5, "r"), ("gbk>big5", 1.0, "q")]) for s in ("a", "b")]
    found = spark.createDataFrame(strong + weak, f"place string, source string, row_id long, pos int, {X.EVIDENCE}")
    totals = spark.createDataFrame([("p", "a", 100), ("p", "b", 100_000)], "place string, source string, n long")
    post = {(r.source, r.row_id): sum(r.posterior) for r in X.posterior(found, totals).collect()}
    assert post["a", 900] > 0.9 > 0.5 > post["b", 900]
    # pools given beside the texts
    assert X.posterior(found.limit(0), totals.limit(0)).count() == 0


def test_lost_characters_can_be_overruled(spark):
    """In a source where every text holds one they are evidence as before; what EM pools is not fixed."""
    rows = [("p", "a", i, 0, [(X.UNKNOWN, X.LOST_GAIN, "r")]) for i in range(3)]
    found = spark.createDataFrame(rows, f"place string, source string, row_id long, pos int, {X.EVIDENCE}")
    few = {sum(r.posterior) > 0.99 for r in X.posterior(found, spark.createDataFrame([("p", "a", 3)], "place string, source string, n long")).collect()}
    many = {sum(r.posterior) > 0.99 for r in X.posterior(found, spark.createDataFrame([("p", "a", 10**9)], "place string, source string, n long")).collect()}
    assert few == {True} and many == {False}


@pytest.mark.parametrize("places", [1, 2, 3, 8, 12])
def test_stretches_between_clean_ones(model, places):
    """Clean sentences between damaged ones stay as they are, whatever the wrong encoding can hold."""
    table = X.decode_single("cp1252")
    wrong = lambda s: "".join(chr(table[b]) for b in s.encode())
    a, b, c = CLEAN["zh"]
    clean = " ".join(f"{a}{b}{c}" for _ in range(places))
    bad = " ".join(f"{a}{wrong(b)}{c}" for _ in range(places))
    assert best(bad, model)[2] == clean


def test_nothing_is_lost_by_repair(model):
    table = X.decode_single("cp1252")
    wrong = lambda s: "".join(chr(table[b]) for b in s.encode())
    a, b, _ = CLEAN["zh"]
    cut = wrong(a)[:-2] + b  # two bytes are missing: what they belonged to stays as it stands
    fixed = best(cut, model)[2]
    assert "�" not in fixed and fixed.startswith(a[:-1]) and fixed.endswith(b)
    gap = wrong(a[:5]) + "�" + wrong(a[6:]) + b  # a whole character lost
    assert best(gap, model)[2] == a[:5] + "�" + a[6:] + b


def test_sizes_byte_by_byte():
    for right in X.DOUBLE:
        text = "".join(chr(c) for c in (*range(0x20, 0x7F), *range(0x3041, 0x3090), *range(0x4E00, 0x5200)) if X.encoder(right)[0][c])
        raw = text.encode(right) + b"\xff" + text.encode(right)[:-1] + b"\x81"
        exact = X._sizes_exactly(raw, right)
        out = np.frombuffer(raw.decode(right, "surrogateescape").encode("utf-32-le", "surrogatepass"), "<u4")
        assert len(exact) == len(out) and exact.sum() == len(raw)
        assert (exact == X._sizes(out.copy(), right)).mean() > 0.99


def test_private_characters():
    """Bytes of GBK's free rows, read as private characters."""
    size, one, two = X.encoder("gbk")
    for cp, raw in ((0xE000, b"\xaa\xa1"), (0xE233, b"\xaf\xfe"), (0xE234, b"\xf8\xa1"), (0xE4C5, b"\xfe\xfe"), (0xE4C6, b"\xa1\x40"), (0xE765, b"\xa7\xa0")):
        assert size[cp] == 2 and bytes([one[cp], two[cp]]) == raw
    assert size[0xE766] == 0


def test_stretches_against_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(200):
        gain = np.concatenate([[0], np.cumsum(rng.normal(0, 3, 9))]).tolist()
        got = sum(gain[b] - gain[a] - 2 for a, b in X.stretches(gain, 2))
        cash, hold = 0.0, -1e9
        for g in gain:
            cash, hold = max(cash, hold + g), max(hold, cash - g - 2)
        assert got == pytest.approx(cash)


def test_any_number_of_chains(model):
    """Every chain with evidence is kept."""
    texts = [codepoints(pa.array([t]))[0].copy() for t in ("雨Ð¾ÐºÐ¾Ð»Ð¾", "Ðºîìïàñ òîãî äîðîæå", "ÐŸÐ¾Ð´")]
    assert max(len(f) for f in X.explain(texts, model)) > 3


def test_model_in_two_levels(spark, monkeypatch):
    df = spark.createDataFrame([(i, [t]) for i, t in enumerate([t for ts in CLEAN.values() for t in ts] * 9)], "i int, texts array<string>").repartition(7)
    one = X.corpus_model(df)
    monkeypatch.setattr(X, "FAN", 2)
    two = X.corpus_model(df)
    assert (one.pairs == two.pairs).all() and (one.single == two.single).all() and one.single.sum() > 0


def test_short_texts(spark):
    wrong = lambda s, right, read: s.encode(right).decode(read)
    # 渡口 read as gbk has three characters, as big5 two
    titles = ["西河沿", "上河沿", "渡口", "账本", "———", "雨"]
    clean = [("t", "s", i, [t]) for i, t in enumerate([*titles, *(t for ts in CLEAN.values() for t in ts)] * 40)]
    long = [("t", "s", 8000 + i, [wrong(t, "gbk", "big5")]) for i, t in enumerate(["他们走了很远", "才望见河边的村庄", "信上只有一行字"] * 4)]
    bad = {9000: wrong("西河沿", "gbk", "big5"), 9001: wrong("上河沿", "gbk", "big5"), 9002: "〞〞〞", 9003: wrong("渡口", "utf-8", "gbk"), 9004: wrong("渡口", "gbk", "big5")}
    assert [len(t) for t in bad.values()] == [3, 3, 3, 3, 2]
    df = spark.createDataFrame([*clean, *long, *(("t", "s", i, [t]) for i, t in bad.items())], "place string, source string, row_id long, texts array<string>")
    model = X.corpus_model(df.where("row_id < 8000"))  # in so small a corpus three signs would teach it
    got = {r.row_id: r.repaired for r in X.repair(df, model).collect() if not 8000 <= r.row_id < 9000}
    assert got == {9000: "西河沿", 9001: "上河沿", 9002: "———", 9003: "渡口", 9004: "渡口"}


def test_a_short_text_leaves_its_neighbours(model):
    texts = [codepoints(pa.array([t]))[0].copy() for t in ("昹碩朓", "雨从早上", "昹碩", CLEAN["zh"][0])]
    for cps, starts in (X._marked(texts), codepoints(pa.array(["昹碩朓", "雨从早上", "昹碩", CLEAN["zh"][0]]))):
        odd, row = X.strange(cps, starts, model)
        assert set(row[odd]) == {0, 2}
