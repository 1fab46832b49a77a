import random
import unicodedata

import pyarrow as pa
from pyspark.sql import functions as F

from quillspark.llm import lookalike as L


def forms(*texts):
    return L.fold_texts(pa.array(texts, pa.string())).to_pylist()


def test_same_look():
    groups = [
        ("Thaïs Crève", "Tｈａïｓ Сrèvｅ", "Thaïs Crève", "﻿Thaïs​ Crève", "Thaïs Crève"), ("ガラス", "ｶﾞﾗｽ", "ガラス"), ("比起没人", "⽐起没⼈"), ("한국", "한국"),
        ("ё", "ё", "ë"), ("ế", "ế", "ế"), ("入口", "入ロ"), ("क़", "क़"), ("a b", "a　b", "a b"), ("x", "　　x "),
    ]
    for g in groups:
        assert len(set(forms(*g))) == 1, (g, forms(*g))


def test_other_look():
    pairs = [("a", "A"), ("e", "é"), ("x2", "x²"), ("1", "①"), ("カ", "ガ"), ("ab", "a b"), ("—", "-"), ("か", "が"), ("", None)]
    for a, b in pairs:
        assert forms(a)[0] != forms(b)[0], (a, b)


def test_composition_is_that_of_unicode():
    rng = random.Random(2)
    pool = [*range(0xC0, 0x250), *range(0x300, 0x330), *range(0x1E00, 0x1EFF), *range(0x904, 0x94D), *range(0x3042, 0x3090), *range(0xAC00, 0xAC80), *range(0x1100, 0x1113), *range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]
    plain = [c for c in pool if L._tables().fold[c] == c and c not in (0x131, 0x34F)]
    texts = ["x" + "".join(chr(rng.choice(plain)) for _ in range(10)) for _ in range(400)]
    got = forms(*texts)
    assert got == forms(*[unicodedata.normalize("NFC", t) for t in texts]) == forms(*[unicodedata.normalize("NFD", t) for t in texts])
    assert sum(a == unicodedata.normalize("NFC", t) for a, t in zip(got, texts, strict=True)) > 300


def test_long_stacks_of_marks():
    rng = random.Random(3)
    marks = [c for c in range(0x300, 0x370) if L._tables().fold[c] == c and c != 0x34F]
    texts = ["x" + "".join(rng.choice("aeouAE") + "".join(chr(rng.choice(marks)) for _ in range(rng.randint(5, 40))) for _ in range(3)) for _ in range(200)]
    # one mark far from its base, behind marks of lower classes
    texts += ["xa" + "\u0327\u0328\u031b\u0323\u0324\u0325\u0330\u0331"[:k] + "\u0301" for k in range(9)]
    assert forms(*texts) == [unicodedata.normalize("NFC", t) for t in texts]


def brute_pairs(rows):
    out = set()
    for i, (g, c, p, t) in enumerate(rows):
        for g2, c2, p2, t2 in rows[:i]:
            if g == g2 and (p < 0) == (p2 < 0) and t and t2 and t != t2 and forms(t)[0] == forms(t2)[0] and forms(t)[0]:
                out.add((g, *sorted([(c, p), (c2, p2)])))
    return out


def test_pairs_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK", 3)
    rng = random.Random(5)
    words = ["abc", "ａbc", "аbc", "a​bc", "口", "ロ", "x", "", None]
    chapters = [(c, rng.choice(["b1", "b2", None]), [rng.choice(words) for _ in range(rng.randint(0, 4))], "extra") for c in range(40)]
    df = spark.createDataFrame(chapters, "chapter long, book string, texts array<string>, form string")
    keyed = L.form_keys(df, ["book", "chapter"]).withColumn("kind", F.lit("p"))
    got = L.equal_looking_pairs(keyed, ["book", "kind"], ["chapter", "pos"]).collect()
    flat = [(b, c, p, t) for c, b, ts, _ in chapters for p, t in enumerate(ts)]
    assert sorted((r.book or "", (r.chapter_a, r.pos_a), (r.chapter_b, r.pos_b)) for r in got) == sorted((g or "", a, b) for g, a, b in brute_pairs(flat))

    # the same by class
    links = {}
    for g, a, b in brute_pairs(flat):
        for x in (a, b):
            links[g, x] = links.get((g, x), 0) + 1
    rows = L.classes(L.alike(keyed, ["book", "kind"]), ["book", "kind"], ["chapter", "pos"]).collect()
    assert {(r.book, (r.chapter, r.pos)): r.n_links for r in rows} == links and len(rows) == len(links)
    assert all((r.first.chapter, r.first.pos) <= (r.chapter, r.pos) for r in rows)


def test_columns(spark):
    df = spark.createDataFrame([(1, ["ａ", None], "ｂ" * 200_000), (2, None, None), (2, [], "")], "id int, l array<string>, s string")
    got = {(r.id, tuple(r.form) if r.form is not None else None) for r in L.fold_column(df, ["id"], "l").collect()}
    assert (2, None) in got and (2, ()) in got
    texts = {r.form for r in L.fold_column(df, ["id"], "s").collect()}
    assert texts == {"b" * 200_000, None, ""}
    empty = spark.createDataFrame([], "id int, l array<string>, s string")
    assert L.fold_column(empty, ["id"], "l").count() == 0 and L.form_keys(empty, ["id"], "l").count() == 0
