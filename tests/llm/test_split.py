import random
import re

from quillspark.llm.split import _CLUSTER, LEVELS, parts, pieces, split_oversized

SCHEMA = "id long, text string, limit int, overlap int, piece string, _text int"


def check(text, limit, overlap):
    got = list(pieces(text, limit, overlap))
    o = min(max(0, overlap), limit - 1)
    assert got[0][0] == 0 and got[-1][1] == len(text)
    assert all(b - a <= limit for a, b in got)
    assert all(b - o == c for (_, b), (c, _) in zip(got, got[1:], strict=False))
    return [text[a:b] for a, b in got]


def test_boundaries():
    assert check("一二三。四五六。七八九。", 8, 0) == ["一二三。四五六。", "七八九。"]
    assert check("他说：“走。快走。”然后离开了这里。", 10, 0)[0] == "他说：“走。快走。”"
    assert check("aa bb cc dd", 6, 0) == ["aa bb ", "cc dd"]
    assert check("One two. Three four. Five six.", 22, 4)[0] == "One two. Three four. "
    assert check("x\n\ny z y z y z", 9, 0)[0] == "x\n\ny z y "
    assert check("甲" * 25, 10, 3)[0] == "甲" * 10


def brute(text, limit, overlap):
    """Splits by recursion over strings and packs the parts one by one."""
    limit = max(1, limit)
    overlap = min(max(0, overlap), limit - 1)
    if len(text) <= limit:
        return [(0, len(text))]

    def split(t, level):
        if len(t) <= limit - overlap:
            return [t]
        if level == len(LEVELS):
            out = []
            for c in re.findall(_CLUSTER, t):
                out += [c[i : i + limit - overlap] for i in range(0, len(c), limit - overlap)]
            return out
        ends = [m.end() for m in LEVELS[level].finditer(t)] if level > 1 or "\n" in t else []
        cuts = sorted({0, len(t), *ends})
        return [x for a, b in zip(cuts, cuts[1:], strict=False) for x in split(t[a:b], level + 1)]

    out, start, at = [], 0, 0
    for part in split(text, 0):
        if at + len(part) - start > limit:
            out.append((start, at))
            start = at - overlap
        at += len(part)
    return [*out, (start, len(text))]


def test_against_recursion_over_strings():
    rng = random.Random(8)
    for _ in range(300):
        text = "".join(rng.choice(["ab", " ", "。", "，", "甲", "x", "\n", "\n\n", "\u0301", "!"]) for _ in range(rng.randint(1, 200)))
        limit, overlap = rng.randint(2, 40), rng.randint(0, 20)
        got = list(pieces(text, limit, overlap))
        if not re.search(r"\w\w\w[.!?]|\s\n|\n\s", text):  # there what stands outside a part is seen by the pattern
            assert got == brute(text, limit, overlap), (text, limit, overlap)


def test_every_piece_is_packed_full():
    """The next part wouldn't have fitted into any piece."""
    text = "".join(f"第{i}句话说了一些事情，又说了另一些。" for i in range(500))
    got = list(pieces(text, 100, 10))
    ends = list(parts(text, 0, len(text), 90))
    for (a, b), _ in zip(got, got[1:], strict=False):
        assert ends[ends.index(b) + 1] - a > 100


def test_marks_stay_with_their_letter():
    text = "é" * 20
    assert all(not p.startswith("́") for p in check(text, 7, 0))


def test_random_texts():
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice("ab 。，.\n甲́") for _ in range(rng.randint(1, 300)))
        check(text, rng.randint(1, 40), rng.randint(-2, 50))


def test_operator(spark):
    long = "甲。" * 50_000
    rows = [(1, long, 160, 16, "p", 0), (1, long, 160, 16, "p", 0), (2, "short", 160, 16, "p", 0), (3, None, 5, 1, "p", 0), (4, "abcdef", None, 1, "p", 0), (5, "abcdef", 3, None, "p", 0), (6, "", 3, 1, "p", 0), (7, "abc", 0, 5, "p", 0)]
    out = split_oversized(spark.createDataFrame(rows, SCHEMA), ["id"]).collect()
    assert {r.id for r in out} == {1, 5, 7}
    assert len([r for r in out if r.id == 1 and r.piece_no == 0]) == 2  # repeated rows are cut each
    assert [r.piece for r in out if r.id == 5] == ["abc", "def"] and [r.piece for r in out if r.id == 7] == ["a", "b", "c"]
    assert split_oversized(spark.createDataFrame([], SCHEMA), ["id"]).count() == 0
