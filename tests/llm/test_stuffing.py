import numpy as np
import pyarrow as pa
import pytest

from quillspark.llm import stuffing as S
from quillspark.llm.stuffing import judge_pages

SPAM = [
    "\n".join(f"https://a{i}.example/b/{i}" for i in range(9)), "\n".join(f"[标题{i}](http://x.test/{i})" for i in range(9)), "\n".join(f"第{i}章 → m.x-mp3.test/{i}" for i in range(9)), "#免费听书\n#有声书\n" * 6,
    " / ".join(f"棋盘{i} BOX-{i} ¥{i}.50 免费" for i in range(9)), "免费听书，百万书库，免费听书。百万书库，免费听书，百万书库。" * 5, "best narrators token, token chapter zip, token best narrators, chapter zip token, " * 4, "免 费 听 书 百 万 书 库\n百 万 书 库 免 费 听 书\n" * 6, "河口镇的铜铃药铺" * 20,
    "tags: a b, c d, e f, a b\n" * 8,
]
FINE = [
    "\n".join(f"第{i}章 {chr(0x4E00 + 7 * i)}{chr(0x5000 + 11 * i)}的{chr(0x6000 + 5 * i)} …… {i * 9}" for i in range(1, 20)), "\n".join(f"{chr(0x4E00 + 7 * i)}{chr(0x5000 + 11 * i)}, {i}, {i + 20}–{i + 24}" for i in range(1, 20)),
    "\n".join(f"{chr(0x4E00 + 7 * i)}某——{chr(0x6000 + 5 * i)}掌柜" for i in range(20)), "他走了很远，才望见村庄。她把灯放在桌上，轻轻叹了口气。\n雨下了一天。" * 3, "A long walk took us home. We saw the lamp, and nobody spoke.\n\nhttps://x.example/\nhttps://y.example/", "搜“免费听书”搜了半天，最后在书店找到了纸书。第一次听这种免费听书的版本，配乐太满。", "", "  \n ",
]


def judge(text):
    share, (_, code, _, chars, bad) = S.judge_batch(pa.array([text]))
    return share[0], [(S.shape_name(c), n, b) for c, n, b in zip(code.tolist(), chars.tolist(), bad.tolist(), strict=True)]


def test_pages_of_a_batch_do_not_touch():
    alone = [judge(t)[0] for t in SPAM + FINE]
    assert S.judge_batch(pa.array(SPAM + FINE))[0].tolist() == alone
    assert S.judge_batch(pa.array([], pa.string()))[0].tolist() == []


def test_the_shapes_decide():
    """With one shape for all units nothing is told apart any more."""
    one = S.judge_batch(pa.array(SPAM + FINE), lambda u: np.zeros(len(u.page), np.int64))[0] > S.SHARE
    assert one.tolist() != [True] * len(SPAM) + [False] * len(FINE)


def brute_repeated(texts, n):
    flat = "\n".join("".join(c for c in t.lower() if c.isalnum()) for t in texts)
    hit = set()
    for i in range(len(flat) - n + 1):
        g = flat[i : i + n]
        if "\n" not in g and sum(flat[j : j + n] == g for j in range(len(flat))) >= S.REPEATED:
            hit.update(range(i, i + n))
    return len(hit)


@pytest.mark.parametrize(("text", "n"), [("abcdef ghij\nabcdef, xyz\nAbcdef\nqrs tuv", 5), ("棋盘灯塔\n棋盘老街\n又见棋盘\n山水", 2), ("กขคงจฉช\nกขคงจ\nฉกขคง", 4)])
def test_repetition_against_brute_force(text, n):
    u = S.Units(pa.array([text, text]))
    got = np.bincount(u.page, S._repeated(u, np.ones(len(u.page), bool)))
    assert got.tolist() == [brute_repeated(text.split("\n"), n)] * 2


@pytest.mark.parametrize("text", SPAM)
def test_stuffed(text):
    assert judge(text)[0] > 0.5, judge(text)


@pytest.mark.parametrize("text", FINE)
def test_fine(text):
    assert judge(text)[0] <= 0.5, judge(text)


def test_operator(spark):
    df = spark.createDataFrame([(1, SPAM[0], 0.1), (1, SPAM[0], 0.1), (2, None, 0.1), (3, "走。" * 60_000, 0.1)], "id long, text string, share double")
    assert sorted((r.id, r.stuffed) for r in judge_pages(df, "id").collect()) == [(1, True), (1, True), (2, False), (3, False)]
    assert judge_pages(df.limit(0), "id").count() == 0
