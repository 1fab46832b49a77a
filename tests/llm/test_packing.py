import collections
import random

import numpy as np
import pytest

from quillspark.llm import packing
from quillspark.llm.mixing import mix, plan_mixes, schedule
from quillspark.llm.packing import combinations, layout, pack, plan, solve_counts
from quillspark.llm.tokens import TOKENIZER, token_sizes


@pytest.mark.parametrize("capacity", [1, 7, 64, 512])
def test_plan_uses_every_item_once_and_fits(capacity):
    rng = random.Random(capacity)
    counts = {s: rng.randint(1, 400) for s in {min(capacity, int(rng.lognormvariate(3, 1)) + 1) for _ in range(200)}}
    patterns = plan(counts, capacity)
    used = collections.Counter()
    for pattern, n in patterns:
        assert sum(s * t for s, t in pattern) <= capacity
        for s, t in pattern:
            used[s] += t * n
    assert used == counts
    packs = sum(n for _, n in patterns)
    assert capacity < 64 or packs <= 1.05 * -(-sum(s * n for s, n in counts.items()) // capacity) + 1
    assert layout(patterns).containers == packs
    assert plan({}, 5) == []


def test_pack(spark):
    rng = random.Random(1)
    sizes = [rng.randint(0, 90) for _ in range(500)] + [64] * 300 + [1000, None]
    df = spark.createDataFrame([(i, s, "x") for i, s in enumerate(sizes)] + [(0, sizes[0], "x")], "doc_id long, tokens long, pack_no string")
    rows = pack(df, [("a", 64), ("b", 128)]).collect()
    for name, cap in (("a", 64), ("b", 128)):
        own = [r for r in rows if r.pack_id == name]
        fill = collections.Counter()
        for r in own:
            fill[r.pack_no] += r.tokens
        assert max(fill.values()) <= cap
        whole = collections.Counter()
        for r in own:
            whole[r.doc_id] += r.tokens
            assert r.tokens <= cap and (r.piece_no == 0 or sizes[r.doc_id] > cap)
        assert all(whole[i] == (s or 0) * (2 if i == 0 else 1) for i, s in enumerate(sizes))
        assert set(whole) == set(range(len(sizes)))
    assert pack(df.limit(0), [("a", 64)]).count() == 0


def test_many_kinds_of_containers(spark, monkeypatch):
    """1,001 kinds are packed, also in several batches; from a table with nulls, repeats and what holds nothing."""
    df = spark.createDataFrame([(i, s) for i, s in enumerate([5, 9, 30, 0])], "doc_id long, tokens long")
    kinds = spark.createDataFrame([(f"k{i}", 4 + i % 40) for i in range(1001)] + [("k0", 4), ("none", None), ("zero", 0), (None, 7)], "pack_id string, capacity_tokens int")
    want = {f"k{i}" for i in range(1001)} | {None}
    monkeypatch.setattr(packing, "ENTRIES", 12_000)
    rows = pack(df, kinds).collect()
    assert {r.pack_id for r in rows} == want
    whole = collections.Counter()
    for r in rows:
        whole[r.pack_id, r.doc_id] += r.tokens
    assert all(whole[k, i] == s for k in want for i, s in enumerate([5, 9, 30, 0]))


def test_full_pieces_have_containers_of_their_own(spark, monkeypatch):
    """Most pieces fill a container; they are numbered without gaps, in as many groups as wanted."""
    monkeypatch.setattr(packing, "ROWS", 10)
    sizes = [1000 + i % 7 for i in range(300)] + [8] * 100
    df = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, tokens long")
    rows = pack(df, [("a", 8)]).collect()
    fill = collections.Counter()
    for r in rows:
        fill[r.pack_no] += r.tokens
    assert max(fill.values()) == 8 and sum(fill.values()) == sum(sizes)
    full = sorted(r.pack_no for r in rows if r.tokens == 8)
    assert len(set(full)) == len(full) and sorted(fill) == list(range(max(fill) + 1))


def test_least_squares_residual(monkeypatch):
    """Sizes that can fill containers are used up but for a small residual, which more rounds hardly lower."""
    rng = random.Random(4)
    counts = collections.Counter(min(128, int(rng.lognormvariate(3, 0.8)) + 1) for _ in range(20_000))
    sizes, n = np.array(sorted(counts)), np.array([counts[s] for s in sorted(counts)])
    which, times = combinations(sizes, n, 256)

    def residual():
        x = solve_counts(which, times, n)
        assert (x >= 0).all()
        return np.linalg.norm(np.bincount(which.ravel(), (times * x[:, None]).ravel(), len(n)) - n) / np.linalg.norm(n)

    settled = residual()
    monkeypatch.setattr(packing, "SETTLED", 0.0)
    assert settled < 0.02 and residual() > settled - 0.01


def test_tokens(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=TOKENIZER)
    texts = ["你好。世界！", "", None, "x y z " * 30_000]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "id long, text string, tokens int")
    assert {r.id: r.tokens for r in token_sizes(df, ["id"]).collect()} == {i: len(sp.encode(t or "")) for i, t in enumerate(texts)}


def test_schedule_is_even(spark, monkeypatch):
    from quillspark.llm import mixing

    monkeypatch.setattr(mixing, "CHUNK", 64)
    mixes = spark.createDataFrame([(1, 1000, [(0.5, "a"), (0.8, "b"), (1.0, "c")])], "mix_id int, n_slots long, edges array<struct<upper:double,source:string>>")
    rows = schedule(mixes).collect()
    assert sorted(r.slot for r in rows) == list(range(1000))
    for s, w in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        own = sorted((r.slot, r.k) for r in rows if r.source == s)
        assert [k for _, k in own] == list(range(len(own)))
        seen = np.cumsum(np.isin(np.arange(1000), [slot for slot, _ in own]))
        assert np.abs(seen - w * np.arange(1, 1001)).max() < 4


def test_plan_mixes(spark):
    """A small source is repeated up to its cap, the others keep their parts, and the shortfall is told."""
    targets = spark.createDataFrame([(1, "a", 1.0, 2), (1, "b", 1.0, None), (1, "none", 1.0, 1), (1, "zero", 0.0, 1)], "mix_id int, source string, weight double, max_repeats int")
    tokens = spark.createDataFrame([("a", 1000), ("b", 1_000_000), ("zero", 5)], "source string, whole long")
    got = {r.source: r for r in plan_mixes(targets, tokens).collect()}
    assert set(got) == {"a", "b"} and got["a"].give == 2000 and got["a"].times == 2 and got["b"].give == got["b"].asked == got["a"].asked == 500_500
    kept = {r.source: r.give for r in plan_mixes(targets, tokens, keep_weights=True).collect()}
    assert kept == {"a": 2000, "b": 2000}


def test_mix(spark):
    rng = random.Random(2)
    docs = [(i, s, rng.randint(50, 150)) for s, n in (("big", 3000), ("small", 100), ("free", 20)) for i in range(n)]
    docs = [(k, s, t, 0) for k, (_, s, t) in enumerate(docs)] + [(90_000, None, 5, 0), (90_001, "other", 5, 0), (90_002, "big", None, 0), (90_003, "big", 0, 0)]
    df = spark.createDataFrame(docs, "doc_id long, source string, tokens long, slot int")
    targets = spark.createDataFrame([(1, "big", 0.6, 1), (1, "small", 0.2, 3), (1, "free", 0.2, None), (2, "big", None, 1), (2, "gone", 1.0, 1)], "mix_id int, source string, weight double, max_repeats int")
    draws, shares = mix(df, targets, keep_weights=True, block=1000)
    rows = draws.collect()
    uses = collections.Counter((r.mix_id, r.source, r.doc_id) for r in rows)
    assert max(n for (m, s, _), n in uses.items() if s == "small") <= 3 and max(n for (m, s, _), n in uses.items() if s == "big") == 1
    assert len({(r.mix_id, r.doc_id, r.repeat_no) for r in rows}) == len(rows)
    got = {(r.mix_id, r.source): r for r in shares.collect()}
    for s, w in (("big", 0.6), ("small", 0.2), ("free", 0.2)):
        assert abs(got[1, s].share - w) < 0.01
    assert got[2, "gone"].tokens == 0 and got[2, "big"].n_draws == 0
    most = {r.source: r for r in mix(df, targets)[1].collect() if r.mix_id == 1}
    assert most["small"].n_draws == 300 and most["small"].shortfall > 0 == most["big"].shortfall and most["small"].share < 0.2 < most["free"].share
    slots = sorted({(r.slot, r.source) for r in rows if r.mix_id == 1})
    assert len(slots) == len({s for s, _ in slots})  # a slot has one source
    empty, none = mix(df.limit(0), targets)
    assert empty.count() == 0 and none.count() == 5


def test_mix_with_a_total(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], 10) for i in range(200)], "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([(1, "a", 1.0, 1), (1, "b", 3.0, 1)], "mix_id int, source string, weight double, max_repeats int")
    got = {r.source: r.tokens for r in mix(df, targets, total=2000)[1].collect()}
    assert got["b"] == 1000 and abs(got["a"] - 500) <= 10
