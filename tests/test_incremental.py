import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from quillspark.operators.incremental import CommitStore, Window, plan_run, process_new

T = dt.datetime(2024, 1, 1)
CHAPTERS = "chapter_id long, book_id string, spine_index int, paragraphs array<string>, loaded_at timestamp, extra string"
ENTRIES = "entry_id long, book_id string, spine_index int, title string, text_hash string, output string, status string, run_id int, written_at timestamp"
RUNS = "run_id int, outcome string"


def sha(*p):
    return hashlib.sha256("\n".join(p).encode()).hexdigest()


def test_process_new_survives_failures(spark, tmp_path):
    store = CommitStore(spark, f"file://{tmp_path}/s")
    rows = lambda a, b: spark.createDataFrame([(i, f"v{i}") for i in range(a, b)] + [(None, "x")], "seq long, v string")
    process_new(rows(0, 5), "seq", store, lambda d: d)

    def fail(d):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        process_new(rows(0, 8), "seq", store, fail)
    (tmp_path / "s/data/half").mkdir()  # what a dead run leaves behind
    process_new(rows(0, 8), "seq", store, lambda d: d)
    process_new(rows(0, 8), "seq", store, lambda d: d)
    assert sorted(r.seq for r in store.read("out").collect()) == list(range(8))
    assert [c.high for c in store.commits()] == [4, 7, 7]
    assert store.vacuum() == [] and store.vacuum(-5) == ["half"] and store.vacuum(-5) == []
    assert sorted(r.seq for r in store.read("out").collect()) == list(range(8))


def test_two_runs_cannot_commit_the_same_window(spark, tmp_path):
    store = CommitStore(spark, f"file://{tmp_path}/s")
    df = spark.range(1)
    window = store.window(5)
    store.commit(window, {"out": df})
    with pytest.raises(RuntimeError):
        store.commit(window, {"out": df})


def test_empty_source(spark, tmp_path):
    store = CommitStore(spark, f"file://{tmp_path}/s")
    commit = process_new(spark.createDataFrame([], "seq long"), "seq", store, lambda d: d)
    assert commit.high is None and store.read("out").count() == 0
    assert spark.range(3).where(Window(None, None).holds(F.col("id"))).count() == 0


def test_pending(spark, tmp_path):
    ch = [
        (1, "a", 0, ["x"], T, "e"), (2, "a", 0, ["y"], T, "e"),  # same time: the greater id is current
        (3, "a", 1, ["x"], T, "e"), (4, "a", 2, [], None, "e"), (5, "b", 0, None, T, "e"), (6, "c", 0, ["n"], T, "e"), (6, "c", 0, ["n"], T, "e"), (7, None, None, ["z"], T, "e"),
    ]
    en = [
        (1, "a", 0, "t", sha("y").upper(), "o", "done", 1, T), (2, "a", 1, "t", sha("x"), "", "done", 1, T), (3, "a", 2, "t", sha(), "o", "done", 1, T), (4, "b", 0, "t", sha(), "o", "done", 1, T),
        (5, "b", 0, "t", sha(), None, "error", 2, T), (6, "c", 0, "t", sha("n"), "o", "done", 9, T), (7, "gone", 0, "t", "h", "o", "done", 1, T),
    ]
    runs = spark.createDataFrame([(1, "ok"), (2, "failed"), (9, None)], RUNS)
    chapters, entries = spark.createDataFrame(ch, CHAPTERS), spark.createDataFrame(en, ENTRIES)
    store = CommitStore(spark, f"file://{tmp_path}/s")
    first = plan_run(chapters, entries, runs, store)
    got = lambda c: {(r.book_id, r.spine_index) for r in store.output(c, "pending").collect()}
    assert got(first) == {("a", 1), ("c", 0), (None, None)}
    # a run that was open closes later: it is carried although its number lies below the watermark
    closed = spark.createDataFrame([(1, "ok"), (2, "failed"), (9, "ok")], RUNS)
    assert [r.run_id for r in store.output(first, "open").collect()] == [9]
    second = plan_run(chapters, entries, closed, store)
    assert got(second) == {("a", 1), (None, None)} and store.output(second, "open").count() == 0


def unread(chapters):
    """The chapters with texts that can't be read."""
    return chapters.withColumn("paragraphs", F.raise_error(F.lit("read a text")).cast("array<string>"))


def test_a_text_is_read_once(spark, tmp_path):
    """A run over an unchanged corpus touches no text, and one over a grown corpus only the new rows."""
    chapters = spark.createDataFrame([(i, "b", i % 4, [f"t{i}"], T, "e") for i in range(8)], CHAPTERS)
    entries = spark.createDataFrame([(i, "b", i, "t", sha(f"t{4 + i}"), "o", "done", i, T) for i in range(3)], ENTRIES)
    runs = spark.createDataFrame([(i, "ok") for i in range(3)], RUNS)
    store = CommitStore(spark, f"file://{tmp_path}/s")
    got = lambda c: {(r.spine_index, r.chapter_id) for r in store.output(c, "pending").collect()}
    assert got(plan_run(chapters, entries, runs, store)) == {(3, 7)}
    assert got(plan_run(unread(chapters), entries, runs, store)) == {(3, 7)}
    grown = unread(chapters).unionByName(spark.createDataFrame([(8, "b", 0, ["new"], T, "e"), (9, "b", 4, ["more"], T, "e")], CHAPTERS))
    assert got(plan_run(grown, entries, runs, store)) == {(0, 8), (3, 7), (4, 9)}
    late = entries.unionByName(spark.createDataFrame([(9, "b", 3, "t", sha("t7"), "o", "done", 5, T)], ENTRIES))
    assert got(plan_run(unread(chapters), late, runs.union(spark.createDataFrame([(5, "ok")], RUNS)), store)) == {(0, 8), (4, 9)}


def test_any_windows_give_what_one_gives(spark, tmp_path, monkeypatch):
    """Also with merged layers, and with runs that die before or after their files are written."""
    import random

    from quillspark.operators import incremental

    monkeypatch.setattr(incremental, "LAYERS", 2)
    rng = random.Random(3)
    text = lambda: [f"t{rng.randint(0, 3)}"]
    chapters = spark.createDataFrame([(i, rng.choice("ab"), rng.randint(0, 5), text(), T + dt.timedelta(rng.randint(0, 2)), "e") for i in range(60)], CHAPTERS).cache()
    entries = spark.createDataFrame([(i, rng.choice("ab"), rng.randint(0, 5), "t", sha(*text()), rng.choice(["o", "", None]), rng.choice(["done", "done", "error"]), i // 4, T + dt.timedelta(rng.randint(0, 2))) for i in range(80)], ENTRIES).cache()
    runs = spark.createDataFrame([(i, rng.choice(["ok", "ok", "failed"])) for i in range(20)], RUNS)
    one = CommitStore(spark, f"file://{tmp_path}/one")
    want = {tuple(r) for r in one.output(plan_run(chapters, entries, runs, one), "pending").collect()}
    many = CommitStore(spark, f"file://{tmp_path}/many")
    publish = many._publish
    for k, (run, row) in enumerate([(4, 10), (9, 10), (9, 40), (15, 55), (19, 59)]):
        known = runs.withColumn("outcome", F.when((F.col("run_id") != 3) | F.lit(run > 9), F.col("outcome")))  # run 3 closes late
        if k in (1, 3):
            many._publish = lambda commit: (_ for _ in ()).throw(RuntimeError("lost before publishing"))
            with pytest.raises(RuntimeError):
                plan_run(chapters, entries, known, many, run, row)
            many._publish = publish
        plan_run(chapters, entries, known, many, run, row)
    assert {tuple(r) for r in many.output(many.last(), "pending").collect()} == want and want
    assert len(many.last().layers["texts"]) <= 3 and len(many.commits()) == 5


def test_empty_tables(spark, tmp_path):
    store = CommitStore(spark, f"file://{tmp_path}/s")
    commit = plan_run(spark.createDataFrame([], CHAPTERS), spark.createDataFrame([], ENTRIES), spark.createDataFrame([], RUNS), store)
    assert store.output(commit, "pending").count() == 0
