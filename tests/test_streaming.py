import datetime as dt

from quillspark.streaming.folder import arriving, loads_per_window, manifest_stream

SCHEMA = "chapter_id long, book_id string, spine_index int, title string, paragraphs array<string>, loaded_at timestamp"


def batch(spark, low, high):
    rows = [(i, "b", i, "t", ["x"] * (i % 3), dt.datetime(2024, 1, 1, i % 24)) for i in range(low, high)]
    return spark.createDataFrame(rows, SCHEMA).coalesce(1)


def test_each_row_once_over_restarts(spark, tmp_path):
    source, out, check = (f"file://{tmp_path}/{n}" for n in ("in", "out", "check"))
    batch(spark, 0, 5).write.parquet(source)
    run = lambda: manifest_stream(arriving(spark, source, batch(spark, 0, 1).schema), out, check).awaitTermination()
    run()
    run()
    batch(spark, 5, 8).write.mode("append").parquet(source)
    run()
    assert sorted(r["index"] for r in spark.read.parquet(out).collect()) == list(range(8))


def test_windows(spark, tmp_path):
    source = f"file://{tmp_path}/in"
    batch(spark, 0, 50).write.parquet(source)
    q = loads_per_window(arriving(spark, source, batch(spark, 0, 1).schema)).writeStream.format("memory").queryName("loads").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT sum(n_rows), count(*) FROM loads").first() == (50, 24)


def test_positions_over_stretches(spark):
    from quillspark.operators.manifest import positions

    rows = [("a", i * 7) for i in range(700)] + [("b", 3)]
    got = positions(spark.createDataFrame(rows, "book_id string, spine_index int")).collect()
    assert {(r.book_id, r.spine_index): r.ordinal for r in got} == {("a", i * 7): i for i in range(700)} | {("b", 3): 0}
