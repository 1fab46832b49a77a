"""Whole pipelines: inspect and convert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.audio import PAUSE_MS, chapter_samples
from ..functions.titles import choose_title, wav_path
from ..operators import manifest as m
from ..operators.joins import join_small
from ..operators.segment import MAX_CHARS, with_chunks
from ..operators.speech import synthesize_chapters
from ..session import spread

#: Characters per chunk by engine, where another number than the usual holds.
ENGINE_CHARS = {"onnx": 80}


def titled(chapters: DataFrame) -> DataFrame:
    """Chapters with a title chosen where theirs says nothing."""
    return chapters.withColumn("title", choose_title(F.col("title"), F.col("item_id"), F.col("paragraphs")))


def current(chapters: DataFrame) -> DataFrame:
    """The row loaded last of each chapter, then that of the greatest chapter_id, with its text.

    Only ids travel for the choice; the rows are then picked by their unique chapter_id, where they stand as long as
    the ids fit on every worker. What needs no text takes ``manifest.current_rows``, which never moves any.
    """
    order = F.struct(F.coalesce(F.col("loaded_at"), F.lit("0001-01-01").cast("timestamp")).alias("at"), F.col("chapter_id").alias("id"))
    last = chapters.groupBy("book_id", "spine_index").agg(F.max(order).alias("o")).select(F.col("o.id").alias("chapter_id"))
    return join_small(chapters, last, ["chapter_id"], "left_semi", unique=True)


def inspect(chapters: DataFrame, limit: int | Column = MAX_CHARS, numbers: bool | Column = True) -> DataFrame:
    """Title, number of paragraphs and of chunks, and the length in samples of every chapter."""
    chunked = with_chunks(titled(spread(chapters)), "paragraphs", limit, numbers)
    return chunked.select("book_id", "spine_index", "chapter_id", "title", F.size("paragraphs").alias("n_paragraphs"), F.size("chunks").alias("n_chunks"), chapter_samples(F.col("chunks")).alias("n_samples"))


def inspect_line() -> Column:
    """[%03d] title | paragraphs: n | chunks: m"""
    return F.format_string("[%03d] %s | paragraphs: %d | chunks: %d", F.col("spine_index") + 1, "title", "n_paragraphs", "n_chunks")


def convert(
    chapters: DataFrame, earlier: DataFrame | None = None, files: DataFrame | None = None, folder: str | None = None, engine: str = "tone", jobs: int | None = None, numbers: bool | Column = False,
    limit: int | Column | None = None, pause_ms: int = PAUSE_MS, by_hash: bool = False, records: DataFrame | None = None, **options: object,
) -> tuple[DataFrame, DataFrame]:
    """(results, manifest rows) of narrating the chapters that aren't done.

    ``chapters`` has book_id, spine_index, title, item_id and paragraphs. What is done is left out before any
    text is touched. Results have one row per narrated chapter: output, n_samples, sample_rate, status, error.
    ``records`` are those of a run that died, see ``manifest.read_records``; they hold for chapters of the same text.
    With ``folder`` each chapter is recorded as soon as its file is whole; without it nothing is written. ``jobs`` is the number of partitions to spread the work over, as
    chapters take unequal time.
    """
    named = m.positions(titled(chapters))
    rows = m.chapter_rows(named)
    if earlier is not None:
        rows = m.resume(rows, earlier, by_hash)
    if records is not None:
        rows = m.resume(rows, records, True)
    todo = rows
    if (earlier is not None or records is not None) and files is not None:
        todo = m.pending(rows, m.done_rows(rows, files))
    work = join_small(named, todo.select("book_id", F.col("index").cast("int").alias("spine_index")), ["book_id", "spine_index"], "left_semi", unique=True)
    work = work.repartition(jobs) if jobs else spread(work)
    chunked = with_chunks(work, "paragraphs", limit or ENGINE_CHARS.get(engine, MAX_CHARS), numbers)
    path = F.lit(None).cast("string")
    if folder:
        path = wav_path(F.concat(F.lit(f"{folder}/"), F.col("book_id"), F.lit("/chapters")), F.col("ordinal") + 1, F.col("title"))
    chunked = chunked.withColumn("path", path).withColumn("index", F.col("spine_index").cast("bigint"))
    keys = ["book_id", "index", "ordinal", "n_chapters", "percent", "title"]
    record = None
    if folder:
        place = F.concat(F.lit(f"{folder}/"), F.col("book_id"), F.lit("/progress/"), F.col("index").cast("string"), F.lit(".json"))
        content = F.to_json(F.struct("book_id", "index", "title", m.text_hash(F.col("paragraphs")).alias("text_hash"), F.size("paragraphs").cast("bigint").alias("paragraphs"), F.col("path").alias("output"), F.lit("done").alias("status")))
        chunked = chunked.withColumn("_place", place).withColumn("_note", content)
        record = ("_place", "_note")
    results = synthesize_chapters(chunked, keys, "chunks", "path", engine, pause_ms, record=record, **options)
    return results, rows
