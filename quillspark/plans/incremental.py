"""Queries of the incremental run (problem 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.incremental import CommitStore, plan_run, process_new, text_hash
from ..session import fresh_path, table


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, sf_dir, "chapters"), table(spark, sf_dir, "chapter_manifest"), table(spark, sf_dir, "run_log")


def _run(spark: SparkSession, sf_dir: str, windows: int) -> DataFrame:
    """What is left after so many runs, each of which knew so much more of the log and of the stored chapters."""
    chapters, entries, runs = _tables(spark, sf_dir)
    store = CommitStore(spark, fresh_path(spark, "p3"))
    first, last = runs.agg(F.min("run_id"), F.max("run_id")).first()
    low, high = chapters.agg(F.min("chapter_id"), F.max("chapter_id")).first()
    for k in range(1, windows):
        if last is not None and high is not None:
            plan_run(chapters, entries, runs, store, first + (last - first) * k // windows, low + (high - low) * k // windows)
    return store.output(plan_run(chapters, entries, runs, store), "pending")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters that are not settled, as a run commits them that goes on from an earlier run's watermarks."""
    return _run(spark, sf_dir, 2).select("book_id", "spine_index")


def p3_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same after four runs."""
    return _run(spark, sf_dir, 4)


def p3_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text hash of every stored row, each made in the one of three runs that found it new."""
    chapters = table(spark, sf_dir, "chapters")
    store = CommitStore(spark, fresh_path(spark, "p3"))
    low, high = chapters.agg(F.min("chapter_id"), F.max("chapter_id")).first()
    for k in (1, 2, 3):
        process_new(chapters, "chapter_id", store, lambda d: d.select("chapter_id", text_hash(F.col("paragraphs")).alias("text_hash")), high=None if high is None else low + (high - low) * k // 3)
    return store.read("out")


_NOW = """
now AS (SELECT book_id, spine_index, chapter_id, sha256(array_to_string(paragraphs, chr(10))) AS text_hash
        FROM (SELECT *, row_number() OVER (PARTITION BY book_id, spine_index ORDER BY loaded_at DESC, chapter_id DESC) AS r FROM chapters)
        WHERE r = 1),
done AS (SELECT book_id, spine_index, lower(text_hash) AS h
         FROM (SELECT *, row_number() OVER (PARTITION BY book_id, spine_index ORDER BY written_at DESC, entry_id DESC) AS r
               FROM chapter_manifest WHERE run_id IN (SELECT run_id FROM run_log WHERE outcome = 'ok'))
         WHERE r = 1 AND status = 'done' AND output <> ''),
pending AS (SELECT * FROM now WHERE NOT EXISTS (SELECT 1 FROM done WHERE done.book_id = now.book_id AND done.spine_index = now.spine_index AND done.h = now.text_hash))
"""

QUERIES = {"p3_found": p3_found, "p3_windows": p3_windows, "p3_hashes": p3_hashes}
ORACLES = {
    "p3_found": f"WITH {_NOW} SELECT book_id, spine_index FROM pending",
    "p3_windows": f"WITH {_NOW} SELECT book_id, spine_index, chapter_id, text_hash FROM pending",
    "p3_hashes": "SELECT chapter_id, sha256(array_to_string(paragraphs, chr(10))) AS text_hash FROM chapters",
}
