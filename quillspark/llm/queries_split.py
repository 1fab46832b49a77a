"""Queries of problem 2."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import join_small
from ..session import cut, table
from .split import split_oversized


def limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book_id, limit, overlap) of every book; without a config the default one holds."""
    config = table(spark, sf_dir, "segment_config").select("config_id", F.col("max_chars_per_chunk").alias("limit"), F.col("overlap_chars").alias("overlap"))
    books = table(spark, sf_dir, "book_manifest").groupBy("book_id").agg(F.coalesce(F.max("config_id"), F.lit("default")).alias("config_id"))
    return join_small(books, config, ["config_id"]).select("book_id", "limit", "overlap")


def _pieces(spark: SparkSession, sf_dir: str, with_text: bool) -> DataFrame:
    books = cut(limits(spark, sf_dir), "limits")
    least = books.agg(F.min("limit")).first()[0]
    # what is within every limit is dropped inside the array, before anything is exploded or joined
    long = F.filter(F.transform("paragraphs", lambda p, i: F.struct(i.alias("para_no"), p.alias("text"))), lambda x: F.char_length(x["text"]) > F.lit(least))
    rows = table(spark, sf_dir, "chapters").select("chapter_id", "book_id", F.explode(long).alias("x")).select("chapter_id", "book_id", "x.*")
    items = join_small(rows, books, ["book_id"]).where(F.char_length("text") > F.col("limit"))
    return split_oversized(items, ["chapter_id", "para_no"], with_text=with_text)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Oversized paragraphs: those that the split cut at least once."""
    return _pieces(spark, sf_dir, False).where("piece_no = 1").select("chapter_id", "para_no")


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces with their text."""
    return _pieces(spark, sf_dir, True)


QUERIES = {"p2_found": p2_found, "p2_pieces": p2_pieces}
ORACLES = {
    "p2_found": """
        WITH books AS (SELECT book_id, coalesce(max(config_id), 'default') AS config_id FROM book_manifest GROUP BY book_id),
        items AS (SELECT chapter_id, book_id, unnest(paragraphs) AS text, unnest(range(len(paragraphs))) AS para_no FROM chapters)
        SELECT chapter_id, CAST(para_no AS INTEGER) AS para_no
        FROM items JOIN books USING (book_id) JOIN segment_config USING (config_id) WHERE length(text) > max_chars_per_chunk"""
}
