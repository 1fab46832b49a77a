"""Queries of problem 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .encodings import repair


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(place, source, row_id, texts): the paragraphs of every stored chapter row and the title of every manifest.

    ``source`` is the book; ``pools`` has the source of each, so that no text is joined.
    """
    chapters = table(spark, sf_dir, "chapters").select(F.lit("paragraph").alias("place"), F.col("book_id").alias("source"), F.col("chapter_id").alias("row_id"), F.col("paragraphs").alias("texts"))
    manifests = table(spark, sf_dir, "book_manifest")
    return chapters.unionByName(manifests.select(F.lit("title").alias("place"), F.col("book_id").alias("source"), F.col("manifest_id").alias("row_id"), F.array("title").alias("texts")))


def pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, pool): of each book the file it came from."""
    return table(spark, sf_dir, "book_manifest").groupBy(F.col("book_id").alias("source")).agg(F.max("source").alias("pool"))


def damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The damaged texts and their repair, evidence pooled by source and field."""
    return repair(items(spark, sf_dir), pools=pools(spark, sf_dir))


def _cases(df: DataFrame) -> DataFrame:
    return df.withColumn("para_no", F.when(F.col("place") == "title", F.lit(-1)).otherwise(F.col("pos")))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of which any part was read in a wrong encoding."""
    return _cases(damaged(spark, sf_dir)).select("place", "row_id", "para_no")


def p1_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the chain and the original text."""
    return _cases(damaged(spark, sf_dir)).select("place", "row_id", "para_no", "chain", "repaired")


QUERIES = {"p1_found": p1_found, "p1_repaired": p1_repaired}
ORACLES: dict[str, str] = {}
