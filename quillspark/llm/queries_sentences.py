"""Queries of problem 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.joins import join_small
from ..session import table
from .sentences import abbreviation_counts, abbreviations, sentence_ends


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of the proof sample."""
    chapters = table(spark, sf_dir, "chapters")
    sample = join_small(chapters.select("chapter_id", "paragraphs"), table(spark, sf_dir, "proof_sample").select("chapter_id").distinct(), ["chapter_id"], "left_semi", unique=True)
    return sentence_ends(sample, "chapter_id", "paragraphs", abbreviations(abbreviation_counts(chapters, "paragraphs"))).select("chapter_id", "para_no", "end_pos")


def p6_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of every chapter."""
    chapters = table(spark, sf_dir, "chapters")
    return sentence_ends(chapters, "chapter_id", "paragraphs", abbreviations(abbreviation_counts(chapters, "paragraphs")))


QUERIES = {"p6_found": p6_found, "p6_sentences": p6_sentences}
ORACLES: dict[str, str] = {}
