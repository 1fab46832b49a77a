"""Queries of problem 4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import join_small
from ..session import cut, table
from .lookalike import alike, classes, equal_looking_pairs, fold_column, form_keys
from .queries_encodings import damaged


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chapter, book_id, texts): title first, then the paragraphs."""
    none = F.array().cast("array<string>")
    return table(spark, sf_dir, "chapters").select(F.col("chapter_id").alias("chapter"), "book_id", F.concat(F.array("title"), F.coalesce("paragraphs", none)).alias("texts"))


def _sound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(place, book_id, chapter, para, form, raw) of the texts with look-alikes; exactly the cases of p1 take no part."""
    keyed = form_keys(_texts(spark, sf_dir), ["book_id", "chapter"]).select("book_id", "chapter", (F.col("pos") - 1).alias("para"), "form", "raw")
    keyed = keyed.withColumn("place", F.when(F.col("para") < 0, "title").otherwise("paragraph"))
    cases = damaged(spark, sf_dir).where("place = 'paragraph'").select(F.col("row_id").alias("chapter"), F.col("pos").alias("para"))
    rows = alike(cut(keyed, "forms"), ["book_id", "place"])
    return cut(join_small(rows, cut(cases, "damaged"), ["chapter", "para"], "left_anti"), "alike")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of texts of one book that look the same but differ in their characters."""
    pairs = equal_looking_pairs(_sound(spark, sf_dir), ["book_id", "place"], ["chapter", "para"])
    return pairs.select("place", "chapter_a", "para_a", "chapter_b", "para_b")


def p4_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as one row per text: the first text of its class and how many of the class are spelled otherwise."""
    found = classes(_sound(spark, sf_dir), ["book_id", "place"], ["chapter", "para"])
    return found.select("place", "chapter", "para", F.col("first.chapter").alias("class_chapter"), F.col("first.para").alias("class_para"), "n_links")


def p4_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one form of every title and paragraph."""
    return fold_column(_texts(spark, sf_dir), ["chapter"], "texts").select("chapter", F.posexplode("form").alias("pos", "form")).select("chapter", (F.col("pos") - 1).alias("para"), "form")


QUERIES = {"p4_found": p4_found, "p4_classes": p4_classes, "p4_forms": p4_forms}
ORACLES: dict[str, str] = {}
