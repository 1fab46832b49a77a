"""Queries of problem 9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .stuffing import judge_pages


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of keywords, links, tags or goods."""
    return judge_pages(table(spark, sf_dir, "documents"), "doc_id").where("stuffed").select("doc_id")


def p9_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every page is built of: all its shapes, with their units, their share of the page, and whether they are
    stuffed."""
    judged = judge_pages(table(spark, sf_dir, "documents"), "doc_id")
    return judged.select("doc_id", F.col("share").alias("stuffed_share"), F.explode_outer("shapes").alias("s")).select("doc_id", "stuffed_share", "s.*")


QUERIES = {"p9_found": p9_found, "p9_shapes": p9_shapes}
ORACLES: dict[str, str] = {}
