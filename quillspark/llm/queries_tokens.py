"""Queries of problems 7 and 8, whose sizes are tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import fits
from ..session import cut, table
from .mixing import mix
from .packing import pack
from .tokens import token_sizes


def p7_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pack for every document, for each capacity."""
    sizes = cut(token_sizes(table(spark, sf_dir, "documents"), ["doc_id"]), "sizes")
    return pack(sizes, table(spark, sf_dir, "pack_capacity").select("pack_id", "capacity_tokens"))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the packs are."""
    packs = p7_packs(spark, sf_dir).where("tokens > 0").groupBy("pack_id", "pack_no").agg(F.sum("tokens").alias("tokens"))
    capacity = table(spark, sf_dir, "pack_capacity")
    sums = packs.groupBy("pack_id").agg(F.count("*").alias("n_packs"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"))
    return sums.join(capacity, "pack_id").withColumn("unused_share", 1 - F.col("tokens") / (F.col("n_packs") * F.col("capacity_tokens")))


def _mix(spark: SparkSession, sf_dir: str, **options: bool) -> tuple[DataFrame, DataFrame]:
    targets = table(spark, sf_dir, "mix_targets")
    # only documents of listed sources are measured, unless there are too many to broadcast: texts aren't shuffled for it
    listed, names = table(spark, sf_dir, "documents").select("doc_id", "source", "text"), targets.where("weight > 0").select("source").distinct()
    if fits(names):
        listed = listed.join(F.broadcast(names), "source", "left_semi")
    return mix(cut(token_sizes(listed, ["doc_id", "source"]), "sizes"), targets, **options)


def p8_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every use of a document in a mix."""
    return _mix(spark, sf_dir)[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of each source, and what it lacks under its cap."""
    return _mix(spark, sf_dir)[1]


def p8_exact_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of the largest mixes in which no source falls short."""
    return _mix(spark, sf_dir, keep_weights=True)[1]


QUERIES = {"p7_packs": p7_packs, "p7_fill": p7_fill, "p8_draws": p8_draws, "p8_shares": p8_shares, "p8_exact_shares": p8_exact_shares}
ORACLES: dict[str, str] = {}
