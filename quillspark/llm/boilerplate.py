"""Lines repeated across one site's documents (problem 5).

A line's key is the hash of its lower-cased letters and marks. Keys with enough support within a source are the
nodes of a graph, consecutive occurrences of two nodes its edges; nodes and edges weigh as many documents as hold
them. Connected components over well supported edges are boilerplate blocks, whose occurrences are deleted. A line
that is excessive by itself is a block of its own, so edges tell which lines belong together and never whether a
line goes.

Only hashes are counted and shuffled, never text. A node stands in at least ``min_share`` of the source's
documents, so a source has at most (lines per document) / min_share nodes: what is gathered per source is
bounded however large the source is.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import join_small
from ..session import cut

MIN_DOCS = 5
MIN_PERCENT = 8


def line_key(line: Column) -> Column:
    """Hash of the letters and marks, lower-cased; null for a line without any."""
    letters = F.lower(F.regexp_replace(line, r"[^\p{L}\p{M}]+", ""))
    return F.when(letters != "", F.xxhash64(letters))


def keyed_lines(df: DataFrame, doc: str, source: str, lines: str) -> DataFrame:
    """(doc, source, keys): one array of line keys per document, aligned with its lines."""
    return df.select(F.col(doc).alias("doc"), F.col(source).alias("source"), F.transform(F.coalesce(lines, F.array().cast("array<string>")), line_key).alias("keys"))


def repeated_lines(keyed: DataFrame, min_docs: int = MIN_DOCS, min_percent: int = MIN_PERCENT) -> DataFrame:
    """(source, key, n_docs, n_source): the nodes. Rows are documents; equal rows count each."""
    docs = keyed.where("source IS NOT NULL")
    total = docs.groupBy("source").agg(F.count("*").alias("n_source"))
    # distinct keys of each document first, then map-side partial counts: a hot source sends one row per key and task
    counts = docs.select("source", F.explode(F.array_distinct("keys")).alias("key")).where("key IS NOT NULL").groupBy("source", "key").agg(F.count("*").alias("n_docs"))
    many = counts.where(F.col("n_docs") >= min_docs)
    return join_small(many, total, ["source"]).where(F.col("n_docs") * 100 >= F.col("n_source") * min_percent)


def _components(nodes: pd.DataFrame) -> pd.DataFrame:
    """Block of each node of one source: the least key of its component."""
    parent: dict[int, int] = {}

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for k in (*nodes["key"], *nodes["next"]):
        parent.setdefault(k, k)
    for a, b in zip(nodes["key"], nodes["next"], strict=True):
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    own = nodes.drop_duplicates("key")
    return pd.DataFrame({"source": own["source"], "key": own["key"], "block": [root(k) for k in own["key"]], "n_docs": own["n_docs"], "n_source": own["n_source"]})


def boilerplate_blocks(keyed: DataFrame, min_docs: int = MIN_DOCS, min_percent: int = MIN_PERCENT) -> tuple[DataFrame, DataFrame]:
    """The blocks (source, key, block, n_docs, n_source), and the occurrences of their lines (doc, source, line_no, key)."""
    nodes = cut(repeated_lines(keyed, min_docs, min_percent), "nodes")
    lines = keyed.where("source IS NOT NULL").withColumn("row", F.monotonically_increasing_id()).select("row", "doc", "source", F.posexplode("keys").alias("line_no", "key")).where("key IS NOT NULL")
    found = cut(join_small(lines, nodes.select("source", "key"), ["source", "key"]), "found")
    after = F.lead("key").over(Window.partitionBy("row").orderBy("line_no"))
    pairs = found.select("row", "source", "key", after.alias("next")).where("next IS NOT NULL").distinct()
    edges = pairs.groupBy("source", "key", "next").agg(F.count("*").alias("weight")).where(F.col("weight") >= min_docs)
    edges = join_small(edges, nodes.select("source", "n_source").distinct(), ["source"]).where(F.col("weight") * 100 >= F.col("n_source") * min_percent)
    graph = nodes.select("source", "key", F.col("key").alias("next"), "n_docs", "n_source").unionByName(edges.select("source", "key", "next", F.lit(0).cast("bigint").alias("n_docs"), "n_source"))
    blocks = graph.groupBy("source").applyInPandas(_blocks_of_source, "source string, key bigint, block bigint, n_docs bigint, n_source bigint")
    return blocks, found


def _blocks_of_source(pdf: pd.DataFrame) -> pd.DataFrame:
    return _components(pdf.sort_values("n_docs", ascending=False, kind="stable"))


def find_repeated(df: DataFrame, doc: str, source: str, lines: str, min_docs: int = MIN_DOCS, min_percent: int = MIN_PERCENT, sites: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(matches, blocks). ``matches``: doc, line_no, block of every line to delete.

    ``sites`` (source, site) names the site of each source where it isn't a column of the documents; it joins the
    hashed lines, never the text, and documents without a site are left out. Documents of a null source belong to no
    site and lose nothing; null lines, lines without letters and null or empty arrays match nothing; repeated rows of
    a document count and match each. Any other columns are ignored.
    """
    keyed = keyed_lines(df, doc, source, lines)
    if sites is not None:
        keyed = join_small(keyed, sites.select("source", "site"), ["source"]).select("doc", F.col("site").alias("source"), "keys")
    blocks, found = boilerplate_blocks(cut(keyed, "keys"), min_docs, min_percent)
    blocks = cut(blocks, "blocks")
    return join_small(found, blocks.select("source", "key", "block"), ["source", "key"]).select("doc", "line_no", "block"), blocks


def remove_lines(df: DataFrame, doc: str, lines: str, matches: DataFrame) -> DataFrame:
    """``df`` with ``lines`` without the matched ones; ``doc`` must be unique. Rows without a match stay as they are."""
    gone = matches.groupBy(F.col("doc").alias(doc)).agg(F.collect_set("line_no").alias("_gone"))
    left = df.join(gone, doc, "left")
    return left.withColumn(lines, F.when(F.col("_gone").isNull(), F.col(lines)).otherwise(F.filter(lines, lambda p, i: ~F.array_contains("_gone", i)))).drop("_gone")
