"""Queries of problem 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .boilerplate import find_repeated, remove_lines


def _repeated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sites = table(spark, sf_dir, "book_manifest").groupBy(F.col("book_id").alias("source")).agg(F.max("source").alias("site"))
    return find_repeated(table(spark, sf_dir, "chapters").select("chapter_id", "book_id", "paragraphs"), "chapter_id", "book_id", "paragraphs", sites=sites)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs holding a line that is excessive in its source."""
    matches, _ = _repeated(spark, sf_dir)
    return matches.select(F.col("doc").alias("chapter_id"), F.col("line_no").alias("para_no"))


def p5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: how many excessive lines it has, in how many blocks, and in how many chapter rows of how many."""
    _, blocks = _repeated(spark, sf_dir)
    return blocks.groupBy("source", "n_source").agg(F.count("*").alias("n_lines"), F.countDistinct("block").alias("n_blocks"), F.sum("n_docs").alias("n_occurrences"))


def p5_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chapter's paragraphs without the occurrences of its source's blocks."""
    matches, _ = _repeated(spark, sf_dir)
    chapters = table(spark, sf_dir, "chapters").select("chapter_id", "paragraphs")
    return remove_lines(chapters, "chapter_id", "paragraphs", matches).select("chapter_id", F.array_join("paragraphs", "\n").alias("text"))


_FOUND = """
books AS (SELECT book_id, max(source) AS source FROM book_manifest GROUP BY book_id),
total AS (SELECT source, count(*) AS n_source FROM chapters JOIN books USING (book_id) GROUP BY source),
lines AS (SELECT chapter_id, source, para_no, text, lower(regexp_replace(text, '[^\\p{L}\\p{M}]+', '', 'g')) AS key
          FROM (SELECT chapter_id, book_id, unnest(paragraphs) AS text, unnest(range(len(paragraphs))) AS para_no FROM chapters) JOIN books USING (book_id)),
often AS (SELECT source, key, n_source, count(DISTINCT chapter_id) AS n FROM lines JOIN total USING (source) WHERE key <> ''
          GROUP BY ALL HAVING n >= 5 AND n * 100 >= n_source * 8)
"""

QUERIES = {"p5_found": p5_found, "p5_lines": p5_lines, "p5_clean": p5_clean}
ORACLES = {
    "p5_found": f"WITH {_FOUND} SELECT chapter_id, CAST(para_no AS INTEGER) AS para_no FROM lines SEMI JOIN often USING (source, key)",
    "p5_lines": f"""WITH RECURSIVE {_FOUND},
        kept AS (SELECT chapter_id, source, key, lead(key) OVER (PARTITION BY chapter_id ORDER BY para_no) AS nxt FROM lines SEMI JOIN often USING (source, key)),
        edge AS (SELECT source, key, nxt FROM kept JOIN total USING (source) WHERE nxt IS NOT NULL GROUP BY source, key, nxt, n_source HAVING count(DISTINCT chapter_id) >= 5 AND count(DISTINCT chapter_id) * 100 >= n_source * 8),
        both_ways AS (SELECT source, key AS a, nxt AS b FROM edge UNION SELECT source, nxt, key FROM edge),
        reach(source, key, other) AS (SELECT source, key, key FROM often UNION SELECT r.source, r.key, w.b FROM reach r JOIN both_ways w ON w.source = r.source AND w.a = r.other),
        block AS (SELECT source, key, min(other) AS block FROM reach GROUP BY source, key)
        SELECT source, n_source, count(*) AS n_lines, count(DISTINCT block) AS n_blocks, CAST(sum(n) AS BIGINT) AS n_occurrences FROM often JOIN block USING (source, key) GROUP BY source, n_source""",
    "p5_clean": f"""WITH {_FOUND} SELECT chapter_id, coalesce(text, '') AS text FROM chapters LEFT JOIN
        (SELECT chapter_id, string_agg(text, chr(10) ORDER BY para_no) AS text FROM lines ANTI JOIN often USING (source, key) GROUP BY chapter_id) USING (chapter_id)""",
}
