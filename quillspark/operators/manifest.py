"""Book manifests: one row per chapter with its hash, state and output; nested per book; as JSON."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.audio import HEADER
from .incremental import text_hash
from .joins import join_small

CHAPTER = "struct<index:bigint,title:string,text_hash:string,paragraphs:bigint,output:string,status:string>"
SCHEMA = f"tool string, created_at string, book_id string, source string, title string, chapters array<{CHAPTER}>"
TOOL = "quillspark"


def chapter_rows(chapters: DataFrame, index: str = "spine_index") -> DataFrame:
    """book_id, index, title, text_hash, paragraphs (their number), output (null), status (parsed)."""
    return chapters.select(
        "book_id", F.col(index).cast("bigint").alias("index"), "title", text_hash(F.col("paragraphs")).alias("text_hash"), F.size(F.coalesce("paragraphs", F.array().cast("array<string>"))).cast("bigint").alias("paragraphs"),
        F.lit(None).cast("string").alias("output"), F.lit("parsed").alias("status"),
    )


def current_rows(chapters: DataFrame, index: str = "spine_index") -> DataFrame:
    """``chapter_rows`` of each chapter's current row: the one loaded last, then that of the greatest chapter_id.

    Every text is hashed where it is read; title, hash and counts travel once, for the choice.
    """
    order = F.struct(F.coalesce(F.col("loaded_at"), F.lit("0001-01-01").cast("timestamp")).alias("at"), F.col("chapter_id").alias("id"))
    count = F.size(F.coalesce("paragraphs", F.array().cast("array<string>"))).cast("bigint")
    rows = chapters.select("book_id", F.col(index).cast("bigint").alias("index"), F.struct(order.alias("o"), "title", text_hash(F.col("paragraphs")).alias("text_hash"), count.alias("paragraphs")).alias("r"))
    last = rows.groupBy("book_id", "index").agg(F.max("r").alias("r"))
    return last.select("book_id", "index", "r.title", "r.text_hash", "r.paragraphs", F.lit(None).cast("string").alias("output"), F.lit("parsed").alias("status"))


def book_manifests(rows: DataFrame, books: DataFrame, created_at: Column | None = None, tool: str = TOOL) -> DataFrame:
    """One row per book with its chapters in order. ``books`` has book_id, title, source."""
    nested = rows.groupBy("book_id").agg(F.sort_array(F.collect_list(F.struct("index", "title", "text_hash", "paragraphs", "output", "status"))).alias("chapters"))
    at = created_at if created_at is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    joined = books.join(nested, "book_id", "left")
    return joined.select(F.lit(tool).alias("tool"), at.alias("created_at"), "book_id", "source", "title", F.coalesce("chapters", F.array().cast(f"array<{CHAPTER}>")).alias("chapters"))


#: Spine items that one task numbers at a time.
STRETCH = 1024


def positions(chapters: DataFrame, index: str = "spine_index") -> DataFrame:
    """``chapters`` with ordinal (dense, from 0), n_chapters and percent of each in its book.

    Only keys are ordered, in stretches of the index, so neither a book with a third of all chapters nor any text
    comes together in one task. The index is unique within a book.
    """
    keys = chapters.select("book_id", index, F.floor(F.col(index) / STRETCH).alias("_part"))
    sizes = keys.groupBy("book_id", "_part").agg(F.count("*").alias("_n"))
    parts = Window.partitionBy("book_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("book_id", "_part", F.coalesce(F.sum("_n").over(parts), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy("book_id")).alias("n_chapters"))
    inside = F.row_number().over(Window.partitionBy("book_id", "_part").orderBy(index))
    at = (F.col("_before") + F.col("_row") - 1).cast("int")
    numbered = keys.withColumn("_row", inside).join(before, ["book_id", "_part"]).select("book_id", index, at.alias("ordinal"), "n_chapters")
    rows = join_small(chapters.drop("ordinal", "n_chapters", "percent"), numbered, ["book_id", index], unique=True)
    return rows.withColumn("percent", F.round(F.lit(100.0) * (F.col("ordinal") + 1) / F.col("n_chapters")).cast("int"))


def progress_line(verb: str) -> Column:
    """[i/n pct%] verb title, from the columns of ``positions``."""
    return F.format_string("[%d/%d %d%%] %s %s", F.col("ordinal") + 1, F.col("n_chapters"), F.col("percent"), F.lit(verb), F.coalesce("title", F.lit("")))


def not_empty(path: Column, length: Column) -> Column:
    """Whether a file holds anything: more than the header for WAV files. A null length means there is none."""
    return F.coalesce(length > F.when(F.lower(path).endswith(".wav"), F.lit(HEADER)).otherwise(F.lit(0)), F.lit(False))


def resume(current: DataFrame, earlier: DataFrame, by_hash: bool = False) -> DataFrame:
    """The manifest rows to go on with: a book's earlier rows where they are as many as now, else the current ones.

    With ``by_hash`` the current rows are kept and take over output and status where index and text are the same.
    """
    if by_hash:
        old = earlier.select("book_id", "index", F.lower("text_hash").alias("_h"), F.col("output").alias("_o"), F.col("status").alias("_s"))
        same = F.col("_h") == F.col("text_hash")
        return current.join(old, ["book_id", "index"], "left").select(
            "book_id", "index", "title", "text_hash", "paragraphs", F.when(same, F.col("_o")).otherwise(F.col("output")).alias("output"), F.when(same, F.col("_s")).otherwise(F.col("status")).alias("status")
        )
    count = lambda df, name: df.groupBy("book_id").agg(F.count("*").alias(name))
    kept = count(current, "a").join(count(earlier, "b"), "book_id").where("a = b").select("book_id")
    return earlier.join(kept, "book_id", "left_semi").select(current.columns).unionByName(current.join(kept, "book_id", "left_anti"))


def listed_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length) of all files below a folder of any file system; no content is read. Paths of local files have no
    scheme."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return listed.select(plain_path(F.col("path")).alias("path"), "length")


def plain_path(path: Column) -> Column:
    """A path without the scheme of local files."""
    return F.regexp_replace(path, "^file:/+", "/")


def done_rows(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Rows that need no synthesis: status done and an output that is a file with something in it.

    ``files`` has path and length, as the binaryFile source lists them.
    """
    listed = files.select(plain_path(F.col("path")).alias("_path"), F.col("length").alias("_n"))
    named = rows.where("status = 'done' AND output IS NOT NULL").withColumn("_path", plain_path(F.col("output")))
    return named.join(listed, "_path").where(not_empty(F.col("output"), F.col("_n"))).select("book_id", "index")


def pending(rows: DataFrame, done: DataFrame) -> DataFrame:
    """What is left to do."""
    return rows.join(done, ["book_id", "index"], "left_anti")


def update(rows: DataFrame, results: DataFrame) -> DataFrame:
    """Rows with output and status of their results (book_id, index, output, status), unchanged without one."""
    new = results.select("book_id", "index", F.col("output").alias("_o"), F.col("status").alias("_s"))
    return rows.join(new, ["book_id", "index"], "left").select(
        "book_id", "index", "title", "text_hash", "paragraphs", F.when(F.col("_s").isNotNull(), F.col("_o")).otherwise(F.col("output")).alias("output"), F.coalesce("_s", "status").alias("status")
    )


def status_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("book_id").agg(*(F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("done", "error", "parsed")))


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Manifest files of one JSON object each; a malformed one is an error."""
    return spark.read.schema(SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records that workers left of single chapters, like the rows of ``flat``; one that can't be read is an error."""
    schema = "book_id string, " + CHAPTER.removeprefix("struct<").removesuffix(">").replace(":", " ")
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def flat(manifests: DataFrame) -> DataFrame:
    return manifests.select("book_id", F.explode("chapters").alias("c")).select("book_id", "c.*")


def write_manifest_files(manifests: DataFrame, folder: str) -> DataFrame:
    """<folder>/<book_id>/manifest.json for each book, written by the workers into a shared folder."""
    from .speech import write_file

    def run(batches):
        import pandas as pd

        for batch in batches:
            paths = []
            for book, text in zip(batch["book_id"], batch["json"], strict=True):
                path = f"{folder}/{book}/manifest.json"
                write_file(path, json.dumps(json.loads(text), indent=2, ensure_ascii=False).encode())
                paths.append(path)
            yield pd.DataFrame({"book_id": batch["book_id"], "path": paths})

    body = F.to_json(F.struct("tool", "created_at", "book_id", "source", "title", "chapters"), {"ignoreNullFields": "false"})
    return manifests.select("book_id", body.alias("json")).mapInPandas(run, "book_id string, path string")
