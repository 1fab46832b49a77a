"""Chapters that arrive in a watched folder, as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.manifest import chapter_rows


def arriving(spark: SparkSession, folder: str, schema: StructType, pattern: str = "*.parquet", files_per_batch: int = 100) -> DataFrame:
    """New Parquet files of chapters in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", pattern).parquet(folder)


def manifest_stream(chapters: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append a manifest row for every arriving chapter row, each exactly once, and stop when there is no more.

    The checkpoint keeps what has been read and the sink's log what has been written, so a restart goes on where
    a failed run stopped.
    """
    rows = chapter_rows(chapters)
    return rows.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def loads_per_window(chapters: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """How many chapter rows were loaded in each window; rows later than ``late`` are left out by the watermark."""
    counts = chapters.withWatermark("loaded_at", late).groupBy(F.window("loaded_at", window)).agg(F.count("*").alias("n_rows"))
    return counts.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n_rows")
