"""Keeping a quad table up to date with a folder of documents, by a file stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.summary import changed_files
from ..sources import frontmatter
from ..sources.corpus import below

FILES = "path string, suffix string, text string, size long, mtime timestamp"


def file_stream(spark: SparkSession, root: str) -> DataFrame:
    """New and changed files of a folder as a stream of (path, suffix, text, size, mtime)."""
    texts = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("latestFirst", False).load(root)
    suffix = F.lower(F.regexp_extract("_metadata.file_path", r"(\.[^./]*)$", 1))
    return texts.select(below(root).alias("path"), suffix.alias("suffix"), F.col("value").alias("text"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("mtime")).where(F.col("suffix").isin(list(frontmatter.DOCUMENTS)))


def refresh(spark: SparkSession, root: str, table: str, checkpoint: str, rows_of: Callable[[DataFrame], DataFrame]) -> None:
    """Processes what has come since the last call into a Parquet table with a column path.

    Rows of a file replace those it had before: each batch is written beside the others with its number, and
    ``current`` keeps the newest of each path, so a repeated batch does no harm.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows_of(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{table}/batch={number:08d}")
        batch.select("path").distinct().withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{table}-paths/batch={number:08d}")

    file_stream(spark, root).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def current(spark: SparkSession, table: str) -> DataFrame:
    """The rows of each path's newest batch; a file that gives no rows any more has none."""
    newest = spark.read.parquet(f"{table}-paths").groupBy("path").agg(F.max("batch").alias("batch"))
    return spark.read.parquet(table).join(newest, ["path", "batch"]).drop("batch")


def deleted(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path) of files that are gone: a stream doesn't tell, two manifests (path, mtime) do."""
    return changed_files(before, after).where(F.col("change") == "removed").select("path")
