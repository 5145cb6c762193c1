"""Writing intermediate results to the shared folder, so that loops have short plans and executors may be lost."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, or a temporary one where a local session has none."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local[") and context.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="lineage-")
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def put(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file wherever Spark can."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(text.encode()))
    out.close()


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table of its own in the shared folder: cuts lineage, and columns and predicates still prune what is read."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def together(parts: list[DataFrame]) -> DataFrame:
    """Stored tables of one schema as one table: a single scan of their folders, so a plan doesn't grow with their number."""
    folders = sorted({file.rpartition("/")[0] for part in parts for file in part.inputFiles()}) if len(parts) > 1 else []
    return parts[0].sparkSession.read.schema(parts[0].schema).parquet(*folders) if folders else parts[0]


def let_go(spark: SparkSession) -> None:
    """Has the driver's JVM collect its garbage: shuffle files, broadcasts and plans of steps that are done go only when it does."""
    spark.sparkContext._jvm.System.gc()  # type: ignore[union-attr]
