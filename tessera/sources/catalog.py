"""Quad stores on disk, kept by the fingerprint of the files that they were made from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.summary import fingerprint
from . import quads as store


def manifest(files: DataFrame) -> DataFrame:
    """(path, size, mtime_ns) of scanned files."""
    return files.select("path", "size", (F.unix_micros(F.col("mtime").cast("timestamp")) * 1000).alias("mtime_ns"))


def cached(files: DataFrame, folder: str, config: str, build: Callable[[], DataFrame], kind: str = "asserted") -> DataFrame:
    """The quads that ``build`` gives, from ``folder`` if files and configuration are what they were; else built and kept."""
    spark = files.sparkSession
    key = fingerprint(manifest(files), config).first()["fingerprint"]
    path = f"{folder.rstrip('/')}/{kind}-{key}"
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")):
        store.write(build(), path)
        for other in system.listStatus(jvm.org.apache.hadoop.fs.Path(folder)):
            name = other.getPath().getName()
            if name.startswith(f"{kind}-") and name != f"{kind}-{key}":
                system.delete(other.getPath(), True)
    return store.read(spark, path)
