"""Helpers that the operators of this folder share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that an operator takes from an Arrow batch at a time, so that long texts stay few in memory.
SLICE_ROWS = 256
#: Rows of a file of a checkpoint whose size is known, and files that are always allowed.
FILE_ROWS = 100_000
LEAST_FILES = 8
#: Text bytes that an operator takes from an Arrow batch at a time.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only where that is unset, on one machine, a temporary folder."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local[") and context.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back; cuts its lineage.

    Where its ``rows`` are known, about, a small table is written in few files, whatever the number of shuffle partitions.
    """
    shared_folder(df.sparkSession)
    return (df if rows is None else df.coalesce(max(LEAST_FILES, -(-rows // FILE_ROWS)))).checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, for wide rows; cuts its lineage."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def let_go(spark: SparkSession) -> None:
    """Has the driver's JVM collect its garbage: shuffle files, broadcasts and checkpoints of steps that are done go only when it does."""
    spark.sparkContext._jvm.System.gc()  # type: ignore[union-attr]


def kept_rows(df: DataFrame, keeps: Callable[[Iterator[str]], Iterator[bool]], text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text ``keeps`` says to keep; it gets a partition's texts, null as empty."""
    at = df.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, at):
            yield piece.filter(pa.array(keeps(text or "" for text in piece.column(at).to_pylist()), pa.bool_()))

    return df.mapInArrow(work, df.schema)


def keyed_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Two columns only, so that columns with clashing names can't disturb; a null text counts as empty."""
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def slices(batches: Iterator[pa.RecordBatch], text_at: int = 1) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a slice has few rows and, but for single long rows, few bytes."""
    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        lengths = pa.compute.binary_length(batch.column(text_at)).to_pylist()
        start = held = 0
        for row, size in enumerate(lengths):
            size = size or 0
            if row > start and (row - start >= SLICE_ROWS or held + size > SLICE_BYTES):
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += size
        yield batch.slice(start, rows - start)


def per_text(docs: DataFrame, schema: str, rows_of: Callable[[int, str], list[tuple]], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``rows_of(doc_id, text)`` for each row, Arrow batch by Arrow batch; ``schema`` names the columns it gives."""
    return arrow_rows(keyed_text(docs, id_col, text_col), schema, lambda part: (row for doc_id, text in part for row in rows_of(doc_id, text)))


def arrow_rows(df: DataFrame, schema: str, run: Callable[[Iterator[tuple]], Iterator[tuple]], text_at: int = 1) -> DataFrame:
    """``run`` over the rows of a partition, as tuples, gathered into Arrow batches again."""
    arrow = arrow_schema(df.sparkSession, schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for piece in slices(batches, text_at):
                yield from zip(*(column.to_pylist() for column in piece.columns), strict=True)

        yield from gathered(run(rows()), arrow)

    return df.mapInArrow(work, schema)


def gathered(rows: Iterator[tuple], arrow: pa.Schema, most: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, (str, bytes)))
        if len(held) >= most or size > SLICE_BYTES:
            yield record_batch(held, arrow)
            held, size = [], 0
    if held:
        yield record_batch(held, arrow)


def record_batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    columns: list[Any] = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)


def arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    parsed = _parse_datatype_string(schema)
    assert isinstance(parsed, StructType)
    return to_arrow_schema(parsed)
