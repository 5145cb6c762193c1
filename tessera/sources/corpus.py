"""A folder of documents and RDF files as DataFrames of texts, quads, metadata, headings and links."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from . import frontmatter, rdf
from .frontmatter import Config
from .quads import SCHEMA

RDF_SUFFIXES = (".ttl", ".trig", ".nt", ".nq", ".rdf", ".xml", ".jsonld")


def flat_map(df: DataFrame, schema: str, rows: Callable[..., list[tuple]]) -> DataFrame:
    """``rows(*values)`` for each row of ``df``, Arrow batch by batch."""
    parsed = _parse_datatype_string(schema)
    assert isinstance(parsed, StructType)
    arrow = to_arrow_schema(parsed)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                out = [row for values in zip(*(c.to_pylist() for c in part.columns), strict=True) for row in rows(*values)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    return df.mapInArrow(work, schema)


def excluded(path_column, patterns: list[str]):
    """Whether a root-relative path matches one of some globs, in which * crosses slashes."""
    found = F.lit(False)
    for pattern in patterns:
        found = found | path_column.rlike("^" + fnmatch.translate(pattern).replace("\\Z", "").replace("\\z", "").removeprefix("(?s:").removesuffix(")") + "$")
    return found


def below(root: str) -> Column:
    """A file's path relative to a root, which may be given with or without its file system, whatever characters it holds."""
    inner = "/" + (root.partition(":")[2] if re.match(r"\w+:", root) else root).strip("/") + "/"
    # Spark gives paths with blanks and such encoded, but leaves a plus sign as it is.
    full = F.expr("url_decode(replace(_metadata.file_path, '+', '%2B'))")
    at = F.instr(full, inner)
    return F.when(at > 0, F.substring(full, at + len(inner), F.lit(2**31 - 1))).otherwise(full)


def scan(spark: SparkSession, root: str, exclude: list[str] | None = None) -> DataFrame:
    """(path, suffix, text, size, mtime) of every document and RDF file below a root, paths relative to it."""
    texts = spark.read.text(root, wholetext=True, recursiveFileLookup=True)
    name = F.col("_metadata.file_path")
    files = texts.select(below(root).alias("path"), F.lower(F.regexp_extract(name, r"(\.[^./]*)$", 1)).alias("suffix"), F.col("value").alias("text"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("mtime"))
    kept = files.where(F.col("suffix").isin([*frontmatter.DOCUMENTS, *RDF_SUFFIXES]))
    return kept.where(~excluded(F.col("path"), exclude or []))


def quads(files: DataFrame, config: Config, graph: str = "") -> DataFrame:
    """Quads of (path, suffix, text[, g]) files; those that can't be read are left out (see ``warnings``)."""
    graph = graph or config.base_iri.rstrip("/") + "/graphs/root"
    with_graph = files if "g" in files.columns else files.withColumn("g", F.lit(graph))
    lines = with_graph.where(F.col("suffix").isin(".nt", ".nq")).select("g", F.explode(F.split("text", "\r?\n")).alias("value"))
    native = rdf.line_quads(lines, graph)
    parsed = flat_map(with_graph.where(~F.col("suffix").isin(".nt", ".nq")).select("path", "suffix", "text", "g"), SCHEMA, lambda p, s, t, g: file_quads(p, s, t, g, config)[0])
    return native.unionByName(parsed)


def warnings(files: DataFrame, config: Config) -> DataFrame:
    """(path, message) of files that could not be read, in whole or in part."""
    return flat_map(files.where(~F.col("suffix").isin(".nt", ".nq")).select("path", "suffix", "text"), "path string, message string", lambda p, s, t: [(p, w) for w in file_quads(p, s, t, "", config)[1]])


def file_quads(path: str, suffix: str, text: str, graph: str, config: Config) -> tuple[list, list[str]]:
    if suffix in frontmatter.DOCUMENTS:
        return frontmatter.document_quads(path, text, config, graph)
    try:
        return rdf.parse_text(text, suffix, graph, path, config.namespaces), []
    except Exception as e:  # a broken file is skipped, whatever its parser says
        return [], [f"{path}: {e}"]


def metadata_rows(files: DataFrame) -> DataFrame:
    """(route, key_path, value, value_type) of every metadata value, typed as its format has it."""

    def rows(path: str, text: str) -> list[tuple]:
        data, _ = frontmatter.metadata(path, text)
        return [(frontmatter.route_of(path), *r) for r in frontmatter.typed_rows(data)] if data else []

    return flat_map(files.select("path", "text"), "route string, key_path string, value string, value_type string", rows)
