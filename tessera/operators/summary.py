"""Counts over a quad table, fingerprints and changed files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.algebra import TYPE


#: Longer texts are told apart by their MD5, 128 bits, when different ones are counted.
LONG = 32


def different(triples: DataFrame, columns: Sequence[str], text: str, name: str) -> DataFrame:
    """One row: how many different values the columns have; what is shuffled of a long text is its digest."""
    long = F.length(text) > LONG
    short = triples.select(*columns, long.alias("long"), F.when(long, F.md5(text)).otherwise(F.col(text)).alias("text"))
    return short.distinct().agg(F.count(F.lit(1)).alias(name))


def graph_stats(triples: DataFrame) -> DataFrame:
    """One row: triples, subjects, predicates, objects (of a set of triples). Each count is a pass of its own over the columns that it needs."""
    one = triples.agg(F.count(F.lit(1)).alias("triples"), F.count_distinct("p").alias("predicates"))
    subjects = different(triples, ["s_kind"], "s", "subjects")
    objects = different(triples, ["o_kind", "o_dt", "o_lang"], "o", "objects")
    return one.crossJoin(subjects).crossJoin(objects).select("triples", "subjects", "predicates", "objects")


def classes(triples: DataFrame, most: int = 25) -> DataFrame:
    """(iri, n): the classes with the most instances; ties by IRI."""
    found = triples.where((F.col("p") == TYPE) & (F.col("o_kind") == "iri")).groupBy(F.col("o").alias("iri")).agg(F.count(F.lit(1)).alias("n"))
    return found.orderBy(F.desc("n"), "iri").limit(most)


def predicates(triples: DataFrame, most: int = 50) -> DataFrame:
    """(iri, n): the predicates with the most triples; ties by IRI."""
    return triples.groupBy(F.col("p").alias("iri")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "iri").limit(most)


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change) between two manifests (path, mtime): added, removed or modified."""
    a, b = before.select("path", F.col("mtime").alias("old")), after.select("path", F.col("mtime").alias("new"))
    joined = a.join(b, "path", "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("modified")
    return joined.select("path", change.alias("change"))


def fingerprint(manifest: DataFrame, config: str = "") -> DataFrame:
    """One row (fingerprint): a hash of (path, size, mtime_ns) rows, whatever their order, and of a configuration.

    Rows are hashed first and the hashes summed, so that no task holds the whole manifest.
    """
    row = F.sha2(F.to_json(F.struct("path", "size", "mtime_ns")), 256)
    parts = [F.coalesce(F.sum(F.conv(F.substring(row, 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")), F.lit(0).cast("decimal(38,0)")).cast("string") for i in range(8)]
    return manifest.agg(F.sha2(F.concat_ws("|", F.count(F.lit(1)).cast("string"), *parts, F.lit(config)), 256).alias("fingerprint"))
