"""Statements of documents and what RDFS makes of them, kept up to date by signed changes.

A log holds every change as rows with a sign: what a document says now less what it said before, and what follows from that. Under a closed schema
each RDFS consequence follows from one statement, so counting is exact: a fact holds while its signs sum to more than zero, and what a deletion takes
away is derived from the deleted statements alone. A round therefore reads the changed documents' earlier statements, found by buckets of their
paths, and the small schema; it writes the differences. Only a changed schema makes everything anew, and then only what differs is written.

Changes commute, so batches may be folded together at any time, and a batch that is repeated after a failure replaces its own rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.closure import transitive
from ..operators.inference import decoded, encoded
from ..operators.lineage import stored
from ..operators.rules import FACT, is_node
from ..plans.algebra import RDFS, TYPE
from .refresh import file_stream

SCHEMA = [RDFS + p for p in ("subClassOf", "subPropertyOf", "domain", "range")]
LOG = "path string, s string, p string, o string, o_kind string, o_dt string, o_lang string, sign long, batch string, layer string, bucket int"


class Log:
    """The log in a folder of the shared storage: (path, facts..., sign) by batch, layer and bucket."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 256) -> None:
        self.spark, self.folder, self.buckets = spark, folder, buckets

    def _exists(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)  # type: ignore[union-attr]
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def rows(self, layer: str, but: str = "") -> DataFrame:
        """A layer's rows, but for those of one batch."""
        if not self._exists():
            return self.spark.createDataFrame([], LOG)
        return self.spark.read.schema(LOG).option("basePath", self.folder).parquet(self.folder).where((F.col("layer") == layer) & (F.col("batch") != but))

    def append(self, rows: DataFrame, batch: str) -> None:
        """Writes a batch, in place of what it wrote before if it is repeated."""
        parts = rows.repartition("layer", "bucket").sortWithinPartitions("layer", "bucket", "path", "p")
        parts.drop("batch").write.mode("overwrite").partitionBy("layer", "bucket").parquet(f"{self.folder}/batch={batch}")

    def batches(self) -> list[str]:
        if not self._exists():
            return []
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)  # type: ignore[union-attr]
        found = fs_path.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(fs_path)
        return sorted(f.getPath().getName().removeprefix("batch=") for f in found if f.getPath().getName().startswith("batch="))

    def compact(self, into: Log) -> None:
        """All batches as one, in another folder, which readers turn to when it is whole; rows whose signs cancel are gone."""
        layers = [self.rows(layer) for layer in ("said", "schema", "fact")]
        into.append(netted(reduce(DataFrame.unionByName, layers).drop("batch")), "compacted")

    def bucket(self, column: str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(self.buckets)).cast("int")


def netted(rows: DataFrame) -> DataFrame:
    """Rows that agree in all but the sign as one with their sum, those of sum zero left out."""
    rest = [c for c in rows.columns if c != "sign"]
    return rows.groupBy(*rest).agg(F.sum("sign").alias("sign")).where("sign <> 0")


class Schema:
    """The RDFS schema, closed."""

    def __init__(self, facts: DataFrame) -> None:
        pairs = lambda p: facts.where((F.col("p") == p) & is_node()).select(F.col("s").alias("x"), F.col("o").alias("y")).distinct()
        self.sub_class, self.sub_property = transitive(pairs(RDFS + "subClassOf")), transitive(pairs(RDFS + "subPropertyOf"))
        self.domain, self.range = pairs(RDFS + "domain"), pairs(RDFS + "range")

    def own(self) -> DataFrame:
        """The closed hierarchies as facts."""
        parts = [d.select(F.col("x").alias("s"), F.lit(p).alias("p"), F.col("y").alias("o"), *self.plain()) for d, p in ((self.sub_class, RDFS + "subClassOf"), (self.sub_property, RDFS + "subPropertyOf"))]
        return parts[0].unionByName(parts[1]).withColumn("sign", F.lit(1).cast("long"))

    @staticmethod
    def plain() -> list:
        return [F.lit("node").alias("o_kind"), F.lit("").alias("o_dt"), F.lit("").alias("o_lang")]

    def follow(self, said: DataFrame) -> DataFrame:
        """Statements (facts..., sign) and all that follows from each, by itself, with its sign, as often as it follows."""
        over = self.sub_property.select(F.col("x").alias("p"), F.col("y").alias("q"))
        facts = said.select(*FACT, "sign").unionByName(said.join(over, "p").select("s", F.col("q").alias("p"), *FACT[2:], "sign"))
        typed = []
        for table, at in ((self.domain, "s"), (self.range, "o")):
            held = (facts if at == "s" else facts.where(is_node())).join(table.select(F.col("x").alias("p"), F.col("y").alias("class")), "p")
            typed.append(held.select(F.col(at).alias("s"), F.lit(TYPE).alias("p"), F.col("class").alias("o"), *self.plain(), "sign"))
        more = typed[0].unionByName(typed[1])
        types = more.unionByName(facts.where((F.col("p") == TYPE) & is_node()))
        above = types.join(self.sub_class.select(F.col("x").alias("o"), F.col("y").alias("up")), "o").select("s", "p", F.col("up").alias("o"), *FACT[3:], "sign")
        return facts.unionByName(more).unionByName(above)


def change(log: Log, paths: DataFrame, quads: DataFrame, batch: str) -> None:
    """The documents at ``paths`` say ``quads`` (path, s, s_kind, p, o, o_kind, o_dt, o_lang) from now on; those without any are gone.

    A document's repeated statements count once. Null paths are refused by the join and leave no trace.
    """
    spark = log.spark
    paths = paths.select("path").distinct().withColumn("bucket", log.bucket("path"))
    touched = [r["bucket"] for r in paths.select("bucket").distinct().collect()]
    before = log.rows("said", batch).where(F.col("bucket").isin(touched)).join(paths.select("path"), "path", "left_semi").select("path", *FACT, "sign")
    now = encoded(quads.join(paths.select("path"), "path", "left_semi"), ["path"]).distinct().withColumn("sign", F.lit(1).cast("long"))
    delta = stored(netted(now.unionByName(before.withColumn("sign", -F.col("sign")))), "delta")
    known = netted(log.rows("schema", batch).select(*FACT, "sign"))
    new_schema = delta.where(F.col("p").isin(SCHEMA))
    layers = [delta.withColumn("layer", F.lit("said")).withColumn("bucket", log.bucket("path"))]
    old = Schema(known)
    if new_schema.isEmpty():
        facts = old.follow(delta)
    else:
        layers.append(new_schema.withColumn("layer", F.lit("schema")).withColumn("bucket", F.lit(0)))
        new = Schema(netted(known.unionByName(new_schema.select(*FACT, "sign"))))
        all_before = netted(log.rows("said", batch).select("path", *FACT, "sign"))
        all_after = netted(all_before.unionByName(delta.select("path", *FACT, "sign")))
        less = lambda df: df.withColumn("sign", -F.col("sign"))
        facts = new.follow(all_after).unionByName(less(old.follow(all_before))).unionByName(new.own()).unionByName(less(old.own()))
    layers.append(netted(facts).withColumn("path", F.lit("")).withColumn("layer", F.lit("fact")).withColumn("bucket", log.bucket("s")))
    columns = ["path", *FACT, "sign", "layer", "bucket"]
    log.append(reduce(DataFrame.unionByName, [layer.select(*columns) for layer in layers]), batch)


def facts(log: Log) -> DataFrame:
    """(s, s_kind, p, o, o_kind, o_dt, o_lang): all that is said and follows, each once."""
    return decoded(netted(log.rows("fact").select(*FACT, "sign")).where("sign > 0"), [])


def said(log: Log) -> DataFrame:
    """(path, s, s_kind, p, ...): what each document says."""
    return decoded(netted(log.rows("said").select("path", *FACT, "sign")).where("sign > 0"), ["path"])


def paths_of(log: Log) -> DataFrame:
    return netted(log.rows("said").select("path", *FACT, "sign")).select("path").distinct()


def sync(log: Log, root: str, checkpoint: str, quads_of: Callable[[DataFrame], DataFrame], present: DataFrame) -> None:
    """Brings the log up to a folder: new and changed files by a stream, then those that ``present`` (path) no longer names as deletions."""

    def write(batch: DataFrame, number: int) -> None:
        change(log, batch, quads_of(batch), f"s{number:08d}")

    file_stream(log.spark, root).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    gone = paths_of(log).join(present.select("path"), "path", "left_anti")
    if not gone.isEmpty():
        number = sum(b.startswith("d") for b in log.batches())
        change(log, gone, log.spark.createDataFrame([], "path string, s string, s_kind string, p string, o string, o_kind string, o_dt string, o_lang string"), f"d{number:08d}")
