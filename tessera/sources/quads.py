"""A table of quads (g, s, s_kind, p, o, o_kind, o_dt, o_lang) as a dataset, and writing one partitioned by predicate."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import stored
from ..plans.algebra import Iri, Literal, Term, Var
from ..plans.bindings import IRI, TERM_KIND, Kind, Rel, as_kind, name

COLUMNS = ("g", "s", "s_kind", "p", "o", "o_kind", "o_dt", "o_lang")
#: Spark leaves folders of such names out when it reads a table.
STATISTICS = "/_statistics"
SCHEMA = "g string, s string, s_kind string, p string, o string, o_kind string, o_dt string, o_lang string"


def from_rel(rel: Rel, s: str, p: str, o: str, graph: str) -> DataFrame:
    """Quads of a predicate from solutions."""
    return (
        rel.df.select(as_kind(rel.value(s), Kind("term")).alias("a"), as_kind(rel.value(o), Kind("term")).alias("b"))
        .select(F.lit(graph).alias("g"), F.col("a.lex").alias("s"), F.col("a.k").alias("s_kind"), F.lit(p).alias("p"), F.col("b.lex").alias("o"), F.col("b.k").alias("o_kind"), F.col("b.dt").alias("o_dt"), F.col("b.lang").alias("o_lang"))
    )


def default_union(quads: DataFrame) -> DataFrame:
    """The union of all graphs as a set of triples."""
    return quads.drop("g").distinct()


def write(quads: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """Stores the different quads by predicate, so that a pattern with a given predicate reads its files alone, with statistics beside them.

    Ranges of (p, s, o) are dealt to tasks: a predicate with many triples is written by many, near subjects stand in one file, and a subject with
    many triples of a predicate is split as well. The statistics are a row per predicate: triples, subjects and objects (the last two estimated), and
    whether a triple stands in several graphs.
    """
    found = stored(quads.select(*COLUMNS).distinct(), "quads")
    triples = found.groupBy(*(c for c in COLUMNS if c != "g")).agg(F.count(F.lit(1)).alias("graphs"))
    statistics = triples.groupBy("p").agg(F.sum("graphs").alias("rows"), F.approx_count_distinct("s").alias("subjects"), F.approx_count_distinct(F.struct("o", "o_kind", "o_dt", "o_lang")).alias("objects"), (F.max("graphs") > 1).alias("repeated"))
    order = [F.col("p"), F.col("s"), F.col("o")]
    ranged = found.repartitionByRange(-(-found.count() // rows_per_file) or 1, *order).sortWithinPartitions(*order)
    ranged.write.mode("overwrite").partitionBy("p").parquet(path)
    statistics.write.mode("overwrite").parquet(path.rstrip("/") + STATISTICS)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(*COLUMNS)


def opened(spark: SparkSession, path: str) -> Quads:
    """A stored table as a dataset that knows its statistics."""
    return Quads(read(spark, path), statistics=spark.read.parquet(path.rstrip("/") + STATISTICS))


class Quads:
    """A dataset over a quad table.

    ``distinct`` says that the triples are a set whatever their graphs; ``statistics`` (p, rows, subjects, objects, repeated) come with a stored table.
    """

    def __init__(self, quads: DataFrame, default_graphs: list[str] | None = None, named_graphs: list[str] | None = None, *, distinct: bool = False, statistics: DataFrame | None = None) -> None:
        self.spark, self.df = quads.sparkSession, quads
        self.default_graphs, self.named_graphs = default_graphs, named_graphs
        self.distinct, self.statistics = distinct, statistics
        self._known: dict[str | None, dict] = {}

    def restricted(self, default: list[str], named: list[str]) -> Quads:
        return Quads(self.df, default, named, distinct=self.distinct, statistics=self.statistics)

    def known(self, p: str | None) -> dict:
        """The statistics of a predicate, or of all together; a query asks for those that it names, so not all reach the driver."""
        if p not in self._known:
            assert self.statistics is not None
            rows = self.statistics if p is None else self.statistics.where(F.col("p") == p)
            self._known[p] = rows.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum("subjects"), F.lit(0)).alias("subjects"), F.coalesce(F.sum("objects"), F.lit(0)).alias("objects"), F.coalesce(F.max("repeated"), F.lit(False)).alias("repeated")).head().asDict()
        return self._known[p]

    def is_set(self, p: Term, allowed: list[str] | None) -> bool:
        """Whether a pattern's triples stand once each without their graphs."""
        if self.distinct or (self.statistics is not None and allowed is not None and len(allowed) <= 1):
            return True
        return self.statistics is not None and not self.known(p.value if isinstance(p, Iri) else None)["repeated"]

    def star(self, subject: Term, pairs: list[tuple[Term, Term]], graph: Term | None, known: dict[str, Kind] | None = None) -> Rel:
        from ..plans.bindings import join

        out = None
        for p, o in pairs:
            rel = self._scan(subject, p, o, graph)
            out = rel if out is None else join(out, rel)
        return out

    def _scan(self, s: Term, p: Term, o: Term, graph: Term | None) -> Rel:
        df = self.df
        allowed = self.default_graphs if graph is None else self.named_graphs
        if allowed is not None:
            df = df.where(F.col("g").isin(allowed))
        if isinstance(graph, Iri):
            df = df.where(F.col("g") == graph.value)
        if isinstance(p, Iri):
            df = df.where(F.col("p") == p.value)
        if isinstance(s, Iri):
            df = df.where((F.col("s") == s.value) & (F.col("s_kind") == "iri"))
        if isinstance(o, Iri):
            df = df.where((F.col("o") == o.value) & (F.col("o_kind") == "iri"))
        elif isinstance(o, Literal):
            df = df.where((F.col("o") == o.value) & (F.col("o_kind") == "literal") & (F.col("o_dt") == o.datatype) & (F.col("o_lang") == o.lang))
        if graph is None:
            df = df.drop("g") if self.is_set(p, allowed) else df.drop("g").distinct()
        subject = F.struct(F.col("s_kind").alias("k"), F.col("s").alias("lex"), F.lit("").alias("dt"), F.lit("").alias("lang"))
        obj = F.struct(F.col("o_kind").alias("k"), F.col("o").alias("lex"), F.col("o_dt").alias("dt"), F.col("o_lang").alias("lang"))
        columns, kinds = {}, {}
        for t, column, kind in ((s, subject, TERM_KIND), (p, F.col("p"), IRI), (o, obj, TERM_KIND), (graph, F.col("g"), IRI)):
            if isinstance(t, Var):
                if t.name in columns:
                    same = columns[t.name] == column if kinds[t.name] == kind else F.lit(False)
                    df = df.where(same)
                else:
                    columns[t.name], kinds[t.name] = column, kind
        return Rel(df.select(*(c.alias(name(v)) for v, c in columns.items())) if columns else df.select(F.lit(1).alias("one")), kinds)

    def size_hint(self, subject: Term, pairs: list[tuple[Term, Term]]) -> int:
        """Less for patterns that are likely to have fewer solutions: by the statistics, where there are some, four for each power of ten."""
        if self.statistics is None:
            return 10 * isinstance(subject, Var) - 3 * sum(not isinstance(o, Var) for _, o in pairs) + sum(isinstance(p, Var) for p, _ in pairs) * 20
        found = []
        for p, o in pairs:
            known = self.known(p.value if isinstance(p, Iri) else None)
            n = float(known["rows"])
            n /= 1 if isinstance(subject, Var) else max(1, known["subjects"])
            found.append(n if isinstance(o, Var) else n / max(1, known["objects"]))
        return int(4 * math.log10(1 + min(found)))

    def quads(self) -> DataFrame:
        return self.df
