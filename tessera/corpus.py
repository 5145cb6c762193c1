"""The library's front door: a folder of documents that can be queried, checked, linted, linked and exported."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import names, results
from .operators import audits, documents, shacl, summary
from .operators.inference import inconsistencies, infer
from .operators.lineage import cut
from .plans.compiler import Compiler, Result
from .sources import corpus as source
from .sources.frontmatter import Config
from .sources.quads import Quads, default_union


@dataclass
class Corpus:
    """Files (path, suffix, text[, g]) under one configuration. Everything is computed when asked for."""

    spark: SparkSession
    files: DataFrame
    config: Config

    @classmethod
    def load(cls, spark: SparkSession, root: str, config: Config | None = None, exclude: list[str] | None = None, sources: Mapping[str, str] | None = None) -> Corpus:
        """The files below a root, and those of other sources (name: folder), whose statements are graphs of their own."""
        config = config or Config()
        files = source.scan(spark, root, exclude)
        if sources:
            graph = lambda name: names.source_graph(F.lit(name).cast("string"), config.base_iri)
            files = files.withColumn("g", graph(None))
            for name, folder in sources.items():
                files = files.unionByName(source.scan(spark, folder, exclude).withColumn("g", graph(name)))
        return cls(spark, files, config)

    def dataset(self, inference: bool = False) -> DataFrame:
        """Quads with their graphs; inference stays within each graph."""
        found = source.quads(self.files, self.config)
        return infer(found, per_graph=True) if inference else found

    def graph(self, inference: bool = False) -> DataFrame:
        """The union of all graphs as a set of triples; inference runs over the union."""
        found = default_union(source.quads(self.files, self.config))
        return infer(found) if inference else found

    def query(self, text: str, inference: bool = False) -> Result:
        """A SPARQL query; one that names graphs sees them apart, any other sees their union."""
        from .plans.parser import parse

        q = parse(text, self.config.namespaces, self.config.base_iri)
        apart = q.uses_graphs or q.named_graphs or q.default_graphs
        quads = self.dataset(inference) if apart else self.graph(inference).withColumn("g", F.lit(self.config.base_iri + "graphs/root"))
        return Compiler(self.spark, Quads(quads, distinct=not apart), self.config.namespaces, self.config.base_iri).run(q)

    def format(self, text: str, fmt: str = "table", inference: bool = False) -> str:
        return results.formatted(self.query(text, inference), fmt, self.config.namespaces, self.config.base_iri)

    def graphs(self) -> DataFrame:
        """(g, triples)."""
        return self.dataset().groupBy("g").agg(F.count(F.lit(1)).alias("triples"))

    def stats(self, inference: bool = False) -> DataFrame:
        return summary.graph_stats(self.graph(inference))

    def shacl(self) -> DataFrame:
        """Violations of the shapes in the data, after inference."""
        return shacl.validate(self.graph(inference=True))

    def shacl_documents(self) -> DataFrame:
        """(g, focus, ...): the violations of every document's own metadata, each taken by itself, under all shapes of the corpus."""
        told = self.document_quads().drop("g").withColumnRenamed("route", "g")
        return shacl.validate_documents(infer(told, per_graph=True), self.graph())

    def inconsistencies(self) -> DataFrame:
        """(rule, s, detail) of what can't be true together."""
        return inconsistencies(self.graph())

    def links(self) -> DataFrame:
        return documents.links(self.files)

    def broken_links(self) -> DataFrame:
        routes = self.files.select(documents.route(F.col("path")).alias("route"))
        return documents.broken_links(self.links(), routes, documents.headings(self.files).select("route", "slug"))

    def suggestions(self) -> DataFrame:
        """Mentions that could be links, by page and place."""
        return documents.suggest_links(self.files, documents.aliases(documents.titles(self.files))).orderBy("source_route", "line", "column")

    def fixes(self, renames: dict[str, str] | None = None) -> DataFrame:
        return documents.fix_links(self.broken_links(), self.files.select(documents.route(F.col("path")).alias("route")), renames)

    def fixed(self, renames: dict[str, str] | None = None) -> DataFrame:
        """(path, text) of the pages whose broken links have one sensible page or heading, with these links mended."""
        broken = cut(self.broken_links())
        routes = documents.fix_links(broken, self.files.select(documents.route(F.col("path")).alias("route")), renames)
        heads = documents.fix_headings(broken, documents.headings(self.files).select("route", "slug"))
        edits = audits.fix_edits(self.files, routes).unionByName(audits.heading_edits(self.files, heads))
        return documents.apply_edits(self.files, edits)

    def check(self, schemas: DataFrame | None = None, others: DataFrame | None = None, folders: Sequence[str] = (), wanted: DataFrame | None = None) -> DataFrame:
        """(code, route, message) of what makes a corpus invalid.

        ``schemas`` (path, text) are JSON Schemas that metadata may name, ``others`` (path) all other files of the root, ``folders`` the
        asset folders among them, ``wanted`` (path) the files to look at.
        """
        none = self.files.limit(0)
        schemas = none.select("path", "text") if schemas is None else schemas
        return audits.check(self.documents, self.config, self.shacl(), schemas, none.select("path") if others is None else others, folders, wanted)

    @property
    def documents(self) -> DataFrame:
        """The files that are no plain RDF."""
        return self.files.where(~F.col("suffix").isin(*source.RDF_SUFFIXES))

    def lint(self, filename_pattern: str = r"[^\s]+", others: DataFrame | None = None, folders: Sequence[str] = (), wanted: DataFrame | None = None) -> DataFrame:
        """(code, route, line, message) of what could be written better."""
        return audits.lint(self.documents, self.files.limit(0).select("path") if others is None else others, folders, filename_pattern, wanted)

    def preflight(self, checked: DataFrame, linted: DataFrame, **severities) -> DataFrame:
        """(stage, code, severity, n) of what ``check`` and ``lint`` found, and of query tables that are out of date."""
        return audits.preflight(checked, linted, self.rendered(), **severities)

    def rendered(self, inference: bool = False) -> DataFrame:
        """(path, text) of the pages whose query tables are out of date, with the tables as they should be.

        Each different query runs once; their number, and the tables, are what a page shows, not the data's size.
        """
        asked = [r["query"] for r in documents.query_blocks(self.documents).select("query").distinct().collect()]
        routes = {r["route"] for r in self.documents.where(~F.col("path").contains("/")).select(documents.route(F.col("path")).alias("route")).collect()} if asked else set()
        tables = {}
        for text in asked:
            names, rows = results.plain_rows(self.query(text, inference))
            tables[text] = results.markdown_table(names, rows, self.config.base_iri, routes)
        return documents.render_blocks(self.documents, tables)

    def document_quads(self) -> DataFrame:
        """(route, g, s, ...): what each document says, each statement once."""
        graph, config = self.config.base_iri.rstrip("/") + "/graphs/root", self.config
        schema = "route string, g string, s string, s_kind string, p string, o string, o_kind string, o_dt string, o_lang string"
        told = source.flat_map(self.documents.select("path", "suffix", "text"), schema, lambda path, suffix, text: [(source.frontmatter.route_of(path), *q) for q in source.file_quads(path, suffix, text, graph, config)[0]])
        return told.distinct()

    def export_documents(self, fmt: str = "nquads") -> DataFrame:
        """(route, text): each document's own statements in a format of triples or quads, written where the document is read."""
        config, fmt = self.config, results.format_name(fmt)
        quads = self.document_quads()
        if fmt in ("nt", "nquads"):
            lines = quads.select("route", results.line_column(graph=fmt == "nquads").alias("line")).distinct()
            return lines.groupBy("route").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("text"))
        write = {"turtle": results.turtle_rows, "trig": results.trig_rows, "xml": results.xml_rows, "json-ld": results.json_ld_rows}[fmt]
        # A group is what one document says.
        rows = quads.groupBy("route").agg(F.collect_list(F.struct(*quads.columns[1:])).alias("rows"))
        return source.flat_map(rows, "route string, text string", lambda route, found: [(route, write(found, config.namespaces))])

    def write(self, path: str, fmt: str = "nquads", inference: bool = False) -> None:
        """All statements as N-Triples or N-Quads files, a part per partition, without a way through the driver."""
        fmt = results.format_name(fmt)
        if fmt not in ("nt", "nquads"):
            raise ValueError("only formats of a line per statement are written in parts")
        results.write_lines(self.dataset(inference) if fmt == "nquads" else self.graph(inference), path, graph=fmt == "nquads")

    def export(self, fmt: str = "json-ld", inference: bool = False) -> str:
        triples = self.graph(inference)
        fmt = results.format_name(fmt)
        if fmt in ("nt", "nquads"):
            return "\n".join(sorted(r["line"] for r in triples.select(results.line_column().alias("line")).collect()))
        if fmt == "trig":
            return results.trig_rows(self.dataset(inference).collect(), self.config.namespaces)
        return {"json-ld": results.json_ld_rows, "xml": results.xml_rows}.get(fmt, results.turtle_rows)(triples.collect(), self.config.namespaces)
