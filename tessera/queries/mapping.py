"""The tables as RDF: one class, one named graph and one IRI template each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans.compiler import Compiler, Result
from ..sources.tables import Field, Table, Tables

EX = "http://example.org/"
NAMESPACES = {"ex": EX, "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "rdfs": "http://www.w3.org/2000/01/rdf-schema#", "owl": "http://www.w3.org/2002/07/owl#", "xsd": "http://www.w3.org/2001/XMLSchema#", "sh": "http://www.w3.org/ns/shacl#", "schema": "https://schema.org/"}

#: table: (key column, class, {predicate: column or (column, referenced table)})
MODEL: dict[str, tuple[str, str, dict[str, str | tuple[str, str]]]] = {
    "region": ("r_regionkey", "Region", {"name": "r_name"}),
    "nation": ("n_nationkey", "Nation", {"name": "n_name", "region": ("n_regionkey", "region")}),
    "customer": ("c_custkey", "Customer", {"name": "c_name", "nation": ("c_nationkey", "nation"), "balance": "c_acctbal", "segment": "c_mktsegment"}),
    "supplier": ("s_suppkey", "Supplier", {"name": "s_name", "nation": ("s_nationkey", "nation"), "balance": "s_acctbal"}),
    "part": ("p_partkey", "Part", {"name": "p_name", "brand": "p_brand", "partType": "p_type", "size": "p_size", "retailPrice": "p_retailprice"}),
    "orders": ("o_orderkey", "Order", {"customer": ("o_custkey", "customer"), "status": "o_orderstatus", "totalPrice": "o_totalprice", "date": "o_orderdate", "priority": "o_orderpriority"}),
    "events": ("event_id", "Event", {"user": "user_id", "time": "ts", "eventType": "event_type", "value": "value", "props": "props"}),
    "documents": ("doc_id", "Document", {"text": "text", "language": "lang", "source": "source", "chars": "n_chars"}),
    "pages": ("page_id", "Page", {"url": "url", "html": "html"}),
}
TEMPLATES = {t: f"{EX}{'order' if t == 'orders' else t.rstrip('s') if t in ('events', 'documents', 'pages') else t}/" for t in MODEL}
GRAPHS = {t: f"{EX}graphs/source/{t}" for t in MODEL}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dataset(spark: SparkSession, sf_dir: str) -> Tables:
    tables = []
    for name, (key, kind, fields) in MODEL.items():
        columns = {EX + p: Field(c) if isinstance(c, str) else Field(c[0], TEMPLATES[c[1]]) for p, c in fields.items()}
        tables.append(Table(table(spark, sf_dir, name), key, TEMPLATES[name], EX + kind, GRAPHS[name], columns))
    return Tables(spark, tables)


def ask(spark: SparkSession, sf_dir: str, question: str) -> Result:
    return Compiler(spark, dataset(spark, sf_dir), NAMESPACES, EX).query(question)
