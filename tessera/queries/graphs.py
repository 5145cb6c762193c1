"""Inference, validation, counts, dependencies and refreshing: queries over quads made from the tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import closure, shacl, summary
from ..operators.inference import infer
from ..operators.lineage import put, scratch
from ..plans.algebra import RDFS, TYPE, XSD
from ..sources import catalog
from ..sources.quads import SCHEMA
from ..sources.rdf import Turtle
from ..streaming import refresh
from .mapping import EX, MODEL, NAMESPACES, dataset, table

HEAD = "".join(f"@prefix {p}: <{ns}> .\n" for p, ns in NAMESPACES.items())


def schema_quads(spark: SparkSession, text: str, graph: str = "tbox") -> DataFrame:
    return spark.createDataFrame(Turtle(HEAD + text, graph).read(), SCHEMA)


def facts(df: DataFrame, s: Column, p: str, o: Column, kind: str = "iri", dt: str = "", graph: str = "data") -> DataFrame:
    iri = lambda c: F.concat(F.lit(EX), c)
    return df.select(F.lit(graph).alias("g"), iri(s).alias("s"), F.lit("iri").alias("s_kind"), F.lit(p).alias("p"), (iri(o) if kind == "iri" else o.cast("string")).alias("o"), F.lit(kind).alias("o_kind"), F.lit(dt).alias("o_dt"), F.lit("").alias("o_lang"))


def key(prefix: str, column: str) -> Column:
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def all_of(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def inferred(spark: SparkSession, data: list[DataFrame], tbox: str, per_graph: bool = False) -> DataFrame:
    return infer(all_of(*data, schema_quads(spark, tbox)), per_graph)


def typed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return facts(p, key("part/", "p_partkey"), TYPE, F.replace(F.col("p_type"), F.lit(" "), F.lit("_")))


def infer_subclass(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    data = facts(p, key("part/", "p_partkey"), TYPE, key("Size", "p_size"))
    tbox = "".join(f"ex:Size{n} rdfs:subClassOf ex:{'Small' if n <= 25 else 'Large'} .\n" for n in range(1, 51)) + "ex:Small rdfs:subClassOf ex:Item . ex:Item owl:equivalentClass ex:Thing ."
    return inferred(spark, [data], tbox).where((F.col("p") == TYPE) & F.col("s").startswith(EX + "part/")).groupBy(F.col("o").alias("class")).agg(F.count(F.lit(1)).alias("n"))


def nation_facts(spark: SparkSession, sf_dir: str, graph: str = "data") -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return facts(n, key("nation/", "n_nationkey"), EX + "region", key("region/", "n_regionkey"), graph=graph)


def infer_subproperty(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = inferred(spark, [nation_facts(spark, sf_dir)], "ex:region rdfs:subPropertyOf ex:within . ex:within owl:equivalentProperty ex:inside .")
    return found.where(F.col("p").isin(EX + "within", EX + "inside")).select("s", "p", "o")


def infer_domain_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = inferred(spark, [nation_facts(spark, sf_dir)], "ex:region rdfs:domain ex:Country ; rdfs:range ex:Continent . ex:Country rdfs:subClassOf ex:Place .")
    return found.where(F.col("p") == TYPE).select("s", "o")


def infer_inverse_symmetric(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    near = facts(n, key("nation/", "n_nationkey"), EX + "near", F.concat(F.lit("nation/"), (F.col("n_nationkey") + 1).cast("string")))
    found = inferred(spark, [nation_facts(spark, sf_dir), near], "ex:region owl:inverseOf ex:holds . ex:near a owl:SymmetricProperty .")
    return found.where(F.col("p").isin(EX + "near", EX + "holds")).select("s", "p", "o")


def infer_transitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cycle and tails: k leads to (3 k + 1) modulo 25."""
    n = table(spark, sf_dir, "nation")
    edge = facts(n, key("n", "n_nationkey"), EX + "next", F.concat(F.lit("n"), ((F.col("n_nationkey") * 3 + 1) % 25).cast("string")))
    return inferred(spark, [edge], "ex:next a owl:TransitiveProperty .").where(F.col("p") == EX + "next").select("s", "o")


def infer_sameas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations with one code are one: the code is an inverse functional property."""
    n = table(spark, sf_dir, "nation")
    code = facts(n, key("nation/", "n_nationkey"), EX + "code", F.concat(F.lit("code/"), (F.col("n_nationkey") % 20).cast("string")))
    found = inferred(spark, [code, nation_facts(spark, sf_dir)], "ex:code a owl:InverseFunctionalProperty .")
    return found.where(F.col("p") == EX + "region").select("s", "o")


def infer_restrictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    tbox = "ex:Central owl:onProperty ex:region ; owl:hasValue <http://example.org/region/2> . ex:InPlace owl:onProperty ex:region ; owl:someValuesFrom ex:Named . <http://example.org/region/1> a ex:Named . ex:Both owl:intersectionOf ( ex:Upper ex:Lower ) . <http://example.org/region/3> a ex:Both ."
    return inferred(spark, [nation_facts(spark, sf_dir)], tbox).where((F.col("p") == TYPE) & F.col("s_kind").isin("iri")).select("s", "o")


def infer_per_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schema stands in one of two graphs, so only that graph's facts are expanded."""
    a, b = nation_facts(spark, sf_dir, "tbox"), nation_facts(spark, sf_dir, "other")
    found = inferred(spark, [a, b], "ex:region rdfs:subPropertyOf ex:within .", per_graph=True)
    return found.groupBy("g", "p").agg(F.count(F.lit(1)).alias("n"))


def gapped_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with gaps: every eleventh lacks its customer, every thirteenth has a second one, every seventh a price that is none."""
    o = table(spark, sf_dir, "orders")
    me = key("order/", "o_orderkey")
    price = F.when(F.col("o_orderkey") % 7 == 0, F.lit("much")).otherwise(F.col("o_totalprice").cast("string"))
    return all_of(
        facts(o, me, TYPE, F.lit("Order")),
        facts(o.where("o_orderkey % 11 <> 0"), me, EX + "customer", key("customer/", "o_custkey")),
        facts(o.where("o_orderkey % 13 = 0"), me, EX + "customer", F.lit("customer/extra")),
        facts(o, me, EX + "price", price, "literal", XSD + "double"),
        facts(o, me, EX + "status", F.col("o_orderstatus"), "literal", XSD + "string"),
    )


def shacl_report(shape: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        text = f"ex:Shape a sh:NodeShape ; sh:targetClass ex:Order ; {shape} ."
        return shacl.validate(gapped_orders(spark, sf_dir).drop("g"), schema_quads(spark, text).drop("g")).select("focus", "component", "value", "message")

    return run


def shacl_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose customer has no name, and those that neither a customer nor a status leads anywhere from."""
    names = facts(table(spark, sf_dir, "customer"), key("customer/", "c_custkey"), EX + "name", F.col("c_name"), "literal", XSD + "string")
    shape = "sh:property [ sh:path ( ex:customer ex:name ) ; sh:minCount 1 ; sh:message \"sequence\" ] ; sh:property [ sh:path [ sh:alternativePath ( ex:customer [ sh:inversePath ex:none ] ) ] ; sh:minCount 1 ; sh:message \"alternative\" ]"
    text = f"ex:Shape a sh:NodeShape ; sh:targetClass ex:Order ; {shape} ."
    return shacl.validate(all_of(gapped_orders(spark, sf_dir), names).drop("g"), schema_quads(spark, text).drop("g")).select("focus", "component", "message")


ORDER = f"concat('{EX}order/', o_orderkey)"
FEW = "FROM orders WHERE true"


def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A row's key and a column's predicate are unique, so the triples are a set already.
    return summary.graph_stats(dataset(spark, sf_dir).quads().drop("g"))


def mapped_sql() -> str:
    """Predicate, object and its kind of every mapped column, and the rows' types, of all tables."""
    parts = []
    for name, (_, kind, fields) in MODEL.items():
        parts.append(f"SELECT '{TYPE}' AS p, 'class {kind}' AS o FROM {name}")
        for predicate, column in fields.items():
            own = column if isinstance(column, str) else column[0]
            shown = f"concat('{column[1]} ', {own})" if not isinstance(column, str) else f"concat(replace(typeof({own}), 'BIGINT', 'INTEGER'), ' ', {own})"
            parts.append(f"SELECT '{EX}{predicate}', {shown} FROM {name} WHERE {own} IS NOT NULL")
    return " UNION ALL ".join(parts)


def manifests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, sf_dir, "part").select(key("p", "p_partkey").alias("path"), F.col("p_partkey").alias("k"), F.col("p_size").cast("long").alias("mtime"))
    return p.where("k % 10 <> 1"), p.where("k % 10 <> 2").withColumn("mtime", F.when(F.col("k") % 10 == 3, F.col("mtime") + 1).otherwise(F.col("mtime")))


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = manifests(spark, sf_dir)
    shaped = lambda df: df.select("path", F.lit(1).cast("long").alias("size"), F.col("mtime").alias("mtime_ns"))
    one, again, other = (summary.fingerprint(x) for x in (shaped(a), shaped(a).repartition(3), shaped(b)))
    return one.select(F.lit("same").alias("pair"), F.col("fingerprint").alias("f")).join(again, F.col("f") == F.col("fingerprint")).select("pair").unionByName(one.select(F.lit("other").alias("pair"), F.col("fingerprint").alias("f")).join(other, F.col("f") != F.col("fingerprint")).select("pair"))


def needs(spark: SparkSession, sf_dir: str, cyclic: bool = False) -> DataFrame:
    """(x, y): part k needs part k // 3, but part 0, the root, needs none; with cycles, 7 also needs 65."""
    p = table(spark, sf_dir, "part").where("p_partkey > 0").select(F.col("p_partkey").alias("x"), F.floor(F.col("p_partkey") / 3).alias("y"))
    return p.unionByName(spark.createDataFrame([(7, 65)], "x long, y long")) if cyclic else p


def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = needs(spark, sf_dir)
    roots = spark.createDataFrame([(150,), (77,)], "x long")
    return closure.orphans(edges.select("x").unionByName(edges.select(F.col("y").alias("x"))), edges, roots)


def stream_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rounds of files through the stream; the second replaces a page of the first."""
    from ..sources import corpus
    from .texts import CONFIG, nation_pages

    folder = scratch(spark, "stream")
    rows = nation_pages(spark, sf_dir).collect()

    def rows_of(batch: DataFrame) -> DataFrame:
        return corpus.flat_map(batch.select("path", "suffix", "text"), "path string, s string, p string, o string", lambda p, s, t: [(p, q[1], q[3], q[4]) for q in corpus.file_quads(p, s, t, "g", CONFIG)[0]])

    for r in rows[:-1]:
        put(spark, f"{folder}/in/{r['path']}", r["text"])
    refresh.refresh(spark, f"{folder}/in", f"{folder}/table", f"{folder}/state", rows_of)
    put(spark, f"{folder}/in/{rows[-1]['path']}", rows[-1]["text"])
    refresh.refresh(spark, f"{folder}/in", f"{folder}/table", f"{folder}/state", rows_of)
    return refresh.current(spark, f"{folder}/table").where(F.col("p") == "https://schema.org/name").select("path", "o")


def disk_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quad store built once and then read."""
    folder = scratch(spark, "cache")
    files = table(spark, sf_dir, "nation").select(key("n", "n_nationkey").alias("path"), F.lit(1).cast("long").alias("size"), F.lit("2020-01-01").cast("timestamp").alias("mtime"))
    first = catalog.cached(files, folder, "v1", lambda: nation_facts(spark, sf_dir))
    again = catalog.cached(files, folder, "v1", lambda: first.limit(0))
    return again.select("s", "p", "o")


N = f"concat('{EX}nation/', n_nationkey)"
R = f"concat('{EX}region/', n_regionkey)"
CLOSURE = "WITH RECURSIVE e AS (SELECT n_nationkey AS x, (n_nationkey * 3 + 1) % 25 AS y FROM nation), c AS (SELECT x, y FROM e UNION SELECT c.x, e.y FROM c JOIN e ON c.y = e.x)"
NEEDS = "WITH RECURSIVE e AS (SELECT p_partkey AS x, p_partkey // 3 AS y FROM part WHERE p_partkey > 0{more}), c AS (SELECT x, y FROM e UNION SELECT c.x, e.y FROM c JOIN e ON c.y = e.x)"

ROWS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "infer_subclass": (
        infer_subclass,
        f"SELECT class, count(*) AS n FROM (SELECT concat('{EX}Size', p_size) AS class FROM part UNION ALL SELECT CASE WHEN p_size <= 25 THEN '{EX}Small' ELSE '{EX}Large' END FROM part UNION ALL SELECT '{EX}' || unnest(['Item', 'Thing']) FROM part WHERE p_size <= 25) GROUP BY 1",
    ),
    "infer_subproperty": (infer_subproperty, f"SELECT {N} AS s, '{EX}' || unnest(['within', 'inside']) AS p, {R} AS o FROM nation"),
    "infer_domain_range": (infer_domain_range, f"SELECT {N} AS s, '{EX}' || unnest(['Country', 'Place']) AS o FROM nation UNION ALL SELECT DISTINCT {R}, '{EX}Continent' FROM nation"),
    "infer_inverse_symmetric": (
        infer_inverse_symmetric,
        f"SELECT {N} AS s, '{EX}near' AS p, concat('{EX}nation/', n_nationkey + 1) AS o FROM nation UNION SELECT concat('{EX}nation/', n_nationkey + 1), '{EX}near', {N} FROM nation UNION SELECT {R}, '{EX}holds', {N} FROM nation",
    ),
    "infer_transitive": (infer_transitive, f"{CLOSURE} SELECT concat('{EX}n', x) AS s, concat('{EX}n', y) AS o FROM c"),
    "infer_sameas": (infer_sameas, f"SELECT DISTINCT concat('{EX}nation/', a.n_nationkey) AS s, concat('{EX}region/', b.n_regionkey) AS o FROM nation a JOIN nation b ON a.n_nationkey % 20 = b.n_nationkey % 20"),
    "infer_restrictions": (
        infer_restrictions,
        f"SELECT {N} AS s, '{EX}Central' AS o FROM nation WHERE n_regionkey = 2 UNION ALL SELECT {N}, '{EX}InPlace' FROM nation WHERE n_regionkey = 1 UNION ALL SELECT '{EX}region/1', '{EX}Named' UNION ALL SELECT '{EX}region/3', '{EX}' || unnest(['Both', 'Upper', 'Lower'])",
    ),
    "infer_per_graph": (infer_per_graph, f"SELECT 'tbox' AS g, p, (SELECT count(*) FROM nation) AS n FROM (SELECT unnest(['{EX}region', '{EX}within']) AS p) UNION ALL SELECT 'tbox', '{RDFS}subPropertyOf', 1 UNION ALL SELECT 'other', '{EX}region', (SELECT count(*) FROM nation)"),
    "shacl_mincount": (shacl_report("sh:property [ sh:path ex:customer ; sh:minCount 1 ; sh:message \"no customer\" ]"), f"SELECT {ORDER} AS focus, 'minCount' AS component, NULL::VARCHAR AS value, 'no customer' AS message {FEW} AND o_orderkey % 11 = 0 AND o_orderkey % 13 <> 0"),
    "shacl_maxcount": (shacl_report("sh:property [ sh:path ex:customer ; sh:maxCount 1 ]"), f"SELECT {ORDER} AS focus, 'maxCount' AS component, NULL::VARCHAR AS value, '' AS message {FEW} AND o_orderkey % 11 <> 0 AND o_orderkey % 13 = 0"),
    "shacl_datatype": (shacl_report("sh:property [ sh:path ex:price ; sh:datatype xsd:double ]"), f"SELECT {ORDER} AS focus, 'datatype' AS component, 'much' AS value, '' AS message {FEW} AND o_orderkey % 7 = 0"),
    "shacl_range_pattern_in": (
        shacl_report("sh:property [ sh:path ex:status ; sh:in ( \"O\" \"F\" ) ; sh:pattern \"^[A-O]\" ; sh:maxLength 1 ]"),
        f"SELECT {ORDER} AS focus, 'in' AS component, o_orderstatus AS value, '' AS message {FEW} AND o_orderstatus NOT IN ('O', 'F') UNION ALL SELECT {ORDER}, 'pattern', o_orderstatus, '' {FEW} AND NOT regexp_matches(o_orderstatus, '^[A-O]')",
    ),
    "shacl_logic": (
        shacl_report("sh:or ( [ sh:path ex:customer ; sh:minCount 1 ] [ sh:path ex:status ; sh:hasValue \"O\" ] )"),
        f"SELECT {ORDER} AS focus, 'or' AS component, {ORDER} AS value, '' AS message {FEW} AND o_orderkey % 11 = 0 AND o_orderkey % 13 <> 0 AND o_orderstatus <> 'O'",
    ),
    "shacl_paths": (
        shacl_paths,
        f"SELECT {ORDER} AS focus, 'minCount' AS component, 'sequence' AS message {FEW} AND (o_orderkey % 11 = 0 OR o_custkey NOT IN (SELECT c_custkey FROM customer)) UNION ALL SELECT {ORDER}, 'minCount', 'alternative' {FEW} AND o_orderkey % 11 = 0 AND o_orderkey % 13 <> 0",
    ),
    "graph_stats": (
        graph_stats,
        f"WITH t AS ({mapped_sql()}) SELECT (SELECT count(*) FROM t) AS triples, {' + '.join(f'(SELECT count(*) FROM {t})' for t in MODEL)} AS subjects, (SELECT count(DISTINCT p) FROM t) AS predicates, (SELECT count(DISTINCT o) FROM t) AS objects FROM (SELECT 1) WHERE true",
    ),
    "vocab_classes": (lambda s, d: summary.classes(dataset(s, d).quads()), " UNION ALL ".join(f"SELECT '{EX}{kind}' AS iri, count(*) AS n FROM {t}" for t, (_, kind, _) in MODEL.items())),
    "vocab_predicates": (lambda s, d: summary.predicates(dataset(s, d).quads()), f"SELECT p AS iri, count(*) AS n FROM ({mapped_sql()}) GROUP BY 1"),
    "changed_files": (lambda s, d: summary.changed_files(*manifests(s, d)), "SELECT concat('p', p_partkey) AS path, CASE p_partkey % 10 WHEN 1 THEN 'added' WHEN 2 THEN 'removed' ELSE 'modified' END AS change FROM part WHERE p_partkey % 10 IN (1, 2, 3)"),
    "fingerprint": (fingerprints, "SELECT unnest(['same', 'other']) AS pair"),
    "dependency_closure": (lambda s, d: closure.transitive(needs(s, d)).select("x", "y"), f"{NEEDS.format(more='')} SELECT x, y FROM c"),
    "dependency_cycles": (lambda s, d: closure.cycles(needs(s, d, True)).select("x"), f"{NEEDS.format(more=' UNION ALL SELECT 7, 65')} SELECT DISTINCT x FROM c WHERE x = y"),
    "orphans": (orphans, f"{NEEDS.format(more='')} SELECT x FROM (SELECT x FROM e UNION SELECT y FROM e) WHERE x NOT IN (150, 77) AND x NOT IN (SELECT y FROM c WHERE x IN (150, 77))"),
    "disk_cache": (disk_cache, f"SELECT {N} AS s, '{EX}region' AS p, {R} AS o FROM nation"),
    "stream_refresh": (stream_refresh, "SELECT concat('nations/', n_nationkey, '.md') AS path, n_name AS o FROM nation"),
}

QUERIES = {name: run for name, (run, _) in ROWS.items()}
ORACLES = {name: sql for name, (_, sql) in ROWS.items() if sql}
