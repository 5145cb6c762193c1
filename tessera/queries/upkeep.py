"""Keeping a corpus right: consequences of changed documents, repaired headings, sources and what they ask for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..operators import audits, documents, provenance
from ..operators.lineage import scratch
from ..plans.algebra import TYPE, XSD
from ..plans.compiler import Compiler
from ..sources import quads
from ..streaming import incremental
from .graphs import all_of, facts, key, schema_quads
from .mapping import EX, NAMESPACES, table
from .rules import customer_nations, order_customers
from .texts import lines

NO_QUADS = "path string, s string, s_kind string, p string, o string, o_kind string, o_dt string, o_lang string"
RDFS_SCHEMA = "ex:customer rdfs:subPropertyOf ex:party . ex:party rdfs:domain ex:Deal ; rdfs:range ex:Partner . ex:Order rdfs:subClassOf ex:Deal . ex:Deal rdfs:subClassOf ex:Happening ."


def order_documents(orders: DataFrame, moved: bool) -> DataFrame:
    """What each order's document says; those moved name another customer."""
    me = key("order/", "o_orderkey")
    customer = F.col("o_custkey") + F.when(F.lit(moved) & (F.col("o_orderkey") % 5 == 0), 100_000).otherwise(0)
    said = all_of(facts(orders, me, TYPE, F.lit("Order"), graph=""), facts(orders, me, EX + "customer", F.concat(F.lit("customer/"), customer.cast("string")), graph=""))
    return said.withColumn("path", F.regexp_replace("s", "^.*/order/", "orders/")).drop("g")


def incremental_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rounds: two thirds of the orders and the schema; the rest and a fifth changed; a seventh deleted."""
    orders = table(spark, sf_dir, "orders")
    number = F.col("o_orderkey")
    paths = lambda some: some.select(key("orders/", "o_orderkey").alias("path"))
    log = incremental.Log(spark, scratch(spark, "log"), buckets=8)
    first = orders.where(number % 3 != 2)
    schema = schema_quads(spark, RDFS_SCHEMA).withColumn("path", F.lit("schema")).drop("g")
    incremental.change(log, paths(first).union(schema.select("path")), order_documents(first, False).unionByName(schema), "s1")
    second = orders.where((number % 3 == 2) | (number % 5 == 0))
    incremental.change(log, paths(second), order_documents(second, True), "s2")
    incremental.change(log, paths(orders.where(number % 7 == 0)), spark.createDataFrame([], NO_QUADS), "d3")
    return incremental.facts(log).where(F.col("p") == TYPE).select("s", "o")


def stored_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders, customers and nations in a quad store with statistics; the chain begins with its rarest pattern."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    me, nation = key("customer/", "c_custkey"), key("nation/", "n_nationkey")
    data = all_of(order_customers(spark, sf_dir), customer_nations(spark, sf_dir), facts(c, me, TYPE, F.lit("Customer")), facts(n, nation, EX + "name", F.col("n_name"), "literal", XSD + "string"), facts(n.where("n_nationkey % 5 = 0"), nation, TYPE, F.lit("Port")))
    folder = scratch(spark, "store")
    quads.write(data, folder, rows_per_file=20_000)
    question = "SELECT ?o ?name WHERE { ?o ex:customer ?c . ?c a ex:Customer ; ex:nation ?n . ?n a ex:Port ; ex:name ?name }"
    return Compiler(spark, quads.opened(spark, folder), NAMESPACES, EX).query(question).df


def name_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names with a code span, marks and accents in the forms that addresses need."""
    name = lines("  ", F.col("p_name"), " -- & ", F.col("p_brand"), "! `x y` Éa*~ ")
    return table(spark, sf_dir, "part").select("p_partkey", names.kebab_case(name).alias("kebab"), names.source_graph(names.without_code(name), EX).alias("graph"), names.without_accents(lines(F.col("p_name"), " Žluťoučký KŮŇ")).alias("plain"))


def heading_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    text = lines("---\nname: x\n---\n# Customer ", k, "\n\n## Order history\n\n## Contact details\n\nSee [[customers/", k, "#Order histroy|it]], [that](", k, ".md#contact-detail) and [[#nothing like it]].\n")
    return c.select(lines("customers/", k, ".md").alias("path"), text.alias("text"))


def fix_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links to misspelt headings of their pages, and to one that no heading is close to."""
    files = heading_pages(spark, sf_dir)
    routes = files.select(documents.route(F.col("path")).alias("route"))
    ids = documents.headings(files).select("route", "slug")
    fixes = documents.fix_headings(documents.broken_links(documents.links(files), routes, ids), ids)
    return documents.apply_edits(files, audits.heading_edits(files, fixes))


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a file of its source and language; English ones of each source have a source of their own below it."""
    files = table(spark, sf_dir, "documents").select(lines("sources/", F.col("source"), "/", F.col("lang"), "/", F.col("doc_id"), ".md").alias("path"))
    found = table(spark, sf_dir, "documents").select("source").distinct()
    sources = found.select(F.col("source").alias("name"), lines("sources/", F.col("source"), "/").alias("root")).unionByName(found.select(lines(F.col("source"), "-en").alias("name"), lines("sources/", F.col("source"), "/en").alias("root")))
    more = files.where(F.col("path").endswith("0.md")).select(F.regexp_replace("path", "^sources/", "own/").alias("path"))
    return provenance.source_graphs(files.unionByName(more), sources, EX).groupBy("g").agg(F.count(F.lit(1)).alias("n"))


def resolution(spark: SparkSession, sf_dir: str) -> provenance.Resolution:
    """Part k is asked for by k // 3 and, every tenth, by k // 7 at another version; 4 and 13 ask for each other; the root asks for 1."""
    p = table(spark, sf_dir, "part").where("p_partkey > 1")
    k = F.col("p_partkey")
    row = lambda df, by, ref: df.select(F.concat(F.lit("p"), F.floor(k / by).cast("string")).alias("parent"), key("p", "p_partkey").alias("name"), lines("http://e.org/", k).alias("url"), F.lit(ref).alias("ref"), F.lit(None).cast("string").alias("path"), F.lit(by).alias("position"))
    few = spark.createDataFrame([(None, "p1", "http://e.org/1", "v1", None, 0), ("p13", "p4", "http://e.org/4", "v1", None, 0)], provenance.DECLARED)
    return provenance.Resolution(row(p, 3, "v1").unionByName(row(p.where(k % 10 == 0), 7, "v2")).unionByName(few))


PART = "WITH RECURSIVE e AS (SELECT p_partkey // 3 AS x, p_partkey AS y, 'v1' AS ref FROM part WHERE p_partkey > 1 UNION ALL SELECT p_partkey // 7, p_partkey, 'v2' FROM part WHERE p_partkey > 1 AND p_partkey % 10 = 0 UNION ALL SELECT 13, 4, 'v1'), r AS (SELECT 1 AS y UNION SELECT e.y FROM r JOIN e ON e.x = r.y)"
O = f"concat('{EX}order/', o_orderkey)"

ROWS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "incremental_inference": (
        incremental_inference,
        f"""WITH d AS (SELECT {O} AS s, concat('{EX}customer/', o_custkey + CASE WHEN o_orderkey % 5 = 0 THEN 100000 ELSE 0 END) AS c FROM orders WHERE o_orderkey % 7 <> 0)
        SELECT s, '{EX}' || unnest(['Order', 'Deal', 'Happening']) AS o FROM d UNION ALL SELECT DISTINCT c, '{EX}Partner' FROM d""",
    ),
    "stored_join": (stored_join, f"SELECT {O} AS o, n_name AS name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey % 5 = 0"),
    "name_forms": (
        name_forms,
        f"""WITH n AS (SELECT p_partkey, p_name, concat('  ', p_name, ' -- & ', p_brand, '! `x y` Éa*~ ') AS x FROM part)
        SELECT p_partkey, regexp_replace(regexp_replace(trim(lower(x)), '[\\s-]+', '-', 'g'), '[^a-z0-9-]', '', 'g') AS kebab, concat('{EX}graphs/source/', replace(replace(url_encode(replace(x, '`x y`', '')), '%7E', '~'), '+', '%20')) AS graph, concat(p_name, ' Zlutoucky KUN') AS plain FROM n""",
    ),
    "fix_headings": (
        fix_headings,
        """SELECT concat('customers/', c_custkey, '.md') AS path, concat('---', chr(10), 'name: x', chr(10), '---', chr(10), '# Customer ', c_custkey, chr(10), chr(10), '## Order history', chr(10), chr(10), '## Contact details', chr(10), chr(10),
        'See [[customers/', c_custkey, '#order-history|it]], [that](', c_custkey, '.md#contact-details) and [[#nothing like it]].', chr(10)) AS text FROM customer""",
    ),
    "source_graphs": (
        source_files,
        f"SELECT concat('{EX}graphs/source/', source, CASE WHEN lang = 'en' THEN '-en' ELSE '' END) AS g, count(*) AS n FROM documents GROUP BY 1 UNION ALL SELECT '{EX}graphs/root', count(*) FROM documents WHERE doc_id % 10 = 0 HAVING count(*) > 0",
    ),
    "source_conflicts": (
        lambda s, d: resolution(s, d).conflicts().select("name", "parent", "ref", "taken_ref"),
        f"{PART}, n AS (SELECT concat('p', y) AS name, concat('p', x) AS parent, ref FROM e WHERE x IN (SELECT y FROM r)), t AS (SELECT name, min_by(ref, parent || ' ' || ref) AS taken_ref FROM n GROUP BY name) SELECT DISTINCT name, parent, ref, taken_ref FROM n JOIN t USING (name) WHERE ref <> taken_ref",
    ),
    "source_cycles": (lambda s, d: resolution(s, d).cycles(), "SELECT unnest(['p4', 'p13']) AS name, 'p13' AS cycle"),
}

QUERIES = {name: run for name, (run, _) in ROWS.items()}
ORACLES = {name: sql for name, (_, sql) in ROWS.items()}
