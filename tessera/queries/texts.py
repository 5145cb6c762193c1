"""Queries over documents written from table columns: the engine reads the text, the SQL knows the columns."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import results
from ..operators import documents
from ..plans.algebra import RDF, XSD
from ..plans.compiler import Compiler
from ..sources import corpus, rdf
from ..sources.frontmatter import Config
from ..sources.quads import Quads
from .mapping import EX, NAMESPACES, dataset, table

WIKI = "http://example.org/wiki/"
SCHEMA = "https://schema.org/"
CONFIG = Config(base_iri=WIKI)


def lines(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def customer_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, suffix, text): a page per customer, with metadata, headings, links and, for every seventh, a broken one."""
    c = table(spark, sf_dir, "customer")
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    text = lines(
        "---\ntype: Customer\nname: ", F.col("c_name"), "\nkey: ", key, "\nactive: true\nsince: 2020-01-02\nsegment: ", F.col("c_mktsegment"), "\nnation: wiki:nations/", nation,
        "\naddress:\n  type: PostalAddress\n  city: City ", nation, "\n  street: Street ", key, "\ntags: [t", key % 3, ", u", key % 5, "]\nempty: 0\n---\n# ", F.col("c_name"),
        "\n\n## About\n\nFrom [[nations/", nation, "]], see [history](../nations/", nation, ".md#history) and `[[not/this]]`.\n",
        F.when(key % 7 == 0, lines("\nAlso [gone](../missing/", key, ".md) and [[nations/", nation, "#nowhere]].\n")).otherwise(F.lit("")),
        F.when(key % 5 == 0, F.lit("\n#### Too Deep\n")).otherwise(F.lit("\n### Deeper\n")),
        F.when(key % 4 == 0, F.lit("\n## About\n")).otherwise(F.lit("")),
        F.when(key % 6 == 0, F.lit("\n---\n")).otherwise(F.lit("")),
        F.when(key % 9 == 0, F.lit("\n## 1. First Steps Taken Here\n")).otherwise(F.lit("")),
        F.when(key % 9 == 1, F.lit("\n## 2020 plans of the [Old Town Hall](x.png) NATO\n")).when(key % 9 == 2, F.lit("\n## The Étude And Other Pieces\n")).otherwise(F.lit("")),
    )
    return c.select(lines("customers/", key, ".md").alias("path"), F.lit(".md").alias("suffix"), text.alias("text"))


def nation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    key = F.col("n_nationkey")
    text = lines("---\ntype: Nation\nname: ", F.col("n_name"), "\nregion: wiki:regions/", F.col("n_regionkey"), "\n---\n# ", F.col("n_name"), "\n\n## History\n\nOld.\n")
    return n.select(lines("nations/", key, ".md").alias("path"), F.lit(".md").alias("suffix"), text.alias("text"))


def wiki(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customer_pages(spark, sf_dir).unionByName(nation_pages(spark, sf_dir))


def frontmatter_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.quads(customer_pages(spark, sf_dir), CONFIG).where((F.col("s_kind") == "iri") & (F.col("o_kind") != "bnode")).select("s", "p", "o", "o_kind", "o_dt")


def over_wiki(question: str, pages: Callable[[SparkSession, str], DataFrame] = customer_pages, config: Config = CONFIG) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: Compiler(spark, Quads(corpus.quads(pages(spark, sf_dir), config)), config.namespaces, WIKI).query(question).df


def untyped_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third nation's page has no type."""
    n = table(spark, sf_dir, "nation")
    text = lines("---\n", F.when(F.col("n_nationkey") % 3 == 0, F.lit("")).otherwise(F.lit("type: Nation\n")), "name: ", F.col("n_name"), "\nschema:alternateName: N", F.col("n_nationkey"), "\n---\n")
    return n.select(lines("nations/", F.col("n_nationkey"), ".md").alias("path"), F.lit(".md").alias("suffix"), text.alias("text"))


def data_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as YAML, JSON and TOML documents, by turns, and one of each that is no mapping."""
    n = table(spark, sf_dir, "nation")
    key, name = F.col("n_nationkey"), F.col("n_name")
    turn = key % 3
    text = F.when(turn == 0, lines("type: Nation\nname: ", name, "\nkey: ", key, "\n")).when(turn == 1, lines('{"type": "Nation", "name": "', name, '", "key": ', key, "}")).otherwise(lines('type = "Nation"\nname = "', name, '"\nkey = ', key, "\n"))
    suffix = F.when(turn == 0, ".yaml").when(turn == 1, ".json").otherwise(".toml")
    good = n.select(lines("data/", key, suffix).alias("path"), suffix.alias("suffix"), text.alias("text"))
    bad = spark.createDataFrame([("x/list.yaml", ".yaml", "- a\n- b\n"), ("x/broken.json", ".json", "{"), ("x/broken.toml", ".toml", "= 3")], "path string, suffix string, text string")
    return good.unionByName(bad)


def rdf_files(suffix: str) -> Callable[[SparkSession, str], DataFrame]:
    """Each nation as a file of one RDF format."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        n = table(spark, sf_dir, "nation")
        key, region, name = F.col("n_nationkey"), F.col("n_regionkey"), F.col("n_name")
        text = {
            ".ttl": lines("@prefix ex: <", EX, "> .\n# a nation\n<", EX, "nation/", key, "> a ex:Nation ; ex:name \"", name, '"@EN ; ex:region [ ex:key ', region, " ] .\n"),
            ".trig": lines("PREFIX ex: <", EX, ">\nGRAPH ex:g", region, " { <", EX, "nation/", key, "> a ex:Nation ; ex:name \"", name, '"@en ; ex:region [ ex:key ', region, " ] . }\n"),
            ".rdf": lines('<rdf:RDF xmlns:rdf="', RDF, '" xmlns:ex="', EX, '"><ex:Nation rdf:about="', EX, "nation/", key, '"><ex:name xml:lang="en">', name, '</ex:name><ex:region rdf:parseType="Resource"><ex:key rdf:datatype="', XSD, 'integer">', region, "</ex:key></ex:region></ex:Nation></rdf:RDF>"),
            ".jsonld": lines('{"@context": {"ex": "', EX, '"}, "@id": "ex:nation/', key, '", "@type": "ex:Nation", "ex:name": {"@value": "', name, '", "@language": "en"}, "ex:region": {"ex:key": ', region, "}}"),
        }[suffix]
        files = n.select(lines("n", key, suffix).alias("path"), F.lit(suffix).alias("suffix"), text.alias("text"))
        files = files.unionByName(spark.createDataFrame([(f"broken{suffix}", suffix, "<<< no file")], "path string, suffix string, text string"))
        return Compiler(spark, Quads(corpus.quads(files, CONFIG)), NAMESPACES).query("SELECT ?n ?x (LANG(?x) AS ?l) ?k WHERE { ?n a ex:Nation ; ex:name ?x ; ex:region ?r . ?r ex:key ?k }").df

    return run


NATION_RDF = f"SELECT concat('{EX}nation/', n_nationkey) AS n, n_name AS x, 'en' AS l, CAST(n_regionkey AS VARCHAR) AS k FROM nation"


def nt_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples written as lines and read again, both without Python."""
    quads = dataset(spark, sf_dir).restricted([f"{EX}graphs/source/nation"], []).quads().where(F.col("g") == f"{EX}graphs/source/nation")
    return rdf.line_quads(quads.select(results.line_column(graph=True).alias("value")), "none")


def fenced_turtle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations that stand as Turtle in pages without a type; every eighth block is broken."""
    n = table(spark, sf_dir, "nation")
    key = F.col("n_nationkey")
    text = lines("No metadata.\n\n```turtle\n<", EX, "nation/", key, "> <", EX, "name> \"", F.col("n_name"), '" ', F.when(key % 8 == 0, "oops").otherwise("."), "\n```\n\nMore.\n")
    files = n.select(lines("n", key, ".md").alias("path"), F.lit(".md").alias("suffix"), text.alias("text"))
    return corpus.quads(files, CONFIG).select("s", "o")


def body_fulltext(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    files = d.select(lines("docs/", F.col("doc_id"), ".md").alias("path"), F.lit(".md").alias("suffix"), lines("---\ntype: Article\nid: wiki:docs/", F.col("doc_id"), "\n---\n", F.col("text")).alias("text"))
    config = Config(base_iri=WIKI, content_predicate="articleBody")
    return Compiler(spark, Quads(corpus.quads(files, config)), config.namespaces).query('SELECT ?d WHERE { ?d a schema:Article ; schema:articleBody ?t FILTER(CONTAINS(LCASE(?t), "worthless")) }').df


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    path = odd_path(p)
    return p.select(path.alias("path"), documents.route(path).alias("route"))


def odd_path(p: DataFrame) -> Column:
    key = F.col("p_partkey")
    return F.when(key % 4 == 0, lines("a/", key, "/index.md")).when(key % 4 == 1, lines("A b/", key, ".yaml")).when(key % 4 == 2, lines("x/", F.floor(key / 10), ".json")).otherwise(lines("X/", F.floor(key / 10), ".toml"))


ODD_PATH = "CASE WHEN p_partkey % 4 = 0 THEN concat('a/', p_partkey, '/index.md') WHEN p_partkey % 4 = 1 THEN concat('A b/', p_partkey, '.yaml') WHEN p_partkey % 4 = 2 THEN concat('x/', p_partkey // 10, '.json') ELSE concat('X/', p_partkey // 10, '.toml') END"
ODD_ROUTE = f"regexp_replace(regexp_replace({ODD_PATH}, '\\.(md|yaml|yml|json|toml)$', ''), '(^|/)index$', '')"


def route_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return documents.route_safety(p.select(odd_path(p).alias("path")))


def output_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    path = odd_path(p)
    return documents.output_collisions(p.select(F.concat(F.lpad(F.col("p_partkey").cast("string"), 9, "0"), F.lit(" "), path).alias("source"), documents.route(path).alias("output_path")))


HREF = r'<a href="([^"]*)"'


def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("target"))


def backlink_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_links(spark, sf_dir).groupBy("target").agg(F.count_distinct("page_id").alias("n"))


def html_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<h1>(.*?)</h1>", 1).alias("heading"))


def md_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.links(customer_pages(spark, sf_dir)).select("source_route", "kind", "target_route", "fragment")


def broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = wiki(spark, sf_dir)
    known = pages.select(documents.route(F.col("path")).alias("route"))
    return documents.broken_links(documents.links(pages), known, documents.headings(pages).select("route", "slug"))


def broken_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return broken(spark, sf_dir).where(F.col("issue") == "missing_document").select("source_route", "target_route")


def broken_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return broken(spark, sf_dir).where(F.col("issue") == "missing_heading").select("source_route", "target_route", "fragment")


def backlinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = documents.backlinks(documents.links(wiki(spark, sf_dir)).where(F.startswith("target_route", F.lit("nations/"))))
    return found.select("route", F.size("sources").cast("long").alias("n"))


def heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.headings(customer_pages(spark, sf_dir))


def heading_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heads(spark, sf_dir).select("route", "level", "text", "slug")


def jq_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.json_path(table(spark, sf_dir, "events"), "props", ".k", ["event_id"]).select("event_id", F.col("value").cast("long").alias("k"))


def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    key = F.col("n_nationkey")
    text = F.when(key % 3 == 0, lines("---\nheadline: H ", key, "\nname: N\n---\n# T\n")).when(key % 3 == 1, lines("# Title ", key, "\n")).otherwise(F.lit("text"))
    return documents.titles(n.select(lines("some_dir/some-page_", key, ".md").alias("path"), text.alias("text")))


def suggestion_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region pages with titles of two words; nation pages mention their region, every second one in code."""
    r, n = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    regions = r.select(lines("regions/r", F.col("r_regionkey"), ".md").alias("path"), lines("# Great Area ", F.col("r_regionkey"), "x\n").alias("text"))
    mention = lines("great area ", F.col("n_regionkey"), "x")
    body = F.when(F.col("n_nationkey") % 2 == 0, lines("It is in ", mention, ", yes.\n")).otherwise(lines("It is in `", mention, "`, and [[regions/r0|great area 0x]].\n"))
    nations = n.select(lines("nations/n", F.col("n_nationkey"), ".md").alias("path"), body.alias("text"))
    return regions.unionByName(nations)


def suggest_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = suggestion_pages(spark, sf_dir)
    return documents.suggest_links(pages, documents.aliases(documents.titles(pages)))


def fix_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links to old names, to names with blanks, and to names that lack a letter and are in another folder."""
    n = table(spark, sf_dir, "nation")
    key = F.col("n_nationkey")
    name = lines("c_", F.substring(F.md5(key.cast("string")), 1, 12))
    known = n.select(name.alias("route"))
    target = F.when(key % 3 == 0, lines("old/", key)).when(key % 3 == 1, F.replace(name, F.lit("_"), F.lit(" "))).otherwise(lines(F.substring(name, 1, 13), "/"))
    missing = n.select(lines("p", key).alias("source_route"), target.alias("raw_target"), target.alias("target_route"), F.lit("missing_document").alias("issue"))
    renames = {f"old/{k}": f"c_{hashlib.md5(str(k).encode()).hexdigest()[:12]}" for k in range(0, 25, 3)}
    return documents.fix_links(missing, known, renames).select("source_route", "new_route", "how")


def render_markdown_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.markdown_rows(table(spark, sf_dir, "nation"), ["n_nationkey", "n_name", "n_regionkey"])


def render_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a query block: every second table is stale."""
    n = table(spark, sf_dir, "nation")
    key = F.col("n_nationkey")
    value = F.when(key % 2 == 0, "old").otherwise("NEW ")
    text = lines("# ", F.col("n_name"), "\n\n<!-- sparql:start -->\n```sparql\nSELECT ?x WHERE { ?x a ex:N }\n```\n\n| X |\n|---|\n| ", value, " |\n\n<!-- sparql:end -->\n")
    files = n.select(lines("n", key, ".md").alias("path"), text.alias("text"))
    return documents.render_blocks(files, {"SELECT ?x WHERE { ?x a ex:N }": "| x |\n| --- |\n| NEW |"}).select("path")


def jsonschema(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    data = F.to_json(F.struct(F.when(key % 5 > 0, F.col("p_name")).alias("name"), F.when(key % 7 > 0, F.col("p_size").cast("string")).alias("size"), F.when(key % 7 == 0, F.col("p_size")).alias("weight"), F.col("p_brand").alias("brand")))
    schema = {"type": "object", "required": ["name", "size"], "properties": {"name": {"type": "string", "minLength": 1}, "weight": {"type": "integer", "maximum": 40}, "brand": {"enum": ["Brand#11", "Brand#12", "Brand#13"]}}}
    rows = p.select(key.cast("string").alias("route"), F.lit("Part").alias("type"), data.alias("data"))
    return documents.schema_errors(rows, {"Part": schema}).select("route", "path", "keyword")


def issue_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    code = F.when(F.col("p_size") % 4 == 0, "broken_links").when(F.col("p_size") % 4 == 1, "route_safety").when(F.col("p_size") % 4 == 2, "headings").otherwise("link_style")
    return documents.issue_report(p.select(code.alias("code")), {"link_style": "error"})


C = "concat('http://example.org/wiki/customers/', c_custkey)"
ROUTE = "concat('customers/', c_custkey)"
ROWS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "frontmatter_triples": (
        frontmatter_triples,
        f"SELECT {C} AS s, v.p AS p, v.o AS o, v.k AS o_kind, v.dt AS o_dt FROM customer, LATERAL (VALUES ('{RDF}type', '{SCHEMA}Customer', 'iri', ''), ('{SCHEMA}name', c_name, 'literal', '{XSD}string'), ('{SCHEMA}key', CASE WHEN c_custkey = 0 THEN NULL ELSE CAST(c_custkey AS VARCHAR) END, 'literal', '{XSD}integer'), ('{SCHEMA}active', 'true', 'literal', '{XSD}boolean'), ('{SCHEMA}since', '2020-01-02', 'literal', '{XSD}date'), "
        f"('{SCHEMA}segment', c_mktsegment, 'literal', '{XSD}string'), ('{SCHEMA}nation', concat('{WIKI}nations/', c_nationkey), 'iri', ''), ('{SCHEMA}tags', concat('t', c_custkey % 3), 'literal', '{XSD}string'), ('{SCHEMA}tags', concat('u', c_custkey % 5), 'literal', '{XSD}string')) v(p, o, k, dt) WHERE v.o IS NOT NULL",
    ),
    "frontmatter_nested": (
        over_wiki("SELECT ?s ?city ?street WHERE { ?s schema:address ?a . ?a a schema:PostalAddress ; schema:city ?city ; schema:street ?street FILTER(isBLANK(?a)) }"),
        f"SELECT {C} AS s, concat('City ', c_nationkey) AS city, concat('Street ', c_custkey) AS street FROM customer",
    ),
    "frontmatter_lists": (over_wiki("SELECT ?t (COUNT(*) AS ?n) WHERE { ?s schema:tags ?t } GROUP BY ?t"), "SELECT t, count(*) AS n FROM (SELECT concat('t', c_custkey % 3) AS t FROM customer UNION ALL SELECT concat('u', c_custkey % 5) FROM customer) GROUP BY 1"),
    "frontmatter_formats": (over_wiki("SELECT ?s ?n ?k WHERE { ?s a schema:Nation ; schema:name ?n OPTIONAL { ?s schema:key ?k } }", data_documents), f"SELECT concat('{WIKI}data/', n_nationkey) AS s, n_name AS n, CASE WHEN n_nationkey > 0 THEN CAST(n_nationkey AS VARCHAR) END AS k FROM nation"),
    "metadata_rows": (
        lambda spark, sf_dir: corpus.metadata_rows(nation_pages(spark, sf_dir)),
        "SELECT concat('nations/', n_nationkey) AS route, v.k AS key_path, v.v AS value, 'str' AS value_type FROM nation, LATERAL (VALUES ('type', 'Nation'), ('name', n_name), ('region', concat('wiki:regions/', n_regionkey))) v(k, v)",
    ),
    "implicit_types": (
        over_wiki("SELECT ?s ?t WHERE { ?s a ?t }", untyped_pages, Config(base_iri=WIKI, implicit_types=["Thing"])),
        f"SELECT concat('{WIKI}nations/', n_nationkey) AS s, concat('{SCHEMA}', CASE WHEN n_nationkey % 3 = 0 THEN 'Thing' ELSE 'Nation' END) AS t FROM nation",
    ),
    "implicit_types_append": (
        over_wiki("SELECT ?s ?t WHERE { ?s a ?t }", untyped_pages, Config(base_iri=WIKI, implicit_types=["Thing"], implicit_policy="append")),
        f"SELECT concat('{WIKI}nations/', n_nationkey) AS s, '{SCHEMA}Thing' AS t FROM nation UNION ALL SELECT concat('{WIKI}nations/', n_nationkey), '{SCHEMA}Nation' FROM nation WHERE n_nationkey % 3 <> 0",
    ),
    "untyped_documents": (over_wiki("SELECT ?s ?n WHERE { ?s schema:name ?n }", untyped_pages), f"SELECT concat('{WIKI}nations/', n_nationkey) AS s, n_name AS n FROM nation WHERE n_nationkey % 3 <> 0"),
    "vocab_null": (
        over_wiki("SELECT ?s ?p ?o WHERE { ?s ?p ?o FILTER(?p != rdf:type) }", untyped_pages, Config(base_iri=WIKI, vocab=None, implicit_types=["schema:Thing"])),
        f"SELECT concat('{WIKI}nations/', n_nationkey) AS s, '{SCHEMA}alternateName' AS p, concat('N', n_nationkey) AS o FROM nation",
    ),
    "body_fulltext": (body_fulltext, f"SELECT concat('{WIKI}docs/', doc_id) AS d FROM documents WHERE contains(lower(text), 'worthless')"),
    "fenced_turtle": (fenced_turtle, f"SELECT concat('{EX}nation/', n_nationkey) AS s, n_name AS o FROM nation WHERE n_nationkey % 8 <> 0"),
    "turtle_files": (rdf_files(".ttl"), NATION_RDF),
    "trig_files": (rdf_files(".trig"), NATION_RDF),
    "rdf_xml_files": (rdf_files(".rdf"), NATION_RDF),
    "json_ld_files": (rdf_files(".jsonld"), NATION_RDF),
    "nt_scan": (
        nt_scan,
        f"SELECT '{EX}graphs/source/nation' AS g, concat('{EX}nation/', n_nationkey) AS s, 'iri' AS s_kind, v.p AS p, v.o AS o, v.k AS o_kind, v.dt AS o_dt, '' AS o_lang FROM nation, LATERAL (VALUES ('{RDF}type', '{EX}Nation', 'iri', ''), ('{EX}name', n_name, 'literal', '{XSD}string'), ('{EX}region', concat('{EX}region/', n_regionkey), 'iri', '')) v(p, o, k, dt)",
    ),
    "routes": (routes, f"SELECT {ODD_PATH} AS path, {ODD_ROUTE} AS route FROM part"),
    "route_safety": (route_safety, f"SELECT {ODD_ROUTE} AS route, 'white space' AS message FROM part WHERE p_partkey % 4 = 1"),
    "output_collisions": (
        output_collisions,
        f"WITH o AS (SELECT concat(lpad(CAST(p_partkey AS VARCHAR), 9, '0'), ' ', {ODD_PATH}) AS source, {ODD_ROUTE} AS output_path FROM part), f AS (SELECT lower(output_path) AS k, min(source) AS first_source FROM o GROUP BY 1) SELECT output_path, source, first_source FROM o JOIN f ON lower(output_path) = k WHERE source <> first_source",
    ),
    "html_links": (html_links, f"SELECT page_id, unnest(regexp_extract_all(html, '{HREF}', 1)) AS target FROM pages"),
    "backlink_counts": (backlink_counts, f"SELECT target, count(DISTINCT page_id) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '{HREF}', 1)) AS target FROM pages) GROUP BY 1"),
    "html_headings": (html_headings, "SELECT page_id, regexp_extract(html, '<h1>(.*?)</h1>', 1) AS heading FROM pages"),
    "md_links": (
        md_links,
        f"SELECT {ROUTE} AS source_route, 'wiki' AS kind, concat('nations/', c_nationkey) AS target_route, '' AS fragment FROM customer UNION ALL SELECT {ROUTE}, 'markdown', concat('nations/', c_nationkey), 'history' FROM customer "
        f"UNION ALL SELECT {ROUTE}, 'markdown', concat('missing/', c_custkey), '' FROM customer WHERE c_custkey % 7 = 0 UNION ALL SELECT {ROUTE}, 'wiki', concat('nations/', c_nationkey), 'nowhere' FROM customer WHERE c_custkey % 7 = 0",
    ),
    "broken_documents": (broken_documents, f"SELECT {ROUTE} AS source_route, concat('missing/', c_custkey) AS target_route FROM customer WHERE c_custkey % 7 = 0"),
    "broken_headings": (broken_headings, f"SELECT {ROUTE} AS source_route, concat('nations/', c_nationkey) AS target_route, 'nowhere' AS fragment FROM customer WHERE c_custkey % 7 = 0"),
    "backlinks": (backlinks, "SELECT concat('nations/', c_nationkey) AS route, count(*) AS n FROM customer GROUP BY 1"),
    "heading_slugs": (
        heading_slugs,
        f"SELECT {ROUTE} AS route, 1 AS level, c_name AS text, regexp_replace(lower(c_name), '[^a-z0-9_-]', '', 'g') AS slug FROM customer UNION ALL SELECT {ROUTE}, 2, 'About', 'about' FROM customer UNION ALL SELECT {ROUTE}, 2, 'About', 'about-1' FROM customer WHERE c_custkey % 4 = 0 "
        f"UNION ALL SELECT {ROUTE}, 4, 'Too Deep', 'too-deep' FROM customer WHERE c_custkey % 5 = 0 UNION ALL SELECT {ROUTE}, 3, 'Deeper', 'deeper' FROM customer WHERE c_custkey % 5 <> 0 UNION ALL SELECT {ROUTE}, 2, '1. First Steps Taken Here', '1-first-steps-taken-here' FROM customer WHERE c_custkey % 9 = 0 "
        f"UNION ALL SELECT {ROUTE}, 2, '2020 plans of the [Old Town Hall](x.png) NATO', '2020-plans-of-the-old-town-hallxpng-nato' FROM customer WHERE c_custkey % 9 = 1 UNION ALL SELECT {ROUTE}, 2, 'The Étude And Other Pieces', 'the-etude-and-other-pieces' FROM customer WHERE c_custkey % 9 = 2",
    ),
    "heading_levels": (lambda s, d: documents.heading_level_skips(heads(s, d)).select("route", "from_level", "to_level"), f"SELECT {ROUTE} AS route, 2 AS from_level, 4 AS to_level FROM customer WHERE c_custkey % 5 = 0"),
    "duplicate_headings": (lambda s, d: documents.duplicate_headings(heads(s, d)).select("route", "text"), f"SELECT {ROUTE} AS route, 'About' AS text FROM customer WHERE c_custkey % 4 = 0"),
    "lint_title_case": (lambda s, d: documents.heading_style(heads(s, d)).select("route", "issue"), f"SELECT {ROUTE} AS route, CASE c_custkey % 9 WHEN 0 THEN 'numbered' ELSE 'title case' END AS issue FROM customer WHERE c_custkey % 9 IN (0, 2)"),
    "lint_thematic": (lambda s, d: documents.thematic_breaks(customer_pages(s, d)).select("route"), f"SELECT {ROUTE} AS route FROM customer WHERE c_custkey % 6 = 0"),
    "lint_link_style": (lambda s, d: documents.link_style(customer_pages(s, d)).select("route"), f"SELECT {ROUTE} AS route FROM customer UNION ALL SELECT {ROUTE} FROM customer WHERE c_custkey % 7 = 0"),
    "lint_filename": (lambda s, d: documents.filename_issues(customer_pages(s, d), "[0-9]*[02468]"), "SELECT concat('customers/', c_custkey, '.md') AS path FROM customer WHERE c_custkey % 2 = 1"),
    "page_titles": (page_titles, "SELECT concat('some_dir/some-page_', n_nationkey) AS route, CASE n_nationkey % 3 WHEN 0 THEN concat('H ', n_nationkey) WHEN 1 THEN concat('Title ', n_nationkey) ELSE concat('some page ', n_nationkey) END AS title FROM nation"),
    "suggest_links": (suggest_links, "SELECT concat('nations/n', n_nationkey) AS source_route, concat('great area ', n_regionkey, 'x') AS alias, concat('regions/r', n_regionkey) AS target_route, 1 AS line, 10 AS \"column\" FROM nation WHERE n_nationkey % 2 = 0"),
    "fix_links": (fix_links, "SELECT concat('p', n_nationkey) AS source_route, concat('c_', substr(md5(CAST(n_nationkey AS VARCHAR)), 1, 12)) AS new_route, CASE n_nationkey % 3 WHEN 0 THEN 'rename' WHEN 1 THEN 'underscore' ELSE 'close' END AS how FROM nation"),
    "jq_path": (jq_path, "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract(props, '$.k') IS NOT NULL"),
    "render_markdown_table": (render_markdown_table, "SELECT concat('| ', n_nationkey, ' | ', n_name, ' | ', n_regionkey, ' |') AS line FROM nation"),
    "render_blocks": (render_blocks, "SELECT concat('n', n_nationkey, '.md') AS path FROM nation WHERE n_nationkey % 2 = 0"),
    "jsonschema": (
        jsonschema,
        "SELECT CAST(p_partkey AS VARCHAR) AS route, '' AS path, 'required' AS keyword FROM part WHERE p_partkey % 5 = 0 UNION ALL SELECT CAST(p_partkey AS VARCHAR), '', 'required' FROM part WHERE p_partkey % 7 = 0 "
        "UNION ALL SELECT CAST(p_partkey AS VARCHAR), '/weight', 'maximum' FROM part WHERE p_partkey % 7 = 0 AND p_size > 40 UNION ALL SELECT CAST(p_partkey AS VARCHAR), '/brand', 'enum' FROM part WHERE p_brand NOT IN ('Brand#11', 'Brand#12', 'Brand#13')",
    ),
    "issue_report": (issue_report, "SELECT code, severity, count(*) AS n FROM (SELECT CASE p_size % 4 WHEN 0 THEN 'broken_links' WHEN 1 THEN 'route_safety' ELSE 'link_style' END AS code, CASE p_size % 4 WHEN 0 THEN 'warning' ELSE 'error' END AS severity FROM part WHERE p_size % 4 <> 2) GROUP BY 1, 2"),
}

QUERIES = {name: run for name, (run, _) in ROWS.items()}
ORACLES = {name: sql for name, (_, sql) in ROWS.items() if sql}
