"""Queries over assets, references in metadata, schemas, reports, link edits, query tables and exports of pages made from tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..corpus import Corpus
from ..operators import audits, documents, shacl
from ..operators import pages as site
from ..sources import corpus
from ..sources.quads import default_union
from .graphs import schema_quads
from .mapping import table
from .texts import CONFIG, SCHEMA, WIKI, lines, nation_pages, odd_path, suggestion_pages, wiki

FOLDERS = ["assets"]
SCHEMA_TEXT = '{"type": "object", "required": ["name"], "properties": {"key": {"type": "integer", "maximum": 1000}}}'


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page per customer with pictures, references and a layout, some of them missing; and two bindings of classes to schemas."""
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    text = lines(
        "---\ntype: Customer\nkey: ", key, F.when(key % 3 > 0, lines("\nname: N", key)).otherwise(F.lit("")), "\nimage: ../assets/c", key % 10, ".png\npeer:\n  at: [wiki:nations/", F.col("c_nationkey"),
        F.when(key % 7 == 0, lines(", 'wiki:gone/", key, ".md#part'")).otherwise(F.lit("")), "]\nx:layout: layouts/", F.when(key % 11 == 0, "none").otherwise("page"), ".html\n---\n# Page ", key,
        "\n\n![seen](../assets/c", key % 10, ".png) and `![not](no.png)` and ![far](https://example.org/a.png)\n", F.when(key % 6 == 0, F.lit("\n![out](../../etc/x.png)\n")).otherwise(F.lit("")),
    )
    own = c.select(lines("customers/", key, ".md").alias("path"), F.lit(".md").alias("suffix"), text.alias("text"))
    bindings = [(f"bindings/{n}.md", ".md", f"---\ntype: Binding\nsh:targetClass: {kind}\nx:jsonSchema: schemas/{ref}.json\n---\n# B\n") for n, kind, ref in (("customer", "Customer", "customer"), ("nation", "Nation", "none"))]
    return own.unionByName(nation_pages(spark, sf_dir)).unionByName(spark.createDataFrame(bindings, "path string, suffix string, text string"))


def others(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f"assets/c{k}.png",) for k in range(5)] + [("layouts/page.html",), ("elsewhere/x.png",)], "path string")


def schemas(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("schemas/customer.json", SCHEMA_TEXT)], "path string, text string")


def broken_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.broken_assets(audits.asset_references(pages(spark, sf_dir)), others(spark), FOLDERS)


def asset_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(lines(F.when(F.col("p_partkey") % 2 == 0, "assets/").otherwise("else/"), F.col("p_partkey"), " é.png").alias("path"))
    return audits.asset_manifest(p, FOLDERS, "/base/")


def broken_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pages(spark, sf_dir)
    return audits.broken_metadata(audits.metadata_references(found), found.select(documents.route(F.col("path")).alias("route")))


def checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.check(pages(spark, sf_dir), CONFIG, spark.createDataFrame([], shacl.REPORT), schemas(spark), others(spark), FOLDERS)


def check_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' pages without a name break a shape, and the check reports it beside its own findings."""
    found = pages(spark, sf_dir)
    shape = "ex:S a sh:NodeShape ; sh:targetClass schema:Customer ; sh:property [ sh:path schema:name ; sh:minCount 1 ; sh:message \"no name\" ] ."
    violations = shacl.validate(default_union(corpus.quads(found, CONFIG)), schema_quads(spark, shape))
    return audits.check(found, CONFIG, violations, schemas(spark), others(spark), FOLDERS).where("code IN ('shacl_violation', 'missing_layout_file')").select("code", "route", "message")


def lint_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each rule finds something in pages that break all but one of them."""
    return audits.lint(wiki(spark, sf_dir), spark.createDataFrame([], "path string")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def linted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.lint(pages(spark, sf_dir), others(spark), FOLDERS)


def check_chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chosen files alone, one of them without metadata."""
    found = pages(spark, sf_dir).unionByName(spark.createDataFrame([("bare.md", ".md", "# Bare\n")], "path string, suffix string, text string"))
    chosen = spark.createDataFrame([("customers/33.md",), ("bare.md",)], "path string")
    return audits.check(found, CONFIG, spark.createDataFrame([], shacl.REPORT), schemas(spark), others(spark), FOLDERS, chosen).select("code", "route")


def unsafe_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "part").select(odd_path(table(spark, sf_dir, "part")).alias("path"), F.lit("# A\n\n# 1. B\n").alias("text"))
    return audits.lint(files, others(spark), FOLDERS).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def table_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations, and a page per region with a query's table, every second one up to date."""
    r = table(spark, sf_dir, "region")
    key = F.col("r_regionkey")
    old = F.when(key % 2 == 0, "| n |\n| --- |\n").otherwise("| N |\n|-|\n| ")
    text = lines("# R", key, "\n\n<!-- sparql:start -->\n```sparql\n", F.lit(QUESTION), "\n```\n\n", old, F.when(key % 2 == 0, "").otherwise("25 |\n"), "\n<!-- sparql:end -->\n")
    return nation_pages(spark, sf_dir).unionByName(r.select(lines("tables/", key, ".md").alias("path"), F.lit(".md").alias("suffix"), text.alias("text")))


QUESTION = "SELECT (COUNT(*) AS ?n) WHERE { ?x a schema:Nation }"


def render_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Corpus(spark, table_pages(spark, sf_dir), CONFIG).rendered().select("path", F.col("text").contains("| 25 |").alias("new"))


def preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    stale = Corpus(spark, table_pages(spark, sf_dir), CONFIG).rendered()
    return audits.preflight(checked(spark, sf_dir), linted(spark, sf_dir), stale, {"missing_layout_file": "warning"}, {"broken_links": "error"})


def suggestion_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suggestion_pages(spark, sf_dir)
    return documents.apply_edits(found, audits.suggestion_edits(found, documents.aliases(documents.titles(found))))


def fix_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    key = F.col("n_nationkey")
    files = n.select(lines("pages/p", key, ".md").alias("path"), lines("---\nname: x\n---\nSee [[old/", key, "#top|it]] and [that](../old/", key, ".md#part), not [far](http://e.org/old/", key, ".md).\n").alias("text"))
    fixes = n.select(lines("pages/p", key).alias("source_route"), F.explode(F.array(lines("old/", key), lines("../old/", key, ".md#part"))).alias("raw_target"), lines("new/n", key).alias("new_route"))
    return documents.apply_edits(files, audits.fix_edits(files, fixes))


def export_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Corpus(spark, nation_pages(spark, sf_dir), CONFIG).export_documents("nquads")


def page_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with three headings, one too deep to cut, and pages without any."""
    n = table(spark, sf_dir, "nation")
    key = F.col("n_nationkey")
    text = F.when(key % 3 == 0, lines("plain ", key, "\nmore")).otherwise(lines("before\n# One ", key, "\na\n### Deep\nb\n## Two\n", F.col("n_name")))
    return site.sections(n.select(lines("n", key, ".md").alias("path"), text.alias("text")))


def layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    template = "<title>%wiki.title%</title>%wiki.title.long% %wiki.none%"
    return n.select("n_nationkey", site.filled(template, {"%wiki.title%": F.col("n_name"), "%wiki.title.long%": lines("Nation ", F.col("n_name"))}).alias("page"), F.array_join(site.unknown_tokens(F.lit(template), ["%wiki.title%", "%wiki.title.long%"]), ",").alias("unknown"))


def remaining_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pages(spark, sf_dir).select("path", lines(F.col("text"), "[a](gone/a.md) [[gone/b]]\n").alias("text")).where(F.col("path").startswith("customers/"))
    broken = documents.broken_links(documents.links(found), found.select(documents.route(F.col("path")).alias("route")), documents.headings(found).select("route", "slug"))
    fixes = broken.where("raw_target = 'gone/b'").select("source_route", "raw_target")
    return site.remaining(broken, fixes).select("source_route", "raw_target", "issue")


ROUTE = "concat('customers/', c_custkey)"
PICTURE = "concat('../assets/c', c_custkey % 10, '.png')"
GONE = "FROM customer WHERE c_custkey % 7 = 0"
LAYOUTS, SCHEMAS = "(SELECT count(*) FROM customer WHERE c_custkey % 11 = 0)", "(SELECT count(*) FROM customer WHERE c_custkey % 3 = 0) + (SELECT count(*) FROM customer WHERE c_custkey > 1000)"
LINKS = f"(SELECT count(*) {GONE}) + 2 * (SELECT count(*) FROM customer WHERE c_custkey % 10 >= 5) + (SELECT count(*) FROM customer WHERE c_custkey % 6 = 0)"
NQUAD = f"'<{WIKI}nations/' || n_nationkey || '> <'"
ROWS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "broken_assets": (
        broken_assets,
        f"SELECT {ROUTE} AS route, unnest(['image', 'metadata']) AS kind, {PICTURE} AS raw_target, 'missing_asset' AS issue FROM customer WHERE c_custkey % 10 >= 5 UNION ALL SELECT {ROUTE}, 'image', '../../etc/x.png', 'outside_assets' FROM customer WHERE c_custkey % 6 = 0",
    ),
    "asset_manifest": (asset_manifest, "SELECT p AS source, p AS output_path, '/base/' || replace(replace(p, ' ', '%20'), 'é', '%C3%A9') AS public_url FROM (SELECT concat('assets/', p_partkey, ' é.png') AS p FROM part WHERE p_partkey % 2 = 0)"),
    "metadata_references": (
        lambda s, d: audits.metadata_references(pages(s, d)),
        f"SELECT {ROUTE} AS source_route, concat('wiki:nations/', c_nationkey) AS raw_target, concat('nations/', c_nationkey) AS target_route FROM customer UNION ALL SELECT {ROUTE}, concat('wiki:gone/', c_custkey, '.md#part'), concat('gone/', c_custkey, '.md') {GONE} "
        "UNION ALL SELECT concat('nations/', n_nationkey), concat('wiki:regions/', n_regionkey), concat('regions/', n_regionkey) FROM nation".replace("concat('gone/', c_custkey, '.md')", "concat('gone/', c_custkey)"),
    ),
    "broken_metadata": (
        broken_metadata,
        f"SELECT {ROUTE} AS source_route, concat('wiki:gone/', c_custkey, '.md#part') AS raw_target, concat('gone/', c_custkey) AS target_route {GONE} UNION ALL SELECT concat('nations/', n_nationkey), concat('wiki:regions/', n_regionkey), concat('regions/', n_regionkey) FROM nation",
    ),
    "schema_issues": (
        lambda s, d: audits.schema_issues(pages(s, d), schemas(s), CONFIG).select("code", "route"),
        f"SELECT 'missing_schema_ref' AS code, 'bindings/nation' AS route UNION ALL SELECT 'frontmatter_schema', {ROUTE} FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT 'frontmatter_schema', {ROUTE} FROM customer WHERE c_custkey > 1000",
    ),
    "check_report": (
        lambda s, d: documents.issue_report(checked(s, d)),
        f"SELECT * FROM (SELECT 'missing_layout_file' AS code, 'error' AS severity, {LAYOUTS} AS n UNION ALL SELECT 'frontmatter_schema', 'error', {SCHEMAS} UNION ALL SELECT 'missing_schema_ref', 'error', 1) WHERE n > 0",
    ),
    "check_chosen": (check_chosen, "SELECT * FROM (VALUES ('missing_layout_file', 'customers/33'), ('frontmatter_schema', 'customers/33'), ('missing_metadata', 'bare')) v(code, route)"),
    "lint_report": (lambda s, d: linted(s, d).groupBy("code").agg(F.count(F.lit(1)).alias("n")), f"SELECT 'broken_links' AS code, {LINKS} + (SELECT count(*) FROM nation) AS n"),
    "lint_unsafe": (unsafe_lint, "SELECT 'route_safety' AS code, count(*) AS n FROM part WHERE p_partkey % 4 = 1"),
    "preflight": (
        preflight,
        f"SELECT * FROM (SELECT 'check' AS stage, 'missing_layout_file' AS code, 'warning' AS severity, {LAYOUTS} AS n UNION ALL SELECT 'check', 'frontmatter_schema', 'error', {SCHEMAS} UNION ALL SELECT 'check', 'missing_schema_ref', 'error', 1 "
        f"UNION ALL SELECT 'lint', 'broken_links', 'error', {LINKS} + (SELECT count(*) FROM nation) UNION ALL SELECT 'render', 'stale_table', 'error', count(*) FROM region WHERE r_regionkey % 2 = 0) WHERE n > 0",
    ),
    "render_loop": (render_loop, "SELECT concat('tables/', r_regionkey, '.md') AS path, true AS new FROM region WHERE r_regionkey % 2 = 0"),
    "suggestion_edits": (suggestion_edits, "SELECT concat('nations/n', n_nationkey, '.md') AS path, concat('It is in [[regions/r', n_regionkey, '|great area ', n_regionkey, 'x]], yes.', chr(10)) AS text FROM nation WHERE n_nationkey % 2 = 0"),
    "fix_edits": (
        fix_edits,
        "SELECT concat('pages/p', k, '.md') AS path, concat('---', chr(10), 'name: x', chr(10), '---', chr(10), 'See [[new/n', k, '#top|it]] and [that](../new/n', k, '.md#part), not [far](http://e.org/old/', k, '.md).', chr(10)) AS text FROM (SELECT n_nationkey AS k FROM nation)",
    ),
    "check_shapes": (
        check_shapes,
        f"SELECT 'shacl_violation' AS code, concat('{WIKI}customers/', c_custkey) AS route, 'minCount https://schema.org/name no name' AS message FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT 'missing_layout_file', {ROUTE}, 'layouts/none.html' FROM customer WHERE c_custkey % 11 = 0",
    ),
    "lint_rules": (
        lint_rules,
        """SELECT code, n FROM (SELECT unnest([{'code': 'broken_links', 'n': 2 * count(*) FILTER (c_custkey % 7 = 0) + (SELECT count(*) FROM nation)}, {'code': 'headings', 'n': count(*) FILTER (c_custkey % 9 IN (0, 2))},
        {'code': 'heading_levels', 'n': count(*) FILTER (c_custkey % 5 = 0)}, {'code': 'duplicate_headings', 'n': count(*) FILTER (c_custkey % 4 = 0)}, {'code': 'thematic_breaks', 'n': count(*) FILTER (c_custkey % 6 = 0)},
        {'code': 'link_style', 'n': count(*) + count(*) FILTER (c_custkey % 7 = 0)}], recursive := true) FROM customer)""",
    ),
    "page_categories": (
        lambda s, d: site.categories(pages(s, d)),
        f"SELECT {ROUTE} AS route, 0 AS position, CASE WHEN c_custkey % 11 = 0 THEN 'none' ELSE 'page' END AS category FROM customer UNION ALL SELECT {ROUTE}, 1, 'Customer' FROM customer UNION ALL SELECT concat('nations/', n_nationkey), 0, 'Nation' FROM nation UNION ALL SELECT 'bindings/' || unnest(['customer', 'nation']), 0, 'Binding'",
    ),
    "page_ids": (lambda s, d: site.identifiers(nation_pages(s, d), CONFIG), f"SELECT concat('nations/', n_nationkey) AS route, 0 AS position, concat('{WIKI}nations/', n_nationkey) AS id FROM nation"),
    "page_sections": (
        page_sections,
        "SELECT concat('n', n_nationkey) AS route, s.n AS section, s.l AS level, s.t AS title, s.x AS text FROM nation, LATERAL (VALUES (0, 1, '', concat('plain ', n_nationkey, chr(10), 'more')), (1, 1, concat('One ', n_nationkey), concat('# One ', n_nationkey, chr(10), 'a', chr(10), '### Deep', chr(10), 'b')), (2, 2, 'Two', concat('## Two', chr(10), n_name))) s(n, l, t, x) WHERE (n_nationkey % 3 = 0) = (s.n = 0)",
    ),
    "titled_backlinks": (
        lambda s, d: site.titled_backlinks(documents.links(wiki(s, d)).where(F.startswith("target_route", F.lit("nations/"))), documents.titles(wiki(s, d))),
        "SELECT concat('nations/', c_nationkey) AS route, concat('customers/', c_custkey) AS source_route, c_name AS title FROM customer",
    ),
    "layouts": (layouts, "SELECT n_nationkey, concat('<title>', n_name, '</title>Nation ', n_name, ' %wiki.none%') AS page, '%wiki.none%' AS unknown FROM nation"),
    "remaining_links": (remaining_links, f"SELECT {ROUTE} AS source_route, 'gone/a.md' AS raw_target, 'missing_document' AS issue FROM customer"),
    "route_slugs": (lambda s, d: table(s, d, "customer").select("c_custkey", site.route_slug(lines("Ünder Way!/", F.col("c_name"), "/--")).alias("slug")), "SELECT c_custkey, concat('under-way/', lower(regexp_replace(c_name, '[^A-Za-z0-9_-]', '', 'g')), '/section') AS slug FROM customer"),
    "build_counts": (lambda s, d: site.build_counts(pages(s, d), others(s)), "SELECT (SELECT count(*) FROM customer) + (SELECT count(*) FROM nation) + 2 AS pages, (SELECT count(*) FROM customer) + (SELECT count(*) FROM nation) + 2 AS routes, 7 AS assets"),
    "export_documents": (
        export_documents,
        f"SELECT concat('nations/', n_nationkey) AS route, array_to_string(list_sort([{NQUAD} || 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <{SCHEMA}Nation> <{WIKI}graphs/root> .', {NQUAD} || '{SCHEMA}name> \"' || n_name || '\" <{WIKI}graphs/root> .', {NQUAD} || '{SCHEMA}region> <{WIKI}regions/' || n_regionkey || '> <{WIKI}graphs/root> .']), chr(10)) AS text FROM nation",
    ),
}

QUERIES = {name: run for name, (run, _) in ROWS.items()}
ORACLES = {name: sql for name, (_, sql) in ROWS.items() if sql}
