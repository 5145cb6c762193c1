"""What a site shows of each page, as tables: categories, identifiers, sections, titled backlinks, filled layouts, chosen files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import markdown as md
from ..functions.names import without_accents
from ..sources.corpus import flat_map, metadata_rows
from ..sources.frontmatter import Config, route_of, split_markdown
from . import documents
from .lineage import cut

HEADING = r"^(#{1,6})\s+(.+?)\s*$"


def stripped(column: Column) -> Column:
    return F.regexp_replace(column, r"^\s+|\s+$", "")


def in_order(found: DataFrame, column: str, key: Column) -> DataFrame:
    """(route, position, column): the values of each route that differ in ``key``, by their rank, counted from 0."""
    first = found.where(F.col(column) != "").groupBy("route", key.alias("key")).agg(F.min("rank").alias("rank"), F.min_by(column, "rank").alias(column))
    place = F.row_number().over(Window.partitionBy("route").orderBy("rank")) - 1
    return first.select("route", place.alias("position"), column)


def categories(files: DataFrame) -> DataFrame:
    """(route, position, category): a page's layout but the default one, then its types without prefixes, each once whatever its case."""
    rows = metadata_rows(files).where(F.col("value").isNotNull())
    layouts = rows.where(F.col("key_path").rlike(r"^([^.\[]*:)?layout$")).groupBy("route").agg(F.min_by("value", "key_path").alias("value"))
    name = F.regexp_replace(F.substring_index("value", "/", -1), r"\.html$", "")
    own = layouts.select("route", F.lit(0).alias("rank"), stripped(name).alias("category")).where("category <> 'default'")
    typed = rows.where(F.col("key_path").rlike(r"^@?type(\[\d+\])?$") & (F.col("value_type") == "str") & (F.col("value") != ""))
    typed = typed.withColumn("key", F.regexp_extract("key_path", r"^@?type", 0)).withColumn("first", F.min("key").over(Window.partitionBy("route"))).where("key = first")
    place = F.coalesce(F.regexp_extract("key_path", r"\d+", 0).try_cast("int"), F.lit(0)) + 1
    kinds = typed.select("route", place.alias("rank"), stripped(F.regexp_replace("value", "^[^:]*:", "")).alias("category"))
    return in_order(own.unionByName(kinds), "category", F.lower("category"))


def identifiers(files: DataFrame, config: Config) -> DataFrame:
    """(route, position, id): the names that a page gives itself, with known prefixes written out, then its own address; each once."""
    rank = F.when(F.col("key_path") == "@id", 0).otherwise(2)
    given = metadata_rows(files).where(F.col("key_path").isin("@id", "id") & (F.col("value_type") == "str")).select("route", rank.alias("rank"), stripped(F.col("value")).alias("id"))
    spaces = F.create_map(*(F.lit(x) for pair in config.namespaces.items() for x in pair)) if config.namespaces else F.create_map()
    prefix = F.substring_index("id", ":", 1)
    plain = F.col("id").contains(":") & ~F.col("id").rlike(md.EXTERNAL.pattern) & (F.lower(prefix) != "urn")
    full = given.where(plain).select("route", (F.col("rank") + 1).alias("rank"), F.concat(F.try_element_at(spaces, prefix), F.regexp_replace("id", "^[^:]*:", "")).alias("id")).where("id IS NOT NULL")
    own = files.select(documents.route(F.col("path")).alias("route")).distinct().select("route", F.lit(4).alias("rank"), F.concat(F.lit(config.base_iri), "route").alias("id"))
    return in_order(given.unionByName(full).unionByName(own), "id", F.col("id"))


def sections(files: DataFrame) -> DataFrame:
    """(route, section, level, title, text): a body cut at its headings of levels one and two; what stands before them is left out.

    A body without such headings is one section of level one without a title, a blank one none. In SQL functions but for the front matter.
    """
    bodies = flat_map(files.select("path", "text"), "route string, body string", lambda p, t: [(route_of(p), split_markdown(t)[1])])
    lines = bodies.select("route", F.posexplode(F.split("body", "\n")).alias("n", "line"))
    level = F.length(F.regexp_extract("line", HEADING, 1))
    cutting = F.col("line").rlike(HEADING) & (level <= 2)
    w = Window.partitionBy("route").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = lines.withColumn("section", F.sum(cutting.cast("int")).over(w))
    each = numbered.groupBy("route", "section").agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("lines"))
    most = each.groupBy("route").agg(F.max("section").alias("most"))
    text = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    head = F.col("lines")[0]["line"]
    found = each.join(most, "route").where((F.col("section") > 0) | ((F.col("most") == 0) & (F.trim(text) != "")))
    plain = F.col("section") == 0
    return found.select("route", F.col("section").cast("int").alias("section"), F.when(plain, 1).otherwise(F.length(F.regexp_extract(head, HEADING, 1))).alias("level"), F.when(plain, "").otherwise(F.regexp_extract(head, HEADING, 2)).alias("title"), text.alias("text"))


def titled_backlinks(links: DataFrame, titles: DataFrame) -> DataFrame:
    """(route, source_route, title): each page that links to another, once, with its title or else its route made readable.

    A row per link, so a page that all others link to is no long row.
    """
    pairs = links.where(F.col("target_route").isNotNull()).select(F.col("target_route").alias("route"), "source_route").distinct()
    known = titles.select(F.col("route").alias("source_route"), "title")
    readable = F.initcap(F.replace("source_route", F.lit("-"), F.lit(" ")))
    return pairs.join(known, "source_route", "left").select("route", "source_route", F.coalesce("title", readable).alias("title"))


def filled(template: Column | str, tokens: dict[str, Column | str]) -> Column:
    """A layout with its tokens, such as %wiki.title%, replaced; longer tokens first, so that none is cut by a shorter one."""
    out = F.lit(template) if isinstance(template, str) else template
    for token in sorted(tokens, key=len, reverse=True):
        value = tokens[token]
        out = F.replace(out, F.lit(token), F.coalesce(F.lit(value) if isinstance(value, str) else value, F.lit("")))
    return out


def unknown_tokens(template: Column, tokens: list[str]) -> Column:
    """The tokens of a layout that have no value, sorted."""
    return F.array_sort(F.array_except(F.array_distinct(F.regexp_extract_all(template, F.lit(r"(%wiki\.[A-Za-z0-9_.]+%)"), F.lit(1))), F.array(*map(F.lit, tokens))))


def without_wrappers(text: str) -> str:
    """Markdown with query blocks as a reader sees them: a shown query and its table, or of a hidden one the table alone."""

    def shown(m) -> str:
        table = m[3].strip()
        return f"{table}\n" if m[1] is None else f"```sparql\n{m[1].strip()}\n```\n\n{table}\n"

    return md.SPARQL_BLOCK.sub(shown, text)


def route_slug(route: Column) -> Column:
    """Each step of a route as a fragment's name, accents aside."""
    plain = without_accents(F.lower(route))
    step = lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"[^\p{L}\p{N}_\s-]", ""), r"[\s-]+", "-"), "^-+|-+$", "")
    return F.array_join(F.transform(F.split(plain, "/"), lambda x: F.when(step(x) == "", "section").otherwise(step(x))), "/")


def chosen(files: DataFrame, paths: list[str], suffixes: tuple[str, ...] = (".md", ".yaml", ".yml", ".json", ".toml")) -> DataFrame:
    """The files of explicitly given paths, in their order (column ``position``); one of another kind, or that is not there, raises."""
    wrong = [p for p in paths if not p.lower().endswith(suffixes)]
    if wrong:
        raise ValueError(f"not a document: {wrong[0]}")
    wanted = files.sparkSession.createDataFrame(list(enumerate(dict.fromkeys(paths))), "position int, path string")
    found = cut(files.join(F.broadcast(wanted), "path"))
    missing = wanted.join(found.select("path"), "path", "left_anti").orderBy("position").first()
    if missing is not None:
        raise FileNotFoundError(missing["path"])
    return found.orderBy("position")


def remaining(broken: DataFrame, fixes: DataFrame) -> DataFrame:
    """The broken links that no fix (source_route, raw_target) mends."""
    return broken.join(fixes.select("source_route", "raw_target").distinct(), ["source_route", "raw_target"], "left_anti")


def build_counts(files: DataFrame, assets: DataFrame) -> DataFrame:
    """One row: pages, routes (pages that would share an output count once) and assets."""
    pages = files.agg(F.count(F.lit(1)).alias("pages"), F.count_distinct(documents.route(F.col("path"))).alias("routes"))
    return pages.withColumn("kind", F.lit(1)).join(assets.agg(F.count(F.lit(1)).alias("assets")).withColumn("kind", F.lit(1)), "kind").drop("kind")
