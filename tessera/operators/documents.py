"""Audits and repairs over documents (path, text): headings, links, lints, suggestions, fixes, query blocks, schemas."""

from __future__ import annotations

import difflib
import json
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import jsonschema
from ..functions import markdown as md
from ..sources.corpus import flat_map
from ..sources.frontmatter import metadata, route_of, split_markdown
from .lineage import cut

ISSUES = "code string, route string, line int, message string"
#: What each rule's findings count as unless configured.
SEVERITIES = {"shacl_violation": "error", "frontmatter_schema": "error", "missing_schema_ref": "error", "route_safety": "error", "output_collision": "error", "missing_layout_file": "error", "missing_metadata": "error", "broken_links": "warning", "filename_pattern": "warning", "link_style": "warning", "headings": "off", "heading_levels": "off", "duplicate_headings": "off", "thematic_breaks": "off"}
#: A link or image in a heading.
LINK = r"!?\[[^\]]*\]\([^)]*\)"
SUFFIX = r"(?i)\.(md|yaml|yml|json|toml)$"
CUTOFF = 0.86


def route(path: Column) -> Column:
    """The path without suffix and last 'index'."""
    return F.regexp_replace(F.regexp_replace(path, SUFFIX, ""), "(^|/)index$", "")


def route_safety(files: DataFrame) -> DataFrame:
    """(route, message) of routes that can't be addresses."""
    r = route(F.col("path"))
    bad = (
        F.when(r.rlike(r"\s"), "white space")
        .when(r.rlike(r"[\x00-\x1f\x7f]"), "control character")
        .when(r.rlike(r"[?#%]"), "reserved character")
        .when(r.rlike(r"(^|/)(\.{1,2})?(/|$)") & (r != ""), "empty or dot segment")
    )
    return files.select(r.alias("route"), bad.alias("message")).where(F.col("message").isNotNull())


def output_collisions(outputs: DataFrame) -> DataFrame:
    """(output_path, source, first_source) of (source, output_path) entries that differ from an earlier one by case at most."""
    key = F.lower("output_path")
    first = outputs.groupBy(key.alias("k")).agg(F.min("source").alias("first_source"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return outputs.join(first, key == F.col("k")).where(F.col("source") != F.col("first_source")).select("output_path", "source", "first_source")


def headings(files: DataFrame) -> DataFrame:
    """(route, line, level, text, slug)."""
    return flat_map(files.select("path", "text"), "route string, line int, level int, text string, slug string", lambda p, t: [(route_of(p), *h) for h in md.headings(split_markdown(t)[1])])


def heading_level_skips(found: DataFrame) -> DataFrame:
    """Headings more than one level below the one before."""
    before = F.lag("level").over(Window.partitionBy("route").orderBy("line"))
    return found.withColumn("before", before).where((F.col("before") > 0) & (F.col("level") > F.col("before") + 1)).select("route", "line", F.col("before").alias("from_level"), F.col("level").alias("to_level"))


def duplicate_headings(found: DataFrame) -> DataFrame:
    """Headings from level two on whose text an earlier one of the document has, but for case, links and white space."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower("text"), LINK, ""), "`", ""), r"\s+", " "))
    low = found.where(F.col("level") >= 2).withColumn("key", plain)
    w = Window.partitionBy("route", "key").orderBy("line")
    return low.select("route", "line", "text", F.first("line").over(w).alias("first_line"), F.row_number().over(w).alias("n")).where("n > 1").drop("n")


def heading_style(found: DataFrame) -> DataFrame:
    """(route, line, issue): numbered headings ("1. x", "1) x"), and lower ones in title case.

    Links don't count. A word in title case has three letters or more, the first one large and all others small.
    """
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", LINK, ""), r"\s+", " "), r"^[ ,;:]+|[ ,;:]+$", "")
    numbered = F.col("text").rlike(r"^\d+[.)]\s+")
    words = F.split(text, " ")
    rest = F.slice(words, 2, F.greatest(F.lit(0), F.size(words) - 1))
    title = F.size(F.filter(rest, lambda w: F.regexp_replace(w, "^[.,;:!?]+|[.,;:!?]+$", "").rlike(r"^\p{Lu}[^\p{Lu}\p{Nd}-]*\p{Ll}[^\p{Lu}\p{Nd}-]*$") & (F.length(F.regexp_replace(w, "^[.,;:!?]+|[.,;:!?]+$", "")) > 2))) >= 2
    issue = F.when(numbered, "numbered").when((F.col("level") >= 2) & title, "title case")
    return found.select("route", "line", issue.alias("issue")).where(F.col("issue").isNotNull())


def break_lines(body: str) -> list[int]:
    """Lines of rules that are no underlines of headings and not in code."""
    lines = body.split("\n")
    out, before = [], ""
    for n, (line, fenced) in enumerate(zip(lines, md.fenced_lines(lines), strict=True), 1):
        if not fenced and md.THEMATIC.match(line) and not (re.match(r"^ {0,3}-+\s*$", line) and before.strip()):
            out.append(n)
        before = line
    return out


def thematic_breaks(files: DataFrame) -> DataFrame:
    """(route, line) of rules in bodies."""
    return flat_map(files.select("path", "text"), "route string, line int", lambda p, t: [(route_of(p), n) for n in break_lines(split_markdown(t)[1])])


def filename_issues(files: DataFrame, pattern: str) -> DataFrame:
    """(path) of Markdown files whose name without suffix doesn't match."""
    stem = F.regexp_extract("path", r"([^/]*)\.md$", 1)
    return files.where(F.col("path").endswith(".md") & ~stem.rlike(f"^(?:{pattern})$")).select("path")


def links(files: DataFrame) -> DataFrame:
    """(source_route, kind, raw_target, target_route, fragment, start, end) of page links in bodies."""

    def rows(path: str, text: str) -> list[tuple]:
        here = route_of(path)
        return [(here, *x) for x in md.links(split_markdown(text)[1], here)]

    return flat_map(files.where(F.col("path").endswith(".md")).select("path", "text"), "source_route string, kind string, raw_target string, target_route string, fragment string, start int, end int", rows)


def wiki_link_lines(body: str) -> list[int]:
    code = md.code(body)
    return [md.line_column(body, m.start())[0] for m in md.WIKILINK.finditer(body) if not md.overlaps(*m.span(), code)]


def link_style(files: DataFrame) -> DataFrame:
    """(route, line) of wiki links outside code, where plain links are the style."""
    return flat_map(files.where(F.col("path").endswith(".md")).select("path", "text"), "route string, line int", lambda p, t: [(route_of(p), n) for n in wiki_link_lines(split_markdown(t)[1])])


def backlinks(found: DataFrame) -> DataFrame:
    """(route, sources): distinct linking routes in the order of the first link."""
    first = found.where(F.col("target_route").isNotNull()).groupBy("target_route", "source_route").agg(F.min("start").alias("at"))
    return first.groupBy(F.col("target_route").alias("route")).agg(F.transform(F.array_sort(F.collect_list(F.struct("source_route", "at"))), lambda x: x["source_route"]).alias("sources"))


def broken_links(found: DataFrame, routes: DataFrame, ids: DataFrame) -> DataFrame:
    """The links with an issue: missing_document, or missing_heading where the document lacks the fragment's heading.

    ``routes`` (route) are the documents, ``ids`` (route, slug) their headings.
    """
    known = routes.select(F.col("route").alias("target_route")).distinct()
    no_document = found.join(known, "target_route", "left_anti").withColumn("issue", F.lit("missing_document"))
    with_fragment = found.where(F.col("fragment") != "").join(known, "target_route", "left_semi")
    slugs = ids.select(F.col("route").alias("target_route"), F.col("slug").alias("fragment")).distinct()
    no_heading = with_fragment.join(slugs, ["target_route", "fragment"], "left_anti").withColumn("issue", F.lit("missing_heading"))
    return no_document.unionByName(no_heading)


def titles(files: DataFrame) -> DataFrame:
    """(route, title)."""

    def rows(path: str, text: str) -> list[tuple]:
        data, body = metadata(path, text)
        return [(route_of(path), md.title_of(data, body, route_of(path)))]

    return flat_map(files.select("path", "text"), "route string, title string", rows)


def aliases(found: DataFrame) -> DataFrame:
    """(alias, route): titles and readable routes worth linking; of equal ones, the last route in order has it."""
    readable = F.trim(F.regexp_replace(F.regexp_extract("route", "[^/]*$", 0), "[_-]+", " "))
    each = found.select("route", F.explode(F.array_distinct(F.array(F.trim("title"), readable))).alias("alias")).withColumn("alias", F.lower("alias"))
    worth = (F.length("alias") >= 4) & (F.col("alias").rlike(r"\s") | (F.length("alias") >= 8))
    return each.where(worth).groupBy("alias").agg(F.max("route").alias("route"))


def suggest_links(files: DataFrame, names: DataFrame, most: int = 200_000) -> DataFrame:
    """(source_route, alias, target_route, line, column) of mentions of other pages that are no links yet.

    Candidate aliases of a page are found by a join on the word in them that the fewest aliases have, those without any word by
    search; only these are looked for in the page. Up to ``most`` aliases, they are sent to every task for the join.
    """
    schema = "source_route string, alias string, target_route string, line int, column int"

    def rows_for(table: dict[str, str], path: str, text: str) -> list[tuple]:
        here = route_of(path)
        return [(here, a, r, line, column) for a, r, line, column, *_ in md.mentions(split_markdown(text)[1], table, here)]

    pages = files.where(F.col("path").endswith(".md"))
    names = cut(names.select("alias", "route"))
    parts = names.select("alias", "route", F.explode_outer(F.array_distinct(F.regexp_extract_all("alias", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))).alias("w"))
    common = parts.where(F.col("w").isNotNull()).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    keyed = parts.join(common, "w", "left").groupBy("alias", "route").agg(F.min_by("w", F.struct("n", "w")).alias("w")).select("alias", "route", F.coalesce("w", F.lit("")).alias("w"))
    keyed = F.broadcast(keyed) if names.count() <= most else keyed
    words = pages.select("path", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))).alias("w"))
    wordless = pages.join(keyed.where("w = ''"), F.expr("contains(text, alias)")).select("path", "alias", "route")
    candidates = words.join(keyed.where("w <> ''"), "w").select("path", "alias", "route").unionByName(wordless).groupBy("path").agg(F.collect_list(F.struct("alias", "route")).alias("table"))
    joined = pages.join(candidates, "path").select("path", "text", "table")
    return flat_map(joined, schema, lambda p, t, table: rows_for({x["alias"]: x["route"] for x in table}, p, t))


def fix_links(broken: DataFrame, routes: DataFrame, renames: dict[str, str] | None = None) -> DataFrame:
    """(source_route, raw_target, new_route, how) of links to missing documents that have one sensible target.

    In this order: the rename map, underscores for blanks, the one route that is close enough in spelling. Distinct
    targets are compared with routes of nearly their length and a common letter pair, never all with all.
    """
    known = routes.select("route").distinct()
    missing = broken.where(F.col("issue") == "missing_document").select("source_route", "raw_target", "target_route").where(F.col("target_route").isNotNull())
    table = F.create_map(*(F.lit(x) for pair in (renames or {}).items() for x in pair)) if renames else None
    renamed = F.element_at(table, F.col("target_route")) if table is not None else F.lit(None).cast("string")
    under = F.replace("target_route", F.lit(" "), F.lit("_"))
    step = missing.withColumn("renamed", renamed).withColumn("under", F.when(under != F.col("target_route"), under))
    step = step.join(known.select(F.col("route").alias("renamed"), F.lit(True).alias("has_renamed")), "renamed", "left").join(known.select(F.col("route").alias("under"), F.lit(True).alias("has_under")), "under", "left")
    targets = step.where(F.col("has_renamed").isNull() & F.col("has_under").isNull()).select("target_route").distinct()
    pairs = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - 1)), lambda i: F.substring(c, i, F.lit(2))))
    left = targets.select("target_route", F.explode(pairs(F.col("target_route"))).alias("pair"))
    right = known.select("route", F.explode(pairs(F.col("route"))).alias("pair"))
    # Names of a and b letters have a ratio of CUTOFF if m >= c (a + b) letters match, c being its half, in at most a + b - 2 m + 1
    # stretches. So a name lacks at most 2 a + b - 3 m of its pairs, and b >= a c / (1 - c): one more than that of its
    # rarest pairs are looked up, of which a close route has one at least. Lengths are within a third.
    c = CUTOFF / 2
    lacking = F.floor(F.length("target_route") * ((2 - 3 * c) + (1 - 3 * c) * c / (1 - c)) + 1e-9)
    common = right.groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    ranked = left.join(common, "pair", "left").groupBy("target_route").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "pair"))).alias("pairs"))
    prefix = ranked.select("target_route", F.explode(F.slice("pairs", F.lit(1), (lacking + 1).cast("int"))).alias("p")).where("p.n > 0").select("target_route", F.col("p.pair").alias("pair"))
    near = prefix.join(right, "pair").select("target_route", "route").distinct().where(F.abs(F.length("target_route") - F.length("route")) <= 0.33 * F.length("target_route"))
    close = flat_map(near.select("target_route", "route"), "target_route string, route string", lambda a, b: [(a, b)] if difflib.SequenceMatcher(None, b, a).ratio() >= CUTOFF else [])
    only = close.groupBy("target_route").agg(F.count(F.lit(1)).alias("n"), F.min("route").alias("close")).where("n = 1").select("target_route", "close")
    done = step.join(only, "target_route", "left")
    new = F.when(F.col("has_renamed"), F.col("renamed")).when(F.col("has_under"), F.col("under")).otherwise(F.col("close"))
    how = F.when(F.col("has_renamed"), "rename").when(F.col("has_under"), "underscore").otherwise("close")
    return done.select("source_route", "raw_target", new.alias("new_route"), how.alias("how")).where(F.col("new_route").isNotNull())


def fix_headings(broken: DataFrame, ids: DataFrame) -> DataFrame:
    """(source_route, raw_target, fragment, new_fragment) of links to missing headings that one heading of the page is close to in spelling.

    Different fragments of a page are compared with the page's own slugs alone. A ratio of CUTOFF leaves room for few edits, so the edit distance
    sorts most of them out before the ratio is taken.
    """
    missing = broken.where(F.col("issue") == "missing_heading").select("source_route", "raw_target", "target_route", "fragment")
    asked = missing.select("target_route", "fragment").distinct()
    slugs = ids.select(F.col("route").alias("target_route"), "slug").distinct()
    near = asked.join(slugs, "target_route").where(F.levenshtein("fragment", "slug") <= F.floor((F.length("fragment") + F.length("slug")) * (1 - CUTOFF) + 1e-9))
    close = flat_map(near.select("target_route", "fragment", "slug"), "target_route string, fragment string, slug string", lambda r, a, b: [(r, a, b)] if difflib.SequenceMatcher(None, b, a).ratio() >= CUTOFF else [])
    only = close.groupBy("target_route", "fragment").agg(F.count(F.lit(1)).alias("n"), F.min("slug").alias("new_fragment")).where("n = 1").drop("n")
    return missing.join(only, ["target_route", "fragment"]).select("source_route", "raw_target", "fragment", "new_fragment").distinct()


def apply_edits(files: DataFrame, edits: DataFrame) -> DataFrame:
    """(path, text) with each file's (path, start, end, old, new) edits made from the right, where the old text still stands."""
    grouped = edits.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start", "end", "old", "new"))).alias("edits"))

    def rows(path: str, text: str, found) -> list[tuple]:
        for e in reversed(found):
            if text[e["start"] : e["end"]] == e["old"]:
                text = text[: e["start"]] + e["new"] + text[e["end"] :]
        return [(path, text)]

    return flat_map(files.select("path", "text").join(grouped, "path"), "path string, text string", rows)


def query_blocks(files: DataFrame) -> DataFrame:
    """(path, position, query, table, hidden) of query blocks."""
    return flat_map(files.where(F.col("text").rlike("(?i)sparql:start")).select("path", "text"), "path string, position int, query string, table string, hidden boolean", lambda p, t: [(p, *b) for b in md.blocks(t)])


def render_blocks(files: DataFrame, tables: dict[str, str]) -> DataFrame:
    """(path, text) of files that change when the tables of their queries are put in."""

    def rows(path: str, text: str) -> list[tuple]:
        new = md.with_table(text, tables)
        return [(path, new)] if new != text else []

    return flat_map(files.where(F.col("text").rlike("(?i)sparql:start")).select("path", "text"), "path string, text string", rows)


def schema_errors(rows: DataFrame, schemas: dict[str, dict], *, key: str = "route", kind: str = "type", data: str = "data") -> DataFrame:
    """(route, path, keyword, message): JSON values checked against the schema of their type."""
    text = json.dumps(schemas)

    def check(name: str, type_of: str, value: str) -> list[tuple]:
        schema = json.loads(text).get(type_of)
        return [(name, *e) for e in jsonschema.errors(json.loads(value), schema)] if schema is not None else []

    return flat_map(rows.select(key, kind, data), "route string, path string, keyword string, message string", check)


def issue_report(issues: DataFrame, severities: dict[str, str] | None = None, strict: bool = False) -> DataFrame:
    """(code, severity, n) of issues (code), as configured; strict makes warnings errors, off leaves them out."""
    table = SEVERITIES | (severities or {})
    found = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), F.col("code")), F.lit("error"))
    severity = F.when(found == "warning", "error").otherwise(found) if strict else found
    return issues.select("code", severity.alias("severity")).where(F.col("severity") != "off").groupBy("code", "severity").agg(F.count(F.lit(1)).alias("n"))


def json_path(rows: DataFrame, column: str, path: str, key: Sequence[str] = ()) -> DataFrame:
    """(key..., value): values at a path of a JSON column, as JSON text, without leaving the JVM."""
    names = re.findall(r"(\w+)|\[(\d*)\]|(\.)|(.)", path.strip().removeprefix("."))
    if any(bad for *_, bad in names):
        raise ValueError(f"cannot read path {path!r}")
    out = rows.select(*key, F.col(column).alias("value"))
    for word, index, dot, _ in names:
        if dot:
            continue
        if word:
            out = out.select(*key, F.get_json_object("value", f"$.{word}").alias("value"))
        elif index:
            out = out.select(*key, F.get_json_object("value", f"$[{index}]").alias("value"))
        else:
            out = out.select(*key, F.explode(F.from_json("value", "array<string>")).alias("value"))
    return out.where(F.col("value").isNotNull())
