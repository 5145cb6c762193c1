"""Assets, references in metadata, schemas bound to types, layouts, and the reports that put all checks together."""

from __future__ import annotations

import json
import posixpath
import re
from collections.abc import Iterator, Sequence
from functools import reduce
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import jsonschema
from ..functions import markdown as md
from ..sources.corpus import flat_map
from ..sources.frontmatter import Config, expand, metadata, route_of, split_markdown, types_of
from . import documents
from .closure import transitive
from .lineage import cut, stored

IMAGE = re.compile(r"!\[[^\]\n]*\]\(([^)\s]+)(?:\s+\"[^\"]*\")?\)")
#: Keys of metadata whose values are files, beside all that end in "image".
IMAGE_KEYS = {"image", "thumbnail", "logo"}
#: Keys that name or type the document itself, so that their values are no references.
OWN_KEYS = {"@context", "@id", "id", "@type", "type"}
REMOTE = re.compile(r"(?i)^https?://")


def local_name(key: str) -> str:
    return key.rpartition(":")[2]


def named(data: dict, name: str):
    """The value of a key with this local name, whatever its prefix."""
    return next((v for k, v in data.items() if local_name(str(k)) == name), None)


def asset_path(target: str, path: str) -> str | None:
    """The path below the root that a reference in a file leads to; None for what lies elsewhere."""
    plain = unquote(re.split(r"[?#]", target, maxsplit=1)[0]).replace("\\", "/").strip()
    if not plain or plain.startswith("/"):
        return None
    found = posixpath.normpath(posixpath.join(posixpath.dirname(path), plain))
    return None if found == ".." or found.startswith("../") else found


def shown_files(path: str, data: dict | None, body: str) -> Iterator[tuple[str, str, str | None]]:
    """(kind, raw target, asset) of a document's images and of the files that its metadata name."""
    if path.lower().endswith(".md"):
        code = md.code(body)
        for m in IMAGE.finditer(body):
            if not md.overlaps(*m.span(), code) and not md.EXTERNAL.match(m[1]):
                yield "image", m[1], asset_path(m[1], path)
    for key, value in (data or {}).items():
        if str(key).lower() in IMAGE_KEYS or str(key).lower().endswith("image"):
            for v in value if isinstance(value, list) else [value]:
                if isinstance(v, str) and not md.EXTERNAL.match(v):
                    yield "metadata", v, asset_path(v, path)


def asset_references(files: DataFrame) -> DataFrame:
    """(route, kind, raw_target, asset): files that bodies show, outside code, and that metadata name; external ones aside."""
    return flat_map(files.select("path", "text"), "route string, kind string, raw_target string, asset string", lambda p, t: [(route_of(p), *x) for x in shown_files(p, *metadata(p, t))])


def below(path: F.Column, folders: Sequence[str]) -> F.Column:
    return reduce(lambda a, b: a | b, (path.startswith(f.strip("/") + "/") for f in folders), F.lit(False))


def broken_assets(references: DataFrame, assets: DataFrame, folders: Sequence[str]) -> DataFrame:
    """(route, kind, raw_target, issue): outside_assets, or missing_asset for what is not among ``assets`` (path)."""
    inside = F.coalesce(below(F.col("asset"), folders), F.lit(False))
    known = assets.select(F.col("path").alias("asset"), F.lit(True).alias("there")).distinct()
    found = references.join(known, "asset", "left")
    issue = F.when(~inside, "outside_assets").when(F.col("there").isNull(), "missing_asset")
    return found.select("route", "kind", "raw_target", issue.alias("issue")).where(F.col("issue").isNotNull())


def asset_manifest(assets: DataFrame, folders: Sequence[str], base_url: str = "") -> DataFrame:
    """(source, output_path, public_url) of the files to copy."""
    base = base_url.rstrip("/")
    there = assets.where(below(F.col("path"), folders)).select("path")
    return flat_map(there, "source string, output_path string, public_url string", lambda p: [(p, p, f"{base}/{quote(p, safe='/()_-.$~')}")])


def wiki_names(value) -> Iterator[str]:
    """wiki: names in a value of metadata, however deep."""
    if isinstance(value, str):
        if re.fullmatch(r"wiki:\S+", value):
            yield value
    elif isinstance(value, dict):
        for key, inner in value.items():
            if key not in OWN_KEYS:
                yield from wiki_names(inner)
    elif isinstance(value, list):
        for inner in value:
            yield from wiki_names(inner)


def named_documents(data: dict | None) -> list[tuple[str, str]]:
    """(raw target, target route) of wiki: names in metadata."""
    return [(name, name[5:].partition("#")[0].removesuffix(".md")) for name in wiki_names(data or {})]


def metadata_references(files: DataFrame) -> DataFrame:
    """(source_route, raw_target, target_route) of wiki: names in metadata."""
    return flat_map(files.select("path", "text"), "source_route string, raw_target string, target_route string", lambda p, t: [(route_of(p), *x) for x in named_documents(metadata(p, t)[0])])


PARSED = """path string, route string, headings array<struct<line: int, level: int, text: string, slug: string>>,
    links array<struct<kind: string, raw_target: string, target_route: string, fragment: string, start: int, end: int>>, breaks array<int>, wiki_links array<int>,
    references array<struct<raw_target: string, target_route: string>>, assets array<struct<kind: string, raw_target: string, asset: string>>"""


def parsed(files: DataFrame) -> DataFrame:
    """What all rules on texts look at, a row per document: each text is read once, and kept as a table."""
    named_fields = lambda names, rows: [dict(zip(names, r, strict=True)) for r in rows]

    def rows(path: str, text: str) -> list[tuple]:
        (data, rest), body = metadata(path, text), split_markdown(text)[1]
        route, is_page = route_of(path), path.endswith(".md")
        links = md.links(body, route) if is_page else []
        return [
            (
                path,
                route,
                named_fields(("line", "level", "text", "slug"), md.headings(body)),
                named_fields(("kind", "raw_target", "target_route", "fragment", "start", "end"), links),
                documents.break_lines(body),
                documents.wiki_link_lines(body) if is_page else [],
                named_fields(("raw_target", "target_route"), named_documents(data)),
                named_fields(("kind", "raw_target", "asset"), shown_files(path, data, rest)),
            )
        ]

    return stored(flat_map(files.select("path", "text"), PARSED, rows), "parsed")


def broken_metadata(references: DataFrame, routes: DataFrame) -> DataFrame:
    """The references whose document is missing."""
    return references.join(routes.select(F.col("route").alias("target_route")).distinct(), "target_route", "left_anti").select("source_route", "raw_target", "target_route")


def schema_refs(data: dict) -> list[str] | None:
    """The schemas that metadata name, a string or a list of strings, once each; None if it is neither."""
    value = named(data, "jsonSchema")
    if value is None:
        return []
    refs = [value] if isinstance(value, str) else value
    return list(dict.fromkeys(refs)) if isinstance(refs, list) and all(isinstance(r, str) for r in refs) else None


def payload(data: dict) -> dict:
    """What a schema sees of metadata: neither names, nor pointers to schemas, nor parts of shapes."""
    return {k: v for k, v in data.items() if not str(k).startswith(("@", "sh:")) and k != "id" and local_name(str(k)) != "jsonSchema"}


def schema_uses(files: DataFrame, config: Config) -> DataFrame:
    """(route, role, type, ref, data): bindings of a class to schemas, types of documents, and schemas that a document names itself.

    ``role`` is binding, type, own, or invalid for a pointer that is neither a string nor a list of strings.
    """

    def rows(path: str, text: str) -> Iterator[tuple]:
        data, _ = metadata(path, text)
        if not data:
            return
        route, refs, target = route_of(path), schema_refs(data), data.get("sh:targetClass")
        if refs is None:
            yield route, "invalid", None, None, None
            return
        if target and refs:
            yield from ((route, "binding", expand(str(target), config, True), ref, None) for ref in refs)
            refs = []
        shown = json.dumps(payload(data), default=str)
        yield from ((route, "type", kind, None, shown) for kind in types_of(data, config))
        yield from ((route, "own", None, ref, shown) for ref in refs)

    return flat_map(files.select("path", "text"), "route string, role string, type string, ref string, data string", lambda p, t: list(rows(p, t)))


def readable(text: str | None) -> bool:
    try:
        return isinstance(json.loads(text or ""), dict)
    except ValueError:
        return False


def schema_closures(schemas: DataFrame) -> DataFrame:
    """(ref, others): the other schemas (path, text), as a map by address, that each one comes to by its references.

    A document is known by its path and by its own ``$id``. What one schema refers to is a bounded map; references are closed on addresses alone.
    """

    def rows(path: str, text: str) -> list[tuple]:
        if not readable(text):
            return []
        schema = json.loads(text)
        own = schema.get("$id")
        return [(path, "refers", x) for x in jsonschema.references(schema, path)] + ([(path, "is", own.partition("#")[0])] if isinstance(own, str) else [])

    told = cut(flat_map(schemas.select("path", "text"), "path string, what string, address string", rows))
    names = schemas.select(F.col("path").alias("address"), "path").unionByName(told.where("what = 'is'").select("address", "path")).groupBy("address").agg(F.min("path").alias("y"))
    edges = told.where("what = 'refers'").join(names, "address").select(F.col("path").alias("x"), "y").where("x <> y")
    texts = schemas.where(F.col("path").isNotNull()).groupBy("path").agg(F.first("text").alias("text"))
    return transitive(edges).where("x <> y").join(texts.withColumnRenamed("path", "y"), "y").groupBy(F.col("x").alias("ref")).agg(F.map_from_entries(F.collect_list(F.struct("y", "text"))).alias("others"))


def schema_issues(files: DataFrame, schemas: DataFrame, config: Config) -> DataFrame:
    """(code, route, message): missing_schema_ref and frontmatter_schema, for ``schemas`` (path, text) below the root.

    Classes are joined with the schemas bound to them, documents with those of their types and their own, each pair once. Remote
    schemas are not fetched: they count as missing unless ``schemas`` has them under their address.
    """
    uses = schema_uses(files, config)
    bound = uses.where("role = 'binding'").select("type", "ref").distinct()
    wanted = uses.where("role = 'type'").join(bound.withColumnRenamed("ref", "bound"), "type").select("route", F.col("bound").alias("ref"), "data")
    own = uses.where("role = 'own'").select("route", "ref", "data")
    known = schemas.select(F.col("path").alias("ref"), F.col("text").alias("schema"))
    pairs = wanted.unionByName(own).groupBy("route", "ref").agg(F.first("data").alias("data")).join(known, "ref", "left")
    named_by = uses.where(F.col("role").isin("binding", "own")).select("route", "ref").distinct()

    missing = flat_map(named_by.join(known, "ref", "left").select("route", "ref", "schema"), "code string, route string, message string", lambda route, ref, schema: [] if readable(schema) else [("missing_schema_ref", route, ref)])
    others = schema_closures(schemas)

    def check(route: str, ref: str, data: str, schema: str | None, more: dict[str, str] | None) -> list[tuple]:
        if not readable(schema):
            return []
        texts = {x["key"]: json.loads(x["value"]) for x in more or [] if readable(x["value"])}
        return [("frontmatter_schema", route, f"{path} {keyword}: {message} ({ref})") for path, keyword, message in jsonschema.errors(json.loads(data), json.loads(schema), ref, texts)]

    checked = pairs.join(others, "ref", "left").select("route", "ref", "data", "schema", F.map_entries("others").alias("others"))
    invalid = uses.where("role = 'invalid'").select(F.lit("frontmatter_schema").alias("code"), "route", F.lit("schema pointer is neither a string nor a list of strings").alias("message"))
    return missing.unionByName(flat_map(checked, "code string, route string, message string", check)).unionByName(invalid)


def layout_issues(files: DataFrame, others: DataFrame) -> DataFrame:
    """(code, route, message) of layouts that metadata name and that are no .html file among ``others`` (path)."""

    def rows(path: str, text: str) -> list[tuple]:
        data, _ = metadata(path, text)
        name = named(data or {}, "layout")
        return [(route_of(path), str(name), posixpath.normpath(str(name)))] if name else []

    used = flat_map(files.select("path", "text"), "route string, message string, layout string", rows)
    there = others.where(F.lower("path").endswith(".html")).select(F.col("path").alias("layout")).distinct()
    return used.join(there, "layout", "left_anti").select(F.lit("missing_layout_file").alias("code"), "route", "message")


def missing_metadata(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """(code, route, message) of explicitly chosen files (path) without metadata."""
    chosen = files.join(wanted.select("path").distinct(), "path", "left_semi")
    return flat_map(chosen.select("path", "text"), "code string, route string, message string", lambda p, t: [("missing_metadata", route_of(p), p)] if not metadata(p, t)[0] else [])


def selected(issues: DataFrame, wanted: DataFrame | None) -> DataFrame:
    """The issues of chosen files (path), or all of them."""
    return issues if wanted is None else issues.join(wanted.select(documents.route(F.col("path")).alias("route")).distinct(), "route", "left_semi").select(*issues.columns)


def check(files: DataFrame, config: Config, violations: DataFrame, schemas: DataFrame, others: DataFrame, folders: Sequence[str] = (), wanted: DataFrame | None = None) -> DataFrame:
    """(code, route, message) of what makes a corpus invalid.

    Collisions of outputs are looked for only where all routes are safe, since no others have outputs. ``violations`` are those of the
    shapes; ``wanted`` (path) restricts layouts and schemas, and asks for metadata in these files.
    """
    unsafe = documents.route_safety(files).select(F.lit("route_safety").alias("code"), "route", "message")
    pages = files.select(F.col("path").alias("source"), F.concat(documents.route(F.col("path")), F.lit(".html")).alias("output_path"))
    outputs = pages.unionByName(asset_manifest(others, folders).select("source", "output_path")) if folders else pages
    # Routes are made of paths alone, so to look for an unsafe one first is cheap.
    collisions = documents.output_collisions(outputs if unsafe.isEmpty() else outputs.limit(0))
    broken = violations.select(F.lit("shacl_violation").alias("code"), F.col("focus").alias("route"), F.concat_ws(" ", "component", "path", "value", "message").alias("message"))
    found = [
        unsafe,
        collisions.select(F.lit("output_collision").alias("code"), F.col("output_path").alias("route"), F.concat_ws(" ", "source", "first_source").alias("message")),
        broken,
        selected(layout_issues(files, others), wanted),
        selected(schema_issues(files, schemas, config), wanted),
    ]
    if wanted is not None:
        found.append(missing_metadata(files, wanted))
    return reduce(DataFrame.unionByName, found)


def lint(files: DataFrame, others: DataFrame, folders: Sequence[str] = (), filename_pattern: str = r"[^\s]+", wanted: DataFrame | None = None) -> DataFrame:
    """(code, route, line, message) of what could be written better; unsafe routes alone where there are any."""
    unsafe = documents.route_safety(files)
    whole = lambda df, code, route, message: df.select(F.lit(code).alias("code"), route.alias("route"), F.lit(None).cast("int").alias("line"), message.alias("message"))
    if not unsafe.isEmpty():
        return whole(unsafe, "route_safety", F.col("route"), F.col("message"))
    line = lambda df, code, message: df.select(F.lit(code).alias("code"), "route", F.col("line").cast("int").alias("line"), message.alias("message"))
    texts = parsed(files)
    heads = texts.select("route", F.inline("headings"))
    routes = texts.select("route")
    page_links = texts.select(F.col("route").alias("source_route"), F.inline("links"))
    links = documents.broken_links(page_links, routes, heads.select("route", "slug"))
    named_there = broken_metadata(texts.select(F.col("route").alias("source_route"), F.inline("references")), routes)
    shown = broken_assets(texts.select("route", F.inline("assets")), others, folders)
    parts = [
        whole(links, "broken_links", F.col("source_route"), F.concat_ws(" ", "issue", "raw_target")),
        whole(named_there, "broken_links", F.col("source_route"), F.concat_ws(" ", F.lit("missing_document"), "raw_target")),
        whole(shown, "broken_links", F.col("route"), F.concat_ws(" ", "issue", "raw_target")),
        whole(documents.filename_issues(files, filename_pattern), "filename_pattern", documents.route(F.col("path")), F.col("path")),
        line(documents.heading_style(heads), "headings", F.col("issue")),
        line(documents.heading_level_skips(heads), "heading_levels", F.concat_ws(" to ", "from_level", "to_level")),
        line(documents.duplicate_headings(heads), "duplicate_headings", F.col("text")),
        line(texts.select("route", F.explode("breaks").alias("line")), "thematic_breaks", F.lit("")),
        line(texts.select("route", F.explode("wiki_links").alias("line")), "link_style", F.lit("")),
    ]
    return selected(reduce(DataFrame.unionByName, parts), wanted)


def preflight(checked: DataFrame, linted: DataFrame, stale: DataFrame, check_severities: dict[str, str] | None = None, lint_severities: dict[str, str] | None = None, strict: bool = False) -> DataFrame:
    """(stage, code, severity, n): all that stands in the way of publishing, with each stage's own severities.

    ``stale`` (path) are files whose query tables are out of date, each an error.
    """
    one = documents.issue_report(checked, check_severities, strict).select(F.lit("check").alias("stage"), "code", "severity", "n")
    two = documents.issue_report(linted, lint_severities, strict).select(F.lit("lint").alias("stage"), "code", "severity", "n")
    three = stale.groupBy().agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(F.lit("render").alias("stage"), F.lit("stale_table").alias("code"), F.lit("error").alias("severity"), "n")
    return one.unionByName(two).unionByName(three)


def suggestion_edits(files: DataFrame, names: DataFrame) -> DataFrame:
    """(path, start, end, old, new) that make a suggested mention a link, for ``documents.apply_edits``."""
    found = documents.suggest_links(files, names)
    at = files.select("path", "text", documents.route(F.col("path")).alias("source_route")).where(F.col("path").endswith(".md"))
    grouped = found.groupBy("source_route").agg(F.collect_list(F.struct("alias", "target_route", "line", "column")).alias("found"))

    def rows(path: str, text: str, mentions) -> list[tuple]:
        body = split_markdown(text)[1]
        lines = [0]
        for line in body.split("\n"):
            lines.append(lines[-1] + len(line) + 1)
        skip = len(text) - len(body)
        starts = [(skip + lines[m["line"] - 1] + m["column"] - 1, m) for m in mentions]
        return [(path, at, at + len(m["alias"]), m["alias"], f"[[{m['target_route']}|{m['alias']}]]") for at, m in starts]

    return flat_map(at.join(grouped, "source_route").select("path", "text", "found"), "path string, start int, end int, old string, new string", rows)


def fix_edits(files: DataFrame, fixes: DataFrame) -> DataFrame:
    """(path, start, end, old, new) that point broken links to their new routes, keeping fragments and labels.

    ``fixes`` are (source_route, raw_target, new_route). A plain link gets a path relative to its page.
    """
    at = files.select("path", "text", documents.route(F.col("path")).alias("source_route")).where(F.col("path").endswith(".md"))
    grouped = fixes.groupBy("source_route").agg(F.collect_list(F.struct("raw_target", "new_route")).alias("found"))

    def rows(path: str, text: str, found) -> list[tuple]:
        body = split_markdown(text)[1]
        skip, new = len(text) - len(body), {f["raw_target"]: f["new_route"] for f in found}
        out = []
        for kind, raw, _, _, a, b in md.links(body, route_of(path)):
            if raw not in new:
                continue
            old = body[a:b]
            if kind == "wiki":
                changed = old.replace(raw, new[raw], 1)
            else:
                suffix = re.search(r"(?:\.\w+)?(?:#.*)?$", raw)
                changed = old.replace(f"({raw}", "(" + posixpath.relpath(new[raw], posixpath.dirname(path) or ".") + (suffix[0] if suffix else ""), 1)
            out.append((path, skip + a, skip + b, old, changed))
        return out

    return flat_map(at.join(grouped, "source_route").select("path", "text", "found"), "path string, start int, end int, old string, new string", rows)


def heading_edits(files: DataFrame, fixes: DataFrame) -> DataFrame:
    """(path, start, end, old, new) that give links the headings of ``documents.fix_headings``: page and label stay, the fragment changes."""
    at = files.select("path", "text", documents.route(F.col("path")).alias("source_route")).where(F.col("path").endswith(".md"))
    grouped = fixes.groupBy("source_route").agg(F.collect_list(F.struct("raw_target", "fragment", "new_fragment")).alias("found"))

    def rows(path: str, text: str, found) -> list[tuple]:
        body = split_markdown(text)[1]
        skip, new = len(text) - len(body), {(f["raw_target"], f["fragment"]): f["new_fragment"] for f in found}
        out = []
        for kind, raw, _, fragment, a, b in md.links(body, route_of(path)):
            if (raw, fragment) in new:
                old = body[a:b]
                mark = old.index("#", old.index("](") if kind == "markdown" else 0)
                end = re.compile(r"[|\]]" if kind == "wiki" else r"[\s)]").search(old, mark).start()
                out.append((path, skip + a, skip + b, old, f"{old[:mark]}#{new[raw, fragment]}{old[end:]}"))
        return out

    return flat_map(at.join(grouped, "source_route").select("path", "text", "found"), "path string, start int, end int, old string, new string", rows)
