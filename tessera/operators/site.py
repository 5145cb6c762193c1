"""Pages of a static site as a DataFrame: title, outline, backlinks, address and HTML."""

from __future__ import annotations

import html
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import markdown as md
from ..functions.builtins import encode_path
from ..sources.corpus import flat_map
from ..sources.frontmatter import metadata, route_of
from . import documents

PAGE = "slug string, title string, url string, output_path string, markdown string, html string, outline array<struct<title:string,slug:string,level:int>>"


def inline(text: str, source: str, style: str) -> str:
    """Code, emphasis and links of one block; raw HTML is escaped."""
    held: list[str] = []

    def keep(markup: str) -> str:
        held.append(markup)
        return f"\x00{len(held) - 1}\x00"

    text = md.INLINE_CODE.sub(lambda m: keep(f"<code>{html.escape(m[2])}</code>"), text)
    text = md.WIKILINK.sub(lambda m: keep(f'<a href="{page_url(m[1].strip(), style) if m[1].strip() else ""}{"#" + md.slug(m[2][1:]) if m[2] else ""}">{html.escape((m[3] or m[1] or (m[2] or "")[1:]).strip())}</a>'), text)

    def link(m: re.Match) -> str:
        target, _, fragment = m[2].partition("#")
        if not md.EXTERNAL.match(m[2]) and target and md.is_page(target) and (route := md.resolve(target, source)) is not None:
            target = page_url(route, style)
        return keep(f'<a href="{html.escape(target)}{"#" + fragment if fragment else ""}">{html.escape(m[1])}</a>')

    text = md.MD_LINK.sub(link, text)
    text = html.escape(text, quote=False)
    text = re.sub(r"\*\*(.+?)\*\*", r"<strong>\1</strong>", text)
    text = re.sub(r"(?<![\w*])\*([^*\s][^*]*)\*", r"<em>\1</em>", text)
    return re.sub(r"\x00(\d+)\x00", lambda m: held[int(m[1])], text)


ITEM = re.compile(r"^( *)([-*+]|\d{1,9}[.)])(?: +(.*)|[ \t]*()$)")


def listed(lines: list[str], n: int, source: str, style: str) -> tuple[int, str]:
    """(line after it, HTML) of the list that begins at a line: an item holds what is indented to its text, lists and code included.

    A list is loose, its paragraphs marked as such, if blank lines stand between its items or within one.
    """
    first = ITEM.match(lines[n])
    assert first is not None
    kind, level = first[2][-1], len(first[1])
    items: list[list[str]] = []
    loose = blank = False
    width = 0
    while n < len(lines):
        line = lines[n]
        item = ITEM.match(line)
        indent = len(line) - len(line.lstrip(" "))
        if not line.strip():
            blank = True
            items[-1].append("")
        elif items and indent >= width:
            loose |= blank and bool(items[-1])
            items[-1].append(line[width:])
            blank = False
        elif item and item[2][-1] == kind and not md.THEMATIC.match(line) and len(item[1]) <= level + 1:
            loose |= blank
            text = item[3] or ""
            width = len(line) - len(line[len(item[1]) + len(item[2]) :].lstrip(" ")) if text else indent + len(item[2]) + 1
            items.append([text])
            blank = False
        elif not blank and not item and items and items[-1][-1].strip() and not any(p.match(line) for p in (md.ATX, md.FENCE_LINE, md.THEMATIC)) and not line.startswith((">", "|")):
            items[-1].append(line.strip())
        else:
            break
        n += 1
    tag = "ol" if first[2][0].isdigit() else "ul"
    start = f' start="{int(first[2][:-1])}"' if tag == "ol" and int(first[2][:-1]) != 1 else ""
    shown = "".join(f"<li>{render(chr(10).join(x).rstrip(), source, style, tight=not loose)}</li>" for x in items)
    return n, f"<{tag}{start}>{shown}</{tag}>"


def render(body: str, source: str = "", style: str = "pretty", tight: bool = False) -> str:
    """Headings with ids, paragraphs, lists, quotes, tables, rules and fenced code; the paragraphs of a tight list's items are bare."""
    slugs = {line: (level, text, slug) for line, level, text, slug in md.headings(body)}
    out: list[str] = []
    paragraph: list[str] = []
    lines = body.split("\n")

    def flush() -> None:
        if paragraph:
            shown = inline(" ".join(paragraph), source, style)
            out.append(shown if tight else f"<p>{shown}</p>")
            paragraph.clear()

    n = 0
    while n < len(lines):
        line = lines[n]
        fence = md.FENCE_LINE.match(line)
        if n + 1 in slugs:
            flush()
            level, text, slug = slugs[n + 1]
            out.append(f'<h{level} id="{slug}">{inline(text, source, style)}</h{level}>')
            n += 1 if md.ATX.match(line) else 2
        elif fence:
            flush()
            end = next((i for i in range(n + 1, len(lines)) if lines[i].strip().startswith(fence[1])), len(lines))
            language = line.strip()[len(fence[1]) :].strip()
            code = html.escape("\n".join(lines[n + 1 : end]))
            out.append(f"<pre><code{f' class="language-{html.escape(language)}"' if language else ''}>{code}</code></pre>")
            n = end + 1
        elif md.THEMATIC.match(line):
            flush()
            out.append("<hr>")
            n += 1
        elif line.lstrip().startswith("|") and n + 1 < len(lines) and re.fullmatch(r"\s*\|?[\s:|-]+\|?\s*", lines[n + 1]) and "-" in lines[n + 1]:
            flush()
            end = next((i for i in range(n, len(lines)) if not lines[i].lstrip().startswith("|")), len(lines))
            cells = [[inline(c.strip(), source, style) for c in x.strip().strip("|").split("|")] for i, x in enumerate(lines[n:end]) if i != 1]
            row = lambda r, tag: "<tr>" + "".join(f"<{tag}>{c}</{tag}>" for c in r) + "</tr>"
            out.append(f"<table>{row(cells[0], 'th')}{''.join(row(r, 'td') for r in cells[1:])}</table>")
            n = end
        elif ITEM.match(line) and not (paragraph and not ITEM.match(line)[3].strip()):
            flush()
            n, markup = listed(lines, n, source, style)
            out.append(markup)
        elif line.startswith(">"):
            flush()
            quoted = []
            while n < len(lines) and lines[n].startswith(">"):
                quoted.append(lines[n][2 if lines[n][1:2] == " " else 1 :].rstrip())
                n += 1
            out.append(f"<blockquote>{render(chr(10).join(quoted), source, style)}</blockquote>")
        else:
            if line.strip():
                paragraph.append(line.strip())
            else:
                flush()
            n += 1
    flush()
    return "\n".join(out)


def page_url(route: str, style: str = "pretty") -> str:
    return "/" + encode_path(route) + ("/" if route and style == "pretty" else ".html" if route else "")


def output_path(route: str, style: str = "pretty") -> str:
    if not route:
        return "index.html"
    return f"{route}/index.html" if style == "pretty" else f"{route}.html"


def pages(files: DataFrame, style: str = "pretty") -> DataFrame:
    """A row per Markdown document, with the routes that link to it."""

    def rows(path: str, text: str) -> list[tuple]:
        data, body = metadata(path, text)
        route = route_of(path)
        title = md.title_of(data, body, route)
        heads = md.headings(body)
        shown = body
        if heads and heads[0][1] == 1 and heads[0][2].casefold() == title.casefold():
            # The layout shows the title; a first heading that repeats it goes.
            shown = "\n".join(body.split("\n")[heads[0][0] :])
        outline = [{"title": t, "slug": s, "level": level} for _, level, t, s in heads if 2 <= level <= 6]
        return [(route, title, page_url(route, style), output_path(route, style), body, render(shown, route, style), outline)]

    made = flat_map(files.where(F.col("path").endswith(".md")).select("path", "text"), PAGE, rows)
    links = documents.backlinks(documents.links(files)).select(F.col("route").alias("slug"), F.col("sources").alias("backlinks"))
    return made.join(links, "slug", "left").withColumn("backlinks", F.coalesce("backlinks", F.array().cast("array<string>")))


def manifest(site: DataFrame) -> DataFrame:
    """(source, output_path, public_url, kind)."""
    return site.select(F.col("slug").alias("source"), "output_path", F.col("url").alias("public_url"), F.lit("page").alias("kind"))


def formatted(text: str) -> str:
    """Markdown with line ends, blank lines, heading marks and table padding made uniform; code, and query blocks with their tables, are left alone."""
    out: list[str] = []
    fence = ""
    text = text.replace("\r\n", "\n")
    shielded = {n for a, b in md.spans(md.SPARQL_BLOCK, text) for n in range(text.count("\n", 0, a), text.count("\n", 0, b) + 1)}
    for n, line in enumerate(text.split("\n")):
        if n in shielded:
            out.append(line)
            continue
        mark = md.FENCE_LINE.match(line)
        if fence:
            out.append(line)
            if mark and mark[1].startswith(fence) and not line.strip(" `~"):
                fence = ""
            continue
        if mark:
            fence = mark[1]
        line = line.rstrip()
        if (heading := md.ATX.match(line)) is not None and heading[2]:
            line = f"{heading[1]} {heading[2].strip()}"
        elif line.startswith("|"):
            line = "| " + " | ".join(c.strip() for c in line.strip("|").split("|")) + " |"
        if line or (out and out[-1]):
            out.append(line)
    return "\n".join(out).rstrip("\n") + "\n"
