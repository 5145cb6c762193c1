"""Plain functions on Markdown text: headings, links, code spans, routes, titles."""

from __future__ import annotations

import re
import unicodedata
from urllib.parse import unquote

FENCE_LINE = re.compile(r"^ {0,3}(`{3,}|~{3,})")
ATX = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
SETEXT = re.compile(r"^ {0,3}(=+|-+)[ \t]*$")
THEMATIC = re.compile(r"^ {0,3}(?:(?:-[ \t]*){3,}|(?:\*[ \t]*){3,}|(?:_[ \t]*){3,})$")
#: A run of backticks, up to the next one of the same length in the line.
INLINE_CODE = re.compile(r"(?<!`)(`+)(?!`)([^\n]*?)(?<!`)\1(?!`)")
WIKILINK = re.compile(r"\[\[([^\]|#\n]*)(#[^\]|\n]*)?(?:\|([^\]\n]*))?\]\]")
MD_LINK = re.compile(r"(?<!!)\[([^\]\n]*)\]\(([^)\s]+)(?:\s+\"[^\"]*\")?\)")
EXTERNAL = re.compile(r"(?i)^(?:https?|mailto|tel):")
PAGE_SUFFIXES = ("", ".md", ".yaml", ".yml", ".json")
SPARQL_BLOCK = re.compile(r"<!--\s*sparql:start\s*-->\s*(?:```sparql\s*\n(.*?)```|<!--(.*?)-->)(.*?)<!--\s*sparql:end\s*-->", re.S | re.I)


def slug(text: str) -> str:
    """A heading's fragment name before numbering."""
    plain = re.sub(r"[^\w\s-]", "", unicodedata.normalize("NFKD", text).lower())
    return re.sub(r"[\s-]+", "-", plain).strip("-") or "section"


def fenced_lines(lines: list[str]) -> list[bool]:
    """Whether each line belongs to a fenced block, its fences included; one that is never closed goes on to the end."""
    out, fence = [], ""
    for line in lines:
        mark = FENCE_LINE.match(line)
        out.append(bool(fence or mark))
        if fence:
            fence = "" if mark and mark[1].startswith(fence) and not line.strip(" `~") else fence
        elif mark:
            fence = mark[1]
    return out


def code(text: str) -> list[tuple[int, int]]:
    """The spans of fenced blocks, line by line, and of inline code outside them, in order."""
    out, at = [], 0
    lines = text.split("\n")
    for line, fenced in zip(lines, fenced_lines(lines), strict=True):
        out += [(at, at + len(line) + 1)] if fenced else [(at + m.start(), at + m.end()) for m in INLINE_CODE.finditer(line)]
        at += len(line) + 1
    return out


def headings(text: str) -> list[tuple[int, int, str, str]]:
    """(line from 1, level, text, slug) outside fences; slugs met before get -1, -2..."""
    out, seen = [], {}
    lines = text.split("\n")
    paragraph = ""
    for n, (line, fenced) in enumerate(zip(lines, fenced_lines(lines), strict=True), 1):
        if fenced:
            paragraph = ""
            continue
        atx, under = ATX.match(line), SETEXT.match(line)
        level = 0
        if atx:
            level, content, at = len(atx[1]), (atx[2] or "").strip(), n
        elif under and paragraph:
            level, content, at = (1 if under[1][0] == "=" else 2), paragraph, n - 1
        if level:
            base = slug(content)
            count = seen.get(base, 0)
            seen[base] = count + 1
            out.append((at, level, content, f"{base}-{count}" if count else base))
            paragraph = ""
        else:
            paragraph = line.strip() if line.strip() and not THEMATIC.match(line) and not line.startswith(("    ", "\t", ">", "- ", "* ", "|")) else ""
    return out


def spans(pattern: re.Pattern, text: str) -> list[tuple[int, int]]:
    return [m.span() for m in pattern.finditer(text)]


def overlaps(a: int, b: int, among: list[tuple[int, int]]) -> bool:
    return any(x < b and a < y for x, y in among)


def merged(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def resolve(target: str, source: str) -> str | None:
    """The route that a link from a source route leads to; None if it leaves the wiki."""
    if target.startswith("/"):
        return None
    parts = source.split("/")[:-1]
    for step in unquote(target).split("/"):
        if step in ("", "."):
            continue
        if step == "..":
            if not parts:
                return None
            parts.pop()
        else:
            parts.append(step)
    route = re.sub(r"\.(md|yaml|yml|json)$", "", "/".join(parts), flags=re.I)
    return re.sub(r"(^|/)index$", "", route)


def is_page(target: str) -> bool:
    last = target.rpartition("/")[2]
    dot = last.rfind(".")
    return (last[dot:].lower() if dot > 0 else "") in PAGE_SUFFIXES


def links(text: str, source: str) -> list[tuple[str, str, str | None, str, int, int]]:
    """(kind, raw target, route, fragment, start, end) of page links, wiki links first, code spans apart."""
    inline = spans(INLINE_CODE, text)
    out = []
    for m in WIKILINK.finditer(text):
        if not overlaps(*m.span(), inline):
            target = m[1].strip()
            fragment = (m[2] or "")[1:].strip()
            out.append(("wiki", target, target or source, slug(unquote(fragment)) if fragment else "", *m.span()))
    for m in MD_LINK.finditer(text):
        target, _, fragment = m[2].partition("#")
        if overlaps(*m.span(), inline) or EXTERNAL.match(m[2]) or not is_page(target):
            continue
        out.append(("markdown", m[2], resolve(target, source) if target else source, slug(unquote(fragment)) if fragment else "", *m.span()))
    return out


def title_of(data: dict | None, body: str, route: str) -> str:
    """Headline, name, first heading of level one, or the route made readable."""
    for key in ("headline", "name"):
        if data and isinstance(data.get(key), str) and data[key].strip():
            return data[key].strip()
    first = next((t for _, level, t, _ in headings(body) if level == 1), None)
    return first or humanized(route)


def humanized(route: str) -> str:
    return re.sub(r"[_-]+", " ", route.rpartition("/")[2]).strip() or "Index"


def line_column(text: str, at: int) -> tuple[int, int]:
    return text.count("\n", 0, at) + 1, at - (text.rfind("\n", 0, at) + 1) + 1


def linkable(alias: str) -> bool:
    """Whether mentions of a title are worth a link: four letters and more than one word, or eight letters."""
    return len(alias) >= 4 and (len(alias.split()) > 1 or "_" in alias or len(alias) >= 8)


def mentions(text: str, aliases: dict[str, str], source: str) -> list[tuple[str, str, int, int, int, int]]:
    """(alias, route, line, column, start, end) of unlinked mentions; aliases are casefolded keys, longest match first."""
    if not aliases:
        return []
    pattern = re.compile(r"(?<![^\W_])(?<![\w-])(?:" + "|".join(re.escape(a) for a in sorted(aliases, key=lambda a: -len(a))) + r")(?![\w-])", re.I)
    guarded = merged(code(text) + spans(WIKILINK, text) + spans(MD_LINK, text))
    out = []
    for m in pattern.finditer(text):
        route = aliases.get(m[0].casefold())
        if route is not None and route != source and not overlaps(*m.span(), guarded):
            out.append((m[0], route, *line_column(text, m.start()), *m.span()))
    return out


def normal_table(table: str) -> list[list[str]]:
    """A Markdown table without its padding and rule, for comparison; the header's case doesn't matter."""
    rows = [[c.strip() for c in line.strip().strip("|").split("|")] for line in table.strip().splitlines() if line.strip()]
    rows = [r for r in rows if not all(re.fullmatch(r":?-+:?", c) for c in r)]
    return [[c.casefold() for c in rows[0]], *rows[1:]] if rows else []


def blocks(text: str) -> list[tuple[int, str, str, bool]]:
    """(position, query, table, hidden) of query blocks."""
    return [(m.start(), (m[1] or m[2] or "").strip(), m[3].strip(), m[1] is None) for m in SPARQL_BLOCK.finditer(text)]


def with_table(text: str, tables: dict[str, str]) -> str:
    """The text with the table of each block whose query has a new one, if it differs by more than padding."""

    def put(m: re.Match) -> str:
        new = tables.get((m[1] or m[2] or "").strip())
        if new is None or normal_table(new) == normal_table(m[3]):
            return m[0]
        at, end = m.start(3) - m.start(), m.end(3) - m.start()
        return m[0][:at] + "\n\n" + new.strip() + "\n\n" + m[0][end:]

    return SPARQL_BLOCK.sub(put, text)


def json_path(data, path: str) -> list:
    """Values at a path such as .a.b[].c[0]; names are words, what is missing gives nothing."""
    text = path.strip().removeprefix(".")
    steps = re.findall(r"(\w+)|\[(\d*)\]|(\.)|(.)", text)
    if any(bad for *_, bad in steps):
        raise ValueError(f"cannot read path {path!r}")
    found = [data]
    for word, index, dot, _ in steps:
        if dot:
            continue
        if word:
            found = [v[word] for v in found if isinstance(v, dict) and word in v]
        elif index:
            found = [v[int(index)] for v in found if isinstance(v, list) and int(index) < len(v)]
        else:
            found = [x for v in found if isinstance(v, list) for x in v]
    return found
