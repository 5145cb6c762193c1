"""Main text of web pages by site template removal.

Every element has a slot, its path of element names and classes, and a content, a hash of its subtree's text. Contents
are counted per host and slot in Spark, over pages with different articles. A slot that stands on many of a host's
pages, and whose content mostly is that of other articles' pages too, is a part of the site's template; its subtrees
are deleted on all pages of the host, also where they are at odds with the rest. Of attributes only classes count, without numbers
and the marks of an active entry, so that a menu is the same on every page.

Elements that say what they are help where a host has few pages: an article or main element bounds the text, its own paragraphs and
headings are never templates, and menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
comments go. ``trust_markup=False`` leaves all of this aside but scripts, styles and the like.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, checkpointed

#: A slot is a template if it stands on so many pages of a host with different articles, on this share of them,
MIN_PAGES = 5
MIN_SHARE = 0.1
#: and this share of them has a content that stands with another article too.
MIN_RECURRING = 0.5
#: Slots that are sent to every task at most; more are joined by host, in so many parts of each.
BROADCAST_SLOTS = 200_000
SALTS = 64

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

# Elements by their role in HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
CLOSES_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
OWN_KIND = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "thead": {"tr"}, "tfoot": {"tr", "td", "th", "tbody"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}, "tbody": {"table"}, "thead": {"table"}, "tfoot": {"table"}}
TEXT_BLOCKS = set("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th tr tbody thead figcaption caption summary article main body html".split())
NEVER_TEXT = set("head script style noscript template nav header footer aside form button select option textarea input iframe svg canvas object embed audio video map dialog menu noembed noframes xmp title datalist".split())
NOT_TEXT_ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar note status".split())
NOT_TEXT_NAMES = (
    "ad ads adbox adsbygoogle advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice notices notification popup modal overlay paywall "
    "newsletter subscribe subscription signup nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar widget widgets footer header masthead topbar comment comments commentlist respond replies disqus "
    "share sharing social related recommended recommendations toolbar login pagination pager copyright disclaimer skiplink skip toc"
).split()
NAMED = re.compile(r"(?:^|\s)(?!(?:has|no|with|without|not)[-_])(?:[a-z0-9]+[-_]+)*(?:" + "|".join(NOT_TEXT_NAMES) + r")(?:[-_]+[a-z0-9]+)*(?=\s|$)")
BODY_NAMED = re.compile(r"(?:^|[\s_-])(?:content|article|main|story|entry|post)(?:[\s_-]|$)")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
NO_SCREEN = set("head script style noscript template textarea iframe svg canvas object embed audio video map noembed noframes xmp title datalist".split())
VOLATILE = re.compile(r"(?:^|[-_])(?:active|current|selected|open|first|last|odd|even|hover|visited)(?:$|[-_])|\d")
BARRIERS = ("button", "table", "td", "th", "caption", "object")


class Node:
    __slots__ = ("tag", "attrs", "children", "parent", "slot", "digest", "length")

    def __init__(self, tag: str, attrs: str, parent: Node | None = None) -> None:
        self.tag, self.attrs, self.children, self.parent, self.slot, self.digest, self.length = tag, attrs, [], parent, 0, 0, 0

    def attributes(self) -> dict[str, str]:
        return {k.lower(): html.unescape(a or b or c or "") for k, a, b, c in ATTRIBUTE.findall(self.attrs)}


class Open:
    """The open elements; knows where the last one of each name stands, so that deep nesting costs no scans."""

    def __init__(self, root: Node) -> None:
        self.stack = [root]
        self.places: dict[str, list[int]] = {}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def last(self, tags: set[str] | tuple[str, ...]) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def close(self, place: int) -> None:
        while len(self.stack) > place:
            self.places[self.stack.pop().tag].pop()


def parse(page: str) -> Node:
    """The page as a tree; ends that HTML lets authors leave out are put in, stray ends are ignored. Time grows with the page's length."""
    root = Node("html", "")
    opened = Open(root)
    stack = opened.stack
    at = 0
    raw_ends: dict[str, re.Pattern] = {}
    unclosed: set[str] = set()
    while at < len(page):
        lt = page.find("<", at)
        match = TOKEN.match(page, lt) if lt >= 0 else None
        while lt >= 0 and match is None:
            lt = page.find("<", lt + 1)
            match = TOKEN.match(page, lt) if lt >= 0 else None
        if lt < 0:
            stack[-1].children.append(page[at:])
            break
        if lt > at:
            stack[-1].children.append(page[at:lt])
        at = match.end()
        tag = match["tag"] or match["tag2"]
        if tag is None:
            continue
        tag = tag.lower()
        if match["end"] or match["end2"]:
            if opened.places.get(tag):
                opened.close(opened.places[tag][-1])
            continue
        attrs = match["attrs"] or match["attrs2"] or ""
        if tag in CLOSES_P and opened.places.get("p"):
            if (p := opened.places["p"][-1]) > opened.last(BARRIERS):
                opened.close(p)
        elif tag in OWN_KIND:
            while (own := opened.last(OWN_KIND[tag])) > opened.last(SCOPES[tag] - OWN_KIND[tag]):
                opened.close(own)
        node = Node(tag, attrs.strip(), stack[-1])
        stack[-1].children.append(node)
        if tag in RAW:
            ends = raw_ends.setdefault(tag, re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I))
            end = None if tag in unclosed else ends.search(page, at)
            if end is None:
                unclosed.add(tag)
            if tag not in ("script", "style"):
                node.children.append(page[at : end.start() if end else len(page)])
            at = end.end() if end else len(page)
        elif tag not in VOID and not attrs.endswith("/"):
            opened.push(node)
    return root


def dropped(node: Node) -> bool:
    """Whether an element says itself that it is no part of the main text."""
    if node.tag in NEVER_TEXT:
        return True
    if not node.attrs or node.tag in ("html", "body", "main"):
        return False
    found = node.attributes()
    if found.get("role", "").lower() in NOT_TEXT_ROLES or "hidden" in found or HIDDEN.search(found.get("style", "").lower()):
        return True
    names = f"{found.get('class', '')} {found.get('id', '')}".lower()
    return bool(NAMED.search(names)) and not (node.tag in ("article", "section", "div") and BODY_NAMED.search(names) and not re.search(r"comment|sidebar|related|advert|sponsor|promo|footer|header", names))


def digest_of(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\x00".join(parts).encode("utf-8", "surrogatepass"))


def described(root: Node) -> None:
    """Gives each element its slot, its content's hash and the length of its text."""
    todo = [(root, iter(root.children), [])]
    while todo:
        top, rest, parts = todo[-1]
        for child in rest:
            if isinstance(child, str):
                text = " ".join(child.split())
                if text:
                    parts.append(text)
                    top.length += len(text)
            elif child.tag not in NO_SCREEN:
                names = child.attributes().get("class", "").lower().split() if "class" in child.attrs.lower() else ()
                child.slot = digest_of(f"{top.slot:x}", child.tag, *sorted(n for n in names if not VOLATILE.search(n)))
                todo.append((child, iter(child.children), []))
                break
        else:
            todo.pop()
            # What is emphasised or linked is a matter of the day; blocks keep their order.
            top.digest = digest_of(*parts) if parts else 0
            if todo and parts:
                todo[-1][2].append(f"{top.digest:x}")
                todo[-1][0].length += top.length


def elements(node: Node) -> Iterator[Node]:
    todo = [node]
    while todo:
        top = todo.pop()
        yield top
        todo.extend(c for c in reversed(top.children) if isinstance(c, Node))


def pruned(node: Node, templates: frozenset[int] | set[int], trust_markup: bool = True) -> None:
    """Deletes, below a node, templates, what never is on screen and, if trusted, elements that say they are no main text."""
    todo = [node]
    while todo:
        top = todo.pop()
        top.children = [c for c in top.children if isinstance(c, str) or not (c.slot in templates or c.tag in NO_SCREEN or (trust_markup and dropped(c)))]
        todo.extend(c for c in top.children if isinstance(c, Node))


def text_of(node: Node) -> str:
    """Blocks in page order, one a line; references decoded, white space inside a block one space."""
    blocks: list[str] = []
    held: list[str] = []

    def flush() -> None:
        text = " ".join(html.unescape("".join(held)).split())
        if text:
            blocks.append(text)
        held.clear()

    todo: list = [node]
    while todo:
        top = todo.pop()
        if top is None:
            flush()
        elif isinstance(top, str):
            held.append(top)
        elif top.tag == "br":
            held.append(" ")
        elif top.tag in INLINE:
            todo.extend(reversed(top.children))
        else:
            flush()
            todo.append(None)
            todo.extend(reversed(top.children))
    flush()
    return "\n".join(blocks)


def marked_main(root: Node) -> list[Node]:
    """The topmost article elements, or else main elements, that are not within a dropped one; none if the page has neither."""
    for wanted in (lambda n: n.tag == "article", lambda n: n.tag == "main" or n.attributes().get("role") == "main" or n.attributes().get("itemprop") == "articleBody"):
        found: list[Node] = []
        todo = [root]
        while todo:
            top = todo.pop()
            for child in top.children:
                if isinstance(child, Node) and not dropped(child):
                    if wanted(child):
                        found.append(child)
                    else:
                        todo.append(child)
        if found:
            return found
    return []


def scope_of(root: Node, trust_markup: bool) -> Node:
    """What the main text is in: the marked article, the smallest element that holds all of several, or the page."""
    found = marked_main(root) if trust_markup else []
    if not found:
        return root
    if len(found) == 1:
        return found[0]

    def above(node: Node) -> list[Node]:
        out = [node]
        while out[-1].parent is not None:
            out.append(out[-1].parent)
        return out[::-1]

    paths = [above(n) for n in found]
    common = root
    for level in zip(*paths, strict=False):
        if any(n is not level[0] for n in level):
            break
        common = level[0]
    return common


def subtrees(page: str, trust_markup: bool = True) -> tuple[int, list[tuple[int, int]]]:
    """A hash of the page's article, and slot and content of all that may be a template: never the article or what holds it.

    The text blocks of a marked article, and what holds half of its text or more, are no templates either. A slot that stands several times on a page has one content.
    """
    root = parse(page)
    described(root)
    article = scope_of(root, trust_markup)
    above = set()
    node: Node | None = article
    while node is not None:
        above.add(id(node))
        node = node.parent
    found: dict[int, list[str]] = {}
    todo = [(root, False)]
    while todo:
        top, inside = todo.pop()
        for child in reversed(top.children):
            if isinstance(child, Node) and child.tag not in NO_SCREEN and child.digest:
                within = inside or child is article
                if child.tag not in INLINE and child.tag != "body" and id(child) not in above and not (within and (child.tag in TEXT_BLOCKS or 2 * child.length >= article.length)):
                    found.setdefault(child.slot, []).append(f"{child.digest:x}")
                todo.append((child, within))
    return article.digest, [(slot, digest_of(*contents)) for slot, contents in sorted(found.items())]


def extract_text(page: str, templates: frozenset[int] | set[int] = frozenset(), trust_markup: bool = True) -> str:
    """The main text of one page, given its host's template slots."""
    root = parse(page)
    if templates or not trust_markup:
        described(root)
    scope = scope_of(root, trust_markup)
    pruned(scope, templates, trust_markup)
    return text_of(scope)


def host_of(url: F.Column) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, min_recurring: float = MIN_RECURRING, trust_markup: bool = True) -> DataFrame:
    """(host, slot): the template slots of each host of (host, html).

    Pages with one article (without a marked one: with one text) count once, so that copies of a page are no evidence
    of a template.
    """

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for host, page in rows:
            article, found = subtrees(page, trust_markup)
            yield host, signed(article), [{"slot": signed(a), "content": signed(b)} for a, b in found]

    found = checkpointed(arrow_rows(pages.select("host", "html"), "host string, article long, slots array<struct<slot: long, content: long>>", run))
    each = found.select("host", "article", F.explode("slots").alias("s")).select("host", "article", "s.slot", "s.content").distinct()
    articles = found.select("host", "article").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("articles"))
    contents = each.groupBy("host", "slot", "content").agg(F.count(F.lit(1)).alias("n"))
    counts = contents.groupBy("host", "slot").agg(F.sum("n").alias("total"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("recurring"))
    chosen = counts.where((F.col("total") >= min_pages) & (F.col("recurring") >= min_recurring * F.col("total")))
    return chosen.join(articles, "host").where(F.col("total") >= F.lit(min_share) * F.col("articles")).select("host", "slot")


def extract(pages: DataFrame, *, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, min_recurring: float = MIN_RECURRING, trust_markup: bool = True, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page, from its whole html.

    Null and empty html give an empty text; pages without a url share one host; a page_id may be null or repeated, as templates are
    found by host. Repeated rows give repeated results and are one article, an empty table gives none, other columns
    are left aside. Two contents that are as frequent are both templates or both none, so ties can't arise.
    A host's slots stand on ``min_share`` of its pages each, so its list is no longer than some pages' own.
    """
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"), host_of(F.col(url_col)).alias("host"))
    chosen = checkpointed(templates(own, min_pages, min_share, min_recurring, trust_markup))
    by_host = chosen.groupBy("host").agg(F.collect_set("slot").alias("slots"))
    if chosen.count() <= BROADCAST_SLOTS:
        marked = own.join(F.broadcast(by_host), "host", "left")
    else:
        salted = by_host.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        marked = own.withColumn("salt", F.pmod(F.xxhash64("page_id", "url", "html"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for page_id, page, url, found in rows:
            text = extract_text(page, {x & (1 << 64) - 1 for x in found or ()}, trust_markup)
            yield page_id, url, text, len(text)

    return arrow_rows(marked.select("page_id", "html", "url", "slots"), "page_id long, url string, text string, n_chars long", run)
