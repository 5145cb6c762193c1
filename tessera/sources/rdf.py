"""RDF files as quads: N-Triples and N-Quads by columns alone; Turtle, TriG, RDF/XML and JSON-LD by small parsers."""

from __future__ import annotations

import hashlib
import json
import re
import xml.etree.ElementTree as ET
from urllib.parse import urljoin

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.algebra import RDF, XSD
from ..plans.parser import TOKENS, tokenize, unescape
from .quads import COLUMNS

Quad = tuple[str, str, str, str, str, str, str, str]

NODE = r"(?:<([^>]*)>|_:(\S+?))"
LINE = r'^\s*(?:<([^>]*)>|_:(\S+))\s+<([^>]*)>\s+(?:<([^>]*)>|_:([^\s.]+)|"((?:[^"\\]|\\.)*)"(?:\^\^<([^>]*)>|@([A-Za-z0-9-]+))?)\s*(?:<([^>]*)>|_:(\S+))?\s*\.\s*(?:#.*)?$'


def line_quads(lines: DataFrame, graph: str, column: str = "value") -> DataFrame:
    """Quads of N-Triples or N-Quads lines, without leaving the JVM; lines that are no statements are left out.

    Escapes of tabs, line ends, quotes and backslashes are undone; \\u escapes are kept as written.
    """
    part = lambda n: F.regexp_extract(F.col(column), LINE, n)
    matched = lines.where(F.col(column).rlike(LINE))
    body = part(6)
    for written, meant in (("\\\\", "\x00"), ('\\"', '"'), ("\\n", "\n"), ("\\t", "\t"), ("\\r", "\r"), ("\x00", "\\")):
        body = F.replace(body, F.lit(written), F.lit(meant))
    kind = F.when(part(4) != "", "iri").when(part(5) != "", "bnode").otherwise("literal")
    return matched.select(
        F.when(part(9) != "", part(9)).otherwise(F.lit(graph)).alias("g"),
        F.when(part(1) != "", part(1)).otherwise(part(2)).alias("s"),
        F.when(part(1) != "", "iri").otherwise("bnode").alias("s_kind"),
        part(3).alias("p"),
        F.when(kind == "iri", part(4)).when(kind == "bnode", part(5)).otherwise(body).alias("o"),
        kind.alias("o_kind"),
        F.when(kind != "literal", "").when(part(7) != "", part(7)).when(part(8) != "", RDF + "langString").otherwise(XSD + "string").alias("o_dt"),
        F.lower(part(8)).alias("o_lang"),
    )


class TurtleError(ValueError):
    """Text that is no Turtle or TriG."""


class Turtle:
    """A reader of Turtle and TriG; blank nodes are named after the file and their place."""

    def __init__(self, text: str, graph: str = "", base: str = "", name: str = "", prefixes: dict[str, str] | None = None) -> None:
        assert TOKENS
        self.tokens, self.at = tokenize(text), 0
        self.graph, self.base, self.prefixes = graph, base, dict(prefixes or {})
        self.salt = hashlib.sha256(name.encode()).hexdigest()[:16]
        self.count = 0
        self.out: list[Quad] = []

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else ("end", "")

    def take(self) -> tuple[str, str]:
        self.at += 1
        return self.tokens[self.at - 1] if self.at <= len(self.tokens) else ("end", "")

    def want(self, value: str) -> None:
        if self.take()[1] != value:
            raise TurtleError(f"expected {value!r} before {self.peek()[1]!r}")

    def blank(self, label: str | None = None) -> tuple[str, str]:
        if label is None:
            self.count += 1
            label = f"g{self.count}"
        return f"{self.salt}-{label}", "bnode"

    def read(self) -> list[Quad]:
        while self.peek()[0] != "end":
            kind, value = self.peek()
            word = value.lower()
            if kind == "lang" and word in ("@prefix", "@base") or kind == "word" and word in ("prefix", "base"):
                self.take()
                if word.endswith("prefix"):
                    prefix = self.take()[1].rstrip(":")
                    self.prefixes[prefix] = self.iri(self.take())
                else:
                    self.base = self.iri(self.take())
                if kind == "lang":
                    self.want(".")
            elif kind == "word" and word == "graph" or value == "{" or self.peek(1)[1] == "{":
                if kind == "word":
                    self.take()
                outer = self.graph
                if self.peek()[1] != "{":
                    self.graph = self.node()[0]
                self.want("{")
                while self.peek()[1] != "}":
                    self.statement()
                    if self.peek()[1] != "}":
                        self.want(".")
                self.want("}")
                self.graph = outer
            else:
                self.statement()
                self.want(".")
        return self.out

    def iri(self, token: tuple[str, str]) -> str:
        kind, value = token
        if kind == "iri":
            inner = unescape(value[1:-1])
            return urljoin(self.base, inner) if self.base else inner
        if kind == "pname":
            prefix, _, local = value.partition(":")
            if prefix not in self.prefixes:
                raise TurtleError(f"unknown prefix {prefix!r}")
            return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)
        if value == "a":
            return RDF + "type"
        raise TurtleError(f"expected an IRI, found {value!r}")

    def statement(self) -> None:
        alone = self.peek()[1] == "["
        subject = self.node()
        if alone and self.peek()[1] in (".", "}"):
            return
        self.properties(subject)

    def properties(self, subject: tuple) -> None:
        while True:
            predicate = self.iri(self.take())
            while True:
                o = self.node()
                self.out.append((self.graph, subject[0], subject[1], predicate, o[0], o[1], o[2] if len(o) > 2 else "", o[3] if len(o) > 3 else ""))
                if self.peek()[1] != ",":
                    break
                self.take()
            while self.peek()[1] == ";":
                self.take()
            if self.peek()[1] in (".", "]", "}") or self.peek()[0] == "end":
                return

    def node(self) -> tuple:
        kind, value = self.peek()
        if value == "[":
            self.take()
            me = self.blank()
            if self.peek()[1] != "]":
                self.properties(me)
            self.want("]")
            return me
        if value == "(":
            self.take()
            items = []
            while self.peek()[1] != ")":
                items.append(self.node())
            self.take()
            rest: tuple = (RDF + "nil", "iri")
            for item in reversed(items):
                cell = self.blank()
                self.out.append((self.graph, *cell, RDF + "first", item[0], item[1], *(item[2:] or ("", ""))))
                self.out.append((self.graph, *cell, RDF + "rest", rest[0], rest[1], "", ""))
                rest = cell
            return rest
        self.take()
        if kind == "bnode":
            return self.blank(value[2:])
        if kind == "string":
            body = unescape(value[3:-3] if value[:3] in ('"""', "'''") else value[1:-1])
            if self.peek()[0] == "lang":
                return body, "literal", RDF + "langString", self.take()[1][1:].lower()
            if self.peek()[1] == "^^":
                self.take()
                return body, "literal", self.iri(self.take()), ""
            return body, "literal", XSD + "string", ""
        if kind == "op" and value in "+-":
            number = self.take()[1]
            return value.replace("+", "") + number, "literal", self.number(number), ""
        if kind == "number":
            return value, "literal", self.number(value), ""
        if kind == "word" and value in ("true", "false"):
            return value, "literal", XSD + "boolean", ""
        return self.iri((kind, value)), "iri"

    @staticmethod
    def number(value: str) -> str:
        return XSD + ("double" if "e" in value.lower() else "decimal" if "." in value else "integer")


def rdf_xml(text: str, graph: str, name: str = "") -> list[Quad]:
    """Node and property elements, attributes, rdf:resource, rdf:nodeID, datatypes, languages and parseType Resource."""
    out: list[Quad] = []
    salt = hashlib.sha256(name.encode()).hexdigest()[:16]
    counter = iter(range(1 << 60))
    xml = "{http://www.w3.org/XML/1998/namespace}"
    r = f"{{{RDF}}}"
    plain = lambda tag: tag[1:].replace("}", "")

    def subject(el) -> tuple[str, str]:
        if r + "about" in el.attrib:
            return el.attrib[r + "about"], "iri"
        if r + "ID" in el.attrib:
            return "#" + el.attrib[r + "ID"], "iri"
        return f"{salt}-{el.attrib.get(r + 'nodeID', f'x{next(counter)}')}", "bnode"

    def node(el, lang: str) -> tuple[str, str]:
        me = subject(el)
        lang = el.attrib.get(xml + "lang", lang)
        if el.tag != r + "Description":
            out.append((graph, *me, RDF + "type", plain(el.tag), "iri", "", ""))
        for key, value in el.attrib.items():
            if not key.startswith((r, xml)):
                out.append((graph, *me, plain(key), value, "literal", RDF + "langString" if lang else XSD + "string", lang))
        for p in el:
            inner_lang = p.attrib.get(xml + "lang", lang).lower()
            if r + "resource" in p.attrib:
                o = (p.attrib[r + "resource"], "iri", "", "")
            elif r + "nodeID" in p.attrib:
                o = (f"{salt}-{p.attrib[r + 'nodeID']}", "bnode", "", "")
            elif p.attrib.get(r + "parseType") == "Resource":
                inner = ET.Element(r + "Description")
                inner.extend(list(p))
                o = (*node(inner, inner_lang), "", "")
            elif len(p):
                o = (*node(p[0], inner_lang), "", "")
            else:
                dt = p.attrib.get(r + "datatype", RDF + "langString" if inner_lang else XSD + "string")
                o = (p.text or "", "literal", dt, inner_lang if dt.endswith("langString") else "")
            out.append((graph, *me, plain(p.tag), *o))
        return me

    root = ET.fromstring(text)
    for el in root if root.tag == r + "RDF" else [root]:
        node(el, "")
    return out


def json_ld(text: str, graph: str, name: str = "", namespaces: dict[str, str] | None = None) -> list[Quad]:
    """Expanded or compacted objects with an inline context: prefixes, @vocab, @base, terms, @id, @type, @value, @list, @graph."""
    out: list[Quad] = []
    salt = hashlib.sha256(name.encode()).hexdigest()[:16]
    counter = iter(range(1 << 60))

    def context(given, old: dict) -> dict:
        made = dict(old)
        for one in given if isinstance(given, list) else [given]:
            if isinstance(one, dict):
                made |= one
        return made

    def expand(term: str, ctx: dict, vocab: bool) -> str:
        found = ctx.get(term) if vocab else None
        if found is not None:
            term = found["@id"] if isinstance(found, dict) else found
        if term.startswith(("@", "_:")) or "://" in term:
            return term
        prefix, colon, local = term.partition(":")
        if colon and isinstance(ctx.get(prefix), str):
            return ctx[prefix] + local
        if colon and namespaces and prefix in namespaces:
            return namespaces[prefix] + local
        if vocab:
            return ctx.get("@vocab", "") + term if not colon else term
        return urljoin(ctx.get("@base", ""), term)

    def value(v, ctx: dict, hint: str | None) -> tuple | None:
        if isinstance(v, dict):
            if "@value" in v:
                raw, lang = v["@value"], v.get("@language", "").lower()
                dt = expand(v["@type"], ctx, True) if "@type" in v else RDF + "langString" if lang else scalar(raw)[2]
                return (scalar(raw)[0], "literal", dt, lang)
            if "@list" in v:
                rest: tuple = (RDF + "nil", "iri", "", "")
                for item in reversed([value(x, ctx, hint) for x in v["@list"]]):
                    cell = (f"{salt}-j{next(counter)}", "bnode")
                    out.append((graph, *cell, RDF + "first", *item))
                    out.append((graph, *cell, RDF + "rest", *rest))
                    rest = (*cell, "", "")
                return rest
            return (*node(v, ctx), "", "")
        if hint == "@id" and isinstance(v, str):
            return (expand(v, ctx, False), "iri", "", "")
        if v is None:
            return None
        lexical, kind, dt, lang = scalar(v)
        return (lexical, kind, expand(hint, ctx, True) if hint and hint != "@id" else dt, lang)

    def node(obj: dict, ctx: dict) -> tuple[str, str]:
        ctx = context(obj.get("@context", {}), ctx)
        iri = obj.get("@id") or obj.get("id")
        me = (f"{salt}-j{next(counter)}", "bnode") if iri is None else (f"{salt}-{iri[2:]}", "bnode") if iri.startswith("_:") else (expand(iri, ctx, False), "iri")
        types = obj.get("@type", [])
        for t in types if isinstance(types, list) else [types]:
            out.append((graph, *me, RDF + "type", expand(t, ctx, True), "iri", "", ""))
        for key, found in obj.items():
            if key.startswith("@"):
                continue
            p = expand(key, ctx, True)
            if not re.match(r"[A-Za-z][\w+.-]*:", p):
                continue
            hint = ctx[key].get("@type") if isinstance(ctx.get(key), dict) else None
            for one in found if isinstance(found, list) else [found]:
                o = value(one, ctx, hint)
                if o is not None:
                    out.append((graph, *me, p, *o))
        return me

    data = json.loads(text)
    for obj in data if isinstance(data, list) else [data]:
        ctx = context(obj.get("@context", {}), {})
        for inner in obj["@graph"] if "@graph" in obj else [obj]:
            node(inner, ctx)
    return out


def scalar(v) -> tuple[str, str, str, str]:
    if isinstance(v, bool):
        return str(v).lower(), "literal", XSD + "boolean", ""
    if isinstance(v, int):
        return str(v), "literal", XSD + "integer", ""
    if isinstance(v, float):
        return str(v), "literal", XSD + "double", ""
    return str(v), "literal", XSD + "string", ""


def parse_text(text: str, suffix: str, graph: str, name: str, prefixes: dict[str, str] | None = None) -> list[Quad]:
    """Quads of one file by its suffix."""
    if suffix in (".rdf", ".xml"):
        return rdf_xml(text, graph, name)
    if suffix == ".jsonld":
        return json_ld(text, graph, name, prefixes)
    return Turtle(text, graph, name=name, prefixes=prefixes).read()


__all__ = ["COLUMNS", "Turtle", "TurtleError", "json_ld", "line_quads", "parse_text", "rdf_xml"]
