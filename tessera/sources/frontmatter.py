"""Documents to triples: metadata mappings by the rules of the knowledge base's configuration."""

from __future__ import annotations

import datetime
import hashlib
import json
import re
import tomllib
from dataclasses import dataclass, field

import yaml

from ..plans.algebra import RDF, SH, XSD
from .rdf import Quad, TurtleError, parse_text

#: Prefixes that every configuration has.
PREFIXES = {
    "rdf": RDF,
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "owl": "http://www.w3.org/2002/07/owl#",
    "xsd": XSD,
    "sh": SH,
    "schema": "https://schema.org/",
    "foaf": "http://xmlns.com/foaf/0.1/",
    "skos": "http://www.w3.org/2004/02/skos/core#",
    "dcterms": "http://purl.org/dc/terms/",
    "prov": "http://www.w3.org/ns/prov#",
}
DOCUMENTS = (".md", ".yaml", ".yml", ".json", ".toml")
FENCE = re.compile(r"^```turtle[^\n]*\n(.*?)^```", re.S | re.M)
UNSAFE = re.compile(r"[\s\x00-\x1f?#%]")


@dataclass
class Config:
    """What decides how metadata become triples."""

    base_iri: str = "http://example.org/wiki/"
    vocab: str | None = "https://schema.org/"
    prefixes: dict[str, str] = field(default_factory=dict)
    implicit_types: list[str] = field(default_factory=list)
    #: fallback: for documents without types; append: in addition.
    implicit_policy: str = "fallback"
    content_predicate: str | None = None

    @property
    def namespaces(self) -> dict[str, str]:
        return PREFIXES | {"wiki": self.base_iri} | self.prefixes


def load_yaml(text: str):
    """What a YAML text says, read by the C library where it is installed."""
    return yaml.load(text, getattr(yaml, "CSafeLoader", yaml.SafeLoader))


def split_markdown(text: str) -> tuple[str, str]:
    """(metadata text, body): metadata stand between a first line of three dashes and the next three dashes."""
    if not text.startswith("---"):
        return "", text
    parts = text.split("---", 2)
    return (parts[1], parts[2]) if len(parts) == 3 else ("", text)


def metadata(path: str, text: str) -> tuple[dict | None, str]:
    """(mapping, body) of a document; None if there is no mapping."""
    suffix = "." + path.rpartition(".")[2].lower()
    try:
        if suffix == ".md":
            head, body = split_markdown(text)
            data = load_yaml(head) if head.strip() else None
        elif suffix in (".yaml", ".yml"):
            data, body = load_yaml(text), ""
        elif suffix == ".json":
            data, body = json.loads(text), ""
        else:
            data, body = tomllib.loads(text), ""
    except (yaml.YAMLError, ValueError):
        return None, text if suffix == ".md" else ""
    return (data if isinstance(data, dict) else None), body


def route_of(path: str) -> str:
    """The path without its suffix and without a last 'index'."""
    route = re.sub(r"\.(md|yaml|yml|json|toml)$", "", path, flags=re.I)
    return re.sub(r"(^|/)index$", "", route)


def expand(name: str, c: Config, vocab: bool) -> str | None:
    """An IRI for a name: a known prefix's; else, of keys and types, the wiki's own or the vocabulary's.

    Other names, of documents and things (``vocab`` false), stand for themselves, as urn: and mailto: do.
    """
    prefix, colon, local = name.partition(":")
    if colon and prefix in c.namespaces:
        return c.namespaces[prefix] + local
    if name.startswith(("http://", "https://")):
        return name
    if not vocab:
        return name
    if name.startswith("wiki."):
        return c.base_iri + name[5:]
    return c.vocab + name if c.vocab else None


def as_list(v) -> list:
    return v if isinstance(v, list) else [] if v is None else [v]


def scalar(v, c: Config) -> tuple[str, str, str, str] | None:
    """(form, kind, datatype, language) of a plain value."""
    if v is None:
        return None
    if isinstance(v, str):
        prefix, colon, local = v.partition(":")
        if v.startswith("http"):
            return v, "iri", "", ""
        if colon and prefix in c.namespaces and not re.search(r"[ \n]", v):
            return c.namespaces[prefix] + local, "iri", "", ""
        return v, "literal", XSD + "string", ""
    if isinstance(v, bool):
        return str(v).lower(), "literal", XSD + "boolean", ""
    if isinstance(v, int):
        return str(v), "literal", XSD + "integer", ""
    if isinstance(v, float):
        return repr(v), "literal", XSD + "double", ""
    if isinstance(v, (datetime.datetime, datetime.time)):
        return v.isoformat(), "literal", XSD + "dateTime", ""
    if isinstance(v, datetime.date):
        return v.isoformat(), "literal", XSD + "date", ""
    return str(v), "literal", XSD + "string", ""


def types_of(data: dict, c: Config) -> list[str]:
    """Types of a document, in order, without repeats; shapes get no implicit ones appended."""
    own = [t for x in as_list(data.get("@type", data.get("type"))) if (t := expand(str(x), c, True))]
    implicit = [t for x in c.implicit_types if (t := expand(x, c, True))]
    shape = any(t.startswith(SH) for t in own)
    if not own:
        own = implicit
    elif c.implicit_policy == "append" and not shape:
        own = own + implicit
    return list(dict.fromkeys(own))


def document_quads(path: str, text: str, c: Config, graph: str) -> tuple[list[Quad], list[str]]:
    """(quads, warnings) of one document: its metadata, if it has a type, and its fenced Turtle."""
    quads: list[Quad] = []
    warnings: list[str] = []
    data, body = metadata(path, text)
    if path.endswith(".md"):
        for n, block in enumerate(FENCE.findall(text)):
            try:
                quads += parse_text(block, ".ttl", graph, f"{path}#{n}", c.namespaces)
            except (TurtleError, ValueError) as e:
                warnings.append(f"{path}: fenced Turtle: {e}")
    if data is None:
        return quads, warnings
    route = route_of(path)
    if any(UNSAFE.search(part) for part in route.split("/")):
        return quads, [*warnings, f"{path}: unsafe route"]
    types = types_of(data, c)
    if not types:
        return quads, warnings
    given = data.get("@id") or data.get("id")
    subject = expand(given, c, False) if isinstance(given, str) and (":" in given) else None
    subject = subject or (urn(given, c) if isinstance(given, str) else c.base_iri + route)

    def add(s: tuple[str, str], p: str, v, place: str) -> None:
        if isinstance(v, dict):
            ref = v.get("@id")
            if isinstance(ref, str):
                quads.append((graph, *s, p, expand(ref, c, False) if ":" in ref else urn(ref, c), "iri", "", ""))
                return
            inner = (hashlib.sha256(f"{path}|{place}".encode()).hexdigest()[:24], "bnode")
            quads.append((graph, *s, p, *inner, "", ""))
            for t in as_list(v.get("@type", v.get("type"))):
                if (iri := expand(str(t), c, True)) is not None:
                    quads.append((graph, *inner, RDF + "type", iri, "iri", "", ""))
            for key, value in v.items():
                if not key.startswith("@") and key not in ("type", "id") and (q := expand(key, c, True)) is not None:
                    add(inner, q, value, f"{place}.{key}")
            return
        o = scalar(v, c)
        if o is not None:
            quads.append((graph, *s, p, *o))

    me = (subject, "iri")
    quads += [(graph, *me, RDF + "type", t, "iri", "", "") for t in types]
    for key, value in data.items():
        if key.startswith("@") or key in ("type", "id") or (p := expand(key, c, True)) is None:
            continue
        if isinstance(value, list):
            for n, item in enumerate(value):
                add(me, p, item, f"{key}[{n}]")
        elif value or isinstance(value, dict):
            # A false, zero or empty value gives no triple at the top.
            add(me, p, value, key)
    if c.content_predicate and body.strip() and (p := expand(c.content_predicate, c, True)) is not None:
        add(me, p, body.strip(), "body")
    return quads, warnings


def urn(name: str, c: Config) -> str:
    return name if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", name) else c.base_iri + name


def typed_rows(data, place: str = "") -> list[tuple[str, str | None, str]]:
    """(key path, value, type) of every leaf and container of a mapping."""
    if isinstance(data, dict):
        own = [(place, None, "map")] if place else []
        return own + [row for k, v in data.items() for row in typed_rows(v, f"{place}.{k}" if place else str(k))]
    if isinstance(data, list):
        return [(place, None, "list")] + [row for n, v in enumerate(data) for row in typed_rows(v, f"{place}[{n}]")]
    if data is None:
        return [(place, None, "null")]
    kind = "bool" if isinstance(data, bool) else "int" if isinstance(data, int) else "float" if isinstance(data, float) else "datetime" if isinstance(data, (datetime.datetime, datetime.time)) else "date" if isinstance(data, datetime.date) else "str"
    return [(place, str(data).lower() if kind == "bool" else str(data), kind)]
