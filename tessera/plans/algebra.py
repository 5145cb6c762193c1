"""Nodes of a query: terms, patterns, expressions and forms."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
SH = "http://www.w3.org/ns/shacl#"
TYPE = RDF + "type"


class QueryError(ValueError):
    """A query that can't be read or is not supported."""


@dataclass(frozen=True)
class Iri:
    value: str


@dataclass(frozen=True)
class Literal:
    value: str
    datatype: str = XSD + "string"
    lang: str = ""


@dataclass(frozen=True)
class Var:
    name: str


Term = Iri | Literal | Var


@dataclass(frozen=True)
class Path:
    """A property path: op is one of / | ^ * + ? !; parts are paths, IRIs or, for !, (IRI, inverse) pairs."""

    op: str
    parts: tuple


@dataclass(frozen=True)
class Triple:
    s: Term
    p: Term | Path
    o: Term


@dataclass(frozen=True)
class Call:
    """An expression: a function or operator on arguments (terms, calls, or patterns for exists)."""

    name: str
    args: tuple = ()


@dataclass(frozen=True)
class Aggregate:
    name: str
    arg: Any
    distinct: bool = False
    separator: str = " "


@dataclass
class Node:
    """A pattern; ``op`` names it, ``parts`` are its operands."""

    op: str
    parts: list = field(default_factory=list)


@dataclass
class Query:
    form: str
    where: Node
    project: list[tuple[str, Any]] | None = None
    distinct: bool = False
    template: list[Triple] = field(default_factory=list)
    targets: list[Term] = field(default_factory=list)
    group: list[tuple[str, Any]] | None = None
    having: list = field(default_factory=list)
    order: list[tuple[Any, bool]] = field(default_factory=list)
    limit: int | None = None
    offset: int = 0
    default_graphs: list[str] = field(default_factory=list)
    named_graphs: list[str] = field(default_factory=list)
    values: Node | None = None
    uses_graphs: bool = False
