"""Ordinary tables as RDF: rows are subjects, columns predicates, each table a class and a named graph.

A pattern of one subject with several predicates is one scan of one table. Keys stay keys: IRIs of a table are
kept as key values below the table's template, so joins and filters run on the stored columns.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.algebra import TYPE, XSD, Iri, Literal, Term, Var
from ..plans.bindings import BOOL, IRI, STR, Kind, Rel, Value, as_kind, constant, join, name, union

KINDS = {"string": STR, "boolean": BOOL, "double": Kind("num", XSD + "double"), "float": Kind("num", XSD + "double"), "date": Kind("date", XSD + "date"), "timestamp": Kind("ts", XSD + "dateTime"), "timestamp_ntz": Kind("ts", XSD + "dateTime")}


@dataclass(frozen=True)
class Field:
    """A predicate's column; with a template, its values are keys of subjects below that template."""

    column: str
    template: str = ""


@dataclass
class Table:
    df: DataFrame
    key: str
    template: str
    type_iri: str
    graph: str
    fields: dict[str, Field]

    def __post_init__(self) -> None:
        self.types = dict(self.df.dtypes)

    def kind(self, field: Field) -> Kind:
        if field.template:
            return Kind("iri", template=field.template)
        return KINDS.get(self.types[field.column], Kind("num", XSD + "integer"))

    def key_of(self, iri: str, template: str, column: str) -> Column | None:
        """The stored value for an IRI below a template; None if there can be none."""
        if not iri.startswith(template):
            return None
        rest = iri[len(template) :]
        if self.types[column] != "string":
            if not rest.lstrip("-").isdigit() or rest != str(int(rest)):
                return None
            return F.lit(int(rest)).cast(self.types[column])
        return F.lit(rest)


class Tables:
    """A dataset of mapped tables."""

    def __init__(self, spark: SparkSession, tables: list[Table], default_graphs: list[str] | None = None, named_graphs: list[str] | None = None) -> None:
        self.spark, self.tables = spark, tables
        self.default_graphs, self.named_graphs = default_graphs, named_graphs

    def restricted(self, default: list[str], named: list[str]) -> Tables:
        """The dataset that FROM and FROM NAMED ask for."""
        return Tables(self.spark, self.tables, default, named)

    def in_scope(self, graph: Term | None) -> list[Table]:
        allowed = self.default_graphs if graph is None else self.named_graphs
        return [t for t in self.tables if (allowed is None or t.graph in allowed) and (not isinstance(graph, Iri) or t.graph == graph.value)]

    def star(self, subject: Term, pairs: list[tuple[Term, Term]], graph: Term | None, known: dict[str, Kind] | None = None) -> Rel:
        """Solutions of patterns with one subject: a scan for each table that has all predicates.

        Tables of one template describe the same subjects, so there the predicates are looked up in each and joined.
        ``known`` kinds of variables leave out tables and columns whose IRIs can't be among theirs.
        """
        known = known or {}
        found: list[Rel] = []
        scope = [t for t in self.in_scope(graph) if not self.apart(known, subject, t.template)]
        together: dict[str, list[Table]] = {}
        for t in scope:
            together.setdefault(t.template, []).append(t)
        if len(pairs) > 1 and not isinstance(graph, Var):
            for same in [x for x in together.values() if len(x) > 1]:
                scope = [t for t in scope if t not in same]
                parts = [[r for t in same if not self.unfit(t, p, o, known) and (r := self._scan(t, subject, [(p, o)], graph)) is not None] for p, o in pairs]
                if all(parts):
                    each = (reduce(union, rels) for rels in parts)
                    found.append(reduce(join, (Rel(r.df.distinct(), r.kinds) for r in each)))
        for t in scope:
            if any(self.unfit(t, p, o, known) for p, o in pairs):
                continue
            if all(isinstance(p, Iri) for p, _ in pairs):
                rel = self._scan(t, subject, pairs, graph)
                if rel is not None:
                    found.append(rel)
            else:
                (predicate, obj), = pairs
                for p in [TYPE, *t.fields]:
                    rel = self._scan(t, subject, [(Iri(p), obj)], graph, predicate)
                    if rel is not None:
                        found.append(rel)
        if found:
            return reduce(union, found)
        names = list(dict.fromkeys(x.name for x in (subject, graph, *(y for pair in pairs for y in pair)) if isinstance(x, Var)))
        columns = [F.lit(None).cast("string").alias(name(v)) for v in names]
        return Rel(self.spark.range(0).select(*columns), dict.fromkeys(names, IRI), none=True)

    @staticmethod
    def apart(known: dict[str, Kind], term: Term, template: str) -> bool:
        """Whether a variable's IRIs are known to lie below another template."""
        kind = known.get(term.name) if isinstance(term, Var) else None
        return kind is not None and kind.name == "iri" and not kind.maybe and bool(kind.template) and not kind.template.startswith(template) and not template.startswith(kind.template)

    def unfit(self, t: Table, predicate: Term, obj: Term, known: dict[str, Kind]) -> bool:
        """Whether a column's IRIs are known not to be a variable's."""
        field = t.fields.get(predicate.value) if isinstance(predicate, Iri) else None
        return field is not None and bool(field.template) and self.apart(known, obj, field.template)

    def _scan(self, t: Table, subject: Term, pairs: list[tuple[Term, Term]], graph: Term | None, predicate: Var | None = None) -> Rel | None:
        filters: list[Column] = []
        bound: dict[str, Value] = {}

        def bind(var: Var, value: Value) -> None:
            if var.name in bound:
                old = bound[var.name]
                if old.kind.name != value.kind.name:
                    filters.append(F.lit(False))
                else:
                    kind = old.kind if old.kind == value.kind else Kind(old.kind.name, XSD + "double" if old.kind.name == "num" else old.kind.dt)
                    filters.append(as_kind(old, kind) == as_kind(value, kind))
            else:
                bound[var.name] = value

        if isinstance(subject, Var):
            bind(subject, Value(F.col(t.key), Kind("iri", template=t.template)))
        else:
            key = t.key_of(subject.value, t.template, t.key) if isinstance(subject, Iri) else None
            if key is None:
                return None
            filters.append(F.col(t.key) == key)
        for p, obj in pairs:
            if p.value == TYPE:
                if isinstance(obj, Var):
                    bind(obj, Value(F.lit(t.type_iri), IRI))
                elif obj != Iri(t.type_iri):
                    return None
                continue
            field = t.fields.get(p.value)
            if field is None:
                return None
            kind, column = t.kind(field), F.col(field.column)
            filters.append(column.isNotNull())
            if isinstance(obj, Var):
                bind(obj, Value(column, kind))
            elif isinstance(obj, Iri):
                key = t.key_of(obj.value, field.template, field.column) if kind.name == "iri" else None
                if key is None:
                    return None
                filters.append(column == key)
            else:
                assert isinstance(obj, Literal)
                value = constant(obj)
                if value.kind.name != kind.name:
                    return None
                filters.append(column == value.col)
        if predicate is not None:
            bind(predicate, Value(F.lit(pairs[0][0].value), IRI))
        if isinstance(graph, Var):
            bind(graph, Value(F.lit(t.graph), IRI))
        df = t.df
        for f in filters:
            df = df.where(f)
        # Numbers are longs or doubles from here on.
        columns = [(v.col.cast("long") if v.kind.name == "num" and v.kind.dt == XSD + "integer" else v.col).alias(name(x)) for x, v in bound.items()]
        return Rel(df.select(*columns) if columns else df.select(F.lit(1).alias("one")), {x: v.kind for x, v in bound.items()})

    def size_hint(self, subject: Term, pairs: list[tuple[Term, Term]]) -> int:
        """Less for patterns that are likely to have fewer solutions."""
        return 10 * isinstance(subject, Var) - 3 * sum(not isinstance(o, Var) for p, o in pairs if p != Iri(TYPE)) + sum(isinstance(p, Var) for p, _ in pairs) * 20

    def quads(self) -> DataFrame:
        """All triples, with their graphs, as a quad table."""
        from .quads import from_rel

        parts = []
        for t in self.tables:
            for p in [TYPE, *t.fields]:
                rel = self._scan(t, Var("s"), [(Iri(p), Var("o"))], None)
                if rel is not None:
                    parts.append(from_rel(rel, "s", p, "o", t.graph))
        return reduce(DataFrame.unionByName, parts)
