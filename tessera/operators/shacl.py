"""SHACL core: shapes are few and are read on the driver; each constraint is one DataFrame over the data's triples.

Terms are structs of their text, kind, datatype, language and scope, so that a number and a string of the same text are different everywhere. The
scope is empty where all data are one graph; where each document is validated by itself, it is the document, and so every join stays within
one document. Each row knows the node that a shape was asked about (root), whichever nested value it has come to.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..plans.algebra import RDF, RDFS, SH, TYPE, XSD
from ..plans.bindings import NUMERIC
from .closure import transitive
from .lineage import stored

REPORT = "focus string, path string, value string, component string, severity string, message string, shape string"
NODE_KINDS = {SH + "IRI": ["iri"], SH + "BlankNode": ["bnode"], SH + "Literal": ["literal"], SH + "BlankNodeOrIRI": ["bnode", "iri"], SH + "BlankNodeOrLiteral": ["bnode", "literal"], SH + "IRIOrLiteral": ["iri", "literal"]}
ZONE = r"(Z|[+-]\d\d:\d\d)?$"
DIGITS, DECIMAL = r"^[+-]?\d+$", r"^[+-]?(\d+(\.\d*)?|\.\d+)$"
DOUBLE = r"^([+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|[+-]?INF|NaN)$"
#: The lexical forms of datatypes.
FORMS = {"decimal": DECIMAL, "double": DOUBLE, "float": DOUBLE, "boolean": "^(true|false|0|1)$", "date": r"^-?\d{4,}-\d\d-\d\d" + ZONE, "dateTime": r"^-?\d{4,}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?" + ZONE, "time": r"^\d\d:\d\d:\d\d(\.\d+)?" + ZONE, "gYear": r"^-?\d{4,}" + ZONE, "gYearMonth": r"^-?\d{4,}-\d\d" + ZONE}
#: Integers and their bounds.
INTEGERS = {"integer": (None, None), "long": (-(2**63), 2**63 - 1), "int": (-(2**31), 2**31 - 1), "short": (-(2**15), 2**15 - 1), "byte": (-128, 127), "nonNegativeInteger": (0, None), "positiveInteger": (1, None), "nonPositiveInteger": (None, 0), "negativeInteger": (None, -1), "unsignedLong": (0, 2**64 - 1), "unsignedInt": (0, 2**32 - 1), "unsignedShort": (0, 2**16 - 1), "unsignedByte": (0, 255)}


def well_formed(lex: Column, datatype: str) -> Column:
    """Whether a text is a literal of a datatype: by its form, and by its value where a form allows too much."""
    name = datatype.removeprefix(XSD)
    if name in INTEGERS:
        low, high = INTEGERS[name]
        # Longer numbers than a decimal holds are compared by their sign alone; no bounded type has any.
        value = F.coalesce(lex.try_cast("decimal(38,0)"), F.when(lex.startswith("-"), F.lit("-" + "9" * 38).cast("decimal(38,0)")).otherwise(F.lit("9" * 38).cast("decimal(38,0)")))
        ok = lex.rlike(DIGITS)
        for bound, within in ((low, lambda c: value >= c), (high, lambda c: value <= c)):
            if bound is not None:
                ok = ok & within(F.lit(str(bound)).cast("decimal(38,0)"))
        return ok
    if name not in FORMS:
        return F.lit(True)
    ok = lex.rlike(FORMS[name])
    if name in ("date", "dateTime"):
        ok = ok & (lex.startswith("-") | (F.length(F.substring_index(lex, "-", 1)) > 4) | F.substring(lex, 1, 10).try_cast("date").isNotNull())
    return ok


def struct(lex: Column, kind: Column, dt: Column, lang: Column, scope: Column) -> Column:
    blank = lambda c: F.coalesce(c, F.lit(""))
    return F.struct(lex.alias("lex"), kind.alias("kind"), blank(dt).alias("dt"), blank(lang).alias("lang"), scope.alias("scope"))


def terms(triples: DataFrame) -> DataFrame:
    """(s, p, o) of triples, or of quads that are validated graph by graph, with terms as structs."""
    scope = F.col("g") if "g" in triples.columns else F.lit("")
    return triples.select(struct(F.col("s"), F.col("s_kind"), F.lit(""), F.lit(""), scope).alias("s"), "p", struct(F.col("o"), F.col("o_kind"), F.col("o_dt"), F.col("o_lang"), scope).alias("o"))


@dataclass
class Node:
    lex: str
    kind: str = "iri"
    dt: str = ""
    lang: str = ""


@dataclass
class Shape:
    name: str
    facts: dict[str, list[Node]] = field(default_factory=lambda: defaultdict(list))

    def one(self, key: str) -> Node | None:
        found = self.facts.get(SH + key)
        return found[0] if found else None

    def all(self, key: str) -> list[Node]:
        return self.facts.get(SH + key, [])


class Shapes:
    """The shapes in a set of triples. Only triples about shapes, and the lists that they name, are collected: they don't grow with the data."""

    def __init__(self, triples: DataFrame) -> None:
        about = triples.where(F.startswith("p", F.lit(SH)) | ((F.col("p") == TYPE) & F.startswith("o", F.lit(SH))))
        self.nodes: dict[str, Shape] = {}
        self.lists: dict[str, dict[str, Node]] = defaultdict(dict)
        named: list[tuple[str]] = []
        for r in about.collect():
            self.nodes.setdefault(r["s"], Shape(r["s"])).facts[r["p"]].append(self.node(r))
            if r["o_kind"] == "bnode":
                named.append((r["o"],))
        if named:
            heads = triples.sparkSession.createDataFrame(named, "x string").distinct()
            rest = triples.where(F.col("p") == RDF + "rest").select(F.col("s").alias("x"), F.col("o").alias("y"))
            # Paths may be lists of lists.
            inner = triples.where((F.col("p") == RDF + "first") & (F.col("o_kind") == "bnode")).select(F.col("s").alias("x"), F.col("o").alias("y"))
            cells = transitive(rest.unionByName(inner), start=heads).select(F.col("y").alias("s")).unionByName(heads.select(F.col("x").alias("s"))).distinct()
            for r in triples.where(F.col("p").isin(RDF + "first", RDF + "rest")).join(cells, "s", "left_semi").collect():
                self.lists[r["s"]][r["p"]] = self.node(r)

    @staticmethod
    def node(r: Row) -> Node:
        return Node(r["o"], r["o_kind"], r["o_dt"], r["o_lang"])

    def listed(self, head: str) -> list[Node]:
        out, seen = [], set()
        while head in self.lists and head not in seen:
            seen.add(head)
            cell = self.lists[head]
            out.append(cell[RDF + "first"])
            head = cell[RDF + "rest"].lex
        return out

    def targeted(self) -> list[Shape]:
        return [s for s in self.nodes.values() if any(s.all(t) for t in ("targetClass", "targetNode", "targetSubjectsOf", "targetObjectsOf"))]


def is_term(column: Column, n: Node) -> Column:
    return (column["lex"] == n.lex) & (column["kind"] == n.kind) & (column["dt"] == n.dt) & (column["lang"] == n.lang)


def comparable(term: Column, datatype: str) -> Column:
    """A term's value in the order of a datatype; null for terms that have none there."""
    lex, dt = term["lex"], term["dt"]
    if datatype in NUMERIC:
        return F.when(dt.isin(NUMERIC), F.when(lex.isin("INF", "+INF"), F.lit(float("inf"))).when(lex == "-INF", F.lit(float("-inf"))).otherwise(lex.try_cast("double")))
    if datatype in (XSD + "date", XSD + "dateTime"):
        return F.when(dt == datatype, lex.try_cast("timestamp"))
    return F.when(dt == datatype, lex)


class Validator:
    """``data`` are terms; focus nodes are looked for in ``within``, which is all data unless given."""

    def __init__(self, data: DataFrame, shapes: Shapes, within: DataFrame | None = None) -> None:
        self.data, self.shapes = data, shapes
        self.within = data if within is None else within
        self._below: DataFrame | None = None

    def with_classes(self, triples: DataFrame) -> DataFrame:
        """(node, class) of the types in ``triples``, with the classes above that the data know."""
        types = triples.where((F.col("p") == TYPE) & (F.col("o.kind") != "literal")).select(F.col("s").alias("node"), F.col("o").alias("class"))
        below = self.data.where((F.col("p") == RDFS + "subClassOf") & (F.col("o.kind") != "literal")).select(F.col("s").alias("x"), F.col("o").alias("y"))
        if self._below is None:
            self._below = below if below.isEmpty() else transitive(below)
        up = self._below.select(F.col("x").alias("class"), F.col("y").alias("up"))
        return types.unionByName(types.join(up, "class").select("node", F.col("up").alias("class"))).distinct()

    def focus(self, shape: Shape) -> DataFrame:
        """(root, focus)."""
        parts = []
        of = lambda df, column: df.select(F.col(column).alias("focus"))
        if shape.all("targetClass"):
            typed = self.with_classes(self.within)
            parts += [of(typed.where(is_term(F.col("class"), n)), "node") for n in shape.all("targetClass")]
        for n in shape.all("targetNode"):
            # In each scope that has any triples of the node; where all data are one, whether it has or not.
            scopes = self.within.where(is_term(F.col("s"), n) | is_term(F.col("o"), n)).select(F.col("s.scope").alias("scope")).distinct()
            if self.scoped:
                parts.append(scopes.select(struct(F.lit(n.lex), F.lit(n.kind), F.lit(n.dt), F.lit(n.lang), F.col("scope")).alias("focus")))
            else:
                parts.append(self.data.sparkSession.range(1).select(struct(F.lit(n.lex), F.lit(n.kind), F.lit(n.dt), F.lit(n.lang), F.lit("")).alias("focus")))
        parts += [of(self.within.where(F.col("p") == n.lex), "s") for n in shape.all("targetSubjectsOf")]
        parts += [of(self.within.where(F.col("p") == n.lex), "o") for n in shape.all("targetObjectsOf")]
        return reduce(DataFrame.unionByName, parts).distinct().select(F.col("focus").alias("root"), "focus")

    scoped = False

    def values(self, focus: DataFrame, shape: Shape) -> DataFrame:
        """(root, focus, v): the focus itself, or what the shape's path leads to."""
        path = shape.one("path")
        itself = focus.select("root", "focus", F.col("focus").alias("v"))
        if path is None:
            return itself
        # The path is walked once for each focus node, however many roots lead to it.
        ends = self.reached(itself.select("focus", "v").distinct(), path.lex)
        return focus.join(ends, "focus").select("root", "focus", "v")

    def reached(self, ends: DataFrame, path: str) -> DataFrame:
        """(focus, v): where a path leads to from (focus, v), each end once."""
        node, cell = self.shapes.nodes.get(path), path in self.shapes.lists
        if cell:
            return reduce(lambda found, step: self.reached(found, step.lex), self.shapes.listed(path), ends)
        kinds = {k: n for k in ("inversePath", "alternativePath", "zeroOrMorePath", "oneOrMorePath", "zeroOrOnePath") if node and (n := node.one(k)) is not None}
        if not kinds:
            return self.stepped(ends, self.data.where(F.col("p") == path).select(F.col("s").alias("v"), F.col("o").alias("w")))
        (kind, inner), *more = kinds.items()
        if more:
            raise ValueError(f"a path of several kinds: {path}")
        if kind == "inversePath":
            if inner.lex in self.shapes.lists or inner.lex in self.shapes.nodes:
                raise ValueError("only predicates can be inverted")
            return self.stepped(ends, self.data.where(F.col("p") == inner.lex).select(F.col("o").alias("v"), F.col("s").alias("w")))
        if kind == "alternativePath":
            return reduce(DataFrame.unionByName, [self.reached(ends, n.lex) for n in self.shapes.listed(inner.lex)]).distinct()
        if kind == "zeroOrOnePath":
            return ends.unionByName(self.reached(ends, inner.lex)).distinct()
        # From each node that the first step leads to, all that further steps lead to; what a round finds is written once.
        found = new = stored(self.reached(ends, inner.lex), "reached")
        while not new.isEmpty():
            new = stored(self.reached(new, inner.lex).join(found, found.columns, "left_anti"), "reached")
            found = found.unionByName(new)
        return (ends.unionByName(found) if kind == "zeroOrMorePath" else found).distinct()

    @staticmethod
    def stepped(ends: DataFrame, step: DataFrame) -> DataFrame:
        return ends.join(step, "v").select("focus", F.col("w").alias("v")).distinct()

    def report(self) -> DataFrame:
        """A row per violation; none if the data conform."""
        parts = [p for shape in self.shapes.targeted() for p in self.violations(shape, self.focus(shape))]
        if not parts:
            return self.data.sparkSession.createDataFrame([], ("g string, " if self.scoped else "") + REPORT)
        found = reduce(DataFrame.unionByName, parts).drop("root").distinct()
        return found.select(*([F.col("focus.scope").alias("g")] if self.scoped else []), F.col("focus.lex").alias("focus"), "path", F.col("value.lex").alias("value"), "component", "severity", "message", "shape")

    def row(self, df: DataFrame, shape: Shape, component: str, value: str | None = None) -> DataFrame:
        severity, message, path = shape.one("severity"), shape.one("message"), shape.one("path")
        none = F.lit(None).cast(df.schema["focus"].dataType)
        return df.select(
            "root",
            "focus",
            F.lit(path.lex if path else None).cast("string").alias("path"),
            (none if value is None else F.col(value)).alias("value"),
            F.lit(component).alias("component"),
            F.lit(severity.lex.rpartition("#")[2] if severity else "Violation").alias("severity"),
            F.lit(message.lex if message else "").alias("message"),
            F.lit(shape.name).alias("shape"),
        )

    def violations(self, shape: Shape, focus: DataFrame, asked: tuple[str, ...] = ()) -> list[DataFrame]:
        """Rows (root, focus, ...) of what a shape finds at focus nodes; ``asked`` are the shapes that led here."""
        deactivated = shape.one("deactivated")
        if deactivated and deactivated.lex == "true":
            return []
        if shape.name in asked:
            raise ValueError(f"a shape that asks for itself: {shape.name}")
        asked = (*asked, shape.name)
        out = []
        values = self.values(focus, shape)
        v, lex = F.col("v"), F.col("v.lex")
        at = ["root", "focus"]

        def bad(component: str, ok: Column) -> None:
            out.append(self.row(values.where(~F.coalesce(ok, F.lit(False))), shape, component, "v"))

        def limits(counts: DataFrame, keys: tuple[str, str]) -> None:
            """Focus nodes with too few or too many rows in ``counts``."""
            n = F.coalesce("n", F.lit(0))
            counted = focus.join(counts.groupBy(*at).agg(F.count(F.lit(1)).alias("n")), at, "left")
            for key, wrong in zip(keys, (lambda c: n < c, lambda c: n > c), strict=True):
                if (limit := shape.one(key)) is not None:
                    out.append(self.row(counted.where(wrong(int(limit.lex))), shape, key))

        if shape.one("minCount") or shape.one("maxCount"):
            limits(values, ("minCount", "maxCount"))
        if (n := shape.one("datatype")) is not None:
            bad("datatype", (F.col("v.kind") == "literal") & (F.col("v.dt") == n.lex) & well_formed(lex, n.lex))
        for n in shape.all("class"):
            members = self.with_classes(self.data).where(is_term(F.col("class"), n)).select(F.col("node").alias("v"))
            out.append(self.row(values.join(members, "v", "left_anti"), shape, "class", "v"))
        if (n := shape.one("nodeKind")) is not None:
            bad("nodeKind", F.col("v.kind").isin(NODE_KINDS[n.lex]))
        for key, ok in (("minInclusive", lambda a, b: a >= b), ("maxInclusive", lambda a, b: a <= b), ("minExclusive", lambda a, b: a > b), ("maxExclusive", lambda a, b: a < b)):
            if (n := shape.one(key)) is not None:
                limit = struct(F.lit(n.lex), F.lit("literal"), F.lit(n.dt), F.lit(n.lang), F.lit(""))
                bad(key, (F.col("v.kind") == "literal") & ok(comparable(v, n.dt), comparable(limit, n.dt)))
        if (n := shape.one("minLength")) is not None:
            bad("minLength", (F.col("v.kind") != "bnode") & (F.length(lex) >= int(n.lex)))
        if (n := shape.one("maxLength")) is not None:
            bad("maxLength", (F.col("v.kind") != "bnode") & (F.length(lex) <= int(n.lex)))
        if (n := shape.one("pattern")) is not None:
            flags = shape.one("flags")
            bad("pattern", (F.col("v.kind") != "bnode") & lex.rlike((f"(?{flags.lex})" if flags else "") + n.lex))
        if (n := shape.one("in")) is not None:
            bad("in", F.struct("v.lex", "v.kind", "v.dt", "v.lang").isin([F.struct(*(F.lit(x).alias(a) for a, x in zip(("lex", "kind", "dt", "lang"), (m.lex, m.kind, m.dt, m.lang), strict=True))) for m in self.shapes.listed(n.lex)]))
        if (n := shape.one("languageIn")) is not None:
            own = F.lower("v.lang")
            bad("languageIn", reduce(Column.__or__, [(own == x.lex.lower()) | own.startswith(x.lex.lower() + "-") for x in self.shapes.listed(n.lex)], F.lit(False)))
        if (n := shape.one("uniqueLang")) is not None and n.lex == "true":
            twice = values.where(F.col("v.lang") != "").groupBy(*at, F.lower("v.lang").alias("lang")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
            out.append(self.row(twice, shape, "uniqueLang"))
        for n in shape.all("hasValue"):
            out.append(self.row(focus.join(values.where(is_term(v, n)).select(*at), at, "left_anti"), shape, "hasValue"))
        for key in ("equals", "disjoint", "lessThan", "lessThanOrEquals"):
            for n in shape.all(key):
                other = self.data.where(F.col("p") == n.lex).select(F.col("s").alias("focus"), F.col("o").alias("w")).distinct()
                as_v = other.withColumnRenamed("w", "v")
                if key == "disjoint":
                    out.append(self.row(values.join(as_v, ["focus", "v"], "left_semi"), shape, key, "v"))
                elif key == "equals":
                    out.append(self.row(values.join(as_v, ["focus", "v"], "left_anti"), shape, key, "v"))
                    missing = focus.join(as_v, "focus").join(values, ["root", "focus", "v"], "left_anti")
                    out.append(self.row(missing, shape, key, "v"))
                else:
                    less = (lambda a, b: a < b) if key == "lessThan" else (lambda a, b: a <= b)
                    w = F.col("w")
                    ok = F.coalesce(*(less(comparable(v, dt), comparable(w, dt)) for dt in (XSD + "double", XSD + "date", XSD + "dateTime")), less(lex, F.col("w.lex")) & (F.col("v.dt") == F.col("w.dt")) & (F.col("v.dt") == XSD + "string"), F.lit(False))
                    out.append(self.row(values.join(other, "focus").where(~ok).select(*at, "v").distinct(), shape, key, "v"))
        inner = values.select("root", F.col("v").alias("focus")).distinct()
        for n in shape.all("property"):
            out += self.violations(self.shapes.nodes[n.lex], inner, asked)
        nodes = values.select("v").distinct()
        for n in shape.all("node"):
            out.append(self.row(values.join(self.failing(n.lex, nodes, asked), "v", "left_semi"), shape, "node", "v"))
        for n in shape.all("not"):
            out.append(self.row(values.join(self.failing(n.lex, nodes, asked), "v", "left_anti"), shape, "not", "v"))
        for key in ("and", "or", "xone"):
            for n in shape.all(key):
                parts = [self.failing(m.lex, nodes, asked) for m in self.shapes.listed(n.lex)]
                failed = reduce(DataFrame.unionByName, parts).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
                counted = values.join(failed, "v", "left").withColumn("passed", F.lit(len(parts)) - F.coalesce("n", F.lit(0)))
                wrong = {"and": F.col("passed") < len(parts), "or": F.col("passed") < 1, "xone": F.col("passed") != 1}[key]
                out.append(self.row(counted.where(wrong), shape, key, "v"))
        if (n := shape.one("qualifiedValueShape")) is not None:
            limits(values.join(self.failing(n.lex, nodes, asked), "v", "left_anti"), ("qualifiedMinCount", "qualifiedMaxCount"))
        if (n := shape.one("closed")) is not None and n.lex == "true":
            allowed = [p.lex for x in shape.all("property") if (p := self.shapes.nodes[x.lex].one("path"))]
            ignored = shape.one("ignoredProperties")
            allowed += [x.lex for x in self.shapes.listed(ignored.lex)] if ignored else []
            extra = self.data.where(~F.col("p").isin(allowed)).select(F.col("s").alias("v"), F.col("o").alias("w"))
            out.append(self.row(values.join(extra, "v").select(*at, "w"), shape, "closed", "w"))
        return out

    def failing(self, name: str, nodes: DataFrame, asked: tuple[str, ...]) -> DataFrame:
        """The nodes (v) that violate a shape, by themselves or by any nested value."""
        parts = self.violations(self.shapes.nodes.get(name, Shape(name)), nodes.select(F.col("v").alias("root"), F.col("v").alias("focus")), asked)
        if not parts:
            return nodes.limit(0)
        return reduce(DataFrame.unionByName, [p.select("root") for p in parts]).select(F.col("root").alias("v")).distinct()


def validate(data: DataFrame, shapes: DataFrame | None = None, within: DataFrame | None = None) -> DataFrame:
    """(focus, path, value, component, severity, message, shape) for each violation, shapes in the data or apart.

    ``within`` are triples whose nodes alone are looked at, such as one document's; their values are found in all data.
    """
    data = data.drop("g")
    return Validator(terms(data), Shapes(data if shapes is None else shapes), None if within is None else terms(within.drop("g"))).report()


def validate_documents(quads: DataFrame, shapes: DataFrame) -> DataFrame:
    """(g, focus, ...): the violations of every graph, each taken as all data by itself; a shape's target nodes count where a graph speaks of them."""
    validator = Validator(terms(quads), Shapes(shapes))
    validator.scoped = True
    return validator.report()
