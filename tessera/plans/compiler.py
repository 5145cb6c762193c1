"""Algebra to DataFrames. Catalyst chooses how to run them."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.builtins import Expressions, number, order_keys, text
from ..operators.closure import transitive
from ..operators.lineage import stored
from .algebra import TYPE, XSD, Aggregate, Call, Iri, Literal, Node, Path, Query, QueryError, Term, Triple, Var
from .bindings import DOUBLE, INTEGER, IRI, STR, Kind, Rel, Value, as_kind, common, constant, half_join, join, lex, name, term, union
from .parser import parse

Graph = Term | None


@dataclass
class Result:
    """What a query gives: rows for SELECT and ASK, triples (s, s_kind, p, o, o_kind, o_dt, o_lang) for the other forms."""

    form: str
    df: DataFrame
    variables: list[str]
    rel: Rel | None = None

    def terms(self) -> DataFrame:
        """Every variable as a struct of kind, lexical form, datatype and language."""
        assert self.rel is not None
        return self.rel.df.select(*(term(self.rel.value(v)).alias(v) for v in self.variables))


class Compiler:
    def __init__(self, spark: SparkSession, source, namespaces: dict[str, str] | None = None, base: str = "") -> None:
        self.spark, self.source, self.namespaces, self.base = spark, source, namespaces or {}, base
        self.fresh = 0

    def query(self, question: str) -> Result:
        return self.run(parse(question, self.namespaces, self.base))

    def run(self, q: Query) -> Result:
        inner = self
        if q.default_graphs or q.named_graphs:
            inner = Compiler(self.spark, self.source.restricted(q.default_graphs, q.named_graphs), self.namespaces, self.base)
        return inner._run(q)

    def _run(self, q: Query) -> Result:
        if q.form == "select":
            rel, variables = self.select(q)
            return Result("select", native(rel, variables), variables, rel)
        where = self.pattern(q.where, None)
        if q.values is not None:
            where = join(where, self.pattern(q.values, None))
        if q.form == "ask":
            found = where.df.limit(1).agg((F.count(F.lit(1)) > 0).alias("ask"))
            return Result("ask", found, ["ask"])
        if q.form == "construct":
            where = self.slice(self.ordered(where, q), q)
            return Result("construct", self.construct(where, q.template), [])
        return Result("describe", self.describe(where, q.targets), [])

    # Solution modifiers.

    def select(self, q: Query) -> tuple[Rel, list[str]]:
        rel = self.pattern(q.where, None)
        if q.values is not None:
            rel = join(rel, self.pattern(q.values, None))
        project = q.project
        aggregates: dict[Aggregate, str] = {}
        if q.group is not None or any(holds_aggregate(e) for _, e in project or []) or q.having:
            project = [(v, lifted(e, aggregates)) for v, e in project or []]
            having = [lifted(e, aggregates) for e in q.having]
            order = [(lifted(e, aggregates), down) for e, down in q.order]
            rel = self.grouped(rel, q.group or [], aggregates)
            for condition in having:
                rel = Rel(rel.df.where(self.expressions(rel).truth(condition)), rel.kinds)
            q = replace(q, order=order)
        if project is None:
            variables = [v for v in rel.kinds if not v.startswith(("_b", "_n"))]
        else:
            variables = [v for v, _ in project]
            for v, e in project:
                if e is not None:
                    rel = self.extend(rel, v, e)
        missing = [v for v in variables if v not in rel.kinds]
        if missing:
            rel = Rel(rel.df.select("*", *(F.lit(None).cast("string").alias(name(v)) for v in missing)), rel.kinds | dict.fromkeys(missing, Kind("str", XSD + "string", maybe=True)))
        if q.distinct:
            # Sorting may only use what is kept, so duplicates can go first.
            kept = rel.pick(variables)
            rel = Rel(kept.df.distinct(), kept.kinds)
        return self.slice(self.ordered(rel, q), q).pick(variables), variables

    def ordered(self, rel: Rel, q: Query) -> Rel:
        if not q.order:
            return rel
        e = self.expressions(rel)
        return Rel(rel.df.orderBy(*(key for x, down in q.order for key in order_keys(e.of(x), down))), rel.kinds)

    @staticmethod
    def slice(rel: Rel, q: Query) -> Rel:
        df = rel.df
        if q.offset:
            df = df.offset(q.offset)
        if q.limit is not None:
            df = df.limit(q.limit)
        return Rel(df, rel.kinds)

    def grouped(self, rel: Rel, keys: list, aggregates: dict[Aggregate, str]) -> Rel:
        for v, e in keys:
            if e is not None:
                rel = self.extend(rel, v, e)
        e = self.expressions(rel)
        columns, kinds = [], {v: rel.kinds[v] for v, _ in keys}
        for a, v in aggregates.items():
            made = self.aggregate(e, a, rel)
            columns.append(made.col.alias(name(v)))
            kinds[v] = made.kind
        grouped = rel.df.groupBy(*(name(v) for v, _ in keys))
        df = grouped.agg(*columns) if columns else rel.df.select(*(name(v) for v, _ in keys)).distinct()
        return Rel(df, kinds)

    def aggregate(self, e: Expressions, a: Aggregate, rel: Rel) -> Value:
        if a.name == "COUNT":
            if a.arg is None:
                made = F.count_distinct(F.struct(*(name(v) for v in rel.kinds))) if a.distinct else F.count(F.lit(1))
            else:
                v = e.of(a.arg)
                made = F.count_distinct(v.col) if a.distinct else F.count(v.col)
            return Value(made, INTEGER)
        v = e.of(a.arg)
        if a.name == "SUM":
            x = number(v)
            whole = v.kind.name == "num" and v.kind.dt == XSD + "integer"
            made = F.sum_distinct(x) if a.distinct else F.sum(x)
            return Value(F.coalesce(made, F.lit(0).cast("long") if whole else F.lit(0.0)), INTEGER if whole else DOUBLE)
        if a.name == "AVG":
            x = number(v).cast("double")
            total, n = (F.sum_distinct(x), F.count_distinct(x)) if a.distinct else (F.sum(x), F.count(x))
            return Value(F.coalesce(F.try_divide(total, n), F.lit(0.0)), DOUBLE)
        if a.name == "GROUP_CONCAT":
            found = F.collect_set(lex(v)) if a.distinct else F.collect_list(lex(v))
            return Value(F.array_join(F.sort_array(found), a.separator), STR)
        if v.kind.name == "term":
            rank = F.when(v.col["k"] == "bnode", 1).when(v.col["k"] == "iri", 2).otherwise(3)
            key = F.struct(rank.alias("r"), F.coalesce(number(v).cast("double"), F.lit(float("inf"))).alias("n"), v.col["lex"].alias("l"))
            return Value(F.max_by(v.col, key) if a.name == "MAX" else F.min_by(v.col, F.when(v.col.isNotNull(), key)), v.kind)
        return Value(F.max(v.col) if a.name == "MAX" else F.min(v.col), replace(v.kind, maybe=True))

    # Patterns.

    def expressions(self, rel: Rel, exists: dict | None = None) -> Expressions:
        return Expressions(lambda v: rel.value(v) if v in rel.kinds else None, None, self.base)

    def pattern(self, n: Node, graph: Graph) -> Rel:
        return getattr(self, "p_" + n.op)(n.parts, graph)

    def unit(self) -> Rel:
        return Rel(self.spark.range(1).select(F.lit(1).alias("one")), {})

    def p_join(self, parts: list, graph: Graph) -> Rel:
        return join(self.pattern(parts[0], graph), self.pattern(parts[1], graph))

    def p_union(self, parts: list, graph: Graph) -> Rel:
        return union(self.pattern(parts[0], graph), self.pattern(parts[1], graph))

    def p_minus(self, parts: list, graph: Graph) -> Rel:
        a, b = self.pattern(parts[0], graph), self.pattern(parts[1], graph)
        if not any(v in b.kinds for v in a.kinds):
            return a
        return half_join(a, b, "left_anti", need_shared=True)

    def p_graph(self, parts: list, graph: Graph) -> Rel:
        return self.pattern(parts[1], parts[0])

    def p_leftjoin(self, parts: list, graph: Graph) -> Rel:
        left, right, condition = parts
        a, b = self.pattern(left, graph), self.pattern(right, graph)
        if condition is None:
            return join(a, b, "left")
        both = self.expressions_over(a, b)
        return join(a, b, "left", both.truth(condition))

    def expressions_over(self, a: Rel, b: Rel) -> Expressions:
        """Expressions in the condition of a join: a's columns, else b's."""

        def value(v: str) -> Value | None:
            if v in a.kinds:
                # In the condition a shared variable has the joint kind of both sides.
                kind = common(a.kinds[v], b.kinds[v]) if v in b.kinds else a.kinds[v]
                return Value(F.col(name(v)), kind)
            return Value(F.col(name(v)), b.kinds[v]) if v in b.kinds else None

        return Expressions(value, None, self.base)

    def p_filter(self, parts: list, graph: Graph) -> Rel:
        rel = self.pattern(parts[0], graph)
        for one in conjuncts(parts[1]):
            if isinstance(one, Call) and one.name in ("EXISTS", "NOT EXISTS"):
                rel = self.exists(rel, one.args[0], graph, "left_semi" if one.name == "EXISTS" else "left_anti")
                continue
            marks: list[str] = []

            def marked(node: Node) -> Column:
                nonlocal rel
                self.fresh += 1
                flag = f"x_{self.fresh}"
                inner = self.pattern(node, graph)
                shared = [v for v in rel.kinds if v in inner.kinds]
                inner = inner.pick(shared) if shared else Rel(inner.df.limit(1).select(F.lit(1).alias("one")), {})
                known = Rel(inner.df.distinct().withColumn(name(flag), F.lit(True)), inner.kinds | {flag: Kind("bool", XSD + "boolean")})
                rel = join(rel, known, "left")
                marks.append(flag)
                return F.coalesce(F.col(name(flag)), F.lit(False))

            e = Expressions(lambda v: rel.value(v) if v in rel.kinds else None, marked, self.base)
            condition = e.truth(one)
            rel = Rel(rel.df.where(condition), rel.kinds)
            if marks:
                rel = rel.pick([v for v in rel.kinds if v not in marks])
        return rel

    def exists(self, rel: Rel, node: Node, graph: Graph, how: str) -> Rel:
        """A filter inside the pattern may use variables of the outer one, so it joins the condition."""
        condition = None
        if node.op == "filter":
            node, condition = node.parts
        inner = self.pattern(node, graph)
        extra = None if condition is None else self.expressions_over(rel, inner).truth(condition)
        if not any(v in inner.kinds for v in rel.kinds) and extra is None:
            inner = Rel(inner.df.limit(1), inner.kinds)
        return half_join(rel, inner, how, extra)

    def p_extend(self, parts: list, graph: Graph) -> Rel:
        inner, v, e = parts
        return self.extend(self.pattern(inner, graph), v, e)

    def extend(self, rel: Rel, v: str, e) -> Rel:
        made = self.expressions(rel).of(e)
        kinds = dict(rel.kinds) | {v: replace(made.kind, maybe=True)}
        return Rel(rel.df.withColumn(name(v), made.col), kinds)

    def p_values(self, parts: list, graph: Graph) -> Rel:
        names, rows = parts
        kinds: dict[str, Kind] = {}
        for i, v in enumerate(names):
            found = [constant(r[i]).kind for r in rows if r[i] is not None]
            kind = reduce(common, found) if found else STR
            kinds[v] = replace(kind, maybe=any(r[i] is None for r in rows))
        parts_of = []
        for r in rows:
            columns = []
            for i, v in enumerate(names):
                plain = replace(kinds[v], maybe=False)
                columns.append((as_kind(constant(r[i]), plain) if r[i] is not None else F.lit(None)).alias(name(v)))
            parts_of.append(F.struct(*columns))
        if not rows:
            return Rel(self.spark.range(0).select(*(F.lit(None).cast("string").alias(name(v)) for v in names)), kinds)
        table = self.spark.range(1).select(F.explode(F.array(*parts_of)).alias("r")).select("r.*")
        return Rel(table, kinds)

    def p_subselect(self, parts: list, graph: Graph) -> Rel:
        return self.select(parts[0])[0]

    # Basic graph patterns.

    def p_bgp(self, triples: list[Triple], graph: Graph, given: dict[str, Kind] | None = None) -> Rel:
        """``given`` are the kinds that variables are known to have, which leave tables out."""
        if not triples:
            return self.unit()
        plain = []
        units: list = []
        for t in self.flattened(triples):
            if isinstance(t.p, Path):
                units.append(("path", t.s, t))
            elif isinstance(t.p, Var):
                units.append(("star", t.s, [(t.p, t.o)]))
            else:
                plain.append(t)
        stars: dict[Term, list] = {}
        for t in plain:
            stars.setdefault(t.s, []).append((t.p, t.o))
        units += [("star", s, pairs) for s, pairs in stars.items()]

        def variables(u) -> set[str]:
            terms = (u[2].s, u[2].o) if u[0] == "path" else (u[1], *(x for pair in u[2] for x in pair))
            return {x.name for x in terms if isinstance(x, Var)}

        def hint(u) -> int:
            return 40 if u[0] == "path" else self.source.size_hint(u[1], u[2])

        units.sort(key=hint)
        rel = None
        seen: set[str] = set()
        nodes: set[str] = set()
        while units:
            # The next unit shares a variable with those before it, if any does.
            at = next((i for i, u in enumerate(units) if not seen or variables(u) & seen), 0)
            u = units.pop(at)
            known = (given or {}) | (rel.kinds if rel is not None else {})
            if u[0] == "path":
                one = self.sideways(u[2], rel, nodes, graph) or self.path(u[2].p, u[2].s, u[2].o, graph)
            else:
                one = self.source.star(u[1], u[2], graph, known or None)
            rel = one if rel is None else join(rel, one)
            seen |= variables(u)
            nodes |= {x.name for x in ((u[2].s, u[2].o) if u[0] == "path" else (u[1], *(o for _, o in u[2]))) if isinstance(x, Var)}
        return rel

    def flattened(self, triples: list[Triple]) -> list[Triple]:
        """Sequences and inverses as plain patterns."""
        out = []
        for t in triples:
            if isinstance(t.p, Path) and t.p.op == "/":
                at = t.s
                for i, part in enumerate(t.p.parts):
                    self.fresh += 1
                    end = t.o if i + 1 == len(t.p.parts) else Var(f"_b_p{self.fresh}")
                    out += self.flattened([Triple(at, part, end)])
                    at = end
            elif isinstance(t.p, Path) and t.p.op == "^":
                out += self.flattened([Triple(t.o, t.p.parts[0], t.s)])
            else:
                out.append(t)
        return out

    def path(self, p: Path, s: Term, o: Term, graph: Graph) -> Rel:
        if p.op == "|":
            return reduce(union, (self.p_bgp([Triple(s, part, o)], graph) for part in p.parts))
        self.fresh += 1
        x, y = Var(f"_b_x{self.fresh}"), Var(f"_b_y{self.fresh}")
        if p.op == "!":
            return self.negated(p, s, o, graph)
        edges = self.p_bgp([Triple(x, p.parts[0], y)], graph).pick([x.name, y.name])
        pairs = edges.df.select(term(edges.value(x.name)).alias("x"), term(edges.value(y.name)).alias("y"))
        backwards = not isinstance(o, Var) and isinstance(s, Var)
        if backwards:
            pairs = pairs.select(F.col("y").alias("x"), F.col("x").alias("y"))
        fixed = o if backwards else s if not isinstance(s, Var) else None
        start = None
        if fixed is not None:
            start = self.spark.range(1).select(term(constant(fixed)).alias("x"))
        found = pairs.distinct() if p.op == "?" else transitive(pairs, start=start)
        if p.op in "*?":
            if fixed is not None:
                own = start.select("x", F.col("x").alias("y"))
            elif not isinstance(o, Var):
                own = self.spark.range(1).select(term(constant(o)).alias("x")).select("x", F.col("x").alias("y"))
            else:
                own = self.nodes(graph).select("x", F.col("x").alias("y"))
            found = found.unionByName(own).distinct()
        if fixed is not None:
            found = found.where(F.col("x") == term(constant(fixed)))
        if backwards:
            found = found.select(F.col("y").alias("x"), F.col("x").alias("y"))
        return self.bound(found, s, o)

    def sideways(self, t: Triple, rel: Rel | None, nodes: set[str], graph: Graph) -> Rel | None:
        """A repeated path from the solutions so far, where these bind one end to nodes of the graph; else None.

        Only what those nodes lead to is closed, and only tables that can hold them are read: each round joins the nodes found last, kind by kind on
        their stored keys, with the edges that such nodes can have.
        """
        if rel is None or t.p.op not in ("+", "*") or not isinstance(t.s, Var) or not isinstance(t.o, Var) or t.s == t.o:
            return None
        end = next((v for v in (t.s, t.o) if v.name in rel.kinds and v.name in nodes and not rel.kinds[v.name].maybe and rel.kinds[v.name].name in ("iri", "term")), None)
        if end is None:
            return None
        far = t.o if end == t.s else t.s
        inner = t.p.parts[0]
        steps = list(inner.parts) if isinstance(inner, Path) and inner.op == "|" else [inner]
        self.fresh += 1
        origin, at, to = (f"_b_{x}{self.fresh}" for x in ("origin", "at", "to"))
        kind = rel.kinds[end.name]
        begun = Rel(rel.df.select(F.col(name(end.name)).alias(name(origin)), F.col(name(end.name)).alias(name(at))).distinct(), {origin: kind, at: kind})
        found: dict[Kind, DataFrame] = {}
        frontier = [begun]
        while frontier:
            fresh: dict[Kind, list[DataFrame]] = {}
            for part in frontier:
                for step in steps:
                    triple = Triple(Var(at), step, Var(to)) if end == t.s else Triple(Var(to), step, Var(at))
                    edges = self.p_bgp([triple], graph, {at: part.kinds[at]})
                    if at in edges.kinds and to in edges.kinds and not edges.none:
                        led = join(part, edges.pick([at, to]))
                        fresh.setdefault(led.kinds[to], []).append(led.df.select(F.col(name(origin)), F.col(name(to)).alias(name(at))))
            frontier = []
            for k, parts in fresh.items():
                new = reduce(DataFrame.unionByName, parts).distinct()
                new = stored(new.join(found[k], new.columns, "left_anti") if k in found else new, "path")
                if not new.isEmpty():
                    found[k] = found[k].unionByName(new) if k in found else new
                    frontier.append(Rel(new, {origin: kind, at: k}))
        rels = [Rel(df, {origin: kind, at: k}) for k, df in found.items()] + ([begun] if t.p.op == "*" else [])
        if not rels:
            rels = [Rel(begun.df.limit(0), begun.kinds)]
        out = reduce(union, rels)
        # A node that leads back to itself is found by a step and by none.
        named = out.df.select(F.col(name(origin)).alias(name(end.name)), F.col(name(at)).alias(name(far.name)))
        return Rel(named.distinct() if t.p.op == "*" else named, {end.name: out.kinds[origin], far.name: out.kinds[at]})

    @staticmethod
    def bound(found: DataFrame, s: Term, o: Term) -> Rel:
        """Pairs (x, y) of terms as solutions for the ends of a path."""
        kinds: dict[str, Kind] = {}
        columns = []
        for t, column in ((s, "x"), (o, "y")):
            if not isinstance(t, Var):
                found = found.where(F.col(column) == term(constant(t)))
            elif t.name in kinds:
                found = found.where(F.col("x") == F.col("y"))
            else:
                kinds[t.name] = Kind("term")
                columns.append(F.col(column).alias(name(t.name)))
        return Rel(found.select(*columns) if columns else found.limit(1).select(F.lit(1).alias("one")), kinds)

    def negated(self, p: Path, s: Term, o: Term, graph: Graph) -> Rel:
        out = []
        for inverse in (False, True):
            unwanted = [iri for iri, turned in p.parts if turned == inverse]
            if not unwanted and inverse or unwanted == [] and any(turned for _, turned in p.parts) and not inverse:
                continue
            self.fresh += 1
            v = Var(f"_b_q{self.fresh}")
            a, b = (o, s) if inverse else (s, o)
            rel = self.source.star(a, [(v, b)], graph)
            rel = Rel(rel.df.where(~lex(rel.value(v.name)).isin(unwanted)), rel.kinds)
            out.append(rel.pick([x for x in rel.kinds if x != v.name]))
        return reduce(union, out)

    def nodes(self, graph: Graph) -> DataFrame:
        """Every subject and object."""
        self.fresh += 1
        s, p, o = (Var(f"_b_{x}{self.fresh}") for x in "spo")
        rel = self.source.star(s, [(p, o)], graph)
        return rel.df.select(term(rel.value(s.name)).alias("x")).unionByName(rel.df.select(term(rel.value(o.name)).alias("x"))).distinct()

    # Graph results.

    def construct(self, rel: Rel, template: list[Triple]) -> DataFrame:
        own = sorted(rel.kinds)
        row = F.xxhash64(*(lex(rel.value(v)) for v in own)) if own else F.lit(0)

        def made(t: Term) -> Column:
            if isinstance(t, Var) and t.name not in rel.kinds:
                if not t.name.startswith(("_b", "_n")):
                    return F.lit(None).cast("struct<k:string,lex:string,dt:string,lang:string>")
                label = F.concat(F.lit("b"), F.hex(row), F.lit(t.name))
                return F.struct(F.lit("bnode").alias("k"), label.alias("lex"), F.lit("").alias("dt"), F.lit("").alias("lang"))
            return term(rel.value(t.name)) if isinstance(t, Var) else term(constant(t)) if not isinstance(t, Literal) else literal(t)

        rows = F.array(*(F.struct(made(t.s).alias("s"), made(t.p).alias("p"), made(t.o).alias("o")) for t in template))
        out = rel.df.select(F.explode(rows).alias("t")).select("t.s", "t.p", "t.o").where(F.col("s").isNotNull() & F.col("p").isNotNull() & F.col("o").isNotNull() & (F.col("s.k") != "literal") & (F.col("p.k") == "iri"))
        return triples(out).distinct()

    def describe(self, where: Rel, targets: list[Term]) -> DataFrame:
        """All triples of the targets, and of blank nodes that these lead to."""
        wanted = [t for t in targets if not isinstance(t, Var)]
        parts = [where.df.select(term(where.value(t.name)).alias("x")) for t in targets if isinstance(t, Var) and t.name in where.kinds]
        if not targets:
            parts = [where.df.select(term(where.value(v)).alias("x")) for v in where.kinds if not v.startswith("_")]
        found = [self.source.star(t, [(Var("p"), Var("o"))], None) for t in wanted]
        out = [rel.df.select(term(constant(t)).alias("s"), term(rel.value("p")).alias("p"), term(rel.value("o")).alias("o")) for t, rel in zip(wanted, found, strict=True)]
        everything = self.source.star(Var("s"), [(Var("p"), Var("o"))], None)
        table = everything.df.select(*(term(everything.value(v)).alias(v) for v in "spo"))
        if parts:
            focus = reduce(DataFrame.unionByName, parts).distinct()
            out.append(table.join(focus, table["s"] == focus["x"], "left_semi"))
        all_of = reduce(DataFrame.unionByName, out)
        if any(everything.kinds[v].name == "term" for v in "so"):
            blank = table.where(F.col("o.k") == "bnode").select(F.col("s").alias("x"), F.col("o").alias("y"))
            reached = transitive(blank, start=all_of.select(F.col("s").alias("x")).distinct())
            nodes = reached.select(F.col("y").alias("n")).distinct()
            all_of = all_of.unionByName(table.join(nodes, table["s"] == nodes["n"], "left_semi"))
        return triples(all_of).distinct()


def literal(t: Literal) -> Column:
    return F.struct(F.lit("literal").alias("k"), F.lit(t.value).alias("lex"), F.lit(t.datatype).alias("dt"), F.lit(t.lang).alias("lang"))


def triples(df: DataFrame) -> DataFrame:
    return df.select(F.col("s.lex").alias("s"), F.col("s.k").alias("s_kind"), F.col("p.lex").alias("p"), F.col("o.lex").alias("o"), F.col("o.k").alias("o_kind"), F.col("o.dt").alias("o_dt"), F.col("o.lang").alias("o_lang"))


def native(rel: Rel, variables: list[str]) -> DataFrame:
    """Numbers, booleans and times as such, everything else by its form."""
    return rel.df.select(*((rel.value(v).col if rel.kinds[v].name in ("num", "bool", "ts", "date", "str") else lex(rel.value(v))).alias(v) for v in variables))


def conjuncts(e) -> list:
    return [x for a in e.args for x in conjuncts(a)] if isinstance(e, Call) and e.name == "&&" else [e]


def holds_aggregate(e) -> bool:
    return isinstance(e, Aggregate) or isinstance(e, Call) and any(holds_aggregate(a) for a in e.args)


def lifted(e, found: dict[Aggregate, str]):
    """The expression with each aggregate replaced by a variable."""
    if isinstance(e, Aggregate):
        return Var(found.setdefault(e, f"_agg{len(found)}"))
    if isinstance(e, Call):
        return Call(e.name, tuple(lifted(a, found) for a in e.args))
    return e


__all__ = ["Compiler", "Result", "TYPE", "IRI", "text", "Iri", "QueryError"]
