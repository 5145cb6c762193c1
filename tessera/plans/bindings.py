"""Solution tables: a DataFrame with one column per variable, and what is known of each variable beforehand."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .algebra import RDF, XSD, Iri, Literal, Term

TERM = "struct<k:string,lex:string,dt:string,lang:string>"
NUMERIC = [XSD + t for t in ("integer", "decimal", "double", "float", "int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger")]
STRING = XSD + "string"


@dataclass(frozen=True)
class Kind:
    """What a column holds. name: iri, num, str, bool, ts, date or term; an iri may be a key below a template."""

    name: str
    dt: str = ""
    template: str = ""
    maybe: bool = False


@dataclass(frozen=True)
class Value:
    """An expression's column and its kind."""

    col: Column
    kind: Kind


IRI, STR, BOOL, TERM_KIND = Kind("iri"), Kind("str", STRING), Kind("bool", XSD + "boolean"), Kind("term")
INTEGER, DOUBLE = Kind("num", XSD + "integer"), Kind("num", XSD + "double")


def name(var: str) -> str:
    return f"v_{var}"


def lex(v: Value) -> Column:
    """The lexical form."""
    k = v.kind
    if k.name == "iri":
        return F.concat(F.lit(k.template), v.col.cast("string")) if k.template else v.col
    if k.name == "str":
        return v.col
    if k.name == "term":
        return v.col["lex"]
    if k.name == "ts":
        return F.replace(v.col.cast("string"), F.lit(" "), F.lit("T"))
    return v.col.cast("string")


def term(v: Value) -> Column:
    """The value as a struct of kind, lexical form, datatype and language."""
    k = v.kind
    if k.name == "term":
        return v.col
    made = F.struct(F.lit("iri" if k.name == "iri" else "literal").alias("k"), lex(v).alias("lex"), F.lit("" if k.name == "iri" else k.dt).alias("dt"), F.lit("").alias("lang"))
    return F.when(v.col.isNotNull(), made)


def constant(t: Term) -> Value:
    if isinstance(t, Iri):
        return Value(F.lit(t.value), IRI)
    assert isinstance(t, Literal)
    if t.datatype in NUMERIC:
        if t.datatype.endswith(("integer", "int", "long", "short", "byte", "Integer")):
            return Value(F.lit(int(t.value)).cast("long"), Kind("num", t.datatype))
        return Value(F.lit(float(t.value)), Kind("num", t.datatype))
    if t.datatype == XSD + "boolean":
        return Value(F.lit(t.value in ("true", "1")), BOOL)
    if t.datatype == XSD + "dateTime":
        return Value(F.to_timestamp_ntz(F.lit(t.value.replace("T", " ").rstrip("Z"))), Kind("ts", t.datatype))
    if t.datatype == XSD + "date":
        return Value(F.lit(t.value).cast("date"), Kind("date", t.datatype))
    if t.datatype == STRING and not t.lang:
        return Value(F.lit(t.value), STR)
    made = F.struct(F.lit("literal").alias("k"), F.lit(t.value).alias("lex"), F.lit(t.datatype or RDF + "langString").alias("dt"), F.lit(t.lang).alias("lang"))
    return Value(made, TERM_KIND)


def common(a: Kind, b: Kind) -> Kind:
    """The narrowest kind that both fit."""
    maybe = a.maybe or b.maybe
    if replace(a, maybe=False) == replace(b, maybe=False):
        return replace(a, maybe=maybe)
    if a.name == b.name == "iri":
        return Kind("iri", maybe=maybe)
    if a.name == b.name == "num":
        return Kind("num", XSD + "double" if XSD + "double" in (a.dt, b.dt) else XSD + "decimal", maybe=maybe)
    if a.name == b.name and a.name != "term":
        return replace(a, maybe=maybe)
    return Kind("term", maybe=maybe)


def as_kind(v: Value, kind: Kind) -> Column:
    if kind.name == "term":
        return term(v)
    if kind.name == "iri" and kind.template != v.kind.template:
        return lex(v)
    if kind.name == "num" and kind.dt != v.kind.dt and kind.dt in (XSD + "double", XSD + "decimal"):
        return v.col.cast("double")
    return v.col


@dataclass
class Rel:
    """Solutions: a column v_<name> for each variable. ``none`` says that there are none, where that is known beforehand."""

    df: DataFrame
    kinds: dict[str, Kind]
    none: bool = False

    def value(self, var: str) -> Value:
        return Value(F.col(name(var)), self.kinds[var])

    def cast(self, wanted: dict[str, Kind]) -> Rel:
        """The same solutions with some variables as wider kinds."""
        if all(self.kinds.get(v) == k for v, k in wanted.items() if v in self.kinds):
            return self
        kinds = {v: wanted.get(v, k) for v, k in self.kinds.items()}
        return Rel(self.df.select(*(as_kind(self.value(v), k).alias(name(v)) for v, k in kinds.items())), kinds)

    def pick(self, variables: list[str]) -> Rel:
        return Rel(self.df.select(*(F.col(name(v)) for v in variables)), {v: self.kinds[v] for v in variables})


def union(a: Rel, b: Rel) -> Rel:
    """All solutions of both; a variable that one side lacks is unbound there."""
    kinds = {}
    for v in [*a.kinds, *(x for x in b.kinds if x not in a.kinds)]:
        if v in a.kinds and v in b.kinds:
            kinds[v] = common(a.kinds[v], b.kinds[v])
        else:
            kinds[v] = replace(a.kinds.get(v) or b.kinds[v], maybe=True)
    return Rel(a.cast(kinds).df.unionByName(b.cast(kinds).df, allowMissingColumns=True), kinds)


def compatible(a: Rel, b: Rel) -> tuple[Rel, Rel, Column | None, dict[str, Kind]]:
    """Both sides with shared variables as one kind, b's renamed r_<name>, and the condition that they agree."""
    shared = [v for v in a.kinds if v in b.kinds]
    wanted = {v: common(a.kinds[v], b.kinds[v]) for v in shared}
    a = a.cast({v: replace(k, maybe=a.kinds[v].maybe) for v, k in wanted.items()})
    b = b.cast({v: replace(k, maybe=b.kinds[v].maybe) for v, k in wanted.items()})
    right = b.df.select(*(F.col(name(v)).alias(f"r_{v}" if v in shared else name(v)) for v in b.kinds))
    condition = None
    for v in shared:
        x, y = F.col(name(v)), F.col(f"r_{v}")
        one = x == y
        if a.kinds[v].maybe:
            one = one | x.isNull()
        if b.kinds[v].maybe:
            one = one | y.isNull()
        condition = one if condition is None else condition & one
    return a, Rel(right, b.kinds), condition, wanted


def bound_parts(a: Rel, b: Rel, shared: list[str]) -> list[tuple[DataFrame, DataFrame, Column | None]]:
    """Pairs of parts whose joins, by plain equality each, make up the join of compatible solutions.

    Rows that leave a variable unbound are compatible whatever the other side says, so they are joined apart, without it.
    """
    parts: list[tuple[DataFrame, DataFrame, Column | None]] = [(a.df, b.df, None)]
    for v in shared:
        x, y, split = F.col(name(v)), F.col(f"r_{v}"), []
        for left, right, condition in parts:
            equal = x == y if condition is None else condition & (x == y)
            here = left.where(x.isNotNull()) if a.kinds[v].maybe else left
            there = right.where(y.isNotNull()) if b.kinds[v].maybe else right
            split.append((here, there, equal))
            if a.kinds[v].maybe:
                split.append((left.where(x.isNull()), right, condition))
            if b.kinds[v].maybe:
                split.append((here, right.where(y.isNull()), condition))
        parts = split
    return parts


#: Variables that may be unbound, of both sides together, by which a join is split into joins by equality.
MOST_UNBOUND = 4


def half_parts(a: Rel, b: Rel, wanted: list[str]) -> list[tuple[Column, list[tuple[Column, Column | None]]]]:
    """Rows of a by what they leave unbound, and for each the rows of b by what they leave unbound with the equality that makes them compatible.

    None where they have nothing bound in common, so that all are.
    """
    true = F.lit(True)

    def patterns(variables: list[str], column) -> list[tuple[Column, set[str]]]:
        out: list[tuple[Column, set[str]]] = [(true, set())]
        for v in variables:
            out = [x for cond, free in out for x in ((cond & column(v).isNotNull(), free), (cond & column(v).isNull(), free | {v}))]
        return out

    found = []
    for mine, unbound in patterns([v for v in wanted if a.kinds[v].maybe], lambda v: F.col(name(v))):
        shared = [v for v in wanted if v not in unbound]
        theirs = []
        for other, missing in patterns([v for v in shared if b.kinds[v].maybe], lambda v: F.col(f"r_{v}")):
            equal = [F.col(name(v)) == F.col(f"r_{v}") for v in shared if v not in missing]
            theirs.append((other, reduce(Column.__and__, equal) if equal else None))
        found.append((mine, theirs))
    return found


def join(a: Rel, b: Rel, how: str = "inner", extra: Column | None = None) -> Rel:
    """Inner or left join on compatible solutions; ``extra`` is a further condition."""
    whole = a, b
    a, b, condition, wanted = compatible(a, b)
    if extra is not None:
        condition = extra if condition is None else condition & extra
    left = how == "left"
    unbound = [v for v in wanted if a.kinds[v].maybe or b.kinds[v].maybe]
    if left and 0 < len(unbound) <= 2 and any(b.kinds[v].maybe for v in unbound):
        # Solutions with a compatible one, by joins by equality, and those without.
        return union(join(*whole, extra=extra), half_join(*whole, "left_anti", extra))
    if 0 < len(unbound) <= 2 and not (left and any(b.kinds[v].maybe for v in unbound)):
        joins = []
        for one, other, equal in bound_parts(a, b, list(wanted)):
            both = equal if extra is None else extra if equal is None else equal & extra
            joins.append(one.join(other, F.lit(True) if both is None else both, how) if both is not None or left else one.crossJoin(other))
        joined = reduce(DataFrame.unionByName, joins)
    elif condition is None and not left:
        joined = a.df.crossJoin(b.df)
    else:
        joined = a.df.join(b.df, F.lit(True) if condition is None else condition, how)
    kinds, columns = {}, []
    for v in [*a.kinds, *(x for x in b.kinds if x not in a.kinds)]:
        if v in wanted:
            kinds[v] = replace(wanted[v], maybe=a.kinds[v].maybe and (b.kinds[v].maybe or left))
            column = F.coalesce(F.col(name(v)), F.col(f"r_{v}")) if a.kinds[v].maybe else F.col(name(v))
        else:
            kinds[v] = a.kinds[v] if v in a.kinds else replace(b.kinds[v], maybe=b.kinds[v].maybe or left)
            column = F.col(name(v))
        columns.append(column.alias(name(v)))
    return Rel(joined.select(*columns), kinds)


def half_join(a: Rel, b: Rel, how: str, extra: Column | None = None, need_shared: bool = False) -> Rel:
    """Solutions of a with (left_semi) or without (left_anti) a compatible one in b."""
    before = a.kinds
    a, b, condition, wanted = compatible(a, b)
    if need_shared:
        # At least one variable must be bound on both sides.
        both = None
        for v in wanted:
            one = F.col(name(v)).isNotNull() & F.col(f"r_{v}").isNotNull()
            both = one if both is None else both | one
        if any(before[v].maybe or b.kinds[v].maybe for v in wanted):
            condition = condition & both
    if extra is not None:
        condition = extra if condition is None else condition & extra
    unbound = sum(x.kinds[v].maybe for v in wanted for x in (a, b))
    if not 0 < unbound <= MOST_UNBOUND:
        return Rel(a.df.join(b.df, F.lit(True) if condition is None else condition, how), a.kinds)
    kept = []
    for mine, theirs in half_parts(a, b, list(wanted)):
        rest = a.df.where(mine)
        for other, equal in theirs:
            if equal is None and need_shared:
                continue
            both = extra if equal is None else equal if extra is None else equal & extra
            part = b.df.where(other) if both is not None else b.df.where(other).limit(1)
            both = F.lit(True) if both is None else both
            if how == "left_semi":
                kept.append(rest.join(part, both, "left_semi"))
            rest = rest.join(part, both, "left_anti")
        if how == "left_anti":
            kept.append(rest)
    return Rel(reduce(DataFrame.unionByName, kept) if kept else a.df.limit(0), a.kinds)
