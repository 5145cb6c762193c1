"""SPARQL expressions as columns. An error is NULL, so three-valued logic comes out as SPARQL has it."""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import quote

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.algebra import RDF, XSD, Aggregate, Call, Iri, Literal, Node, QueryError, Var
from ..plans.bindings import BOOL, DOUBLE, INTEGER, IRI, NUMERIC, STR, TERM_KIND, Kind, Value, as_kind, common, constant, lex, term

CASTS = {XSD + "boolean": "boolean", XSD + "integer": "long", XSD + "int": "long", XSD + "decimal": "double", XSD + "double": "double", XSD + "float": "double", XSD + "string": "string", XSD + "dateTime": "timestamp_ntz", XSD + "date": "date"}
DATE_PARTS: dict[str, Callable[[Column], Column]] = {"YEAR": F.year, "MONTH": F.month, "DAY": F.day, "HOURS": F.hour, "MINUTES": F.minute, "SECONDS": F.second}


def number(v: Value) -> Column:
    """The numeric value; NULL if it has none."""
    if v.kind.name == "num":
        return v.col
    if v.kind.name == "term":
        return F.when(v.col["dt"].isin(NUMERIC), v.col["lex"].try_cast("double"))
    return F.lit(None).cast("double")


def text(v: Value) -> Column:
    """The string of a string literal; NULL for anything else."""
    if v.kind.name == "str":
        return v.col
    if v.kind.name == "term":
        return F.when((v.col["k"] == "literal") & v.col["dt"].isin(XSD + "string", RDF + "langString"), v.col["lex"])
    return F.lit(None).cast("string")


def stamp(v: Value) -> Column:
    if v.kind.name in ("ts", "date"):
        return v.col.cast("timestamp_ntz")
    if v.kind.name == "term":
        return F.when(v.col["dt"].isin(XSD + "dateTime", XSD + "date"), F.regexp_replace(v.col["lex"], "Z$", "").try_cast("timestamp_ntz"))
    return F.lit(None).cast("timestamp_ntz")


def truth(v: Value) -> Column:
    """The effective boolean value."""
    if v.kind.name == "bool":
        return v.col
    if v.kind.name == "num":
        return v.col != 0
    if v.kind.name == "str":
        return F.length(v.col) > 0
    if v.kind.name == "term":
        dt = v.col["dt"]
        return F.when(dt == XSD + "boolean", v.col["lex"].isin("true", "1")).when(dt.isin(NUMERIC), number(v) != 0).when(dt.isin(XSD + "string", RDF + "langString"), F.length(v.col["lex"]) > 0)
    return F.lit(None).cast("boolean")


def equal(a: Value, b: Value) -> Column:
    x, y = a.kind.name, b.kind.name
    if x == y == "iri" and a.kind.template == b.kind.template:
        return a.col == b.col
    if x == y == "iri":
        return lex(a) == lex(b)
    if x == y and x != "term":
        kind = common(a.kind, b.kind)
        return as_kind(a, kind) == as_kind(b, kind)
    if "iri" in (x, y) and "term" not in (x, y):
        return F.lit(False)
    if "term" not in (x, y):
        return stamp(a) == stamp(b) if {x, y} <= {"ts", "date"} else F.lit(None).cast("boolean")
    s, t = term(a), term(b)
    both = s["dt"].isin(NUMERIC) & t["dt"].isin(NUMERIC)
    same = (s["k"] == t["k"]) & (s["lex"] == t["lex"]) & (s["dt"] == t["dt"]) & (s["lang"] == t["lang"])
    comparable = (s["k"] != "literal") | (t["k"] != "literal") | (s["dt"] == t["dt"])
    return F.when(both, number(a).cast("double") == number(b).cast("double")).when(same, True).when(comparable, False)


def less(a: Value, b: Value, op: str) -> Column:
    compare = {"<": lambda x, y: x < y, ">": lambda x, y: x > y, "<=": lambda x, y: x <= y, ">=": lambda x, y: x >= y}[op]
    x, y = a.kind.name, b.kind.name
    if x == y == "num" or x == y == "str" or x == y == "bool" or x == y == "ts" or x == y == "date":
        return compare(a.col, b.col)
    if {x, y} <= {"ts", "date"}:
        return compare(stamp(a), stamp(b))
    if "term" not in (x, y) or "iri" in (x, y):
        return F.lit(None).cast("boolean")
    return F.coalesce(compare(number(a).cast("double"), number(b).cast("double")), compare(text(a), text(b)), compare(stamp(a), stamp(b)))


def arithmetic(a: Value, b: Value, op: str) -> Value:
    whole = a.kind.name == b.kind.name == "num" and a.kind.dt == b.kind.dt == XSD + "integer"
    x, y = number(a), number(b)
    if op == "/":
        return Value(F.try_divide(x.cast("double"), y.cast("double")), DOUBLE)
    made = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](x, y)
    return Value(made, INTEGER if whole else DOUBLE)


def order_keys(v: Value, down: bool) -> list[Column]:
    """Unbound before blank nodes, IRIs and literals; numbers by value, times by time, the rest by their form."""
    turn = (lambda c: c.desc_nulls_last()) if down else (lambda c: c.asc_nulls_first())
    if v.kind.name != "term":
        return [turn(lex(v) if v.kind.name == "iri" else v.col)]
    rank = F.when(v.col.isNull(), 0).when(v.col["k"] == "bnode", 1).when(v.col["k"] == "iri", 2).otherwise(3)
    return [turn(rank), turn(number(v)), turn(stamp(v)), turn(v.col["lex"])]


class Expressions:
    """Compiles expressions over the variables of ``values``; ``exists`` answers (NOT) EXISTS patterns."""

    def __init__(self, values: Callable[[str], Value | None], exists: Callable[[Node], Column] | None = None, base: str = "") -> None:
        self.values, self.exists, self.base = values, exists, base

    def of(self, e) -> Value:
        if isinstance(e, Var):
            found = self.values(e.name)
            return found if found is not None else Value(F.lit(None).cast("string"), Kind("str", XSD + "string", maybe=True))
        if isinstance(e, (Iri, Literal)):
            return constant(e)
        if isinstance(e, Aggregate):
            raise QueryError("an aggregate stands where none may")
        assert isinstance(e, Call)
        return self.call(e)

    def truth(self, e) -> Column:
        return truth(self.of(e))

    def call(self, e: Call) -> Value:
        n, args = e.name, e.args
        if n in ("EXISTS", "NOT EXISTS"):
            if self.exists is None:
                raise QueryError("EXISTS may not stand here")
            found = self.exists(args[0])
            return Value(found if n == "EXISTS" else ~found, BOOL)
        if n == "BOUND":
            return Value(self.of(args[0]).col.isNotNull(), BOOL)
        if n == "COALESCE":
            return self.one_of([self.of(a) for a in args])
        if n == "IF":
            yes, no = self.of(args[1]), self.of(args[2])
            kind = common(yes.kind, no.kind)
            return Value(F.when(self.truth(args[0]), as_kind(yes, kind)).when(~self.truth(args[0]), as_kind(no, kind)), kind)
        if n == "&&":
            return Value(self.truth(args[0]) & self.truth(args[1]), BOOL)
        if n == "||":
            return Value(self.truth(args[0]) | self.truth(args[1]), BOOL)
        if n == "!":
            return Value(~self.truth(args[0]), BOOL)
        v = [self.of(a) for a in args]
        if n in ("IN", "NOT IN"):
            found = None
            if all(isinstance(a, (Iri, Literal)) for a in args[1:]) and len({x.kind.name for x in v}) == 1 and v[0].kind.name in ("str", "num"):
                found = v[0].col.isin([x.col for x in v[1:]])
            else:
                for x in v[1:]:
                    one = equal(v[0], x)
                    found = one if found is None else found | one
            found = F.lit(False) if found is None else found
            return Value(found if n == "IN" else ~found, BOOL)
        if n == "=":
            return Value(equal(v[0], v[1]), BOOL)
        if n == "!=":
            return Value(~equal(v[0], v[1]), BOOL)
        if n in ("<", ">", "<=", ">="):
            return Value(less(v[0], v[1], n), BOOL)
        if n in ("+", "-", "*", "/"):
            return arithmetic(v[0], v[1], n)
        if n == "neg":
            return Value(-number(v[0]), v[0].kind if v[0].kind.name == "num" else DOUBLE)
        if n in CASTS:
            return self.cast(v[0], n)
        made = getattr(self, "f_" + n.lower(), None)
        if made is None:
            raise QueryError(f"unknown function {n}")
        return made(*v)

    @staticmethod
    def one_of(v: list[Value]) -> Value:
        kind = v[0].kind
        for x in v[1:]:
            kind = common(kind, x.kind)
        return Value(F.coalesce(*(as_kind(x, kind) for x in v)), kind)

    @staticmethod
    def cast(v: Value, dt: str) -> Value:
        kind = {"boolean": BOOL, "long": INTEGER, "double": DOUBLE, "string": STR, "timestamp_ntz": Kind("ts", dt), "date": Kind("date", dt)}[CASTS[dt]]
        if CASTS[dt] == "string":
            return Value(lex(v), STR)
        if v.kind.name == "iri":
            return Value(F.lit(None).cast(CASTS[dt]), kind)
        if v.kind.name == "num" and CASTS[dt] == "long":
            return Value(v.col.try_cast("long"), kind)
        if CASTS[dt] == "timestamp_ntz":
            return Value(stamp(v) if v.kind.name in ("ts", "date") else F.regexp_replace(lex(v), "Z$", "").try_cast("timestamp_ntz"), kind)
        return Value((v.col if v.kind.name in ("num", "bool") else lex(v)).try_cast(CASTS[dt]), kind)

    # Terms.

    def f_str(self, v):
        return Value(lex(v), STR)

    def f_lang(self, v):
        return Value(v.col["lang"] if v.kind.name == "term" else F.lit(""), STR)

    def f_datatype(self, v):
        return Value(F.when(v.col["k"] == "literal", v.col["dt"]) if v.kind.name == "term" else F.when(v.col.isNotNull(), F.lit(v.kind.dt or None)), IRI)

    def f_langmatches(self, v, tag):
        a, b = F.lower(text(v)), F.lower(text(tag))
        return Value(F.when(b == "*", F.length(a) > 0).otherwise((a == b) | F.startswith(a, F.concat(b, F.lit("-")))), BOOL)

    def is_kind(self, v, kind):
        if v.kind.name == "term":
            return Value(v.col["k"] == kind, BOOL)
        return Value(F.when(v.col.isNotNull(), F.lit((v.kind.name == "iri") == (kind == "iri") and kind != "bnode")), BOOL)

    def f_isiri(self, v):
        return self.is_kind(v, "iri")

    f_isuri = f_isiri

    def f_isblank(self, v):
        return self.is_kind(v, "bnode")

    def f_isliteral(self, v):
        return self.is_kind(v, "literal")

    def f_isnumeric(self, v):
        return Value(F.when(v.col.isNotNull(), number(v).isNotNull()), BOOL)

    def f_sameterm(self, a, b):
        return Value(term(a) == term(b), BOOL)

    def f_iri(self, v):
        made = lex(v)
        if self.base:
            made = F.when(made.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), made).otherwise(F.concat(F.lit(self.base), made))
        return Value(made, IRI)

    f_uri = f_iri

    def f_bnode(self, *v):
        label = F.concat(F.lit("b"), F.sha2(text(v[0]), 256)) if v else F.uuid()
        return Value(F.struct(F.lit("bnode").alias("k"), label.alias("lex"), F.lit("").alias("dt"), F.lit("").alias("lang")), TERM_KIND)

    def f_strdt(self, v, dt):
        return Value(F.struct(F.lit("literal").alias("k"), text(v).alias("lex"), lex(dt).alias("dt"), F.lit("").alias("lang")), TERM_KIND)

    def f_strlang(self, v, lang):
        return Value(F.struct(F.lit("literal").alias("k"), text(v).alias("lex"), F.lit(RDF + "langString").alias("dt"), F.lower(text(lang)).alias("lang")), TERM_KIND)

    def f_uuid(self):
        return Value(F.concat(F.lit("urn:uuid:"), F.uuid()), IRI)

    def f_struuid(self):
        return Value(F.uuid(), STR)

    # Strings.

    def f_strlen(self, v):
        return Value(F.length(text(v)).cast("long"), INTEGER)

    def f_substr(self, v, start, *length):
        args = [number(start).cast("int")] + [number(x).cast("int") for x in length]
        return Value(F.substring(text(v), args[0], args[1]) if length else F.substring(text(v), args[0], F.length(text(v))), STR)

    def f_ucase(self, v):
        return Value(F.upper(text(v)), STR)

    def f_lcase(self, v):
        return Value(F.lower(text(v)), STR)

    def f_strstarts(self, a, b):
        return Value(F.startswith(text(a), text(b)), BOOL)

    def f_strends(self, a, b):
        return Value(F.endswith(text(a), text(b)), BOOL)

    def f_contains(self, a, b):
        return Value(F.contains(text(a), text(b)), BOOL)

    def f_strbefore(self, a, b):
        at = F.position(text(b), text(a))
        return Value(F.when(at > 0, F.substring(text(a), F.lit(1), at - 1)).otherwise(F.lit("")), STR)

    def f_strafter(self, a, b):
        at = F.position(text(b), text(a))
        return Value(F.when(at > 0, F.substring(text(a), at + F.length(text(b)), F.length(text(a)))).otherwise(F.lit("")), STR)

    def f_encode_for_uri(self, v):
        # What is not reserved stays; url_encode writes a space as + and leaves * alone.
        return Value(F.replace(F.replace(F.replace(F.url_encode(text(v)), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~")), STR)

    def f_concat(self, *v):
        return Value(F.concat(*(text(x) for x in v)) if v else F.lit(""), STR)

    def f_replace(self, v, pattern, new, *flags):
        return Value(F.regexp_replace(text(v), self.pattern(pattern, flags), text(new)), STR)

    def f_regex(self, v, pattern, *flags):
        return Value(F.regexp_like(text(v), self.pattern(pattern, flags)), BOOL)

    @staticmethod
    def pattern(pattern, flags):
        if not flags:
            return text(pattern)
        return F.concat(F.lit("(?"), text(flags[0]), F.lit(")"), text(pattern))

    # Numbers, times, hashes.

    def f_abs(self, v):
        return Value(F.abs(number(v)), v.kind if v.kind.name == "num" else DOUBLE)

    def rounded(self, v, how):
        return v if v.kind.name == "num" and v.kind.dt == XSD + "integer" else Value(how(number(v)).cast("double"), DOUBLE)

    def f_round(self, v):
        return self.rounded(v, lambda c: F.floor(c + 0.5))

    def f_ceil(self, v):
        return self.rounded(v, F.ceil)

    def f_floor(self, v):
        return self.rounded(v, F.floor)

    def f_rand(self):
        return Value(F.rand(), DOUBLE)

    def f_now(self):
        return Value(F.current_timestamp().cast("timestamp_ntz"), Kind("ts", XSD + "dateTime"))

    def f_timezone(self, v):
        return Value(F.when(F.regexp_like(lex(v), F.lit("Z$")), F.lit("PT0S")), STR)

    def f_tz(self, v):
        return Value(F.regexp_extract(lex(v), r"(Z|[+-]\d\d:\d\d)$", 1), STR)

    def f_md5(self, v):
        return Value(F.md5(text(v)), STR)

    def f_sha1(self, v):
        return Value(F.sha1(text(v)), STR)

    def f_sha256(self, v):
        return Value(F.sha2(text(v), 256), STR)

    def f_sha384(self, v):
        return Value(F.sha2(text(v), 384), STR)

    def f_sha512(self, v):
        return Value(F.sha2(text(v), 512), STR)


def _date_part(part: Callable[[Column], Column]):
    return lambda self, v: Value(part(stamp(v)).cast("long"), INTEGER)


for _name, _part in DATE_PARTS.items():
    setattr(Expressions, "f_" + _name.lower(), _date_part(_part))

#: What percent-encoding leaves alone in paths.
SAFE = "/()_-.$~"


def encode_path(path: str) -> str:
    return quote(path, safe=SAFE)
