"""Shapes against a validator that goes from node to node; typed values, nested shapes, one document and every document."""

import random
import re

import pytest

from tessera.operators import shacl
from tessera.plans.algebra import TYPE, XSD
from tessera.sources.quads import SCHEMA
from tessera.sources.rdf import Turtle

E = "http://e/"
HEAD = "PREFIX ex: <http://e/> PREFIX sh: <http://www.w3.org/ns/shacl#> PREFIX xsd: <http://www.w3.org/2001/XMLSchema#>\n"


def quads(spark, text, graph="g"):
    return spark.createDataFrame(Turtle(HEAD + text, graph).read(), SCHEMA)


def found(spark, data, shapes, **options):
    rows = shacl.validate(quads(spark, data), quads(spark, shapes), **options).collect()
    return {(r["focus"].removeprefix(E), r["component"], r["value"]) for r in rows}


def test_nested_property_below_node(spark):
    shapes = "ex:S a sh:NodeShape ; sh:targetNode ex:n , ex:m ; sh:node [ sh:property [ sh:path ex:a ; sh:property [ sh:path ex:b ; sh:minCount 1 ] ] ] ."
    assert found(spark, "ex:n ex:a ex:x . ex:m ex:a ex:y . ex:y ex:b 1 .", shapes) == {("n", "node", E + "n")}
    turned = shapes.replace("sh:node [", "sh:not [")
    assert found(spark, "ex:n ex:a ex:x . ex:m ex:a ex:y . ex:y ex:b 1 .", turned) == {("m", "not", E + "m")}


def test_values_of_one_text_differ_by_kind_and_datatype(spark):
    data = 'ex:n ex:p 1 . ex:m ex:p "1" . ex:i ex:p <1> . ex:l ex:p "1"@en .'
    shape = 'ex:S a sh:NodeShape ; sh:targetSubjectsOf ex:p ; sh:property [ sh:path ex:p ; {} ] .'
    assert {f for f, _, _ in found(spark, data, shape.format('sh:in ( "1" )'))} == {"n", "i", "l"}
    assert {f for f, _, _ in found(spark, data, shape.format('sh:hasValue "1"'))} == {"n", "i", "l"}
    assert {f for f, _, _ in found(spark, data, shape.format("sh:in ( 1 2 )"))} == {"m", "i", "l"}


@pytest.mark.parametrize(
    "datatype, good, bad",
    [
        ("integer", ["1", "-0012", "+7", "9" * 60], ["1.5", "", "x", "1e3", " 1"]),
        ("byte", ["127", "-128"], ["128", "-129", "9" * 50, "-" + "9" * 50]),
        ("nonNegativeInteger", ["0", "9" * 45], ["-1", "-" + "9" * 45]),
        ("unsignedLong", [str(2**64 - 1)], [str(2**64)]),
        ("decimal", ["1.50", ".5", "-3."], ["1e3", "INF", "."]),
        ("double", ["1e3", "INF", "-INF", "NaN", "2"], ["inf", "1,5"]),
        ("boolean", ["true", "0"], ["TRUE", "yes"]),
        ("date", ["2024-02-29", "2024-02-28Z", "12024-01-01"], ["2023-02-29", "2024-2-1", "2024-01-01T00:00:00"]),
        ("dateTime", ["2024-01-01T10:00:00.5+02:00"], ["2024-01-01", "2024-13-01T00:00:00"]),
        ("string", ["", "x"], []),
    ],
)
def test_lexical_forms(spark, datatype, good, bad):
    rows = [(x,) for x in [*good, *bad]]
    ok = {r["x"] for r in spark.createDataFrame(rows, "x string").where(shacl.well_formed(shacl.F.col("x"), XSD + datatype)).collect()}
    assert ok == set(good)


# Random shapes: a small graph, shapes as nested dictionaries, and a validator that follows their definitions.

NODES, PREDICATES = [E + x for x in "abcdef"], [E + x for x in "pqr"]


def literal(rng):
    return rng.choice([("1", XSD + "integer"), ("2", XSD + "integer"), ("1", XSD + "string"), ("x", XSD + "string"), ("1.5", XSD + "integer")])


def graph(rng):
    out = set()
    for _ in range(14):
        out.add((rng.choice(NODES), rng.choice(PREDICATES), (rng.choice(NODES), "iri") if rng.random() < 0.6 else literal(rng)))
    return out | {(n, TYPE, (E + rng.choice("AB"), "iri")) for n in rng.sample(NODES, 3)}


def shape(rng, depth=0, path=False):
    s = {"path": rng.choice(PREDICATES)} if path else {}
    choices = ["datatype", "class", "nodeKind", "pattern", "in", "hasValue", "minInclusive", "equals", "disjoint"] + (["minCount", "maxCount"] if path else [])
    for key in rng.sample(choices, rng.choice([0, 1])) + (["minCount"] if path and rng.random() < 0.4 else []):
        s[key] = {
            "datatype": lambda: XSD + rng.choice(["integer", "string"]), "class": lambda: E + rng.choice("AB"), "nodeKind": lambda: rng.choice(["IRI", "Literal"]), "pattern": lambda: rng.choice(["^1", "[a-c]$"]),
            "in": lambda: [rng.choice([(rng.choice(NODES), "iri"), literal(rng)]) for _ in range(3)], "hasValue": lambda: rng.choice([(rng.choice(NODES), "iri"), literal(rng)]), "minInclusive": lambda: 2,
            "equals": lambda: rng.choice(PREDICATES), "disjoint": lambda: rng.choice(PREDICATES), "minCount": lambda: 1, "maxCount": lambda: 1,
        }[key]()
    if depth < 2:
        s["property"] = [shape(rng, depth + 1, True) for _ in range(rng.choice([0, 1, 1, 2]))]
        for key in rng.sample(["node", "not", "and", "or", "xone"], rng.choice([0, 1])):
            s[key] = shape(rng, depth + 1, rng.random() < 0.5) if key in ("node", "not") else [shape(rng, depth + 1, rng.random() < 0.5) for _ in range(2)]
    return s


def violations(g, s, focus):
    """(focus, component, value) of a shape at a node."""
    of = lambda n, p: {o for a, q, o in g if (a, "iri") == n and q == p}
    values = of(focus, s["path"]) if "path" in s else {focus}
    out = set()
    bad = lambda key, vs: out.update((focus[0], key, v[0]) for v in vs)
    fails = lambda t, v: bool(violations(g, t, v))
    for key, x in s.items():
        if key == "minCount" and len(values) < x or key == "maxCount" and len(values) > x or key == "hasValue" and x not in values:
            out.add((focus[0], key, None))
        elif key == "datatype":
            bad(key, {v for v in values if v[1] != x or x.endswith("integer") and not re.fullmatch(r"\d+", v[0])})
        elif key == "class":
            bad(key, {v for v in values if (x, "iri") not in of(v, TYPE)})
        elif key == "nodeKind":
            bad(key, {v for v in values if (v[1] == "iri") != (x == "IRI")})
        elif key == "pattern":
            bad(key, {v for v in values if not re.search(x, v[0])})
        elif key == "in":
            bad(key, {v for v in values if v not in x})
        elif key == "minInclusive":
            bad(key, {v for v in values if not (v[1] == XSD + "integer" and float(v[0]) >= x)})
        elif key == "equals":
            bad(key, values ^ of(focus, x))
        elif key == "disjoint":
            bad(key, values & of(focus, x))
        elif key == "property":
            for t in x:
                for v in values:
                    out |= violations(g, t, v)
        elif key == "node":
            bad(key, {v for v in values if fails(x, v)})
        elif key == "not":
            bad(key, {v for v in values if not fails(x, v)})
        elif key in ("and", "or", "xone"):
            passed = {v: sum(not fails(t, v) for t in x) for v in values}
            bad(key, {v for v, n in passed.items() if {"and": n < len(x), "or": n < 1, "xone": n != 1}[key]})
    return out


def turtle(s):
    term = lambda v: f"<{v[0]}>" if v[1] == "iri" else f'"{v[0]}"^^<{v[1]}>'
    out = []
    for key, x in s.items():
        if key in ("path", "datatype", "class", "equals", "disjoint"):
            out.append(f"sh:{key} <{x}>")
        elif key == "nodeKind":
            out.append(f"sh:nodeKind sh:{x}")
        elif key == "pattern":
            out.append(f'sh:pattern "{x}"')
        elif key in ("in",):
            out.append(f"sh:in ( {' '.join(map(term, x))} )")
        elif key == "hasValue":
            out.append(f"sh:hasValue {term(x)}")
        elif key in ("minCount", "maxCount", "minInclusive"):
            out.append(f"sh:{key} {x}")
        elif key == "property":
            out += [f"sh:property [ {turtle(t)} ]" for t in x]
        elif key in ("node", "not"):
            out.append(f"sh:{key} [ {turtle(x)} ]")
        else:
            out.append(f"sh:{key} ( {' '.join(f'[ {turtle(t)} ]' for t in x)} )")
    return " ; ".join(out) or "sh:severity sh:Violation"


@pytest.mark.parametrize("seed", range(8))
def test_random_shapes(spark, seed):
    """Several shapes over one graph; what each finds is told apart by its own severity-free name."""
    rng = random.Random(seed)
    g = graph(rng)
    data = "".join(f"<{s}> <{p}> " + (f"<{o[0]}>" if o[1] == "iri" else f'"{o[0]}"^^<{o[1]}>') + " .\n" for s, p, o in g)
    shapes = [shape(rng) for _ in range(5)]
    want = set().union(*(violations(g, s, (n, "iri")) for s in shapes for n in NODES[:4]))
    targets = " , ".join(f"<{n}>" for n in NODES[:4])
    text = "".join(f"ex:S{i} a sh:NodeShape ; sh:targetNode {targets} ; {turtle(s)} .\n" for i, s in enumerate(shapes))
    got = {(r["focus"], r["component"], r["value"]) for r in shacl.validate(quads(spark, data), quads(spark, text)).collect()}
    assert got == want


def test_one_document_and_every_document(spark):
    """Without metadata there is nothing to find; a valid person, and one without a given name."""
    shapes = quads(spark, "ex:P a sh:NodeShape ; sh:targetClass ex:Person ; sh:property [ sh:path ex:givenName ; sh:minCount 1 ; sh:datatype xsd:string ] , [ sh:path ex:knows ; sh:class ex:Person ] .")
    valid, invalid = quads(spark, 'ex:v a ex:Person ; ex:givenName "Ann" ; ex:knows ex:w .', "v"), quads(spark, "ex:w a ex:Person .", "w")
    every = valid.unionByName(invalid)
    assert {(r["g"], r["component"]) for r in shacl.validate_documents(every, shapes).collect()} == {("v", "class"), ("w", "minCount")}
    assert shacl.validate(every, shapes, within=valid).collect() == []
    assert [r["focus"] for r in shacl.validate(every, shapes, within=invalid).collect()] == [E + "w"]
    assert shacl.validate(every, shapes, within=every.limit(0)).collect() == []
    scans = shacl.validate(every, shapes, within=invalid)
    assert scans.columns == ["focus", "path", "value", "component", "severity", "message", "shape"]


def test_a_shape_that_asks_for_itself_is_refused(spark):
    with pytest.raises(ValueError, match="asks for itself"):
        found(spark, "ex:a ex:p ex:b .", "ex:S a sh:NodeShape ; sh:targetNode ex:a ; sh:node ex:S .")
