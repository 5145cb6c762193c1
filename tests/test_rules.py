"""Inference against plain forward chaining on small random graphs; blank nodes; contradictions; what rounds write."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import closure, inference, lineage, rules
from tessera.plans.algebra import OWL, RDF, RDFS, TYPE

E = "http://e/"
QUAD = "s string, s_kind string, p string, o string, o_kind string, o_dt string, o_lang string"
SAME, SUB, SUBP = OWL + "sameAs", RDFS + "subClassOf", RDFS + "subPropertyOf"


def frame(spark, triples):
    node = lambda t: (t[2:], "bnode") if t.startswith("_:") else (t, "iri")
    value = lambda t: (t[1:], "literal", "", "") if t.startswith('"') else (*node(t), "", "")
    return spark.createDataFrame([(*node(s), p, *value(o)) for s, p, o in sorted(triples)], QUAD)


def plain(df):
    mark = lambda t, kind: "_:" + t if kind == "bnode" else '"' + t if kind == "literal" else t
    rows = [(mark(r["s"], r["s_kind"]), r["p"], mark(r["o"], r["o_kind"])) for r in df.collect()]
    assert len(rows) == len(set(rows)), "each fact once"
    return set(rows)


def listed(facts, head):
    out = []
    while head != RDF + "nil":
        out.append(next(o for s, p, o in facts if s == head and p == RDF + "first"))
        head = next(o for s, p, o in facts if s == head and p == RDF + "rest")
    return out


def chained(given):
    """All that follows, one rule after the other until nothing is new. Lists are those given."""
    facts = set(given)
    while True:
        of = lambda p: [(s, o) for s, q, o in facts if q == p]  # noqa: E731,B023
        kind = lambda k: {s for s, o in of(TYPE) if o == OWL + k}  # noqa: E731,B023
        new = set()
        is_node = lambda o: not o.startswith('"')
        below = of(SUB) + [x for a, b in of(OWL + "equivalentClass") for x in ((a, b), (b, a))]
        below += [(c, m) for c, h in of(OWL + "intersectionOf") for m in listed(given, h)] + [(m, c) for c, h in of(OWL + "unionOf") for m in listed(given, h)]
        under = of(SUBP) + [x for a, b in of(OWL + "equivalentProperty") for x in ((a, b), (b, a))]
        predicates = {p for _, p, _ in facts}
        under += [(a, b) for a, b in of(SAME) if a in predicates or b in predicates]
        new |= {(a, SUB, b) for a, b in below} | {(a, SUB, c) for a, b in below for x, c in below if b == x}
        new |= {(a, SUBP, b) for a, b in under if (a, SAME, b) not in facts} | {(a, SUBP, c) for a, b in under for x, c in under if b == x}
        up = {c: {b for a, b in below if a == c} for c, _ in below}
        over = {p: {b for a, b in under if a == p} for p, _ in under}
        domain, range_ = of(RDFS + "domain"), of(RDFS + "range")
        turned = [x for a, b in of(OWL + "inverseOf") for x in ((a, b), (b, a))]
        for s, p, o in facts:
            if p == TYPE:
                new |= {(s, TYPE, c) for c in up.get(o, ())}
            new |= {(s, q, o) for q in over.get(p, ())} | {(s, TYPE, c) for q, c in domain if q == p}
            if is_node(o):
                new |= {(o, TYPE, c) for q, c in range_ if q == p} | {(o, q, s) for x, q in turned if x == p}
                if p in kind("SymmetricProperty"):
                    new.add((o, p, s))
        for p in kind("TransitiveProperty"):
            new |= {(a, p, d) for a, b in of(p) for c, d in of(p) if b == c}
        for p in kind("FunctionalProperty"):
            new |= {(b, SAME, d) for a, b in of(p) for c, d in of(p) if a == c and b != d and is_node(b) and is_node(d)}
        for p in kind("InverseFunctionalProperty"):
            new |= {(a, SAME, c) for a, b in of(p) for c, d in of(p) if b == d and a != c and is_node(b)}
        types = set(of(TYPE))
        for c, p in of(OWL + "onProperty"):
            for x, v in of(OWL + "hasValue"):
                if x == c:
                    new |= {(s, p, v) for s, k in types if k == c} | {(s, TYPE, c) for s, o in of(p) if o == v}
            for x, v in of(OWL + "someValuesFrom"):
                if x == c:
                    new |= {(s, TYPE, c) for s, o in of(p) if (o, v) in types or v == OWL + "Thing"}
            for x, v in of(OWL + "allValuesFrom"):
                if x == c:
                    new |= {(o, TYPE, v) for s, o in of(p) if (s, c) in types and is_node(o)}
            if (c, OWL + "maxCardinality", '"1') in facts:
                new |= {(b, SAME, d) for a, b in of(p) for y, d in of(p) if a == y and (a, c) in types and b != d and is_node(b) and is_node(d)}
        for c, h in of(OWL + "intersectionOf"):
            new |= {(s, TYPE, c) for s, _ in types if all((s, m) in types for m in listed(given, h))}
        for c, h in of(OWL + "oneOf"):
            new |= {(m, TYPE, c) for m in listed(given, h)}
        for q, h in of(OWL + "propertyChainAxiom"):
            ends = None
            for p in listed(given, h):
                ends = set(of(p)) if ends is None else {(a, d) for a, b in ends for c, d in of(p) if b == c}
            new |= {(a, q, b) for a, b in ends}
        for c, h in of(OWL + "hasKey"):
            members = sorted({s for s, k in types if k == c})
            for a, b in itertools.permutations(members, 2):
                if all({o for s, o in of(p) if s == a} & {o for s, o in of(p) if s == b} for p in listed(given, h)):
                    new.add((a, SAME, b))
        same = of(SAME)
        new |= {(b, SAME, a) for a, b in same} | {(a, SAME, d) for a, b in same for c, d in same if b == c and a != d}
        for a, b in same:
            new |= {(b, p, o) for s, p, o in facts if s == a and p != SAME} | {(s, p, b) for s, p, o in facts if o == a and p != SAME}
        new = {(s, p, o) for s, p, o in new if p != SAME or s != o}
        if new <= facts:
            return facts
        facts |= new


def as_list(items, label):
    cells = [f"_:{label}{i}" for i in range(len(items))] + [RDF + "nil"]
    return cells[0], {t for i, x in enumerate(items) for t in ((cells[i], RDF + "first", x), (cells[i], RDF + "rest", cells[i + 1]))}


def world(seed):
    rng = random.Random(seed)
    node = lambda: rng.choice([f"{E}n{i}" for i in range(7)] + ["_:b1", "_:b2"])
    cls = lambda: E + rng.choice("CDFGH")
    prop = lambda: E + rng.choice("pqrtu")
    facts = {(node(), prop(), node() if rng.random() < 0.8 else '"lit') for _ in range(10)} | {(node(), TYPE, cls()) for _ in range(5)}
    axioms = [
        lambda: {(cls(), SUB, cls())}, lambda: {(prop(), SUBP, prop())}, lambda: {(prop(), RDFS + "domain", cls())}, lambda: {(prop(), RDFS + "range", cls())},
        lambda: {(prop(), OWL + "inverseOf", prop())}, lambda: {(prop(), TYPE, OWL + rng.choice(["SymmetricProperty", "TransitiveProperty", "FunctionalProperty", "InverseFunctionalProperty"]))},
        lambda: {(node(), SAME, node())}, lambda: {(E + "R", OWL + "onProperty", prop()), (E + "R", OWL + "hasValue", node())}, lambda: {("_:b9", OWL + "onProperty", prop()), ("_:b9", OWL + "someValuesFrom", cls()), ("_:b9", SUB, cls())},
        lambda: {(E + "A", OWL + "onProperty", prop()), (E + "A", OWL + "allValuesFrom", cls()), (cls(), SUB, E + "A")}, lambda: {(E + "M", OWL + "onProperty", prop()), (E + "M", OWL + "maxCardinality", '"1'), (node(), TYPE, E + "M")},
        lambda: {(cls(), OWL + "equivalentClass", cls())}, lambda: {(prop(), OWL + "equivalentProperty", prop())}, lambda: {(prop(), SAME, prop())} if seed % 4 == 0 else set(),
    ]
    for axiom in rng.sample(axioms, 5):
        facts |= axiom()
    for p, many in (("propertyChainAxiom", prop), ("hasKey", prop), ("intersectionOf", cls), ("unionOf", cls), ("oneOf", node)):
        if rng.random() < 0.5:
            head, cells = as_list([many() for _ in range(rng.choice([1, 2, 3]))], p[:2] + "x")
            facts |= cells | {((prop if p == "propertyChainAxiom" else cls)(), OWL + p, head)}
    return facts


@pytest.mark.parametrize("seed", range(6))
def test_equals_forward_chaining(spark, seed):
    given = world(seed)
    assert plain(inference.infer(frame(spark, given))) - set(given) == chained(given) - set(given)


def test_blank_nodes_stay_blank(spark):
    given = {("_:b1", SAME, E + "a"), (E + "D", SUB, "_:b9"), (E + "x", TYPE, E + "D"), (E + "a", E + "p", '"_:b1')}
    found = inference.infer(frame(spark, given))
    assert found.where("s_kind = 'iri' AND NOT s LIKE 'http%' OR o_kind = 'iri' AND NOT o LIKE 'http%'").count() == 0
    assert {(E + "x", TYPE, "_:b9"), ("_:b1", E + "p", '"_:b1'), (E + "a", SAME, "_:b1")} <= plain(found)


def test_a_schema_that_follows(spark):
    given = {(E + "kindOf", SUBP, SUB), (E + "A", E + "kindOf", E + "B"), (E + "B", SUB, E + "C"), (E + "x", TYPE, E + "A")}
    assert {(E + "x", TYPE, E + "B"), (E + "x", TYPE, E + "C"), (E + "A", SUB, E + "C")} <= plain(inference.infer(frame(spark, given)))


def test_rows_that_lack_a_part_say_nothing(spark):
    given = {(E + "x", E + "p", E + "y"), (E + "p", SUBP, E + "q")}
    odd = spark.createDataFrame([(E + "x", "iri", E + "p", None, "iri", None, None), (None, "iri", E + "p", E + "y", "iri", "", "")], QUAD)
    assert plain(inference.infer(frame(spark, given).unionByName(odd))) == given | {(E + "x", E + "q", E + "y")}


def test_large_class_needs_no_pairs(spark, monkeypatch):
    written = []
    monkeypatch.setattr(inference, "stored", lambda df, name: written.append((name, (out := lineage.stored(df, name)).count())) or out)
    n = 2_000
    rows = spark.range(n).select(F.concat(F.lit(E + "x"), "id").alias("s"), F.lit("iri").alias("s_kind"), F.lit(E + "id").alias("p"), F.lit(E + "one").alias("o"), F.lit("iri").alias("o_kind"), F.lit("").alias("o_dt"), F.lit("").alias("o_lang"))
    found = inference.Closure(rows.unionByName(frame(spark, {(E + "id", TYPE, OWL + "InverseFunctionalProperty")})))
    assert found.classes.count() == n - 1 and found.facts.where(F.col("p") == E + "id").count() == 1
    assert found.expanded().where(F.col("p") == E + "id").count() == n
    assert sum(k for _, k in written) < 8 * n and len(written) < 12


def test_rounds_write_what_they_find(spark, monkeypatch):
    written = []
    monkeypatch.setattr(closure, "stored", lambda df, name: written.append((out := lineage.stored(df, name)).count()) or out)
    edges = spark.range(64).select(F.col("id").alias("x"), (F.col("id") + 1).alias("y"))
    assert closure.transitive(edges).count() == 64 * 65 // 2 == sum(written)


def test_contradictions(spark):
    first, cells = as_list([E + "C", E + "D", E + "F"], "d")
    second, more = as_list([E + "a", E + "b"], "e")
    given = cells | more | {
        (E + "x", TYPE, E + "C"), (E + "x", TYPE, E + "D"), ("_:all", TYPE, OWL + "AllDisjointClasses"), ("_:all", OWL + "members", first), (E + "G", OWL + "disjointWith", E + "H"), (E + "y", TYPE, E + "G"), (E + "y", TYPE, E + "H"),
        ("_:dif", TYPE, OWL + "AllDifferent"), ("_:dif", OWL + "distinctMembers", second), (E + "a", SAME, E + "b"), (E + "a", OWL + "differentFrom", E + "b"), (E + "p", TYPE, OWL + "AsymmetricProperty"), (E + "u", E + "p", E + "v"), (E + "v", E + "p", E + "u"),
        (E + "p", OWL + "propertyDisjointWith", E + "q"), (E + "u", E + "q", E + "v"), (E + "z", TYPE, OWL + "Nothing"), ("_:no", OWL + "sourceIndividual", E + "u"), ("_:no", OWL + "assertionProperty", E + "q"), ("_:no", OWL + "targetIndividual", E + "v"),
    }
    found = {(r["rule"], r["s"]) for r in inference.inconsistencies(frame(spark, given)).collect()}
    assert found == {("cax-adc", E + "x"), ("cax-dw", E + "y"), ("eq-diff1", E + "a"), ("eq-diff3", E + "a"), ("prp-asyp", E + "u"), ("prp-asyp", E + "v"), ("prp-pdw", E + "u"), ("cls-nothing2", E + "z"), ("prp-npa1", E + "u")}
    assert inference.inconsistencies(frame(spark, {(E + "x", TYPE, E + "C")})).collect() == []
    assert rules.SAME == SAME


def test_known_facts_are_one_scan_and_no_limit_is_planned_in_vain(spark):
    given = {(E + "a", E + "p", E + "b"), (E + "b", E + "p", E + "c"), (E + "p", TYPE, OWL + "TransitiveProperty"), (E + "a", TYPE, E + "R"), (E + "R", OWL + "onProperty", E + "p"), (E + "R", OWL + "maxCardinality", '"0')}
    found = inference.Closure(frame(spark, given))
    assert len(found.parts) > 2
    assert found.known()._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert found.rules.limited(0) and not found.rules.limited(1)
    assert {tuple(r) for r in found.inconsistencies().collect()} == {("cls-maxc1", E + "a", E + "R")}


def test_pairs_of_equals_are_dealt_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(inference, "CHUNK", 16)
    names = ["_:b1", *[f"{E}n{i}" for i in range(59)]]
    found = inference.infer(frame(spark, {(names[0], SAME, n) for n in names[1:]})).where(F.col("p") == SAME)
    assert found.groupBy(F.spark_partition_id()).count().count() > 1
    assert plain(found) == {(a, SAME, b) for a in names for b in names if a != b}
