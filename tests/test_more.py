"""Names in metadata, heading rules, close names, paths in shapes, long chains, unbound joins, assets and edits on small cases."""

import difflib
import random

import pytest

from tessera.corpus import Corpus
from tessera.operators import audits, closure, documents, shacl
from tessera.plans.algebra import XSD
from tessera.plans.bindings import Kind, Rel, join
from tessera.queries.graphs import schema_quads
from tessera.sources.frontmatter import Config, document_quads

C = Config(base_iri="http://w/")


def test_names_of_things_stand_for_themselves():
    text = "---\ntype: Book\nid: urn:isbn:123\nmail: {'@id': 'mailto:x@y'}\nseller: {'@id': 'wiki:shop'}\nrel: {'@id': 'http://e/x'}\n---\n"
    quads, _ = document_quads("b.md", text, C, "g")
    assert {(q[1], q[3].rpartition("/")[2].rpartition("#")[2], q[4]) for q in quads} == {("urn:isbn:123", "type", "https://schema.org/Book"), ("urn:isbn:123", "mail", "mailto:x@y"), ("urn:isbn:123", "seller", "http://w/shop"), ("urn:isbn:123", "rel", "http://e/x")}
    assert document_quads("b.md", "---\ntype: Book\nid: plain\n---\n", C, "g")[0][0][1] == "http://w/plain"


def test_heading_rules(spark):
    cases = {"1. First": "numbered", "1) First": "numbered", "2020 plans": None, "1.2 Deep": None, "The Old Town Hall": "title case", "The [Old Town](x) hall": None, "About NATO And SQLite": None, "Das Ölfeld Und Ärger": "title case", "A Big-Small MacOS": None, "x " * 1200 + "Old Town": "title case"}
    files = spark.createDataFrame([(f"{i}.md", f"# T\n\n## {text}\n") for i, text in enumerate(cases)], "path string, text string")
    found = {r["route"]: r["issue"] for r in documents.heading_style(documents.headings(files)).collect()}
    assert [found.get(str(i)) for i in range(len(cases))] == list(cases.values())


def test_close_names_equal_all_pairs(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcde/_") for _ in range(rng.randint(2, 14)))
    routes = sorted({"shared_prefix_of_all/" + word() if rng.random() < 0.5 else word() for _ in range(120)})
    targets = set()
    for r in routes:
        letters = list(r)
        for _ in range(rng.randint(1, 3)):
            letters[rng.randrange(len(letters))] = rng.choice("abcdefg")
        targets.add("".join(letters))
    targets = sorted(targets - set(routes))
    broken = spark.createDataFrame([("s", t, t, "missing_document") for t in targets], "source_route string, raw_target string, target_route string, issue string")
    want = {}
    for t in targets:
        close = [r for r in routes if difflib.SequenceMatcher(None, r, t).ratio() >= documents.CUTOFF]
        if len(close) == 1:
            want[t] = close[0]
    got = {r["raw_target"]: r["new_route"] for r in documents.fix_links(broken, spark.createDataFrame([(r,) for r in routes], "route string")).where("how = 'close'").collect()}
    assert got == want and len(want) > 20


SHAPE = """ex:Shape a sh:NodeShape ; sh:targetNode ex:a ; sh:property [ sh:path {path} ; sh:{kind} {n} ] ."""


@pytest.mark.parametrize(
    ("path", "ends"),
    [("ex:p", 2), ("( ex:p ex:p )", 1), ("[ sh:alternativePath ( ex:p ex:q ) ]", 3), ("[ sh:zeroOrMorePath ex:p ]", 4), ("[ sh:oneOrMorePath ex:p ]", 3), ("[ sh:zeroOrOnePath ex:p ]", 3), ("[ sh:inversePath ex:q ]", 1), ("( [ sh:oneOrMorePath ex:p ] ex:q )", 1)],
)
def test_paths_of_shapes(spark, path, ends):
    data = schema_quads(spark, "ex:a ex:p ex:b, ex:c . ex:b ex:p ex:d . ex:d ex:p ex:b ; ex:q ex:a . ex:a ex:q ex:z . ex:s rdf:first ex:a ; rdf:rest rdf:nil .").drop("g")
    report = lambda kind, n: shacl.validate(data, schema_quads(spark, SHAPE.format(path=path, kind=kind, n=n)).drop("g")).count()
    assert (report("minCount", ends), report("minCount", ends + 1), report("maxCount", ends), report("maxCount", ends - 1)) == (0, 1, 0, 1)


def test_a_long_chain_and_its_starts(spark):
    n = 300
    edges = spark.range(n).selectExpr("id AS x", "id + 1 AS y")
    assert closure.transitive(edges).count() == n * (n + 1) // 2
    assert {r["y"] for r in closure.transitive(edges, start=spark.createDataFrame([(n - 7,)], "x long")).collect()} == set(range(n - 6, n + 1))


@pytest.mark.parametrize("how", ["inner", "left"])
def test_joins_of_unbound_rows(spark, how):
    num, maybe = Kind("num", XSD + "integer"), Kind("num", XSD + "integer", maybe=True)
    a = [(1, 1), (None, 2), (3, 3), (4, 4)]
    b = [(1, 10), (3, 30), (3, 31)] + ([(None, 99)] if how == "inner" else [])
    left = Rel(spark.createDataFrame(a, "v_x long, v_a long"), {"x": maybe, "a": num})
    right = Rel(spark.createDataFrame(b, "v_x long, v_b long"), {"x": maybe if how == "inner" else num, "b": num})
    got = sorted(map(tuple, join(left, right, how).df.collect()), key=repr)
    want = []
    for x, p in a:
        found = [(y if x is None else x, p, q) for y, q in b if x is None or y is None or x == y]
        want += found or ([(x, p, None)] if how == "left" else [])
    assert got == sorted(want, key=repr)
    assert "NestedLoop" not in left.df.join(right.df, "v_x")._jdf.queryExecution().toString()


def test_assets_and_references(spark):
    text = "---\ntype: X\nheroImage: [../assets/a.png, https://e/x.png]\nlogo: /abs.png\nx: {y: ['wiki:gone#p', 'wiki:b.md', 'no wiki:b']}\nid: wiki:me\n---\n![a](../assets/a%20b.png?x=1) `![c](c.png)` ![far](https://e/y.png)\n"
    files = spark.createDataFrame([("p/b.md", text), ("b.md", "x"), ("e.md", "")], "path string, text string")
    found = {(r["kind"], r["raw_target"], r["asset"]) for r in audits.asset_references(files).collect()}
    assert found == {("metadata", "../assets/a.png", "assets/a.png"), ("metadata", "/abs.png", None), ("image", "../assets/a%20b.png?x=1", "assets/a b.png")}
    there = spark.createDataFrame([("assets/a.png",)], "path string")
    assert {(r["raw_target"], r["issue"]) for r in audits.broken_assets(audits.asset_references(files), there, ["assets"]).collect()} == {("/abs.png", "outside_assets"), ("../assets/a%20b.png?x=1", "missing_asset")}
    assert {(r["raw_target"], r["target_route"]) for r in audits.metadata_references(files).collect()} == {("wiki:gone#p", "gone"), ("wiki:b.md", "b")}


def test_a_schema_pointer_of_a_wrong_kind_and_remote_schemas(spark):
    files = spark.createDataFrame([("a.md", "---\ntype: X\nk:jsonSchema: 5\n---\n"), ("b.md", "---\ntype: X\nk:jsonSchema: [https://e/s.json, s.json]\n---\n")], "path string, text string")
    schemas = spark.createDataFrame([("s.json", '{"required": ["size"]}')], "path string, text string")
    assert {(r["code"], r["route"]) for r in audits.schema_issues(files, schemas, C).collect()} == {("frontmatter_schema", "a"), ("missing_schema_ref", "b"), ("frontmatter_schema", "b")}


def test_the_corpus_checks_with_its_schemas(spark):
    files = [("a.md", ".md", "---\ntype: X\nk:jsonSchema: s.json\nlayout: no.html\n---\n# A\n")]
    c = Corpus(spark, spark.createDataFrame(files, "path string, suffix string, text string"), C)
    schemas = spark.createDataFrame([("s.json", '{"required": ["size"]}')], "path string, text string")
    assert {r["code"] for r in c.check(schemas).collect()} == {"frontmatter_schema", "missing_layout_file"}
    assert {r["code"] for r in c.check(schemas, spark.createDataFrame([("no.html",)], "path string")).collect()} == {"frontmatter_schema"}


def test_two_tables_about_the_same_subjects(spark):
    from tessera.plans.compiler import Compiler
    from tessera.sources.tables import Field, Table, Tables

    e = "http://e/"
    one = Table(spark.createDataFrame([(1, "a"), (2, "b")], "k long, name string"), "k", e + "x/", e + "X", e + "g1", {e + "name": Field("name")})
    two = Table(spark.createDataFrame([(2, 20), (3, 30)], "k long, size long"), "k", e + "x/", e + "X", e + "g2", {e + "size": Field("size")})
    other = Table(spark.createDataFrame([(2, "z")], "k long, name string"), "k", e + "y/", e + "Y", e + "g3", {e + "name": Field("name")})
    ask = lambda q: sorted(tuple(r) for r in Compiler(spark, Tables(spark, [one, two, other]), {"e": e}, e).query(q).df.collect())
    assert ask("SELECT ?n ?s WHERE { ?x e:name ?n ; e:size ?s }") == [("b", 20)]
    assert ask("SELECT ?n WHERE { ?x a e:X ; e:name ?n ; e:size 20 }") == [("b",)]
    assert ask("SELECT ?n WHERE { ?x e:size ?s . ?x e:name ?n }") == [("b",)]
    assert len(ask("SELECT ?x ?n WHERE { ?x e:name ?n }")) == 3


@pytest.mark.parametrize(("fmt", "suffix"), [("turtle", ".ttl"), ("n3", ".ttl"), ("trig", ".trig"), ("xml", ".rdf"), ("json-ld", ".jsonld"), ("nquads", ".nq"), ("nt", ".nt")])
def test_exports_read_back(spark, fmt, suffix, tmp_path):
    from tessera.sources import corpus as source

    text = "---\ntype: Book\nname: \"A <b> & \\\"c\\\"\\nline\"\nsize: 5\nok: true\nday: 2020-01-02\nlink: https://e/x?a=1&b=2\npart: {type: Page, n: 1}\n---\n"
    files = spark.createDataFrame([("d/a.md", ".md", text), ("b.md", ".md", text.replace("Book", "Film"))], "path string, suffix string, text string")
    c = Corpus(spark, files, C)
    written = {r["route"]: r["text"] for r in c.export_documents(fmt).collect()}
    assert written.keys() == {"d/a", "b"}
    back = spark.createDataFrame([(f"{k.replace('/', '-')}{suffix}", suffix, v) for k, v in written.items()], "path string, suffix string, text string")
    plain = lambda df: sorted((r["p"], r["o"] if r["o_kind"] != "bnode" else "", r["o_kind"], r["o_dt"]) for r in df.collect())
    assert plain(source.quads(back, C)) == plain(source.quads(files, C))
    if suffix in (".nq", ".nt"):
        c.write(str(tmp_path / "out"), fmt)
        assert spark.read.text(str(tmp_path / "out")).count() == len(plain(source.quads(files, C)))
    else:
        assert len(c.export(fmt)) > 100


def test_chosen_files_and_shown_blocks(spark):
    from tessera.operators import pages

    files = spark.createDataFrame([("a.md", "x"), ("b.yaml", "y"), ("c.txt", "z")], "path string, text string")
    assert [r["path"] for r in pages.chosen(files, ["b.yaml", "a.md", "b.yaml"]).collect()] == ["b.yaml", "a.md"]
    with pytest.raises(FileNotFoundError, match="no.md"):
        pages.chosen(files, ["a.md", "no.md"])
    with pytest.raises(ValueError, match="c.txt"):
        pages.chosen(files, ["c.txt"])
    block = "<!-- sparql:start -->\n```sparql\nQ\n```\n\n| t |\n\n<!-- sparql:end -->"
    assert pages.without_wrappers(f"a\n{block}\nb") == "a\n```sparql\nQ\n```\n\n| t |\n\nb"
    assert pages.without_wrappers("<!-- sparql:start -->\n<!-- Q -->\n\n| t |\n\n<!-- sparql:end -->") == "| t |\n"
    assert [r["category"] for r in pages.categories(spark.createDataFrame([("p.md", "---\ntype: [ex:Book, book, Film]\nlayout: l/Default2.html\n---\n")], "path string, text string")).collect()] == ["Default2", "Book", "Film"]
    ids = pages.identifiers(spark.createDataFrame([("p.md", "---\nid: wiki:q\n'@id': urn:x:1\n---\n")], "path string, text string"), C)
    assert [r["id"] for r in ids.collect()] == ["urn:x:1", "wiki:q", "http://w/q", "http://w/p"]
