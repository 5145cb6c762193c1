"""Parsing, readers, documents and results on tiny corpora."""

import datetime
import json

import pytest

from tessera.corpus import Corpus
from tessera.functions import jsonschema
from tessera.functions import markdown as md
from tessera.functions import results
from tessera.operators import documents, shacl
from tessera.operators.inference import infer
from tessera.plans.algebra import QueryError
from tessera.plans.parser import parse, query_form
from tessera.sources import frontmatter, rdf
from tessera.sources.frontmatter import Config, document_quads
from tessera.sources.quads import SCHEMA, read, write

BASE = "http://example.org/wiki/"
CONFIG = Config(base_iri=BASE)


def quads(spark, text):
    return spark.createDataFrame(rdf.Turtle("PREFIX ex: <http://e/> PREFIX rdfs: <http://www.w3.org/2000/01/rdf-schema#> PREFIX owl: <http://www.w3.org/2002/07/owl#> PREFIX sh: <http://www.w3.org/ns/shacl#> PREFIX xsd: <http://www.w3.org/2001/XMLSchema#>\n" + text, "g").read(), SCHEMA)


@pytest.mark.parametrize("text", ["INSERT DATA { <a> <b> <c> }", "SELECT ?x { SERVICE <http://x> { ?x ?y ?z } }", "SELECT { ?s ?p ?o }", "SELECT ?x { ?x nope:y ?z }", "SELECT ?x { ?x ?y ?z } trailing"])
def test_refused_queries(text):
    with pytest.raises(QueryError):
        parse(text)


def test_query_forms():
    assert query_form("PREFIX a: <b> SELECT * { ?s ?p ?o }") == "SELECT"
    assert query_form("# PREFIX\nBASE <http://x/>\nASK {}") == "ASK"
    assert parse("SELECT * { GRAPH ?g { ?s ?p ?o } }").uses_graphs
    assert not parse('SELECT * { ?s ?p "GRAPH ?g {" }').uses_graphs


def test_front_matter_rules():
    text = "---\ntype: [Person, foaf:Agent]\nname: Ann\nage: 3\nzero: 0\nborn: 2001-02-03\nseen: 2001-02-03 04:05:06\nhome: http://x/y\nknows: {'@id': wiki:bob}\naddress: {type: PostalAddress, city: Rome, codes: [1, 2]}\nnick: [a, 0, null]\nodd:key: v\n'@context': {a: b}\n---\nBody\n"
    found, warnings = document_quads("people/Ann.md", text, CONFIG, "g")
    facts = {(q[3].rpartition("/")[2], q[4], q[5], q[6].rpartition("#")[2]) for q in found if q[1] == BASE + "people/Ann"}
    assert not warnings
    assert {("name", "Ann", "literal", "string"), ("age", "3", "literal", "integer"), ("born", "2001-02-03", "literal", "date"), ("seen", "2001-02-03T04:05:06", "literal", "dateTime"), ("home", "http://x/y", "iri", ""), ("knows", BASE + "bob", "iri", ""), ("nick", "0", "literal", "integer")} <= facts
    assert not any(f[0] == "zero" for f in facts)
    assert any(q[3] == "https://schema.org/codes" and q[4] == "[1, 2]" and q[2] == "bnode" for q in found)
    assert any(q[3] == "https://schema.org/odd:key" for q in found)
    assert document_quads("a b.md", text, CONFIG, "g")[1] and not document_quads("x.md", "---\nname: a\n---\n", CONFIG, "g")[0]
    assert frontmatter.route_of("a/index.md") == "a" and frontmatter.route_of("index.md") == ""
    assert frontmatter.typed_rows({"a": [True, None, datetime.date(2020, 1, 2)]})[1:] == [("a[0]", "true", "bool"), ("a[1]", None, "null"), ("a[2]", "2020-01-02", "date")]


def test_headings_and_links():
    text = "# A `b`\n\nSet\n---\n\n```\n# no\n```\n## Dup\n## Dup\n#nope\n"
    assert md.headings(text) == [(1, 1, "A `b`", "a-b"), (3, 2, "Set", "set"), (9, 2, "Dup", "dup"), (10, 2, "Dup", "dup-1")]
    found = md.links("[[a/b#C d|x]] `[[no]]` [t](../p.md#h) [e](http://x) [f](a.png) [up](../../../z.md)", "q/r/s")
    assert [(k, r, f) for k, _, r, f, *_ in found] == [("wiki", "a/b", "c-d"), ("markdown", "q/p", "h"), ("markdown", None, "")]
    assert md.resolve("../towns/./New%20x.md", "rivers/a") == "towns/New x"
    assert md.mentions("The Salt Way, b-Salt Way, [[x|Salt Way]], `salt way`, salt way", {"salt way": "w"}, "s") == [("Salt Way", "w", 1, 5, 4, 12), ("salt way", "w", 1, 55, 54, 62)]
    assert md.json_path({"a": {"b": [{"c": 1}, {"c": 2}, {}]}}, ".a.b[].c") == [1, 2] and md.json_path({"a": [5]}, "a[0]") == [5]
    with pytest.raises(ValueError):
        md.json_path({}, ".a-b")


def test_json_schema():
    schema = {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "minimum": 2}, "b": {"$ref": "#/$defs/s"}}, "additionalProperties": False, "$defs": {"s": {"type": "array", "items": {"type": "string", "minLength": 2}, "uniqueItems": True}}}
    assert jsonschema.errors({"a": 2, "b": ["xx"]}, schema) == []
    assert [e[:2] for e in jsonschema.errors({"a": 1, "b": ["x", "x"], "c": 0}, schema)] == [("", "additionalProperties"), ("/a", "minimum"), ("/b", "uniqueItems"), ("/b/0", "minLength"), ("/b/1", "minLength")]
    assert jsonschema.errors(True, {"type": "integer"}) and jsonschema.errors(3, {"oneOf": [{"minimum": 1}, {"maximum": 5}]})
    assert not jsonschema.errors(3, {"if": {"minimum": 5}, "then": False, "else": {"const": 3}})


def test_corpus_end_to_end(spark, tmp_path):
    pages = {
        "Alice.md": "---\ntype: Person\ngivenName: Alice\nknows: wiki:Bob\n---\n# Alice\n\nSee [[Bob]] and [[Bop]] and [x](Bob.md#none).\n",
        "Bob.yaml": "type: Person\ngivenName: Bob\n",
        "onto.ttl": "@prefix schema: <https://schema.org/> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . schema:Person rdfs:subClassOf schema:Thing .",
        "shape.md": "no metadata\n\n```turtle\nwiki:S a sh:NodeShape ; sh:targetClass schema:Person ; sh:property [ sh:path schema:familyName ; sh:minCount 1 ; sh:message \"family\" ] .\n```\n",
        "bad.ttl": "<<<", "skip/x.md": "---\ntype: Person\n---\n", "line.nt": '<http://a> <http://b> "c\\"d"@en .\nnot a line\n',
    }
    for name, text in pages.items():
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text(text)
    c = Corpus.load(spark, str(tmp_path), CONFIG, ["skip/*"])
    q = "SELECT ?n WHERE { ?s a schema:Person ; schema:givenName ?n } ORDER BY ?n"
    assert [r["n"] for r in c.query(q).df.collect()] == ["Alice", "Bob"]
    assert c.format(q, "csv") == "n\r\nAlice\r\nBob\r\n"
    assert c.format(q, "md").splitlines()[2:] == ["| Alice |", "| Bob |"]
    assert c.format(q, "ascii") == "n\n-----\nAlice\nBob"
    assert json.loads(c.format(q, "json"))["results"]["bindings"][0] == {"n": {"type": "literal", "value": "Alice"}}
    assert c.query("SELECT ?s WHERE { ?s a schema:Thing }").df.count() == 0
    assert c.query("SELECT ?s WHERE { ?s a schema:Thing }", inference=True).df.count() == 2
    assert json.loads(c.format("ASK { ?s schema:knows wiki:Bob }", "json"))["boolean"] is True
    assert c.format("CONSTRUCT { ?s a schema:Named } WHERE { ?s schema:givenName ?n }", "nt").count("Named") == 2
    assert {(r["issue"], r["target_route"]) for r in c.broken_links().collect()} == {("missing_document", "Bop"), ("missing_heading", "Bob")}
    assert {r["focus"] for r in c.shacl().collect()} == {BASE + "Alice", BASE + "Bob"}
    assert any("bad.ttl" in r["message"] for r in __import__("tessera.sources.corpus", fromlist=["x"]).warnings(c.files, CONFIG).collect())
    assert c.query('SELECT ?o WHERE { <http://a> <http://b> ?o FILTER(LANG(?o) = "en") }').df.collect()[0]["o"] == 'c"d'
    assert "schema:givenName" in c.export("turtle") and json.loads(c.export("json-ld"))["@graph"]
    assert {r["code"] for r in c.lint().collect()} >= {"broken_links", "link_style"}
    assert c.check().count() == 2 and c.stats().first()["triples"] > 8


def test_turtle_and_store(spark, tmp_path):
    found = quads(spark, 'ex:a ex:p 1, 2.5, 1e3, true, "x"@en, "y"^^ex:t ; ex:q [ ex:r ( ex:b ex:c ) ] .')
    assert found.count() == 12
    write(found, str(tmp_path / "q"))
    assert read(spark, str(tmp_path / "q")).exceptAll(found.select(*read(spark, str(tmp_path / "q")).columns)).count() == 0
    lines = found.select(results.line_column(graph=True).alias("value"))
    again = rdf.line_quads(lines, "none")
    assert again.count() == 12 and again.select("p", "o").exceptAll(found.select("p", "o")).count() == 0
    with pytest.raises(ValueError):
        rdf.Turtle("ex:a ex:b ex:c .").read()


def test_inference_is_idempotent(spark):
    data = quads(spark, "ex:A rdfs:subClassOf ex:B . ex:B rdfs:subClassOf ex:A, ex:C . ex:x a ex:A . ex:p owl:inverseOf ex:q . ex:x ex:p ex:y . ex:y owl:sameAs ex:z .")
    once = infer(data)
    assert infer(once).count() == once.count()
    facts = {(r["s"][9:], r["o"][9:]) for r in once.where("p = 'http://e/q'").collect()}
    assert facts == {("y", "x"), ("z", "x")}


def test_shacl_components(spark):
    data = quads(spark, 'ex:a a ex:T ; ex:n 5 ; ex:m 3 ; ex:l "x"@en, "y"@en ; ex:k ex:b . ex:b a ex:U ; ex:n "s" . ex:c a ex:T ; ex:n 1, 2 ; ex:extra 1 .')
    shapes = quads(
        spark,
        "ex:S sh:targetClass ex:T ; sh:closed true ; sh:ignoredProperties ( <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> ex:m ) ; sh:property [ sh:path ex:n ; sh:maxCount 1 ; sh:maxInclusive 4 ; sh:lessThan ex:m ] ; "
        "sh:property [ sh:path ex:l ; sh:uniqueLang true ] ; sh:property [ sh:path ex:k ; sh:class ex:U ; sh:nodeKind sh:IRI ; sh:node ex:N ] . ex:N a sh:NodeShape ; sh:property [ sh:path ex:n ; sh:datatype xsd:integer ] .",
    )
    found = {(r["focus"][9:], r["component"]) for r in shacl.validate(data.drop("g"), shapes.drop("g")).collect()}
    assert found == {("a", "maxInclusive"), ("a", "lessThan"), ("a", "uniqueLang"), ("a", "node"), ("c", "maxCount"), ("c", "closed")}


def test_edits_and_fixes(spark):
    files = spark.createDataFrame([("a.md", "one two three")], "path string, text string")
    edits = spark.createDataFrame([("a.md", 0, 3, "one", "1"), ("a.md", 4, 7, "two", "22"), ("a.md", 8, 13, "other", "x")], "path string, start int, end int, old string, new string")
    assert documents.apply_edits(files, edits).collect()[0]["text"] == "1 22 three"
    broken = spark.createDataFrame([("s", t, t, "missing_document") for t in ("Harbour_Tonw", "old", "a b", "zzz")], "source_route string, raw_target string, target_route string, issue string")
    routes = spark.createDataFrame([("Harbour_Town",), ("new",), ("a_b",)], "route string")
    assert {(r["raw_target"], r["new_route"], r["how"]) for r in documents.fix_links(broken, routes, {"old": "new"}).collect()} == {("Harbour_Tonw", "Harbour_Town", "close"), ("old", "new", "rename"), ("a b", "a_b", "underscore")}


def test_configuration(tmp_path):
    from tessera.sources import config

    (tmp_path / "wiki.yml").write_text("wiki:\n  inputs: docs\ngraph:\n  base_iri: http://x/y\n  context: {ex: 'http://e/'}\nlint:\n  headings: true\n")
    p = config.load(str(tmp_path))
    assert (p.inputs, p.graph.base_iri, p.graph.vocab, p.graph.namespaces["ex"], p.severities) == (["docs"], "http://x/y/", None, "http://e/", {"headings": "error"})
    assert config.load(None).graph.vocab == "https://schema.org/" and config.lockfile(str(tmp_path / "none")) == {}
    assert config.schema_registry([("T", "a"), ("T", ["b", "a"])]) == {"T": ["a", "b"]}
    (tmp_path / "wiki.yml").write_text("nope: 1\n")
    with pytest.raises(ValueError):
        config.load(str(tmp_path))


def test_site_pages(spark):
    from tessera.operators import site

    text = "---\nname: A\n---\n# A\n\nText **b** `<i>` [[b|B]] [c](../b.md#x)\n\n## Sub\n\n- one\n- two\n\n| h |\n|---|\n| 1 |\n\n```py\n<x>\n```\n> q\n"
    files = spark.createDataFrame([("d/a.md", text), ("b.md", "text [[d/a]]")], "path string, text string")
    rows = {r["slug"]: r for r in site.pages(files).collect()}
    a = rows["d/a"]
    assert a["html"] == '<p>Text <strong>b</strong> <code>&lt;i&gt;</code> <a href="/b/">B</a> <a href="/b/#x">c</a></p>\n<h2 id="sub">Sub</h2>\n<ul><li>one</li><li>two</li></ul>\n<table><tr><th>h</th></tr><tr><td>1</td></tr></table>\n<pre><code class="language-py">&lt;x&gt;</code></pre>\n<blockquote><p>q</p></blockquote>'
    assert a["title"] == "A" and a["output_path"] == "d/a/index.html" and [o["slug"] for o in a["outline"]] == ["sub"] and a["backlinks"] == ["b"]
    assert rows["b"]["title"] == "b" and site.page_url("x y", "flat") == "/x%20y.html"
    assert site.formatted("#  A  #\r\n\n\n|a|b |\n```\n x  \n```\n\n") == "# A\n\n| a | b |\n```\n x  \n```\n"
