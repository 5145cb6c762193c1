"""Consequences of changed documents, headings, sources and odd folder names."""

import random

from pyspark.sql import functions as F

from tessera.operators import audits, documents, inference, provenance
from tessera.operators.lineage import scratch
from tessera.plans.algebra import RDFS, TYPE
from tessera.queries.upkeep import NO_QUADS
from tessera.sources import corpus
from tessera.streaming import incremental, refresh

E = "http://e/"


def says(rng):
    node = lambda: E + rng.choice("abcd")
    out = [(node(), "iri", E + rng.choice("pqr"), *((node(), "iri") if rng.random() < 0.7 else ("7", "literal")), "", "") for _ in range(3)]
    out += [(node(), "iri", TYPE, E + rng.choice("CDF"), "iri", "", "")] if rng.random() < 0.6 else []
    if rng.random() < 0.3:
        p = rng.choice(["subClassOf", "subPropertyOf", "domain", "range"])
        ends = {"subClassOf": "CDF", "subPropertyOf": "pqr"}.get(p)
        out.append((E + rng.choice(ends or "pqr"), "iri", RDFS + p, E + rng.choice(ends or "CDF"), "iri", "", ""))
    return out


def test_rounds_equal_a_new_build(spark):
    rng = random.Random(4)
    log = incremental.Log(spark, scratch(spark, "log"), buckets=3)
    held = {}
    for n in range(5):
        changed = rng.sample(range(6), 3)
        for d in changed:
            held[f"d{d}"] = says(rng) if rng.random() < 0.75 else []
        rows = [(f"d{d}", *q) for d in changed for q in held[f"d{d}"]]
        args = (log, spark.createDataFrame([(f"d{d}",) for d in changed], "path string"), spark.createDataFrame(rows + rows[:1], NO_QUADS), f"b{n}")
        incremental.change(*args)
        if n == 2:
            incremental.change(*args)  # repeated after a failure
        every = spark.createDataFrame([q for of in held.values() for q in of], NO_QUADS.removeprefix("path string, "))
        want = {tuple(r) for r in inference.infer(every).collect()} if every.count() else set()
        got = [tuple(r) for r in incremental.facts(log).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert {tuple(r)[1:] for r in incremental.said(log).collect()} == {q for of in held.values() for q in of}
    folded = incremental.Log(spark, scratch(spark, "log"), buckets=3)
    log.compact(folded)
    assert {tuple(r) for r in incremental.facts(folded).collect()} == set(got)
    assert folded.rows("said").count() <= log.rows("said").count()


def test_a_round_reads_the_buckets_of_its_paths(spark):
    log = incremental.Log(spark, scratch(spark, "log"), buckets=32)
    rows = [(f"d{d}", f"{E}{d}", "iri", TYPE, E + "C", "iri", "", "") for d in range(200)]
    paths = lambda some: spark.createDataFrame([(p,) for p in some], "path string")
    incremental.change(log, paths(r[0] for r in rows), spark.createDataFrame(rows, NO_QUADS), "b0")
    bucket = paths(["d5"]).select(log.bucket("path").alias("b")).head()["b"]
    of_one = log.rows("said").where(F.col("bucket") == bucket)
    assert 0 < len(of_one.inputFiles()) and of_one.count() < 30
    incremental.change(log, paths(["d5"]), spark.createDataFrame([], NO_QUADS), "b1")
    written = spark.read.parquet(f"{log.folder}/batch=b1")
    assert written.where("layer = 'said'").count() == 1 and written.count() == 2
    assert incremental.facts(log).count() == 199


def test_a_folder_with_odd_characters(spark, tmp_path):
    root = tmp_path / "my+wiki (1) ä%41"
    (root / "a b").mkdir(parents=True)
    (root / "x.md").write_text("---\ntype: T\n---\n")
    (root / "a b" / "y+z.md").write_text("---\ntype: U\n---\n")
    assert sorted(r["path"] for r in corpus.scan(spark, str(tmp_path / "my+wiki (1) ä%41").replace("%", "%")).collect()) == ["a b/y+z.md", "x.md"]


def test_files_that_go(spark, tmp_path):
    root = tmp_path / "wiki"
    root.mkdir()
    config = corpus.Config()

    def quads_of(batch):
        return corpus.flat_map(batch.select("path", "suffix", "text"), NO_QUADS, lambda p, s, t: [(p, *q[1:]) for q in corpus.file_quads(p, s, t, "g", config)[0]])

    def names():
        log = incremental.Log(spark, str(tmp_path / "log"), buckets=4)
        incremental.sync(log, str(root), str(tmp_path / "state"), quads_of, corpus.scan(spark, str(root)).select("path"))
        return sorted(r["o"].rpartition("/")[2] for r in incremental.facts(log).where(F.col("p") == TYPE).collect())

    for name in "AB":
        (root / f"{name}.md").write_text(f"---\ntype: {name}\n---\n")
    assert names() == ["A", "B"]
    (root / "A.md").unlink()
    (root / "C.md").write_text("---\ntype: C\n---\n")
    assert names() == ["B", "C"]
    assert names() == ["B", "C"]
    assert refresh.deleted.__doc__


def test_headings_are_mended_only_where_one_is_close(spark):
    page = "# Alpha beta\n\n## Alpha betas\n\n## Getting started\n"
    links = "See [[p#Getting startd|x]], [[p#alpha bet]], [y](p.md#getting-strated) and [z](p.md#none), `[[p#Getting startd]]`."
    files = spark.createDataFrame([("p.md", page), ("q.md", links)], "path string, text string")
    ids = documents.headings(files).select("route", "slug")
    broken = documents.broken_links(documents.links(files), files.select(documents.route(F.col("path")).alias("route")), ids)
    fixes = documents.fix_headings(broken, ids)
    # Both alpha headings are close, so neither is taken.
    assert {(r["fragment"], r["new_fragment"]) for r in fixes.collect()} == {("getting-startd", "getting-started"), ("getting-strated", "getting-started")}
    out = documents.apply_edits(files, audits.heading_edits(files, fixes)).collect()
    assert [tuple(r) for r in out] == [("q.md", "See [[p#getting-started|x]], [[p#alpha bet]], [y](p.md#getting-started) and [z](p.md#none), `[[p#Getting startd]]`.")]


def test_sources_and_what_they_ask_for(spark):
    files = [("main/x.md", ""), ("deps/a/x.md", ""), ("deps/a/inner/y.md", ""), ("deps/ab/x.md", "")]
    files += [("deps/a/wiki.yml", "sources:\n- {name: b, url: 'http://b', ref: v1}\n- {name: c, url: 'http://c'}\n- {name: bad}\n"), ("deps/a/wiki.json", '{"sources": [{"name": "no", "url": "u"}]}'), ("deps/b/wiki.toml", '[[sources]]\nname = "c"\nurl = "http://other"\n[[sources]]\nname = "a"\nurl = "http://a"\n'), ("deps/z/wiki.yml", ": : :")]
    frame = spark.createDataFrame(files, "path string, text string")
    sources = spark.createDataFrame([("a", "./deps/a"), ("in", "deps/a/inner/"), ("b", "deps/b"), ("z", "deps/z")], "name string, root string")
    graphs = {r["path"]: r["g"].rpartition("graphs/")[2] for r in provenance.source_graphs(frame, sources, E).collect()}
    assert {p: graphs[p] for p, _ in files[:4]} == {"main/x.md": "root", "deps/a/x.md": "source/a", "deps/a/inner/y.md": "source/in", "deps/ab/x.md": "root"}
    declared = provenance.declarations(frame, sources.withColumn("root", F.regexp_replace("root", "^./", "")))
    assert {(r["parent"], r["name"], r["ref"]) for r in declared.collect()} == {("a", "b", "v1"), ("a", "c", None), ("b", "c", None), ("b", "a", None)}
    root = spark.createDataFrame([(None, "a", "http://a", None, None, 0), ("unused", "a", "http://x", None, None, 0)], provenance.DECLARED)
    found = provenance.Resolution(root.unionByName(declared))
    assert {(r["name"], r["url"]) for r in found.sources.collect()} == {("a", "http://a"), ("b", "http://b"), ("c", "http://c")}
    assert [(r["name"], r["parent"], r["url"], r["taken_url"]) for r in found.conflicts().collect()] == [("c", "b", "http://other", "http://c")]
    assert {tuple(r) for r in found.cycles().collect()} == {("a", "a"), ("b", "a")}
    assert {tuple(r) for r in found.required_by.collect()} == {("b", "a"), ("c", "a"), ("c", "b"), ("a", "b")}


def test_schemas_that_refer_to_others(spark):
    from tessera.functions import jsonschema

    person = {"$id": "http://s/person", "type": "object", "properties": {"home": {"$ref": "address.json#/$defs/place"}, "pets": {"items": {"$ref": "#pet"}}}, "$defs": {"p": {"$anchor": "pet", "required": ["name"]}}}
    address = {"$defs": {"place": {"required": ["city"], "properties": {"near": {"$ref": "http://s/person"}}}}}
    others = {"http://s/address.json": address}
    assert jsonschema.errors({"home": {"city": 1, "near": {"home": {}}}, "pets": [{}]}, person, "schemas/person.json", others) == [("/home/near/home", "required", "city is required"), ("/pets/0", "required", "name is required")]
    assert [e[:2] for e in jsonschema.errors({"home": 1}, person, "schemas/person.json")] == [("/home", "$ref")]
    assert [e[1] for e in jsonschema.errors(1, {"anyOf": [{"$ref": "#"}, {"$ref": "#"}]})] == ["$ref"]
    closed = {"allOf": [{"properties": {"a": True}}, {"if": {"required": ["b"]}, "then": {"properties": {"b": True}}}], "properties": {"c": True}, "unevaluatedProperties": False}
    assert jsonschema.errors({"a": 1, "b": 2, "c": 3}, closed) == [] and [e[1:] for e in jsonschema.errors({"a": 1, "d": 2}, closed)] == [("unevaluatedProperties", "d is not allowed")]
    assert [e[1] for e in jsonschema.errors([1, "x", 2], {"prefixItems": [True], "contains": {"type": "string"}, "unevaluatedItems": False})] == ["unevaluatedItems"]
    assert [e[0] for e in jsonschema.errors({"a": 1}, {"dependentSchemas": {"a": {"required": ["b"]}}})] == [""]
    page = "---\njsonSchema: schemas/one.json\nname: x\nplace: {}\n---\n"
    schemas = [("schemas/one.json", '{"properties": {"place": {"$ref": "two.json"}, "name": {"$ref": "gone.json"}}}'), ("schemas/two.json", '{"$ref": "http://s/three"}'), ("schemas/3.json", '{"$id": "http://s/three", "required": ["city"]}'), ("broken.json", "{")]
    files = spark.createDataFrame([("p.md", page)], "path string, text string")
    found = audits.schema_issues(files, spark.createDataFrame(schemas, "path string, text string"), corpus.Config()).collect()
    assert sorted(r["message"] for r in found) == ["/name $ref: gone.json leads nowhere (schemas/one.json)", "/place required: city is required (schemas/one.json)"]


def test_a_corpus_with_sources_shapes_and_fixes(spark, tmp_path):
    from tessera.corpus import Corpus

    main, other = tmp_path / "main", tmp_path / "dep (1)"
    main.mkdir()
    other.mkdir()
    (main / "Ann_Lee.md").write_text("---\ntype: Person\n---\n# Ann Lee\n\n## Early years\n\nSee [[Ann_Lee#Early yeers]] and [[bob_smit]].\n")
    (main / "bob_smith.md").write_text("---\ntype: Person\ngivenName: Bob\n---\n# Bob Smith\n\nKnows Ann Lee, and again Ann Lee.\n")
    (main / "shape.ttl").write_text("@prefix sh: <http://www.w3.org/ns/shacl#> . @prefix schema: <https://schema.org/> . schema:P a sh:NodeShape ; sh:targetClass schema:Person ; sh:property [ sh:path schema:givenName ; sh:minCount 1 ] .")
    (other / "carl.md").write_text("---\ntype: Person\ngivenName: Carl\n---\n")
    c = Corpus.load(spark, str(main), sources={"de p": str(other)})
    assert {r["g"].rpartition("graphs/")[2] for r in c.graphs().collect()} == {"root", "source/de%20p"}
    assert c.query("SELECT ?s WHERE { ?s a schema:Person }").df.count() == 3
    assert c.query("SELECT ?s WHERE { GRAPH ?g { ?s a schema:Person } FILTER(CONTAINS(STR(?g), 'source')) }").df.count() == 1
    assert [(r["g"], r["component"]) for r in c.shacl_documents().collect()] == [("Ann_Lee", "minCount")]
    assert c.inconsistencies().collect() == []
    assert [r["text"].rpartition("See ")[2] for r in c.fixed().collect()] == ["[[Ann_Lee#early-years]] and [[bob_smith]].\n"]
    found = c.suggestions().collect()
    assert found == sorted(found, key=lambda r: (r["source_route"], r["line"], r["column"])) and found


def test_names(spark):
    from tessera.functions import names

    df = spark.createDataFrame([("John Smith! & Co.",), ("",), ("some--double--dashes",), (None,)], "x string")
    assert [r[0] for r in df.select(names.kebab_case(F.col("x"))).collect()] == ["john-smith--co", "", "some-double-dashes", None]


def test_severities_of_checks_and_lints_differ(tmp_path):
    from tessera.sources import config

    (tmp_path / "wiki.yml").write_text("check: {broken_links: error}\nlint: {broken_links: false}\n")
    found = config.load(str(tmp_path))
    assert (found.check_severities, found.lint_severities) == ({"broken_links": "error"}, {"broken_links": "off"})
