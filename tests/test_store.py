"""The quad store's layout and statistics, and joins of solutions that leave variables unbound."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessera.plans import bindings
from tessera.plans.algebra import TYPE, Iri, Var
from tessera.plans.bindings import IRI, Rel, replace
from tessera.plans.compiler import Compiler
from tessera.sources import quads

E = "http://e/"


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    n = spark.range(5_000)
    row = lambda df, s, p, o, g="a": df.select(F.lit(E + g).alias("g"), F.concat(F.lit(E), s).alias("s"), F.lit("iri").alias("s_kind"), F.lit(p).alias("p"), F.concat(F.lit(E), o).alias("o"), F.lit("iri").alias("o_kind"), F.lit("").alias("o_dt"), F.lit("").alias("o_lang"))
    name = F.concat(F.lit("x"), "id")
    data = row(n, name, TYPE, F.lit("C")).unionByName(row(n, F.lit("hub"), E + "has", name)).unionByName(row(n.where("id < 5"), name, E + "rare", F.lit("R")))
    data = data.unionByName(data.where(F.col("p") == TYPE).limit(10)).unionByName(row(n.where("id < 3"), name, E + "rare", F.lit("R"), "b"))
    path = str(tmp_path_factory.mktemp("store") / "quads")
    quads.write(data, path, rows_per_file=1_000)
    return path


def test_large_predicates_are_split_and_rows_stand_once(spark, store):
    files = lambda part: len(list(Path(store).glob(f"p=*{part}/*.parquet")))
    assert files("type") >= 4 and files("has") >= 4 and files("rare") <= 2
    assert quads.read(spark, store).count() == 10_008
    found = {r["p"].rpartition("/")[2].rpartition("#")[2]: (r["rows"], r["repeated"]) for r in spark.read.parquet(store + quads.STATISTICS).collect()}
    assert found == {"type": (5_000, False), "has": (5_000, False), "rare": (8, True)}


def test_patterns_need_no_distinct_and_begin_with_the_rarest(spark, store, monkeypatch):
    source = quads.opened(spark, store)
    plan = source.star(Var("x"), [(Iri(TYPE), Iri(E + "C"))], None).df._jdf.queryExecution().toString()
    assert "Aggregate" not in plan and "Exchange" not in plan
    assert "Aggregate" in source.star(Var("x"), [(Iri(E + "rare"), Var("y"))], None).df._jdf.queryExecution().toString()
    asked = []
    star = quads.Quads.star
    monkeypatch.setattr(quads.Quads, "star", lambda self, s, pairs, *rest: asked.append(pairs[0][0].value) or star(self, s, pairs, *rest))
    got = Compiler(spark, source, {"e": E}).query("SELECT ?h ?x ?y WHERE { ?h e:has ?x . ?x e:rare ?y }").df
    assert asked == [E + "rare", E + "has"] and got.count() == 5


def rel(spark, rng, variables, maybe):
    rows = [tuple(rng.choice([None, "p", "q"]) if v in maybe else rng.choice("pqr") for v in variables) for _ in range(7)]
    df = spark.createDataFrame(rows, ", ".join(f"v_{v} string" for v in variables))
    return Rel(df, {v: replace(IRI, maybe=v in maybe) for v in variables}), [{v: x for v, x in zip(variables, r, strict=True) if x is not None} for r in rows]


def plain(found, variables):
    return sorted(tuple(sorted((v, r[f"v_{v}"]) for v in variables if f"v_{v}" in r and r[f"v_{v}"] is not None)) for r in (x.asDict() for x in found.df.collect()))


@pytest.mark.parametrize("seed", range(6))
def test_joins_of_unbound_variables(spark, seed):
    rng = random.Random(seed)
    maybe_a, maybe_b = rng.sample("abc", rng.choice([0, 1, 2])), rng.sample("abc", rng.choice([0, 1, 2]))
    a, left = rel(spark, rng, "abcx", set(maybe_a))
    b, right = rel(spark, rng, "abcy", set(maybe_b))
    fits = lambda r, s: all(r[v] == s[v] for v in r.keys() & s.keys())
    show = lambda rows: sorted(tuple(sorted(r.items())) for r in rows)
    both = [r | s for r in left for s in right if fits(r, s)]
    assert plain(bindings.join(a, b), "abcxy") == show(both)
    assert plain(bindings.join(a, b, "left"), "abcxy") == show(both + [r for r in left if not any(fits(r, s) for s in right)])
    assert plain(bindings.half_join(a, b, "left_semi"), "abcx") == show(r for r in left if any(fits(r, s) for s in right))
    assert plain(bindings.half_join(a, b, "left_anti"), "abcx") == show(r for r in left if not any(fits(r, s) for s in right))
    minus = [r for r in left if not any(fits(r, s) and r.keys() & s.keys() for s in right)]
    assert plain(bindings.half_join(a, b, "left_anti", need_shared=True), "abcx") == show(minus)
    if maybe_a or maybe_b:
        assert "NestedLoop" not in bindings.half_join(a, b, "left_anti", need_shared=True).df._jdf.queryExecution().toString()
