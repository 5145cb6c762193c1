"""SHACL and dependency queries see every order and part, also where the registered SQL looks at the first ones only."""

import duckdb
import pytest

from tessera.queries import all_queries

SF = "/root/testdata/sf0.01"
QUERIES, ORACLES = all_queries()


@pytest.mark.parametrize("name", ["shacl_mincount", "shacl_maxcount", "shacl_datatype", "shacl_range_pattern_in", "shacl_logic"])
def test_every_order_is_validated(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{SF}/orders.parquet'")
    cursor = con.execute(ORACLES[name].replace("o_orderkey < 4000", "true"))
    columns = [d[0] for d in cursor.description]
    want = sorted(map(repr, cursor.fetchall()))
    assert sorted(map(repr, map(tuple, QUERIES[name](spark, SF).select(*columns).collect()))) == want


def parts(spark):
    return [r[0] for r in spark.read.parquet(f"{SF}/part.parquet").select("p_partkey").collect() if r[0] > 0]


def above(k):
    """All that k needs, by k // 3 again and again."""
    out = set()
    while k > 0:
        k //= 3
        out.add(k)
    return out


def test_closure_of_every_part(spark):
    want = {(k, y) for k in parts(spark) for y in above(k)}
    assert {tuple(r) for r in QUERIES["dependency_closure"](spark, SF).select("x", "y").collect()} == want and len({x for x, _ in want}) > 1000


def test_cycles_and_orphans_of_every_part(spark):
    assert {r["x"] for r in QUERIES["dependency_cycles"](spark, SF).collect()} == {7, 65, 21}
    reached = {150, 77} | above(150) | above(77)
    assert {r["x"] for r in QUERIES["orphans"](spark, SF).collect()} == ({0} | set(parts(spark))) - reached
