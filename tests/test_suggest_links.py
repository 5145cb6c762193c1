"""Suggested links are the same however many aliases there are."""

from tessera.operators import documents


def test_both_branches_agree(spark):
    text = "Use the .NET Runtime here, a (draft) plan, the $100 laptop, data lake and -- ** -- too.\nA Données Ouvertes page; foo.net runtime"
    files = spark.createDataFrame([("a.md", text), ("b.md", "Nothing of this, but a data lake.\n"), ("c.md", "")], "path string, text string")
    names = [".net runtime", "(draft) plan", "$100 laptop", "data lake", "-- ** --", "données ouvertes", "absent page"]
    table = spark.createDataFrame([(n, f"to/{i}") for i, n in enumerate(names)], "alias string, route string")
    few, many = (sorted(map(tuple, documents.suggest_links(files, table, **most).collect())) for most in ({}, {"most": 0}))
    assert few == many
    assert {r[1].lower() for r in few} == set(names) - {"absent page"}
