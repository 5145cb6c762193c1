"""Licence scans of real licence texts, wrapped headers and tags."""

import textwrap
from pathlib import Path

import pytest

from tessera.llm import licenses

LOCAL = Path("/usr/share/common-licenses")
WHOLE = {name: text for name, text in licenses.TEMPLATES if len(text) > 700}


def found(spark, files):
    rows = licenses.scan(spark.createDataFrame(files, "doc_id long, path string, text string")).collect()
    assert len(rows) == len(files)
    return rows


def laid_out(text, holder="2024 Jane Roe, Example Works"):
    """A licence's text as it stands in files: the holder named, lines wrapped, clauses and paragraphs apart."""
    text = text.replace("Copyright (c)", f"Copyright (c) {holder}\n\n")
    for start in ("Redistribution and use", "Permission", "The above copyright", "THE SOFTWARE", "THIS SOFTWARE", "1. ", "2. ", "3. "):
        text = text.replace(f" {start}", f"\n\n{start}")
    return "\n\n".join(textwrap.fill(p, 75) for p in text.split("\n\n"))


def test_whole_licence_files(spark):
    texts = {n: t for n, t in WHOLE.items() if n != "Apache-2.0"}
    assert {"MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC"} <= texts.keys()
    rows = found(spark, [(i, f"{n}/LICENSE", laid_out(t)) for i, (n, t) in enumerate(texts.items())])
    assert {r["path"]: r["license"] for r in rows} == {f"{n}/LICENSE": n for n in texts}
    assert all(r["cosine"] >= 0.9 and r["origin"] == "own" for r in rows)


@pytest.mark.skipif(not LOCAL.is_dir(), reason="no licence texts on this machine")
def test_licence_texts_of_the_system(spark):
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "BSD": "BSD-3-Clause"}
    files = [(i, f"{n}/COPYING", (LOCAL / n).read_text()) for i, n in enumerate(names)]
    got = {r["path"]: r["license"] for r in found(spark, files)}
    assert got == {f"{n}/COPYING": want for n, want in names.items()}


HEADERS = {t[1].split(" ")[0] + str(i): t for i, t in enumerate(licenses.TEMPLATES) if 100 < len(t[1]) and not t[1].startswith("ISC License")}


def test_wrapped_comment_headers(spark):
    marks = {"#": "# {}", "//": "// {}", "*": " * {}", ";": ";; {}", "--": "-- {}"}
    files, want = [], {}
    for i, (name, text) in enumerate(HEADERS.values()):
        for k, (_, mark) in enumerate(marks.items()):
            doc_id = 10 * i + k
            body = "\n".join(mark.format(line).rstrip() for line in textwrap.wrap(text, 70))
            files.append((doc_id, f"src/{doc_id}.x", f"#!/bin/sh\n\n{body}\n\ncode = 1\nmore(code)\n"))
            want[doc_id] = name
    got = {r["doc_id"]: r["license"] for r in found(spark, files)}
    assert got == want


def test_tags(spark):
    names = ["MIT", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-3.0", "AGPL-3.0", "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "Unlicense"]
    files = [(i, f"{i}.c", f"// SPDX-License-Identifier: {n}\nint main() {{}}\n") for i, n in enumerate(names)] + [(99, "99.c", "// SPDX-License-Identifier: Frob-7.1\nint x;")]
    got = {r["doc_id"]: (r["license"], r["origin"]) for r in found(spark, files)}
    assert got == {i: (n, "own") for i, n in enumerate(names)} | {99: (None, "none")}


def test_rows_that_share_an_id_or_have_none(spark):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    files = [(1, "a/x.py", mit), (1, "b/y.py", f"x = 1\n# {apache}"), (None, "c/z.py", f"# {mit}"), (None, "d/w.py", "no"), (1, "a/x.py", mit)]
    got = sorted((r["path"], r["license"], r["origin"]) for r in found(spark, files))
    assert got == [("a/x.py", "MIT", "own")] * 2 + [("b/y.py", "Apache-2.0", "own"), ("c/z.py", "MIT", "own"), ("d/w.py", None, "none")]


def test_a_very_long_text(spark):
    text = "word after word goes on\n" * 200_000 + "Released under the MIT License.\n" + "and on\n" * 1_000
    assert [r["license"] for r in found(spark, [(1, "x.txt", text)])] == ["MIT"]
