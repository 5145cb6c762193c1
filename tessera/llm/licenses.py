"""Licence scan by sparse TF-IDF cosine, then inheritance from the nearest directory above that has a licence.

Only DataFrame and SQL functions. Units of a file are its lines that speak of licences, without comment marks, its
paragraphs of several lines that do (between blank lines, or where comments begin or end), blocks of adjacent commented lines that do (a wrapped header), and, of a licence file,
the whole text. Units and templates are vectors of term counts times inverse document frequencies over the templates, which are
a fixed, small table: notices, standard headers, SPDX tags, titles, and whole texts where these are short. A long licence
is known by its title and by the notice that it ends with.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed

#: A unit has the licence of the nearest template from this cosine on.
LEAST_COSINE = 0.8
#: A line is a unit if it matches.
MENTIONS = r"(?i)licen[cs]e|copyright|redistribut|public domain|permission is hereby granted|permission to use, copy|creative commons|cc0"
#: What marks a line as a comment.
COMMENT = r"^[ \t]*(?:#+|//+!?|/\*+|\*+/?|;+|--+|%+|<!--+|[Rr][Ee][Mm] )[ \t]*"
TERM = r"[a-z0-9]+(?:\.[0-9]+)*"
LICENSE_FILE = r"(?i)^(?:licen[cs]e|copying|copyright|unlicense|notice)(?:[._-].*)?$"

# Notices by which the licences ask to be referred to, and opening clauses of their texts.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License - see the LICENSE file for details."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    # Further notices and headers.
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    # Titles of licences' texts.
    ("MIT", "The MIT License (MIT)"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International Public License"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International Public License"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International Public License"),
    ("CC0-1.0", "CC0 1.0 Universal"),
    # Whole texts.
    ("MIT", "MIT License Copyright (c) Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("BSD-2-Clause", "Copyright (c) All rights reserved. Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-3-Clause", "Copyright (c) All rights reserved. Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("ISC", "ISC License Copyright (c) Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
) + tuple((name, f"SPDX-License-Identifier: {name}") for name in ("MIT", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-2.0", "EPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC0-1.0", "Unlicense"))


def weights(templates: tuple[tuple[str, str], ...] = TEMPLATES) -> tuple[dict[str, float], float, list[tuple[str, int, str, float]]]:
    """Inverse document frequency of each term, that of unknown terms, and (term, template, licence, weight) at length one."""
    counts = [Counter(re.findall(TERM, text.lower())) for _, text in templates]
    df = Counter(term for c in counts for term in c)
    idf = {term: math.log((1 + len(templates)) / (1 + n)) + 1 for term, n in df.items()}
    rows = []
    for n, ((licence, _), c) in enumerate(zip(templates, counts, strict=True)):
        length = math.sqrt(sum((k * idf[t]) ** 2 for t, k in c.items()))
        rows += [(t, n, licence, k * idf[t] / length) for t, k in sorted(c.items())]
    return idf, math.log(1 + len(templates)) + 1, rows


def units(text: Column, whole: Column) -> Column:
    """The units of a text, an array: the whole of a licence file, then lines, paragraphs of lines, and blocks of comments that speak of licences."""
    lines = F.split(text, "\n")
    before = F.slice(F.concat(F.array(F.lit(None).cast("string")), lines), F.lit(1), F.size(lines))
    commented = lambda x: x.rlike(COMMENT)
    # Where comments begin or end, \x01 stands for the line's end; a comment's own first line is marked by \x02.
    joined = F.array_join(
        F.zip_with(
            lines,
            before,
            lambda x, p: F.concat(
                F.when(p.isNull(), "").when(commented(x) == commented(p), "\n").otherwise("\x01"),
                F.when(commented(x) & ~F.coalesce(commented(p), F.lit(False)), "\x02").otherwise(""),
                F.regexp_replace(x, COMMENT, ""),
            ),
        ),
        "",
    )
    speaks = lambda x: x.rlike(MENTIONS)
    several = lambda x: x.contains("\n")
    single = F.filter(F.transform(lines, lambda x: F.regexp_replace(x, COMMENT, "")), speaks)
    # A text without a break is no paragraph: that would be the whole text of a file that is no licence.
    paragraphs = F.filter(F.split(joined, r"\x01|\n[ \t]*\n"), lambda x: speaks(x) & several(x) & (x != joined))
    blocks = F.filter(F.split(joined, "\x01"), lambda x: x.startswith("\x02") & speaks(x) & several(x))
    return F.when(speaks(text) | whole, F.concat(F.when(whole, F.array(text)).otherwise(F.array().cast("array<string>")), single, paragraphs, blocks)).otherwise(F.array().cast("array<string>"))


def matches(found: DataFrame, spark: SparkSession, templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = LEAST_COSINE) -> DataFrame:
    """(file, license, cosine) of (file, units): each file's best unit against its best template, ties to the first unit and template."""
    idf, unknown, rows = weights(templates)
    # Both tables are as small as the templates.
    frequencies = spark.createDataFrame([(t, float(w)) for t, w in idf.items()] or [("", 0.0)], "term string, idf double").coalesce(1)
    vectors = spark.createDataFrame(rows, "term string, template int, license string, weight double").coalesce(1)
    bodies = found.where(F.size("units") > 0).select("file", F.posexplode("units").alias("unit", "body"))
    terms = bodies.select("file", "unit", F.explode(F.regexp_extract_all(F.lower("body"), F.lit(TERM), F.lit(0))).alias("term"))
    counts = terms.groupBy("file", "unit", "term").agg(F.count(F.lit(1)).alias("tf"))
    weighed = counts.join(F.broadcast(frequencies), "term", "left").select("file", "unit", "term", (F.col("tf") * F.coalesce("idf", F.lit(unknown))).alias("w"))
    # A unit's length stands in a row of its own, so that its terms are weighed and added up once.
    length = weighed.select("file", "unit", F.lit(-1).alias("template"), F.lit(None).cast("string").alias("license"), (F.col("w") * F.col("w")).alias("part"))
    dot = weighed.join(F.broadcast(vectors), "term").select("file", "unit", "template", "license", (F.col("w") * F.col("weight")).alias("part"))
    sums = dot.unionByName(length).groupBy("file", "unit", "template", "license").agg(F.sum("part").alias("part"))
    each = sums.groupBy("file", "unit").agg(F.sqrt(F.max(F.when(F.col("template") < 0, F.col("part")))).alias("length"), F.collect_list(F.when(F.col("template") >= 0, F.struct("template", "license", "part"))).alias("dots"))
    scored = each.select("file", "unit", "length", F.explode("dots").alias("d")).select("file", "unit", "d.template", "d.license", F.round(F.col("d.part") / F.col("length"), 6).alias("cosine")).where(F.col("cosine") >= least)
    best = F.max_by(F.struct("license", "cosine"), F.struct("cosine", -F.col("unit"), -F.col("template")))
    return scored.groupBy("file").agg(best.alias("best")).select("file", "best.license", "best.cosine")


def parent(path: Column) -> Column:
    """The directory of a path: all before its last slash, the empty string at the top."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def scan(files: DataFrame, *, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", license_file: Column | None = None, grants: Column | None = None, templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = LEAST_COSINE) -> DataFrame:
    """(doc_id, path, license, cosine, origin, from_dir) of every file.

    ``origin`` is 'own' for a licence found in the file, 'inherited' for that of the nearest directory at or above
    the file's that has a licence file with a match (of several, the one with the highest cosine, then the first
    by path), else 'none'. ``license_file`` says which files are licence files; by default their names do.
    ``grants`` says which files' matches hold for their directory; by default those of licence files. A null
    text is empty, a null path is the top, a null id is an id like any other; a row is known by id, path and text, so rows that
    share an id are scanned by themselves, and equal rows give equal results. An empty table gives no rows;
    other columns are left aside. Directories are resolved once each, so a full directory is no hot key.
    Texts are read once: what is kept of them is their units.
    """
    named = F.regexp_extract(F.coalesce(F.col(path_col), F.lit("")), r"[^/]*$", 0).rlike(LICENSE_FILE) if license_file is None else license_file
    own = files.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(path_col), F.lit("")).alias("path"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(named, F.lit(False)).alias("whole"), F.coalesce(named if grants is None else grants, F.lit(False)).alias("grants"))
    row = F.struct(F.xxhash64("doc_id", "path", "text").alias("a"), F.xxhash64("text", "path", "doc_id").alias("b"))
    narrow = checkpointed(own.select("doc_id", "path", "grants", row.alias("file"), units(F.col("text"), F.col("whole")).alias("units")))
    found = matches(narrow.select("file", "units").where(F.size("units") > 0), files.sparkSession, templates, least)
    known = checkpointed(narrow.select("doc_id", "file", "path", "grants", parent(F.col("path")).alias("dir")).join(found, "file", "left").drop("file"))
    licensed = (
        known.where(F.col("grants") & F.col("license").isNotNull())
        .groupBy("dir")
        .agg(F.max("cosine").alias("cosine"), F.min_by("license", F.struct(-F.col("cosine"), F.col("path"), F.col("license"))).alias("license"))
    )
    steps = F.split("dir", "/")
    above = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/")))
    places = known.select("dir").distinct().select("dir", F.explode(F.array_distinct(above)).alias("up"))
    nearest = (
        places.join(licensed.withColumnRenamed("dir", "up"), "up")
        .groupBy("dir")
        .agg(F.max_by(F.struct("up", F.col("license").alias("from_license"), F.col("cosine").alias("from_cosine")), F.length("up")).alias("n"))
        .select("dir", "n.up", "n.from_license", "n.from_cosine")
    )
    origin = F.when(F.col("license").isNotNull(), "own").when(F.col("from_license").isNotNull(), "inherited").otherwise("none")
    return known.join(nearest, "dir", "left").select(
        "doc_id",
        "path",
        F.coalesce("license", "from_license").alias("license"),
        F.coalesce("cosine", "from_cosine").alias("cosine"),
        origin.alias("origin"),
        F.when(origin == "inherited", F.col("up")).alias("from_dir"),
    )
