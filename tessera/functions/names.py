"""Names for addresses, as column functions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented Latin letters and the plain ones that stand for them, by their decompositions.
ACCENTED, PLAIN = map("".join, zip(*((c, d) for c in map(chr, range(0xC0, 0x250)) if len(d := "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))) == 1 and d != c), strict=True))


def without_accents(text: Column) -> Column:
    return F.regexp_replace(F.translate(text, ACCENTED, PLAIN), r"\p{Mn}", "")


def kebab_case(text: Column) -> Column:
    """Lower case, runs of white space and hyphens as one hyphen, of all else only a-z and 0-9."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(text.cast("string")), r"^\s+|\s+$", ""), r"[\s-]+", "-"), "[^a-z0-9-]", "")


def without_code(text: Column) -> Column:
    """Text without its inline code spans."""
    return F.regexp_replace(text, r"`[^`\n]*`", "")


def percent_encoded(text: Column) -> Column:
    """Every character but letters, digits and ``_.-~`` percent-encoded."""
    return F.replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def source_graph(name: Column, base: str) -> Column:
    """The IRI of a source's named graph; the root's without a name."""
    head = base.rstrip("/") + "/graphs/"
    return F.when(name.isNull(), head + "root").otherwise(F.concat(F.lit(head + "source/"), percent_encoded(name)))
