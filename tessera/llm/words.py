"""Words as runs of letters and digits: A-Z lower-cased, every other character below 128 a separator, all characters from 128 on part of a word."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a byte of a UTF-8 text becomes: separators are spaces, so that split() gives the words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.
BYTES = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in bytes(range(256)).lower())
#: Bytes of a text whose words are listed at a time.
STEP = 1 << 20


def keyed_bytes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text) alone, the text as UTF-8 bytes; a null text counts as empty."""
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))


def word_lists(text: bytes) -> Iterator[list[bytes]]:
    """The words of a whole text, in lists of a bounded size, cut between words only."""
    text = text.translate(BYTES)
    at = 0
    while at < len(text):
        end = text.find(b" ", at + STEP)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end
