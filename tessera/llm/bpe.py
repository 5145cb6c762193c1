"""Byte-level BPE of whole texts, and back, by tree concatenation.

A text of more than ``leaf_chars`` characters is halved until its parts are short. The parts are encoded on their
own, texts of more than ``spread_chars`` in separate tasks, and joined pairwise up the tree. At a join a window
around the cut is encoded again and grows until both sides agree:

* The tokenizer's pattern scans from left to right and depends on nothing before its position. So all chunks of
  the left part but its last are right, and once a chunk of the window ends where a chunk of the right part ends,
  all later ones are right.
* A chunk that itself is long (no white space) is cut into parts too. Two neighbouring tokens are what the merges
  make of their bytes; a sequence whose neighbours all are is what the merges make of the whole. So a window whose
  first and last tokens come out as they were is joined exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, keyed_text
from .tokens import SEPARATORS, Encoder, Merger, encoder, merger

LEAF_CHARS = 16_384
SPREAD_CHARS = 65_536
#: A chunk of more bytes is encoded in parts.
CHUNK_BYTES = 2_048

Chunked = tuple[list[str], list[bytes]]


class TreeEncoder:
    """Encodes with the library, joins parts exactly; ``joins`` and ``grown`` count joins and enlarged windows."""

    def __init__(self, path: str, leaf_chars: int = LEAF_CHARS, chunk_bytes: int = CHUNK_BYTES) -> None:
        self.library: Encoder = encoder(path)
        self.merges: Merger = merger(path)
        if self.library.mode != "byte_level":
            raise ValueError("tree concatenation needs a byte-level tokenizer that splits by its own pattern")
        self.leaf_chars, self.chunk_bytes = leaf_chars, chunk_bytes
        self.specials = [t.content for t in self.library.tokenizer.get_added_tokens_decoder().values()]
        self.joins = self.grown = 0

    def leaf(self, text: str) -> Chunked:
        """Chunks of a part and their ids."""
        chunks = self.library.chunks(text)
        if len(text.encode()) <= self.chunk_bytes or max(map(len, chunks)) * 4 <= self.chunk_bytes:
            return chunks, self.library.lookup(chunks)
        return chunks, [self.chunk(c) for c in chunks]

    def chunk(self, text: str) -> bytes:
        """Ids of one chunk, which the pattern may still split; a long unsplit stretch goes by halves."""
        data = text.encode()
        if len(data) <= self.chunk_bytes or len(self.library.tokenizer.pre_tokenizer.pre_tokenize_str(text)) > 1:
            return self.library.lookup([text])[0]
        return np.array(self.unsplit(data), dtype="<u4").tobytes()

    def unsplit(self, data: bytes) -> list[int]:
        """Ids of bytes that the pattern keeps together."""
        if len(data) <= self.chunk_bytes:
            return self.merges.ids(data)
        half = len(data) // 2
        return self.join_ids(self.unsplit(data[:half]), self.unsplit(data[half:]))

    def join_ids(self, left: list[int], right: list[int]) -> list[int]:
        if not left or not right:
            return left + right
        self.joins += 1
        pieces, width = self.merges.pieces, 8
        while True:
            a, b = left[-width:], right[:width]
            window = self.merges.ids(b"".join(map(pieces.__getitem__, a + b)))
            whole_left, whole_right = len(a) == len(left), len(b) == len(right)
            if (whole_left or window[0] == a[0]) and (whole_right or window[-1] == b[-1]):
                return left[: len(left) - len(a)] + window + right[len(b) :]
            width *= 2
            self.grown += 1

    def join(self, left: Chunked, right: Chunked) -> Chunked:
        """Two neighbouring parts as one."""
        (a, x), (b, y) = left, right
        if not a or not b:
            return a + b, x + y
        self.joins += 1
        keep, width = len(a) - 1, 1
        # White space at the end of the left part may belong to what follows, as may the chunk before it.
        while keep and not a[keep].strip():
            keep -= 1
        while True:
            window = "".join(a[keep:]) + "".join(b[:width])
            chunks = self.library.chunks(window)
            if width >= len(b) or (len(chunks) > 1 and chunks[-1] == b[width - 1] and chunks[-1].strip()):
                break
            width *= 2
            self.grown += 1
        done = {a[keep]: x[keep], b[min(width, len(b)) - 1]: y[min(width, len(b)) - 1]}
        ids = [done[c] if c in done else self.merged(c, a, x, b, y) for c in chunks]
        return a[:keep] + chunks + b[width:], x[:keep] + ids + y[width:]

    def merged(self, chunk: str, a: list[str], x: list[bytes], b: list[str], y: list[bytes]) -> bytes:
        """Ids of a chunk that lies across the cut: token windows if it is long and unsplit, else the library's."""
        if chunk == a[-1] + b[0] and len(chunk.encode()) > self.chunk_bytes and len(self.library.tokenizer.pre_tokenizer.pre_tokenize_str(chunk)) == 1:
            return np.array(self.join_ids(np.frombuffer(x[-1], "<u4").tolist(), np.frombuffer(y[0], "<u4").tolist()), dtype="<u4").tobytes()
        return self.chunk(chunk)

    def whole(self, text: str) -> bool:
        """Texts with special tokens or odd separators are left to the library as they are."""
        return any(s in text for s in self.specials) or any(c in text for c in SEPARATORS)

    def tree(self, text: str) -> Chunked:
        if len(text) <= self.leaf_chars:
            return self.leaf(text)
        half = len(text) // 2
        return self.join(self.tree(text[:half]), self.tree(text[half:]))

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if self.whole(text):
            return self.library._library([text])[0]
        if len(text) <= self.leaf_chars:
            return b"".join(self.leaf(text)[1])
        return b"".join(self.tree(text)[1])


@lru_cache(maxsize=4)
def tree_encoder(path: str) -> TreeEncoder:
    return TreeEncoder(path)


Finish = Callable[[np.ndarray, str], tuple]


def ids_and_text(ids: np.ndarray, decoded: str) -> tuple:
    return ids.astype("i8").tolist(), decoded


def roundtrip(docs: DataFrame, tokenizer_path: str, finish: Finish = ids_and_text, columns: str = "ids array<long>, decoded string", *, id_col: str = "doc_id", text_col: str = "text", spread_chars: int = SPREAD_CHARS) -> DataFrame:
    """Every whole text encoded and decoded: doc_id and what ``finish(ids, decoded)`` gives, by default both.

    ``finish`` runs where the ids are, so that an operator that needs a digest alone moves no ids. Null and empty
    texts have no ids. Repeated rows give repeated results; an empty table gives none; other columns are left aside.
    """
    schema = f"doc_id long, {columns}"

    def done(doc_id: int, data: bytes) -> tuple:
        ids = np.frombuffer(data, "<u4")
        return (doc_id, *finish(ids, merger(tokenizer_path).decode(ids.tolist())))

    def short(rows: Iterator[tuple]) -> Iterator[tuple]:
        encode = tree_encoder(tokenizer_path).encode
        for doc_id, text in rows:
            yield done(doc_id, encode(text))

    texts = keyed_text(docs, id_col, text_col)
    near = arrow_rows(texts.where(F.length("text") <= spread_chars), schema, short)

    # A long text is known by its digests, so that a task that runs again cuts the same parts; copies of one are encoded once.
    tall = texts.where(F.length("text") > spread_chars).select("doc_id", F.xxhash64("text").alias("k"), F.xxhash64(F.lit(1), "text").alias("l"), "text")

    def cut(rows: Iterator[tuple]) -> Iterator[tuple]:
        for k, l, text in rows:
            for n, at in enumerate(range(0, len(text), spread_chars)):
                yield k, l, n, text[at : at + spread_chars]

    leaves = arrow_rows(tall.select("k", "l", "text"), "k long, l long, n int, text string", cut, text_at=2).dropDuplicates(["k", "l", "n"])

    def encoded(rows: Iterator[tuple]) -> Iterator[tuple]:
        tree = tree_encoder(tokenizer_path)
        for k, l, n, text in rows:
            chunks, ids = ([text], [b""]) if tree.whole(text) else tree.tree(text)
            ends = np.cumsum([len(c) for c in chunks], dtype="<i8").tobytes()
            counts = np.array([len(i) for i in ids], dtype="<i8").tobytes()
            yield k, l, n, text, ends, counts, b"".join(ids)

    def joined(frame: pd.DataFrame) -> pd.DataFrame:
        tree = tree_encoder(tokenizer_path)
        frame = frame.sort_values("n")
        key = frame["k"].iloc[0], frame["l"].iloc[0]
        whole = "".join(frame["text"])
        if tree.whole(whole):
            return pd.DataFrame([(*key, *done(0, tree.encode(whole))[1:])], columns=names)
        level = []
        for text, ends, counts, data in zip(frame["text"], frame["ends"], frame["counts"], frame["ids"], strict=True):
            stops = np.frombuffer(ends, "<i8").tolist()
            cuts = np.cumsum(np.frombuffer(counts, "<i8")).tolist()
            level.append(([text[a:b] for a, b in zip([0, *stops], stops, strict=False)], [data[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]))
        while len(level) > 1:
            level = [tree.join(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return pd.DataFrame([(*key, *done(0, b"".join(level[0][1]))[1:])], columns=names)

    names = ["k", "l", *(f.name for f in near.schema.fields[1:])]
    parts = arrow_rows(leaves, "k long, l long, n int, text string, ends binary, counts binary, ids binary", encoded, text_at=3)
    whole_texts = parts.groupBy("k", "l").applyInPandas(joined, f"k long, l long, {columns}")
    return near.unionByName(tall.select("doc_id", "k", "l").join(whole_texts, ["k", "l"]).drop("k", "l"))


def digests(ids: np.ndarray, decoded: str) -> tuple:
    """(n_tokens, ids_sha256, decoded_sha256) of one text."""
    listed = ",".join(map(str, ids.tolist())).encode()
    return len(ids), hashlib.sha256(listed).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()
