"""Benchmark passages in documents: a prefix-filtered join of item windows with document windows of their size.

A window is ``window`` consecutive words of a benchmark item, or a shorter item whole. As a set its elements are shingles of ``shingle``
words. A document holds a window only if it holds all of its shingles, so with shingles in one order, the first of them alone is a necessary
prefix. The order is by rarity: one pass over all documents counts every benchmark shingle. The second pass joins the prefix
shingles; where one stands, its place in the window says where the window would begin, which must lie inside the document with
room for the window's length (the bounds on place and length). What passes is verified word by word.

Words are numbered by the benchmark's vocabulary, and pairs and triples by those that occur in it, so equal numbers are equal
words: nothing is hashed. An index holds some ``block_words`` benchmark words. A larger benchmark is dealt into blocks, each searched in
all documents, and the blocks' findings of a document are merged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, arrow_schema, checkpointed, gathered, slices, written
from .words import keyed_bytes, word_lists

#: Benchmark words that an index holds, about: the bound on what is sent to tasks.
BLOCK_WORDS = 1 << 19
#: Words of an item that make a piece of the benchmark; longer items are several, overlapping by a window less a word.
PIECE = 1 << 14
#: Candidates that are verified at a time.
AT_ONCE = 1 << 17


def pieces(benchmark: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """(item, words, n): the items' words, joined by spaces, cut so that every window is in a piece. Equal pieces of an item stand once."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for item, text in rows:
            held: list[bytes] = []
            first = True
            for words in word_lists(text):
                held += words
                while len(held) >= PIECE + window:
                    yield item, b" ".join(held[:PIECE]), PIECE
                    held, first = held[PIECE - window + 1 :], False
            if held and (first or len(held) >= window):
                yield item, b" ".join(held), len(held)

    named = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    return arrow_rows(named, "item string, words binary, n long", run).dropDuplicates(["item", "words"])


def looked_up(table: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Places, from 1, of the codes in a sorted table; 0 for those that it lacks."""
    if not len(table):
        return np.zeros(len(codes), np.int64)
    at = np.minimum(np.searchsorted(table, codes), len(table) - 1)
    return np.where(table[at] == codes, at + 1, 0)


def grouped(keys: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, values): the values of each key from 0 to n - 1, next to each other."""
    order = np.argsort(keys, kind="stable")
    return np.concatenate([[0], np.cumsum(np.bincount(keys, minlength=n))]), values[order]


def spread(starts: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, place): for each key, the places of its values in ``grouped``; which is the key's place in ``keys``."""
    sizes = starts[keys + 1] - starts[keys]
    which = np.repeat(np.arange(len(keys)), sizes)
    place = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts[keys], sizes)
    return which, place


class Index:
    """A block of the benchmark: its vocabulary, shingles, windows and, once counts are known, the rarest shingle of each window."""

    def __init__(self, rows: list[tuple[str, bytes]], window: int, shingle: int) -> None:
        self.window, self.shingle = window, min(shingle, window)
        split = [words.split() for _, words in rows]
        self.vocabulary = {w: n for n, w in enumerate(sorted({w for words in split for w in words}), 1)}
        self.items = sorted({item for item, _ in rows})
        number = {item: n for n, item in enumerate(self.items)}
        self.base = len(self.vocabulary) + 1
        found, owners = [], []
        for (item, _), words in zip(rows, split, strict=True):
            ids = np.array([self.vocabulary[w] for w in words], np.int64)
            size = min(window, len(ids))
            at = np.lib.stride_tricks.sliding_window_view(ids, size)
            found.append(np.pad(at, ((0, 0), (0, window - size))))
            owners.append(np.full(len(at), number[item]))
        stacked = np.concatenate(found) if found else np.zeros((0, window), np.int64)
        self.windows, which = np.unique(stacked, axis=0, return_inverse=True)
        pairs = np.unique(np.stack([which.ravel(), np.concatenate(owners)], 1), axis=0) if found else np.zeros((0, 2), np.int64)
        self.lengths = (self.windows > 0).sum(axis=1)
        self.item_starts, self.item_of = grouped(pairs[:, 0], pairs[:, 1], len(self.windows))
        self.tables: list[np.ndarray] = []
        flat = np.pad(self.windows, ((0, 0), (0, 1))).ravel()
        level = flat
        for size in range(2, self.shingle + 1):
            codes = self.codes(level, flat, size)
            self.tables.append(np.unique(codes[codes > 0]))
            level = looked_up(self.tables[-1], codes) * (codes > 0)
        #: The first token of each size of shingle.
        self.offsets = np.cumsum([0, self.base, *(len(t) + 1 for t in self.tables)]).tolist()
        self.slot: np.ndarray | None = None

    def codes(self, level: np.ndarray, ids: np.ndarray, size: int) -> np.ndarray:
        """What names the run of ``size`` words at each place: the number of its head and its last word; 0 where a word is missing."""
        out = np.zeros(len(ids), np.int64)
        head, last = level[: len(ids) - size + 1], ids[size - 1 :]
        out[: len(head)] = np.where((head > 0) & (last > 0), head * self.base + last, 0)
        return out

    def tokens(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, tokens) of the benchmark's shingles of each size in a row of word numbers."""
        level = ids
        at = np.flatnonzero(level)
        yield at, level[at]
        for size, table in enumerate(self.tables, 2):
            codes = self.codes(level, ids, size)
            at = np.flatnonzero(codes)
            level = np.zeros(len(ids), np.int64)
            level[at] = looked_up(table, codes[at])
            at = np.flatnonzero(level)
            yield at, level[at] + self.offsets[size - 1]

    def numbers(self, text: bytes) -> np.ndarray:
        """A text's words by number, 0 for those that the benchmark lacks."""
        parts = [np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int32, len(words)) for words in word_lists(text)]
        return np.concatenate(parts) if parts else np.zeros(0, np.int32)

    def choose(self, counts: np.ndarray) -> None:
        """The prefix of every window: the shingle of its size that documents hold least often. A window with one that none holds can't occur."""
        flat = np.pad(self.windows, ((0, 0), (0, 1))).ravel()
        width = self.window + 1
        best = np.full(len(self.windows), np.iinfo(np.int64).max)
        token_of, offset_of = np.zeros(len(self.windows), np.int64), np.zeros(len(self.windows), np.int64)
        for size, (at, tokens) in enumerate(self.tokens(flat), 1):
            here = np.minimum(self.lengths, self.shingle)[at // width] == size
            at, tokens = at[here], tokens[here]
            for offset in range(self.window):
                now = at % width == offset
                w, t = at[now] // width, tokens[now]
                better = counts[t] < best[w]
                best[w[better]], token_of[w[better]], offset_of[w[better]] = counts[t[better]], t[better], offset
        live = np.flatnonzero((best > 0) & (best < np.iinfo(np.int64).max))
        prefixes, key = np.unique(token_of[live], return_inverse=True)
        self.slot = np.full(self.offsets[-1], -1, np.int64)
        self.slot[prefixes] = np.arange(len(prefixes))
        self.prefix_starts, self.prefix_windows = grouped(key, live, len(prefixes))
        self.offset_of = offset_of

    def occurrences(self, ids: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, windows) where windows stand in texts that begin at ``starts`` of a row of word numbers, a zero after each."""
        assert self.slot is not None
        steps = np.arange(self.window)
        for places, tokens in self.tokens(ids):
            slots = self.slot[tokens]
            places, slots = places[slots >= 0], slots[slots >= 0]
            load = np.cumsum(self.prefix_starts[slots + 1] - self.prefix_starts[slots])
            for low in np.unique(np.searchsorted(load, np.arange(0, load[-1] if len(load) else 0, AT_ONCE), "right")).tolist():
                high = int(np.searchsorted(load, (load[low - 1] if low else 0) + AT_ONCE, "right"))
                high = max(high, low + 1)
                which, at = spread(self.prefix_starts, slots[low:high])
                window = self.prefix_windows[at]
                begin = places[low:high][which] - self.offset_of[window]
                text = np.searchsorted(starts, places[low:high], "right")[which] - 1
                stop = np.append(starts[1:], len(ids))[text] - 1
                fits = (begin >= starts[text]) & (begin + self.lengths[window] <= stop)
                begin, window = begin[fits], window[fits]
                want = self.windows[window]
                have = ids[np.minimum(begin[:, None] + steps, len(ids) - 1)]
                same = ((have == want) | (want == 0)).all(axis=1)
                yield begin[same], window[same]


def joined(batch: pa.RecordBatch, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """The word numbers of a batch's texts in one row, a zero after each, and where each text begins."""
    parts = [index.numbers(text) for text in batch.column(1).to_pylist()]
    starts = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])])[:-1].astype(np.int64)
    row = np.zeros(sum(len(p) + 1 for p in parts), np.int64)
    for start, part in zip(starts.tolist(), parts, strict=True):
        row[start : start + len(part)] = part
    return row, starts


def counted(docs: DataFrame, index: Index) -> np.ndarray:
    """How often the documents hold each of the index's shingles; ``docs`` is (key, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(index)
    arrow = arrow_schema(docs.sparkSession, "token long, n long")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        counts = np.zeros(index.offsets[-1], np.int64)
        for batch in slices(batches):
            for _, tokens in index.tokens(joined(batch, index)[0]):
                counts += np.bincount(tokens, minlength=len(counts))
        tokens = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(tokens), pa.array(counts[tokens])], schema=arrow)

    out = np.zeros(index.offsets[-1], np.int64)
    for token, n in docs.mapInArrow(work, "token long, n long").groupBy("token").agg(F.sum("n")).collect():
        out[token] = n
    shared.unpersist()
    return out


def runs_of(marks: np.ndarray) -> list[tuple[int, int]]:
    """(first, stop) of the runs of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], marks.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


FOUND = "n_words long, spans array<struct<first: long, stop: long>>, items array<string>"


def searched(docs: DataFrame, index: Index) -> DataFrame:
    """(key, n_words, spans, items) of (key, text): runs of words that windows cover, and the items whose windows stand there, sorted."""
    shared = docs.sparkSession.sparkContext.broadcast(index)
    schema = f"{docs.columns[0]} long, {FOUND}"
    arrow = arrow_schema(docs.sparkSession, schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value

        def rows() -> Iterator[tuple]:
            for batch in slices(batches):
                ids, starts = joined(batch, index)
                cover = np.zeros(len(ids) + 1, np.int64)
                pairs = np.zeros((0, 2), np.int64)
                for begin, window in index.occurrences(ids, starts):
                    cover += np.bincount(begin, minlength=len(cover)) - np.bincount(begin + index.lengths[window], minlength=len(cover))
                    seen = np.unique(np.stack([np.searchsorted(starts, begin, "right") - 1, window], 1), axis=0)
                    which, at = spread(index.item_starts, seen[:, 1])
                    pairs = np.unique(np.concatenate([pairs, np.stack([seen[which, 0], index.item_of[at]], 1)]), axis=0)
                hit = np.cumsum(cover)[:-1] > 0
                stops = np.append(starts[1:], len(ids)) - 1
                at = np.searchsorted(pairs[:, 0], np.arange(len(starts) + 1))
                for n, (key, start, stop) in enumerate(zip(batch.column(0).to_pylist(), starts.tolist(), stops.tolist(), strict=True)):
                    named = pairs[at[n] : at[n + 1], 1].tolist()
                    spans = runs_of(hit[start:stop]) if named else []
                    yield key, stop - start, [{"first": a, "stop": b} for a, b in spans], [index.items[i] for i in named]

        yield from gathered(rows(), arrow)

    return docs.mapInArrow(work, schema)


def merged(found: DataFrame) -> DataFrame:
    """One row per row number of what several blocks found in it."""
    every = found.groupBy("row").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for row, n_words, spans, items in rows:
            cover = np.zeros(n_words + 1, np.int64)
            for span in spans:
                cover[span["first"]] += 1
                cover[span["stop"]] -= 1
            yield row, n_words, [{"first": a, "stop": b} for a, b in runs_of(np.cumsum(cover)[:-1] > 0)], items

    schema = f"row long, {FOUND}"
    arrow = arrow_schema(found.sparkSession, schema)
    return every.mapInArrow(lambda batches: gathered(run(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)), arrow), schema)


def contamination(
    docs: DataFrame, benchmark: DataFrame, *, window: int = 10, shingle: int = 3, block_words: int = BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """(doc_id, n_words, spans, items) of every document: the runs of its words that lie in an occurrence of a window, and the items concerned, as sorted strings.

    Null and empty texts have no words, and items without words no windows. A null item_id is the item of the empty name; rows that share an item_id are
    one item; windows that several items share name all of them. Repeated documents give repeated rows, an empty benchmark finds
    nothing, an empty table of documents gives no rows; other columns are left aside.
    """
    texts = keyed_bytes(docs, id_col, text_col)
    parts = checkpointed(pieces(benchmark, window, item_id, item_text))
    blocks = max(1, math.ceil((parts.agg(F.sum("n")).head()[0] or 0) / block_words))
    block = F.pmod(F.xxhash64("item", "words"), F.lit(blocks))

    def index_of(n: int) -> Index:
        return Index([(r[0], bytes(r[1])) for r in parts.where(block == n).select("item", "words").collect()], window, shingle)

    def found(rows: DataFrame, index: Index) -> DataFrame:
        index.choose(counted(rows, index))
        return searched(rows, index)

    if blocks == 1:
        return found(texts, index_of(0))
    numbered = written(texts.withColumn("row", F.monotonically_increasing_id()), "numbered-texts")
    rows = numbered.select("row", "text")
    every = [found(rows, index_of(n)) for n in range(blocks)]
    hits = [checkpointed(f.where(F.size("items") > 0)) for f in every[1:]]
    all_of = every[0]
    for more in hits:
        all_of = all_of.unionByName(more)
    return numbered.select("row", "doc_id").join(merged(all_of), "row").drop("row")


def digest(found: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of what ``contamination`` gives."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["first"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("items") > 0).alias("contaminated"))


def cleaned(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", **options: object) -> DataFrame:
    """The documents, with all their columns, that no benchmark window occurs in. A row without id stays only if no such row is contaminated."""
    dirty = contamination(docs, benchmark, id_col=id_col, **options).where(F.size("items") > 0).select("doc_id").distinct()  # type: ignore[arg-type]
    return docs.join(dirty, docs[id_col].eqNullSafe(dirty["doc_id"]), "left_anti")
