"""Resampling towards a target distribution by importance weights of hashed word features.

A task keeps the word runs of its texts in a trie: the node of a run holds its count and the CRC-32 state of its bytes, so
a longer run's bucket continues its parent's state and no joined string is made. Buckets' totals, a fixed number, are
all that is summed over tasks. The gains made of them go back to the tasks, whose tries attach a gain to each node; a
document's weight is what its walk along trie paths collects. A trie that has grown to ``NODES`` gives its counts to the
totals, or drops its gains, and starts anew, so memory is bounded and no result changes.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, checkpointed
from .words import keyed_bytes, word_lists

#: Nodes of a task's trie at most, give or take those of one list of words.
NODES = 1 << 18
#: Rows of a partition that monotonically_increasing_id leaves room for.
ROW_BITS = 33


class Trie:
    """Runs of one to ``most`` words. A node is [value, CRC-32 of its run, children]."""

    def __init__(self, most: int) -> None:
        self.most = most
        self.root: dict[bytes, list] = {}
        self.nodes = 0

    def paths(self, words: Sequence[bytes], starts: int) -> Iterator[list]:
        """The node of every run that begins at one of the first ``starts`` words."""
        for i in range(starts):
            level, crc, joint = self.root, 0, b""
            for word in words[i : i + self.most]:
                node = level.get(word)
                if node is None:
                    node = level[word] = [None, zlib.crc32(joint + word, crc), {} if self.most > 1 else None]
                    self.nodes += 1
                yield node
                _, crc, level = node
                joint = b" "

    def all_nodes(self) -> Iterator[list]:
        levels = [self.root]
        while levels:
            for node in levels.pop().values():
                yield node
                if node[2]:
                    levels.append(node[2])


def spans_of_words(text: bytes, most: int) -> Iterator[tuple[list[bytes], int]]:
    """(words, starts): lists of a text's words, each with those of the next list that its last runs need."""
    held: list[bytes] = []
    for words in word_lists(text):
        held += words
        starts = len(held) - most + 1
        if starts > 0:
            yield held, starts
            held = held[starts:]
    if held:
        yield held, len(held)


def bucket_totals(texts: DataFrame, most: int, buckets: int, *, id_col: str, text_col: str) -> np.ndarray:
    """How many features fall into each bucket, over all texts: ``buckets`` counts, whatever the size of the input."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        totals = np.zeros(buckets, np.int64)
        trie = Trie(most)

        def give() -> None:
            for count, crc, _ in trie.all_nodes():
                totals[crc % buckets] += count

        for _, text in rows:
            for words, starts in spans_of_words(text, most):
                for node in trie.paths(words, starts):
                    node[0] = (node[0] or 0) + 1
                if trie.nodes > NODES:
                    give()
                    trie = Trie(most)
        give()
        yield from ((int(b), int(totals[b])) for b in np.flatnonzero(totals))

    parts = arrow_rows(keyed_bytes(texts, id_col, text_col), "bucket int, n long", run)
    out = np.zeros(buckets, np.int64)
    for bucket, n in parts.groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousand times the logarithm of a bucket's share of the target over its share of the source, both smoothed by one, floored."""
    s, t = float(source.sum() + len(source)), float(target.sum() + len(target))
    return np.array([math.floor(1000 * math.log(float(b + 1) * s / (float(a + 1) * t))) for a, b in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def gumbel(doc_id: int | None, seed: int) -> int:
    """A thousandfold Gumbel variate of the id's digest, so that the highest sums with weights are a draw without replacement."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighed(docs: DataFrame, gain_of: np.ndarray, most: int, seed: int, *, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(gain_of)

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        gain = shared.value.tolist()
        trie = Trie(most)
        for doc_id, text in rows:
            n_words = n = total = 0
            for words, starts in spans_of_words(text, most):
                n_words += starts
                for node in trie.paths(words, starts):
                    if node[0] is None:
                        node[0] = gain[node[1] % len(gain)]
                    total += node[0]
                    n += 1
                if trie.nodes > NODES:
                    trie = Trie(most)
            weight = total // n if n else 0
            yield doc_id, n_words, n, weight, weight + gumbel(doc_id, seed)

    return arrow_rows(keyed_bytes(docs, id_col, text_col), "doc_id long, n_words long, n_features long, weight long, score long", run)


def ranked(scored: DataFrame, drawn: int) -> DataFrame:
    """``scored`` with the rank of its ``drawn`` highest scores, ties to the smaller doc_id; null beyond.

    Ranges of (score, doc_id, row) are sorted apart, and a row's rank is its place in its range plus the sizes of the ranges before.
    A row's own number parts rows that agree in all else, so no id is a hot key.
    """
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")]
    numbered = scored.withColumn("row", F.monotonically_increasing_id())
    placed = checkpointed(numbered.repartitionByRange(*order).sortWithinPartitions(*order).drop("row").withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", ROW_BITS)
    sizes = sorted(placed.groupBy(part.alias("part")).count().collect())
    before = np.cumsum([0, *(n for _, n in sizes)]).tolist()
    offsets = placed.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(sizes, before, strict=False)], "part long, before long")
    rank = F.col("before") + F.col("place").bitwiseAND((1 << ROW_BITS) - 1) + 1
    return placed.withColumn("part", part).join(F.broadcast(offsets), "part").withColumn("rank", F.when(rank <= drawn, rank)).drop("part", "before", "place")


def resample(
    docs: DataFrame, target: DataFrame, *, most: int = 1, buckets: int = 10_000, percent: int = 10, min_words: int = 20, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", target_id: str = "item_id", target_text: str = "text"
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every document; those drawn have a rank.

    Features are all runs of one to ``most`` words; ``percent`` of the documents with ``min_words`` words or more are drawn, rounded down.
    A null or empty text has no words, weight 0 and is never drawn where ``min_words`` is above zero; a null id is drawn by the digest of an empty id and
    comes last among equal scores. Repeated rows are documents of their own with ranks of their own. An empty target makes all
    gains those of an even distribution; an empty table of documents gives no rows. Other columns are left aside.
    """
    source = bucket_totals(docs, most, buckets, id_col=id_col, text_col=text_col)
    gain_of = gains(source, bucket_totals(target, most, buckets, id_col=target_id, text_col=target_text))
    scored = checkpointed(weighed(docs, gain_of, most, seed, id_col=id_col, text_col=text_col))
    enough = F.col("n_words") >= min_words
    # Scores are logarithms, so their number of values is bounded: some 100,000 for any count that 64 bits hold.
    counts = sorted(scored.where(enough).groupBy("score").count().collect(), reverse=True)
    drawn = percent * sum(n for _, n in counts) // 100
    least, seen = None, 0
    for score, n in counts:
        if seen >= drawn:
            break
        least, seen = score, seen + n
    if least is None:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    first = enough & (F.col("score") >= least)
    return ranked(scored.where(first), drawn).unionByName(scored.where(~first).withColumn("rank", F.lit(None).cast("long")))


def draw(docs: DataFrame, target: DataFrame, **options: object) -> DataFrame:
    """The drawn documents' ids by rank: (rank, doc_id)."""
    return resample(docs, target, **options).where("rank IS NOT NULL").select("rank", F.col("doc_id"))  # type: ignore[arg-type]
