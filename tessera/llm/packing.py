"""Best-fit packing of tokenised documents into sequences of fixed length.

Pattern packing by non-negative least squares. The histogram of piece lengths, at most ``seq_len`` counts, is all
that the driver sees. Patterns of few pieces that fill a sequence are enumerated on a grid of lengths; least squares
with counts of zero or more fits how often each is used; the counts are rounded down and turned into patterns of
exact lengths; what is left is packed best fit first into the remaining room, still on counts. The result is a
plan of which ranks of each length go where, so its size depends on ``seq_len`` alone. Pieces find their place by
their rank among the pieces of their length: a rank in their partition plus the counts of partitions before it.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, checkpointed, keyed_text
from .tokens import encoder

#: Lengths on the grid of patterns.
GRID = 128
#: Pieces in an enumerated pattern at most.
PATTERN_PIECES = 3


def pieces(docs: DataFrame, tokenizer_path: str, seq_len: int, end_id: int, *, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """Documents as pieces of at most ``seq_len`` ids: (doc_id, piece, start, length, ids_crc32, part, rank[, ids]).

    The document's ids and ``end_id`` are cut every ``seq_len`` ids. A null or empty text is ``end_id`` alone.
    ``rank`` counts earlier pieces of this length in the partition ``part``.
    """
    end = np.array([end_id], dtype="<u4").tobytes()
    step = 4 * seq_len

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        part = TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        encode = encoder(tokenizer_path).encode
        for doc_id, text in rows:
            data = encode(text) + end
            for n, at in enumerate(range(0, len(data), step)):
                piece = data[at : at + step]
                length = len(piece) // 4
                rank = seen.get(length, 0)
                seen[length] = rank + 1
                row = (doc_id, n, at // 4, length, zlib.crc32(piece), part, rank)
                yield (*row, np.frombuffer(piece, "<u4").tolist()) if ids else row

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long" + (", ids array<long>" if ids else "")
    return arrow_rows(keyed_text(docs, id_col, text_col), schema, run)


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """The x of zero or more with the least |a x - b|: active sets, one column in at a time."""
    gram, right = a.T @ a, a.T @ b
    x = np.zeros(a.shape[1])
    active = np.zeros(a.shape[1], dtype=bool)
    least = 1e-9 * max(1.0, float(np.abs(right).max(initial=0)))
    for _ in range(rounds):
        slope = right - gram @ x
        slope[active] = -np.inf
        best = int(slope.argmax()) if len(slope) else 0
        if not len(slope) or slope[best] <= least:
            break
        active[best] = True
        while True:
            at = np.nonzero(active)[0]
            z = np.linalg.lstsq(gram[np.ix_(at, at)], right[at], rcond=None)[0]
            if (z > 0).all():
                break
            low = z <= 0
            shift = float((x[at][low] / np.maximum(x[at][low] - z[low], 1e-300)).min())
            x[at] += shift * (z - x[at])
            drop = at[(x[at] <= 1e-12) & low]
            if not len(drop):
                drop = at[low]
            active[drop] = False
            x[drop] = 0
        x[:] = 0
        x[at] = z
    return x


def grid_patterns(grid: int, most: int, used: np.ndarray) -> list[tuple[int, ...]]:
    """Non-increasing tuples of one to ``most`` used grid lengths that sum to ``grid``."""
    out: list[tuple[int, ...]] = []
    have = [g for g in range(grid, 0, -1) if used[g]]

    def grow(done: tuple[int, ...], left: int) -> None:
        if not left:
            out.append(done)
            return
        if len(done) < most:
            for g in have:
                if g <= left and (not done or g <= done[-1]) and g * (most - len(done)) >= left:
                    grow((*done, g), left - g)

    grow((), grid)
    return out


class Plan:
    """Patterns of exact lengths and how often each is used, from a histogram of lengths."""

    def __init__(self, histogram: dict[int, int], seq_len: int) -> None:
        self.seq_len = seq_len
        self.left = np.zeros(seq_len + 1, dtype=np.int64)
        for length, count in histogram.items():
            self.left[length] += count
        self.groups: list[tuple[tuple[int, ...], int]] = []
        if self.left[seq_len]:
            self._use((seq_len,), int(self.left[seq_len]))
        self.fitted = self._fit()
        self._residuals()

    def _use(self, lengths: tuple[int, ...], count: int) -> None:
        self.groups.append((lengths, count))
        for length in lengths:
            self.left[length] -= count

    def _longest(self, low: int, high: int, taken: tuple[int, ...]) -> int:
        """The longest length left in low..high, not counting those taken; 0 if there is none."""
        for length in np.nonzero(self.left[low : high + 1])[0][::-1]:
            length = int(length) + low
            if length and self.left[length] > taken.count(length):
                return length
        return 0

    def _fit(self) -> int:
        """The named method: fit counts of grid patterns, round them down, and pick exact lengths for them."""
        grid = min(GRID, self.seq_len)
        step = self.seq_len / grid
        of = np.ceil(np.arange(self.seq_len + 1) / step).astype(int)
        counts = np.bincount(of, weights=self.left, minlength=grid + 1)
        patterns = grid_patterns(grid, PATTERN_PIECES, counts > 0)
        if not patterns:
            return 0
        a = np.zeros((grid + 1, len(patterns)))
        for column, pattern in enumerate(patterns):
            for g in pattern:
                a[g, column] += 1
        fit = np.floor(nnls(a, counts) + 1e-6).astype(np.int64)
        bounds = {g: (int(np.argmax(of == g)), int(len(of) - 1 - np.argmax(of[::-1] == g))) for g in set(of.tolist())}
        used = 0
        for column in np.argsort(-fit, kind="stable"):
            wanted = int(fit[column])
            while wanted > 0:
                taken: tuple[int, ...] = ()
                for n, g in enumerate(patterns[column]):
                    room = self.seq_len - sum(taken)
                    last = n + 1 == len(patterns[column])
                    low, high = bounds[g]
                    length = self._longest(low, room if last else min(high, room), taken)
                    if not length:
                        break
                    taken += (length,)
                if len(taken) < len(patterns[column]):
                    break
                count = min(wanted, *(int(self.left[x]) // taken.count(x) for x in set(taken)))
                self._use(taken, count)
                wanted -= count
                used += count
        return used

    def _residuals(self) -> None:
        """Best fit, longest first, of the pieces left, into the patterns' room and then into new sequences."""
        room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
        for lengths, count in self.groups:
            room.setdefault(self.seq_len - sum(lengths), []).append((lengths, count))
        frees = sorted(room)

        def put(free: int, lengths: tuple[int, ...], count: int) -> None:
            if free not in room:
                room[free] = []
                bisect.insort(frees, free)
            room[free].append((lengths, count))

        for length in np.nonzero(self.left)[0][::-1]:
            length = int(length)
            need = int(self.left[length])
            while need:
                at = bisect.bisect_left(frees, length)
                if at == len(frees):
                    each = self.seq_len // length
                    if need >= each:
                        put(self.seq_len - each * length, (length,) * each, need // each)
                    if need % each:
                        put(self.seq_len - need % each * length, (length,) * (need % each), 1)
                    need = 0
                    continue
                free = frees[at]
                lengths, count = room[free].pop()
                if not room[free]:
                    del room[free]
                    frees.pop(at)
                if need >= count:
                    each = min(free // length, need // count)
                    put(free - each * length, lengths + (length,) * each, count)
                    need -= each * count
                else:
                    put(free, lengths, count - need)
                    put(free - length, (*lengths, length), need)
                    need = 0
            self.left[length] = 0
        self.groups = [g for free in frees for g in room[free]]

    @property
    def sequences(self) -> int:
        return sum(count for _, count in self.groups)

    def places(self) -> list[tuple[int, int, int, int, int]]:
        """(length, first rank, rank after the last, sequence of the first, offset): bounded by the plan, not the data."""
        out = []
        next_rank: dict[int, int] = {}
        first = 0
        for lengths, count in self.groups:
            offset = 0
            for length in lengths:
                rank = next_rank.get(length, 0)
                out.append((length, rank, rank + count, first, offset))
                next_rank[length] = rank + count
                offset += length
            first += count
        return out


def pack(docs: DataFrame, tokenizer_path: str, seq_len: int = 4096, end_id: int = 1, *, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """All documents packed: (doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]), a row per piece.

    Only documents longer than ``seq_len`` are cut. Pieces of a sequence follow one another from offset 0 without
    gaps. Null and empty texts are the end id alone; repeated rows are packed each; an empty table gives no rows;
    other columns are left aside. Which of several equally long pieces gets which place depends on how the input
    is partitioned; the number of sequences doesn't.
    """
    spark = docs.sparkSession
    cut = checkpointed(pieces(docs, tokenizer_path, seq_len, end_id, id_col=id_col, text_col=text_col, ids=ids))
    counts = cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = Plan(histogram, seq_len).places()
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    plan = spark.createDataFrame(places, "length long, from_rank long, to_rank long, first long, offset long").coalesce(1)
    at = F.col("rank") + F.col("before")
    placed = cut.join(starts, ["part", "length"]).withColumn("at", at)
    # The plan's size is bounded by seq_len (some tens of thousands of rows), whatever the data.
    return (
        placed.join(F.broadcast(plan), (placed["length"] == plan["length"]) & (F.col("at") >= F.col("from_rank")) & (F.col("at") < F.col("to_rank")))
        .select("doc_id", "piece", "start", placed["length"], "ids_crc32", (F.col("first") + F.col("at") - F.col("from_rank")).alias("sequence_id"), "offset", *(["ids"] if ids else []))
    )
