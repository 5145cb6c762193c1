"""Product quantisation of integer vectors: a small codebook for each part of the vector, fitted by rounds of nearest entries and integer means.

Each round broadcasts one kd-tree per codebook, a fixed number of entries. Tasks look up all parts by branch and bound: a tree's node
knows the box of its entries, and a node is visited unless its box is farther than the best entry so far. One that is exactly as
far is visited too, so among equally near entries the lowest index wins. Sums are of integers, so the order of tasks doesn't matter.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, written

#: Vectors that are looked up at a time.
AT_ONCE = 1 << 13
#: Entries of a kd-tree's leaf.
LEAF = 2
#: A label with more than its share of one in HEAVY of all rows has its sum broadcast; there are fewer than HEAVY of them.
HEAVY = 1_024


class KdTree:
    """The entries of one codebook, halved again and again by the widest component."""

    def __init__(self, entries: np.ndarray, indices: np.ndarray | None = None) -> None:
        self.indices = np.arange(len(entries)) if indices is None else indices
        self.low, self.high = entries.min(axis=0, initial=np.iinfo(np.int64).max), entries.max(axis=0, initial=np.iinfo(np.int64).min)
        self.entries = entries
        self.halves: list[KdTree] = []
        if len(entries) > LEAF and (self.low < self.high).any():
            order = np.argsort(entries[:, int((self.high - self.low).argmax())], kind="stable")
            self.halves = [KdTree(entries[half], self.indices[half]) for half in (order[: len(order) // 2], order[len(order) // 2 :])]

    def bound(self, x: np.ndarray) -> np.ndarray:
        """The squared distance of each row from the box of the entries."""
        off = np.maximum(np.maximum(self.low - x, x - self.high), 0)
        return (off * off).sum(axis=1)

    def visit(self, x: np.ndarray, rows: np.ndarray, best: np.ndarray, index: np.ndarray) -> None:
        """Betters ``best`` and ``index`` of the given rows of ``x`` by this node's entries."""
        if not len(rows):
            return
        if not self.halves:
            for entry, number in zip(self.entries, self.indices.tolist(), strict=True):
                off = x[rows] - entry
                distance = (off * off).sum(axis=1)
                better = (distance < best[rows]) | ((distance == best[rows]) & (number < index[rows]))
                best[rows[better]], index[rows[better]] = distance[better], number
            return
        one, two = self.halves
        to_one, to_two = one.bound(x[rows]), two.bound(x[rows])
        first = to_one <= to_two
        for half, near in ((one, first), (two, ~first)):
            half.visit(x, rows[near], best, index)
        for half, far, bound in ((one, ~first, to_one), (two, first, to_two)):
            half.visit(x, rows[far & (bound <= best[rows])], best, index)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry to each row, the lowest index among equals."""
        best = np.full(len(x), np.iinfo(np.int64).max)
        index = np.full(len(x), len(self.indices), np.int64)
        self.visit(x, np.arange(len(x)), best, index)
        return index, best


def integers(vectors: DataFrame, scale: int, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, n, vec): the usable vectors' floored multiples as int32, of n components.

    Beyond the range whose squared distances 64 bits hold, an OverflowError is raised.
    """
    plain = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vec"))
    label = plain.schema["label"].dataType.simpleString()
    schema = f"vec_id long, label {label}, n int, vec binary"
    arrow = arrow_schema(vectors.sparkSession, schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            out, use = [], []
            for row in range(len(column)):
                values = column[row].values
                ok = values is not None and not values.null_count
                floats = values.to_numpy(zero_copy_only=False).astype(np.float64) if ok else np.zeros(0)
                ok = ok and bool(np.isfinite(floats).all())
                use.append(ok)
                if ok:
                    floats = np.floor(floats * scale)
                    if len(floats) and np.abs(floats).max() > math.isqrt(((1 << 63) - 1) // len(floats)) // 2:
                        raise OverflowError(f"a component of a vector is too large for squared distances of 64 bits: {np.abs(floats).max() / scale}")
                    out.append(floats.astype("<i4"))
            kept = pa.array(use, pa.bool_())
            columns = [batch.column(0).filter(kept), batch.column(1).filter(kept), pa.array([len(v) for v in out], pa.int32()), pa.array([v.tobytes() for v in out], pa.binary())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return plain.mapInArrow(work, schema)


def matrices(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of the batches with their vectors as a matrix."""
    for batch in batches:
        for start in range(0, batch.num_rows, AT_ONCE):
            piece = batch.slice(start, AT_ONCE)
            yield piece, np.frombuffer(b"".join(piece.column(at).to_pylist()), "<i4").reshape(piece.num_rows, -1).astype(np.int64)


def moved(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks (part, entry, component) after a round: each entry the floored mean of the parts nearest to it, an unused one as it was."""
    parts, entries, width = books.shape
    trees = rows.sparkSession.sparkContext.broadcast([KdTree(book) for book in books])
    schema = "part int, entry int, place int, total long, n long"
    arrow = arrow_schema(rows.sparkSession, schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(books_shape, np.int64), np.zeros(books_shape[:2], np.int64)
        for _, x in matrices(batches, 0):
            for part, tree in enumerate(trees.value):
                mine = x[:, part * width : (part + 1) * width]
                index, _ = tree.nearest(mine)
                np.add.at(sums[part], index, mine)
                counts[part] += np.bincount(index, minlength=entries)
        part, entry = np.nonzero(counts)
        place = np.tile(np.arange(width), len(part))
        columns = [np.repeat(part, width), np.repeat(entry, width), place, sums[part, entry].ravel(), np.repeat(counts[part, entry], width)]
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    books_shape = (parts, entries, width)
    out = books.copy()
    # As many rows as the codebooks have components, whatever the number of vectors.
    for part, entry, place, total, n in rows.select("vec").mapInArrow(work, schema).groupBy("part", "entry", "place").agg(F.sum("total"), F.sum("n")).collect():
        out[part, entry, place] = total // n
    trees.unpersist()
    return out


def coded(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error): the nearest entries' indices, two hex digits each, and the squared distances' sum."""
    trees = rows.sparkSession.sparkContext.broadcast([KdTree(book) for book in books])
    parts, _, width = books.shape
    schema = f"vec_id long, label {rows.schema['label'].dataType.simpleString()}, code string, error long"
    arrow = arrow_schema(rows.sparkSession, schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, x in matrices(batches, 2):
            codes, errors = np.zeros((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
            for part, tree in enumerate(trees.value):
                index, distance = tree.nearest(x[:, part * width : (part + 1) * width])
                codes[:, part] = index
                errors += distance
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array([c.tobytes().hex() for c in codes]), pa.array(errors)], schema=arrow)

    return rows.select("vec_id", "label", "vec").mapInArrow(work, schema)


def with_label_error(found: DataFrame) -> DataFrame:
    """``found`` with the errors' sum over its label, nulls together.

    Sums are made before anything is joined. Those of labels with a large share of the rows, fewer than HEAVY, are broadcast, so that no such
    label is a hot key; rows of the others are joined by label.
    """
    sums = found.groupBy(F.col("label").alias("of_label")).agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n"))
    total = found.count()
    is_heavy, same = F.col("n") * HEAVY > total, F.col("label").eqNullSafe(F.col("of_label"))
    columns = [*found.columns, "label_error"]
    marked = found.join(F.broadcast(sums.where(is_heavy)), same, "left").drop("of_label")
    large = marked.where("label_error IS NOT NULL").select(columns)
    rest = marked.where("label_error IS NULL").select(found.columns)
    return large.unionByName(rest.join(sums.where(~is_heavy), same).select(columns))


def compress(vectors: DataFrame, *, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """((vec_id, label, code, error, label_error), codebooks): codes of every usable vector, and the entries by part, entry and component.

    A component x counts as floor(scale * x). Vectors that are null or hold null or non-finite components are left out, as are those whose
    length isn't that of the smallest vec_id, which no codebook can stand for. The codebooks begin with the parts of the smallest ids, ids that
    are null last, equal ids by their vectors; with fewer rows they have fewer entries. Repeated rows are coded alike and count in means as often
    as they stand. An empty table gives no rows and codebooks without entries. Other columns are left aside.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits, so a codebook has 256 entries at most")
    rows = written(integers(vectors, scale, id_col, vector_col, label_col), "vectors")
    order = [F.col("vec_id").asc_nulls_last(), "vec"]
    first = rows.orderBy(*order).limit(1).select("n").collect()
    width = first[0]["n"] if first else 0
    if width % parts:
        raise ValueError(f"vectors of {width} components can't be cut into {parts} equal parts")
    rows = rows.where(F.col("n") == width)
    seeds = [np.frombuffer(bytes(r["vec"]), "<i4").astype(np.int64) for r in rows.orderBy(*order).limit(entries).select("vec").collect()]
    books = np.stack(seeds).reshape(len(seeds), parts, width // parts).transpose(1, 0, 2).copy() if seeds else np.zeros((parts, 0, 0), np.int64)
    for _ in range(rounds if seeds and width else 0):
        books = moved(rows, books)
    if not seeds:
        return with_label_error(rows.selectExpr("vec_id", "label", "'' AS code", "0L AS error").where("false")), books
    return with_label_error(written(coded(rows, books), "codes")), books


def decoded(code: str, books: np.ndarray, scale: int = 4096) -> np.ndarray:
    """The vector that a code stands for."""
    return np.concatenate([book[i] for book, i in zip(books, bytes.fromhex(code), strict=True)]) / scale


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
