"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at a distance of ``radius`` or less differ, in at least one of three blocks of bits, by a third of it or more (rounded
up; or are equal). With that block erased, they differ in at most the rest, and meet halfway: every fingerprint emits, for
each block, itself and all variants within half the rest outside the block. For 3 or 4 bits the rest is two and its half
one, for 5 or 6 bits three or four and two. Fingerprints that meet in a variant are
verified. Members of a variant are linked where they meet, in a forest of links at most, never as pairs of a group.
The members of a variant with more than ``MEETING`` of them emit their full balls of half the radius around the whole
fingerprint instead: any value has at most so many fingerprints within that as the ball has values, so those groups are bounded.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, checkpointed, keyed_text
from .components import Forest, components

BITS = 64
RADIUS = 3
#: Bits of the three blocks: 0-21, 22-42, 43-63.
BLOCKS = ((0, 22), (22, 43), (43, 64))
#: Members of a variant that are compared where they meet.
MEETING = 8_192
#: Shingles hashed at a time.
STEP = 1 << 16


def fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    """Majority bits of the shingles' XXH64; A-Z count as a-z, words are split at ASCII white space, no word gives 0."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    n = max(1, len(found) - words + 1)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[:n].tolist()
    stops = ends[words - 1 :].tolist() if len(found) >= words else [len(joined)]
    ones = np.zeros(BITS, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, STEP):
        ones += ones_of(np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[at : at + STEP], stops[at : at + STEP], strict=True)), dtype="<u8", count=min(STEP, n - at)))
    return majority(ones, n)


def ones_of(hashes: np.ndarray) -> np.ndarray:
    """How many of some hashes have each bit set."""
    return np.unpackbits(hashes.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def majority(ones: np.ndarray, n: int) -> int:
    return int(sum(1 << i for i, c in enumerate(ones.tolist()) if 2 * c > n))


def fingerprint_of_set(hashes: np.ndarray) -> int:
    """Majority bits of the hashes of a set of shingles, each counted once; an empty set gives 0."""
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), STEP):
        ones += ones_of(hashes[at : at + STEP])
    return majority(ones, len(hashes))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, *, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long): the fingerprint's 64 bits as a signed long. Null and empty texts have 0.

    A bit set in exactly half of the shingles is 0, so there are no ties. Repeated rows give repeated results; an empty table gives none;
    other columns are left aside.
    """

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text in rows:
            yield doc_id, signed(fingerprint(text, words))

    return arrow_rows(keyed_text(docs, id_col, text_col), "doc_id long, fp long", run)


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint64))


def link_group(members: np.ndarray, forest: Forest, radius: int = RADIUS) -> None:
    """Links all members at distance ``radius`` or less: each is compared with the members not yet in its component."""
    if len(members) == 2:
        if int(popcount(members[:1] ^ members[1:])[0]) <= radius:
            forest.link(int(members[0]), int(members[1]))
        return
    left = members
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            head, front = front[0], front[1:]
            near = popcount(left ^ head) <= radius
            if near.any():
                for other in left[near].tolist():
                    forest.link(int(head), other)
                front, left = np.concatenate([front, left[near]]), left[~near]


def turned(bits: Sequence[int], most: int) -> list[int]:
    """All patterns of at most so many of some bits, as signed longs."""
    return [signed(sum(1 << i for i in some)) for n in range(most + 1) for some in combinations(bits, n)]


def variants(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(block, variant, fp): for each block, fp without it and with other bits turned, as many as half of what the block leaves."""
    half = -(-(radius - -(-radius // len(BLOCKS))) // 2)
    made = []
    for block, (low, high) in enumerate(BLOCKS):
        keep = signed(~(((1 << high) - 1) ^ ((1 << low) - 1)) & ((1 << 64) - 1))
        made += [(block, keep, turn) for turn in turned([i for i in range(BITS) if not low <= i < high], half)]
    table = F.array(*(F.struct(F.lit(b).cast("byte").alias("block"), F.lit(k).cast("long").alias("keep"), F.lit(t).cast("long").alias("turn")) for b, k, t in made))
    each = fps.select("fp", F.explode(table).alias("v"))
    return each.select(F.col("v.block").alias("block"), F.col("fp").bitwiseAND(F.col("v.keep")).bitwiseXOR(F.col("v.turn")).alias("variant"), "fp")


def full_ball(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(block = -1, variant, fp): every value within half the radius, rounded up, of fp."""
    table = F.array(*(F.lit(t).cast("long") for t in turned(range(BITS), -(-radius // 2))))
    each = fps.select("fp", F.explode(table).alias("turn"))
    return each.select(F.lit(-1).cast("byte").alias("block"), F.col("fp").bitwiseXOR(F.col("turn")).alias("variant"), "fp")


def met(pairs: DataFrame, meeting: int, radius: int = RADIUS, near: bool = False) -> DataFrame:
    """(a, b) links of fingerprints that meet in a variant, as a forest per task; b is null for a member of a crowd.

    With ``near``, every link is of two fingerprints within the radius themselves, so that what they stand for can be compared.
    """
    sorted_runs = pairs.repartition("block", "variant").sortWithinPartitions("block", "variant")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        crowded: set[int] = set()
        held: list[np.ndarray] = []
        key = None
        size = 0

        def close() -> None:
            nonlocal held, size
            if size > 1:
                members = np.unique(np.concatenate(held))
                if len(members) > meeting:
                    crowded.update(members.tolist())
                elif len(members) > 1:
                    link_group(members, forest, radius)
            held, size = [], 0

        for batch in batches:
            block, variant, fp = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if not len(fp):
                continue
            cuts = np.nonzero((block[1:] != block[:-1]) | (variant[1:] != variant[:-1]))[0] + 1
            starts, stops = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(fp)]])
            last = len(starts) - 1
            # A run wholly inside the batch is of interest only if it has two rows or more.
            for at in sorted({0, last, *np.nonzero(stops - starts > 1)[0].tolist()}):
                a, b = int(starts[at]), int(stops[at])
                now = (int(block[a]), int(variant[a]))
                if now != key:
                    close()
                    key = now
                held.append(fp[a:b].copy())
                size += b - a
                if len(held) > 64:
                    held = [np.unique(np.concatenate(held))]
        close()
        links = forest.joined if near else [(n, forest.root(n)) for n in list(forest.parent)]
        a = [x for x, _ in links] + list(crowded)
        b = [y for _, y in links] + [None] * len(crowded)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return sorted_runs.mapInArrow(work, "a long, b long")


def links(fps: DataFrame, meeting: int = MEETING, radius: int = RADIUS, size: int | None = None, near: bool = False) -> DataFrame:
    """(a, b): links that connect all fingerprints of (fp), about ``size``, which a chain of distances of ``radius`` or less connects.

    With ``near``, links are no longer than the radius themselves.
    """
    # Fingerprints are few bytes and their variants many, so they are spread before.
    spread = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    # Links are few beside the variants that they come from, so their files may be.
    found = checkpointed(met(variants(spread, radius), meeting, radius, near), None if size is None else 16 * size)
    close = found.where(F.col("b").isNotNull())
    crowd = found.where(F.col("b").isNull()).select(F.col("a").alias("fp")).distinct()
    if crowd.limit(1).count():
        # As many fingerprints as a ball has values share such a variant, some of them further apart than the radius, so they are verified too.
        close = close.unionByName(met(full_ball(crowd, radius), 1 << 62, radius, near))
    return close.distinct()


def near_duplicates(docs: DataFrame, *, words: int = 3, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text", meeting: int = MEETING) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document.

    Documents with one fingerprint are one node, so copies are never compared. component_id is the smallest doc_id
    that links of ``radius`` bits or less reach, the document's own included. Null, empty and wordless texts have
    fingerprint zero and are linked like any other. Repeated rows give repeated results, an empty table gives none,
    other columns are left aside; nothing but counts comes to the driver. A null doc_id is never the smallest, and
    is the component_id only where no other is reachable. ``radius`` is 1 to 6.
    """
    if not 1 <= radius <= 6:
        raise ValueError("radius must be 1 to 6")
    marked = checkpointed(fingerprints(docs, words=words, id_col=id_col, text_col=text_col))
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = components(links(nodes.select("fp"), meeting, radius, marked.count()))
    known = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    leasts = known.groupBy("component").agg(F.min("least").alias("component_id"))
    named = known.select("fp", "component").join(leasts, "component").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, *, words: int = 3, percent: int | None = None, id_col: str = "doc_id", text_col: str = "text", meeting: int = MEETING) -> DataFrame:
    """One row, with all its columns, of each component: that of the smallest doc_id (without ``percent`` any one, if that id repeats).

    Without ``percent``, fingerprints within RADIUS bits are linked. With it, texts whose sets of shingles have a Jaccard similarity of so
    many percent: ``shingles`` compares the sets where fingerprints meet, and finds what is similar though its fingerprints, at 80
    some ten bits apart, are out of reach of any ball of a size to emit. Without ``percent``, rows without a doc_id count as one document.
    Null, empty and wordless texts are copies of each other; an empty table gives none; clashing column names do no harm.
    """
    if percent is not None:
        from . import shingles  # it builds on this module

        return shingles.keep_first(docs, words=words, percent=percent, id_col=id_col, text_col=text_col)
    found = near_duplicates(docs, words=words, id_col=id_col, text_col=text_col, meeting=meeting)
    first = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("first_id")).distinct()
    return docs.join(first, docs[id_col].eqNullSafe(first["first_id"]), "left_semi").dropDuplicates([id_col])
