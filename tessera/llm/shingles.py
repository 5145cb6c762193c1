"""Near-duplicates by exact Jaccard similarity of word shingles: SimHash and its balls first, minimal hashes for what no ball reaches.

Texts with one set of shingles are one node, and the set's fingerprint is its SimHash.

1. Nodes whose fingerprints are equal, or meet in a variant and are within ``RADIUS`` bits (``simhash.links``), are compared by their sets.
   What is similar makes components; some hops from node to least similar node tell most of them, which is enough to leave out comparisons.
2. Pairs at 0.8 are often further apart than any ball reaches. So a node's 160 minimal hashes make 32 bands of five; two nodes at similarity
   0.8 share no band with a chance of 0.672 ** 32, or 3 in a million. A band whose members are in one component is done. Of any other, the
   members outside its largest component are estimated against all members of other components, block by block, and every
   pair from ``CUT`` on is compared by its sets, which the block holds. One byte of each minimal hash is kept as the
   node's sketch: the share of equal bytes estimates the similarity with a standard deviation of 0.03.
3. Before that, a band with over ``BLOCK`` members outside its largest component is thinned: in blocks of a bounded size, each of its
   members' ``BEST`` partners by estimate are compared by their sets, and what is similar joins the components.

So a group of copies costs a few comparisons per member, not one per pair, as long as it holds together; and no pair that
shares a band and is estimated at ``CUT`` or more is left uncompared unless its ends are connected already. A
pair at 0.8 is estimated below ``CUT`` with a chance of 7 in 10,000.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import arrow_rows, arrow_schema, checkpointed, gathered, keyed_text, let_go, slices
from .components import components

#: Bits between fingerprints whose sets are compared; as many variants as for 3 bits.
RADIUS = 4
BANDS = 32
#: Minimal hashes of a band.
WIDTH = 5
#: Odd factors of the hash functions x -> x * factor modulo 2 ** 64.
FACTORS = np.random.default_rng(42).integers(0, 1 << 64, BANDS * WIDTH, dtype=np.uint64) | np.uint64(1)
#: Shingles whose products are made at a time.
STEP = 1 << 11
#: Partners of a node that are compared first.
BEST = 3
#: The least estimate, below the threshold by its percentage, that makes a pair worth comparing.
CUT = 0.1
#: Members of a band that are estimated against each other at a time, and bytes of their sets, about.
BLOCK = 2_048
BLOCK_BYTES = 8 << 20


def shingles(text: str, words: int) -> np.ndarray:
    """The different shingles' XXH64, sorted; A-Z count as a-z, and a text with fewer words is one shingle."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    n = max(1, len(found) - words + 1)
    return np.unique(np.fromiter((digest(b" ".join(found[i : i + words])) for i in range(n)), dtype=np.uint64, count=n))


def key_of(hashes: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes())).view(np.int64)))


def least_hashes(hashes: np.ndarray) -> np.ndarray:
    least = np.full(len(FACTORS), (1 << 64) - 1, dtype=np.uint64)
    for at in range(0, len(hashes), STEP):
        np.minimum(least, (hashes[at : at + STEP, None] * FACTORS).min(axis=0), out=least)
    return least


def bands_of(hashes: np.ndarray) -> list[int]:
    """A long for each band, none for a text without words."""
    return bands_and_sketch(hashes)[0]


def bands_and_sketch(hashes: np.ndarray) -> tuple[list[int], bytes]:
    if not len(hashes):
        return [], b""
    least = least_hashes(hashes)
    bands = np.array([xxhash.xxh64_intdigest(least[i * WIDTH : (i + 1) * WIDTH].tobytes(), seed=i) for i in range(BANDS)], dtype=np.uint64).view(np.int64).tolist()
    return bands, (least >> np.uint64(40)).astype(np.uint8).tobytes()


def sketches(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_hash, key, n, fp, bands, sketch): Spark's hash of the text, digest, size and SimHash of its set of shingles, its bands and its sketch."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text in rows:
            hashes = shingles(text, words)
            text_hash = np.uint64(xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), 42)).view(np.int64)
            yield doc_id, int(text_hash), key_of(hashes), len(hashes), simhash.signed(simhash.fingerprint_of_set(hashes)), *bands_and_sketch(hashes)

    return arrow_rows(keyed_text(docs, id_col, text_col), "doc_id long, text_hash long, key long, n int, fp long, bands array<long>, sketch binary", run)


def sets_of(texts: DataFrame, words: int) -> DataFrame:
    """(key, n, set) of (doc_id, text): the sorted upper halves of the shingles' hashes, four bytes each.

    Two shingles of a pair with n of them are taken for one with a chance of n ** 2 in 2 ** 33.
    """
    schema = "key long, n int, set binary"
    arrow = arrow_schema(texts.sparkSession, schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for piece in slices(batches):
                for text in piece.column(1).to_pylist():
                    hashes = shingles(text, words)
                    kept = np.unique((hashes >> np.uint64(32)).astype("<u4"))
                    yield key_of(hashes), len(kept), kept.tobytes()

        yield from gathered(rows(), arrow)

    return texts.mapInArrow(work, schema)


def jaccard_of(one: np.ndarray, two: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have a Jaccard similarity of ``percent`` or more."""
    both = int((two[np.minimum(np.searchsorted(two, one), len(two) - 1)] == one).sum()) if len(two) else 0
    return 100 * both >= percent * (len(one) + len(two) - both)


def similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard similarity of ``percent`` or more."""
    a, b = (sets.select(F.col("key").alias(x), F.col("set").alias(f"of_{x}")) for x in "ab")
    arrow = arrow_schema(pairs.sparkSession, "a long, b long")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, 2):
            ok = [jaccard_of(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4"), percent) for x, y in zip(piece.column(2).to_pylist(), piece.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in piece.columns[:2]], schema=arrow)

    return pairs.select("a", "b").join(a, "a").join(b, "b").select("a", "b", "of_a", "of_b").mapInArrow(work, "a long, b long")


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """The rows of each run of equal values in the first ``keys`` columns, as arrays; a binary column as a matrix of bytes, one of lists of one length as a matrix, the last one, if it is named set, as objects."""

    def matrix(column: pa.Array, name: str) -> np.ndarray:
        if name == "set":
            return np.array([*column.to_pylist(), None], dtype=object)[:-1]
        if pa.types.is_list(column.type):
            return column.flatten().to_numpy().reshape(len(column), -1)
        return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)

    held: list[list[np.ndarray]] = []
    for batch in batches:
        columns = [matrix(c, name) if pa.types.is_binary(c.type) or pa.types.is_list(c.type) else c.to_numpy(zero_copy_only=False) for c, name in zip(batch.columns, batch.schema.names, strict=True)]
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for c in columns[:keys]:
            change[1:] |= c[1:] != c[:-1]
        if held:
            change[0] = any(c[0] != h[-1] for c, h in zip(columns[:keys], held[-1][:keys], strict=True))
        cuts = np.flatnonzero(change).tolist()
        for start, stop in zip([0, *[c for c in cuts if c]], [*[c for c in cuts if c], batch.num_rows], strict=True):
            if held and change[start]:
                yield [np.concatenate(c) for c in zip(*held, strict=True)]
                held = []
            held.append([c[start:stop] for c in columns])
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def estimates(one: np.ndarray, all_of: np.ndarray, n: int, sizes: np.ndarray, percent: int) -> np.ndarray:
    """The estimated similarity of one sketch with others; nothing for those whose sizes alone rule it out."""
    found = (all_of == one).mean(axis=1)
    found[100 * np.minimum(n, sizes) < percent * np.maximum(n, sizes)] = 0
    return found


def close_prints(nodes: DataFrame, size: int) -> DataFrame:
    """(a, b), a > b: pairs of about ``size`` nodes that SimHash chooses: of one fingerprint, or of two that meet in a variant and are within RADIUS bits.

    A node stands for its fingerprint, the others are paired with it.
    """
    firsts = nodes.groupBy("fp").agg(F.min("key").alias("first"))
    of_a, of_b = (firsts.select(F.col("fp").alias(x), F.col("first").alias(f"first_{x}")) for x in "ab")
    meet = simhash.links(firsts.select("fp"), radius=RADIUS, size=size, near=True).join(of_a, "a").join(of_b, "b").select(F.col("first_a").alias("a"), F.col("first_b").alias("b"))
    same = nodes.select("key", "fp").join(firsts, "fp").where("key != first").select(F.col("key").alias("a"), F.col("first").alias("b"))
    return meet.unionByName(same).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def best_partners(met: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b), a > b: of each node, the BEST partners by estimate in the blocks of its bands."""
    rows = met.join(nodes.select("key", "sketch"), "key").select("band", F.pmod(F.xxhash64("key"), F.ceil(F.col("size") / BLOCK)).alias("block"), "key", "n", "sketch")
    least = percent / 100 - CUT

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, key, n, sketch in runs(batches, 2):
            a, b, e = [], [], []
            for i in range(len(key) if len(key) > 1 else 0):
                found = estimates(sketch[i], sketch, n[i], n, percent)
                found[i] = 0
                best = np.argsort(-found, kind="stable")[:BEST]
                best = best[found[best] >= least]
                a += [int(key[i])] * len(best)
                b += key[best].tolist()
                e += found[best].tolist()
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(e, pa.float64())], names=["a", "b", "e"])

    found = rows.repartition("band", "block").sortWithinPartitions("band", "block").mapInArrow(work, "a long, b long, e double")
    top = found.groupBy("a").agg(F.slice(F.array_sort(F.collect_set(F.struct((-F.col("e")).alias("e"), "b"))), 1, BEST).alias("best"))
    return top.select("a", F.explode(F.col("best.b")).alias("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def hops(close: DataFrame, times: int = 2) -> DataFrame:
    """(node, component): the end of so many doublings of a chain of least similar nodes, so that nodes of one component here are connected."""
    found = close.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    for _ in range(times):
        up = found.select(F.col("node").alias("component"), F.col("component").alias("up"))
        found = found.join(up, "component", "left").select("node", F.coalesce("up", "component").alias("component"))
    return found


def components_of(met: DataFrame, known: DataFrame) -> DataFrame:
    """The members of bands with their components."""
    return met.join(known.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))


def mixed_bands(named: DataFrame) -> DataFrame:
    """(band, main, most, strangers, bytes) of each band with several components: the largest, its members and all others', and the sets' bytes."""
    counts = named.groupBy("band", "component").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("bytes"))
    of_band = counts.groupBy("band").agg(F.max_by("component", F.struct("m", "component")).alias("main"), F.max("m").alias("most"), (F.sum("m") - F.max("m")).alias("strangers"), (4 * F.sum("bytes")).alias("bytes"))
    return of_band.where("strangers > 0")


def open_pairs(named: DataFrame, mixed: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int, cut: float) -> DataFrame:
    """(a, b), a > b: similar pairs of a band in different components, among those that are estimated to be worth comparing, as a forest per task.

    A block holds its members' sets, so that no pair leaves its task unless it is similar. Blocks are bounded by members and by the sets' bytes.
    """
    rows = named.join(mixed, "band").join(nodes.select("key", "sketch", "bands"), "key").join(sets.select("key", "set"), "key")
    heavy = F.ceil(F.col("bytes") / BLOCK_BYTES)
    outside, blocks = F.greatest(F.ceil(F.col("strangers") / BLOCK), heavy), F.greatest(F.ceil(F.col("size") / BLOCK), heavy)
    block = lambda count: F.pmod(F.xxhash64("key"), count)
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), count - 1))
    left = rows.where(F.col("component") != F.col("main")).withColumn("i", block(outside)).withColumn("j", every(blocks)).withColumn("side", F.lit(0))
    right = rows.withColumn("j", block(blocks)).withColumn("i", every(outside)).withColumn("side", F.lit(1))
    wanted = ["band", "i", "j", "at", "side", "key", "n", "component", "sketch", "bands", "set"]
    least = percent / 100 - cut

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A pair whose components this task has connected already tells nothing new, so links stay fewer than components.
        forest = simhash.Forest()
        for _, _, _, at, side, key, n, component, sketch, bands, members in runs(batches, 3):
            these = np.flatnonzero(side == 1)
            found = [np.frombuffer(x, "<u4") for x in members]
            a, b = [], []
            for i in np.flatnonzero(side == 0).tolist():
                guess = estimates(sketch[i], sketch[these], n[i], n[these], percent)
                open_ = these[(guess >= max(least, 1e-9)) & (component[these] != component[i])]
                # A pair that shares several bands is compared in the first of them only.
                open_ = open_[(bands[open_] == bands[i]).argmax(axis=1) == at[i]] if len(open_) else open_
                for o in open_.tolist():
                    one, two = int(component[i]), int(component[o])
                    if forest.root(one) != forest.root(two) and jaccard_of(found[i], found[o], percent):
                        forest.link(one, two)
                        a.append(int(key[i]))
                        b.append(int(key[o]))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    both = left.select(*wanted).unionByName(right.select(*wanted))
    found = both.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j").mapInArrow(work, "a long, b long")
    return found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def links(docs: DataFrame, nodes: DataFrame, size: int, words: int, percent: int, cut: float, id_col: str, text_col: str) -> DataFrame:
    """(a, b): links of keys that connect all of about ``size`` nodes which a chain of similar nodes connects."""
    members = nodes.select("key", "n", F.posexplode("bands").alias("at", "band"))
    shared = members.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    met = checkpointed(members.join(shared, "band").select("band", "at", "key", "n", "size"), BANDS * size)
    let_go(docs.sparkSession)
    chosen = checkpointed(close_prints(nodes, size), BANDS * size)
    let_go(docs.sparkSession)
    # One text of each node that meets another; a repeated or missing id may bring others, which no pair names.
    meeting = met.select("key").unionByName(chosen.select(F.explode(F.array("a", "b")).alias("key"))).distinct()
    some = nodes.join(meeting, "key", "left_semi").select("least").distinct()
    texts = keyed_text(docs, id_col, text_col)
    sets = checkpointed(sets_of(texts.join(some, texts["doc_id"].eqNullSafe(some["least"]), "left_semi"), words).dropDuplicates(["key"]), BANDS * size)
    let_go(docs.sparkSession)
    close = checkpointed(similar(chosen, sets, percent), BANDS * size)
    let_go(docs.sparkSession)
    named = components_of(met, checkpointed(hops(close), BANDS * size))
    mixed = checkpointed(mixed_bands(named), BANDS * size)
    let_go(docs.sparkSession)
    loose = mixed.where(F.col("strangers") > BLOCK).select("band")
    if not loose.isEmpty():
        partners = best_partners(met.join(loose, "band", "left_semi"), nodes, percent)
        close = checkpointed(close.unionByName(similar(partners, sets, percent)), 2 * BANDS * size)
        named = components_of(met, components(close))
        mixed = checkpointed(mixed_bands(named), BANDS * size)
        let_go(docs.sparkSession)
    return close.unionByName(checkpointed(open_pairs(named, mixed, nodes, sets, percent, cut), BANDS * size))


def classes(docs: DataFrame, words: int, percent: int, cut: float, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, key, component) of every document, and (key, least, component) of every node; component is the key of some member of the class."""
    marked = checkpointed(sketches(docs, words, id_col, text_col))
    size = marked.count()
    let_go(docs.sparkSession)
    nodes = checkpointed(marked.groupBy("key").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), BANDS * size)
    found = components(links(docs, nodes, size, words, percent, cut, id_col, text_col)).withColumnRenamed("node", "key")
    let_go(docs.sparkSession)
    named = lambda rows: rows.join(found, "key", "left").withColumn("component", F.coalesce("component", "key"))
    return named(marked.select("doc_id", "text_hash", "key")), named(nodes.select("key", "least"))


def near_copies(docs: DataFrame, *, words: int = 5, percent: int = 80, cut: float = CUT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, key, component, component_id) of every document; component is the class, by the key of some member, and
    component_id the smallest doc_id that links of ``percent`` reach. With a ``cut`` of 1 all pairs that share a band are compared, whatever their estimate.

    Null, empty and wordless texts are copies of each other. A null doc_id is the component_id only where no other is
    reachable. Repeated rows give repeated results; an empty table gives none; other columns are left aside; a tie between estimates
    goes to the smaller key, and can't change the components of pairs that are compared later anyhow.
    """
    rows, nodes = classes(docs, words, percent, cut, id_col, text_col)
    leasts = nodes.groupBy("component").agg(F.min("least").alias("component_id"))
    return rows.join(leasts, "component").select("doc_id", "text_hash", "key", "component", "component_id")


def keep_first(docs: DataFrame, *, words: int = 5, percent: int = 80, cut: float = CUT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row, with all its columns, of each component: that of the smallest doc_id, rows without one coming last.

    Of rows that share the id, or have none, the one whose text has the smallest hash; of equal rows any one.
    """
    found, _ = classes(docs, words, percent, cut, id_col, text_col)
    best = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "text_hash")).alias("b")).select(F.col("b.doc_id").alias("first_id"), F.col("b.text_hash").alias("first_hash"))
    same = docs[id_col].eqNullSafe(best["first_id"]) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == best["first_hash"])
    return docs.join(best, same, "left_semi").dropDuplicates([id_col, text_col])
