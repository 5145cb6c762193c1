"""Exact removal of repeated byte strings, by suffix arrays over the places where repeats can be.

A document loses every byte covered by a string of ``window`` bytes that also starts in a document with a smaller id.
Every such string has an anchor: the start, within it, of the seed (a shorter string) with the least hash. Equal
strings have equal anchors, so the search runs by anchors, in blocks of texts:

1. Blocks send the hashes of their seeds, reducers say which occur twice or more. All else is no repeat.
2. For these, the context (all bytes of the strings that the anchor stands for) is hashed. Of equal contexts, all
   but those of the smallest document are repeats as a whole; a seed with one context needs nothing more. What a block has found out
   about its repeated seeds goes along, so that later rounds need not look for anchors again.
3. Contexts of a seed that has several are sorted: those that share what stands left of the seed, or right of it,
   as far as a repeat must, are joined to one text, whose suffix array brings equal strings together.
4. Blocks delete what is covered.

Blocks send packed arrays, one entry per different content, so that a passage in a third of all documents is one
entry per block. A seed with more contexts than ``crowd`` in all, or ``LOCAL_CROWD`` in a block, is a hot key and would make a long
text in one task; its strings are dealt one by one instead, by 128-bit hashes, each once per block. The outcome is the same.

Blocks and buckets both grow with the square root of the input beyond a gigabyte, up to ``MOST_SCALE`` times, so the rows
that blocks send per byte of input, (input / bucket) / block, stay as they are up to 256 GB. Beyond, rows get shorter: at 100 TB a
row holds two or three seeds of a block, and seeds take some 1.6 times the input in the shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, record_batch
from .suffix_array import flat_suffix_arrays, stretches, suffix_array

WINDOW = 50
#: Text of a block and of a bucket, for inputs of up to BASE_BYTES.
BLOCK_BYTES = 1 << 20
BUCKET_BYTES = 16 << 20
BASE_BYTES = 1 << 30
MOST_SCALE = 16.0
#: Different contexts of a seed that are joined to one text at most.
CROWD = 128
LOCAL_CROWD = 64
#: Bytes handled at a time within a block, for very long texts.
SLICE = 1 << 20
#: Letters sorted in step at most, and how many times its longest text a batch must have for that to pay.
CELLS = 1 << 20
IN_STEP = 64
#: Stands for a null id, so that such rows come after all others.
NO_ID = (1 << 63) - 1

SEEDS, CONTEXTS, STRINGS, MASKS, SINGLES, SINGLE_MARKS, OWN = range(7)
U8 = np.uint64
# Odd 64-bit numbers with evenly spread bits, for mixing.
M1, M2, M3 = (U8(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
STATE_NEW, STATE_REPEAT, STATE_SORT, STATE_SINGLE = range(4)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U8(31))
    x = x * M2
    return x ^ (x >> U8(29))


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def polynomial(table_seed: int) -> np.ndarray:
    return np.random.default_rng(table_seed).integers(1, 1 << 64, 256, dtype=np.uint64) | U8(1)


BYTE_A, BYTE_B = polynomial(11), polynomial(12)
BASE_A, BASE_B = 0x2545F4914F6CDD1D, 0x9E6C63D0876A9A75
POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of a base and of its inverse, kept by a worker for slices of the usual length."""
    found = POWERS.get(base)
    if found is None or len(found[0]) < n:
        least = max(n, SLICE + 256)
        up, down = np.full(least, U8(base)), np.full(least, U8(pow(base, -1, 1 << 64)))
        up[0] = down[0] = 1
        found = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        if least == SLICE + 256:
            POWERS[base] = found
    return found


class Ranges:
    """Hashes of any byte ranges of a buffer, from prefix sums of a polynomial."""

    def __init__(self, data: np.ndarray, table: np.ndarray, base: int) -> None:
        n = len(data)
        up, self.down = powers(base, n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(table[data] * up[:n], out=self.sums[1:], dtype=np.uint64)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        # Scaled down to the range's own powers, so that equal bytes have equal hashes wherever they stand.
        value = (self.sums[end] - self.sums[start]) * self.down[start]
        return mixed(value * M1 + (end - start).astype(np.uint64) * M3)


def in_slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray, base: int) -> np.ndarray:
    """Hashes of ranges with ascending starts, none much longer than two windows, slice by slice."""
    out = np.zeros(len(starts), np.uint64)
    for low in range(0, len(data), SLICE):
        a, b = np.searchsorted(starts, [low, low + SLICE])
        if a < b:
            high = int(ends[a:b].max())
            out[a:b] = Ranges(data[low:high], table, base).of(starts[a:b] - low, ends[a:b] - low)
    return out


def seed_hashes(words: Sequence[np.ndarray], seed: int) -> np.ndarray:
    """Hashes of seeds, given the eight bytes from each of the places 0, 8, ... within them, the last ones at their end."""
    h = words[0] * M1
    at = 8
    for word in words[1:]:
        h ^= h >> U8(29)
        h = (h + word) * (M2 if at % 16 else M3)
        at += 8
    return mixed(h)


class Block:
    """The texts of a block as one buffer, in the order of their ids; rows with one id and text stay beside one another."""

    def __init__(self, ids: np.ndarray | list[int], texts: pa.Array | list[bytes], window: int) -> None:
        ids, texts = np.asarray(ids, np.int64), texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_binary())
        self.order = order = pa.compute.sort_indices(pa.table({"i": ids, "t": texts}), [("i", "ascending"), ("t", "ascending")]).to_numpy()
        self.window, self.seed = window, window // 2 - 1
        self.steps = [min(at, self.seed - 8) for at in range(0, self.seed, 8)]
        self.ids = ids[order]
        joined = texts.take(pa.array(order))
        self.sizes = pa.compute.binary_length(joined).to_numpy(zero_copy_only=False).astype(np.int64)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        offsets = np.frombuffer(joined.buffers()[1], np.int64, count=joined.offset + len(joined) + 1) if len(joined) else np.zeros(1, np.int64)
        body = joined.buffers()[2] if len(joined) else None
        self.data = np.frombuffer(body, np.uint8)[offsets[joined.offset] : offsets[-1]] if body is not None and offsets[-1] else np.zeros(0, np.uint8)

    def words(self, low: int, n: int) -> np.ndarray:
        """The eight bytes from each of n places on, as numbers."""
        return np.ndarray(shape=(n,), dtype="<u8", buffer=self.data[low : low + n + 7], strides=(1,))

    def anchors(self) -> tuple[np.ndarray, ...]:
        """For each anchor: its place, its seed's hash, first and last start of its strings."""
        parts = [self._anchors(a, min(a + SLICE, len(self.data))) for a in range(0, len(self.data), SLICE)]
        return tuple(np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, kind) for k, kind in enumerate((np.int64, np.uint64, np.int64, np.int64)))

    def _anchors(self, low: int, high: int) -> tuple[np.ndarray, ...]:
        """Anchors of strings that start in low..high-1; their contexts end within the next window."""
        window, seed = self.window, self.seed
        n = min(high + window - 1, len(self.data)) - low
        # Strings that run over the end of a document are none.
        starts, ends = np.maximum(self.starts, low), np.minimum(self.ends - window + 1, high)
        ok = stretches((starts - low)[ends > starts], (ends - low)[ends > starts])
        if not len(ok):
            return tuple(np.zeros(0, kind) for kind in (np.int64, np.uint64, np.int64, np.int64))
        words, count = self.words(low, n - 7), n - seed + 1
        h = seed_hashes([words[step : step + count] for step in self.steps], seed)
        place_bits = U8((1 << 24) - 1)
        ranked = (h & ~place_bits) | np.arange(count, dtype=np.uint64)
        anchor = (sliding_least(ranked, window - seed + 1)[ok] & place_bits).astype(np.int64)
        cut = np.flatnonzero((anchor[1:] != anchor[:-1]) | (ok[1:] != ok[:-1] + 1)) + 1
        first, last = ok[np.concatenate([[0], cut])], ok[np.concatenate([cut - 1, [len(ok) - 1]])]
        place = anchor[np.concatenate([[0], cut])]
        # Anchors have small hashes; mixed again, they spread evenly.
        return place + low, mixed(h[place] * M2), first + low, last + low

    def hashes_at(self, place: np.ndarray) -> np.ndarray:
        words = self.words(0, max(0, len(self.data) - 7))
        return mixed(seed_hashes([words[place + step] for step in self.steps], self.seed) * M2)

    def context(self, place: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        return in_slices(self.data, first, last + self.window, BYTE_A, BASE_A) ^ (place - first).astype(np.uint64) * M3

    def doc(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, place, side="right")


class Known:
    """A block's anchors with repeated seeds, and their entries: different contexts, in the order of seed and context.

    ``entry`` is each anchor's entry, ``heads`` an anchor of the smallest document for each entry.
    """

    def __init__(self, block: Block, place: np.ndarray, first: np.ndarray, last: np.ndarray, entry: np.ndarray) -> None:
        self.place, self.first, self.last, self.entry = place, first, last, entry
        # Anchors stand in the order of documents, so an entry's first one is of its smallest.
        self.heads = np.unique(entry, return_index=True)[1]
        self.docs = block.doc(place)

    def packed(self) -> bytes:
        """Ten bytes an anchor, half of them zeros."""
        return planes(np.diff(self.first, prepend=0), "<u4") + planes(self.entry, "<u4") + raw(self.last - self.first, "u1") + raw(self.place - self.first, "u1")

    @classmethod
    def unpacked(cls, block: Block, data: bytes) -> Known:
        n = len(data) // 10
        first, entry = np.cumsum(unplaned(data[: 4 * n], "<u4"), dtype=np.int64), unplaned(data[4 * n : 8 * n], "<u4").astype(np.int64)
        span, place = np.frombuffer(data, "u1", offset=8 * n).astype(np.int64).reshape(2, n)
        return cls(block, first + place, first, first + span, entry)


def local_crowds(hashes: np.ndarray) -> np.ndarray:
    """Which entries (sorted by hash) belong to a seed with many contexts in this block."""
    if not len(hashes):
        return np.zeros(0, bool)
    _, of, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    return counts[of] > LOCAL_CROWD


def raw(x: np.ndarray, kind: str = "<u8") -> bytes:
    return np.ascontiguousarray(x).astype(kind).tobytes()


def planes(x: np.ndarray, kind: str) -> bytes:
    """Numbers as all their first bytes, then all their second ones, and so on: small numbers' zeros compress in the shuffle."""
    numbers = np.ascontiguousarray(x).astype(kind)
    return numbers.view("u1").reshape(-1, numbers.itemsize).T.tobytes()


def unplaned(data: bytes, kind: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, "u1").reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


class Job:
    """The stages' functions for one number of buckets; everything a block sends is rows (bucket, block, kind, data...)."""

    SCHEMA = "bucket int, block int, kind byte, a binary, b binary, c binary, d binary"

    def __init__(self, buckets: int, window: int, crowd: int) -> None:
        self.buckets, self.window, self.crowd = buckets, window, crowd

    def block(self, table: pa.Table) -> Block:
        table = table.combine_chunks()
        texts = table.column("text").cast(pa.large_binary())
        return Block(table.column("doc_id").to_numpy(), texts.chunk(0) if texts.num_chunks == 1 else pa.concat_arrays(texts.chunks), self.window)

    def dealt(self, keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """For each bucket, the places of its keys; the buckets are equal stretches of all keys."""
        bucket = ((keys >> U8(32)) * U8(self.buckets) >> U8(32)).astype(np.int64)
        order = np.arange(len(keys)) if (bucket[1:] >= bucket[:-1]).all() else np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order])) + 1
        for part in np.split(order, cuts) if len(order) else ():
            yield int(bucket[part[0]]), part

    def gathered(self, keys: np.ndarray, answers: dict[int, bytes], kind: str) -> np.ndarray:
        """The reducers' answers in the order of the keys."""
        out = np.zeros(len(keys), kind)
        for bucket, part in self.dealt(keys):
            if bucket in answers:
                out[part] = np.frombuffer(answers[bucket], kind)
        return out

    # What a block knows after each round of answers.

    def known(self, block: Block, seeds: dict[int, bytes]) -> tuple[Known, np.ndarray, np.ndarray]:
        """The anchors with repeated seeds, and the entries' seeds and contexts."""
        place, hashes, first, last = block.anchors()
        found, of, counts = np.unique(hashes, return_inverse=True, return_counts=True)
        at = np.flatnonzero(((self.gathered(found, seeds, "u1") > 0) | (counts > 1))[of])
        place, hashes, first, last = place[at], hashes[at], first[at], last[at]
        contexts = block.context(place, first, last)
        order = np.lexsort((contexts, hashes))
        h, c = hashes[order], contexts[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])]) if len(order) else np.zeros(0, bool)
        entry = np.empty(len(at), np.int64)
        entry[order] = np.cumsum(new) - 1
        return Known(block, place, first, last, entry), h[new], c[new]

    def states(self, block: Block, answers: dict[int, dict[int, bytes]]) -> tuple[Known, np.ndarray, np.ndarray]:
        """The anchors, and the entries' seeds and states."""
        known = Known.unpacked(block, next(iter(answers.get(OWN, {}).values()), b""))
        hashes = block.hashes_at(known.place[known.heads])
        crowded = local_crowds(hashes)
        state = np.full(len(hashes), STATE_SINGLE, "u1")
        state[~crowded] = self.gathered(hashes[~crowded], answers.get(CONTEXTS, {}), "u1")
        return known, hashes, state

    def singles(self, known: Known, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The strings of some anchors one by one: (start, document)."""
        first, end = known.first[anchors], known.last[anchors] + 1
        return stretches(first, end), np.repeat(known.docs[anchors], end - first)

    def single_entries(self, block: Block, known: Known, state: np.ndarray) -> tuple[np.ndarray, ...]:
        """Different strings of crowded seeds: (hash, second hash, first document, string starts, entry of each)."""
        starts, docs = self.singles(known, np.flatnonzero(state[known.entry] == STATE_SINGLE))
        if not len(starts):
            none = np.zeros(0, np.uint64)
            return none, none, starts, starts, starts
        a, b = (in_slices(block.data, starts, starts + self.window, table, base) for table, base in ((BYTE_A, BASE_A), (BYTE_B, BASE_B)))
        order = np.lexsort((docs, b, a))
        new = np.concatenate([[True], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])])
        of = np.empty(len(starts), np.int64)
        of[order] = np.cumsum(new) - 1
        heads = order[new]
        return a[heads], b[heads], docs[heads], starts, of

    # Blocks to reducers.

    def send_seeds(self, block: Block, number: int, _: dict) -> Iterator[tuple]:
        seeds = np.unique(block.anchors()[1])
        for bucket, part in self.dealt(seeds):
            # How far into its bucket a seed is, in four bytes, tells them apart well enough: a wrong yes only costs time.
            within = ((seeds[part] >> U8(24)) * U8(self.buckets) >> U8(8)) & U8(0xFFFFFFFF)
            yield bucket, number, SEEDS, planes(np.diff(within.astype(np.int64), prepend=0), "<u4"), None, None, None

    def send_contexts(self, block: Block, number: int, answers: dict) -> Iterator[tuple]:
        known, hashes, contexts = self.known(block, answers.get(SEEDS, {}))
        if len(known.place):
            yield number % self.buckets, number, OWN, known.packed(), None, None, None
        crowded = local_crowds(hashes)
        marks = np.unique(hashes[crowded])
        ids = block.ids[known.docs[known.heads]]
        rest = ~crowded
        keys = np.concatenate([hashes[rest], marks])
        context = np.concatenate([contexts[rest], np.zeros(len(marks), np.uint64)])
        doc = np.concatenate([ids[rest], np.zeros(len(marks), np.int64)])
        marked = np.concatenate([np.zeros(rest.sum(), "u1"), np.ones(len(marks), "u1")])
        for bucket, part in self.dealt(keys):
            yield bucket, number, CONTEXTS, raw(keys[part]), raw(context[part]), planes(doc[part], "<i8"), np.packbits(marked[part]).tobytes() if marked[part].any() else None

    def send_strings(self, block: Block, number: int, answers: dict) -> Iterator[tuple]:
        known, hashes, state = self.states(block, answers)
        sort = np.flatnonzero(state == STATE_SORT)
        for bucket, part in self.dealt(hashes[sort]):
            anchors = known.heads[sort[part]]
            first, end, place = known.first[anchors], known.last[anchors] + self.window, known.place[anchors]
            shape = np.column_stack([end - first, place - first])
            yield bucket, number, STRINGS, raw(hashes[sort[part]]), raw(shape, "<u2"), planes(block.ids[known.docs[anchors]], "<i8"), block.data[stretches(first, end)].tobytes()
        a, b, docs, _, _ = self.single_entries(block, known, state)
        for bucket, part in self.dealt(a):
            yield bucket, number, SINGLES, raw(a[part]), raw(b[part]), planes(block.ids[docs[part]], "<i8"), None

    # Reducers' answers, in the order in which they were asked.

    def answer_seeds(self, rows: list[dict]) -> Iterator[tuple]:
        sizes = [len(r["a"]) // 4 for r in rows]
        keys = np.concatenate([np.cumsum(unplaned(r["a"], "<u4"), dtype=np.uint32) for r in rows])
        order = np.argsort(keys)
        same = keys[order][1:] == keys[order][:-1]
        twice = np.zeros(len(keys), "u1")
        twice[order[1:][same]] = 1
        twice[order[:-1][same]] = 1
        at = 0
        for r, n in zip(rows, sizes, strict=True):
            yield r["bucket"], r["block"], SEEDS, twice[at : at + n].tobytes(), None, None, None
            at += n

    def answer_contexts(self, rows: list[dict]) -> Iterator[tuple]:
        for r in rows:
            if r["kind"] == OWN:
                yield r["bucket"], r["block"], OWN, r["a"], None, None, None
        rows = [r for r in rows if r["kind"] == CONTEXTS]
        if not rows:
            return
        sizes = [len(r["a"]) // 8 for r in rows]
        h, c = (np.frombuffer(b"".join(r[k] for r in rows), "<u8") for k in "ab")
        doc = np.concatenate([unplaned(r["c"], "<i8") for r in rows])
        mark = np.concatenate([np.unpackbits(np.frombuffer(r["d"], "u1"), count=n) if r["d"] else np.zeros(n, "u1") for r, n in zip(rows, sizes, strict=True)])
        order = np.lexsort((doc, c, h))
        hs, cs, ds = h[order], c[order], doc[order]
        new_h = np.concatenate([[True], hs[1:] != hs[:-1]])
        new_c = new_h | np.concatenate([[True], cs[1:] != cs[:-1]])
        of_h, of_c = np.cumsum(new_h) - 1, np.cumsum(new_c) - 1
        kinds = np.bincount(of_h, weights=new_c)
        crowded = (np.bincount(of_h, weights=mark[order]) > 0) | (kinds > self.crowd)
        state = np.where(crowded[of_h], STATE_SINGLE, np.where(ds > ds[new_c][of_c], STATE_REPEAT, np.where(kinds[of_h] > 1, STATE_SORT, STATE_NEW)))
        out = np.empty(len(h), "u1")
        out[order] = state
        at = 0
        for r, n in zip(rows, sizes, strict=True):
            kept = out[at : at + n][mark[at : at + n] == 0]
            at += n
            yield r["bucket"], r["block"], CONTEXTS, kept.tobytes(), None, None, None

    def answer_strings(self, rows: list[dict]) -> Iterator[tuple]:
        strings, singles = [r for r in rows if r["kind"] == STRINGS], [r for r in rows if r["kind"] == SINGLES]
        if strings:
            h = np.frombuffer(b"".join(r["a"] for r in strings), "<u8")
            shape = np.frombuffer(b"".join(r["b"] for r in strings), "<u2").reshape(-1, 2).astype(np.int64)
            doc = np.concatenate([unplaned(r["c"], "<i8") for r in strings])
            masks = shared_strings(h, shape[:, 0], shape[:, 1], doc, b"".join(r["d"] for r in strings), self.window)
            at = 0
            for r in strings:
                n = len(r["a"]) // 8
                yield r["bucket"], r["block"], MASKS, raw(masks[at : at + n]), None, None, None
                at += n
        if singles:
            a, b = (np.frombuffer(b"".join(r[k] for r in singles), "<u8") for k in "ab")
            doc = np.concatenate([unplaned(r["c"], "<i8") for r in singles])
            order = np.lexsort((doc, b, a))
            new = np.concatenate([[True], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])])
            repeat = np.zeros(len(a), "u1")
            repeat[order] = doc[order] > doc[order][new][np.cumsum(new) - 1]
            at = 0
            for r in singles:
                n = len(r["a"]) // 8
                yield r["bucket"], r["block"], SINGLE_MARKS, repeat[at : at + n].tobytes(), None, None, None
                at += n

    def covered(self, block: Block, answers: dict) -> np.ndarray:
        """Which bytes of a block go."""
        known, hashes, state = self.states(block, answers)
        change = np.zeros(len(block.data) + 1, np.int32)
        entry = known.entry
        own = block.ids[known.docs]
        # Within the block, other documents than the entry's first repeat its context.
        later = own > own[known.heads[entry]]
        whole = np.flatnonzero((state[entry] == STATE_REPEAT) | (later & (state[entry] != STATE_SINGLE)))
        np.add.at(change, known.first[whole], 1)
        np.add.at(change, known.last[whole] + self.window, -1)
        sort = np.flatnonzero(state == STATE_SORT)
        masks = np.zeros(len(state), np.uint64)
        masks[sort] = self.gathered(hashes[sort], answers.get(MASKS, {}), "<u8")
        partly = np.flatnonzero(masks[entry] > 0)
        starts, _ = self.singles(known, partly)
        counts = known.last[partly] - known.first[partly] + 1
        shift = starts - np.repeat(known.first[partly], counts)
        bits = np.repeat(masks[entry[partly]], counts)
        starts = starts[(bits >> shift.astype(np.uint64)) & U8(1) > 0]
        np.add.at(change, starts, 1)
        np.add.at(change, starts + self.window, -1)
        a, _, docs, starts, of = self.single_entries(block, known, state)
        if len(a):
            repeat = self.gathered(a, answers.get(SINGLE_MARKS, {}), "u1")
            starts = starts[(repeat[of] > 0) | (block.ids[block.doc(starts)] > block.ids[docs[of]])]
            np.add.at(change, starts, 1)
            np.add.at(change, starts + self.window, -1)
        return np.cumsum(change[:-1]) > 0


def shared_strings(hashes: np.ndarray, sizes: np.ndarray, places: np.ndarray, docs: np.ndarray, body: bytes, window: int) -> np.ndarray:
    """For each context, a bit for each of its strings that a context of a smaller document has too.

    A repeated string holds the seed and half of the other bytes, left or right of it, at least; so contexts are
    brought together by the seed with what stands left of it, and again with what stands right of it.
    """
    seed = window // 2 - 1
    side = (window - seed) // 2
    ends = np.cumsum(sizes)
    starts = ends - sizes
    data = np.frombuffer(body, np.uint8)
    ranges = Ranges(data, BYTE_A, BASE_A)
    masks = np.zeros(len(hashes), np.uint64)
    at = starts + places
    for ok, low, high in ((places >= side, at - side, at), (sizes - places - seed >= side, at + seed, at + seed + side)):
        some = np.flatnonzero(ok)
        if not len(some):
            continue
        keys = ranges.of(low[some], high[some]) ^ hashes[some] * M1
        order = np.argsort(keys, kind="stable")
        cut = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1], [True]]))
        groups = [some[order[a:b]] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True) if b - a > 1]
        groups = [g for g in groups if docs[g].min() < docs[g].max()]
        lengths = np.array([sizes[g].sum() for g in groups], np.int64)
        held: list[np.ndarray] = []
        letters = 0
        for k in np.argsort(lengths, kind="stable").tolist():
            held.append(groups[k])
            letters += int(lengths[k])
            if letters > CELLS:
                mark(held, starts, ends, docs, data, window, masks)
                held, letters = [], 0
        if held:
            mark(held, starts, ends, docs, data, window, masks)
    return masks


def mark(groups: list[np.ndarray], starts: np.ndarray, ends: np.ndarray, docs: np.ndarray, data: np.ndarray, window: int, masks: np.ndarray) -> None:
    """Sorts each group's joined contexts and sets the bits of strings that are equal to one of a smaller document."""
    texts = [data[stretches(starts[g], ends[g])].tobytes() for g in groups]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    if lengths.sum() < IN_STEP * lengths.max():
        bases = (np.cumsum(lengths) - lengths).tolist()
        flat = np.concatenate([np.array(suffix_array(t), np.int64) + b for t, b in zip(texts, bases, strict=True)])
    else:
        flat, lengths = flat_suffix_arrays(texts)
    # For each letter of a text: which context it is in, and where in the body.
    members = np.concatenate(groups)
    counts = ends[members] - starts[members]
    of = np.repeat(members, counts)
    inner = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
    row = np.repeat(np.arange(len(texts)), lengths)
    full = inner + window <= np.repeat(counts, counts)
    flat, row = flat[full[flat]], row[full[flat]]
    context, shift = of[flat], inner[flat]
    place = starts[context] + shift
    if not len(place):
        return
    windows = np.lib.stride_tricks.sliding_window_view(data, window)
    same = np.zeros(len(place), bool)
    for a in range(0, len(place) - 1, 1 << 17):
        b = min(a + (1 << 17), len(place) - 1)
        same[a + 1 : b + 1] = (windows[place[a + 1 : b + 1]] == windows[place[a:b]]).all(axis=1) & (row[a + 1 : b + 1] == row[a:b])
    run = np.cumsum(~same) - 1
    least = np.minimum.reduceat(docs[context], np.flatnonzero(~same))
    hit = docs[context] > least[run]
    np.bitwise_or.at(masks, context[hit], U8(1) << shift[hit].astype(np.uint64))


Finish = Callable[[int | None, bytes, np.ndarray], tuple]


def kept_text(doc_id: int | None, data: bytes, gone: np.ndarray) -> tuple:
    """(doc_id, text): what is left, without bytes that a cut through a letter leaves."""
    if not gone.any():
        return doc_id, data.decode("utf-8", errors="ignore")
    return doc_id, np.frombuffer(data, np.uint8)[~gone].tobytes().decode("utf-8", errors="ignore")


def digest(doc_id: int | None, data: bytes, gone: np.ndarray) -> tuple:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    if not gone.any():
        return doc_id, len(data), 0, 0, hashlib.sha256(data).hexdigest()
    edge = np.diff(np.concatenate([[0], gone.astype(np.int8)]))
    return doc_id, len(data), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(np.frombuffer(data, np.uint8)[~gone].tobytes()).hexdigest()


def remove_repeats(docs: DataFrame, finish: Finish = kept_text, columns: str = "doc_id long, text string", *, carry: Sequence[str] = (), window: int = WINDOW, crowd: int = CROWD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What ``finish(doc_id, utf-8 bytes, removed)`` gives for every document, by default its remaining text.

    The values of the columns ``carry`` follow in each row. Strings are judged on the input, not on what is left, and never run over a document's end. Null and empty texts
    and texts shorter than ``window`` lose nothing. Rows that share a doc_id don't remove one another's bytes; rows
    without one count as one document after all others. Of equal strings in documents with different ids, ties can't arise.
    An empty table gives no rows; other columns are left aside. ``window`` is 34 to 128.
    """
    if not 34 <= window <= 128:
        raise ValueError("window must be 34 to 128")
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(id_col), F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"), *(F.col(c).alias(f"carried_{i}") for i, c in enumerate(carry)))
    total = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    scale = min(MOST_SCALE, max(1.0, (total / BASE_BYTES) ** 0.5))
    blocks = int(max(1, -(-total // (BLOCK_BYTES * scale))))
    buckets = int(max(8, -(-total // (BUCKET_BYTES * scale))))
    job = Job(buckets, window, crowd)
    # By id and text, so that rows without an id are dealt over all blocks.
    dealt = texts.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
    rows = arrow_schema(spark, Job.SCHEMA)
    final = arrow_schema(spark, columns)

    def answers_of(table: pa.Table) -> dict[int, dict[int, bytes]]:
        out: dict[int, dict[int, bytes]] = {}
        for kind, bucket, data in zip(*(table.column(c).to_pylist() for c in ("kind", "bucket", "a")), strict=True):
            out.setdefault(kind, {})[bucket] = data
        return out

    def as_table(found: list[tuple], schema: pa.Schema) -> pa.Table:
        return pa.Table.from_batches([record_batch(found, schema)] if found else [], schema)

    def ask(send: Callable, answers: DataFrame | None) -> DataFrame:
        if answers is None:
            return dealt.groupBy("block").applyInArrow(lambda t: as_table(list(send(job.block(t), t.column("block")[0].as_py(), {})), rows), Job.SCHEMA)

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            return as_table(list(send(job.block(left), left.column("block")[0].as_py(), answers_of(right))) if left.num_rows else [], rows)

        return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, Job.SCHEMA)

    def answer(asked: DataFrame, reply: Callable) -> DataFrame:
        def run(table: pa.Table) -> pa.Table:
            return as_table(list(reply(table.to_pylist())), rows)

        return asked.groupBy("bucket").applyInArrow(run, Job.SCHEMA)

    seeds = answer(ask(job.send_seeds, None), job.answer_seeds)
    contexts = answer(ask(job.send_contexts, seeds), job.answer_contexts)
    strings = answer(ask(job.send_strings, contexts), job.answer_strings)

    def last(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return as_table([], final)
        block = job.block(left)
        gone = job.covered(block, answers_of(right))
        carried = list(zip(*(left.column(f"carried_{i}").to_pylist() for i in range(len(carry))), strict=True)) or [()] * len(block.order)
        spans = zip(block.ids.tolist(), block.starts.tolist(), block.ends.tolist(), block.order.tolist(), strict=True)
        return as_table([(*finish(None if i == NO_ID else i, block.data[a:b].tobytes(), gone[a:b]), *carried[n]) for i, a, b, n in spans], final)

    return dealt.groupBy("block").cogroup(contexts.unionByName(strings).groupBy("block")).applyInArrow(last, columns)
