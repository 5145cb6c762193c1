"""TIFF files as table columns: a writer and a reader of pages.

The reader walks the image directories of either byte order, decodes PackBits, LZW and deflate (or plain) strips
and tiles, undoes the horizontal and the floating-point predictor and gives one row per page.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from .common import arrow_rows, keyed_text
from pyspark.sql import functions as F

#: Samples in a row of a stored text; texts are padded to whole rows.
ROW = 576
#: Rows of a page and of a strip of a stored text.
PAGE_ROWS = 4_096
STRIP_ROWS = 512

# Fixed values of the format: tags, field types, compressions.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, SAMPLES, STRIP_HEIGHT, SIZES, PLANAR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_SIZES, FORMAT = 317, 322, 323, 324, 325, 339
RUN = re.compile(rb"(.)\1{2,127}", re.S)
#: Width and height of a text's tiles.
TILE = (192, 16)
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 13: "I"}
PLAIN, LZW, ADOBE_DEFLATE, PACKBITS, DEFLATE = 1, 5, 8, 32773, 32946


@dataclass
class Page:
    number: int
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    pixels: np.ndarray


def packbits_decode(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
                at += 2
            else:
                at += 1
    return bytes(out)


def packbits_encode(data: bytes) -> bytes:
    out, at = bytearray(), 0

    def plain(start: int, stop: int) -> None:
        for i in range(start, stop, 128):
            some = data[i : min(i + 128, stop)]
            out.append(len(some) - 1)
            out.extend(some)

    for run in RUN.finditer(data):
        plain(at, run.start())
        out.extend((257 - (run.end() - run.start()), data[run.start()]))
        at = run.end()
    plain(at, len(data))
    return bytes(out)


def lzw_decode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, highest bit first, one early change of width; 256 clears, 257 ends."""
    table: list[bytes] = []
    out: list[bytes] = []
    width, held, bits = 9, 0, 0
    last = b""
    for byte in data:
        held, bits = (held << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            table = [bytes((i,)) for i in range(256)] + [b"", b""]
            width, last = 9, b""
            continue
        if not table:
            raise ValueError("LZW data must begin with a clear code")
        if not last:
            entry = table[code]
        else:
            if code > len(table):
                raise ValueError("LZW code out of order")
            entry = table[code] if code < len(table) else last + last[:1]
            table.append(last + entry[:1])
        out.append(entry)
        last = entry
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    out, held, bits = bytearray(), 0, 0

    def put(code: int) -> None:
        nonlocal held, bits
        held, bits = (held << width) | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits)
            held &= (1 << bits) - 1

    width = 9
    put(256)
    table = {bytes((i,)): i for i in range(256)}
    size, prefix = 258, b""
    for i in range(len(data)):
        longer = prefix + data[i : i + 1]
        if longer in table:
            prefix = longer
            continue
        put(table[prefix])
        table[longer] = size
        size += 1
        # The reader is one entry behind, so its early change comes at these sizes.
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
        if size == 4094:
            put(256)
            table = {bytes((i,)): i for i in range(256)}
            size, width = 258, 9
        prefix = data[i : i + 1]
    if prefix:
        put(table[prefix])
        size += 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
    put(257)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


def unpack(data: bytes, compression: int) -> bytes:
    if compression == PLAIN:
        return data
    if compression == PACKBITS:
        return packbits_decode(data)
    if compression == LZW:
        return lzw_decode(data)
    if compression in (ADOBE_DEFLATE, DEFLATE):
        return zlib.decompress(data)
    raise ValueError(f"unknown compression {compression}")


def compress(data: bytes, compression: int) -> bytes:
    if compression == PLAIN:
        return data
    if compression == PACKBITS:
        return packbits_encode(data)
    if compression == LZW:
        return lzw_encode(data)
    return zlib.compress(data, 1)


def undo(block: bytes, width: int, height: int, samples: int, dtype: np.dtype, predictor: int) -> np.ndarray:
    """A strip or tile as (height, width, samples), its predictor undone."""
    size = height * width * samples * dtype.itemsize
    block = block[:size].ljust(size, b"\0")
    if predictor == 3:
        # Bytes of a row are differences, and lie plane by plane, the most significant plane first.
        rows = np.cumsum(np.frombuffer(block, np.uint8).reshape(height, -1, samples), axis=1, dtype=np.uint8).reshape(height, dtype.itemsize, width * samples)
        return np.ascontiguousarray(rows.transpose(0, 2, 1)).view(dtype.newbyteorder(">")).reshape(height, width, samples).astype(dtype.newbyteorder("="))
    values = np.frombuffer(block, dtype).reshape(height, width, samples).astype(dtype.newbyteorder("="))
    return np.cumsum(values, axis=1, dtype=values.dtype) if predictor == 2 else values


def read_pages(data: bytes) -> Iterator[Page]:
    """Every page of a TIFF file; raises ValueError for a file that is none or that is broken."""
    if len(data) < 8 or data[:2] not in (b"II", b"MM"):
        raise ValueError("no TIFF file")
    order = "<" if data[:2] == b"II" else ">"
    if struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("no classic TIFF file")
    at, number, seen = struct.unpack_from(order + "I", data, 4)[0], 0, set()
    while at:
        if at in seen or at + 2 > len(data):
            raise ValueError("directories run in a circle or out of the file")
        seen.add(at)
        fields, (count,) = {}, struct.unpack_from(order + "H", data, at)
        for i in range(count):
            tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            if kind not in TYPES:
                continue
            form = order + (f"{n}s" if kind == 2 else TYPES[kind] * n)
            where = at + 2 + 12 * i + 8
            if struct.calcsize(form) > 4:
                where = struct.unpack_from(order + "I", data, where)[0]
            fields[tag] = struct.unpack_from(form, data, where)
        yield page_of(data, fields, order, number)
        number += 1
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * count)[0]


def page_of(data: bytes, fields: dict[int, tuple], order: str, number: int) -> Page:
    one = lambda tag, default: fields.get(tag, (default,))[0]
    width, height, samples, bits = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1), one(BITS, 1)
    compression, predictor = one(COMPRESSION, PLAIN), one(PREDICTOR, 1)
    kind = {1: "u", 2: "i", 3: "f"}.get(one(FORMAT, 1), "u")
    if bits not in (1, 2, 4, 8, 16, 32, 64):
        raise ValueError(f"samples of {bits} bits are not read")
    small, bits = bits if bits < 8 else 0, max(bits, 8)
    if small and predictor != 1:
        raise ValueError(f"no predictor is defined for samples of {small} bits")
    dtype = np.dtype(f"{order}{kind}{bits // 8}")
    planes = samples if one(PLANAR, 1) == 2 else 1
    each = samples // planes
    tiled = TILE_OFFSETS in fields
    wide, high = (one(TILE_WIDTH, 0), one(TILE_HEIGHT, 0)) if tiled else (width, min(one(STRIP_HEIGHT, height), height) or height)
    offsets, sizes = fields[TILE_OFFSETS if tiled else OFFSETS], fields[TILE_SIZES if tiled else SIZES]
    across, down = -(-width // wide), -(-height // high)
    pixels = np.zeros((height, width, samples), dtype.newbyteorder("="))
    for n, (offset, size) in enumerate(zip(offsets, sizes, strict=True)):
        if offset + size > len(data):
            raise ValueError("a strip or tile lies outside the file")
        plane, cell = divmod(n, across * down)
        y, x = cell // across * high, cell % across * wide
        rows = high if tiled else min(high, height - y)
        raw = unpack(data[offset : offset + size], compression)
        block = undo(spread(raw, wide * each, rows, small) if small else raw, wide, rows, each, dtype, predictor)
        pixels[y : y + rows, x : x + wide, plane * each : (plane + 1) * each] = block[: height - y, : width - x]
    return Page(number, width, height, samples, small or bits, compression, pixels)


def spread(block: bytes, values: int, rows: int, bits: int) -> bytes:
    """Samples of 1, 2 or 4 bits, highest first in rows of whole bytes, as a byte each."""
    row = -(-values * bits // 8)
    packed = np.frombuffer(block[: rows * row].ljust(rows * row, b"\0"), np.uint8).reshape(rows, row)
    weights = (1 << np.arange(bits - 1, -1, -1)).astype(np.uint8)
    return (np.unpackbits(packed, axis=1).reshape(rows, -1, bits) * weights).sum(axis=2, dtype=np.uint8)[:, :values].tobytes()


def write_pages(pages: list[np.ndarray], *, compression: int = ADOBE_DEFLATE, predictor: int = 1, strip_rows: int = STRIP_ROWS, tile: tuple[int, int] | None = None, order: str = "<") -> bytes:
    """Pages of shape (height, width) or (height, width, samples) as one TIFF file of strips or tiles (width, height)."""
    out = bytearray(b"II*\0" if order == "<" else b"MM\0*") + bytearray(4)
    link = 4
    for pixels in pages:
        pixels = pixels[:, :, None] if pixels.ndim == 2 else pixels
        height, width, samples = pixels.shape
        dtype = pixels.dtype.newbyteorder(order)
        wide, high = tile or (width, strip_rows)
        offsets, sizes = [], []
        for y in range(0, height, high):
            for x in range(0, width, wide):
                block = pixels[y : y + high, x : x + wide]
                if tile:
                    block = np.pad(block, ((0, high - block.shape[0]), (0, wide - block.shape[1]), (0, 0)))
                if predictor == 2:
                    block = np.concatenate([block[:, :1], np.diff(block, axis=1)], axis=1).astype(pixels.dtype)
                if predictor == 3:
                    planes = np.ascontiguousarray(block.astype(dtype.newbyteorder(">"))).view(np.uint8).reshape(block.shape[0], -1, dtype.itemsize).transpose(0, 2, 1)
                    flat = planes.reshape(block.shape[0], -1, samples)
                    raw = np.concatenate([flat[:, :1], np.diff(flat, axis=1)], axis=1).astype(np.uint8).tobytes()
                else:
                    raw = block.astype(dtype).tobytes()
                packed = compress(raw, compression)
                offsets.append(len(out))
                sizes.append(len(packed))
                out += packed + b"\0" * (len(packed) % 2)
        kind = {"u": 1, "i": 2, "f": 3}[dtype.kind]
        fields = [(WIDTH, 4, (width,)), (HEIGHT, 4, (height,)), (BITS, 3, (dtype.itemsize * 8,) * samples), (COMPRESSION, 3, (compression,)), (PHOTOMETRIC, 3, (1,)), (SAMPLES, 3, (samples,)), (PLANAR, 3, (1,)), (PREDICTOR, 3, (predictor,)), (FORMAT, 3, (kind,) * samples)]
        fields += [(TILE_WIDTH, 4, (wide,)), (TILE_HEIGHT, 4, (high,)), (TILE_OFFSETS, 4, tuple(offsets)), (TILE_SIZES, 4, tuple(sizes))] if tile else [(OFFSETS, 4, tuple(offsets)), (STRIP_HEIGHT, 4, (high,)), (SIZES, 4, tuple(sizes))]
        entries = b""
        for tag, form, values in sorted(fields):
            raw = struct.pack(order + TYPES[form] * len(values), *values)
            if len(raw) > 4:
                where = len(out)
                out += raw + b"\0" * (len(raw) % 2)
                raw = struct.pack(order + "I", where)
            entries += struct.pack(order + "HHI", tag, form, len(values)) + raw.ljust(4, b"\0")
        struct.pack_into(order + "I", out, link, len(out))
        link = len(out) + 2 + len(entries)
        out += struct.pack(order + "H", len(fields)) + entries + b"\0\0\0\0"
    return bytes(out)


def payload_of(text: str) -> bytes:
    """The text's UTF-8, filled with bytes 255 up to a positive multiple of ROW."""
    raw = text.encode("utf-8", "surrogatepass")
    return raw + b"\xff" * (max(ROW, -(-len(raw) // ROW) * ROW) - len(raw))


def layout_of(payload: bytes) -> dict:
    """How a text is laid out if nothing is asked for, by a hash of it, so that equal texts are equal files.

    Five of eight files are deflated, two packed by PackBits, one by LZW; with and without predictor, in strips and tiles, in both byte orders.
    """
    h = hashlib.sha256(payload).digest()[0]
    compression = LZW if h % 8 == 0 else PACKBITS if h % 8 < 3 else ADOBE_DEFLATE
    tile = TILE if h >> 4 & 1 and len(payload) >= ROW * TILE[1] else None
    return {"compression": compression, "predictor": 1 + (h >> 3 & 1), "tile": tile, "order": "<>"[h >> 5 & 1]}


def store_text(text: str, compression: int | None = None, predictor: int | None = None) -> bytes:
    """A text as a TIFF file: ROW samples of 8 bits a row, PAGE_ROWS rows a page, laid out as asked for or else by its hash."""
    payload = payload_of(text)
    layout = layout_of(payload)
    layout |= ({} if compression is None else {"compression": compression}) | ({} if predictor is None else {"predictor": predictor})
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    return write_pages([rows[i : i + PAGE_ROWS] for i in range(0, len(rows), PAGE_ROWS)], **layout)


def features(pixels: np.ndarray) -> str:
    """Numbers of an image in one line: pages' samples, mean, deviation, entropy in bits, share of 255, row change."""
    flat = pixels.reshape(-1)
    counts = np.bincount(flat, minlength=256)
    share = counts[counts > 0] / flat.size
    values = np.arange(256)
    mean = float((counts * values).sum() / flat.size)
    deviation = float(np.sqrt((counts * (values - mean) ** 2).sum() / flat.size))
    entropy = float(-(share * np.log2(share)).sum())
    change = float(np.abs(np.diff(pixels.reshape(len(pixels), -1).astype(np.int16), axis=1)).mean()) if pixels.shape[1] > 1 else 0.0
    return f"n={flat.size};mean={mean:.4f};std={deviation:.4f};entropy={entropy:.4f};fill={counts[255] / flat.size:.4f};change={change:.4f}"


def stored(docs: DataFrame, *, compression: int | None = None, predictor: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media binary): each whole text as a TIFF file. Null and empty texts are one row of 255.

    Repeated rows give repeated files; an empty table gives none; other columns are left aside.
    """

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text in rows:
            yield doc_id, len(text.encode("utf-8", "surrogatepass")), store_text(text, compression, predictor)

    return arrow_rows(keyed_text(docs, id_col, text_col), "doc_id long, n_bytes long, media binary", run)


def pages(media: DataFrame, *, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """A row per page of each file: (doc_id, page, width, height, samples, bits, compression, pixels, error).

    ``pixels`` are the samples in the machine's order. A null file has no pages; a broken one gives one row with
    ``error`` and nothing else (pages before the break are given too).
    """
    schema = "doc_id long, page int, width int, height int, samples int, bits int, compression int, pixels binary, error string"

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, data in rows:
            if data is None:
                continue
            try:
                for p in read_pages(data):
                    yield doc_id, p.number, p.width, p.height, p.samples, p.bits, p.compression, p.pixels.tobytes(), None
            except (ValueError, KeyError, struct.error, zlib.error, IndexError) as e:
                yield doc_id, None, None, None, None, None, None, None, str(e)

    return arrow_rows(media.select(F.col(id_col).alias("doc_id"), F.col(media_col).alias("media")), schema, run)


def text_media(docs: DataFrame, *, compression: int | None = None, predictor: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text stored, read back and described, without moving the files: one row per text.

    (doc_id, n_bytes, n_pages, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature): the
    payload is what the reader gives, the media the stored file. Equal texts have equal values.
    """
    schema = "doc_id long, n_bytes long, n_pages int, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text in rows:
            media = store_text(text, compression, predictor)
            read = [p.pixels for p in read_pages(media)]
            samples = np.concatenate(read)[:, :, 0]
            payload = samples.tobytes()
            yield doc_id, len(text.encode("utf-8", "surrogatepass")), len(read), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), features(samples)

    return arrow_rows(keyed_text(docs, id_col, text_col), schema, run)
