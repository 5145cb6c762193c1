"""TIFF codecs against bytes that other programs' descriptions give, small samples, and the query's own layouts."""

import struct

import numpy as np
import pytest

from tessera.llm import media
from tessera.llm.queries import op4_media_tiff


def bits_of(codes, width=9):
    text = "".join(f"{c:0{width}b}" for c in codes)
    return int(text.ljust(-(-len(text) // 8) * 8, "0"), 2).to_bytes(-(-len(text) // 8), "big")


def test_lzw_example_of_the_specification():
    plain = bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    packed = bits_of([256, 7, 258, 8, 8, 258, 6, 6, 257])
    assert media.lzw_decode(packed) == plain and media.lzw_encode(plain) == packed


def test_packbits_example():
    packed = bytes.fromhex("feaa0280002afdaa0380002a22f7aa")
    plain = bytes.fromhex("aaaaaa80002aaaaaaaaa80002a22" + "aa" * 10)
    assert media.packbits_decode(packed) == plain and media.packbits_encode(plain) == packed


def one_page(width, height, bits, body, *, order=">", samples=1, predictor=1, kind=1):
    """A file written out by hand: one strip, no compression."""
    fields = [(256, width), (257, height), (258, bits), (259, 1), (262, 1), (273, 8), (277, samples), (278, height), (279, len(body)), (317, predictor), (339, kind)]
    out = (b"MM" if order == ">" else b"II") + struct.pack(order + "HI", 42, 8 + len(body)) + body + struct.pack(order + "H", len(fields))
    for tag, value in fields:
        short = tag in (258, 259, 262, 277, 317, 339)
        out += struct.pack(order + "HHI", tag, 3 if short else 4, 1) + (struct.pack(order + "HH", value, 0) if short else struct.pack(order + "I", value))
    return out + bytes(4)


@pytest.mark.parametrize("order", "<>")
def test_predictors_by_hand(order):
    page = next(media.read_pages(one_page(4, 2, 8, bytes([1, 1, 1, 1, 250, 3, 5, 0]), order=order, predictor=2)))
    assert page.pixels[:, :, 0].tolist() == [[1, 2, 3, 4], [250, 253, 2, 2]]
    # 1.0 and 2.0 are 3f800000 and 40000000: the planes 3f 40, 80 00, 00 00, 00 00 as differences.
    page = next(media.read_pages(one_page(2, 1, 32, bytes([0x3F, 0x01, 0x40, 0x80, 0, 0, 0, 0]), order=order, predictor=3, kind=3)))
    assert page.pixels[0, :, 0].tolist() == [1.0, 2.0]


@pytest.mark.parametrize(("bits", "body", "want"), [(1, "a0c0", [[1, 0, 1], [1, 1, 0]]), (2, "e490", [[3, 2, 1], [2, 1, 0]]), (4, "12305670", [[1, 2, 3], [5, 6, 7]])])
def test_small_samples(bits, body, want):
    page = next(media.read_pages(one_page(3, 2, bits, bytes.fromhex(body))))
    assert page.bits == bits and page.pixels[:, :, 0].tolist() == want


def test_query_uses_every_layout(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    layouts = [media.layout_of(media.payload_of(t or "")) for t in texts.values()]
    for part, values in {"compression": 3, "predictor": 2, "tile": 2, "order": 2}.items():
        assert len({x[part] for x in layouts}) == values
    for r in op4_media_tiff(spark, sf).collect():
        payload = media.payload_of(texts[r["doc_id"]] or "")
        assert (r["payload_bytes"], r["payload_sha256"]) == (len(payload), media.hashlib.sha256(payload).hexdigest())
        assert r["media_sha256"] == media.hashlib.sha256(media.store_text(texts[r["doc_id"]] or "")).hexdigest()
