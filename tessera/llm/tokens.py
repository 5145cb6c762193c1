"""Token ids of whole texts, exactly as the tokenizers library gives them, with a bounded cache of chunks.

Pre-tokenizers cut a text before they merge. Where the cuts at white space are known from the tokenizer's own
settings, a text is cut there, and each chunk's ids are kept: a chunk has the same ids wherever it stands.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Callable, Sequence
from functools import lru_cache

import numpy as np
import regex
import tiktoken
from tokenizers import Tokenizer, models, pre_tokenizers

#: Chunks kept by a worker; about 200 bytes each.
CACHE_CHUNKS = 200_000
#: Longer chunks are not kept.
CACHE_CHARS = 48
#: Python's white space holds these four; the tokenizers' patterns don't.
SEPARATORS = "\x1c\x1d\x1e\x1f"

#: Fixed value: the pattern of byte-level tokenizers.
BYTE_LEVEL_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The normalizers and the pattern under which white space only separates.
SPACE_BLIND_NORMALIZERS = {"NFC", "Replace", "Lowercase"}
SPACE_BLIND_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def cutting(spec: dict) -> str:
    """How texts may be cut into chunks: 'byte_level', 'spaces' or 'whole', from the tokenizer's settings."""
    norm, pre = spec.get("normalizer"), spec.get("pre_tokenizer") or {}
    if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
        return "byte_level"
    steps = pre.get("pretokenizers") or []
    kinds = {x["type"] for x in (norm or {}).get("normalizers", [])}
    if steps and steps[0]["type"] == "Split" and steps[0]["pattern"].get("Regex") == SPACE_BLIND_PATTERN and steps[0]["invert"] and steps[0]["behavior"] == "Removed" and kinds <= SPACE_BLIND_NORMALIZERS:
        return "spaces"
    return "whole"


def merge_rules(spec: dict) -> list[tuple[str, str]]:
    return [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]


def rank_encoder(spec: dict, pattern: str, word_end: bytes = b"") -> tuple[tiktoken.Encoding, list[int]] | None:
    """The merges as an encoder by ranks, and the id of each rank; None if the settings are of another kind.

    It merges any neighbours whose joint bytes have the lowest rank, where the library merges the neighbours that a rule
    names. When no lower rank is left, the bytes of a rule's token can only stand as the two parts that the rule
    names, so both agree. A word's end is a byte that no text has, joined to the word's last byte before all else.
    """
    model = spec["model"]
    if model.get("dropout") or model.get("ignore_merges") or model.get("byte_fallback") or model.get("fuse_unk"):
        return None
    vocab, back = model["vocab"], {c: b for b, c in enumerate(byte_letters())}
    suffix = model.get("end_of_word_suffix") or ""

    def raw(token: str) -> bytes:
        ends = bool(suffix) and token.endswith(suffix)
        return bytes(back[c] for c in (token[: -len(suffix)] if ends else token)) + (word_end if ends else b"")

    ranks: dict[bytes, int] = {bytes((b,)): b for b in range(256)}
    ids = [vocab.get(c, -1) for c in byte_letters()]
    if suffix:
        for c in byte_letters():
            ranks[raw(c + suffix)] = len(ids)
            ids.append(vocab.get(c + suffix, -1))
    for a, b in merge_rules(spec):
        token = raw(a + b if not (suffix and a.endswith(suffix)) else a[: -len(suffix)] + b)
        if token in ranks:
            return None
        ranks[token] = len(ids)
        ids.append(vocab[a + b])
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), ids


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes."""

    #: A chunk for a byte-level tokenizer: its own pattern splits at these places too, and never across them.
    CHUNKS = re.compile(r" ?\S+|\s+(?!\S)|\s+")

    def __init__(self, path: str) -> None:
        spec = json.loads(open(path, encoding="utf-8").read())
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.mode = cutting(spec)
        self.kept: dict[str, bytes] = {}
        self.specials = tuple(t["content"] for t in spec.get("added_tokens", []))
        self.one: Callable[[str], bytes] | None = getattr(self, f"_{self.mode}", lambda _: None)(spec)

    def _byte_level(self, spec: dict) -> Callable[[str], bytes] | None:
        """Ids of one chunk without the library's overhead; the pattern splits within it."""
        made = rank_encoder(spec, BYTE_LEVEL_PATTERN) if not spec["model"].get("end_of_word_suffix") else None
        if made is None:
            return None
        encode, ids = made[0]._core_bpe.encode_ordinary, made[1]
        return lambda chunk: array("I", map(ids.__getitem__, encode(chunk))).tobytes()

    def _spaces(self, spec: dict) -> Callable[[str], bytes] | None:
        """Ids of one chunk: composed, lower-cased, split by the pattern, each part a word."""
        end = b"\xff"
        made = rank_encoder(spec, SPACE_BLIND_PATTERN, end) if spec["model"].get("end_of_word_suffix") else None
        if made is None or [x["type"] for x in spec["normalizer"]["normalizers"]] != ["NFC", "Replace", "Lowercase"]:
            return None
        encode, ids = made[0]._core_bpe.encode_single_piece, made[1]
        split = regex.compile(SPACE_BLIND_PATTERN).findall
        parts: dict[str, bytes] = {}

        def part(text: str) -> bytes:
            found = parts.get(text)
            if found is None:
                found = array("I", map(ids.__getitem__, encode(text.encode() + end))).tobytes()
                if len(text) <= CACHE_CHARS:
                    if len(parts) >= CACHE_CHUNKS // 2:
                        parts.clear()
                    parts[text] = found
            return found

        def one(chunk: str) -> bytes:
            text = chunk.lower() if chunk.isascii() else unicodedata.normalize("NFC", chunk).lower()
            return part(text) if text.isascii() and text.isalpha() else b"".join(map(part, split(text)))

        return one

    def plain(self, chunk: str) -> bool:
        """Whether a chunk is left to ``one``: no special token in it, and no letter whose lower case depends on its place."""
        if any(s in chunk for s in self.specials):
            return False
        return self.mode == "byte_level" or chunk.isascii() or max(chunk) < "\u0250"

    def chunks(self, text: str) -> list[str]:
        if self.mode == "whole" or any(c in text for c in SEPARATORS) or any(s in text for s in self.specials):
            return [text] if text else []
        return text.split() if self.mode == "spaces" else self.CHUNKS.findall(text)

    def _library(self, chunks: Sequence[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(list(chunks), add_special_tokens=False)]

    def lookup(self, chunks: Sequence[str]) -> list[bytes]:
        """Ids of each chunk."""
        kept = self.kept
        try:
            return list(map(kept.__getitem__, chunks))
        except KeyError:
            pass
        new = set(chunks).difference(kept)
        ids = {c: self.one(c) for c in new if self.plain(c)} if self.one and self.mode != "whole" else {}
        rest = [c for c in new if c not in ids]
        ids.update(zip(rest, self._library(rest) if rest else (), strict=True))
        out = [ids[c] if c in ids else kept[c] for c in chunks]
        if len(kept) + len(ids) > CACHE_CHUNKS:
            kept.clear()
        kept.update((c, b) for c, b in ids.items() if len(c) <= CACHE_CHARS)
        return out

    def encode(self, text: str) -> bytes:
        return b"".join(self.lookup(self.chunks(text)))


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One for each worker and path; later tasks of the worker find its chunks."""
    return Encoder(path)


class Merger:
    """The merges alone, over bytes that no pattern splits: what the library does within one pre-token."""

    def __init__(self, path: str) -> None:
        spec = json.loads(open(path, encoding="utf-8").read())
        vocab, merges = spec["model"]["vocab"], merge_rules(spec)
        self.model = models.BPE(vocab=vocab, merges=merges)
        self.letters = byte_letters()
        back = {c: b for b, c in enumerate(self.letters)}
        size = max([*vocab.values(), *(t["id"] for t in spec.get("added_tokens", []))]) + 1
        self.pieces: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.pieces[i] = bytes(back[c] for c in token)
        for t in spec.get("added_tokens", []):
            self.pieces[t["id"]] = t["content"].encode()

    def ids(self, data: bytes) -> list[int]:
        return [t.id for t in self.model.tokenize("".join(map(self.letters.__getitem__, data)))] if data else []

    def decode(self, ids: Sequence[int]) -> str:
        """As the library's byte-level decoder: the tokens' bytes, bytes that are no text replaced."""
        return b"".join(map(self.pieces.__getitem__, ids)).decode("utf-8", errors="replace")


def byte_letters() -> list[str]:
    """The letter that byte-level tokenizers write for each byte: printable Latin-1 as itself, the rest from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in printable else next(others)) for b in range(256)]


@lru_cache(maxsize=2)
def merger(path: str) -> Merger:
    return Merger(path)


assert pre_tokenizers.ByteLevel.alphabet() and sorted(pre_tokenizers.ByteLevel.alphabet()) == sorted(byte_letters())
