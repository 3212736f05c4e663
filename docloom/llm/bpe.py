"""Byte-level BPE with a proven whole-token table.

``ByteBPE`` reads a tokenizer JSON (byte-level pre-tokenizer, no normaliser). ``whole`` holds every
vocabulary string that is proven, by running the merges on it, to encode alone as exactly one token;
a pre-token found there needs no merge. All others are merged once and remembered in a bounded table.

Texts of any length and any run of equal characters are encoded: the byte-pair core's own splitter keeps a
stack per character of a blank run, so texts beyond ``LONG`` characters are split here and merged piece by piece.
"""

from __future__ import annotations

import heapq
import json
import struct
from functools import cached_property

import numpy as np
import regex
import tiktoken

#: Fixed value: the pre-token pattern of the byte-level pre-tokenizer.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: The core's splitter is safe on runs of 300,000 blanks and fails beyond a million; longer texts than this never reach it.
LONG = 100_000


def byte_symbols() -> list[str]:
    """The symbol of each byte: printable Latin-1 stands for itself, the rest follow from code point 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in shown)}
    return [hidden.get(b, chr(b)) for b in range(256)]


class ByteBPE:
    def __init__(self, definition: str):
        spec = json.loads(definition)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or spec.get("normalizer") or pre.get("add_prefix_space"):
            raise ValueError("only a plain byte-level BPE is supported")
        self.vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {m: r for r, m in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.symbols = byte_symbols()
        back = {s: b for b, s in enumerate(self.symbols)}
        self.pattern = PRE_TOKEN
        self.split = regex.compile(PRE_TOKEN).finditer
        ranked = [self.vocab[a + b] for a, b in merges]
        raw = {bytes(back[c] for c in s): i for s, i in self.vocab.items() if s not in self.special}
        # ids in merge order: the byte-pair core of tiktoken, which merges by id, gives the same tokens
        in_order = ranked == sorted(ranked) and max(raw[bytes([b])] for b in range(256)) < min(ranked, default=256) and len(raw) == len(ranked) + 256
        self.core = tiktoken.Encoding("shipped", pat_str=PRE_TOKEN, mergeable_ranks=raw, special_tokens={}) if in_order else None

    @cached_property
    def whole(self) -> dict[str, int]:
        """Strings proven to encode alone as one token."""
        back, whole = {s: b for b, s in enumerate(self.symbols)}, {}
        for s, i in self.vocab.items():
            if all(c in back for c in s) and self._merge(list(s)) == [s]:
                try:
                    whole[bytes(back[c] for c in s).decode()] = i
                except UnicodeDecodeError:
                    pass  # part of a character: never a whole pre-token
        return whole

    def ids(self, text: str) -> list[int]:
        """Ids of a text without special strings."""
        if self.core and len(text) <= LONG:
            return self.core.encode_ordinary(text)
        known, out = {}, []
        for m in self.split(text):
            p = m[0]
            if (ids := known.get(p)) is None:
                ids = self.piece(p)
                if len(p) < 64 and len(known) < 100_000:
                    known[p] = ids
            out += ids
        return out

    def piece(self, piece: str) -> list[int]:
        """Ids of one pre-token, which isn't split again."""
        return self.core._core_bpe.encode_single_piece(piece.encode()) if self.core else self.merge(piece)

    def _merge(self, parts: list[str]) -> list[str]:
        """Lowest rank first, leftmost among equals; a heap keeps long pre-tokens at n log n."""
        ranks, n = self.ranks, len(parts)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(ranks[p], i, *p) for i, p in enumerate(zip(parts, parts[1:])) if p in ranks]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i], alive[j], after[i] = a + b, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (p := (parts[x], parts[y])) in ranks:
                    heapq.heappush(heap, (ranks[p], x, *p))
        return [p for p, ok in zip(parts, alive) if ok]

    def merge(self, piece: str) -> list[int]:
        """Ids of one pre-token."""
        return [self.vocab[p] for p in self._merge([self.symbols[b] for b in piece.encode()])]


class Counter(dict):
    """Pre-token -> number of tokens."""

    def __init__(self, bpe: ByteBPE, limit: int = 300_000):
        super().__init__(dict.fromkeys(bpe.whole, 1))
        self.bpe, self.limit = bpe, limit
        self.find = regex.compile(bpe.pattern).findall

    def __missing__(self, piece: str) -> int:
        n = len(self.bpe.piece(piece))
        if len(self) < self.limit and len(piece) < 64:
            self[piece] = n
        return n

    def count(self, text: str) -> int:
        pieces, n = _split(text, self.bpe.special)
        for p in pieces:
            n += sum(map(self.__getitem__, self.find(p))) if len(p) <= LONG else sum(self[m[0]] for m in self.bpe.split(p))
        return n


class Encoder:
    """Texts to ids as little-endian 32-bit words."""

    def __init__(self, bpe: ByteBPE):
        self.bpe = bpe

    def encode(self, text: str) -> bytes:
        special = self.bpe.special
        if any(s in text for s in special):
            parts = regex.split("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")", text)
            return b"".join(struct.pack("<I", special[p]) if p in special else self.encode_plain(p) for p in parts)
        return self.encode_plain(text)

    def encode_plain(self, text: str) -> bytes:
        return np.array(self.bpe.ids(text), "<u4").tobytes()


def _split(text: str, special: dict[str, int]) -> tuple[list[str], int]:
    """The stretches between special strings, and how many of those there are."""
    if not any(s in text for s in special):
        return [text], 0
    parts = regex.split("|".join(map(regex.escape, sorted(special, key=len, reverse=True))), text)
    return parts, len(parts) - 1


_LOADED: dict[int, ByteBPE] = {}


def shipped(spark, path: str):
    """A broadcast of the tokenizer (a fixed vocabulary, 3 MB); ``path`` is read and the whole-token table proven on the driver, once."""
    with open(path, encoding="utf-8") as f:
        definition = f.read()
    return spark.sparkContext.broadcast((definition, loaded((definition, None)).whole))


def loaded(sent: tuple[str, dict[str, int] | None]) -> ByteBPE:
    """The tokenizer, built once per Python worker; the whole-token table comes with it."""
    definition, whole = sent
    key = hash(definition)
    if key not in _LOADED:
        _LOADED[key] = ByteBPE(definition)
        if whole is not None:
            _LOADED[key].whole = whole
    return _LOADED[key]
