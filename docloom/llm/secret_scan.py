"""Secret scans: keyword automaton, anchored patterns near its hits, embedded checksums.

One Aho-Corasick pass per text finds the literal keywords that start a secret; a pattern is only matched
anchored at such a hit. The ``hex`` kind has no keyword: a run of 32 or more hex digits covers one of every
32nd positions, so only those probes are looked at. Two token families carry a checksum (six base-62
digits of the CRC-32 of the 30 before), which must hold. One Arrow pass over the scan, no shuffle.

Kinds, in order: assign, access, hex (the base) and github, npm, pem (added). Defined results: a null or
empty text has no spans. Positions are code points, ends exclusive. Repeated rows are scanned each.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import small_batches

KINDS = ("assign", "access", "hex", "github", "npm", "pem")
BASE = KINDS[:3]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
GITHUB = re.compile(r"gh[pousr]_([A-Za-z0-9]{36})(?![A-Za-z0-9])")
NPM = re.compile(r"npm_([A-Za-z0-9]{36})(?![A-Za-z0-9])")
PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY-----")
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
    "pem": ("-----begin ",),
}
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
HEX, HEX_LEAST = frozenset("0123456789abcdef"), 32


def checksum62(body: str) -> str:
    """Six base-62 digits of the CRC-32."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = BASE62[d] + out
    return out


def _valid(kind: str, m: re.Match) -> bool:
    if kind == "assign":
        return len(m[2]) >= 8
    if kind == "access":
        return len(m[0]) >= 16
    if kind in ("github", "npm"):
        return checksum62(m[1][:30]) == m[1][30:]
    return True


PATTERNS = {"assign": ASSIGN, "access": ACCESS, "github": GITHUB, "npm": NPM, "pem": PEM}


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for w in words:
            a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


def hex_runs(text: str) -> Iterator[tuple[int, int]]:
    """Maximal runs of at least 32 hex digits, found by probing every 32nd position."""
    end, step = 0, HEX_LEAST
    for k, c in enumerate(text[step - 1 :: step]):
        at = step - 1 + k * step
        if c in HEX and at >= end:
            lo, hi = at, at + 1
            while lo > end and text[lo - 1] in HEX:
                lo -= 1
            while hi < len(text) and text[hi] in HEX:
                hi += 1
            end = hi
            if hi - lo >= step:
                yield lo, hi


def scan(text: str, words: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """(start, kind's number, kind, end) of all spans, sorted."""
    low = text.lower() if text.isascii() else text.encode().lower().decode()  # A-Z only: positions stay
    out, ends = [(a, 2, "hex", b) for a, b in hex_runs(text)], dict.fromkeys(KINDS, 0)
    for last, (kind, n) in words.iter(low):
        start = last + 1 - n
        if start < ends[kind]:
            continue
        if m := PATTERNS[kind].match(text, start):
            ends[kind] = m.end()
            if _valid(kind, m):
                out.append((start, KINDS.index(kind), kind, m.end()))
    return sorted(out)


def secrets(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) per document."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = automaton()
        names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
        for b in batches:
            cols: list[list] = [[] for _ in names[1:]]
            for t in b.column(1).to_pylist():
                found = scan(t or "", words)
                base = [s for s in found if s[2] in BASE]
                for col, kind in zip(cols, BASE):
                    col.append(sum(s[2] == kind for s in base))
                said = [",".join(f"{k}:{a}:{e}" for a, _, k, e in x) for x in (base, found)]
                cols[3].append(hashlib.sha256(said[0].encode()).hexdigest())
                cols[4].append(said[1])
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.string()) for c in cols[3:])], names)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text)).mapInArrow(run, f"doc_id {dict(docs.dtypes)[id_col]}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
