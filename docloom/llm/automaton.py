"""BPE encoding and decoding by a tokenization automaton.

The merges are compiled into a deterministic automaton whose arcs are tokens and whose paths are exactly the
token sequences that the merges give. It starts as one state with a loop per byte. Each merge (u, v) puts in one
gadget: the state behind u is split off without its arc v, and every state that has u before v gets an arc uv to
the state behind v. All arcs of a token lead to one state, so a state is stored by what it lacks: the arcs taken
from it, with the merge that took them. An arc uv is missing wherever u was missing when uv was made, which the
chain of first parts (u, its own first part, ...) tells; nothing else is stored per arc.

A pre-split word is encoded by transitions of those tables: from each place the longest token first, then its
shorter prefixes; every prefix of a word has one path only, so a place that leads nowhere is left for good and the
work is linear in the word. Ids are decoded by emitting the labels of their arcs.

The automaton (14,639 states with 365,863 missing arcs for 50,000 merges) is compiled once on the driver and
broadcast: its size follows from the vocabulary alone. One Arrow pass each way over the rows, no shuffle.

Defined results: a null text is empty and has no ids; a null list of ids gives a null text. Special strings inside
a text are one id each, as the library does by default. Bytes that are no UTF-8 decode to U+FFFD, ids outside the
vocabulary to nothing. Repeated rows are encoded each. Rows come back in the input's partitions.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.bpe import LONG, PRE_TOKEN, byte_symbols
from docloom.llm.common import small_batches


class Automaton:
    """States and arcs of a byte-level BPE definition (each token made by one merge, of tokens made before it)."""

    def __init__(self, definition: str):
        spec = json.loads(definition)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or spec.get("normalizer") or pre.get("add_prefix_space"):
            raise ValueError("only a plain byte-level BPE is supported")
        vocab: dict[str, int] = model["vocab"]
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        back = {s: b for b, s in enumerate(byte_symbols())}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.labels: list[bytes] = [b""] * size
        for s, i in vocab.items():
            self.labels[i] = bytes(back[c] for c in s) if all(c in back for c in s) else s.encode()
        for s, i in self.special.items():
            self.labels[i] = s.encode()
        #: First part and merge number of a token; the state behind it (-1: no word gives this token).
        self.first, self.made, self.behind = [-1] * size, [0] * size, [-1] * size
        #: Per state the tokens whose arcs were taken away, with the merge that took them.
        self.lacks: list[dict[int, int]] = [{}]
        self._compile([vocab[s] for s in back], [tuple(vocab[x] for x in (a, b, a + b)) for a, b in (m.split(" ") if isinstance(m, str) else m for m in model["merges"])])
        #: Prefixes of live tokens -> token or -1; the longest token that is a proper prefix of a token.
        self.prefixes: dict[bytes, int] = {}
        live = [i for i, q in enumerate(self.behind) if q >= 0]
        for i in live:
            for n in range(1, len(self.labels[i])):
                self.prefixes.setdefault(self.labels[i][:n], -1)
        self.prefixes |= {self.labels[i]: i for i in live}
        self.shorter = [-1] * size
        for i in live:
            self.shorter[i] = next((t for n in range(len(self.labels[i]) - 1, 0, -1) if (t := self.prefixes[self.labels[i][:n]]) >= 0), -1)

    def _compile(self, base: list[int], merges: list[tuple[int, int, int]]) -> None:
        for b in base:
            self.behind[b] = 0
        known, users = set(base), [len(base)]  # users: how many tokens lead to a state
        for n, (u, v, uv) in enumerate(merges):
            if u not in known or v not in known or uv in known:
                raise ValueError(f"merge {n} uses a token that isn't made yet, or makes one again")
            known.add(uv)
            self.first[uv], self.made[uv] = u, n
            q = self.behind[u]
            if q < 0 or self.behind[v] < 0 or not self.has(q, v):
                continue  # u and v never meet: the token has no arc
            self.behind[uv] = self.behind[v]
            users[self.behind[v]] += 1
            if users[q] > 1:  # other tokens lead to q: u gets a state of its own
                users[q] -= 1
                self.lacks.append(dict(self.lacks[q]))
                users.append(1)
                q = self.behind[u] = len(self.lacks) - 1
            self.lacks[q][v] = n

    def has(self, state: int, token: int) -> bool:
        """Whether the state has an arc with this token."""
        lacks, later = self.lacks[state], len(self.made) + len(self.lacks) + (1 << 40)
        while token >= 0:
            taken = lacks.get(token)
            if taken is not None and taken <= later:
                return False
            token, later = self.first[token], self.made[token]
        return True

    def longest(self, word: bytes, i: int) -> int:
        """The longest token that stands at ``i``."""
        known, token = self.prefixes, -1
        for j in range(i + 1, len(word) + 1):
            t = known.get(word[i:j])
            if t is None:
                break
            if t >= 0:
                token = t
        return token

    def word(self, word: bytes) -> list[int]:
        """The one path that spells the word."""
        n, i, out, barred = len(word), 0, [], None
        token = self.longest(word, 0)
        while i < n:
            while token >= 0:
                j = i + len(self.labels[token])
                if not (barred and barred[j]) and (not out or self.has(self.behind[out[-1]], token)):
                    break
                token = self.shorter[token]
            if token >= 0:
                out.append(token)
                i = j
                token = self.longest(word, i) if i < n else -1
            else:  # nothing goes on from here: this place is left for good
                barred = barred or bytearray(n + 1)
                barred[i] = 1
                token = out.pop()
                i -= len(self.labels[token])
                token = self.shorter[token]
        return out


class Words(dict):
    """Pre-token -> its ids: a bounded table in front of the automaton."""

    def __init__(self, automaton: Automaton, limit: int = 200_000):
        super().__init__()
        self.automaton, self.limit = automaton, limit
        self.split = regex.compile(PRE_TOKEN)
        special = sorted(automaton.special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = tuple(self.automaton.word(piece.encode()))
        if len(self) < self.limit and len(piece) < 64:
            self[piece] = ids
        return ids

    def ids(self, text: str) -> array:
        out = array("i")
        for n, part in enumerate(self.special.split(text) if self.special else [text]):
            if n % 2:
                out.append(self.automaton.special[part])
            elif len(part) <= LONG:
                out.extend(chain.from_iterable(map(self.__getitem__, self.split.findall(part))))
            else:
                for m in self.split.finditer(part):
                    out.extend(self[m[0]])
        return out


_BUILT: dict[int, Automaton] = {}


def shipped(spark, path: str):
    """A broadcast of the compiled automaton; ``path`` is read on the driver."""
    with open(path, encoding="utf-8") as f:
        definition = f.read()
    key = hash(definition)
    if key not in _BUILT:
        _BUILT[key] = Automaton(definition)
    return spark.sparkContext.broadcast(_BUILT[key])


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) per row; ``tokenizer`` is the path of a byte-level BPE definition."""
    small_batches(docs.sparkSession)
    sent = shipped(docs.sparkSession, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(sent.value)
        for b in batches:
            flat, ends = array("i"), [0]
            for t in b.column(1):
                flat.extend(words.ids(t.as_py() or ""))
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], ["doc_id", "ids"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text)).mapInArrow(run, f"doc_id {dict(docs.dtypes)[id_col]}, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """All columns of ``encoded`` and ``out``, the text that the ids spell; raises if ``out`` is a column already."""
    if out in encoded.columns:
        raise ValueError(f"column {out} exists")
    small_batches(encoded.sparkSession)
    sent = shipped(encoded.sparkSession, tokenizer)
    at = encoded.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = sent.value.labels
        known = len(labels)
        for b in batches:
            texts = []
            for row in b.column(at):
                if not row.is_valid:
                    texts.append(None)
                    continue
                path = row.values.to_numpy(zero_copy_only=False)
                path = path[(path >= 0) & (path < known)]
                texts.append(b"".join(map(labels.__getitem__, path.tolist())).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, "text"])

    plain = encoded.toDF(*(f"c{n}" for n in range(len(encoded.columns))))  # whatever characters the names hold
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema)
    return plain.mapInArrow(run, f"{fields}, text string").toDF(*encoded.columns, out)


def automaton_query(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): the digests of each text's ids and of what they decode to."""
    both = decode(encode(docs, tokenizer), tokenizer)
    listed = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
