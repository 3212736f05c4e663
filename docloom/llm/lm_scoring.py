"""Language-model scores by masked pseudo-likelihood.

A small network reads a window of two words to each side of a masked word (embeddings, one tanh layer) and gives
the word's probability in three factors: class, unit in class, and word in unit. The units are the most frequent
words, each alone, and ``BUCKETS`` units for all other words, which go by their last two letters, so the network
tells unknown words apart as context and as targets. Inside such a unit a word of the dictionary has its share of
the unit's count; any other word, seen or not, has what is left there times its spelling: a model of letter triples,
read from the word's end, learned from every word of the corpus that is no unit of its own. So each string has a
probability, and invented strings cost what their letters cost.

Everything is gathered over all documents: word counts by a map-side combined aggregation (they grow with the
corpus), letter triples over the counted words, and the weights by data-parallel training. Documents are dealt by
hash into shards of some ``SHARD_WORDS`` words, their number following from the corpus; a shard is trained in the
order of its texts' hashes, each round on every ``rounds``-th word, so all words are targets once. The shards' weights
are averaged in a tree of bounded groups. Neither shards nor order nor groups depend on the input's partitions or
on which executor runs what, so the scores don't either (but for the last digits, by the order of additions).

Defined results: words are split at ASCII white space, A-Z lower-cased. A null, empty or blank text has no words: pll 0,
mean_pll null. Repeated rows are scored each, alike. An empty table leaves the network at its start.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import cut, forget, small_batches

CLASSES, IN_CLASS, DIM, HIDDEN, SIDE = 32, 32, 8, 16, 2
VOCAB, PAD = CLASSES * IN_CLASS, CLASSES * IN_CLASS
BUCKETS, DICTIONARY = 64, 1 << 17
FANIN, BLOCK, SHARD_WORDS, BLOCK_WORDS = 16, 8192, 2_000_000, 65_536

# Letters as 64 symbols: 0 ends a word; a-z and digits alone; other ASCII signs, UTF-8 tails and UTF-8 heads in groups.
SYMBOLS, END = 64, 0
SYMBOL = np.full(256, 63, np.int64)
SYMBOL[0] = END
SYMBOL[97:123] = np.arange(1, 27)
SYMBOL[48:58] = np.arange(27, 37)
for _c in range(33, 127):
    if not chr(_c).isalnum():
        SYMBOL[_c] = 37 + _c % 16
SYMBOL[128:192] = 53 + np.arange(64) // 8
SYMBOL[192:224], SYMBOL[224:256] = 61, 62
#: What a byte costs inside its symbol's group.
IN_SYMBOL = -np.log(np.bincount(SYMBOL, minlength=SYMBOLS)[SYMBOL].astype(np.float64))
IN_SYMBOL[0] = 0.0
TRIPLES = SYMBOLS**3


def words_in(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def letters(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols of all words, each reversed and ended; their bytes; where each word starts; place in its word)."""
    raw = np.frombuffer(b"".join(w[::-1].replace(b"\0", b"\1") + b"\0" for w in words), np.uint8)
    sizes = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
    starts = np.cumsum(sizes) - sizes
    return SYMBOL[raw], raw, starts, np.arange(len(raw)) - np.repeat(starts, sizes)


def cells(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(cell of the letter tables for each letter from a word's second on; the bytes; the starts; the words' buckets)."""
    s, raw, starts, place = letters(words)
    if not len(words):
        return s, raw, starts, s
    pair = np.zeros(len(s), np.int64)
    pair[1:] = s[:-1] * SYMBOLS + s[1:]
    cell = np.where(place >= 2, pair, TRIPLES + pair)
    cell[2:] += np.where(place[2:] >= 2, s[:-2] * SYMBOLS**2, 0)
    return np.where(place >= 1, cell, -1), raw, starts, bucket_of(s[starts], s[starts + 1])


def bucket_of(last, before):
    return (last * 7 + before) % BUCKETS


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): every word of the documents with its count, as a written table."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
        for b in batches:
            for t in b.column(0).to_pylist():
                counts.update(words_in(t))
                if len(counts) > 400_000:
                    yield out()
                    counts.clear()
        yield out()

    return cut(docs.select(text).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))


class Lexicon:
    """What is known of words: units, dictionary shares and letters. Its size is bounded by VOCAB, DICTIONARY and SYMBOLS."""

    def __init__(self, units: list[tuple[bytes, int]], shared: list[tuple[bytes, int]], total: int, triples: np.ndarray):
        self.code = {w: BUCKETS + k for k, (w, _) in enumerate(units)} | {w: VOCAB + k for k, (w, _) in enumerate(shared)}
        n = np.array([c for _, c in shared], np.float64)
        self.bucket = cells([w for w, _ in shared])[3]
        inside = np.bincount(self.bucket, n, BUCKETS)
        once = np.bincount(self.bucket, n == 1, BUCKETS) + 1.0  # left to words not seen, as much as words seen once
        pairs = triples[TRIPLES:].reshape(SYMBOLS, SYMBOLS) + 0.01
        of = bucket_of(np.arange(SYMBOLS)[:, None], np.arange(SYMBOLS)[None, :])
        spelled = np.bincount(of.ravel(), pairs.ravel(), BUCKETS)
        rest = max(0, total - sum(c for _, c in units) - n.sum())  # tokens outside units and dictionary
        outside = rest * spelled / spelled.sum() + once
        self.share = np.log(n / (inside + outside)[self.bucket]) if len(n) else n
        self.left = np.log(outside / (inside + outside))
        self.units = np.r_[np.maximum(inside + outside, 0.5), [max(c, 0.5) for _, c in units]]
        t = triples[:TRIPLES].reshape(SYMBOLS, SYMBOLS, SYMBOLS)
        two = t.sum(0) + 0.05
        two /= two.sum(1, keepdims=True)
        three = (t + 4.0 * two) / (t.sum(2, keepdims=True) + 4.0)
        self.spelling = np.log(np.r_[three.ravel(), (pairs / spelled[of]).ravel()])

    def spell(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(buckets, log-probabilities inside the buckets) of words outside the dictionary."""
        cell, raw, starts, bucket = cells(words)
        if not len(words):
            return bucket, np.empty(0)
        return bucket, np.add.reduceat(np.where(cell >= 0, self.spelling[cell], 0.0) + IN_SYMBOL[raw], starts) + self.left[bucket]

    def read(self, texts: list[str | None]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Per text: its words' units as 16-bit words, the sum of their log-shares in the units, and its number of words."""
        code, lost, sizes = [], [], []
        get = self.code.get
        for t in texts:
            own = words_in(t)
            found = [get(w, -1) for w in own]
            lost += [w for w, c in zip(own, found) if c < 0]
            code += found
            sizes.append(len(own))
        code, extra, sizes = np.array(code, np.int64), np.zeros(len(code)), np.array(sizes, np.int64)
        ids = np.minimum(code, VOCAB - 1)
        shared = code >= VOCAB
        ids[shared], extra[shared] = self.bucket[code[shared] - VOCAB], self.share[code[shared] - VOCAB]
        ids[code < 0], extra[code < 0] = self.spell(lost)
        ends = np.cumsum(sizes)
        sums = np.r_[0.0, np.cumsum(extra)]
        flat = ids.astype("<i2")
        return [flat[e - n : e].tobytes() for e, n in zip(ends, sizes)], sums[ends] - sums[ends - sizes], sizes


def lexicon(counts: DataFrame) -> Lexicon:
    """The units are the VOCAB - BUCKETS most frequent words, the dictionary up to DICTIONARY further ones, letters come from every other word."""
    small_batches(counts.sparkSession)
    top = [(bytes(r.word), r.n) for r in counts.orderBy(F.desc("n"), "word").limit(VOCAB - BUCKETS).collect()]
    own = {w for w, _ in top}
    sizes = counts.groupBy("n").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("n")).limit(DICTIONARY).collect()
    total, words, least = counts.agg(F.sum("n")).first()[0] or 0, 0, None
    for r in sizes:  # as many of the frequent words as fit, all words of one count or none
        words += r.words
        if words > DICTIONARY:
            break
        least = r.n
    shared = sorted((bytes(r.word), r.n) for r in counts.filter(F.col("n") >= least).collect()) if least is not None else []
    known = counts.sparkSession.sparkContext.broadcast(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(TRIPLES + SYMBOLS**2, np.int64)
        for b in batches:
            cell = cells([w for w in b.column(0).to_pylist() if w not in known.value])[0]
            table += np.bincount(cell[cell >= 0], minlength=len(table))
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(table[at])], ["cell", "n"])

    found = counts.select("word").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # at most the table's cells
    triples = np.zeros(TRIPLES + SYMBOLS**2)
    triples[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    return Lexicon(top, [(w, n) for w, n in shared if w not in own], total, triples)


def start(lex: Lexicon, seed: int = 42) -> dict[str, np.ndarray]:
    """Seeded weights; the biases are the units' frequencies, so the start is the unigram model."""
    rng = np.random.default_rng(seed)
    f = np.full(VOCAB, 0.5)
    f[: len(lex.units)] = lex.units
    f = f.reshape(CLASSES, IN_CLASS)
    draw = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)
    return {
        "E": draw(VOCAB + 1, DIM), "W": draw(2 * SIDE * DIM, HIDDEN), "b": np.zeros(HIDDEN, np.float32),
        "C": draw(HIDDEN, CLASSES), "c": np.log(f.sum(1) / f.sum()).astype(np.float32),
        "O": draw(CLASSES, HIDDEN, IN_CLASS), "o": np.log(f / f.sum(1, keepdims=True)).astype(np.float32),
    }


def read(docs: DataFrame, lex: Lexicon, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, uid, ids, extra, n) per document, as a written table: the texts are read once for training and scores."""
    small_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(lex)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, extra, n = shipped.value.read(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.binary()), pa.array(extra), pa.array(n)], ["doc_id", "uid", "ids", "extra", "n"])

    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text), F.col(id_col)).alias("uid"), F.col(text))
    return cut(texts.mapInArrow(run, f"doc_id {dict(docs.dtypes)[id_col]}, uid long, ids binary, extra double, n long"))


def windows(ids: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids with padding between documents, positions of the words, number of words per document)."""
    pad = np.full(SIDE, PAD, np.int16).tobytes()
    flat = np.frombuffer(pad + pad.join(ids) + pad, "<i2").astype(np.int64)
    return flat, np.flatnonzero(flat != PAD), np.array([len(x) // 2 for x in ids], np.int64)


OFFSETS = np.array([k for k in range(-SIDE, SIDE + 1) if k])


def _log_softmax_at(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    top = z.max(1)
    picked = z[np.arange(len(y)), y] - top
    z -= top[:, None]
    return picked - np.log(np.exp(z, out=z).sum(1))


def log_probs(p: dict, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log-probabilities of the words at ``at``, each from both sides; grouped by class, so that a class's weights are read once."""
    order = np.argsort((ids[at] // IN_CLASS).astype(np.int8), kind="stable")
    at = at[order]
    x = p["E"].take(ids.take(at[:, None] + OFFSETS), axis=0).reshape(len(at), -1)
    h = np.tanh(x @ p["W"] + p["b"])
    klass, word = np.divmod(ids[at], IN_CLASS)
    z = np.empty((len(at), IN_CLASS), np.float32)
    ends = np.searchsorted(klass, np.arange(CLASSES + 1))
    for k in range(CLASSES):
        np.matmul(h[ends[k] : ends[k + 1]], p["O"][k], out=z[ends[k] : ends[k + 1]])
        z[ends[k] : ends[k + 1]] += p["o"][k]
    out = _log_softmax_at(h @ p["C"] + p["c"], klass) + _log_softmax_at(z, word)
    back = np.empty_like(out)
    back[order] = out
    return back


def _errors(z: np.ndarray, n: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Gradients of the mean negative log-softmax at ``y``, in place."""
    z -= z.max(1, keepdims=True)
    np.exp(z, out=z)
    z *= np.float32(1 / len(z)) / z.sum(1, keepdims=True)
    z[n, y] -= np.float32(1 / len(z))
    return z


def step(p: dict, g: dict, ids: np.ndarray, at: np.ndarray, rate: float) -> None:
    """One gradient step on the words at ``at``, each weight by its own past gradients ``g`` (AdaGrad); a class's words lie together."""
    order = np.argsort(ids.take(at).astype(np.int16), kind="stable")
    at = at.take(order)
    klass, word = np.divmod(ids.take(at), IN_CLASS)
    ends = np.searchsorted(klass, np.arange(CLASSES + 1)).tolist()
    spans = [(k, a, b) for k, (a, b) in enumerate(zip(ends, ends[1:])) if a < b]
    context, n = ids.take(at[:, None] + OFFSETS), np.arange(len(at))
    x = p["E"].take(context, axis=0).reshape(len(at), -1)
    h = np.tanh(x @ p["W"] + p["b"])
    pc, pw = _errors(h @ p["C"] + p["c"], n, klass), np.empty((len(at), IN_CLASS), np.float32)
    for k, a, b in spans:
        np.matmul(h[a:b], p["O"][k], out=pw[a:b])
        pw[a:b] += p["o"][k]
    pw = _errors(pw, n, word)
    dh, dO, do = pc @ p["C"].T, np.zeros_like(p["O"]), np.zeros_like(p["o"])
    for k, a, b in spans:
        dh[a:b] += pw[a:b] @ p["O"][k].T
        np.matmul(h[a:b].T, pw[a:b], out=dO[k])
        pw[a:b].sum(0, out=do[k])
    dz = dh * (1 - h * h)
    dx = (dz @ p["W"].T).reshape(-1, DIM)
    cell = (context.reshape(-1, 1) * DIM + np.arange(DIM)).ravel()
    dE = np.bincount(cell, dx.ravel(), p["E"].size).reshape(p["E"].shape).astype(np.float32)
    for k, d in (("E", dE), ("W", x.T @ dz), ("b", dz.sum(0)), ("C", h.T @ pc), ("c", pc.sum(0)), ("O", dO), ("o", do)):
        g[k] += d * d
        p[k] -= rate * d / np.sqrt(g[k])


def train(read_docs: DataFrame, weights: dict[str, np.ndarray], rounds: int = 2, rate: float = 0.05, seed: int = 42) -> dict[str, np.ndarray]:
    """Weights after ``rounds`` passes over all documents; pass r predicts the words r, r + rounds, ... of every block."""
    spark = read_docs.sparkSession
    small_batches(spark)
    words = read_docs.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-words // SHARD_WORDS))
    dealt = read_docs.filter("n > 0").select(F.pmod(F.xxhash64(F.lit(seed), "uid"), F.lit(shards)).cast("int").alias("shard"), "uid", "ids")
    for r in range(rounds):
        shipped = spark.sparkContext.broadcast(weights)  # a fixed size

        def run(batches: Iterator[pa.RecordBatch], r=r, shipped=shipped) -> Iterator[pa.RecordBatch]:
            now, held, size = None, [], 0
            p, g, n, block = {}, {}, 0, 0

            def learn() -> None:
                nonlocal n, block, held, size
                ids, at, _ = windows(held)
                at = np.random.default_rng([seed, r, now, block]).permutation(at[r::rounds])
                i = 0
                while i < len(at):
                    many = 256 if n < 200_000 else 2048  # short steps first
                    step(p, g, ids, at[i : i + many], rate)
                    n += len(at[i : i + many])
                    i += many
                block, held, size = block + 1, [], 0

            def done() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([n], pa.int64()), pa.array([pickle.dumps(p)], pa.binary())], ["shard", "n", "weights"])

            for b in batches:
                for shard, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    if shard != now:
                        if held:
                            learn()
                        if now is not None:
                            yield done()
                        now, n, block = shard, 0, 0
                        p = {k: v.copy() for k, v in shipped.value.items()}
                        g = {k: np.full_like(v, 1e-6) for k, v in p.items()}
                    held.append(ids)
                    size += len(ids) // 2
                    if size >= BLOCK_WORDS:
                        learn()
            if held:
                learn()
            if now is not None:
                yield done()

        whole = dealt.repartitionById(shards, "shard").sortWithinPartitions("shard", "uid").select("shard", "ids")  # a task a shard
        weights = _average(whole.mapInArrow(run, "shard long, n long, weights binary"), weights, shards)
    return weights


def _average(parts: DataFrame, before: dict[str, np.ndarray], shards: int) -> dict[str, np.ndarray]:
    """Means of the shards' weights by their words, FANIN neighbours at a time until one is left."""

    def mean(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("shard")
        n = pdf["n"].to_numpy()
        w = n / n.sum() if n.sum() else np.full(len(n), 1 / len(n))
        got = [pickle.loads(x) for x in pdf["weights"]]
        p = {k: sum(a * g[k] for a, g in zip(w, got)).astype(np.float32) for k in got[0]}
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0] // FANIN], "n": [n.sum()], "weights": [pickle.dumps(p)]})

    parts = cut(parts)
    while shards > 1:
        small = cut(parts.groupBy(F.floor(F.col("shard") / FANIN).alias("group")).applyInPandas(mean, "shard long, n long, weights binary"))
        forget(parts)
        parts, shards = small, -(-shards // FANIN)
    row = parts.first()
    forget(parts)
    return pickle.loads(row.weights) if row else before


def scores(read_docs: DataFrame, weights: dict[str, np.ndarray]) -> DataFrame:
    """(doc_id, n_tokens, pll, mean_pll) per document of ``read``."""
    spark = read_docs.sparkSession
    small_batches(spark)
    shipped = spark.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shipped.value
        for b in batches:
            ids, at, lengths = windows(b.column(1).to_pylist())
            logp = np.concatenate([np.empty(0), *(log_probs(p, ids, at[i : i + BLOCK]) for i in range(0, len(at), BLOCK))])
            ends = np.cumsum(lengths)
            total = np.r_[0, np.cumsum(logp)]
            pll = total[ends] - total[ends - lengths] + b.column(2).to_numpy()
            mean = np.divide(pll, lengths, out=np.zeros(len(pll)), where=lengths > 0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lengths), pa.array(pll), pa.array(mean, mask=lengths == 0)], ["doc_id", "n_tokens", "pll", "mean_pll"])

    return read_docs.select("doc_id", "ids", "extra").mapInArrow(run, f"doc_id {dict(read_docs.dtypes)['doc_id']}, n_tokens long, pll double, mean_pll double")


def lm_query(docs: DataFrame) -> DataFrame:
    counts = word_counts(docs)
    lex = lexicon(counts)
    forget(counts)
    known = read(docs, lex)
    return scores(known, train(known, start(lex)))
