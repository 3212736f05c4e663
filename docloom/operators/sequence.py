"""Labels of ordered sequences: the best path through states by dynamic programming (Viterbi), in blocks.

A sequence is cut into blocks of ``BLOCK`` values of its order column, and a block is decoded in one task's memory. How
a block leads from each first state to each last state is a matrix; those matrices are few and small, so going through
them in order gives each block's first and last state on the best path. Every block is then decoded by itself between
its two states, with back pointers. Sequences that fit in one block (most) need no matrices. So a sequence of any
length is spread over tasks, and nothing gathers it.

Rows are dealt out by sequence and block, sorted within partitions and read as a stream; the tables of the model
are bounded by the number of states (emissions are joined, so any number of observations is allowed).

Defined results: a row without an order gets a null state and takes no part. Rows of equal order stand one after
another, by observation. An observation that the model doesn't know, or a state for which it lacks it, has log
probability ``unknown``; a transition or start that is missing ``-inf``. Where no path is possible the states are null.
Of equally good paths one is returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values of the order column in one block; states of a model.
BLOCK, MOST_STATES = 4096, 256


class Model:
    """States in order, log probabilities of transitions (from x to) and of the first state."""

    def __init__(self, transitions: DataFrame, starts: DataFrame):
        t = transitions.select("state", "next", "logp").limit(MOST_STATES**2 + 1).collect()
        s = starts.select("state", "logp").limit(MOST_STATES + 1).collect()
        self.states = sorted({r.state for r in s} | {r.state for r in t} | {r.next for r in t})
        if len(self.states) > MOST_STATES or len(t) > MOST_STATES**2:
            raise ValueError(f"more than {MOST_STATES} states")
        at, k = {s: i for i, s in enumerate(self.states)}, len(self.states)
        self.moves, self.start = np.full((k, k), -np.inf), np.full(k, -np.inf)
        for r in t:
            self.moves[at[r.state], at[r.next]] = r.logp
        for r in s:
            self.start[at[r.state]] = r.logp


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[list]]]:
    """(key, columns) of each run of rows that are equal in their first ``keys`` columns."""
    key, held = None, []
    for b in batches:
        cols = [c.to_pylist() for c in b.columns]
        rows = list(zip(*cols[:keys]))
        begin = 0
        for i, k in enumerate(rows):
            if k != key:
                if i > begin or held:
                    held.append([c[begin:i] for c in cols])
                    yield key, [[x for part in parts for x in part] for parts in zip(*held)]
                key, held, begin = k, [], i
        held.append([c[begin:] for c in cols])
    if held and held[-1] is not None and key is not None:
        yield key, [[x for part in parts for x in part] for parts in zip(*held)]


def _bridge(seen: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Best score from each first to each last state of a block."""
    best = np.full(moves.shape, -np.inf)
    np.fill_diagonal(best, seen[0])
    for e in seen[1:]:
        best = (best[:, :, None] + moves[None]).max(axis=1) + e
    return best


def _path(first: np.ndarray, seen: np.ndarray, moves: np.ndarray, last: int | None) -> tuple[list[int] | None, float]:
    """Best path from the scores of first states, to the last state if it is given."""
    best, back = first + seen[0], []
    for e in seen[1:]:
        ways = best[:, None] + moves
        back.append(ways.argmax(axis=0))
        best = ways.max(axis=0) + e
    end = int(best.argmax()) if last is None else last
    if best[end] == -np.inf:
        return None, -np.inf
    path = [end]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1], float(best[end])


def _seen(steps: DataFrame, emissions: DataFrame, states: list, unknown: float) -> DataFrame:
    """Adds ``seen``: the observation's log probability in each state."""
    held = emissions.groupBy(F.col("obs").alias("__v_obs")).agg(F.map_from_entries(F.collect_list(F.struct("state", "logp"))).alias("__v_p"))  # at most one entry a state
    each = F.array(*(F.coalesce(F.try_element_at("__v_p", F.lit(s)), F.lit(unknown)) for s in states))
    return steps.join(held, F.col("obs") == F.col("__v_obs"), "left").withColumn("seen", F.coalesce(each, F.array(*(F.lit(unknown) for _ in states))))


def viterbi(steps: DataFrame, emissions: DataFrame, transitions: DataFrame, starts: DataFrame, unknown: float = -30.0, block: int | None = None) -> DataFrame:
    """``steps(seq, pos, obs)`` with ``state`` and ``score`` (of the whole best path of its block, from its first state).

    ``emissions(state, obs, logp)``, ``transitions(state, next, logp)``, ``starts(state, logp)``; ``pos`` is an integer.
    """
    size, model = BLOCK if block is None else block, Model(transitions, starts)
    types = dict(steps.dtypes)
    state_type = dict(starts.dtypes)["state"]
    blocked = steps.select("seq", F.floor(F.col("pos") / size).cast("long").alias("block"), "pos", "obs")
    rows = _seen(blocked.filter("pos IS NOT NULL"), emissions, model.states, unknown).select("seq", "block", "pos", "obs", "seen")
    sent = steps.sparkSession.sparkContext.broadcast(model)
    many = rows.groupBy("seq").agg(F.min("block").alias("a"), F.max("block").alias("b")).filter("a < b").select(F.col("seq").alias("__v_seq"))
    order = [F.col(c) for c in ("seq", "block", "pos", "obs")]
    long_ones = rows.join(many, F.col("seq").eqNullSafe(F.col("__v_seq")), "left_semi")

    decoded_as = steps.sparkSession.createDataFrame([], f"seq {types['seq']}, pos {types['pos']}, obs {types['obs']}, state {state_type}, score double")
    kinds_of = decoded_as.toArrow().schema.types

    def bridges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (seq, b), cols in _runs(batches, 2):
            m = _bridge(np.array(cols[4]), sent.value.moves).ravel().tolist()
            yield pa.RecordBatch.from_arrays([pa.array([seq], kinds_of[0]), pa.array([b], pa.int64()), pa.array([m], pa.list_(pa.float64()))], ["seq", "block", "m"])

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        k = len(m.states)
        for (seq,), cols in _runs(batches, 1):  # back pointers of a sequence's blocks: two small numbers a state and block
            best, back = None, []
            for flat in cols[2]:
                bridge = np.array(flat).reshape(k, k)
                if best is None:
                    into, entered = m.start, np.zeros(k, int)
                else:
                    ways = best[:, None] + m.moves
                    into, entered = ways.max(axis=0), ways.argmax(axis=0)
                ways = into[:, None] + bridge
                begun = ways.argmax(axis=0)
                back.append((begun.astype(np.int16), entered[begun].astype(np.int16)))
                best = ways.max(axis=0)
            last, firsts, lasts = int(best.argmax()), [], []
            possible = best[last] > -np.inf
            for begun, entered in reversed(back):
                firsts.append(int(begun[last]) if possible else -1)
                lasts.append(last if possible else -1)
                last = int(entered[last])
            yield pa.RecordBatch.from_arrays([pa.array([seq] * len(back), kinds_of[0]), pa.array(cols[1], pa.int64()), pa.array(firsts[::-1], pa.int32()), pa.array(lasts[::-1], pa.int32())], ["seq", "block", "first", "last"])

    kinds = f"seq {types['seq']}, block long"
    crossed = long_ones.repartition("seq", "block").sortWithinPartitions(*order).mapInArrow(bridges, f"{kinds}, m array<double>")
    fixed = crossed.repartition("seq").sortWithinPartitions("seq", "block").mapInArrow(ends, f"{kinds}, first int, last int")
    fixed = fixed.select(F.col("seq").alias("__v_seq"), F.col("block").alias("__v_block"), "first", "last")
    bound = rows.join(fixed, F.col("seq").eqNullSafe(F.col("__v_seq")) & (F.col("block") == F.col("__v_block")), "left")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for (seq, _), (_, _, pos, obs, seen, first, last) in _runs(batches, 2):
            begin, end = m.start, None
            if first[0] is not None:
                begin, end = np.full(len(m.states), -np.inf), last[0]
                if end >= 0:
                    begin[first[0]] = 0.0
            path, score = _path(begin, np.array(seen), m.moves, end)
            named = [None] * len(pos) if path is None else [m.states[s] for s in path]
            yield pa.RecordBatch.from_arrays([pa.array([seq] * len(pos), kinds_of[0]), pa.array(pos, kinds_of[1]), pa.array(obs, kinds_of[2]), pa.array(named, kinds_of[3]), pa.array([score] * len(pos), pa.float64())], ["seq", "pos", "obs", "state", "score"])

    decoded = bound.select("seq", "block", "pos", "obs", "seen", "first", "last").repartition("seq", "block").sortWithinPartitions(*order).mapInArrow(decode, decoded_as.schema)
    none = steps.filter("pos IS NULL").select("seq", "pos", "obs", F.lit(None).cast(state_type).alias("state"), F.lit(None).cast("double").alias("score"))
    return decoded.union(none)


def estimated(steps: DataFrame, label: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(emissions, transitions, starts) of ``steps(seq, pos, obs, label)`` by counts, each with one added for every known pair.

    Neighbours are rows whose ``pos`` differs by one; the first row of a sequence is the one without a neighbour before.
    """
    own = steps.filter(F.col(label).isNotNull() & F.col("pos").isNotNull() & F.col("obs").isNotNull()).select("seq", "pos", "obs", F.col(label).alias("state"))
    states = sorted(r.state for r in own.select("state").distinct().limit(MOST_STATES + 1).collect())
    if len(states) > MOST_STATES:
        raise ValueError(f"more than {MOST_STATES} states")
    every = lambda name: F.explode(F.array(*map(F.lit, states)).cast(f"array<{dict(own.dtypes)['state']}>")).alias(name)
    one = steps.sparkSession.range(1).select(every("state"))

    def logs(counts: DataFrame, all_pairs: DataFrame, keys: list[str]) -> DataFrame:
        c = all_pairs.join(counts, keys, "left").withColumn("c", F.coalesce("c", F.lit(0)) + 1)
        if len(keys) == 1:
            return c.select(*keys, F.log(F.col("c") / F.lit(c.agg(F.sum("c")).first()[0])).alias("logp"))
        return c.join(c.groupBy("state").agg(F.sum("c").alias("t")), "state").select(*keys, F.log(F.col("c") / F.col("t")).alias("logp"))

    emissions = logs(own.groupBy("state", "obs").agg(F.count(F.lit(1)).alias("c")), own.select("obs").distinct().select("obs", every("state")), ["state", "obs"])
    after = own.select(F.col("seq").alias("s2"), (F.col("pos") - 1).alias("p2"), F.col("state").alias("next"))
    moved = own.join(after, (F.col("seq") == F.col("s2")) & (F.col("pos") == F.col("p2"))).groupBy("state", "next").agg(F.count(F.lit(1)).alias("c"))
    transitions = logs(moved, one.select("state", every("next")), ["state", "next"])
    before = own.select(F.col("seq").alias("s2"), (F.col("pos") + 1).alias("p2"))
    first = own.join(before, (F.col("seq") == F.col("s2")) & (F.col("pos") == F.col("p2")), "left_anti").groupBy("state").agg(F.count(F.lit(1)).alias("c"))
    return emissions, transitions, logs(first, one, ["state"])
