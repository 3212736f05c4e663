"""Trained segmentation: lines that begin a segment (paragraph, section, page), or belong to a title, by their looks.

A line is described by what it and its neighbours look like (lengths, letters, digits, marks, blanks, case), by its first and last
character, its length against the text's median and its printable ASCII characters. A logistic model over labelled lines, fitted by
Spark over all of them, gives a line's chance; it is a few hundred numbers, so texts are segmented inside their row and
nothing is shuffled. Features are made for ``CHUNK`` lines at a time, however long the text.

Defined results: lines end at ``\\r\\n``, ``\\n\\r``, ``\\n`` or ``\\r``; places count code points, an end is exclusive. Segments of
blanks alone are left out. A text without a line that begins a segment is one segment; null, empty and blank texts have none.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 2048
_BREAK = re.compile("\r\n|\n\r|\n|\r")
_LOOKS = 10  # numbers that describe one line
_ASCII = 95
_DIGITS, _MARKS = frozenset("0123456789"), frozenset("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


@dataclass(frozen=True)
class LineModel:
    before: int
    after: int
    weights: np.ndarray
    offset: float


def line_places(text: str) -> list[tuple[int, int, int]]:
    """(start, end, next) of each line; ``end`` is before its break, ``next`` behind it. A text that ends in a break has no further line."""
    out, at = [], 0
    for m in _BREAK.finditer(text):
        out.append((at, m.start(), m.end()))
        at = m.end()
    return out if at == len(text) else [*out, (at, len(text), len(text))]


@cache
def _classes() -> np.ndarray:
    """1 letter, 2 number, 3 mark, 4 separator, 0 else, for each code point."""
    kinds = {"L": 1, "N": 2, "P": 3, "Z": 4}
    return np.array([kinds.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)], np.uint8)


def _looks(text: str, places: list[tuple[int, int, int]]) -> np.ndarray:
    out = np.zeros((len(places), _LOOKS), np.float32)
    for row, (a, b, _) in zip(out, places, strict=True):
        line = text[a:b]
        bare = line.strip()
        kinds = np.bincount(_classes()[np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)], minlength=5)
        row[:] = (len(line), len(bare), line == line.title(), line == line.upper(), *kinds[1:5], not bare, bare.endswith((".", "!", "?", ":", ";")))
    return out


def features(text: str, before: int, after: int) -> Iterator[tuple[int, np.ndarray]]:
    """(number of the first line, features of ``CHUNK`` lines) along a text."""
    places = line_places(text)
    if not places:
        return
    middle = max(float(np.median([b - a for a, b, _ in places])), 1.0)
    for at in range(0, len(places), CHUNK):
        own = places[at : at + CHUNK]
        low = max(at - before, 0)
        near = _looks(text, places[low : at + CHUNK + after])
        wide = np.full((len(own) + before + after, _LOOKS), -1, np.float32)  # beyond the text there is no line
        wide[before - (at - low) : before - (at - low) + len(near)] = near
        window = np.hstack([wide[k : k + len(own)] for k in range(before + after + 1)])
        rest = np.zeros((len(own), 5 + _ASCII), np.float32)
        for row, (a, b, _) in zip(rest, own, strict=True):
            bare = text[a:b].strip()
            if bare:
                row[:4] = bare[0] in _MARKS, bare[-1] in _MARKS, bare[0] in _DIGITS, bare[-1] in _DIGITS
            row[4] = len(bare) / middle
            codes = np.frombuffer(text[a:b].encode("ascii", "ignore"), np.uint8)
            row[5:] = np.bincount(codes[(codes >= 32) & (codes < 127)] - 32, minlength=_ASCII)
        yield at, np.hstack([window, rest])


def line_features(docs: DataFrame, before: int = 3, after: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, line, features) of every line; lines count from 0."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, text in enumerate(b.column(1)):
                for at, x in features(text.as_py() or "", before, after):
                    ids = pa.array([b.column(0)[i].as_py()] * len(x), b.column(0).type)
                    flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel(), pa.float32()))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(np.arange(at, at + len(x)), pa.int32()), flat], [id_col, "line", "features"])

    return docs.select(id_col, text_col).mapInArrow(of, f"{id_col} {dict(docs.dtypes)[id_col]}, line int, features array<float>")


def fit_lines(docs: DataFrame, marked: DataFrame, before: int = 3, after: int = 3, penalty: float = 1e-4, id_col: str = "doc_id", text_col: str = "text") -> LineModel:
    """Learn which lines of ``docs`` (unique ids) are in ``marked(id_col, line)``; all lines of ``docs`` train, both kinds must occur."""
    own = marked.select(id_col, "line").distinct().withColumn("label", F.lit(1.0))
    lines = line_features(docs, before, after, id_col, text_col).join(own, [id_col, "line"], "left").select(array_to_vector("features").alias("features"), F.coalesce("label", F.lit(0.0)).alias("label"))
    model = LogisticRegression(regParam=penalty, maxIter=100).fit(lines)
    return LineModel(before, after, model.coefficients.toArray(), float(model.intercept))


def found_lines(model: LineModel, text: str, threshold: float) -> np.ndarray:
    """Which lines of a text the model takes."""
    cut = np.log(threshold / (1 - threshold))
    parts = [x @ model.weights + model.offset >= cut for _, x in features(text, model.before, model.after)]
    return np.concatenate(parts) if parts else np.zeros(0, bool)


def _between(text: str, places: list, taken: np.ndarray) -> Iterator[tuple[int, int]]:
    starts = [0, *(places[i][0] for i in np.flatnonzero(taken) if i), len(text)]
    yield from zip(starts, starts[1:])


def _runs(text: str, places: list, taken: np.ndarray) -> Iterator[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], taken.astype(np.int8), [0]])))
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        yield places[a][0], places[b - 1][1]


def segments(model: LineModel, docs: DataFrame, threshold: float = 0.5, titles: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, nth, start, end, text): from each line that the model takes to the next; ``titles``: runs of such lines instead."""
    spans = _runs if titles else _between

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, value in enumerate(b.column(1)):
                text = value.as_py() or ""
                found = [(s, e) for s, e in spans(text, line_places(text), found_lines(model, text, threshold)) if text[s:e].strip()]
                for at in range(0, len(found), CHUNK):
                    own = found[at : at + CHUNK]
                    ints = lambda xs: pa.array(list(xs), pa.int32())
                    ids = pa.array([b.column(0)[i].as_py()] * len(own), b.column(0).type)
                    yield pa.RecordBatch.from_arrays([ids, ints(range(at, at + len(own))), ints(s for s, _ in own), ints(e for _, e in own), pa.array([text[s:e] for s, e in own])], [id_col, "nth", "start", "end", "text"])

    return docs.select(id_col, text_col).mapInArrow(of, f"{id_col} {dict(docs.dtypes)[id_col]}, nth int, start int, end int, text string")
