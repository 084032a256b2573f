"""Substring dedup: passages of 50 words that an earlier document has go.

Super-k-mer partitioning (``windows``): consecutive windows that share a
minimiser travel as one packed string to its bucket; there all windows are
sorted as strings, so equal ones stand together and are counted exactly.

A word is removed if a window covers it whose word sequence also starts in a
document with a smaller doc_id, judged on the input.

Defined results: null and empty texts have no words; documents of fewer than 50
words have no window and stay whole; a row without doc_id stays whole and
removes nothing; rows that repeat a doc_id don't remove each other's words, and
with equal texts they get equal results. White space between words that stay
becomes one space.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common
from .windows import Scheme, covered, cut_words, spans

SCHEME = Scheme(window=50, gram=8, cut=cut_words)


def resolve(chunk: list[tuple]) -> list[list[tuple[int, int, int]]]:
    """Sort the windows of all packed strings; runs of windows with one least doc_id."""
    w = SCHEME.window
    keys: list[bytes] = []
    place: list[int] = []
    for nth, row in enumerate(chunk):
        packed = row[-1]
        space = np.flatnonzero(np.frombuffer(packed, np.uint8) == 32).tolist()
        starts, ends = [0, *[s + 1 for s in space]], [*space, len(packed)]
        keys += [packed[a:b] for a, b in zip(starts, ends[w - 1 :])]
        place += [nth] * (len(starts) - w + 1)
    least = [0] * len(keys)
    order = sorted(range(len(keys)), key=keys.__getitem__)
    i = 0
    while i < len(order):
        j, key = i, keys[order[i]]
        low = chunk[place[order[i]]][3]
        while j < len(order) and keys[order[j]] == key:
            low = min(low, chunk[place[order[j]]][3])
            j += 1
        for k in order[i:j]:
            least[k] = low
        i = j
    out: list[list[tuple[int, int, int]]] = [[] for _ in chunk]
    at = 0
    for nth, row in enumerate(chunk):
        n = row[5]
        own = np.array(least[at : at + n])
        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        size = np.diff(np.concatenate((first, [n])))
        out[nth] = list(zip(first.tolist(), size.tolist(), own[first].tolist()))
        at += n
    return out


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])
    sink = common.Sink(schema)
    for doc, body, found in common.rows(batches):
        words = body.split()
        gone = 0
        if found:
            hit = covered(found, SCHEME, len(words))
            gone = int(hit.sum())
            kept = b" ".join([w for w, h in zip(words, hit.tolist()) if not h])
        else:
            kept = b" ".join(words)
        if sink.add((doc, len(words), gone, kept), 64 + len(kept)):
            yield sink.flush()
    yield sink.flush()


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for each row."""
    found = spans(docs, SCHEME, resolve, True, id_col, text_col)
    return found.mapInArrow(_apply, "doc_id long, n_words long, n_removed long, kept string")
