"""Suffix-array dedup: bytes of 400-byte strings that occur more than once go.

Super-k-mers (``windows``) deal the text to buckets; in a bucket a suffix array
over the packed strings is built in two stages: only suffixes that are smaller
than their successor, and whose successor is not, are sorted directly; scans
over the first-byte buckets, downwards and then upwards, induce the rest. Each
scan handles a bucket at a time: the predecessors of its suffixes, in order,
are dealt to their own buckets. Common prefixes of adjacent suffixes then show
the strings that repeat.

Defined results: null and empty texts have no bytes; texts under 400 bytes
have no string; a row without doc_id stays whole and removes nothing; rows that
repeat a doc_id repeat each other's strings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common
from .windows import Scheme, covered, cut_bytes, spans

SCHEME = Scheme(window=400, gram=32, cut=cut_bytes)
#: Ends a string; no UTF-8 text has this byte.
_END = 0xFF


def _rises(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its successor; the last one never is."""
    n = len(text)
    change = np.append(text[:-1] != text[1:], True)
    at = np.where(change, np.arange(n), n)
    nxt = np.minimum.accumulate(at[::-1])[::-1]  # the next place where the byte changes
    up = np.append(text[:-1] < text[1:], False)
    return up[nxt]


def _deal(suffixes: np.ndarray, text: np.ndarray, held: dict[int, list[np.ndarray]], above: bool, own: int) -> None:
    """Deal the predecessors, in order, to the buckets of their first bytes on one side of the own one."""
    before = suffixes[suffixes > 0] - 1
    first = text[before]
    before = before[first > own if above else first < own]
    if len(before):
        first = text[before]
        order = np.argsort(first, kind="stable")
        first, before = first[order], before[order]
        cuts = np.flatnonzero(first[1:] != first[:-1]) + 1
        for part in np.split(before, cuts):
            held.setdefault(int(text[part[0]]), []).append(part)


def _same_byte(base: np.ndarray, text: np.ndarray, own: int, allowed: np.ndarray) -> list[np.ndarray]:
    """Predecessors with the same first byte, their predecessors, and so on."""
    out, level = [], base
    while len(level):
        level = level[level > 0] - 1
        level = level[(text[level] == own) & allowed[level]]
        if len(level):
            out.append(level)
    return out


def _sorted(text: np.ndarray, suffixes: np.ndarray, depth: int) -> np.ndarray:
    """Direct sort: by the first eight bytes as a number, then ties by the bytes behind them."""
    head = np.zeros(len(suffixes), np.uint64)
    padded = np.concatenate((text, np.zeros(8, np.uint8)))
    for k in range(8):
        head = head << np.uint64(8) | padded[suffixes + k]
    order = np.argsort(head, kind="stable")
    suffixes, head = suffixes[order], head[order]
    first = np.flatnonzero(np.concatenate(([True], head[1:] != head[:-1], [True])))
    raw, tied = text.tobytes(), np.flatnonzero(np.diff(first) > 1)
    for a, b in zip(first[tied].tolist(), first[tied + 1].tolist()):
        suffixes[a:b] = sorted(suffixes[a:b].tolist(), key=lambda i: raw[i + 8 : i + depth])
    return suffixes


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """All suffixes in the order of their first ``depth`` bytes at least."""
    n = len(text)
    rises = _rises(text)
    falls = ~rises
    turning = np.flatnonzero(rises[:-1] & falls[1:])
    turning = _sorted(text, turning, depth)
    heads = text[turning]
    used = np.unique(text).tolist()
    none = np.zeros(0, np.int64)

    up: dict[int, np.ndarray] = {}  # rising suffixes of each bucket
    held: dict[int, list[np.ndarray]] = {}
    for c in reversed(used):
        direct = turning[np.searchsorted(heads, c) : np.searchsorted(heads, c, "right")]
        second = text[direct + 1] if len(direct) else none
        by_second = {int(text[p[0] + 1]): p for p in held.pop(c, [])}
        parts = []
        for d in sorted({*by_second, *np.unique(second).tolist()}):
            parts.append(direct[np.searchsorted(second, d) : np.searchsorted(second, d, "right")])
            parts.append(by_second.get(d, none))
        base = np.concatenate(parts) if parts else none
        chain = _same_byte(base, text, c, rises)
        up[c] = np.concatenate([*reversed(chain), base])
        _deal(up[c], text, held, False, c)

    out = []
    held = {int(text[n - 1]): [np.array([n - 1])]}
    for c in used:
        base = np.concatenate(held.pop(c, [none]))
        low = np.concatenate([base, *_same_byte(base, text, c, falls)])
        full = np.concatenate([low, up[c]])
        out.append(full)
        _deal(full, text, held, True, c)
    return np.concatenate(out)


def common_prefixes(text: np.ndarray, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    """Lengths of the common prefixes of pairs of suffixes, up to ``limit`` (a multiple of eight)."""
    padded = np.concatenate((text, np.zeros(8, np.uint8)))
    words = np.lib.stride_tricks.sliding_window_view(padded, 8).copy().view("<u8")[:, 0]
    out = np.zeros(len(a), np.int64)
    alive = np.arange(len(a))
    for at in range(0, limit, 8):
        differ = words[np.minimum(a[alive] + at, len(text))] ^ words[np.minimum(b[alive] + at, len(text))]
        stop = differ != 0
        low = differ[stop] & (~differ[stop] + np.uint64(1))
        out[alive[stop]] = at + np.log2(low.astype(np.float64)).astype(np.int64) // 8
        alive = alive[~stop]
        if not len(alive):
            break
    out[alive] = limit
    return out


def resolve(chunk: list[tuple]) -> list[list[tuple[int, int, int]]]:
    """Runs of windows of each packed string that occur again in the chunk or in a string's other instances."""
    w = SCHEME.window
    joined = np.frombuffer(b"".join([row[-1] + bytes([_END]) for row in chunk]), np.uint8)
    sizes = np.array([len(row[-1]) + 1 for row in chunk])
    begin = np.cumsum(sizes) - sizes
    starts_window = np.zeros(len(joined), bool)
    for b, row in zip(begin.tolist(), chunk):
        starts_window[b : b + row[5]] = True
    order = suffix_array(joined, w)
    order = order[starts_window[order]]
    repeat = np.zeros(len(joined), bool)
    if len(order) > 1:
        same = common_prefixes(joined, order[:-1], order[1:], w) >= w
        repeat[order[:-1][same]] = True
        repeat[order[1:][same]] = True
    out = []
    for b, row in zip(begin.tolist(), chunk):
        if row[4] > 1:  # the packed string itself occurs again
            out.append([(0, row[5], 0)])
            continue
        edge = np.diff(np.concatenate(([0], repeat[b : b + row[5]].view(np.int8), [0])))
        out.append([(int(i), int(j - i), 0) for i, j in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))])
    return out


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])
    sink = common.Sink(schema)
    for doc, body, found in common.rows(batches):
        gone = runs = 0
        kept = body
        if found:
            hit = covered(found, SCHEME, len(body))
            gone = int(hit.sum())
            runs = int(hit[0]) + int((hit[1:] & ~hit[:-1]).sum())
            kept = np.frombuffer(body, np.uint8)[~hit].tobytes()
        if sink.add((doc, len(body), gone, runs, kept), 64 + len(kept)):
            yield sink.flush()
    yield sink.flush()


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary) for each row."""
    found = spans(docs, SCHEME, resolve, False, id_col, text_col)
    return found.mapInArrow(_apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
