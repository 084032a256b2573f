"""Which windows of W tokens occur more than once, by super-k-mers.

Tokens are words or bytes. The minimiser of a window is the smallest hash of
its grams (m consecutive tokens). Consecutive windows with one minimiser form a
super-k-mer; equal windows have equal minimisers, so they meet in one bucket.

1. ``_instances``: one row for each super-k-mer: place, minimiser and a 128-bit
   digest of its packed string; no text. Written as a table in the shared folder.
2. Minimisers seen once (and once in their super-k-mer, unless only windows of
   different documents count) hold no repeated window and stop here. Where all
   super-k-mers of a minimiser are one string, all their windows repeat.
3. Of the other minimisers one packed string for each digest travels to the
   bucket of its minimiser, where ``resolve`` decides about its windows.
4. A minimiser with over ``HOT`` different strings or ``HOT_BYTES`` of them is
   dealt again: its strings are cut by a second minimiser, the pieces that are
   equal become one, and they travel to buckets of their own, where the same
   ``resolve`` decides. The second minimiser is the smallest hash among the
   grams that few strings of the bucket have (a common passage has only grams
   that many have; what stands beside it differs), or among all if there are
   none. A bucket that is still too large is cut a third time with longer grams,
   and then to single windows, which travel with their bytes too.
5. Verdicts go back to all instances and become spans of the documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Different packed strings of one minimiser, and their bytes, that one task resolves at once at most; a suffix array of
#: so many bytes takes some 0.2 GB in the worker.
HOT, HOT_BYTES = 2000, 2 << 20
#: A gram is common in a hot bucket if more than the COMMON-th part of ``HOT`` strings, and the COMMON_PART-th of the
#: bucket's, have it, as estimated from one of ``SAMPLED`` strings: the estimate steers the dealing, not the results.
COMMON, COMMON_PART, SAMPLED = 4, 1024, 16
#: Times that a bucket is cut by a minimiser again before its windows travel alone, and parts of the join that tells tasks the common grams.
RECUTS, SALTS = 2, 16
#: Tokens hashed at once, and bytes of packed strings resolved at once.
SEGMENT, CHUNK = 1 << 19, 512 << 10
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


@dataclass(frozen=True)
class Scheme:
    """``cut`` gives a text's normal form, the first byte of each token and the byte behind it, and token hashes."""

    window: int
    gram: int
    cut: Callable[[bytes], tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]


def cut_words(text: bytes) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    words = text.split()
    normal = b" ".join(words)
    spaces = np.flatnonzero(np.frombuffer(normal, np.uint8) == 32)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if not words:
        return normal, spaces, spaces, hashes
    return normal, np.concatenate(([0], spaces + 1)), np.concatenate((spaces, [len(normal)])), hashes


_BYTE_HASH = np.array([xxhash.xxh3_64_intdigest(bytes([b])) for b in range(256)], np.uint64)


def cut_bytes(text: bytes) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    starts = np.arange(len(text) + 1)
    return text, starts[:-1], starts[1:], _BYTE_HASH[np.frombuffer(text, np.uint8)]


def _grams(tokens: np.ndarray, m: int) -> np.ndarray:
    """A hash of each run of m tokens; m is a power of two."""
    out, base, span = tokens, _BASES[0], 1
    while span < m:
        out = out[:-span] * base + out[span:]
        base, span = base * base, 2 * span
    out = out ^ (out >> np.uint64(31))
    out *= _MIX
    return out ^ (out >> np.uint64(29))


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    out, span = values, 1
    while 2 * span <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def _runs_of(order: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, minimiser) of the runs of windows with one minimiser, given the grams' order."""
    least = _sliding_min(order, window - gram + 1)
    first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    size = np.diff(np.concatenate((first, [len(least)])))
    if size.max() > 4 * window:  # cut the runs of periodic text
        pieces = -(-size // (4 * window))
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        end = np.repeat(first + size, pieces)
        first = np.repeat(first, pieces) + nth * 4 * window
        size = np.minimum(4 * window, end - first)
    return first, size, least[first]


def super_kmers(hashes: np.ndarray, scheme: Scheme) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first window, number of windows, minimiser, whether it has the minimiser twice) of all runs, a segment at a time."""
    w = scheme.window
    total = len(hashes) - w + 1
    with np.errstate(over="ignore"):
        for at in range(0, max(0, total), SEGMENT):
            part = hashes[at : min(at + SEGMENT, total) + w - 1]
            grams = _grams(part, scheme.gram)
            first, size, least = _runs_of(grams, w, scheme.gram)
            ends = (first + size + (w - scheme.gram)).tolist()
            twice = [np.count_nonzero(grams[a:b] == m) > 1 for a, b, m in zip(first.tolist(), ends, least)]
            yield first + at, size, least, np.array(twice)


_INSTANCE = "doc_id long, th long, start int, n int, mini long, ph1 long, ph2 long, twice boolean"


def _instances(scheme: Scheme) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "th", "start", "n", "mini", "ph1", "ph2", "twice"]
        for doc, th, body in common.rows(batches):
            if len(body) < scheme.window:
                continue
            normal, starts, ends, hashes = scheme.cut(body)
            for first, size, least, twice in super_kmers(hashes, scheme):
                a, b = starts[first].tolist(), ends[first + size + (scheme.window - 2)].tolist()
                digests = b"".join([xxhash.xxh3_128_digest(normal[i:j]) for i, j in zip(a, b)])
                halves = np.frombuffer(digests, "<i8").reshape(-1, 2)
                arrays = [np.full(len(first), doc, np.int64), np.full(len(first), th, np.int64), first.astype(np.int32), size.astype(np.int32), least.view(np.int64), halves[:, 0], halves[:, 1], twice]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in arrays], names=names)

    return run


_PACKED = "mini long, ph1 long, ph2 long, doc_id long, c long, n int, packed binary"
_PACKED_ARROW = pa.schema(
    [("mini", pa.int64()), ("ph1", pa.int64()), ("ph2", pa.int64()), ("doc_id", pa.int64()), ("c", pa.int64()), ("n", pa.int32()), ("packed", pa.binary())]
)


def _pack(scheme: Scheme) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink = common.Sink(_PACKED_ARROW, 1 << 20)
        for doc, body, wanted in common.rows(batches):
            if not wanted:
                continue
            normal, starts, ends, _ = scheme.cut(body)
            for x in wanted:
                packed = normal[starts[x["start"]] : ends[x["start"] + x["n"] + scheme.window - 2]]
                if sink.add((x["mini"], x["ph1"], x["ph2"], doc, x["c"], x["n"], packed), 64 + len(packed)):
                    yield sink.flush()
        yield sink.flush()

    return run


_RUN = "mini long, ph1 long, ph2 long, off int, len int, least long"
_RUN_ARROW = pa.schema([("mini", pa.int64()), ("ph1", pa.int64()), ("ph2", pa.int64()), ("off", pa.int32()), ("len", pa.int32()), ("least", pa.int64())])

#: Rows (mini, ph1, ph2, doc_id, c, n, packed) of whole minimisers in; for each row its (offset, length, least doc_id).
Resolve = Callable[[list[tuple]], list[list[tuple[int, int, int]]]]


def _buckets(resolve: Resolve) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink = common.Sink(_RUN_ARROW, 1 << 20)

        def settle(chunk):
            for row, runs in zip(chunk, resolve(chunk)):
                for off, length, least in runs:
                    sink.add((*row[:3], off, length, least))

        chunk, size, last = [], 0, None
        for row in common.rows(batches):
            if size >= CHUNK and row[0] != last:
                settle(chunk)
                yield sink.flush()
                chunk, size = [], 0
            chunk.append(row)
            size += len(row[-1])
            last = row[0]
        if chunk:
            settle(chunk)
        yield sink.flush()

    return run


def _gram(scheme: Scheme, level: int) -> int:
    """The scheme's gram, then four times as long."""
    return scheme.gram << 2 * (level - 1)


def _own_grams(scheme: Scheme, packed: bytes, level: int) -> np.ndarray:
    """Hashes of a packed string's grams, in an order of the level's own; grams are longer from level to level."""
    with np.errstate(over="ignore"):
        grams = _grams(scheme.cut(packed)[3], _gram(scheme, level))
        return grams * _BASES[level % 2] ^ grams >> np.uint64(29)


def _counted(scheme: Scheme, level: int) -> Callable:
    """(mini, kinds, g, n): in how many packed strings of the task a gram is."""
    schema = pa.schema([("mini", pa.int64()), ("kinds", pa.int64()), ("g", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[np.ndarray]] = {}
        size = 0

        def flush():
            for (mini, kinds), parts in held.items():
                found, n = np.unique(np.concatenate(parts), return_counts=True)
                k = len(found)
                columns = [np.full(k, mini, np.int64), np.full(k, kinds, np.int64), found.view(np.int64), n.astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)

        for mini, kinds, packed in common.rows(batches):
            held.setdefault((mini, kinds), []).append(np.unique(_own_grams(scheme, packed, level)))
            size += len(held[mini, kinds][-1])
            if size > 2 << 20:
                yield from flush()
                held, size = {}, 0
        yield from flush()

    return run


_RECUT = "pm long, p1 long, p2 long, at int, mini long, ph1 long, ph2 long, doc_id long, c long, n int, packed binary"
_RECUT_ARROW = pa.schema([("pm", pa.int64()), ("p1", pa.int64()), ("p2", pa.int64()), ("at", pa.int32()), *_PACKED_ARROW])


def _recut(scheme: Scheme, level: int) -> Callable:
    """Pieces of packed strings by the second minimiser; single windows behind the last level."""
    w, gram = scheme.window, _gram(scheme, level)

    def runs(packed: bytes, known: list[int] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if level > RECUTS:
            total = len(scheme.cut(packed)[3]) - w + 1
            return np.arange(total), np.ones(total, np.int64), np.zeros(total, np.uint64)
        grams = _own_grams(scheme, packed, level)
        late = np.isin(grams, np.array(known or (), np.int64).view(np.uint64))
        return _runs_of(grams >> np.uint64(1) | late.astype(np.uint64) << np.uint64(63), w, gram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink = common.Sink(_RECUT_ARROW, 1 << 20)
        for mini, ph1, ph2, doc, c, packed, known in common.rows(batches):
            normal, starts, ends, _ = scheme.cut(packed)
            first, size, least = runs(packed, known)
            for at, n, key in zip(first.tolist(), size.tolist(), least.tolist()):
                piece = normal[starts[at] : ends[at + n + w - 2]]
                digest = xxhash.xxh3_128_digest(piece)
                half = int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)
                own = xxhash.xxh3_64_intdigest(piece if level > RECUTS else key.to_bytes(8, "little"), mini & (1 << 64) - 1)
                new = own - (1 << 64) if own >= 1 << 63 else own
                if sink.add((mini, ph1, ph2, at, new, *half, doc, c, n, piece), 100 + len(piece)):
                    yield sink.flush()
        yield sink.flush()

    return run


def _merged_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of each string in order; those that touch and have one least doc_id become one."""
    sink = common.Sink(_RUN_ARROW, 1 << 20)
    for mini, ph1, ph2, runs in common.rows(batches):
        out: list[list[int]] = []
        for off, length, least in sorted((r["off"], r["len"], r["least"]) for r in runs):
            if out and out[-1][2] == least and off <= out[-1][0] + out[-1][1]:
                out[-1][1] = max(out[-1][1], off + length - out[-1][0])
            else:
                out.append([off, length, least])
        for run in out:
            if sink.add((mini, ph1, ph2, *run)):
                yield sink.flush()
    yield sink.flush()


def _decide(packed: DataFrame, scheme: Scheme, resolve: Resolve, across: bool, level: int = 0) -> DataFrame:
    """Runs of the windows of packed strings, with the least doc_id that has each."""

    def settled(rows: DataFrame) -> DataFrame:
        return rows.repartition("mini").sortWithinPartitions("mini").mapInArrow(_buckets(resolve), _RUN)

    packed = packed.select(*_PACKED_ARROW.names)
    if level > RECUTS + 1:
        return settled(packed)
    sizes = packed.groupBy("mini").agg(F.count(F.lit(1)).alias("kinds"), F.sum(F.octet_length("packed")).alias("bytes"))
    large = common.written(sizes.where((F.col("kinds") > HOT) | (F.col("bytes") > HOT_BYTES) & (F.col("kinds") > 1)).select("mini", "kinds"), "large")
    if large.isEmpty():
        return settled(packed)
    runs = settled(packed.join(large, "mini", "left_anti"))
    level += 1
    hot = packed.join(large, "mini").withColumn("salt", F.pmod("ph1", F.lit(SALTS)))
    if level <= RECUTS:
        often = (
            hot.where(F.pmod(F.xxhash64("ph1", "ph2"), F.lit(SAMPLED)) == 0)
            .select("mini", "kinds", "packed")
            .mapInArrow(_counted(scheme, level), "mini long, kinds long, g long, n long")
            .groupBy("mini", "kinds", "g")
            .agg(F.sum("n").alias("n"))
            .where((F.col("n") * SAMPLED > HOT / COMMON) & (F.col("n") * SAMPLED > F.col("kinds") / COMMON_PART))
        )
        # not more than COMMON_PART times the grams of one string
        known = often.groupBy("mini").agg(F.collect_list("g").alias("known")).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        hot = hot.join(known, ["mini", "salt"], "left")
    else:
        hot = hot.withColumn("known", F.lit(None).cast("array<long>"))
    pieces = common.written(hot.select("mini", "ph1", "ph2", "doc_id", "c", "packed", "known"), "recut", _recut(scheme, level), _RECUT)
    keys = ["mini", "ph1", "ph2"]
    again = pieces.groupBy(*keys).agg(F.min("doc_id").alias("doc_id"), F.sum("c").alias("c"), F.first("n").alias("n"), F.first("packed").alias("packed"))
    if level <= RECUTS:
        again = common.written(again, "pieces")
    found = _decide(again, scheme, resolve, across, level)
    back = pieces.select("pm", "p1", "p2", "at", F.col("doc_id").alias("own"), *keys).join(found, keys)
    # all that the string's instances ask of a least doc_id is whether it is below the least of their own
    least = F.greatest("least", F.col("own") - 1) if across else F.lit(0).cast("long")
    of_string = back.groupBy(F.col("pm").alias("mini"), F.col("p1").alias("ph1"), F.col("p2").alias("ph2")).agg(
        F.collect_list(F.struct((F.col("at") + F.col("off")).alias("off"), "len", least.alias("least"))).alias("runs")
    )
    return runs.unionByName(of_string.mapInArrow(_merged_runs, _RUN))


def spans(docs: DataFrame, scheme: Scheme, resolve: Resolve, across: bool, id_col: str, text_col: str) -> DataFrame:
    """Every row of docs with ``_spans``: array of (at, n), windows to remove: n from the at-th on.

    across: a window goes if a smaller doc_id has it; else if it occurs anywhere else.
    """
    common.session(docs)
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), common.utf8(text_col).alias("b")).select("doc_id", F.xxhash64("b").alias("th"), "b")
    found = common.written(text.where("doc_id is not null"), "superkmers", _instances(scheme), _INSTANCE)
    ends = [f(c).alias(f"{name}_{c}") for c in ("ph1", "ph2") for name, f in (("lo", F.min), ("hi", F.max))]
    repeated = (
        found.groupBy("mini")
        .agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("c"), F.max("twice").alias("twice"), *ends)
        .where("lo < hi" if across else "c > 1 or twice")
        .select("mini", "lo", F.expr("c > 1 and lo_ph1 = hi_ph1 and lo_ph2 = hi_ph2").alias("same"))
    )
    cand = common.written(found.drop("twice").join(repeated, "mini"), "candidates")
    whole = cand.where("same and doc_id > lo" if across else "same").select("doc_id", "th", F.col("start").alias("at"), "n")
    mixed = cand.where("not same")

    kinds = mixed.groupBy("mini", "ph1", "ph2").agg(F.min(F.struct("doc_id", "th", "start", "n")).alias("rep"), F.count(F.lit(1)).alias("c"))
    wanted = kinds.groupBy(F.col("rep.doc_id").alias("_doc"), F.col("rep.th").alias("_th")).agg(
        F.collect_list(F.struct("rep.start", "rep.n", "mini", "ph1", "ph2", "c")).alias("wanted")
    )
    own = (text["doc_id"] == wanted["_doc"]) & (text["th"] == wanted["_th"])
    packed = common.written(text.join(wanted, own).select("doc_id", "b", "wanted"), "packed", _pack(scheme), _PACKED)
    runs = _decide(packed, scheme, resolve, across)

    back = mixed.join(runs, ["mini", "ph1", "ph2"])
    back = back.where("doc_id > least") if across else back
    marked = whole.unionByName(back.select("doc_id", "th", (F.col("start") + F.col("off")).alias("at"), F.col("len").alias("n")))
    of_doc = marked.groupBy(F.col("doc_id").alias("_doc"), F.col("th").alias("_th")).agg(F.collect_list(F.struct("at", "n")).alias("_spans"))
    return text.join(of_doc, (text["doc_id"] == of_doc["_doc"]) & (text["th"] == of_doc["_th"]), "left").select("doc_id", "b", "_spans")


def covered(spans_: list[dict] | None, scheme: Scheme, tokens: int) -> np.ndarray:
    """Which tokens the removed windows cover."""
    edge = np.zeros(tokens + 1, np.int64)
    for s in spans_ or ():
        edge[min(s["at"], tokens)] += 1
        edge[min(s["at"] + s["n"] + scheme.window - 1, tokens)] -= 1
    return np.cumsum(edge)[:-1] > 0
