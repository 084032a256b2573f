"""Top-k of a scored scan, in blocks.

The base is packed in chunks of up to ``CHUNK`` rows and the queries in blocks
of up to ``QUERY_BLOCK``; one row of the join is a chunk beside a block, scored
by one matrix product. Blocks are broadcast if all queries together have at
most ``BROADCAST_BYTES``; more stay partitioned, and blocks meet chunks in the
tasks of a product of partitions. A task keeps a running top-k for each block
and gives out at most k rows a query, so the shuffle has tasks * queries * k
rows, whatever the base has.

Vectors are read from Arrow's flat buffers; null vectors or elements, elements
that aren't finite, and vectors of different lengths are refused there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Query vectors of a block, and base rows of a chunk.
QUERY_BLOCK, CHUNK = 2048, 2048
#: Bytes of all query vectors together, up to which they are broadcast.
BROADCAST_BYTES = 64 << 20
#: Hits that a task holds before it gives them out, and blocks that it keeps prepared.
HELD, PREPARED = 2 << 20, 8
#: Rows of smaller steps inside a batch, and pairs that a task gives out at once.
BATCH, PAIRS = 1024, 1 << 17
HITS = "qid long, id long, dist double"

#: From a chunk: estimated distances, queries by rows (infinity excludes), and their exact values for pairs of places, or None if they are exact.
Score = Callable[[pa.RecordBatch], tuple[np.ndarray, Callable[[np.ndarray, np.ndarray], np.ndarray] | None]]
#: From the vectors of a query block and the number of its list, if any: the score.
Prepare = Callable[[np.ndarray], Score]


def check_positive(**sizes: int) -> None:
    for name, value in sizes.items():
        if not isinstance(value, int) or value <= 0:
            raise ValueError(f"{name} must be a positive whole number, not {value}")


def matrix(column: pa.Array, dtype=np.float64) -> np.ndarray:
    """The vectors of an Arrow list column as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if column.null_count:
        raise ValueError("a vector is null")
    flat = column.flatten()
    if flat.null_count:
        raise ValueError("a vector has a null element")
    values = flat.to_numpy(zero_copy_only=False)
    width = len(values) // n if n else 0
    if n and not pa.types.is_fixed_size_list(column.type) and (np.diff(column.offsets.to_numpy()) != width).any():
        raise ValueError("vectors have different numbers of elements")
    if values.dtype.kind == "f" and not np.isfinite(values).all():
        raise ValueError("a vector has non-finite elements")
    return values.astype(dtype).reshape(n, width)


def list_of(x: np.ndarray, dtype: pa.DataType) -> pa.ListArray:
    """Rows of a matrix as an Arrow list column."""
    n, width = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(x.ravel(), dtype))


def _to_bytes(batch: pa.RecordBatch) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema) as stream:
        stream.write_batch(batch)
    return out.getvalue().to_pybytes()


def _from_bytes(raw: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(pa.py_buffer(raw)).read_next_batch()


def _of_size(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            cut = n // rows * rows
            for at in range(0, cut, rows):
                yield whole.slice(at, rows)
            held, n = [whole.slice(cut)], n - cut
    if n:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def pack(df: DataFrame, rows: int, out: str, key: str | None = None) -> DataFrame:
    """(at long, out binary[, key]): the rows of each task in packs of up to ``rows``, by key if there is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, nth = TaskContext.get().partitionId() << 32, 0
        for batch in _of_size((b for b in batches if b.num_rows), rows if key is None else 8 * rows):
            parts = [(None, batch)]
            if key is not None:
                lists = batch.column(key).to_numpy()
                order = np.argsort(lists, kind="stable")
                batch, lists = batch.take(pa.array(order)), lists[order]
                cuts = [0, *(np.flatnonzero(lists[1:] != lists[:-1]) + 1).tolist(), len(lists)]
                parts = [(int(lists[i]), batch.slice(i, min(rows, b - i))) for a, b in zip(cuts, cuts[1:]) for i in range(a, b, rows)]
            columns = [pa.array(range(first + nth, first + nth + len(parts)), pa.int64()), pa.array([_to_bytes(p) for _, p in parts], pa.binary())]
            nth += len(parts)
            if key is not None:
                columns.append(pa.array([k for k, _ in parts], pa.int32()))
            yield pa.RecordBatch.from_arrays(columns, names=["at", out, key][: len(columns)])

    return df.mapInArrow(run, f"at long, {out} binary" + (f", {key} int" if key else ""))


def small(queries: DataFrame, factor: int = 1, vec_col: str = "qvec") -> bool:
    """Whether all queries, ``factor`` times, may be broadcast."""
    row = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vec_col)).alias("d")).first()
    return row["n"] * factor * 8 * ((row["d"] or 0) + 1) <= BROADCAST_BYTES


class Best:
    """The k least (dist, id) of each query of a block so far."""

    def __init__(self, qids: np.ndarray, k: int):
        self.qids, self.k = qids, k
        self.q, self.id, self.dist = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.bound = np.full(len(qids), np.inf)

    def add(self, dist: np.ndarray, ids: np.ndarray, exact: Callable | None) -> None:
        bound, k = self.bound, self.k
        if dist.shape[1] > 4 * k and np.isinf(bound).any():
            bound = np.minimum(bound, np.partition(dist, k - 1, axis=1)[:, k - 1])
        if exact is not None:  # estimates are off by some last bits
            bound = bound + 1e-9 * (1 + np.abs(np.where(np.isfinite(bound), bound, 0)))
        near = dist <= bound[:, None]
        near &= dist < np.inf
        q, r = np.nonzero(near)
        if not len(q):
            return
        d = dist[q, r] if exact is None else exact(q, r)
        q, i, d = np.concatenate((self.q, q)), np.concatenate((self.id, ids[r])), np.concatenate((self.dist, d))
        order = np.lexsort((i, d, q))
        q, i, d = q[order], i[order], d[order]
        first = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1])))
        size = np.diff(np.append(first, len(q)))
        held = np.arange(len(q)) - np.repeat(first, size) < k
        full = size >= k
        self.bound[q[first[full]]] = d[first[full] + k - 1]
        self.q, self.id, self.dist = q[held], i[held], d[held]

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.qids[self.q]), pa.array(self.id), pa.array(self.dist)], names=["qid", "id", "dist"])


def _scored(prepare: Prepare, k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, Best] = {}
        ready: dict[int, Score] = {}
        last = None
        for batch in batches:
            for chunk_at, chunk, block_at, block in zip(*(batch.column(c) for c in ("c", "chunk", "b", "block"))):
                if chunk_at.as_py() != last:
                    last, rows = chunk_at.as_py(), _from_bytes(chunk.as_py())
                    ids = rows.column("id").to_numpy()
                b = block_at.as_py()
                if b not in ready:
                    queries = _from_bytes(block.as_py())
                    while len(ready) >= PREPARED:
                        del ready[next(iter(ready))]
                    ready[b] = prepare(matrix(queries.column("qvec")))
                    if b not in best:
                        best[b] = Best(queries.column("qid").to_numpy(), k)
                for at in range(0, rows.num_rows, CHUNK):
                    best[b].add(*_with_ids(ready[b](rows.slice(at, CHUNK)), ids[at : at + CHUNK]))
            if sum(len(x.q) for x in best.values()) > HELD:
                yield from (x.batch() for x in best.values())
                best, ready = {}, {}
        yield from (x.batch() for x in best.values())

    return run


def _with_ids(scored: tuple, ids: np.ndarray) -> tuple:
    dist, exact = scored
    return dist, ids, exact


def _all(prepare: Prepare) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: dict[int, tuple[np.ndarray, Score]] = {}
        last = None
        for batch in batches:
            for chunk_at, chunk, b, block in zip(batch.column("c").to_pylist(), batch.column("chunk"), batch.column("b").to_pylist(), batch.column("block")):
                if chunk_at != last:
                    last, rows = chunk_at, _from_bytes(chunk.as_py())
                    ids = rows.column("id").to_numpy()
                if b not in ready:
                    queries = _from_bytes(block.as_py())
                    while len(ready) >= PREPARED:
                        del ready[next(iter(ready))]
                    ready[b] = queries.column("qid").to_numpy(), prepare(matrix(queries.column("qvec")))
                qids, score = ready[b]
                step = max(1, PAIRS // len(qids))
                for at in range(0, rows.num_rows, step):
                    own = ids[at : at + step]
                    dist, exact = score(rows.slice(at, step))
                    if exact is not None:
                        dist = exact(*np.indices(dist.shape).reshape(2, -1))
                    columns = [np.repeat(qids, len(own)), np.tile(own, len(qids)), dist.ravel()]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["qid", "id", "dist"])

    return run


def scan_all(base: DataFrame, queries: DataFrame, prepare: Prepare) -> DataFrame:
    """(qid, id, dist) of base(id, ...) and queries(qid, qvec), all of them: for statements and small sets; no pair is shuffled."""
    chunks = pack(base, CHUNK, "chunk").withColumnRenamed("at", "c")
    blocks = pack(queries, QUERY_BLOCK, "block").withColumnRenamed("at", "b")
    if small(queries):
        blocks = F.broadcast(blocks)
    return chunks.crossJoin(blocks).select("c", "chunk", "b", "block").mapInArrow(_all(prepare), HITS)


def rank(scored: DataFrame, k: int) -> DataFrame:
    """hits(qid, rank, id, dist): the k least by (dist, id)."""
    order = Window.partitionBy("qid").orderBy("dist", "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("qid", "rank", "id", "dist")


def scan_topk(base: DataFrame, queries: DataFrame, k: int, prepare: Prepare, key: str | None = None, broadcast: bool | None = None) -> DataFrame:
    """hits of base(id, ...) for queries(qid, qvec); with a key, a query meets the rows of its own key only."""
    check_positive(k=k)
    chunks = pack(base, CHUNK, "chunk", key).withColumnRenamed("at", "c")
    blocks = pack(queries, QUERY_BLOCK, "block", key).withColumnRenamed("at", "b")
    if broadcast if broadcast is not None else small(queries):
        blocks = F.broadcast(blocks)
    pairs = chunks.crossJoin(blocks) if key is None else chunks.join(blocks, key)
    return rank(pairs.select("c", "chunk", "b", "block").mapInArrow(_scored(prepare, k), HITS), k)
