"""Lloyd's k-means in one or several subspaces, and its starts.

Centroids are small (their size is checked) and live on the driver between
rounds; a round broadcasts them, each task sends one count and one sum a
centroid that it has rows for, and the driver gets one row a centroid. An empty
cluster keeps its centroid; ties go to the lowest centroid.

k-means++ is inherently sequential: it runs on a bounded sample (``SAMPLE``
values at most, rows by a seeded hash of their ids; all rows where the base is
smaller), with a running minimum of distances and a roulette on cumulative sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scan

#: Doubles of all centroids together.
MAX_VALUES = 8 << 20
#: Values of the sample that k-means++ draws its seeds from.
SAMPLE = 8 << 20
#: Values of the differences of rows and centroids that are held at once.
_STEP = 4 << 20


def nearest(x: np.ndarray, centroids: np.ndarray, metric: str) -> np.ndarray:
    """The centroid of each row: greatest inner product, or least squared L2."""
    if metric == "ip":
        return np.argmax(x @ centroids.T, axis=1)
    out = np.zeros(len(x), np.int64)
    step = max(1, _STEP // max(1, centroids.size))
    for at in range(0, len(x), step):
        # differences first: the expanded square would round otherwise
        out[at : at + step] = np.argmin(((x[at : at + step, None, :] - centroids[None, :, :]) ** 2).sum(axis=2), axis=1)
    return out


def initial(base: DataFrame, k: int, init: str = "first_k", seed: int = 0) -> np.ndarray:
    """k rows as centroids: the first by id, by a seeded hash of the id, or k-means++."""
    scan.check_positive(k=k)
    if init == "kmeans++":
        return plus_plus(base, k, seed)
    order = {"first_k": F.col("id"), "random": F.xxhash64(F.col("id"), F.lit(seed))}[init]
    rows = base.orderBy(order, "id").limit(k).collect()
    if len(rows) < k:
        raise ValueError(f"{len(rows)} rows for {k} centroids")
    return np.array([r["vec"] for r in rows], np.float64)


def sample(base: DataFrame, seed: int = 0) -> np.ndarray:
    """Vectors by id: all of them, or those that a seeded hash of the id puts first, up to ``SAMPLE`` values."""
    width = base.select(F.max(F.size("vec"))).first()[0]
    if not width:
        raise ValueError("no rows")
    found = base.select("id", "vec").orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(max(1, SAMPLE // width)).toArrow()
    return scan.matrix(found.take(np.argsort(found["id"].to_numpy(), kind="stable")).column("vec"))


def seeds_of(x: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """k-means++: the first row, then rows drawn with probability as their squared distance to the seeds.

    The draw is the first row whose cumulative sum reaches a random part of the
    total; where all distances are zero, the first row again.
    """
    draw = np.random.default_rng(seed)
    chosen = [0]
    least = ((x - x[0]) ** 2).sum(axis=1)
    while len(chosen) < k:
        sums = np.cumsum(least)
        pick = int(np.searchsorted(sums, draw.random() * sums[-1], "right")) if sums[-1] > 0 else 0
        chosen.append(min(pick, len(x) - 1))
        least = np.minimum(least, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return x[chosen]


def plus_plus(base: DataFrame, k: int, seed: int = 0) -> np.ndarray:
    return seeds_of(sample(base, seed), k, seed)


def lloyd(base: DataFrame, centroids: np.ndarray, rounds: int, metric: str) -> np.ndarray:
    """centroids: subspaces * k * width; the columns of a row are cut in that many slices."""
    if centroids.size > MAX_VALUES:
        raise ValueError(f"centroids have over {MAX_VALUES} values")
    parts, k, width = centroids.shape
    for _ in range(rounds):
        now = base.sparkSession.sparkContext.broadcast(centroids)

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = now.value
            count, total = np.zeros(parts * k, np.int64), np.zeros((parts * k, width))
            for batch in batches:
                for at in range(0, batch.num_rows, scan.BATCH):
                    x = scan.matrix(batch.column(0).slice(at, scan.BATCH))
                    for m in range(parts):
                        part = x[:, m * width : (m + 1) * width]
                        to = m * k + nearest(part, own[m], metric)
                        np.add.at(count, to, 1)
                        np.add.at(total, to, part)
            used = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(count[used]), scan.list_of(total[used], pa.float64())], names=["c", "n", "s"])

        partial = base.select("vec").mapInArrow(sums, "c long, n long, s array<double>")
        whole = partial.groupBy("c").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("s", F.lit(i))) for i in range(width)]).alias("s"))
        new = centroids.reshape(parts * k, width).copy()
        found = whole.toArrow()  # one row a centroid
        if found.num_rows:
            new[found["c"].to_numpy()] = scan.matrix(found["s"]) / found["n"].to_numpy()[:, None]
        centroids = new.reshape(parts, k, width)
        now.unpersist()
    return centroids


def assign(base: DataFrame, centroids: np.ndarray, metric: str) -> DataFrame:
    """base(id, vec) with list_id, the nearest centroid."""
    shared = base.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = nearest(scan.matrix(b.column("vec")), shared.value, metric) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("vec"), pa.array(lists.astype(np.int32))], names=["id", "vec", "list_id"])

    kind = base.schema["vec"].dataType.simpleString()
    return base.select("id", "vec").mapInArrow(run, f"id long, vec {kind}, list_id int")


def centroid_frame(spark, centroids: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centroids)], "list_id int, cvec array<double>")
