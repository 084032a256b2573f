"""Inverted lists: plain, and with product-quantized rows.

A row belongs to the list whose centroid has the greatest inner product with
it (centroids aren't normalised). An index is a folder: lists partitioned by
list_id, the centroids, and the codebook if rows are quantized; it is built
once, saved, loaded and asked often. A query goes to its probed lists: chunks of
a list meet blocks of the queries that probe it, in a join on list_id. Where the
queries are few enough to be broadcast, the probed lists are literals in the
filter as well, so the reader prunes files. A list that is hot is many files,
many chunks and many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact, kmeans, quantize, scan


def _probed(x: np.ndarray, centroids: np.ndarray, nprobe: int) -> np.ndarray:
    order = np.argsort(1.0 - x @ centroids.T, axis=1, kind="stable")
    return order[:, : min(nprobe, len(centroids))]


class IVFIndex:
    def __init__(self, centroids: np.ndarray, lists: DataFrame | None = None, pq: quantize.ProductQuantizer | None = None):
        self.centroids, self.lists, self.pq = centroids, lists, pq

    @classmethod
    def fit(cls, base: DataFrame, nlist: int, rounds: int = 20, init: str = "first_k", seed: int = 0) -> IVFIndex:
        start = kmeans.initial(base, nlist, init, seed)[None]
        return cls(kmeans.lloyd(base, start, rounds, "ip")[0])

    def transform(self, base: DataFrame) -> IVFIndex:
        """The index over all rows of the base; lists(id, vec, list_id)."""
        return IVFIndex(self.centroids, kmeans.assign(base, self.centroids, "ip"), self.pq)

    def quantized(self, pq: quantize.ProductQuantizer) -> IVFIndex:
        """lists(id, codes, norm2, list_id): codes stand with the assignment, so that a search needs no join for them."""
        return IVFIndex(self.centroids, pq.transform(self.lists, keep=("list_id",)), pq)

    def save(self, path: str) -> None:
        spark = self.lists.sparkSession
        self.lists.repartition("list_id", F.pmod(F.xxhash64("id"), F.lit(8))).write.partitionBy("list_id").parquet(f"{path}/lists")
        kmeans.centroid_frame(spark, self.centroids).coalesce(1).write.parquet(f"{path}/centroids")
        if self.pq is not None:
            self.pq.codebook_frame(spark).coalesce(1).write.parquet(f"{path}/codebook")

    @classmethod
    def load(cls, spark: SparkSession, path: str, quantized: bool = False) -> IVFIndex:
        rows = sorted(spark.read.parquet(f"{path}/centroids").collect())  # one row a list
        pq = quantize.ProductQuantizer.load(spark.read.parquet(f"{path}/codebook")) if quantized else None
        return cls(np.array([r["cvec"] for r in rows], np.float64), spark.read.parquet(f"{path}/lists"), pq)

    def probes_of(self, x: np.ndarray, nprobe: int) -> np.ndarray:
        """The lists of the nprobe centroids of least 1 - ip, ties by list."""
        return _probed(x, self.centroids, nprobe)

    def probes(self, queries: DataFrame, nprobe: int) -> DataFrame:
        """(qid, rank, list_id, dist)."""
        scan.check_positive(nprobe=nprobe)
        lists = kmeans.centroid_frame(queries.sparkSession, self.centroids).select(F.col("list_id").cast("long").alias("id"), F.col("cvec").alias("vec"))
        found = exact.exact_topk(lists, queries, min(nprobe, len(self.centroids)))
        return found.select("qid", "rank", F.col("id").cast("int").alias("list_id"), "dist")

    def dealt(self, queries: DataFrame, nprobe: int) -> DataFrame:
        """(qid, qvec, list_id): each query once for each list that it probes."""

        centroids = self.centroids

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, scan.BATCH):
                    b = whole.slice(at, scan.BATCH)
                    lists = _probed(scan.matrix(b.column("qvec")), centroids, nprobe)
                    again = b.take(pa.array(np.repeat(np.arange(b.num_rows), lists.shape[1])))
                    yield pa.RecordBatch.from_arrays([*again.columns, pa.array(lists.ravel().astype(np.int32))], names=["qid", "qvec", "list_id"])

        kind = queries.schema["qvec"].dataType.simpleString()
        return queries.select("qid", "qvec").mapInArrow(run, f"qid long, qvec {kind}, list_id int")

    def _scan(self, queries: DataFrame, k: int, nprobe: int) -> DataFrame:
        asked, lists = self.dealt(queries, nprobe), self.lists
        few = scan.small(queries, nprobe)
        if few:
            wanted = [r[0] for r in asked.select("list_id").distinct().collect()]  # list numbers: not more than centroids
            lists = lists.where(F.col("list_id").isin(wanted))
        if self.pq is None:
            return scan.scan_topk(lists.select("id", "vec", "list_id"), asked, k, exact.score("ip"), "list_id", few)
        return scan.scan_topk(lists.select("id", "codes", "norm2", "list_id"), asked, k, self.pq.score, "list_id", few)

    def search(self, queries: DataFrame, k: int, nprobe: int) -> DataFrame:
        """hits over the rows of the probed lists."""
        scan.check_positive(k=k, nprobe=nprobe)
        return self._scan(queries, k, nprobe)

    def search_quantized(self, base: DataFrame, queries: DataFrame, k: int, nprobe: int, p: int) -> DataFrame:
        """The p nearest by codes over all probed lists together, then exact distances."""
        scan.check_positive(k=k, nprobe=nprobe, p=p)
        return exact.rerank(self._scan(queries, p, nprobe), base, queries, k)
