"""Scalar and product quantization: coarse scan of codes, then exact re-ranking."""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exact, kmeans, scan


class ScalarQuantizer:
    """One byte a dimension: trunc((v - mean) / scale + 128), clipped to 0..255; stored less 128."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        self.mean, self.scale = mean, scale

    @staticmethod
    def params(base: DataFrame) -> DataFrame:
        """sq_params(d, mu, scale): the mean, and the greatest deviation from it / 127 (1.0 if near zero).

        One aggregation: the greatest deviation is that of the maximum or the minimum.
        """
        cells = base.select(F.posexplode("vec").alias("d", "v")).withColumn("v", F.col("v").cast("double"))
        stats = cells.groupBy("d").agg(F.avg("v").alias("mu"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        scale = F.greatest(F.col("hi") - F.col("mu"), F.col("mu") - F.col("lo")) / 127
        return stats.select("d", "mu", F.when(scale < 1e-10, 1.0).otherwise(scale).alias("scale"))

    @classmethod
    def fit(cls, base: DataFrame) -> ScalarQuantizer:
        return cls.load(cls.params(base))

    def frame(self, spark) -> DataFrame:
        """sq_params(d, mu, scale), to write beside the codes."""
        return spark.createDataFrame([(i, float(m), float(s)) for i, (m, s) in enumerate(zip(self.mean, self.scale))], "d int, mu double, scale double")

    @classmethod
    def load(cls, params: DataFrame) -> ScalarQuantizer:
        rows = sorted(params.select("d", "mu", "scale").collect())  # one row a dimension
        return cls(np.array([r["mu"] for r in rows]), np.array([r["scale"] for r in rows]))

    def codes(self, x: np.ndarray) -> np.ndarray:
        return (np.clip(np.trunc((x - self.mean) / self.scale + 128), 0, 255) - 128).astype(np.int8)

    def transform(self, base: DataFrame) -> DataFrame:
        """sq_codes(id, codes array<tinyint>)."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    codes = self.codes(scan.matrix(b.column("vec")))
                    yield pa.RecordBatch.from_arrays([b.column("id"), scan.list_of(codes, pa.int8())], names=["id", "codes"])

        return base.select("id", "vec").mapInArrow(run, "id long, codes array<tinyint>")

    def coarse(self, codes: DataFrame, queries: DataFrame, p: int, weighted: bool = False) -> DataFrame:
        """hits by the negated product of codes; weighted multiplies by the squared scales."""

        def prepare(vectors: np.ndarray) -> scan.Score:
            q = self.codes(vectors).astype(np.float64) * (self.scale**2 if weighted else 1.0)

            def of(batch):
                x = scan.matrix(batch.column("codes"))
                if weighted:
                    return -(q @ x.T), lambda a, b: -(q[a] * x[b]).sum(axis=1)
                return -(q @ x.T), None  # whole numbers below 2**53: exact in any order

            return of

        return scan.scan_topk(codes.select("id", "codes"), queries.select("qid", "qvec"), p, prepare)

    def search(self, base: DataFrame, codes: DataFrame, queries: DataFrame, k: int, p: int, weighted: bool = False) -> DataFrame:
        _check(k, p)
        return exact.rerank(self.coarse(codes, queries, p, weighted), base, queries, k)


def _check(k: int, p: int) -> None:
    scan.check_positive(k=k, p=p)
    if p < k:
        warnings.warn(f"p={p} candidates for k={k}: at most p rows a query", stacklevel=3)


class ProductQuantizer:
    """m codes a vector, each the nearest of ksub centroids of a slice."""

    def __init__(self, codebook: np.ndarray):
        self.codebook = codebook

    @classmethod
    def fit(cls, base: DataFrame, m: int, ksub: int, rounds: int = 20, init: str = "first_k", seed: int = 0, train_n: int = 0) -> ProductQuantizer:
        """init: first_k, random, or kmeans++ (each slice seeded by itself); train_n rows by id, or all."""
        scan.check_positive(m=m, ksub=ksub)
        dim = exact.dimension(base)
        if dim % m:
            raise ValueError(f"{dim} dimensions can't be cut in {m} equal slices")
        if ksub > 256:
            raise ValueError("ksub is 256 at most")
        data = base.orderBy("id").limit(train_n) if train_n else base
        width = dim // m
        if init == "kmeans++":
            rows = kmeans.sample(data, seed)
            start = np.stack([kmeans.seeds_of(rows[:, i * width : (i + 1) * width], ksub, seed + i) for i in range(m)])
        else:
            start = kmeans.initial(data, ksub, init, seed).reshape(ksub, m, width).transpose(1, 0, 2).copy()
        return cls(kmeans.lloyd(data, start, rounds, "l2"))

    def codebook_frame(self, spark) -> DataFrame:
        """pq_codebook(m, c, cvec)."""
        rows = [(m, c, [float(x) for x in v]) for m, part in enumerate(self.codebook) for c, v in enumerate(part)]
        return spark.createDataFrame(rows, "m int, c int, cvec array<double>")

    @classmethod
    def load(cls, codebook: DataFrame) -> ProductQuantizer:
        rows = sorted(codebook.select("m", "c", "cvec").collect())  # m * ksub rows
        m = rows[-1]["m"] + 1
        return cls(np.array([r["cvec"] for r in rows], np.float64).reshape(m, len(rows) // m, -1))

    def codes(self, x: np.ndarray) -> np.ndarray:
        width = self.codebook.shape[2]
        return np.stack([kmeans.nearest(x[:, m * width : (m + 1) * width], part, "l2") for m, part in enumerate(self.codebook)], axis=1)

    def transform(self, base: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
        """pq_codes(id, codes array<smallint>, norm2), and the columns to keep."""
        fields = {f.name: f.dataType.simpleString() for f in base.schema.fields}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    x = scan.matrix(b.column("vec"))
                    columns = [b.column("id"), scan.list_of(self.codes(x), pa.int16()), pa.array((x * x).sum(axis=1)), *(b.column(c) for c in keep)]
                    yield pa.RecordBatch.from_arrays(columns, names=["id", "codes", "norm2", *keep])

        kept = "".join(f", {c} {fields[c]}" for c in keep)
        return base.select("id", "vec", *keep).mapInArrow(run, f"id long, codes array<smallint>, norm2 double{kept}")

    def tables(self, x: np.ndarray) -> np.ndarray:
        """Squared distances of each query's slices to the centroids: queries * m * ksub."""
        m, _, width = self.codebook.shape
        return ((x.reshape(len(x), m, 1, width) - self.codebook[None]) ** 2).sum(axis=3)

    def table_frame(self, queries: DataFrame) -> DataFrame:
        """lut(qid, m, c, d2)."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m, k, _ = self.codebook.shape
            for whole in batches:
                for at in range(0, whole.num_rows, scan.BATCH):
                    b = whole.slice(at, scan.BATCH)
                    columns = [
                        np.repeat(b.column("qid").to_numpy(), m * k),
                        np.tile(np.repeat(np.arange(m, dtype=np.int32), k), b.num_rows),
                        np.tile(np.arange(k, dtype=np.int32), b.num_rows * m),
                        self.tables(scan.matrix(b.column("qvec"))).ravel(),
                    ]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["qid", "m", "c", "d2"])

        return queries.select("qid", "qvec").mapInArrow(run, "qid long, m int, c int, d2 double")

    def score(self, vectors: np.ndarray) -> scan.Score:
        """Estimated 1 - ip from code distances and norms."""
        tables, norms = self.tables(vectors), (vectors**2).sum(axis=1)
        by_code = [np.ascontiguousarray(tables[:, i, :].T) for i in range(tables.shape[1])]

        def of(batch):
            codes = scan.matrix(batch.column("codes"), np.int64)
            d2 = np.zeros((len(codes), len(vectors)))
            for i, table in enumerate(by_code):
                d2 += table[codes[:, i]]
            return 1.0 - (batch.column("norm2").to_numpy()[None] + norms[:, None] - d2.T) / 2, None

        return of

    def coarse(self, codes: DataFrame, queries: DataFrame, p: int) -> DataFrame:
        return scan.scan_topk(codes.select("id", "codes", "norm2"), queries.select("qid", "qvec"), p, self.score)

    def distances(self, codes: DataFrame, queries: DataFrame) -> DataFrame:
        """(qid, id, dist) of every query and code: as many rows as their product, without a shuffle of them."""
        return scan.scan_all(codes.select("id", "codes", "norm2"), queries.select("qid", "qvec"), self.score)

    def search(self, base: DataFrame, codes: DataFrame, queries: DataFrame, k: int, p: int) -> DataFrame:
        _check(k, p)
        return exact.rerank(self.coarse(codes, queries, p), base, queries, k)


def adc_relational(codes: DataFrame, tables: DataFrame, query_norms: DataFrame) -> DataFrame:
    """(qid, id, dist) by a join of codes and distance tables: the statement that the array form is tested against."""
    long = codes.select("id", "norm2", F.posexplode("codes").alias("m", "c"))
    summed = long.join(tables, ["m", "c"]).groupBy("qid", "id", "norm2").agg(F.sum("d2").alias("d2"))
    return summed.join(query_norms, "qid").select("qid", "id", (F.lit(1.0) - (F.col("norm2") + F.col("qnorm2") - F.col("d2")) / 2).alias("dist"))
