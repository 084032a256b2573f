"""Exact top-k by inner product or squared L2, as two plans with one answer.

``plan="expr"`` is the relational statement of it (native expressions and a
window over pairs); ``plan="arrow"`` multiplies matrices of Arrow batches and
keeps a running top-k in each task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vector
from . import scan


def validated(df: DataFrame, id_col: str, vec_col: str, names: tuple[str, str] = ("id", "vec")) -> DataFrame:
    """(id, vec) without null vectors and null or non-finite elements, checked while it is read."""
    vec = F.col(vec_col)
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    checked = F.when(vec.isNull() | bad, F.raise_error(F.lit("a vector has null or non-finite elements"))).otherwise(vec)
    return df.select(F.col(id_col).cast("long").alias(names[0]), checked.alias(names[1]))


def dimension(base: DataFrame, vec_col: str = "vec") -> int:
    row = base.agg(F.min(F.size(vec_col)).alias("lo"), F.max(F.size(vec_col)).alias("hi")).first()
    if row["lo"] != row["hi"]:
        raise ValueError(f"vectors have {row['lo']} to {row['hi']} elements")
    return row["lo"] or 0


def with_queries(base: DataFrame, queries: DataFrame) -> DataFrame:
    """Every base row beside every query of a stated set; queries are broadcast where their checked size allows it."""
    return base.crossJoin(F.broadcast(queries) if scan.small(queries) else queries)


def pair_distances(base: DataFrame, queries: DataFrame, metric: str = "ip") -> DataFrame:
    """(qid, id, dist) of every query and base row: as many rows as their product, for statements and small sets."""
    base, queries = validated(base, "id", "vec"), validated(queries, "qid", "qvec", ("qid", "qvec"))
    return with_queries(base, queries).select("qid", "id", vector.distance(F.col("vec"), F.col("qvec"), metric).alias("dist"))


def score(metric: str) -> scan.Prepare:
    def prepare(q: np.ndarray) -> scan.Score:
        norms = (q * q).sum(axis=1)

        def of(batch):
            x = scan.matrix(batch.column("vec"))
            if x.shape[1] != q.shape[1]:
                raise ValueError(f"queries have {q.shape[1]} elements, the base {x.shape[1]}")
            products = q @ x.T
            if metric == "ip":
                return 1.0 - products, lambda a, b: 1.0 - (q[a] * x[b]).sum(axis=1)
            return norms[:, None] - 2 * products + (x * x).sum(axis=1), lambda a, b: ((x[b] - q[a]) ** 2).sum(axis=1)

        return of

    return prepare


def exact_topk(base: DataFrame, queries: DataFrame, k: int, metric: str = "ip", plan: str = "arrow", exclude_self: bool = False) -> DataFrame:
    """hits(qid, rank, id, dist) of base(id, vec) for queries(qid, qvec); ties by id; fewer than k rows if the base is smaller."""
    scan.check_positive(k=k)
    if metric not in ("ip", "l2"):
        raise ValueError(f"metric is ip or l2, not {metric}")
    if plan == "expr":
        pairs = pair_distances(base, queries, metric)
        return scan.rank(pairs.where("qid <> id") if exclude_self else pairs, k)
    base, queries = base.select("id", "vec"), queries.select("qid", "qvec")
    if not exclude_self:
        return scan.scan_topk(base, queries, k, score(metric))
    return scan.rank(scan.scan_topk(base, queries, k + 1, score(metric)).where("qid <> id").drop("rank"), k)


def rerank(candidates: DataFrame, base: DataFrame, queries: DataFrame, k: int, metric: str = "ip") -> DataFrame:
    """Exact distances of candidates(qid, id, ...), and their top-k; the join sides are sized at run time."""
    pairs = candidates.select("qid", "id").join(base.select("id", "vec"), "id").join(queries, "qid")
    return scan.rank(pairs.select("qid", "id", vector.distance(F.col("vec"), F.col("qvec"), metric).alias("dist")), k)
