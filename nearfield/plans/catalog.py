"""Registered queries over ``embeddings`` and ``lineitem``, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vector
from ..operators import evaluate, exact, hnsw, ivf, kmeans, linalg, quantize
from ..sources import results, store, vectors
from ..sources.vectors import from_parquet

#: The stated query set: every row whose id is divisible by this.
EVERY = 50
K, ROUNDS = 10, 2
#: Settings at which every index reaches a recall@10 of 0.9 on the given tables; these vectors have hardly any clusters.
NLIST, NPROBE, M, KSUB, P, WIDTH = 16, 12, 16, 16, 200, 4

_found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        _found[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return keep


def base_of(spark: SparkSession, sf: str) -> DataFrame:
    return from_parquet(spark, f"{sf}/embeddings.parquet")


def queries_of(spark: SparkSession, sf: str) -> DataFrame:
    return base_of(spark, sf).where(F.col("id") % EVERY == 0).select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))


_stored: dict[tuple[str, str, str], str] = {}


def stored(spark: SparkSession, sf: str, name: str, build: Callable[[str], object]) -> str:
    """The path of an index that is built once an application and table."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _stored:
        path = store.fresh(spark, name)
        build(path)
        _stored[key] = path
    return _stored[key]


def shown(hits: DataFrame) -> DataFrame:
    return hits.select("qid", "rank", "id", F.round("dist", 6).alias("dist"))


# SQL building blocks
BASE = f"b AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT id AS qid, v AS qv FROM b WHERE id % {EVERY} = 0)"
IP = "1.0 - list_inner_product(v, qv)"
L2 = "list_sum(list_transform(range(1, len(v) + 1), lambda i: (v[i] - qv[i]) * (v[i] - qv[i])))"


def topk_sql(dist: str, k: int = K, source: str = "b CROSS JOIN q") -> str:
    return (
        f"SELECT qid, rank, id, round(dist, 6) AS dist FROM (SELECT qid, id, dist, CAST(row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS INT) AS rank "
        f"FROM (SELECT qid, id, {dist} AS dist FROM {source})) WHERE rank <= {k}"
    )


def lloyd_sql(parts: int, k: int, rounds: int, metric: str, pre: str = "") -> str:
    """CTEs c0..c{rounds}(m, c, cv), x(id, m, sv), their names behind a prefix."""
    width = 64 // parts
    out = [f"{pre}x AS (SELECT id, m, v[m * {width} + 1 : (m + 1) * {width}] AS sv FROM b, (SELECT unnest(range({parts})) AS m))", f"{pre}c0 AS (SELECT m, id AS c, sv AS cv FROM {pre}x WHERE id < {k})"]
    for r in range(1, rounds + 1):
        out.append(nearest_sql(f"{pre}a{r}", f"{pre}c{r - 1}", metric, pre))
        out.append(
            f"{pre}u{r} AS (SELECT m, c, list(s ORDER BY d) AS cv FROM (SELECT m, c, d, avg(sv[d]) AS s FROM {pre}a{r}, (SELECT unnest(range(1, {width} + 1)) AS d) GROUP BY m, c, d) GROUP BY m, c)"
        )
        out.append(f"{pre}c{r} AS (SELECT o.m, o.c, coalesce(u.cv, o.cv) AS cv FROM {pre}c{r - 1} o LEFT JOIN {pre}u{r} u ON o.m = u.m AND o.c = u.c)")
    return ", ".join(out)


def nearest_sql(name: str, centroids: str, metric: str, pre: str = "") -> str:
    score = "-list_inner_product(sv, cv)" if metric == "ip" else "list_sum(list_transform(range(1, len(sv) + 1), lambda i: (sv[i] - cv[i]) * (sv[i] - cv[i])))"
    return f"{name} AS (SELECT id, m, c, sv FROM (SELECT x.id, x.m, k.c, sv, row_number() OVER (PARTITION BY x.id, x.m ORDER BY {score}, k.c) AS n FROM {pre}x x JOIN {centroids} k ON x.m = k.m) WHERE n = 1)"


IVF_SQL = f"WITH {BASE}, {lloyd_sql(1, NLIST, ROUNDS, 'ip')}, {nearest_sql('assign', f'c{ROUNDS}', 'ip')}"
PROBES_SQL = (
    f"probes AS (SELECT qid, c, dist, rank FROM (SELECT qid, c, dist, CAST(row_number() OVER (PARTITION BY qid ORDER BY dist, c) AS INT) AS rank "
    f"FROM (SELECT qid, c, 1.0 - list_inner_product(cv, qv) AS dist FROM c{ROUNDS}, q)) WHERE rank <= {NPROBE})"
)
PQ_CTES = f"{lloyd_sql(M, KSUB, ROUNDS, 'l2', 'p')}, {nearest_sql('code', f'pc{ROUNDS}', 'l2', 'p')}"
LUT_SQL = (
    f"lut AS (SELECT qid, m, c, list_sum(list_transform(range(1, {WIDTH} + 1), lambda i: (qv[m * {WIDTH} + i] - cv[i]) * (qv[m * {WIDTH} + i] - cv[i]))) AS d2 FROM q, pc{ROUNDS})"
)
ADC_SQL = (
    "adc AS (SELECT s.qid, s.id, 1.0 - (list_inner_product(b.v, b.v) + list_inner_product(q.qv, q.qv) - s.d2) / 2 AS dist "
    "FROM (SELECT l.qid, k.id, sum(l.d2) AS d2 FROM code k JOIN lut l ON k.m = l.m AND k.c = l.c GROUP BY l.qid, k.id) s JOIN b ON b.id = s.id JOIN q ON q.qid = s.qid)"
)
PQ_SQL = f"WITH {BASE}, {PQ_CTES}, {LUT_SQL}, {ADC_SQL}"
SQ_CTES = (
    "cells AS (SELECT id, d, v[d + 1] AS x FROM b, (SELECT unnest(range(64)) AS d)), "
    "mean AS (SELECT d, avg(x) AS mu FROM cells GROUP BY d), "
    "par AS (SELECT d, any_value(mu) AS mu, CASE WHEN max(abs(x - mu)) / 127 < 1e-10 THEN 1.0 ELSE max(abs(x - mu)) / 127 END AS scale FROM cells JOIN mean USING (d) GROUP BY d), "
    "code AS (SELECT id, d, CAST(greatest(least(trunc((x - mu) / scale + 128), 255), 0) AS INT) - 128 AS code FROM cells JOIN par USING (d))"
)
SQ_COARSE = f"coarse AS (SELECT c.id AS qid, k.id, -CAST(sum(c.code * k.code) AS DOUBLE) AS dist FROM code c JOIN code k ON c.d = k.d WHERE c.id % {EVERY} = 0 GROUP BY c.id, k.id)"


def rerank_sql(coarse: str, p: int) -> str:
    cut = f"SELECT qid, id FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS n FROM {coarse}) WHERE n <= {p}"
    return topk_sql(IP, source=f"(SELECT t.qid, t.id, b.v, q.qv FROM ({cut}) t JOIN b ON b.id = t.id JOIN q ON q.qid = t.qid)")


def recall_sql(ctes: str, hits: str) -> str:
    return (
        f"{ctes}, truth AS ({topk_sql(IP)}), hits AS ({hits}) SELECT t.qid, count(h.id) / 10.0 AS recall FROM truth t LEFT JOIN hits h ON t.qid = h.qid AND t.id = h.id GROUP BY t.qid"
    )


@query(f"WITH {BASE} {topk_sql(IP)}")
def exact_topk_ip(spark, sf):
    return shown(exact.exact_topk(base_of(spark, sf), queries_of(spark, sf), K))


@query(f"WITH {BASE} {topk_sql(IP)}")
def exact_topk_expr(spark, sf):
    return shown(exact.exact_topk(base_of(spark, sf), queries_of(spark, sf), K, plan="expr"))


@query(f"WITH {BASE} {topk_sql(IP)}")
def exact_topk_round_robin(spark, sf):
    return shown(exact.exact_topk(vectors.round_robin(base_of(spark, sf), 8), queries_of(spark, sf), K))


@query(f"WITH {BASE} {topk_sql(L2)}")
def exact_topk_l2(spark, sf):
    return shown(exact.exact_topk(base_of(spark, sf), queries_of(spark, sf), K, "l2"))


@query(f"WITH {BASE} {topk_sql(IP, 1)}")
def exact_top1(spark, sf):
    return shown(exact.exact_topk(base_of(spark, sf), queries_of(spark, sf), 1))


@query(f"WITH {BASE} SELECT qid, id, round({IP}, 6) AS dist FROM b CROSS JOIN q")
def exact_pairs_dist(spark, sf):
    return exact.pair_distances(base_of(spark, sf), queries_of(spark, sf)).select("qid", "id", F.round("dist", 6).alias("dist"))


@query("SELECT vec_id AS id, round(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]), 6) AS norm2 FROM embeddings")
def vec_norms(spark, sf):
    return base_of(spark, sf).select("id", F.round(vector.squared_norm(F.col("vec")), 6).alias("norm2"))


@query(f"WITH {BASE} SELECT qid, id, round((list_inner_product(v, v) + list_inner_product(qv, qv) - {L2}) / 2, 6) AS ip FROM b CROSS JOIN q")
def ip_from_l2(spark, sf):
    q, v = F.col("qvec"), F.col("vec")
    ip = vector.ip_from_l2(vector.squared_norm(v), vector.squared_norm(q), vector.squared_l2(v, q))
    return exact.with_queries(base_of(spark, sf), queries_of(spark, sf)).select("qid", "id", F.round(ip, 6).alias("ip"))


@query(f"WITH b AS (SELECT vec_id AS id, embedding AS v FROM embeddings) SELECT id, CAST(m AS INT) AS m, round(list_sum(v[m * {WIDTH} + 1 : (m + 1) * {WIDTH}]::DOUBLE[]), 6) AS total FROM b, (SELECT unnest(range({M})) AS m)")
def vec_slices(spark, sf):
    cut = F.posexplode(F.array(*[vector.part(F.col("vec"), m, WIDTH) for m in range(M)])).alias("m", "sv")
    return base_of(spark, sf).select("id", cut).select("id", "m", F.round(F.aggregate("sv", F.lit(0.0), lambda s, x: s + x.cast("double")), 6).alias("total"))


@query("SELECT round(sum(l_quantity), 2) AS total FROM lineitem")
def sum_values(spark, sf):
    return linalg.total(spark.read.parquet(f"{sf}/lineitem.parquet"), "l_quantity").select(F.round("total", 2).alias("total"))


@query("SELECT CAST(n AS BIGINT) AS n, CAST(n * (n - 1) / 2 AS DOUBLE) AS total FROM (SELECT unnest(range(128, 2049, 128)) AS n)")
def sum_range(spark, sf):
    return _swept(spark, linalg.array_range, linalg.sizes())


@query("SELECT CAST(n AS BIGINT) AS n, CAST(n AS DOUBLE) AS total FROM (SELECT unnest(range(127, 2049, 257)) AS n)")
def sum_ones(spark, sf):
    return _swept(spark, linalg.array_ones, range(127, 2049, 257))


def _swept(spark, generate, sizes) -> DataFrame:
    """A sum for each size."""
    out = None
    for n in sizes:
        one = linalg.total(generate(spark, n)).select(F.lit(n).cast("long").alias("n"), "total")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT CAST(d AS INT) AS i, round(sum(vec_id * embedding[d + 1]::DOUBLE), 4) AS s FROM embeddings, (SELECT unnest(range(64)) AS d) GROUP BY d")
def matvec_embeddings(spark, sf):
    b = base_of(spark, sf)
    rows = b.select(F.col("id").alias("j"), F.col("vec").alias("row"))
    return linalg.matvec(rows, b.select(F.col("id").alias("i"), F.col("id").cast("double").alias("v"))).select("i", F.round("s", 4).alias("s"))


@query("SELECT CAST(i AS INT) AS i, CAST(sum((i + j) * j) AS DOUBLE) AS s FROM (SELECT unnest(range(512)) AS i), (SELECT unnest(range(512)) AS j) GROUP BY i")
def matvec_synthetic(spark, sf):
    return linalg.matvec(linalg.matrix_rows(spark, 512), linalg.array_range(spark, 512))


@query(f"WITH {BASE}, {SQ_CTES} SELECT CAST(d AS INT) AS d, round(mu, 6) AS mu, round(scale, 8) AS scale FROM par")
def sq_params(spark, sf):
    return quantize.ScalarQuantizer.params(base_of(spark, sf)).select("d", F.round("mu", 6).alias("mu"), F.round("scale", 8).alias("scale"))


@query(f"WITH {BASE}, {SQ_CTES} SELECT id, CAST(d AS INT) AS d, code FROM code")
def sq_codes(spark, sf):
    b = base_of(spark, sf)
    return quantize.ScalarQuantizer.fit(b).transform(b).select("id", F.posexplode("codes").alias("d", "code")).select("id", "d", F.col("code").cast("int").alias("code"))


@query(f"WITH {BASE}, {SQ_CTES}, {SQ_COARSE} {topk_sql('dist', P, 'coarse')}")
def sq_coarse_topp(spark, sf):
    b = base_of(spark, sf)
    sq = quantize.ScalarQuantizer.fit(b)
    return shown(sq.coarse(sq.transform(b), queries_of(spark, sf), P))


@query(f"WITH {BASE}, {SQ_CTES}, {SQ_COARSE} {rerank_sql('coarse', P)}")
def sq_search(spark, sf):
    return shown(_sq(spark, sf))


def _sq(spark, sf):
    def build(path):
        own = quantize.ScalarQuantizer.fit(base_of(spark, sf))
        own.transform(base_of(spark, sf)).write.parquet(f"{path}/codes")
        own.frame(spark).coalesce(1).write.parquet(f"{path}/params")

    path = stored(spark, sf, "sq", build)
    sq = quantize.ScalarQuantizer.load(spark.read.parquet(f"{path}/params"))
    return sq.search(base_of(spark, sf), spark.read.parquet(f"{path}/codes"), queries_of(spark, sf), K, P)


@query(f"{IVF_SQL.replace(f'c{ROUNDS} k', 'c0 k')} SELECT id, CAST(c AS INT) AS list_id FROM assign")
def kmeans_assign(spark, sf):
    b = base_of(spark, sf)
    return kmeans.assign(b, kmeans.initial(b, NLIST), "ip").select("id", "list_id")


def _centroids(spark, sf, rounds, parts=1, k=NLIST, metric="ip"):
    b = base_of(spark, sf)
    start = kmeans.initial(b, k).reshape(k, parts, -1).transpose(1, 0, 2).copy()
    return kmeans.centroid_frame(spark, kmeans.lloyd(b, start, rounds, metric)[0]).select("list_id", F.posexplode("cvec").alias("d", "v")).select("list_id", "d", F.round("v", 6).alias("v"))


def centroid_sql(rounds: int) -> str:
    return f"WITH {BASE}, {lloyd_sql(1, NLIST, rounds, 'ip')} SELECT CAST(c AS INT) AS list_id, CAST(d AS INT) AS d, round(cv[d + 1], 6) AS v FROM c{rounds}, (SELECT unnest(range(64)) AS d)"


@query(centroid_sql(1))
def kmeans_update(spark, sf):
    return _centroids(spark, sf, 1)


@query(centroid_sql(ROUNDS))
def kmeans_lloyd2(spark, sf):
    return _centroids(spark, sf, ROUNDS)


def _pq(spark, sf):
    return quantize.ProductQuantizer.fit(base_of(spark, sf), M, KSUB, ROUNDS)


@query(f"{PQ_SQL} SELECT CAST(m AS INT) AS m, CAST(c AS INT) AS c, CAST(d AS INT) AS d, round(cv[d + 1], 6) AS v FROM pc{ROUNDS}, (SELECT unnest(range({WIDTH})) AS d)")
def pq_codebook(spark, sf):
    return _pq(spark, sf).codebook_frame(spark).select("m", "c", F.posexplode("cvec").alias("d", "v")).select("m", "c", "d", F.round("v", 6).alias("v"))


@query(f"{PQ_SQL} SELECT id, CAST(m AS INT) AS m, CAST(c AS INT) AS code FROM code")
def pq_codes(spark, sf):
    return _pq(spark, sf).transform(base_of(spark, sf)).select("id", F.posexplode("codes").alias("m", "code")).select("id", "m", F.col("code").cast("int").alias("code"))


@query(f"{PQ_SQL} SELECT qid, CAST(m AS INT) AS m, CAST(c AS INT) AS c, round(d2, 6) AS d2 FROM lut")
def pq_lut(spark, sf):
    return _pq(spark, sf).table_frame(queries_of(spark, sf)).select("qid", "m", "c", F.round("d2", 6).alias("d2"))


@query(f"{PQ_SQL} SELECT qid, id, round(dist, 6) AS dist FROM adc")
def pq_adc_dist(spark, sf):
    pq = _pq(spark, sf)
    return pq.distances(pq.transform(base_of(spark, sf)), queries_of(spark, sf)).select("qid", "id", F.round("dist", 6).alias("dist"))


@query(f"{PQ_SQL} {rerank_sql('adc', P)}")
def pq_search(spark, sf):
    return shown(_pq_hits(spark, sf))


def _pq_hits(spark, sf, init="first_k", rounds=ROUNDS):
    def build(path):
        own = quantize.ProductQuantizer.fit(base_of(spark, sf), M, KSUB, rounds, init, 7)
        own.transform(base_of(spark, sf)).write.parquet(f"{path}/codes")
        own.codebook_frame(spark).coalesce(1).write.parquet(f"{path}/codebook")

    path = stored(spark, sf, f"pq-{init}-{rounds}".replace("+", "p"), build)
    pq = quantize.ProductQuantizer.load(spark.read.parquet(f"{path}/codebook"))
    return pq.search(base_of(spark, sf), spark.read.parquet(f"{path}/codes"), queries_of(spark, sf), K, P)


@query()
def pq_search_kmeanspp(spark, sf):
    return shown(_pq_hits(spark, sf, "kmeans++"))


@query()
def pq_search_random(spark, sf):
    return shown(_pq_hits(spark, sf, "random", 10))


def _ivf(spark, sf):
    b = base_of(spark, sf)
    return ivf.IVFIndex.fit(b, NLIST, ROUNDS).transform(b)


@query(centroid_sql(ROUNDS))
def ivf_centroids(spark, sf):
    return _centroids(spark, sf, ROUNDS)


@query(f"{IVF_SQL} SELECT id, CAST(c AS INT) AS list_id FROM assign")
def ivf_assign(spark, sf):
    return _ivf(spark, sf).lists.select("id", "list_id")


@query(f"{IVF_SQL} SELECT CAST(c AS INT) AS list_id, count(*) AS n FROM assign GROUP BY c")
def ivf_list_sizes(spark, sf):
    return _ivf(spark, sf).lists.groupBy("list_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"{IVF_SQL}, {PROBES_SQL} SELECT qid, rank, CAST(c AS INT) AS list_id, round(dist, 6) AS dist FROM probes")
def ivf_probes(spark, sf):
    return _ivf(spark, sf).probes(queries_of(spark, sf), NPROBE).select("qid", "rank", "list_id", F.round("dist", 6).alias("dist"))


_PROBED = "(SELECT p.qid, b.id, b.v, q.qv FROM probes p JOIN assign a ON a.c = p.c JOIN b ON b.id = a.id JOIN q ON q.qid = p.qid)"


@query(f"{IVF_SQL}, {PROBES_SQL} {topk_sql(IP, source=_PROBED)}")
def ivf_search(spark, sf):
    return shown(_ivf_hits(spark, sf))


def _ivf_hits(spark, sf):
    path = stored(spark, sf, "ivf", lambda path: _ivf(spark, sf).save(path))
    return ivf.IVFIndex.load(spark, path).search(queries_of(spark, sf), K, NPROBE)


_ADC_PROBED = "(SELECT d.qid, d.id, d.dist FROM adc d JOIN assign a ON a.id = d.id JOIN probes p ON p.qid = d.qid AND p.c = a.c)"


@query(f"{IVF_SQL}, {PROBES_SQL}, {PQ_CTES}, {LUT_SQL}, {ADC_SQL} {rerank_sql(_ADC_PROBED, P)}")
def ivfpq_search(spark, sf):
    return shown(_ivfpq(spark, sf))


def _ivfpq(spark, sf):
    path = stored(spark, sf, "ivfpq", lambda path: _ivf(spark, sf).quantized(_pq(spark, sf)).save(path))
    return ivf.IVFIndex.load(spark, path, True).search_quantized(base_of(spark, sf), queries_of(spark, sf), K, NPROBE, P)


def _recall(spark, sf, hits):
    truth = exact.exact_topk(base_of(spark, sf), queries_of(spark, sf), K)
    return evaluate.recall_at_k(truth, hits, K)


@query(recall_sql(f"WITH {BASE}, {SQ_CTES}, {SQ_COARSE}", rerank_sql("coarse", P)))
def recall_sq(spark, sf):
    return _recall(spark, sf, _sq(spark, sf))


@query(recall_sql(PQ_SQL, rerank_sql("adc", P)))
def recall_pq(spark, sf):
    return _recall(spark, sf, _pq_hits(spark, sf))


@query(recall_sql(f"{IVF_SQL}, {PROBES_SQL}", topk_sql(IP, source=_PROBED)))
def recall_ivf(spark, sf):
    return _recall(spark, sf, _ivf_hits(spark, sf))


@query(recall_sql(f"{IVF_SQL}, {PROBES_SQL}, {PQ_CTES}, {LUT_SQL}, {ADC_SQL}", rerank_sql(_ADC_PROBED, P)))
def recall_ivfpq(spark, sf):
    return _recall(spark, sf, _ivfpq(spark, sf))


@query(f"SELECT method, 4.0 * d / bytes AS ratio FROM (SELECT max(len(embedding)) AS d FROM embeddings), (VALUES ('sq', 64.0), ('pq', {M}.0)) AS t(method, bytes)")
def compression_ratio(spark, sf):
    dim = exact.dimension(base_of(spark, sf))
    return spark.createDataFrame([("sq", evaluate.compression(dim, dim)), ("pq", evaluate.compression(dim, M))], "method string, ratio double")


@query()
def kmeanspp_seeds(spark, sf):
    return kmeans.centroid_frame(spark, kmeans.initial(base_of(spark, sf), NLIST, "kmeans++", 7)).select(F.col("list_id").alias("seed"), F.col("cvec").alias("vec"))


@query()
def hnsw_levels(spark, sf):
    return hnsw.levels(base_of(spark, sf), 16).groupBy("max_level").agg(F.count(F.lit(1)).alias("n"))


def _hnsw(spark, sf, law="log", full="evict"):
    build = lambda path: hnsw.HNSWIndex.build(base_of(spark, sf), 16, 64, law=law, full=full).save(path)
    return hnsw.HNSWIndex.load(spark, stored(spark, sf, f"hnsw-{law}-{full}", build))


@query()
def hnsw_edges(spark, sf):
    return _hnsw(spark, sf).edges().select("level", "src", "dst", "pos")


@query("SELECT true AS capped, true AS no_self, true AS no_twice, count(*) AS nodes FROM embeddings")
def hnsw_links(spark, sf):
    """Degree caps and self-exclusion of every link, and every node on the ground layer."""
    e = _hnsw(spark, sf).edges()
    each = e.groupBy("level", "src").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("dst").alias("u"), F.max(F.col("src") == F.col("dst")).alias("own"))
    cap = F.when(F.col("level") == 0, 32).otherwise(16)
    return each.agg(
        F.min(F.col("n") <= cap).alias("capped"), F.min(~F.col("own")).alias("no_self"), F.min(F.col("n") == F.col("u")).alias("no_twice"),
        F.sum((F.col("level") == 0).cast("long")).alias("nodes"),
    )


@query()
def hnsw_search(spark, sf):
    return shown(_hnsw(spark, sf).search(queries_of(spark, sf), K, 64))


@query(f"WITH {BASE} {topk_sql(IP)}")
def hnsw_full_beam(spark, sf):
    """A beam as wide as a shard finds what an exact search finds."""
    return shown(_hnsw(spark, sf).search(queries_of(spark, sf), K, None))


@query()
def recall_hnsw(spark, sf):
    return _recall(spark, sf, _hnsw(spark, sf).search(queries_of(spark, sf), K, 64))


@query("SELECT * FROM (VALUES ('sq', true), ('pq', true), ('pq kmeans++', true), ('pq random', true), ('ivf', true), ('ivfpq', true), ('hnsw log', true), ('hnsw coin', true)) AS t(method, enough)")
def index_recall(spark, sf):
    """Whether each index has a mean recall@10 of 0.9 at least against brute force."""
    truth = exact.exact_topk(base_of(spark, sf), queries_of(spark, sf), K)
    graph = lambda *how: _hnsw(spark, sf, *how).search(queries_of(spark, sf), K, 64)
    hits = {
        "sq": _sq(spark, sf), "pq": _pq_hits(spark, sf), "pq kmeans++": _pq_hits(spark, sf, "kmeans++"), "pq random": _pq_hits(spark, sf, "random", 10),
        "ivf": _ivf_hits(spark, sf), "ivfpq": _ivfpq(spark, sf), "hnsw log": graph(), "hnsw coin": graph("coin"),
    }
    out = None
    for name, found in hits.items():
        one = evaluate.mean_recall(truth, found, K).select(F.lit(name).alias("method"), (F.col("recall") >= 0.9).alias("enough"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT CAST(j AS BIGINT) AS id, CAST(128 * j + 8128 AS DOUBLE) AS total FROM (SELECT unnest(range(128)) AS j)")
def vector_file(spark, sf):
    """A generated matrix (its size is fixed) written as a vector file and read in splits."""
    path = store.fresh(spark, "matrix") + ".fbin"
    rows = [r["row"] for r in linalg.matrix_rows(spark, 128).orderBy("j").collect()]
    vectors.write_vectors(path, np.array(rows, np.float32))
    found = vectors.read_vectors(spark, path, split_rows=50)
    return found.select("id", F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double")).alias("total"))


@query("SELECT CAST(n AS INT) AS n, round(n / 64.0, 4) AS slow_ms, round(n / 128.0, 4) AS fast_ms, 2.0 AS speedup FROM (SELECT unnest(range(128, 2049, 128)) AS n)")
def benchmark_file(spark, sf):
    """The sweep of sizes written with fixed decimals and read again."""
    path = store.fresh(spark, "benchmark")
    made = spark.createDataFrame([(n, n / 64, n / 128) for n in linalg.sizes()], "n int, slow_ms double, fast_ms double")
    results.write_benchmark(evaluate.speedup(made, "slow_ms", "fast_ms"), path, {"slow_ms": 4, "fast_ms": 4, "speedup": 2})
    return spark.read.csv(path, header=True, schema="n int, slow_ms double, fast_ms double, speedup double")


@query("SELECT * FROM (VALUES ('flat', 'omp', 'none', 'none', 1, 12::BIGINT, 0.5::DOUBLE, 0, 0), ('ivfpq', 'omp', '100-8', '10', 2, 7::BIGINT, 0.25::DOUBLE, 100, 8)) AS t(algorithm, parallel_mode, parameter1, parameter2, threads, latency_us, recall, nlist, m)")
def result_files(spark, sf):
    """Result files behind one another, with markers and headers between."""
    path, head = store.fresh(spark, "results"), "algorithm,parallel_mode,parameter1,parameter2,threads,latency_us,recall@10"
    lines = ["==> one.csv <==", head, "flat,omp,-,-,1,12,0.5", "", "==> two.csv <==", head, "ivfpq,omp,100-8,10,2,7,0.25"]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    return results.read_concatenated(spark, path).fillna("none").fillna(0, ["nlist", "m"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_found)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
