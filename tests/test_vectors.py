"""Closed forms, limit properties, invariance and refusals of the vector operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.functions import vector
from nearfield.operators import evaluate, exact, hnsw, ivf, kmeans, linalg, quantize, scan
from nearfield.plans import catalog
from nearfield.sources import results, vectors
from nearfield.streaming.search import search_stream


@pytest.fixture(scope="module")
def data(spark):
    x = np.random.default_rng(5).normal(size=(300, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    base = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<float>").cache()
    q = base.where("id < 12").select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    return base, q


def pairs(hits):
    return {(r["qid"], r["rank"], r["id"]) for r in hits.collect()}


def test_plans_agree_and_partitions_dont_matter(data):
    base, q = data
    want = pairs(exact.exact_topk(base, q, 5, plan="expr"))
    for n in (1, 4, 16):
        assert pairs(exact.exact_topk(base.repartition(n), q, 5)) == want
    assert all(i == k for k, r, i in want if r == 1)
    assert all(k != i for k, _, i in pairs(exact.exact_topk(base, q, 5, exclude_self=True)))


@pytest.mark.parametrize("metric", ["ip", "l2"])
def test_pairs_of_many_queries_go_by_blocks(data, metric, monkeypatch):
    base, q = data
    want = sorted(exact.pair_distances(base, q, metric).collect())
    top = sorted(exact.exact_topk(base, q, 5, metric, plan="expr").collect())
    monkeypatch.setattr(scan, "QUERY_BLOCK", 5)
    assert sorted(exact.pair_distances(base, q, metric).collect()) == want and len(want) == 12 * 300
    assert sorted(exact.exact_topk(base, q, 5, metric, plan="expr").collect()) == top


def test_k_over_n_and_ties(spark):
    base = spark.createDataFrame([(3, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, vec array<float>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "qid long, qvec array<float>")
    assert [r["id"] for r in exact.exact_topk(base, q, 9).orderBy("rank").collect()] == [1, 3, 2]
    for bad in (0, -1):
        with pytest.raises(ValueError):
            exact.exact_topk(base, q, bad)
    assert exact.exact_topk(base, q.where("qid > 5"), 3).count() == 0


def test_rejects_non_finite(spark):
    base = spark.createDataFrame([(1, [1.0, float("nan")])], "i long, v array<float>")
    with pytest.raises(Exception, match="non-finite"):
        exact.validated(base, "i", "v").collect()
    q = spark.createDataFrame([(1, [1.0, 0.0])], "qid long, qvec array<float>")
    for v in ([1.0, float("inf")], None, [1.0, None], [1.0]):
        bad = spark.createDataFrame([(1, v), (2, [0.0, 1.0])], "id long, vec array<float>").coalesce(1)
        with pytest.raises(Exception, match="vector|vectors|elements"):
            exact.exact_topk(bad, q, 1).collect()


@pytest.mark.parametrize("n", [1, 127, 384, 640, 2048])
def test_sums(spark, n):
    assert linalg.total(linalg.array_range(spark, n)).first()[0] == n * (n - 1) / 2
    assert linalg.total(linalg.array_ones(spark, n)).first()[0] == n


def test_matvec(spark):
    n = 128
    got = {r["i"]: r["s"] for r in linalg.matvec(linalg.matrix_rows(spark, n), linalg.array_range(spark, n)).collect()}
    assert got == {i: (n - 1) * n * (2 * n - 1) / 6 + i * n * (n - 1) / 2 for i in range(n)}


def test_scalar_codes_truncate(spark):
    base = spark.createDataFrame([(i, [v, 7.0]) for i, v in enumerate((10.0, 12.0, 8.0, 14.0, 6.0))], "id long, vec array<float>")
    sq = quantize.ScalarQuantizer.fit(base)
    assert sq.scale[1] == 1.0
    codes = {r["id"]: [c + 128 for c in r["codes"]] for r in sq.transform(base).collect()}
    assert [codes[i][0] for i in range(5)] == [128, 191, 64, 255, 1] and codes[0][1] == 128


def test_all_candidates_give_exact(data):
    base, q = data
    want = pairs(exact.exact_topk(base, q, 5))
    sq = quantize.ScalarQuantizer.fit(base)
    assert pairs(sq.search(base, sq.transform(base), q, 5, 300)) == want
    pq = quantize.ProductQuantizer.fit(base, 4, 8, 3)
    assert pairs(pq.search(base, pq.transform(base), q, 5, 300)) == want
    index = ivf.IVFIndex.fit(base, 6, 3).transform(base)
    assert pairs(index.search(q, 5, 99)) == want
    assert pairs(index.quantized(pq).search_quantized(base, q, 5, 6, 300)) == want


def test_lists_on_disk_are_pruned(spark, data, tmp_path):
    base, q = data
    index = ivf.IVFIndex.fit(base, 6, 3).transform(base)
    index.save(str(tmp_path / "index"))
    stored = ivf.IVFIndex.load(spark, str(tmp_path / "index"))
    assert pairs(stored.search(q, 5, 2)) == pairs(index.search(q, 5, 2))
    plan = stored.search(q.where("qid = 0"), 5, 1)._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "list_id" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_empty_cluster_keeps_its_centroid(spark):
    base = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(4)], "id long, vec array<float>")
    start = np.array([[[0.0, 0.0], [100.0, 100.0]]])
    assert kmeans.lloyd(base, start, 2, "l2")[0][1].tolist() == [100.0, 100.0]


def test_refusals(data):
    base, q = data
    with pytest.raises(ValueError):
        quantize.ProductQuantizer.fit(base, 5, 8)
    with pytest.raises(ValueError):
        quantize.ProductQuantizer.fit(base, 4, 257)
    with pytest.warns(UserWarning):
        sq = quantize.ScalarQuantizer.fit(base)
        sq.search(base, sq.transform(base), q, 5, 2)
    with pytest.raises(ValueError):
        scan.check_positive(nprobe=0)


def test_graph(spark, data, tmp_path):
    base, q = data
    for i, (metric, rows, law, full) in enumerate((("ip", 1000, "log", "evict"), ("l2", 100, "coin", "refuse"))):
        truth = exact.exact_topk(base, q, 5, metric)
        hnsw.HNSWIndex.build(base, 8, 40, metric, shard_rows=rows, law=law, full=full).save(str(tmp_path / f"g{i}"))
        index = hnsw.HNSWIndex.load(spark, str(tmp_path / f"g{i}"), metric)
        recall = evaluate.mean_recall(truth, index.search(q, 5, 300), 5).first()[0]
        assert recall == 1.0 if full == "evict" else recall > 0
        degrees = {(r["level"], r["src"]): r["n"] for r in index.edges().groupBy("level", "src").agg(F.count("dst").alias("n")).collect()}
        assert max(n for (level, _), n in degrees.items() if level == 0) in range(9, 17) and all(n <= 8 for (level, _), n in degrees.items() if level)
        assert index.edges().where("src = dst").count() == 0
    flips = {r["max_level"]: r["count"] for r in hnsw.levels(base, 8, 1, "coin").groupBy("max_level").count().collect()}
    assert 110 < flips[0] < 190 and 40 < flips[1] < 110


def test_a_beam_as_wide_as_a_shard_is_exact(spark, data):
    """Though no link leads to some nodes, and copies tie."""
    base, _ = data
    copies = base.where("id % 3 = 0").select((F.col("id") + 1000).alias("id"), "vec")
    base = base.unionByName(copies).cache()
    q = base.where("id % 7 = 0").select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    for metric in ("ip", "l2"):
        want = pairs(exact.exact_topk(base, q, 5, metric))
        index = hnsw.HNSWIndex.build(base, 4, 8, metric, shard_rows=200, full="refuse")
        assert pairs(index.search(q, 5, 400)) == want
        assert pairs(index.search(q, 5, None)) == want


def test_many_queries_stay_partitioned(data, monkeypatch):
    """Beyond the broadcast's bound, and with small blocks, chunks and memory: the same hits."""
    base, q = data
    index = ivf.IVFIndex.fit(base, 6, 3).transform(base)
    graph = hnsw.HNSWIndex.build(base, 8, 40, shard_rows=100)
    runs = [lambda: exact.exact_topk(base, q, 5), lambda: exact.exact_topk(base, q, 5, "l2"), lambda: index.search(q, 5, 2), lambda: graph.search(q, 5, 300), lambda: exact.exact_topk(base, q, 5, plan="expr")]
    want = [pairs(r()) for r in runs]
    for name, value in (("BROADCAST_BYTES", 0), ("QUERY_BLOCK", 3), ("CHUNK", 7), ("HELD", 20), ("PREPARED", 1)):
        monkeypatch.setattr(scan, name, value)
    assert [pairs(r()) for r in runs] == want


def test_seeds_are_drawn_by_distance():
    """Against a plain roulette: the running minimum and the cumulative sum."""
    x = np.random.default_rng(1).normal(size=(50, 4))
    got, draw, seeds = kmeans.seeds_of(x, 6, 3), np.random.default_rng(3), [0]
    while len(seeds) < 6:
        weights = [min(float(((a - x[s]) ** 2).sum()) for s in seeds) for a in x]
        r, total, pick = draw.random() * sum(weights), 0.0, 0
        for i, w in enumerate(weights):
            total += w
            if total > r:
                pick = i
                break
        seeds.append(pick)
    assert (got == x[seeds]).all()
    assert (kmeans.seeds_of(np.ones((3, 2)), 3) == 1).all()


def test_all_code_distances_without_a_shuffle(spark, data, monkeypatch):
    base, q = data
    pq = quantize.ProductQuantizer.fit(base, 4, 8, 3)
    codes = pq.transform(base)
    norms = q.select("qid", vector.squared_norm(F.col("qvec")).alias("qnorm2"))
    rounded = lambda df: sorted((r["qid"], r["id"], round(r["dist"], 9)) for r in df.collect())
    want = rounded(quantize.adc_relational(codes, pq.table_frame(q), norms))
    assert rounded(pq.distances(codes, q)) == want and len(want) == 12 * 300
    for name, value in (("BROADCAST_BYTES", 0), ("QUERY_BLOCK", 5), ("CHUNK", 7), ("PAIRS", 20), ("PREPARED", 1)):
        monkeypatch.setattr(scan, name, value)
    assert rounded(pq.distances(codes, q)) == want
    products = rounded(scan.scan_all(base, q, exact.score("ip")))
    assert products == rounded(exact.pair_distances(base, q))


def test_pq_adc_dist_shuffles_no_pairs(spark):
    plan = catalog.pq_adc_dist(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Aggregate" not in plan


def test_stored_quantizers(spark, data, tmp_path):
    base, q = data
    sq, pq = quantize.ScalarQuantizer.fit(base), quantize.ProductQuantizer.fit(base, 4, 8, 3, "kmeans++", 1)
    assert (quantize.ScalarQuantizer.load(sq.frame(spark)).scale == sq.scale).all()
    assert (quantize.ProductQuantizer.load(pq.codebook_frame(spark)).codebook == pq.codebook).all()
    far = quantize.ProductQuantizer.fit(base, 4, 8, 10, "random", 2)
    index = ivf.IVFIndex.fit(base, 6, 3).transform(base).quantized(far)
    index.save(str(tmp_path / "ivfpq"))
    again = ivf.IVFIndex.load(spark, str(tmp_path / "ivfpq"), True)
    assert pairs(again.search_quantized(base, q, 5, 6, 300)) == pairs(exact.exact_topk(base, q, 5))


def test_console(spark, capsys):
    results.console(spark.range(3))
    assert "|2  |" in capsys.readouterr().out


def test_recall(data):
    base, q = data
    t = exact.exact_topk(base, q, 5)
    assert evaluate.mean_recall(t, t, 5).first()[0] == 1.0
    assert evaluate.recall_at_k(t, t.where("rank > 2"), 5).agg(F.max("recall")).first()[0] == 0.6


def test_kmeanspp_is_seeded(data):
    base, _ = data
    a, b = (kmeans.initial(base, 5, "kmeans++", 3) for _ in range(2))
    assert (a == b).all() and len({tuple(x) for x in a.tolist()}) == 5


def test_vector_files(spark, tmp_path):
    x = np.arange(50, dtype=np.float32).reshape(10, 5)
    vectors.write_vectors(str(tmp_path / "a.fbin"), x)
    rows = vectors.read_vectors(spark, str(tmp_path / "a.fbin"), split_rows=3).orderBy("id").collect()
    assert [r["vec"] for r in rows] == x.tolist() and [r["id"] for r in rows] == list(range(10))
    vectors.write_vectors(str(tmp_path / "t.bin"), np.array([[4, 2]], np.int32))
    assert [tuple(r) for r in vectors.read_truth(spark, str(tmp_path / "t.bin")).orderBy("rank").collect()] == [(0, 1, 4), (0, 2, 2)]


def test_result_files(spark, tmp_path):
    head = "algorithm,parallel_mode,parameter1,parameter2,threads,latency_us,recall@10"
    (tmp_path / "one.csv").write_text(f"{head}\nflat,omp,-,-,1,12,0.5\nivfpq,omp,100-8,10,2,7,0.25\n")
    (tmp_path / "all.txt").write_text(f"==> one.csv <==\n{head}\nflat,omp,-,-,1,12,0.5\n\n==> two.csv <==\n{head}\nivfpq,omp,100-8,10,2,7,0.25\n")
    a = [tuple(r) for r in results.read_search_results(spark, str(tmp_path / "one.csv")).orderBy("threads").collect()]
    assert a == [tuple(r) for r in results.read_concatenated(spark, str(tmp_path / "all.txt")).orderBy("threads").collect()]
    assert a[0][2] is None and a[1][-2:] == (100, 8)
    results.write_benchmark(spark.createDataFrame([(1, 0.5)], "N int, ms double"), str(tmp_path / "out"), {"ms": 4})
    assert spark.read.csv(str(tmp_path / "out"), header=True).first()["ms"] == "0.5000"


def test_stream_of_queries(spark, data, tmp_path):
    base, q = data
    q.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(q.schema).parquet(str(tmp_path / "in"))
    run = search_stream(stream, lambda b: exact.exact_topk(base, b, 3), str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert pairs(spark.read.parquet(str(tmp_path / "out"))) == pairs(exact.exact_topk(base, q, 3))
