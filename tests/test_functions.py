"""Values worked out by hand."""

import math

import numpy as np
import pytest

from lodestrata.functions import stats
from lodestrata.operators import evaluate, fusion, graph, inference, lexical, packing, vector


def docs(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc long, text string")


def asks(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "qid long, text string")


def test_bm25_plus_of_one_document(spark):
    ix = lexical.index(docs(spark, "alpha beta beta"), asks(spark, "beta"))
    assert lexical.bm25_plus(ix).first()["score"] == pytest.approx(17 * math.log(2) / 7)
    assert lexical.bm25_plus(ix, delta=0.0).first()["score"] == pytest.approx(10 * math.log(2) / 7)


def test_query_likelihood(spark):
    ix = lexical.index(docs(spark, "a a b", "a b b"), asks(spark, "a a b"))
    got = {r["doc"]: r["score"] for r in lexical.qlm_dirichlet(ix, 5, 2.0).collect()}
    assert got == {0: pytest.approx(-1.937942, abs=1e-6), 1: pytest.approx(-2.343407, abs=1e-6)}
    got = {r["doc"]: r["score"] for r in lexical.qlm_jm(ix, 5, 0.5).collect()}
    assert got == {0: pytest.approx(-1.953462, abs=1e-6), 1: pytest.approx(-2.289934, abs=1e-6)}


def test_smoothing_ranks_documents_without_a_match(spark):
    ix = lexical.index(docs(spark, "x x x x", "a", "x", "", None), asks(spark, "a"))
    assert [r["doc"] for r in lexical.best(lexical.qlm_dirichlet(ix, 5), 5).orderBy("rank").collect()] == [1, 3, 4, 2, 0]


def test_rrf_and_combinations(spark):
    ranks = spark.createDataFrame([("x", 0, d, i + 1) for i, d in enumerate("abc")] + [("y", 0, d, i + 1) for i, d in enumerate("cb")], "ranker string, qid long, doc string, rank long")
    got = {r["doc"]: r["score"] for r in fusion.reciprocal_rank(ranks).collect()}
    assert got["c"] == pytest.approx(124 / 3843) and got["c"] > got["b"] > got["a"]
    scores = spark.createDataFrame([("x", 0, "a", 10.0), ("x", 0, "b", 7.0), ("x", 0, "c", 0.0), ("x", 0, "d", 10.0), ("y", 0, "d", 7.0), ("y", 0, "a", 0.0)], "ranker string, qid long, doc string, score double")
    assert {r["doc"]: r["score"] for r in fusion.combine(scores, "mnz").collect()} == {"a": 1.0, "b": pytest.approx(0.7), "c": 0.0, "d": 4.0}


def test_packing_stops_at_the_first_overflow(spark):
    d = docs(spark, "x" * 8, "x" * 40, "x" * 4, "")
    ranked = spark.createDataFrame([(0, i, i + 1) for i in range(4)], "qid long, doc long, rank long")
    assert [r["doc"] for r in packing.pack(ranked, d, 5).collect()] == [0]
    assert packing.pack(ranked, d, 13).count() == 4
    with pytest.raises(ValueError):
        packing.pack(ranked, d, -1)


def test_mmr():
    sim = np.array([[1, 0.8, 0.1], [0.8, 1, 0.2], [0.1, 0.2, 1]])
    assert vector.mmr_order(np.array([0.9, 0.8, 0.5]), sim, 0.5) == [0, 2, 1]
    assert vector.mmr_order(np.array([0.9, 0.8, 0.5]), sim, 1.0) == [0, 1, 2]


def test_blocked_search_is_exact(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(300, 8))
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "id long, v array<double>").repartition(5)
    got = vector.top_k(v.where("id < 7"), v, 4).orderBy("qid", "rank").collect()
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    want = np.argsort(-(u[:7] @ u.T), axis=1)[:, :4]
    assert [r["doc"] for r in got] == want.reshape(-1).tolist()


def chain(spark, n=5):
    return spark.createDataFrame([(f"n{i}", f"n{i + 1}", "next", 1.0) for i in range(n - 1)], "src string, dst string, rel string, confidence double")


def test_walks(spark):
    seeds = spark.createDataFrame([("n0",)], "seed string")
    assert {r["node"] for r in graph.reach(chain(spark), seeds, 2, "out").collect()} == {"n0", "n1", "n2"}
    assert graph.reach(chain(spark, 8), seeds, 10, "out").agg({"depth": "max"}).first()[0] == 3
    got = {r["node"]: r["activation"] for r in graph.spread(chain(spark, 4), seeds).collect()}
    assert got == {"n0": 1, "n1": 0.5, "n2": 0.25, "n3": 0.125}


def test_decay(spark):
    e = spark.createDataFrame([("a", "b", 0.8, 0, None), ("a", "c", 0.5, 10, 0), ("a", "d", 0.15, 0, None)], "src string, dst string, confidence double, traversal_count int, last_tick int")
    got = {r["dst"]: (round(r["confidence"], 9), r["what"]) for r in graph.decayed(e, 1, rate=0.5, restore=0.4).collect()}
    assert got == {"b": (0.4, "decayed"), "c": (0.7, "reinforced")}


def test_pagerank_keeps_its_mass(spark):
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(3)], "node string")
    from pyspark.sql import functions as F

    got = {r["node"]: r["mass"] for r in graph.pagerank(chain(spark, 3), nodes, F.when(F.col("node") == "n0", 1.0).otherwise(0.0), alpha=0.2, iterations=60).collect()}
    want = {"n0": 0.2, "n1": 0.16, "n2": 0.128}
    total = sum(want.values())
    assert got == {k: pytest.approx(v / total, abs=1e-6) for k, v in want.items()}


def test_metrics_of_one_ranking(spark):
    ranked = spark.createDataFrame([(0, i, i + 1) for i in range(4)], "qid long, doc long, rank long")
    gold = spark.createDataFrame([(0, 0), (0, 2)], "qid long, doc long")
    got = evaluate.retrieval_scores(ranked, gold, asks(spark, "x", "y")).orderBy("qid").collect()
    r = got[0]
    assert (r["rbp"], r["ap"], r["r_precision"], r["err"]) == (0.328, pytest.approx(5 / 6, abs=1e-6), 0.5, pytest.approx(7 / 12, abs=1e-6))
    assert r["chain_recovered"] and r["rr"] == 1 and r["precision"] == 0.5
    assert (got[1]["precision"], got[1]["recall"], got[1]["ndcg"], got[1]["chain_recovered"]) == (1.0, 1.0, 1.0, False)


def test_agreement_and_pareto(spark):
    r = spark.createDataFrame([(u, c) for u, row in enumerate(["AAA", "AAB", "BBB", "ABB"]) for c in row], "unit long, label string")
    assert evaluate.fleiss_counts(r).first()["kappa"] == pytest.approx(1 / 3)
    assert evaluate.krippendorff(r).first()["alpha"] == pytest.approx(7 / 18)
    p = spark.createDataFrame([("a", 0.9, 10.0), ("b", 0.7, 5.0), ("c", 0.6, 8.0), ("d", 0.5, 12.0)], "name string, accuracy double, cost double")
    front = evaluate.pareto(p)
    assert {x["name"] for x in front.collect()} == {"a", "b"}
    assert evaluate.hypervolume(front, 0.0, 20.0).first()[0] == pytest.approx(12.5)


def test_meta_analysis_and_betting(spark):
    s = spark.createDataFrame([(0.1, 0.02), (0.3, 0.03), (0.5, 0.05)], "effect double, variance double")
    got = inference.random_effects(s).first()
    assert (got["q"], got["tau2"], got["i2"], got["pooled"]) == (pytest.approx(76 / 31), pytest.approx(0.007, abs=1e-4), pytest.approx(7 / 38), pytest.approx(0.252227, abs=1e-5))
    x = spark.createDataFrame([(0, i, v) for i, v in enumerate([1.0, 1.0, 0.0, 1.0])], "key long, nth long, x double")
    got = [r["capital"] for r in inference.betting_path(x, 0.5, 0.5).orderBy("nth").collect()]
    assert got == pytest.approx([1.25, 1.5625, 1.171875, 1.464844], abs=1e-6)


def test_small_fits():
    assert stats.isotonic([1, 2, 3, 2, 1]) == [1, 2, 2, 2, 2]
    assert stats.isotonic([1, 2, 3, 2, 1], rising=False) == [2, 2, 2, 2, 1]
    assert stats.bayes_factor(9, 10) == pytest.approx(1024 / 110)
    assert stats.aligned_rank_f(np.array([[[1, 3], [2, 4]], [[5, 7], [6, 10]]], float)) == pytest.approx(32 / 2.25)
    assert stats.t_cdf(2.0, 10) == pytest.approx(0.963306, abs=1e-6)
    assert stats.f_sf(4.0, 2, 12) == pytest.approx(0.046656, abs=1e-4)
    assert stats.chi2_sf(5.991465, 2) == pytest.approx(0.05, abs=1e-6)
    assert stats.wilcoxon([1, 2, 3, 4, 5], [0, 0, 0, 0, 0])[1] == pytest.approx(2 / 32)
    assert stats.mcnemar(1, 9) == pytest.approx(22 / 1024)
    assert stats.friedman(np.array([[1, 2, 3], [1, 2, 3], [1, 2, 3.0]]))[0] == pytest.approx(6)
    assert stats.quantile_line([0, 1, 2, 3], [1, 3, 5, 7], 0.5) == pytest.approx((1, 2))
    low = stats.percentile_ci(range(100), n=300)
    assert low[1] < low[0] == 49.5 < low[2]
    x = np.linspace(-4, 4, 30)
    got = stats.logistic_curve(x, 0.1 + 0.8 / (1 + np.exp(-1.5 * (x - 0.5))))
    assert got == pytest.approx((0.1, 0.9, 0.5, 1.5), abs=1e-3)
