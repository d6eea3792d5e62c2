"""Queries and operators that once did a part of their job."""

from lodestrata.plans import catalogue

SF = "/root/testdata/sf0.001"


def test_pivot_has_a_column_for_each_depth(spark):
    q = catalogue.queries()
    got = {(r["arm"], int(c[1:])): r[c] for r in q["crossover_pivot_all"](spark, SF).collect() for c in r.asDict() if c != "arm" and r[c] is not None}
    assert got == {(r["arm"], r["depth"]): r["recovery"] for r in q["depth_crossover"](spark, SF).collect()}
    assert {d for _, d in got} == set(range(1, 8))


def test_pagerank_goes_on_to_the_fixed_point(spark):
    import numpy as np
    import pytest
    from pyspark.sql import functions as F

    from lodestrata.operators import graph

    edges = [(0, 1, 0.9), (1, 2, 0.5), (2, 0, 0.7), (2, 3, 0.3), (1, 2, 0.2), (4, 0, 1.0), (1, 5, 0.4)]  # a cycle, parallel edges, dangling 3 and 5
    weight, p = np.array([1.0, 0, 0, 2, 0, 0]), np.zeros((6, 6))
    for a, b, c in edges:
        p[a, b] += c
    sums = p.sum(axis=1, keepdims=True)
    p = np.divide(p, sums, out=np.zeros_like(p), where=sums > 0)
    s = weight / weight.sum()
    want = s
    for _ in range(2000):
        want = 0.85 * (p.T @ want + want[sums[:, 0] == 0].sum() * s) + 0.15 * s
    frame = spark.createDataFrame([(str(a), str(b), c) for a, b, c in edges], "src string, dst string, confidence double")
    nodes = spark.createDataFrame([(str(i),) for i in range(6)], "node string")
    restart = F.when(F.col("node") == "0", 1.0).when(F.col("node") == "3", 2.0).otherwise(0.0)
    got = {int(r["node"]): r["mass"] for r in graph.pagerank(frame, nodes, restart, tolerance=1e-7).collect()}
    assert got == {i: pytest.approx(m, abs=1e-7) for i, m in enumerate(want)}
    assert graph.pagerank(frame, nodes, restart, iterations=1).where("node = '1'").first()["mass"] == pytest.approx(0.85 / 3)


def test_pagerank_query_settles(spark):
    got = dict(catalogue.queries()["pagerank_converged"](spark, SF).selectExpr("substr(node, 1, 1) AS level", "mass").groupBy("level").sum("mass").collect())
    ends = [0.85**k for k in range(4)]  # order, customer, nation, region
    assert all(abs(got[level] - x / sum(ends)) < 1e-4 for level, x in zip("ocnr", ends))


def test_rm3_ranks_all_documents_by_the_expanded_query(spark):
    import math
    from collections import Counter

    import pytest

    from lodestrata.functions import text as tx
    from lodestrata.plans import ranking

    q = catalogue.queries()
    weights, got = {}, {}
    for r in ranking._expanded(spark, SF)[2].collect():
        weights.setdefault(r["qid"], {})[r["term"]] = r["weight"]
    for r in q["rm3_topk"](spark, SF).collect():
        got.setdefault(r["qid"], {})[r["rank"]] = r["score"]
    docs = [Counter(r["ws"]) for r in ranking.corpus(spark, SF).select(tx.tokens("text").alias("ws")).collect()]
    sizes, words = [d.total() for d in docs], Counter()
    for d in docs:
        words.update(d)
    total = sum(sizes)
    assert len(got) >= 5
    for qid in sorted(got)[:5]:
        known = [(t, w) for t, w in weights[qid].items() if words[t]]
        scores = sorted((sum(w * math.log((0.5 * d[t] / n if n else 0) + 0.5 * words[t] / total) for t, w in known) for d, n in zip(docs, sizes)), reverse=True)
        assert [got[qid][k] for k in range(1, 11)] == pytest.approx(scores[:10], abs=2e-6)


def test_random_pack_fills_the_budget_and_no_more(spark):
    from pyspark.sql import functions as F

    from lodestrata.operators import packing

    for chars in (4, 400):  # costs of 1 and 100
        docs = spark.range(0, 300).select(F.col("id").alias("doc"), F.repeat(F.lit("x"), chars).alias("text"))
        got = packing.shuffled(docs, 0, 150).orderBy("rank").collect()
        n = min(300, 150 // (chars // 4))
        want = docs.orderBy(F.md5(F.concat(F.lit("0/"), F.col("doc").cast("string")).cast("binary")), "doc").limit(n).select("doc").collect()
        assert [r["doc"] for r in got] == [r["doc"] for r in want] and got[-1]["used"] == n * (chars // 4)


def test_intervals_resample_as_often_as_the_operators_do(spark):
    from lodestrata.functions import stats

    events = spark.read.parquet(f"{SF}/events.parquet").where("value is not null").select("event_type", "event_id", "user_id", "value").toPandas().sort_values("event_id")
    operators = {
        "bootstrap_ci": lambda f: stats.percentile_ci(f["value"]), "studentized_ci": lambda f: stats.studentized_ci(f["value"]),
        "subsample_ci": lambda f: stats.subsampling_ci(f["value"]), "cluster_ci": lambda f: stats.cluster_ci(f["value"], f["user_id"]),
    }
    for name, operator in operators.items():
        got = {r["event_type"]: (r["point"], r["low"], r["high"]) for r in catalogue.queries()[name](spark, SF).collect()}
        assert got == {k: tuple(round(x, 6) for x in operator(f)) for k, f in events.groupby("event_type")}
