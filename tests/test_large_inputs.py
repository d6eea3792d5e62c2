"""Steps whose work once grew with the square of a group."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.operators import inference


def stepped_up(p, factor=1.0):
    order = np.argsort(p, kind="stable")
    x = len(p) / np.arange(1, len(p) + 1) * p[order]
    out = np.empty(len(p))
    out[order] = np.minimum(np.minimum.accumulate(x[::-1])[::-1] * factor, 1)
    return out


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString().lower()


def test_step_up_of_a_large_family_looks_at_each_row_once(spark):
    sizes = {"a": 30_000, "b": 7, None: 50}
    rng = np.random.default_rng(3)
    p = {f: np.round(rng.random(n) ** 2, 4) for f, n in sizes.items()}  # with ties
    frame = spark.createDataFrame([(f, i, float(x)) for f in sizes for i, x in enumerate(p[f])], "family string, id long, p double")
    up, down = inference.step_up(frame, F.lit(0.5)), inference.holm(frame)
    assert "unboundedfollowing" not in plan_of(up).replace(" ", "")
    got = {(r["family"], r["id"]): r["adjusted"] for r in up.collect()}
    fallen = {(r["family"], r["id"]): r["adjusted"] for r in down.collect()}
    assert len(got) == len(fallen) == sum(sizes.values())
    for f, n in sizes.items():
        assert [got[f, i] for i in range(n)] == pytest.approx(stepped_up(p[f], 0.5))
        order = np.argsort(p[f], kind="stable")
        want = np.minimum(np.maximum.accumulate((n - np.arange(n)) * p[f][order]), 1)
        assert [fallen[f, i] for i in order] == pytest.approx(want)


def test_storey_takes_its_share_once_a_family(spark, tmp_path):
    from lodestrata.plans import catalogue

    n = 20_000
    spark.range(1, n + 1).select(F.col("id").alias("p_partkey"), F.when(F.col("id") % 2 == 0, "one").alias("p_brand")).write.parquet(f"{tmp_path}/part.parquet")
    q = catalogue.queries()["storey_q"](spark, str(tmp_path))
    assert "unboundedfollowing" not in plan_of(q).replace(" ", "")
    got = {r["id"]: r["adjusted"] for r in q.collect()}
    assert len(got) == n  # parts without a brand are a family
    for first in (1, 2):
        k = np.arange(first, n + 1, 2)
        p = (k * 7919 % 10007 + 1) / 10008 * ((k % 7 + 1) / 70)
        assert [got[i] for i in k] == pytest.approx(stepped_up(p, min(np.mean(p > 0.05) / 0.95, 1)), abs=2e-9)


def test_yekutieli_adds_its_series_once_a_family(spark, tmp_path):
    from lodestrata.plans import catalogue

    n = 20_000
    spark.range(1, n + 1).select(F.col("id").alias("p_partkey"), F.lit("one").alias("p_brand")).write.parquet(f"{tmp_path}/part.parquet")
    began = time.time()
    got = {r["id"]: r["adjusted"] for r in catalogue.queries()["benjamini_yekutieli"](spark, str(tmp_path)).collect()}
    assert time.time() - began < 20
    k = np.arange(1, n + 1)
    want = stepped_up((k * 7919 % 10007 + 1) / 10008 * ((k % 7 + 1) / 70), sum(1 / k))
    assert [got[i] for i in k] == pytest.approx(want, abs=2e-9)
    for m in (1, 2, 65_536, 65_537, 200_000):
        assert spark.range(1).select(inference.harmonic(F.lit(m))).first()[0] == np.cumsum(1 / np.arange(1, m + 1))[-1]


def test_equal_shares_add_up_the_same_in_any_number_of_tasks(spark):
    from lodestrata.operators import graph

    sizes = range(3, 60)
    edges = [(f"o{n}-{i}", f"c{n}", 0.6) for n in sizes for i in range(n)]
    frame = spark.createDataFrame(edges, "src string, dst string, confidence double").repartition(16)
    nodes = frame.select(F.col("src").alias("node")).unionAll(frame.select("dst")).distinct()
    restart = F.when(F.col("node").startswith("o"), 1.0).otherwise(0.0)
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        got = {r["node"]: r["mass"] for r in graph.pagerank(frame, nodes, restart, iterations=1).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for n in sizes:
        f = 0.0
        for _ in range(n):
            f += 1 / len(edges)
        assert got[f"c{n}"] == 0.85 * f, n
