"""Walks, late interaction, fixed patterns and guards against plain Python on small inputs."""

import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lodestrata.functions import text as tx
from lodestrata.functions import theory
from lodestrata.operators import evaluate, graph, inference, lexical, traverse, vector
from lodestrata.plans import evaluation, ranking

SF = "/root/testdata/sf0.001"


def walked(edges, start, hops, most, direction):
    """Breadth first, out-edges before in-edges, by number; what a first-in first-out queue gives."""
    depth, order, steps, queue, cut = {start: 0}, [start], [], [start], False
    while queue:
        node = queue.pop(0)
        if depth[node] >= hops:
            continue
        out = [(b, s) for s, a, b in edges if a == node] if direction != "in" else []
        back = [(a, s) for s, a, b in edges if b == node] if direction != "out" else []
        for to, seq in out + back:
            steps.append(seq)
            if to in depth:
                continue
            if len(depth) >= most:
                cut = True
                continue
            depth[to] = depth[node] + 1
            order.append(to)
            queue.append(to)
    return order, [depth[n] for n in order], sorted(steps), cut


@pytest.mark.parametrize(("hops", "most", "direction"), [(2, 100, "both"), (3, 6, "both"), (9, 100, "out"), (3, 100, "in"), (0, 3, "both")])
def test_walks_in_order(spark, hops, most, direction):
    rng = random.Random(3)
    edges = [(s, rng.randrange(14), rng.randrange(14)) for s in range(30)] + [(30, 2, 2)]
    frame = spark.createDataFrame([(s, a, b, "r", 1.0) for s, a, b in edges], "seq long, src long, dst long, rel string, confidence double")
    seeds = spark.createDataFrame([(w, w, 0) for w in range(14)], "walk long, node long, pos int")
    nodes, followed = traverse.traverse(frame, seeds, hops, most, direction)
    rows, steps = nodes.orderBy("walk", "ord").collect(), followed.collect()
    for w in range(14):
        order, depths, took, cut = walked(edges, w, min(max(hops, 1), 3), most, direction)
        own = [r for r in rows if r["walk"] == w]
        assert [r["node"] for r in own] == order and [r["depth"] for r in own] == depths
        assert sorted(r["seq"] for r in steps if r["walk"] == w) == took and {r["truncated"] for r in own} == {cut}


def test_final_links_alone_stay(spark):
    edges = spark.createDataFrame([(0, "s", "a", "related", 1.0), (1, "a", "g", "constrains", 1.0), (2, "t", "b", "related", 1.0)], "seq long, src string, dst string, rel string, confidence double")
    ranked = spark.createDataFrame([(1, "s", 1), (1, "t", 2)], "qid long, doc string, rank long")
    got = traverse.follow_links(edges, ranked, 2).orderBy("rank").collect()
    assert [r["doc"] for r in got] == ["s", "g", "t", "b"]
    fused = {r["doc"]: r["score"] for r in traverse.fuse_with_walk(edges, ranked).collect()}
    assert fused["s"] == pytest.approx(2 / 61) and fused["a"] == pytest.approx(1 / 63)


def test_late_interaction(spark):
    docs = {1: "alpha beta", 2: "gamma", 3: "", 4: None, 5: "Alpha ALPHA delta_x"}
    asked = {7: "alpha gamma gamma", 8: ""}
    frame = spark.createDataFrame(list(docs.items()), "doc long, text string")
    queries = spark.createDataFrame(list(asked.items()), "qid long, text string")
    got = {(r["qid"], r["doc"]): r["score"] for r in vector.word_maxsim(queries, frame).collect()}
    words = lambda t: np.array([vector.word_vector(w) for w in (t or "").lower().split()]).reshape(-1, 256)
    want = {(7, d): vector.maxsim_score(words(asked[7]), words(t)) for d, t in docs.items() if t}
    assert got == {k: pytest.approx(v) for k, v in want.items()} and want[7, 2] > want[7, 1]
    assert vector.maxsim_score(np.zeros((0, 4)), np.ones((2, 4))) == 0


def test_fixed_patterns(spark):
    texts = ["call _run() and PlanB, useX", "@a/b-c withAuditLog() Plain", "éfooBar() fooBaré", "I WON'T", "  \u00a0I'm not able to ", None, ""]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", tx.identifiers("t").alias("x"), tx.refuses("t").alias("r"), tx.stripped("t").alias("s")).orderBy("i").collect()
    assert set(rows[0]["x"]) == {"run()", "run", "PlanB", "useX"}
    assert set(rows[1]["x"]) == {"@a/b-c", "withAuditLog()", "withAuditLog"}
    assert set(rows[2]["x"]) == {"fooBar()", "fooBar"}
    assert [r["r"] for r in rows] == [False] * 3 + [True] * 2 + [False] * 2 and rows[4]["s"] == "I'm not able to" and rows[5]["s"] == ""
    ok = spark.range(1).select(tx.honoured(F.lit("use PlanB"), F.lit("d1"), F.lit("we took PlanB")).alias("a"), tx.honoured(F.lit("plain words"), F.lit("d1"), F.lit("see d1")).alias("b"), tx.honoured(F.lit(None).cast("string"), F.lit("d1"), F.lit("")).alias("c")).first()
    assert tuple(ok) == (True, True, False)
    assert spark.range(1).select(tx.expanded(F.lit("q"))).first()[0] == f"q\n\n{tx.PASSAGE} q"
    assert spark.range(1).select(tx.session_of(F.lit("D3:2"))).first()[0] == 3


def test_guards(spark):
    with pytest.raises(PySparkException):
        spark.range(1).select(tx.session_of(F.lit("D3"))).collect()
    items = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c")], "chain int, item string")
    links = spark.createDataFrame([(1, "b", "a")], "chain int, src string, dst string")
    with pytest.raises(PySparkException):
        graph.current_of(items, links).collect()
    assert graph.current_of(items, links.union(spark.createDataFrame([(1, "c", "b")], links.schema))).first()["item"] == "c"
    edges = spark.createDataFrame([("a", "b", 0.5)], "src string, dst string, confidence double")
    nodes = spark.createDataFrame([("a",)], "node string")
    with pytest.raises(PySparkException):
        graph.checked_edges(edges, nodes).collect()
    with pytest.raises(PySparkException):
        graph.unique_nodes(nodes.union(nodes)).collect()
    runs = spark.createDataFrame([("m", 10.0, 2.0)], "model string, tokens_in double, tokens_out double")
    prices = spark.createDataFrame([("m", 3.0, 15.0)], "model string, per_million_in double, per_million_out double")
    assert evaluate.priced(runs, prices).first()["dollars"] == pytest.approx(60e-6)
    with pytest.raises(PySparkException):
        evaluate.priced(runs, prices.limit(0)).collect()
    with pytest.raises(ValueError):
        evaluate.single_tier(spark.createDataFrame([("a",), ("b",)], "tier string"))


def test_sums_do_not_depend_on_order(spark):
    rows = spark.range(0, 5000).select((F.col("id") % 2).alias("qid"), F.lit(1).alias("doc"), (F.rand(1) * 100).alias("v"))
    rows = lexical.kept(rows)
    a = rows.repartition(7).groupBy("qid").agg(lexical.exact_sum(F.col("v")).alias("s")).orderBy("qid").collect()
    b = rows.orderBy("v").groupBy("qid").agg(lexical.exact_sum(F.col("v")).alias("s")).orderBy("qid").collect()
    assert a == b


def test_documents_without_a_match_come_in_corpus_order(spark):
    docs = spark.createDataFrame([(i, "zeta" if i == 5 else "other words here") for i in range(8)] + [(9, None)], "doc long, text string")
    asked = spark.createDataFrame([(1, "zeta"), (2, "unknown"), (3, "")], "qid long, text string")
    ix = lexical.index(docs, asked)
    for scores in (lexical.with_the_rest(ix, lexical.bm25_plus(ix), 4), lexical.qlm_jm(ix, 4), lexical.qlm_dirichlet(ix, 4)):
        got = {}
        for r in lexical.best(scores, 4).orderBy("qid", "rank").collect():
            got.setdefault(r["qid"], []).append(r["doc"])
        assert got[1][0] == 5 and len(got[1]) == 4 and got[2] == got[3] == [0, 1, 2, 3]


def test_containing_is_contains(spark):
    docs, items = ranking.corpus(spark, SF), ranking.asked(spark, SF)
    extra = spark.createDataFrame([(900, "a"), (901, "the"), (902, ", ")], "qid long, text string")
    items = items.unionByName(extra)
    want = {tuple(r) for r in docs.withColumnRenamed("text", "w").join(items, F.contains("w", "text")).select("qid", "doc").collect()}
    assert {tuple(r) for r in evaluation.containing(docs, items).collect()} == want


def test_fano_and_crossing(spark):
    e = spark.range(1).select(theory.fano_error(1.0, 4).alias("e"), theory.fano_error(2.0, 4).alias("m"), theory.fano_error(0.0, 4).alias("z"), theory.fano_error(5.0, 1).alias("one")).first()
    h = lambda p: -p * np.log2(p) - (1 - p) * np.log2(1 - p)
    assert h(e["e"]) + e["e"] * np.log2(3) == pytest.approx(1.0, abs=1e-9) and (e["m"], e["z"], e["one"]) == (0.75, 0.0, 0.0)
    curve = spark.createDataFrame([(1, 1, -1.0), (1, 2, 1.0), (2, 1, 0.5), (2, 2, 0.1), (3, 1, -1.0)], "key int, x int, y double")
    assert {r["key"]: r["crossing"] for r in inference.first_crossing(curve).collect()} == {1: 1.5, 2: 1.0, 3: None}


def test_confidence_sequence_against_numpy(spark):
    x = np.random.default_rng(0).integers(0, 2, 60)
    rows = spark.createDataFrame([(1, i + 1, int(v)) for i, v in enumerate(x)], "key int, nth int, x int")
    got = inference.confidence_sequence(rows, 0.9, 0.5, 49).orderBy("nth").collect()
    grid = np.arange(1, 50) / 50
    d = x[None, :] - grid[:, None]
    most = np.maximum.accumulate(0.5 * np.cumprod(1 + 0.5 * d, 1) + 0.5 * np.cumprod(1 - 0.5 * d, 1), 1)
    stays = np.round(most, 9) < 1 / (1 - 0.9)
    low = np.maximum.accumulate([grid[s].min() if s.any() else 0.0 for s in stays.T])
    high = np.minimum.accumulate([grid[s].max() if s.any() else 1.0 for s in stays.T])
    assert [r["lower"] for r in got] == pytest.approx(low.tolist()) and [r["upper"] for r in got] == pytest.approx(high.tolist())
