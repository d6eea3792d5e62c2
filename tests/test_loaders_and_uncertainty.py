"""Loaders and generators of tasks; null shares, sample sizes, crossover intervals and posteriors."""

import json
import math

import numpy as np
import pytest

from lodestrata.functions import stats
from lodestrata.operators import inference
from lodestrata.plans import catalogue
from lodestrata.sources import loaders, tables

SF = "/root/testdata/sf0.001"


def saved(path, value):
    path.write_text(json.dumps(value))
    return str(path)


def test_dialogues(spark, tmp_path):
    turn = lambda s, n: {"speaker": "Ann", "dia_id": f"D{s}:{n}", "text": f"t{s}{n}"}
    talk = {"speaker_a": "Ann", "session_10": [turn(10, 1)], "session_2": [turn(2, 1), turn(2, 2)], "session_2_date_time": "May", "session_2_summary": "no turn"}
    qa = [
        {"question": "a", "answer": 7, "evidence": ["D10:1", "D2:2", "D10:1"], "category": 1},
        {"question": "b", "answer": "x", "evidence": ["D2:1"], "category": 5},
        {"question": "c", "answer": "y", "evidence": [], "category": 2},
        {"question": "d", "answer": "z", "evidence": ["D2:1"], "category": 2},
    ]
    path = saved(tmp_path / "a.json", [{"sample_id": "s", "conversation": talk, "qa": qa}])
    tasks, items = loaders.read_dialogues(spark, path)
    got = {r["task_id"]: r for r in tasks.collect()}
    assert set(got) == {"locomo-s-q0", "locomo-s-q3"}
    assert got["locomo-s-q0"]["gold"] == ["D10:1", "D2:2"] and got["locomo-s-q0"]["depth"] == 9 and got["locomo-s-q0"]["answer"] == "7"
    assert [(r["item_id"], r["text"], r["date"]) for r in items.orderBy("pos").collect()] == [("D2:1", "Ann: t21", "May"), ("D2:2", "Ann: t22", "May"), ("D10:1", "Ann: t101", "")]
    assert [r["task_id"] for r in loaders.read_dialogues(spark, path, [2])[0].collect()] == ["locomo-s-q3"]
    qa[0]["evidence"] = ["D9:9"]
    with pytest.raises(Exception, match="D9:9"):
        loaders.read_dialogues(spark, saved(tmp_path / "b.json", [{"sample_id": "s", "conversation": talk, "qa": qa}]))[0].collect()


def test_multi_hop(spark, tmp_path):
    record = {"_id": "1", "question": "q", "answer": "yes", "level": "hard", "context": [["A", ["a \"0\"", "a1"]], ["B", ["b0"]]], "supporting_facts": [["B", 0], ["A", 1], ["B", 0]]}
    path = saved(tmp_path / "a.json", [record, record | {"_id": "2", "level": "easy"}])
    tasks, items = loaders.read_multi_hop(spark, path, ["hard"])
    row = tasks.collect()
    assert [(r["task_id"], r["gold"], r["depth"], r["answer"]) for r in row] == [("hotpotqa-1", ["B :: s0", "A :: s1"], 2, "yes")]
    assert [(r["item_id"], r["text"], r["is_supporting"]) for r in items.orderBy("pos").collect()] == [("A :: s0", 'a "0"', False), ("A :: s1", "a1", True), ("B :: s0", "b0", True)]
    with pytest.raises(ValueError):
        loaders.read_multi_hop(spark, path, ["harder"])
    with pytest.raises(Exception, match="C :: s0"):
        loaders.read_multi_hop(spark, saved(tmp_path / "b.json", [record | {"supporting_facts": [["C", 0]]}]))[0].collect()


def test_snapshots(spark, tmp_path):
    session = {"session_id": "s1", "date": "May", "is_gold": True, "turns": [{"role": "user", "content": "hi"}, {"role": "bot", "content": "ho"}]}
    q = {"question_id": "1", "question_type": "knowledge-update", "question": "q", "answer": 3, "depth": 2, "answer_session_ids": ["s1"], "sessions": [session]}
    path = saved(tmp_path / "a.json", {"questions": [q, q | {"question_id": "2", "question_type": "other"}]})
    tasks, items = loaders.read_snapshots(spark, path)
    assert [(r["task_id"], r["gold"], r["depth"], r["answer"]) for r in tasks.collect()] == [("longmemeval-1", ["s1"], 2, "3")]
    assert [(r["item_id"], r["text"], r["is_gold"]) for r in items.collect()] == [("s1", "user: hi\nbot: ho", True)]
    with pytest.raises(ValueError):
        loaders.read_snapshots(spark, path, ["other"])


def test_repositories(spark, tmp_path):
    base = {"base_commit": "c", "problem_statement": "p", "snippet_constraint": "k", "remote_qualname": "f"}
    rows = [base | {"instance_id": str(i), "repo": r, "remote_qualname": n, "snippet_full": f"full{i}", "snippet_justification": j} for i, (r, n, j) in enumerate([("x", "f", "why"), ("x", "f", ""), ("x", "g", ""), ("y", "f", "")])]
    path = saved(tmp_path / "a.json", {"instances": rows})
    certified = spark.createDataFrame([("0", 3), ("1", 3), ("2", 3), ("3", 1)], "task_id string, depth int")
    tasks, items = loaders.read_repositories(spark, path, certified)
    assert tasks.where("task_id = '1'").first()["query"] == "p\n\nRelevant code in this repo you must honour:\nfull1"
    assert sorted((r["corpus_id"], r["item_id"], r["text"]) for r in items.collect()) == [("x", "f", "full0"), ("x", "g", "full2"), ("y", "f", "full3")]
    tasks, items = loaders.read_repositories(spark, path, certified, 3, True)
    assert tasks.count() == 3 and {r["query"] for r in tasks.collect()} == {"p"}
    assert [(r["item_id"], r["text"]) for r in items.orderBy("pos").collect()] == [("f", "k"), ("f-rationale", "why"), ("g", "k")]
    with pytest.raises(ValueError):
        loaders.read_repositories(spark, path, certified, 2)


def test_revisions_end_in_their_head(spark):
    tasks, items, gold, edges = tables.revision_tasks(spark, 3, 4, seed=1)
    assert tasks.count() == 4 and items.count() == 36 and edges.count() == 24
    heads = edges.select("src").subtract(edges.select("dst"))
    assert {r[0] for r in gold.select("item_id").collect()} <= {r[0] for r in heads.collect()}
    assert [x.collect() for x in tables.revision_tasks(spark, 3, 4, seed=1)] == [x.collect() for x in (tasks, items, gold, edges)]
    with pytest.raises(ValueError):
        tables.revision_tasks(spark, 0, 1)


def test_scattered_chains_lead_to_gold(spark):
    tasks, items, gold, edges = tables.scattered_tasks(spark, (1, 3), scatter=2, per_depth=2)
    assert items.where("task_id = 'scattered-3-0'").count() == 4 + 2 * 3 + 6
    out = {(r["task_id"], r["src"]): r["dst"] for r in edges.collect()}
    goal = {r["task_id"]: r["item_id"] for r in gold.collect()}
    for r in tasks.collect():
        at = f"{r['task_id']}-0"
        for _ in range(r["depth"]):
            at = out[r["task_id"], at]
        assert at == goal[r["task_id"]]
    with pytest.raises(ValueError):
        tables.scattered_tasks(spark, (1,), scatter=-1)


def test_null_share_is_the_cubic_at_the_last_point(spark):
    rng = np.random.default_rng(0)
    p = np.concatenate([rng.random(300), rng.random(100) / 100])
    got = inference.null_share(spark.createDataFrame([("f", i, float(x)) for i, x in enumerate(p)], "family string, id long, p double")).first()["pi0"]
    x = np.array(inference.LAMBDAS)
    y = np.array([(p > v).mean() / (1 - v) for v in x])
    cubic = np.polyfit(x, y, 3)
    assert ((np.polyval(cubic, x) - y) ** 2).sum() < len(x)  # so the spline is this cubic
    assert got == pytest.approx(min(1.0, float(np.polyval(cubic, x[-1]))))
    with pytest.raises(Exception, match="not positive"):
        inference.null_share(spark.createDataFrame([("f", 0, 0.01)], "family string, id long, p double")).collect()


def test_sample_sizes_are_those_of_the_driver(spark):
    for r in catalogue.queries()["sample_size_grid"](spark, SF).collect():
        assert r["n"] == stats.required_sample(r["p1"], r["p2"])
        assert r["least_effect"] == pytest.approx(stats.least_effect(r["p1"], 100), abs=1e-6)
        assert stats._Z.cdf(r["z_power"]) == pytest.approx(stats.two_proportion_power(r["p1"], r["p2"], 100), abs=1e-6)
    assert stats.required_sample(0.5, 0.6) == 388
    with pytest.raises(ValueError):
        stats.required_sample(0.5, 0.5)


def test_crossover_interval_is_that_of_resampled_rows(spark):
    cells = [("k", 1, 20, 100, 60, 100), ("k", 2, 45, 100, 50, 100), ("k", 3, 70, 100, 40, 100), ("k", 4, 0, 0, 4, 5), ("never", 1, 0, 50, 50, 50), ("always", 1, 50, 50, 0, 50)]
    got = {r["key"]: r for r in inference.crossover_interval(spark.createDataFrame(cells, "key string, x long, a long, na long, b long, nb long")).collect()}
    assert got["k"]["point"] == pytest.approx(2 + 0.05 / 0.35)
    assert (got["never"]["point"], got["never"]["low"], got["never"]["exists"]) == (None, None, 0.0)
    assert (got["always"]["point"], got["always"]["low"], got["always"]["exists"]) == (1.0, 1.0, 1.0)
    rng, seen = np.random.default_rng(5), []
    rows = [(x, np.repeat([1.0, 0.0], [a, na - a]), np.repeat([1.0, 0.0], [b, nb - b])) for _, x, a, na, b, nb in cells[:3]]
    for _ in range(3000):
        y = [rng.choice(a, len(a)).mean() - rng.choice(b, len(b)).mean() for _, a, b in rows]
        i = next((i for i, v in enumerate(y) if v > 0), None)
        if i is not None:
            seen.append(1.0 if i == 0 else rows[i - 1][0] - y[i - 1] / (y[i] - y[i - 1]))
    low, high = np.quantile(seen, [0.025, 0.975])
    assert got["k"]["low"] == pytest.approx(low, abs=0.06) and got["k"]["high"] == pytest.approx(high, abs=0.06)
    assert got["k"]["exists"] == pytest.approx(len(seen) / 3000, abs=0.01)


def test_chance_above_is_the_integral():
    x = (np.arange(20000) + 0.5) / 20000
    density = lambda a, b: np.exp((a - 1) * np.log(x) + (b - 1) * np.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / 20000
    pa, pb = density(30.5, 20.5), density(25.5, 25.5)
    assert stats.chance_above((30, 50), (25, 50)) == pytest.approx(float((pa * (np.cumsum(pb) - pb / 2)).sum()), abs=0.005)
