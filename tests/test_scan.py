"""Rankings in which each task keeps a query's best, against the same rankings by joins."""

import random

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import lexical


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)] + ["İx", "Kelvin", "é1"]
    line = lambda n: " ".join(rng.choice(words) if rng.random() < 0.7 else rng.choice(words[:5]) for _ in range(n))
    docs = [(i, rng.choice(["", line(3) + "\n"]) + line(rng.randint(0, 60))) for i in range(150)]
    docs += [(200 + i, docs[7][1]) for i in range(20)] + [(300, None), (301, ""), (302, "\n")]  # copies, empty ones
    asked = [(i, line(rng.randint(1, 12))) for i in range(25)] + [(50, ""), (51, None), (52, "nowhere"), (53, "w1 w1 w1 nowhere")]
    return spark.createDataFrame(docs, "doc long, text string").repartition(3), spark.createDataFrame(asked, "qid long, text string")


def ranked(scores, k=6):
    return sorted((r["qid"], r["rank"], r["doc"], round(r["score"], 8)) for r in lexical.best(scores, k).collect())


RANKERS = {
    "plus": lambda ix: lexical.with_the_rest(ix, lexical.bm25_plus(ix, k=6), 6),
    "no delta": lambda ix: lexical.with_the_rest(ix, lexical.bm25_plus(ix, delta=0.0, k=6), 6),
    "okapi": lambda ix: lexical.with_the_rest(ix, lexical.bm25_okapi(ix, ix.df.select("term", "df"), k=6), 6),
    "dirichlet": lambda ix: lexical.qlm_dirichlet(ix, 6, 20.0),
    "jm": lambda ix: lexical.qlm_jm(ix, 6, 0.4),
}


@pytest.mark.parametrize("name", RANKERS)
def test_tasks_that_keep_the_best_rank_as_joins_do(spark, texts, name, monkeypatch):
    ix = lexical.index(*texts)
    got = kept = lexical.kept(RANKERS[name](ix))
    assert kept.count() <= 29 * 6 * 4  # and not every pair of a query and a document that share a word
    got = ranked(got)
    monkeypatch.setattr(lexical, "BROADCAST_WORDS", 0)
    other = lexical.index(*texts)
    assert other.vocabulary is None and (other.n, other.total) == (ix.n, ix.total)
    assert ranked(RANKERS[name](other)) == got


def test_fields_in_one_pass_rank_as_joins_do(spark, texts, monkeypatch):
    ix, fields, plus = lexical.bm25f(*texts, 6)
    got = [ranked(lexical.with_the_rest(ix, x, 6)) for x in (fields, plus)]
    assert fields.count() <= 29 * 6 * 4
    monkeypatch.setattr(lexical, "BROADCAST_WORDS", 0)
    ix, fields, plus = lexical.bm25f(*texts, 6)
    assert [ranked(lexical.with_the_rest(ix, x, 6)) for x in (fields, plus)] == got


def test_cells_are_scored_in_stretches(spark, texts, monkeypatch):
    from lodestrata.operators import scan

    whole = ranked(lexical.bm25_plus(lexical.index(*texts), k=6))
    monkeypatch.setattr(scan, "ROWS", 3)  # read where the pass is planned
    monkeypatch.setattr(scan, "CELLS", 60)
    assert ranked(lexical.bm25_plus(lexical.index(*texts), k=6)) == whole


def test_late_interaction_leaves_a_task_as_the_best_only(spark, texts, monkeypatch):
    import numpy as np

    from lodestrata.operators import vector

    docs, asked = texts
    monkeypatch.setattr(vector, "HELD_CELLS", 400)  # room for few rows, and many stretches
    top = lexical.kept(vector.word_maxsim(asked, docs, k=6))
    assert top.count() <= 29 * 6 * 4
    every = vector.word_maxsim(asked, docs)
    assert ranked(top) == ranked(every)
    words = lambda t: [w for w in "".join(c if c.isascii() and (c.isalnum() or c == "_") else " " for c in (t or "").lower()).split()]
    text, query = {r["doc"]: r["text"] for r in docs.collect()}, {r["qid"]: r["text"] for r in asked.collect()}
    for r in every.where("doc in (3, 7, 201) and qid in (0, 5, 52)").collect():
        q, d = (np.array([vector.word_vector(w) for w in words(x)]) for x in (query[r["qid"]], text[r["doc"]]))
        assert r["score"] == pytest.approx(vector.maxsim_score(q, d))
