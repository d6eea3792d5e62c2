"""The sparse expansion against vectors written out in plain Python."""

import math
import random
from collections import Counter

import pytest

from lodestrata.operators import lexical


def plain(docs, asked):
    words = {d: Counter(t.split()) for d, t in docs}
    df = Counter(w for c in words.values() for w in c)
    cooc = {}
    for c in words.values():
        for a in c:
            cooc.setdefault(a, Counter()).update(b for b in c if b != a)

    def vector(counts):
        out, more = {w: math.log1p(n) for w, n in counts.items()}, Counter()
        for w in counts:
            for u, n in cooc.get(w, {}).items():
                if u not in counts:
                    more[u] += 0.5 * out[w] * n / df[w]
        return out | more

    wide = {d: vector(c) for d, c in words.items()}
    return {(q, d): sum(x * v.get(w, 0) for w, x in vector(Counter(t.split())).items()) for q, t in asked for d, v in wide.items()}


@pytest.mark.parametrize("seed", [None, 1, 2])
def test_documents_are_widened_too(spark, seed):
    docs, asked = [(1, "audit log export"), (2, "audit log review"), (3, "export report")], [(1, "audit")]
    if seed is not None:
        rng = random.Random(seed)
        text = lambda n: " ".join(f"w{int(rng.random() ** 2 * 40)}" for _ in range(n))
        docs, asked = [(i, text(rng.randint(1, 15))) for i in range(30)], [(i, text(rng.randint(1, 5))) for i in range(6)]
    want = {k: x for k, x in plain(docs, asked).items() if x}
    got = {(r["qid"], r["doc"]): r["score"] for r in lexical.sparse_expansion(spark.createDataFrame(docs, "doc long, text string"), spark.createDataFrame(asked, "qid long, text string")).collect()}
    assert got == {k: pytest.approx(x, abs=1e-6) for k, x in want.items()}
    if seed is None:
        assert got[1, 1] == pytest.approx(1.875 * math.log(2) ** 2, abs=1e-6)  # worked out by hand in the reference's test
