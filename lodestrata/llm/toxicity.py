"""Toxicity as severity grades, by cumulative-link ordinal regression on sparse text features.

Features are the words of a text, their beginnings and their endings, named by 63-bit hashes (so that in practice no
two share one).  Each can give two columns: whether the text has it, and the density of its hits (a family of words that
clean texts use now and then tells by how much of the text it makes up).  One weight vector w serves all thresholds:
P(grade > k) = sigmoid(w . x - t_k) with t_0 <= t_1 <= ...; the expected severity is the sum of these probabilities.
How sure a column must be to enter, and the L1 penalty on the weights, are chosen by the loss on folds left out.

The labels are binary.  Grade 0 is label 0.  Label 1 is split into GRADES - 1 grades of equal size by the score that a
model gives a text which has not seen it, so grades never come from the fit that learns them.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodestrata.llm.common import bounded_sample, fitted, map_text, sigmoid, take_memory, where_text

#: Labelled documents of each class that the fit sees, and the characters that those of a class may have together.
SAMPLE_PER_CLASS, SAMPLE_CHARS = 2500, 20_000_000
GRADES = 4
#: Features of a word; texts of the sample that a feature must be in to be looked at.
PARTS, LEAST_TEXTS = 5, 3
#: What is tried: standard errors by which a column must be higher under label 1, and L1 penalties; folds left out in turn.
SURE, L1, FOLDS = (3.0, 4.5, 6.0), (1e-4, 1e-3), 3
#: Density is SCALE * hits / (words + PRIOR_WORDS) ** POWER: a single hit in a few words is no high one, and hits in a
#: long text count for more than their share.
SCALE, PRIOR_WORDS, POWER = 22.0, 20, 0.75
#: Expected severity from which a document is rejected.
REJECT = 0.5
MEMORY_WORDS = 200_000

_WORD = re.compile(r"\w+")


def word_features(word: str) -> list[int]:
    """Columns of a word: itself, beginnings of 4, 5 and 6 characters, endings of 5."""
    import xxhash

    parts = ["=" + word] + ["<" + word[:n] for n in (4, 5, 6) if len(word) > n] + [">" + word[-5:]] * (len(word) > 5)
    return [xxhash.xxh3_64_intdigest(p) >> 1 for p in parts]


def density(hits, words):
    """How much of a text of so many words the hits make up."""
    return SCALE * hits / (words + PRIOR_WORDS) ** POWER


@dataclass
class Model:
    columns: np.ndarray  # rising features that the fit knows
    weights: np.ndarray  # of each: for being there, and for the density of its hits
    thresholds: np.ndarray

    def scorer(self):
        """Texts to (score, expected severity, grade)."""
        weight = dict(zip(self.columns.tolist(), map(tuple, self.weights.tolist())))
        known: dict[str, tuple] = {}

        def carried(w: str) -> tuple:
            if len(known) > MEMORY_WORDS:
                known.clear()
            known[w] = got = tuple(f for f in word_features(w) if f in weight)
            return got

        def score(text: str | None) -> tuple[float, float, int]:
            words = _WORD.findall((text or "").lower())
            hits: Counter[int] = Counter()
            for w in words:
                f = known.get(w)
                if f is None:
                    f = carried(w)
                if f:
                    hits.update(f)
            s = sum(weight[f][0] + weight[f][1] * density(hits[f], len(words)) for f in sorted(hits))
            above = sigmoid(s - self.thresholds)
            return s, float(above.sum()), int((above > 0.5).sum())

        return score


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, grades: np.ndarray, n_cols: int, n_grades: int, l1: float = 1e-4, steps: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Weights and rising thresholds of the cumulative-link model for sparse features (rows, cols, values), by Adam steps each
    followed by soft thresholding; no weight is below 0, so a feature never lowers the severity.  Grade 0 weighs as much as all others, which weigh the same among themselves."""
    n = len(grades)
    count = np.bincount(grades, minlength=n_grades)
    others = max(1, int((count[1:] > 0).sum()))
    share = np.array([0.5] + [0.5 / others] * (n_grades - 1))
    weight = (share / np.maximum(count, 1))[grades]
    target = (grades[:, None] > np.arange(n_grades - 1)[None, :]).astype(float)
    params = [np.zeros(n_cols), np.array([1.0] + [0.5] * (n_grades - 2))]  # weights; first threshold and the gaps
    m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        rate = 0.1 if step <= steps // 2 else 0.03
        w, gaps = params
        s = np.bincount(rows, w[cols] * values, n)
        error = (sigmoid(s[:, None] - np.cumsum(gaps)[None, :]) - target) * weight[:, None]
        grads = [np.bincount(cols, error.sum(axis=1)[rows] * values, n_cols), -np.cumsum(error.sum(axis=0)[::-1])[::-1]]
        for p, g, a1, a2 in zip(params, grads, m1, m2):
            a1 *= 0.9
            a1 += 0.1 * g
            a2 *= 0.999
            a2 += 0.001 * g * g
            scale = rate / (np.sqrt(a2 / (1 - 0.999**step)) + 1e-6)
            p -= scale * a1 / (1 - 0.9**step)
            if p is w:
                p[:] = np.maximum(p - np.minimum(scale, 50.0) * l1, 0.0)
        gaps[1:] = np.maximum(gaps[1:], 0.0)
    return params[0], np.cumsum(params[1])


def new_places(ids: list[np.ndarray], run: int = 5) -> tuple[list[np.ndarray], np.ndarray]:
    """Of each text (its words by number) the places in runs of five that no earlier text has, and a fold by its least run.
    Copies and passages that texts share would else pass their chance words for evidence, or learn of the fold left out."""
    hashes = []
    for x in ids:
        at = [x[j : len(x) - min(run, len(x)) + 1 + j] for j in range(min(run, len(x)))]
        h = np.full(max(1, len(x) - run + 1), len(at), np.uint64)
        for part in at:
            h = (h ^ part.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        hashes.append(h)
    fold = np.array([int(h.min() >> np.uint64(7)) % FOLDS for h in hashes])
    sizes = np.array(list(map(len, hashes)))
    text = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
    flat = np.concatenate(hashes)
    del hashes
    order = np.argsort(flat, kind="stable")
    first = np.empty(len(flat), bool)
    sorted_ = flat[order]
    lead = np.concatenate([[True], sorted_[1:] != sorted_[:-1]])
    owner = text[order][lead][np.cumsum(lead) - 1]  # the earliest text that has the run
    first[order] = owner == text[order]
    out = []
    for x, n in zip(ids, np.split(first, np.cumsum(sizes)[:-1])):
        got = np.zeros(len(x), bool)
        for j in range(min(run, len(x))):
            got[j : j + len(n)] |= n
        out.append(got)
    return out, fold


def _counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Names of the features that at least LEAST_TEXTS texts have; rows, columns, hits and hits in new places of the texts
    that have them; words of each text; and a fold of each, which near copies mostly share."""
    number: dict[str, int] = {}
    ids = [np.array([number.setdefault(w, len(number)) for w in _WORD.findall((t or "").lower())], np.int32) for t in texts]
    table = np.full((len(number), PARTS), -1, np.int64)
    for k, w in enumerate(number):
        f = word_features(w)
        table[k, : len(f)] = f
    del number
    names, features = np.unique(table, return_inverse=True)
    del table
    short = int((names < 0).any())
    names, features = names[short:], features.reshape(-1, PARTS).astype(np.int32) - short
    rows, cols, hits, fresh_hits = [], [], [], []
    places, fold = new_places(ids)
    for i, (x, new) in enumerate(zip(ids, places)):
        got = features[x].ravel()
        f, at = np.unique(got[got >= 0], return_inverse=True)
        rows.append(np.full(len(f), i, np.int32))
        cols.append(f)
        hits.append(np.bincount(at, minlength=len(f)).astype(np.int32))
        fresh_hits.append(np.bincount(at, np.repeat(new, PARTS)[got >= 0], len(f)).astype(np.int32))
    row, col, hit, new_hit = (np.concatenate([np.zeros(0, np.int32), *x]) for x in (rows, cols, hits, fresh_hits))
    often = np.bincount(col, minlength=len(names)) >= LEAST_TEXTS
    kept = often[col]
    column = (np.cumsum(often) - 1).astype(np.int32)
    return names[often], row[kept], column[col[kept]], hit[kept], new_hit[kept], np.array(list(map(len, ids))), fold


@dataclass
class _Sample:
    """Sparse counts of the sample; learned() fits on some of its rows."""

    names: np.ndarray
    row: np.ndarray
    col: np.ndarray
    hit: np.ndarray
    new_hit: np.ndarray
    words: np.ndarray
    toxic: np.ndarray

    def screened(self, use: np.ndarray, sure: float) -> np.ndarray:
        """(feature, what) pairs, what 0 for being there and 1 for the density, that stand out under label 1 in the rows used."""
        y = self.toxic
        n1, n0 = int((use & (y == 1)).sum()), int((use & (y == 0)).sum())
        seen = use[self.row] & (self.new_hit > 0)
        row, col = self.row[seen], self.col[seen]
        label, n = y[row], n0 + n1
        chosen = []
        for what, v in enumerate((np.ones(len(row)), density(self.new_hit[seen], self.words[row]))):
            top, bottom = np.bincount(col, v * label, len(self.names)), np.bincount(col, v * (1 - label), len(self.names))
            mean = (top + bottom) / n
            deviation = np.sqrt(np.maximum(np.bincount(col, v * v, len(self.names)) / n - mean * mean, 1e-12) * (1 / n1 + 1 / n0))
            z = (top / n1 - bottom / n0) / deviation
            f = np.flatnonzero(z >= sure)
            chosen.append(np.stack([f, np.full(len(f), what)], axis=1))
        return np.concatenate(chosen)

    def matrix(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, columns (places in pairs) and values of the whole sample."""
        rows, cols, values = [], [], []
        for what in (0, 1):
            place = np.full(len(self.names), -1)
            own = np.flatnonzero(pairs[:, 1] == what)
            place[pairs[own, 0]] = own
            got = place[self.col] >= 0
            rows.append(self.row[got])
            cols.append(place[self.col[got]])
            values.append(density(self.hit[got], self.words[self.row[got]]) if what else np.ones(int(got.sum())))
        return np.concatenate(rows), np.concatenate(cols), np.concatenate(values)

    def learned(self, use: np.ndarray, grades: np.ndarray, n_grades: int, sure: float, l1: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Pairs, weights, thresholds, and the scores of all rows, for a fit on the rows used."""
        pairs = self.screened(use, sure)
        rows, cols, values = self.matrix(pairs)
        own = use[rows]
        at = np.cumsum(use) - 1
        w, t = fit_ordinal(at[rows[own]], cols[own], values[own], grades[use], len(pairs), n_grades, l1)
        return pairs, w, t, np.bincount(rows, w[cols] * values, len(use))


def _loss(score: np.ndarray, threshold: np.ndarray, y: np.ndarray) -> float:
    """Logistic loss with both labels weighing the same."""
    z = np.clip(np.where(y == 1, score - threshold, threshold - score), -40, 40)
    each = np.log1p(np.exp(-z))
    return float(each[y == 1].mean() + each[y == 0].mean())


def fit(texts: list[str], toxic: list[int]) -> Model:
    """A model from labelled texts; without both labels it finds nothing toxic."""
    y = np.array(toxic, np.int64)
    none = Model(np.zeros(0, np.int64), np.zeros((0, 2)), np.linspace(3, 5, GRADES - 1))
    if min((y == 1).sum(), (y == 0).sum()) < 1:
        return none
    *counts, fold = _counts(texts)
    sample = _Sample(*counts, y)
    everything = np.full(len(y), True)
    best, scores = None, np.zeros(len(y))
    for sure in SURE:
        for l1 in L1:
            out, cut = np.zeros(len(y)), np.full(len(y), 3.0)
            for k in range(FOLDS):
                use = fold != k
                if use.all() or min((use & (y == 1)).sum(), (use & (y == 0)).sum()) < 1:
                    continue
                _, _, t, s = sample.learned(use, y, 2, sure, l1)
                out[~use], cut[~use] = s[~use], t[0]
            loss = _loss(out, cut, y)
            if best is None or loss < best[0] - 1e-9:
                best, scores = (loss, sure, l1), out - cut
    grades = np.zeros(len(y), np.int64)
    n1 = int((y == 1).sum())
    rank = np.empty(n1, np.int64)
    rank[np.lexsort((np.arange(n1), scores[y == 1]))] = np.arange(n1)
    grades[y == 1] = 1 + rank * (GRADES - 1) // n1
    pairs, w, t, _ = sample.learned(everything, grades, GRADES, best[1], best[2])
    if not (w > 0).any():
        return none
    chosen = np.unique(pairs[w > 0, 0])
    weights = np.zeros((len(chosen), 2))
    kept = w > 0
    weights[np.searchsorted(chosen, pairs[kept, 0]), pairs[kept, 1]] = w[kept]
    return Model(sample.names[chosen], weights, t)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = SAMPLE_PER_CLASS, chars: int = SAMPLE_CHARS) -> Model:
    """Fit on at most per_class labelled documents of each class, of at most ``chars`` characters together.

    Null ids and labels, and labels but 0 and 1, are left out; null texts count as empty.  Without both labels, or
    without any telling word, the model finds nothing toxic.
    """
    return fitted(bounded_sample(docs, labels, id_col, text_col, label_col, per_class, chars, (0, 1)), fit)


FIELDS = T.StructType([T.StructField("severity", T.DoubleType(), False), T.StructField("grade", T.IntegerType(), False), T.StructField("toxic", T.BooleanType(), False)])


def grade(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", reject: float = REJECT) -> DataFrame:
    """id, severity (expected grade), grade, toxic for every row.

    Null and empty texts have no feature, hence the severity that the thresholds alone give, which is low.  Rows that
    repeat and null ids stay as they are; an empty table gives no rows.  Other columns are ignored.
    """

    def make():
        take_memory("toxicity")
        score = model.scorer()

        def step(texts: list) -> dict:
            got = [score(t) for t in texts]
            return {"severity": [s for _, s, _ in got], "grade": [g for _, _, g in got], "toxic": [s >= reject for _, s, _ in got]}

        return step

    return map_text(docs, [id_col], text_col, make, FIELDS)


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text", reject: float = REJECT) -> DataFrame:
    """The rows of docs, with all their columns, whose expected severity is below reject.

    Null and empty texts stay.  Each row is judged by its own text, so rows that repeat stay or go together; an empty
    table gives no rows.  Other columns may have any name and type; they don't go to Python.
    """

    def make():
        take_memory("toxicity")
        score = model.scorer()
        return lambda texts: [score(t)[1] < reject for t in texts]

    return where_text(docs, text_col, make)
