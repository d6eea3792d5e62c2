"""Text quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE bytes.  A passage is encoded by the square roots of its shares of byte-class
pairs (letters by case, digits, marks, white space, other) and of the document's repetition figures.  With encoding
h = tanh(E x), passage i gets attention a_i = softmax(w . (tanh(V h_i) * sigmoid(U h_i))), and the document the score
sigmoid(c . sum a_i h_i + d).  Only document labels are learned from; which passages matter is learned with them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from lodestrata.llm.common import bounded_sample, crc_mod, fitted, map_text, sigmoid, take_memory

PASSAGE = 512
HIDDEN, GATE = 16, 8
#: Labelled documents of each class that the fit sees, and the characters that those of a class may have together.
SAMPLE_PER_CLASS, SAMPLE_CHARS = 1500, 8_000_000
#: Score from which label 1 is predicted.
CUT = 0.3

# Byte classes; every byte not named falls into the last.
_CLASSES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", ".", ",;:", "!", "?", "#$%&*+=~^", "|", "\"'()[]{}-_", "/\\@<>`"]
_N = len(_CLASSES) + 2
_CLASS = np.full(256, _N - 1, np.int64)
for _k, _chars in enumerate(_CLASSES):
    _CLASS[[ord(c) for c in _chars]] = _k
_CLASS[128:] = _N - 2
WIDTH = _N * _N + 3


def passages(text: str | None) -> np.ndarray:
    """Features of each passage, at least one row."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    b = _CLASS[np.frombuffer(raw, np.uint8)] if raw else np.array([3])
    n = -(-len(b) // PASSAGE)
    pair = b[:-1] * _N + b[1:]
    bag = np.arange(len(pair)) // PASSAGE
    n = max(1, -(-len(pair) // PASSAGE))
    counts = np.bincount(bag * (_N * _N) + pair, minlength=n * _N * _N).reshape(n, -1)
    out = np.zeros((n, WIDTH))
    out[:, : _N * _N] = np.sqrt(counts / np.maximum(1, counts.sum(axis=1))[:, None])
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    sentences = [x for x in raw.split(b".") if x.strip()]
    out[:, -3] = len(set(words)) / np.sqrt(len(words)) / 10 if words else 0
    out[:, -2] = 1 - len(set(lines)) / len(lines) if lines else 0
    out[:, -1] = 1 - len(set(sentences)) / len(sentences) if sentences else 0
    return out


@dataclass
class Model:
    params: list[np.ndarray]  # E, e, V, U, w, c, d

    def forward(self, x: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        enc, enc0, gv, gu, w, c, d = self.params
        h = np.tanh(x @ enc + enc0)
        tv, su = np.tanh(h @ gv), sigmoid(h @ gu)
        g = (tv * su) @ w
        g = np.exp(g - np.repeat(np.maximum.reduceat(g, starts), sizes))
        a = g / np.repeat(np.add.reduceat(g, starts), sizes)
        bag = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return h, tv, su, a, bag, sigmoid(bag @ c + d[0])

    def score(self, texts: list) -> np.ndarray:
        x, starts, sizes = _bags(texts)
        return self.forward(x, starts, sizes)[-1]


def _bags(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = [passages(t) for t in texts]
    sizes = np.array([len(r) for r in rows])
    return np.concatenate(rows), np.cumsum(sizes) - sizes, sizes


def fit(texts: list[str], labels: list[int], epochs: int = 30, seed: int = 5) -> Model:
    """Adam steps on the logistic loss.  Without both labels the score is their share for every text."""
    rng = np.random.default_rng(seed)
    y = np.array(labels, float)
    params = [rng.normal(0, 0.3, (WIDTH, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, (HIDDEN, GATE)), rng.normal(0, 0.3, (HIDDEN, GATE)), rng.normal(0, 0.3, GATE), rng.normal(0, 0.3, HIDDEN), np.zeros(1)]
    model = Model(params)
    share = float(y.mean()) if len(y) else 0.5
    if len(y) == 0 or share in (0.0, 1.0):
        params[5][:] = 0
        params[6][0] = np.log((share + 1e-3) / (1 - share + 1e-3))
        return model
    bags = [passages(t) for t in texts]
    m1, m2, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(epochs):
        order, rate = rng.permutation(len(y)), 0.01 * (0.5 if epoch > epochs * 2 // 3 else 1)
        for i in range(0, len(order), 64):
            rows = order[i : i + 64]
            x = np.concatenate([bags[r] for r in rows])
            sizes = np.array([len(bags[r]) for r in rows])
            starts = np.cumsum(sizes) - sizes
            h, tv, su, a, bag, p = model.forward(x, starts, sizes)
            enc, enc0, gv, gu, w, c, d = params
            dz = (p - y[rows]) / len(rows)
            db = np.repeat(dz, sizes)[:, None] * c[None, :]  # by passage: of its bag
            da = (db * h).sum(axis=1)
            dg = a * (da - np.repeat(np.add.reduceat(a * da, starts), sizes))
            dt, ds = dg[:, None] * w * su * (1 - tv**2), dg[:, None] * w * tv * su * (1 - su)
            dh = a[:, None] * db + dt @ gv.T + ds @ gu.T
            dx = dh * (1 - h**2)
            grads = [x.T @ dx, dx.sum(axis=0), h.T @ dt, h.T @ ds, (tv * su).T @ dg, bag.T @ dz, np.array([dz.sum()])]
            step += 1
            for k, (p_, g_, a1, a2) in enumerate(zip(params, grads, m1, m2)):
                if k in (0, 5):
                    g_ = g_ + 1e-4 * p_
                a1 *= 0.9
                a1 += 0.1 * g_
                a2 *= 0.999
                a2 += 0.001 * g_ * g_
                p_ -= rate * (a1 / (1 - 0.9**step)) / (np.sqrt(a2 / (1 - 0.999**step)) + 1e-8)
    return model


def held_out(doc_id: Column) -> Column:
    """Rows that training never sees: crc32 of the id as text, modulo 5, is 0."""
    return crc_mod(doc_id, 5) == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = SAMPLE_PER_CLASS, chars: int = SAMPLE_CHARS) -> Model:
    """Fit on at most per_class labelled documents of each class, none of them held out, of at most ``chars`` characters.

    Null ids and labels, and labels but 0 and 1, are left out; null texts count as empty.  Without both labels every text
    gets the share of label 1, about one half without any.
    """
    return fitted(bounded_sample(docs, labels, id_col, text_col, label_col, per_class, chars, (0, 1), lambda k: ~held_out(k)), fit)


FIELDS = T.StructType([T.StructField("score", T.DoubleType(), False), T.StructField("predicted", T.IntegerType(), False)])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """id, score, predicted for every row.  Null and empty texts are a bag of one blank passage.  Rows that repeat and
    null ids stay as they are; an empty table gives no rows.  Other columns are ignored, whatever their names."""

    def make():
        take_memory("mil_quality")

        def step(texts: list) -> dict:
            s: list[float] = []
            for i in range(0, len(texts), 64):
                s += model.score(texts[i : i + 64]).tolist()
            return {"score": s, "predicted": [int(v >= cut) for v in s]}

        return step

    return map_text(docs, [id_col], text_col, make, FIELDS)
