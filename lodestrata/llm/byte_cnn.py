"""Language identification by a byte convolutional network trained in numpy.

Bytes are embedded, filters of widths 2, 3 and 4 slide over windows of WINDOW bytes, each filter keeps its largest
response, and a softmax layer gives the languages.  A text is cut into windows to its end; its languages' shares are
the mean over windows, weighted by the letters in them.  For prediction the embedding and all filters are folded into two
tables by byte pair, so that a position costs two look-ups.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.llm.common import bounded_sample, crc_mod, fitted, map_text, take_memory, where_text

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
DEPTH = 8
#: Documents of each language that the fit sees, whole, and the characters that they may have together.
SAMPLE_PER_CLASS, SAMPLE_CHARS = 250, 1_000_000
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")
_IS_LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])


def windows_of(text: bytes, window: int = WINDOW) -> np.ndarray:
    """Rows of window bytes, the last one filled up with 0."""
    n = max(1, -(-len(text) // window))
    out = np.zeros(n * window, np.uint8)
    out[: len(text)] = np.frombuffer(text, np.uint8)
    return out.reshape(n, window)


@dataclass
class Model:
    languages: list[str]
    embed: np.ndarray  # 256, DEPTH
    kernels: list[np.ndarray]  # width, DEPTH, FILTERS
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Responses of all filters to the byte pairs at offsets 0 and 2 of a position; indexed first + 256 * second."""
        one = np.zeros((4, 256, len(WIDTHS) * FILTERS), np.float32)
        for k, (w, kernel) in enumerate(zip(WIDTHS, self.kernels)):
            for j in range(w):
                one[j, :, k * FILTERS : (k + 1) * FILTERS] = self.embed @ kernel[j]
        pair = lambda a, b: (one[b][:, None, :] + one[a][None, :, :]).reshape(65536, -1)
        return pair(0, 1), pair(2, 3)

    def predictor(self):
        """Texts to (language, share)."""
        first, second = self.tables()

        def shares(wins: np.ndarray) -> np.ndarray:
            out = np.empty((len(wins), len(self.languages)))
            for i in range(0, len(wins), 128):
                w = np.pad(wins[i : i + 128], ((0, 0), (0, 3))).astype(np.uint16)
                pairs = w[:, :-1] | (w[:, 1:] << np.uint16(8))
                top = (first[pairs[:, :-2]] + second[pairs[:, 2:]]).max(axis=1) + self.bias
                z = np.maximum(top, 0) @ self.out + self.out_bias
                e = np.exp(z - z.max(axis=1, keepdims=True))
                out[i : i + 128] = e / e.sum(axis=1, keepdims=True)
            return out

        def predict(texts: list) -> list[tuple[str, float]]:
            cut = [windows_of((t or "").encode("utf-8", "surrogatepass")) for t in texts]
            every = np.concatenate(cut) if cut else np.zeros((0, WINDOW), np.uint8)
            p = shares(every) * (1e-9 + _IS_LETTER[every].sum(axis=1))[:, None]
            ends = np.cumsum([len(c) for c in cut])
            got = []
            for t, a, b in zip(texts, [0, *ends[:-1]], ends):
                if not t or not _LETTER.search(t) or not self.languages:
                    got.append((UNKNOWN, 0.0))
                    continue
                s = p[a:b].sum(axis=0)
                k = int(np.argmax(s))
                got.append((self.languages[k], float(min(1.0, s[k] / s.sum()))))
            return got

        return predict


def fit(texts: list[str], languages: list[str], epochs: int = 6, seed: int = 3) -> Model:
    """Train on all windows of the texts that have a letter, by Adam steps on the cross entropy; windows without a letter
    say nothing and are left out.  A language weighs as much as any other, and a long text more than a short one, by the root of its length."""
    both = [(t, x) for t, x in zip(texts, languages) if t and _LETTER.search(t)]
    texts, languages = [t for t, _ in both], [x for _, x in both]
    names = sorted(set(languages))
    rng = np.random.default_rng(seed)
    n_out, n_feat = len(names), len(WIDTHS) * FILTERS
    embed = rng.normal(0, 0.5, (256, DEPTH))
    kernels = [rng.normal(0, 1 / np.sqrt(w * DEPTH), (w, DEPTH, FILTERS)) for w in WIDTHS]
    bias, out, out_bias = np.zeros(n_feat), rng.normal(0, 0.2, (n_feat, n_out)), np.zeros(n_out)
    if n_out < 2:
        return Model(names, embed, kernels, bias, out, out_bias)
    xs, ys, shares = [], [], []
    for t, lang in zip(texts, languages):
        w = windows_of(t.encode("utf-8", "surrogatepass"))
        w = w[_IS_LETTER[w].any(axis=1)]
        xs.append(w)
        ys += [names.index(lang)] * len(w)
        shares += [1.0 / max(1, len(w)) ** 0.5] * len(w)
    x, y, share = np.concatenate(xs), np.array(ys), np.array(shares)
    weight = share / np.maximum(1e-12, np.bincount(y, share, n_out))[y]
    weight /= weight.mean()
    params = [embed, *kernels, bias, out, out_bias]
    m1, m2, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for a in range(0, len(order), 64):
            rows = order[a : a + 64]
            xb, yb = x[rows], y[rows]
            e = embed[xb]
            tops, at = [], []
            for k, w in enumerate(WIDTHS):
                r = sum(e[:, j : WINDOW - w + 1 + j] @ kernels[k][j] for j in range(w))
                at.append(r.argmax(axis=1))
                tops.append(np.take_along_axis(r, at[-1][:, None, :], 1)[:, 0])
            h = np.concatenate(tops, axis=1) + bias
            hp = np.maximum(h, 0)
            z = hp @ out + out_bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(yb)), yb] -= 1
            dz = p * weight[rows][:, None] / len(yb)
            grads_out, grads_ob = hp.T @ dz, dz.sum(axis=0)
            dh = (dz @ out.T) * (h > 0)
            g_embed, g_kernels = np.zeros_like(embed), []
            for k, w in enumerate(WIDTHS):
                d = dh[:, k * FILTERS : (k + 1) * FILTERS]
                g = np.zeros_like(kernels[k])
                for j in range(w):
                    b = np.take_along_axis(xb, at[k] + j, 1)  # byte under tap j, by row and filter
                    g[j] = np.einsum("rfd,rf->df", embed[b], d)
                    np.add.at(g_embed, b.reshape(-1), (kernels[k][j].T[None] * d[:, :, None]).reshape(-1, DEPTH))
                g_kernels.append(g)
            step += 1
            for p_, g_, a1, a2 in zip(params, [g_embed, *g_kernels, dh.sum(axis=0), grads_out, grads_ob], m1, m2):
                a1 *= 0.9
                a1 += 0.1 * g_
                a2 *= 0.999
                a2 += 0.001 * g_ * g_
                p_ -= 0.01 * (a1 / (1 - 0.9**step)) / (np.sqrt(a2 / (1 - 0.999**step)) + 1e-8)
    return Model(names, embed, kernels, bias, out, out_bias)


def may_learn(doc_id: Column) -> Column:
    """Rows that training may see: crc32 of the id as text, modulo 4, is not 2."""
    return crc_mod(doc_id, 4) != 2


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_class: int = SAMPLE_PER_CLASS, where=may_learn, chars: int = SAMPLE_CHARS) -> Model:
    """Fit on at most per_class documents of each language, of at most ``chars`` characters together.

    Rows without id or language and texts without a letter teach nothing.  With one language every text with a letter is
    in it; with none every text is und.
    """
    return fitted(bounded_sample(docs, docs, id_col, text_col, lang_col, per_class, chars, where=where), fit)


FIELDS = T.StructType([T.StructField("lang_pred", T.StringType(), False), T.StructField("score", T.DoubleType(), False)])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score for every row; und and 0 where the text is null, empty or has no letter.

    Rows that repeat and null ids stay as they are; an empty table gives no rows.  Other columns are ignored.
    """

    def make():
        take_memory("byte_cnn")
        predict = model.predictor()

        def step(texts: list) -> dict:
            got = predict(texts)
            return {"lang_pred": [g for g, _ in got], "score": [s for _, s in got]}

        return step

    return map_text(docs, [id_col], text_col, make, FIELDS)


def identified_only(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.3) -> DataFrame:
    """The rows of docs, with all their columns, that have a language with a share of at least ``least``.

    Null and empty texts and those without a letter go.  Each row is judged by its own text, so rows that repeat stay or
    go together; an empty table gives no rows.  Other columns may have any name and type; they don't go to Python.
    """

    def make():
        take_memory("byte_cnn")
        predict = model.predictor()
        return lambda texts: [g != UNKNOWN and s >= least for g, s in predict(texts)]

    return where_text(docs, text_col, make)
