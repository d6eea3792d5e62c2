"""Vector ranking: blocked exact search, greedy diversification, cluster trees, hashed embeddings."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions import text as tx
from lodestrata.operators import scan
from lodestrata.operators.lineage import kept

BLOCK = 4096
#: Words of a query set that late interaction holds at once.
QUERY_WORDS = 1_000_000
#: Cosines of a document's word with a query set's word that a worker remembers.
HELD_CELLS = 16_000_000


def unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def blocks(vectors: DataFrame) -> DataFrame:
    """(ids, dim, data): vectors (id, v) in blocks of at most BLOCK rows, as binary."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for a in range(0, len(f), BLOCK):
                m = np.array(f["v"].iloc[a : a + BLOCK].tolist(), np.float64)
                yield pd.DataFrame({"ids": [f["id"].iloc[a : a + BLOCK].to_numpy()], "dim": [m.shape[1]], "data": [m.tobytes()]})

    return vectors.mapInPandas(run, "ids array<long>, dim int, data binary")


def top_k(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """(qid, doc, score, rank): exact best k by cosine for vectors (id, v).

    Both sides are packed into blocks; each pair of blocks gives k rows a query, so what is shuffled is the number
    of corpus blocks times k by query, not all pairs.
    """
    q = blocks(queries).select(F.col("ids").alias("qids"), F.col("dim").alias("qdim"), F.col("data").alias("qdata"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples(index=False):
                a = unit(np.frombuffer(r.qdata).reshape(-1, r.qdim))
                b = unit(np.frombuffer(r.data).reshape(-1, r.dim))
                s, ids = np.round(a @ b.T, 12), np.asarray(r.ids)
                order = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :k]
                yield pd.DataFrame({"qid": np.repeat(np.asarray(r.qids), order.shape[1]), "doc": ids[order].reshape(-1), "score": np.take_along_axis(s, order, 1).reshape(-1)})

    best = blocks(corpus).crossJoin(q).mapInPandas(run, "qid long, doc long, score double")
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), "doc")
    return best.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def mmr_order(relevance: np.ndarray, similarity: np.ndarray, lam: float = 0.5, k: int | None = None) -> list[int]:
    """Greedy argmax of lam * relevance - (1 - lam) * largest similarity to what is chosen; the first maximum wins."""
    if not 0 <= lam <= 1 or similarity.shape != (len(relevance), len(relevance)):
        raise ValueError("lam must lie in [0, 1] and similarity must be square")
    chosen, worst = [], np.zeros(len(relevance))
    open_ = np.ones(len(relevance), bool)
    while open_.any() and (k is None or len(chosen) < k):
        gain = np.where(open_, lam * relevance - (1 - lam) * worst, -np.inf)
        i = int(np.argmax(gain))
        worst = similarity[i].copy() if not chosen else np.maximum(worst, similarity[i])
        chosen.append(i)
        open_[i] = False
    return chosen


def mmr(top: DataFrame, vectors: DataFrame, lam: float = 0.5) -> DataFrame:
    """Diversified order of each query's candidates (qid, doc, score): groups are as large as the candidate list."""

    def order(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["rank"]).reset_index(drop=True)
        m = unit(np.array(f["v"].tolist(), np.float64))
        got = mmr_order(f["score"].to_numpy(), m @ m.T, lam)
        return pd.DataFrame({"qid": f["qid"], "doc": f["doc"].to_numpy()[got], "rank": np.arange(1, len(got) + 1)})

    return top.join(vectors, top["doc"] == vectors["id"]).select("qid", "doc", "rank", "score", "v").groupBy("qid").applyInPandas(order, "qid long, doc long, rank long")


def average_linkage(m: np.ndarray, k: int) -> np.ndarray:
    """Labels of k clusters by average cosine linkage."""
    n = len(m)
    if n < 2 or k <= 1:
        return np.zeros(n, int)
    u = unit(m)
    d = 1 - u @ u.T
    np.fill_diagonal(d, np.inf)
    size, alive, label = np.ones(n), np.ones(n, bool), np.arange(n)
    for _ in range(n - k):
        i, j = divmod(int(np.argmin(d)), n)
        i, j = min(i, j), max(i, j)
        d[i] = d[:, i] = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i, i] = np.inf
        d[j] = d[:, j] = np.inf
        size[i] += size[j]
        alive[j] = False
        label[label == j] = i
    return np.unique(label, return_inverse=True)[1]


def cluster_tree(top: DataFrame, vectors: DataFrame) -> DataFrame:
    """Candidates (qid, doc, score) and the centroids of their sqrt(n) clusters ranked together; a centroid brings its
    members that are not yet out, by their own score."""
    query = vectors.select(F.col("id").alias("qid"), F.col("v").alias("qv"))

    def order(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("rank").reset_index(drop=True)
        m, s = np.array(f["v"].tolist(), np.float64), f["score"].to_numpy()
        label = average_linkage(m, round(len(m) ** 0.5))
        centres = unit(np.array([m[label == c].mean(axis=0) for c in range(label.max() + 1)]))
        cs = centres @ unit(np.array([f["qv"].iloc[0]], np.float64))[0]
        pool = [(-s[i], 0, i) for i in range(len(m))] + [(-cs[c], 1, c) for c in range(len(cs))]
        out: list[int] = []
        for _, kind, i in sorted(pool):
            out += [j for j in ([i] if kind == 0 else sorted(np.flatnonzero(label == i), key=lambda j: -s[j])) if j not in out]
        return pd.DataFrame({"qid": f["qid"], "doc": f["doc"].to_numpy()[out], "rank": np.arange(1, len(out) + 1)})

    joined = top.join(vectors, top["doc"] == vectors["id"]).join(query, "qid").select("qid", "doc", "rank", "score", "v", "qv")
    return joined.groupBy("qid").applyInPandas(order, "qid long, doc long, rank long")


def word_vector(word: str, dim: int = 256) -> np.ndarray:
    """Signed counts of a word and its character 3- to 5-grams, hashed to dim places."""
    out = np.zeros(dim)
    padded = f"#{word}#"
    for f in [word, *(padded[i : i + n] for n in (3, 4, 5) for i in range(len(padded) - n + 1))]:
        h, sign = _digests[f]
        out[h % dim] += sign
    return out


class _Digests(dict):
    """A number and a sign of each piece of a word that a worker has met."""

    def __missing__(self, piece: str) -> tuple[int, int]:
        if len(self) >= MEMORY_PIECES:
            self.clear()
        h = hashlib.blake2b(piece.encode(), digest_size=9).digest()
        self[piece] = out = int.from_bytes(h[:8], "big"), 1 if h[8] & 1 else -1
        return out


#: Pieces of words whose digests a worker remembers (about 250 bytes each).
MEMORY_PIECES = 200_000
_digests = _Digests()


class _Words(dict):
    """Vectors of the words met so far by a worker, in float32 (their entries are small integers, so nothing is lost)."""

    def __init__(self, dim: int):
        self.dim = dim

    def __missing__(self, word: str) -> np.ndarray:
        if len(self) >= MEMORY_WORDS:
            self.clear()
        self[word] = v = word_vector(word, self.dim).astype(np.float32)
        return v


#: Word vectors that a worker remembers (1 kB each at 256 places).
MEMORY_WORDS = 100_000
_known: dict[int, _Words] = {}
_WORD = re.compile("[a-zA-Z0-9_]+")


def _words(dim: int) -> _Words:
    return _known.setdefault(dim, _Words(dim))


def hashed(text: str | None, dim: int = 256) -> np.ndarray:
    """The sum of a text's word vectors, of length 1; zeros without words."""
    out, known = np.zeros(dim), _words(dim)
    for w, n in Counter(_WORD.findall((text or "").lower())).items():
        out += n * known[w]
    n = np.linalg.norm(out)
    return out / n if n else out


def hashed_vectors(texts: DataFrame, dim: int = 256) -> DataFrame:
    """(id, v) of (id, text)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"id": f["id"], "v": [hashed(t, dim) for t in f["text"]]})

    return texts.mapInPandas(run, "id long, v array<double>")


def maxsim_score(query: np.ndarray, doc: np.ndarray) -> float:
    """Sum over the query's vectors of the largest cosine with one of the document's; 0 if either has none."""
    return float((unit(query) @ unit(doc).T).max(axis=1).sum()) if len(query) and len(doc) else 0.0


def maxsim(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(qid, doc, score) by late interaction of token vectors: queries (qid, v), docs (doc, v), a row a token.

    The queries are the given query set: their vectors are gathered in one block, which the plan crosses with the blocks of
    each document; per document that costs its tokens times the query set's, and nothing is shuffled but the documents' tokens."""
    q = queries.groupBy("qid").agg(F.collect_list("v").alias("qv"))
    d = docs.groupBy("doc").agg(F.collect_list("v").alias("dv"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [maxsim_score(np.array(a.tolist(), np.float64), np.array(b.tolist(), np.float64)) for a, b in zip(f["qv"], f["dv"])]
            yield pd.DataFrame({"qid": f["qid"], "doc": f["doc"], "score": got})

    return d.crossJoin(q).mapInPandas(run, "qid long, doc long, score double")


def word_maxsim(queries: DataFrame, docs: DataFrame, dim: int = 256, k: int | None = None) -> DataFrame:
    """(qid, doc, score): maxsim over hashed word vectors of texts, queries (qid, text) against all docs (doc, text); with k, at
    least each query's best k.

    A document's distinct words decide.  Word vectors are small whole numbers, so their products with the query set's words
    are exact in float32; a word's row of cosines is kept from its second use on, as long as there is room, and a document
    takes the maximum of its words' rows one after the other.  With k, what leaves a task is k rows a query."""
    asked = kept(queries.select("qid", tx.tokens(F.col("text")).alias("ws")).where(F.size("ws") > 0))
    if (asked.agg(F.sum(F.size("ws"))).first()[0] or 0) > QUERY_WORDS:
        raise ValueError(f"a query set has {QUERY_WORDS} words at most; ask in several sets")
    query = [(r["qid"], r["ws"]) for r in asked.collect()]  # the query set
    vocabulary = sorted({w for _, ws in query for w in ws})
    place = {w: i for i, w in enumerate(vocabulary)}
    qids = np.array([q for q, _ in query], np.int64)
    wanted = np.array([place[w] for _, ws in query for w in ws], np.int64)
    starts = np.cumsum([0] + [len(ws) for _, ws in query])[:-1]
    split = scan.splitter(tx.tokens)
    room, step = max(1, HELD_CELLS // max(1, len(vocabulary))), max(1, min(512, HELD_CELLS // 8 // max(1, len(vocabulary))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not len(query):
            return
        known, hot, met = _words(dim), {}, set()
        left = np.array([known[w] for w in vocabulary], np.float32)
        length, left = 1 / np.linalg.norm(left.astype(np.float64), axis=1), np.ascontiguousarray(left.T)
        top = scan.Best(len(query), k) if k else None

        def rows(words: list[bytes]) -> np.ndarray:
            m = np.array([known[w.decode()] for w in words], np.float32)
            return (m @ left).astype(np.float64) * length / np.linalg.norm(m.astype(np.float64), axis=1)[:, None]

        for batch in batches:
            for a in range(0, batch.num_rows, 16):
                part = batch.slice(a, 16)
                texts = [set(split(x)) for x in part.column(1).to_pylist()]
                docs = part.column(0).to_numpy(zero_copy_only=False)
                full = np.array([len(x) > 0 for x in texts], bool)
                most = np.full((len(texts), len(vocabulary)), -np.inf)
                users: dict[bytes, list[int]] = {}
                for i, words in enumerate(texts):
                    for w in words:
                        row = hot.get(w)
                        if row is None:
                            users.setdefault(w, []).append(i)
                        else:
                            np.maximum(most[i], row, out=most[i])
                new = list(users)
                for b in range(0, len(new), step):
                    for w, row in zip(new[b : b + step], rows(new[b : b + step])):
                        for i in users[w]:
                            np.maximum(most[i], row, out=most[i])
                        if len(hot) < room:
                            if w in met or len(users[w]) > 1:
                                hot[w] = row.copy()
                            elif len(met) < MEMORY_WORDS:
                                met.add(w)
                if not full.any():
                    continue
                docs, score = docs[full], np.add.reduceat(most[full][:, wanted], starts, axis=1)
                if top is not None:
                    top.add(docs, score, None)
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(np.tile(qids, len(docs))), pa.array(np.repeat(docs, len(qids))), pa.array(score.reshape(-1))], ["qid", "doc", "score"])
        if top is not None:
            yield pa.RecordBatch.from_arrays([pa.array(qids[top.q]), pa.array(top.doc), pa.array(top.score)], ["qid", "doc", "score"])

    return scan.lowered(docs, tx.tokens).mapInArrow(run, "qid long, doc long, score double")
