"""Order-preserving packing: window cuts by dynamic programming over document and sentence boundaries.

A task's documents form one stream of token ids in table order.  Cuts may fall at document ends (no penalty), at
sentence ends (a small truncation penalty) and, only where a longer stretch has neither, inside a sentence (a large
one).  With boundaries at positions b, best[j] = cut(j) + min over b[j]-b[i] <= window of best[i] + window-(b[j]-b[i]).
Since the padding is linear in b[i], a queue of candidates with falling best[i]+b[i] gives each transition in constant
time.  Blocks of boundaries are solved in turn, so memory does not grow with a task.  Tokens left at the end of a task
go to sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodestrata.llm.common import named, parts_of, quoted, ship
from lodestrata.llm.words import tokenizer_file, word_ids

WINDOW = 2048
SENTENCE_PENALTY = 4.0
INSIDE_PENALTY = 64.0
#: Tokens after which a block is solved and its cuts, but for the last window's, are final.
BLOCK_TOKENS = 1 << 19
#: Words that a worker remembers unless told otherwise: few, as a pipeline's earlier stages have filled the executor.
MEMORY_WORDS = 800_000

PIECE_FIELDS = T.StructType(
    [
        T.StructField("start", T.LongType(), False),
        T.StructField("length", T.LongType(), False),
        T.StructField("ids_crc32", T.LongType(), False),
        T.StructField("doc_tokens", T.LongType(), False),
        T.StructField("sequence_id", T.LongType(), False),
        T.StructField("offset", T.LongType(), False),
    ]
)
IDS_FIELD = T.StructField("ids", T.BinaryType(), False)


def best_cuts(at: np.ndarray, penalty: np.ndarray, window: int) -> np.ndarray:
    """Indexes of the cuts of least cost.  at: rising positions from 0, no gap over the window; the last is a cut.

    Ties go to the longer window.
    """
    n = len(at)
    pos, pen = at.tolist(), penalty.tolist()
    best, back = [0.0] * n, [0] * n
    queue = deque([(0.0, 0)])  # best[i] + pos[i], rising from the left; i
    left = queue.popleft
    for j in range(1, n):
        p = pos[j]
        low = p - window
        while pos[queue[0][1]] < low:
            left()
        v, i = queue[0]
        best[j] = b = v + window - p + pen[j]
        back[j] = i
        v = b + p
        while queue and queue[-1][0] > v:
            queue.pop()
        queue.append((v, j))
    cuts, j = [], n - 1
    while j:
        cuts.append(j)
        j = back[j]
    return np.array(cuts[::-1], np.int64)


def cut_points(ends: np.ndarray, stops: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and penalties of possible cuts: documents' ends, sentences' ends, and every quarter window of a stretch over a quarter window long without either."""
    total = int(ends[-1])
    at = np.concatenate([[0], ends, stops])
    penalty = np.zeros(len(at))
    penalty[1 + len(ends) :] = SENTENCE_PENALTY
    order = np.argsort(at, kind="stable")  # of equal positions a document's end comes first
    at, penalty = at[order], penalty[order]
    first = np.diff(at, prepend=-1) > 0
    at, penalty = at[first], penalty[first]
    step = window // 4 or 1
    wide = np.flatnonzero(np.diff(at) > step)
    if len(wide):
        inside = np.concatenate([np.arange(at[k] + step, at[k + 1], step) for k in wide])
        at, penalty = np.concatenate([at, inside]), np.concatenate([penalty, np.full(len(inside), INSIDE_PENALTY)])
        order = np.argsort(at, kind="stable")
        at, penalty = at[order], penalty[order]
    penalty[at == total] = 0.0
    return at, penalty


class Packer:
    """Takes documents in order and gives pieces (row, start, length, crc, doc_tokens, sequence, offset, ids)."""

    def __init__(self, window: int = WINDOW, block: int = BLOCK_TOKENS):
        self.window, self.block = window, block
        self.docs: list[list] = []  # key, ids, stops, ids already given out
        self.held = 0
        self.sequence = 0

    def add(self, key, ids: np.ndarray, stops: np.ndarray) -> Iterator[tuple]:
        self.docs.append([key, ids, stops, 0])
        self.held += len(ids)
        while self.held >= self.block:
            yield from self._solve(False)

    def finish(self) -> Iterator[tuple]:
        if self.held:
            yield from self._solve(True)

    def _solve(self, last: bool) -> Iterator[tuple]:
        sizes = np.array([len(d[1]) - d[3] for d in self.docs], np.int64)
        ends = np.cumsum(sizes)
        begin = ends - sizes
        stops = [d[2][d[2] > d[3]] - d[3] + b for d, b in zip(self.docs, begin)]
        at, penalty = cut_points(ends, np.concatenate(stops), self.window)
        if not last:
            # the block ends where the next documents are unknown: solve it all and keep the cuts but the last two
            cuts = at[best_cuts(at, penalty, self.window)]
            cuts = cuts[:-2]
        else:
            cuts = self._tail(at, penalty)
        if len(cuts):
            yield from self._give(cuts, ends, begin)

    def _tail(self, at: np.ndarray, penalty: np.ndarray) -> np.ndarray:
        cuts = at[best_cuts(at, penalty, self.window)]
        total = int(at[-1])
        done = int(cuts[-2]) if len(cuts) > 1 else 0
        cuts = list(map(int, cuts[:-1]))
        while total > done:
            done += 1 << min((total - done).bit_length() - 1, self.window.bit_length() - 1)
            cuts.append(done)
        return np.array(cuts, np.int64)

    def _give(self, cuts: np.ndarray, ends: np.ndarray, begin: np.ndarray) -> Iterator[tuple]:
        k, low = 0, 0
        for cut in cuts.tolist():
            pos = low
            while pos < cut:
                while ends[k] <= pos:
                    k += 1
                d = self.docs[k]
                a = d[3] + pos - int(begin[k])
                n = min(cut, int(ends[k])) - pos
                ids = d[1][a : a + n].astype("<u4").tobytes()
                yield d[0], a, n, zlib.crc32(ids), len(d[1]), self.sequence, pos - low, ids
                pos += n
            self.sequence += 1
            low = cut
        while k < len(self.docs) and ends[k] <= low:
            k += 1
        if k < len(self.docs):
            self.docs[k][3] += max(0, low - int(begin[k]))
        self.docs = self.docs[k:]
        self.held -= low


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str | None = None,
    window: int = WINDOW,
    eos: int = 1,
    with_ids: bool = False,
    memory_words: int = MEMORY_WORDS,
) -> DataFrame:
    """One row per piece: the id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids as bytes).

    Null and empty texts have the end token alone.  Rows that repeat are packed each for itself; a null id stays null.
    An empty table gives no rows.  Other columns are ignored, whatever their names; an output that is named like the id
    gets an underscore in front.  Sequences never span tasks: sequence_id is the task's partition number times 2**33 plus
    a counter, the same when a lost task runs again.
    """
    spark = docs.sparkSession
    ship(spark)
    path = path or tokenizer_file()
    fields = [*PIECE_FIELDS, *([IDS_FIELD] if with_ids else [])]
    out = T.StructType([T.StructField("id", docs.schema[id_col].dataType, True), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() << 33
        words, packer = word_ids(path, memory_words), Packer(window)
        kind: pa.DataType | None = None

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            keys, *cols, ids = zip(*rows)
            cols[4] = [part + s for s in cols[4]]
            arrays = [pa.array(keys, type=kind), *[pa.array(c, type=pa.int64()) for c in cols]]
            if with_ids:
                arrays.append(pa.array(ids, type=pa.binary()))
            return pa.RecordBatch.from_arrays(arrays, out.names)

        rows: list[tuple] = []
        for batch in batches:
            kind = batch.column(0).type
            for a, b, texts in parts_of(batch.column(1)):
                for k, (ids, stops) in zip(batch.column(0).slice(a, b - a).to_pylist(), words(texts)):
                    ids = np.append(ids, np.int32(eos))
                    rows += packer.add(k, ids, stops)
                if len(rows) >= 4096:
                    yield batch_of(rows)
                    rows = []
        rows += packer.finish()
        if rows:
            yield batch_of(rows)

    names = [f.name for f in fields]
    return docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text")).mapInArrow(run, out).toDF(id_col, *named([id_col], names))
