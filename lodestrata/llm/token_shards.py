"""Training-order materialisation: token sequences in shards of fixed stride, shuffled by a keyed permutation.

Documents become token ids in table order, each followed by an end id; a task's stream is cut into sequences of LENGTH ids.
Sequence n of N goes to slot P(n), where P is a four-round Feistel network over the least even number of bits that
holds N, walked along its cycle until it falls below N: a permutation of 0..N-1 that needs no table.  Slots are
dealt out by ranges of equal size, one task a shard; slot s lies at byte (s - first) * stride of its shard, so a reader
can begin anywhere.  A shard is written under a name of its attempt and renamed when whole; its bytes
depend on nothing but its slots, so a task that runs twice leaves the same file.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.llm.common import Scratch, parts_of, quoted, scratch_path, ship, stored
from lodestrata.llm.words import tokenizer_file, word_ids

LENGTH = 2048
#: Sequences a shard: 32 MB of 2-byte ids.
PER_SHARD = 8192
KEY = 0x5EED


def _round_keys(key: int, rounds: int = 4) -> list[np.uint64]:
    return [np.uint64(zlib.crc32(f"{key}/{r}".encode()) | zlib.crc32(f"{r}/{key}".encode()) << 32) for r in range(rounds)]


def feistel(n: np.ndarray, size: int, key: int = KEY) -> np.ndarray:
    """The slots of sequences n, all below size: a permutation of 0..size-1 that key chooses."""
    half = np.uint64(max(1, -(-max(size - 1, 1).bit_length() // 2)))
    mask = np.uint64((1 << int(half)) - 1)
    keys = _round_keys(key)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & mask
        for k in keys:
            f = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((f >> np.uint64(32)) & mask)
        return (left << half) | right

    x = once(np.asarray(n, np.uint64))
    while (far := x >= size).any():
        x[far] = once(x[far])
    return x.astype(np.int64)


SEQUENCE = T.StructType(
    [
        T.StructField("part", T.IntegerType(), False),
        T.StructField("nth", T.LongType(), False),
        T.StructField("n_tokens", T.IntegerType(), False),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("ids", T.BinaryType(), False),
    ]
)


#: Documents (the first that are read), and characters of the beginning of each, on whose sequences the compression
#: dictionary is trained, and its size.  The dictionary changes how the scratch table is packed and no result.
DICT_DOCS, DICT_CHARS, DICT_BYTES = 300, 20_000, 64 << 10


def dictionary_of(docs: DataFrame, text_col: str, path: str, length: int) -> bytes:
    """A Zstandard dictionary for sequences, which are too short to compress well alone; empty if there is too little text."""
    import zstandard

    texts = [r[0] for r in docs.select(F.substring(quoted(text_col), 1, DICT_CHARS)).limit(DICT_DOCS).collect() if r[0]]
    ids = np.concatenate([np.zeros(0, np.int32), *(i for i, _ in word_ids(path)(texts))]).astype("<u2")
    samples = [ids[a : a + length].tobytes() for a in range(0, len(ids) - length + 1, length)]
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes() if len(samples) > 20 else b""
    except zstandard.ZstdError:
        return b""


def _packer(dictionary: bytes):
    import zstandard

    return zstandard.ZstdCompressor(level=6, **({"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}))


def _unpacker(dictionary: bytes):
    import zstandard

    return zstandard.ZstdDecompressor(**({"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}))


def sequences(docs: DataFrame, id_col: str, text_col: str, path: str, length: int, eos: int, dictionary: bytes = b"") -> DataFrame:
    """(part, nth, n_tokens, doc_ids, ids): ids as 2-byte little-endian numbers, filled up with the end id, compressed."""
    spark = docs.sparkSession
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, words, nth, packer = TaskContext.get().partitionId(), word_ids(path), 0, _packer(dictionary)
        held: list[tuple] = []  # id, ids not yet given out
        size = 0
        rows: list[tuple] = []

        def cut(n: int) -> None:
            nonlocal nth, size
            ids, owners, left = [], [], n
            while left:
                k, x = held[0]
                take = min(left, len(x))
                ids.append(x[:take])
                if k is not None and (not owners or owners[-1] != k):
                    owners.append(k)
                left -= take
                if take == len(x):
                    held.pop(0)
                else:
                    held[0] = (k, x[take:])
            whole = np.full(length, eos, "<u2")
            whole[:n] = np.concatenate(ids)
            rows.append((part, nth, n, owners, packer.compress(whole.tobytes())))
            nth, size = nth + 1, size - n

        def batch_of() -> pa.RecordBatch:
            kinds = [pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary()]
            out = pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows), kinds)], SEQUENCE.names)
            rows.clear()
            return out

        for batch in batches:
            for a, b, texts in parts_of(batch.column(1)):
                for k, (ids, _) in zip(batch.column(0).slice(a, b - a).to_pylist(), words(texts)):
                    if len(ids) and ids.max() > 65535:
                        raise ValueError("ids over 65535 need a wider stride than 2 bytes")
                    held.append((k, np.append(ids, eos).astype(np.uint16)))
                    size += len(ids) + 1
                    while size >= length:
                        cut(length)
                    if len(rows) >= 512:
                        yield batch_of()
        if size:
            cut(size)
        if rows:
            yield batch_of()

    columns = docs.select(quoted(id_col).cast("long").alias("id"), quoted(text_col).alias("text"))
    return columns.mapInArrow(run, SEQUENCE)


PLACED = T.StructType(
    [
        T.StructField("slot", T.LongType(), False),
        T.StructField("shard", T.StringType(), False),
        T.StructField("byte_offset", T.LongType(), False),
        T.StructField("n_tokens", T.IntegerType(), False),
        T.StructField("ids_crc32", T.LongType(), False),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
    ]
)


def materialise(
    docs: DataFrame,
    folder: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str | None = None,
    length: int = LENGTH,
    per_shard: int = PER_SHARD,
    key: int = KEY,
    eos: int = 1,
) -> DataFrame:
    """Write the shards (into folder, a path that all executors share) and give a row per sequence, as read back:
    slot, shard, byte_offset, n_tokens (without filling), ids_crc32 (of the stride's bytes), doc_ids (in order).

    Null and empty texts are the end id alone.  Rows that repeat are written each for itself; tokens of rows whose id is
    null are written and listed under no id.  An empty table writes no shard and gives no rows.  Other columns are
    ignored, whatever their names.
    """
    spark = docs.sparkSession
    folder = (folder or scratch_path(spark, "shards")).rstrip("/")
    path = path or tokenizer_file()
    dictionary = dictionary_of(docs, text_col, path, length)
    with Scratch(spark) as keep:
        staged = keep(sequences(docs, id_col, text_col, path, length, eos, dictionary), "sequences")
        return _placed(staged, folder, length, per_shard, key, dictionary)


def _placed(staged: DataFrame, folder: str, length: int, per_shard: int, key: int, dictionary: bytes) -> DataFrame:
    """Deal the sequences out by slot, write the shards and read them back."""
    spark = staged.sparkSession
    counts = sorted((r["part"], r["n"]) for r in staged.groupBy("part").agg(F.count("*").alias("n")).collect())  # one row a task
    total = sum(n for _, n in counts)
    if not total:
        return spark.createDataFrame([], PLACED)
    first, base = {}, 0
    for part, n in counts:
        first[part], base = base, base + n
    stride = 2 * length

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part, nth = b.column(0).to_numpy(), b.column(1).to_numpy()
            slot = feistel(np.array([first[p] for p in part.tolist()], np.int64) + nth, total, key) if len(nth) else np.zeros(0, np.int64)
            arrays = [pa.array(slot), pa.array((slot // per_shard).astype(np.int32)), *b.columns[2:]]
            yield pa.RecordBatch.from_arrays(arrays, ["slot", "n_shard", "n_tokens", "doc_ids", "ids"])

    dealt = staged.mapInArrow(place, T.StructType([T.StructField("slot", T.LongType()), T.StructField("n_shard", T.IntegerType()), *SEQUENCE[2:]]))
    dealt = dealt.repartitionById(-(-total // per_shard), F.col("n_shard")).sortWithinPartitions("slot")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(folder)
        name, out, unpacker = None, None, _unpacker(dictionary)
        meta: list[tuple] = []
        for b in batches:
            slots = b.column(0).to_pylist()
            for i, (slot, n) in enumerate(zip(slots, b.column(2).to_pylist())):
                if out is None:
                    lowest = slot // per_shard * per_shard
                    name = f"shard-{slot // per_shard:08d}.bin"
                    store.create_dir(root, recursive=True)
                    trial = f"{root}/_{name}.{TaskContext.get().taskAttemptId()}"
                    out = store.open_output_stream(trial)
                if slot != lowest + len(meta):
                    raise ValueError(f"slot {slot} where {lowest + len(meta)} was due")
                data = unpacker.decompress(b.column(4)[i].as_py())
                if len(data) != stride:
                    raise ValueError(f"{len(data)} bytes in a stride of {stride}")
                out.write(data)
                meta.append((slot, n, b.column(3)[i].as_py()))
        if out is None:
            return
        out.close()
        store.move(trial, f"{root}/{name}")
        crcs = [zlib.crc32(s) for s in _strides(store, f"{root}/{name}", stride, 0, len(meta))]
        for a in range(0, len(meta), 1024):
            rows = [(s, name, (s - lowest) * stride, n, c, d) for (s, n, d), c in zip(meta[a : a + 1024], crcs[a : a + 1024])]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows), kinds)], PLACED.names)

    return stored(dealt.mapInArrow(write, PLACED), "placed")


def _strides(store, path: str, stride: int, start: int, n: int) -> Iterator[bytes]:
    with store.open_input_file(path) as f:
        f.seek(start * stride)
        for _ in range(n):
            data = f.read(stride)
            if len(data) != stride:
                raise ValueError(f"{path} ends within a stride")
            yield data


def read_slots(folder: str, start: int, n: int, length: int = LENGTH, per_shard: int = PER_SHARD) -> Iterator[np.ndarray]:
    """The ids of slots start..start+n-1 in training order; a reader that stopped before slot s goes on with start=s."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    while n > 0:
        k, at = divmod(start, per_shard)
        part = min(n, per_shard - at)
        for data in _strides(store, f"{root.rstrip('/')}/shard-{k:08d}.bin", 2 * length, at, part):
            yield np.frombuffer(data, "<u2")
        start, n = start + part, n - part
