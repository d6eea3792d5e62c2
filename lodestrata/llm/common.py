"""Plumbing shared by the training-data operators: batches, scratch tables, bounded labelled samples, joins on hot keys."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import pickle
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and characters that a Python step holds at once, whatever size Arrow batches have.
SLICE_ROWS = 512
SLICE_CHARS = 4_000_000
#: Bytes up to which a table is broadcast; its size is summed first.
BROADCAST_BYTES = 32 << 20
#: Values that a class column may have; of more, those with most rows are learned.
MOST_CLASSES = 1000
#: A text of over this share of a class's characters is passed over when a sample is taken.
LONGEST_SHARE = 0.1


def ship(spark: SparkSession) -> None:
    """Make this package importable on executors that have no copy of it (once a session)."""
    sc = spark.sparkContext
    if getattr(sc, "_lodestrata_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp()
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    bundle = os.path.join(folder, f"{root.name}.zip")
    with zipfile.ZipFile(bundle, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(bundle)
    sc._lodestrata_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Where that is unset, a folder of our own in local mode only; on a cluster it would be another one on each machine,
    so the operator refuses to run.
    """
    got = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not got:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        got = tempfile.mkdtemp(prefix="lodestrata-")
        atexit.register(shutil.rmtree, got, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(got)
        got = spark.sparkContext.getCheckpointDir()
    return got.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lodestrata/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Cut the lineage with a table in the shared folder; it outlives lost executors."""
    path = path or scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables in the shared folder that one run of an operator needs: ``keep(df, name)`` writes one, the end of the block
    deletes all.  What the operator returns must have been stored outside."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.n = spark, scratch_path(spark, "run"), 0

    def __enter__(self) -> Scratch:
        return self

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        return stored(df, name, f"{self.path}/{self.n:03d}-{name}")

    def __exit__(self, *exc) -> None:
        dropped(self.spark, self.path)


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder in whatever store holds it."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def fresh(columns: Sequence[str], base: str) -> str:
    """A column name that clashes with none of these (names compare without case)."""
    taken = {c.lower() for c in columns}
    name, k = f"_{base}", 0
    while name.lower() in taken:
        name, k = f"_{base}{k}", k + 1
    return name


def named(keys: Sequence[str], outputs: Sequence[str]) -> list[str]:
    """Names of output columns beside key columns: those that a key has already get an underscore in front."""
    out: list[str] = []
    for n in outputs:
        taken = {c.lower() for c in [*keys, *out]}
        out.append(fresh([*keys, *out], n) if n.lower() in taken else n)
    return out


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def slices(sizes: Sequence[int]) -> Iterator[tuple[int, int]]:
    """Cut a batch so that no slice has over SLICE_ROWS rows, nor (but for a single row) over SLICE_CHARS characters."""
    start = size = 0
    for i, n in enumerate(sizes):
        if i > start and (i - start >= SLICE_ROWS or size + n > SLICE_CHARS):
            yield start, i
            start, size = i, 0
        size += n
    if start < len(sizes):
        yield start, len(sizes)


def parts_of(column: pa.Array) -> Iterator[tuple[int, int, list]]:
    """(from, to, values) of the slices of a column of texts or bytes; only one slice is held as Python objects."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    for a, b in slices(sizes):
        yield a, b, column.slice(a, b - a).to_pylist()


def map_text(df: DataFrame, keep: Sequence[str], text_col: str, make: Callable[[], Callable[[list], dict]], fields: T.StructType) -> DataFrame:
    """Columns ``keep`` as they are, then ``fields`` computed from whole texts (None where null).

    ``make()`` runs once a task and returns the function that maps a list of texts to a dict of columns.
    Columns outside ``keep`` never reach Python, so their names and types don't matter.  A field that is named like a
    kept column gets an underscore in front.
    """
    ship(df.sparkSession)
    keep = list(keep)
    names = [f.name for f in fields]
    kinds = [_arrow(f.dataType) for f in fields]
    inner = [f"k{i}" for i in range(len(keep))]
    at = [f"f{i}" for i in range(len(names))]
    out = T.StructType([T.StructField(i, df.schema[c].dataType, True) for i, c in zip(inner, keep)] + [T.StructField(i, f.dataType, f.nullable) for i, f in zip(at, fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for a, b, texts in parts_of(batch.column(batch.num_columns - 1)):
                got = step(texts)
                made = [pa.array(got[n], type=k) for n, k in zip(names, kinds)]
                kept = [batch.column(i).slice(a, b - a) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays(kept + made, inner + at)

    rows = df.select(*[quoted(c).alias(i) for i, c in zip(inner, keep)], quoted(text_col).alias("text")).mapInArrow(run, out)
    return rows.toDF(*keep, *named(keep, names))


def where_text(df: DataFrame, text_col: str, make: Callable[[], Callable[[list], list]]) -> DataFrame:
    """The rows of df, with all their columns, whose text the function that ``make()`` returns (once a task) says True of.
    Only the text goes to Python, so other columns may have any type and any name, twice even."""
    ship(df.sparkSession)

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        step = make()
        for c in columns:
            said: list[bool] = []
            for _, _, texts in parts_of(c):
                said += step(texts)
            yield pa.array(said, pa.bool_())

    run.__annotations__ = {"columns": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return df.where(F.arrow_udf(run, "boolean")(quoted(text_col)))


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


_memories: dict[str, Callable[[], None]] = {}


def take_memory(name: str, forget: Callable[[], None] = lambda: None) -> None:
    """Let one operator remember things between the tasks of a worker process: what others remember there is forgotten.

    Workers outlive stages, so the memories of a pipeline's operators would else add up."""
    for other in [x for x in _memories if x != name]:
        _memories.pop(other)()
    _memories[name] = forget
    tidy()


def tidy() -> None:
    """Give freed memory back to the system."""
    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def give_back(spark: SparkSession) -> None:
    """Have the executors' JVMs collect their garbage and give the heap that it took back to the system.

    A JVM lets its heap grow with what a step allocates, not with what it keeps, and hardly shrinks it; Python workers
    need that memory beside it.  A task a core reaches every executor that is idle; one that is missed only stays large.
    """
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).collect()  # one row a task


def bounded_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, class_col: str, per_class: int, chars: int, classes: Sequence | None = None, where=None) -> DataFrame:
    """(_k, _t, _y): id, text and class of at most ``per_class`` labelled documents of each class, the least by a hash of
    the id, as long as their texts have at most ``chars`` characters together.

    Texts are taken whole; one of over LONGEST_SHARE of ``chars`` is passed over.  An id with two classes counts for the
    least, one with several texts has the least of them.  Labels are read twice whatever the number of classes: once to
    count them, and once for the ids whose hash is below a bound that about twice as many reach, so what is sorted does
    not grow with the tables.  The ids to join are at most ``per_class`` times the classes, which bounds the broadcast.
    """
    spark = docs.sparkSession
    rows = labels.select(quoted(id_col).alias("_k"), quoted(class_col).alias("_y")).where("_k is not null and _y is not null")
    if where is not None:
        rows = rows.where(where(F.col("_k")))
    if classes is not None:
        rows = rows.where(F.col("_y").isin(list(classes)))
    counts = rows.groupBy("_y").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "_y").limit(MOST_CLASSES).collect()  # one row a class
    kind = T.StructType([T.StructField("_y", rows.schema["_y"].dataType), T.StructField("_most", T.LongType())])
    bounds = spark.createDataFrame([(r["_y"], hash_bound(2 * per_class + 1000, r["n"])) for r in counts], kind)
    near = rows.join(F.broadcast(bounds), "_y").where(F.xxhash64("_k") <= F.col("_most")).groupBy("_k").agg(F.min("_y").alias("_y"))
    from pyspark.sql import Window

    order = Window.partitionBy("_y").orderBy(F.xxhash64("_k"), "_k")
    picked = near.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= per_class)
    texts = docs.select(quoted(id_col).alias("_d"), quoted(text_col).alias("_t")).where(F.coalesce(F.length("_t"), F.lit(0)) <= int(chars * LONGEST_SHARE))
    got = texts.join(F.broadcast(picked), F.col("_d") == F.col("_k")).groupBy("_k", "_y", "_r").agg(F.min("_t").alias("_t"))
    used = F.sum(F.coalesce(F.length("_t"), F.lit(0))).over(Window.partitionBy("_y").orderBy("_r").rowsBetween(Window.unboundedPreceding, 0))
    return got.withColumn("_used", used).where(F.col("_used") <= chars).select("_k", "_t", "_y")


def fitted(sample: DataFrame, fit: Callable[[list, list], object]):
    """What ``fit(texts, classes)`` makes of a bounded sample (_k, _t, _y), in the order of its ids.

    The fit is one task on an executor, which may run again; the driver's memory holds the model alone.
    """
    ship(sample.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_memory("fit")
        rows: list[tuple] = []
        for b in batches:
            rows += zip(*(c.to_pylist() for c in b.columns))
        rows.sort(key=lambda r: (r[0], r[1] or ""))
        model = pickle.dumps(fit([r[1] for r in rows], [r[2] for r in rows]))
        del rows
        tidy()
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], ["model"])

    got = sample.repartition(1).mapInArrow(run, "model binary").collect()  # one row
    return pickle.loads(bytes(got[0][0])) if got else fit([], [])


def hash_bound(wanted: int, count: int) -> int:
    """The 64-bit hash that about ``wanted`` of ``count`` don't exceed; the largest of all if there are no more."""
    return 2**63 - 1 if count <= wanted else int(-(2**63) + wanted / count * 2**64)


def hash_share(h: Column, wanted: int, count: int) -> Column:
    """Whether a hash is among the least; about ``wanted`` of ``count`` are, and all if there are no more."""
    return h <= F.lit(hash_bound(wanted, count))


def small_enough(df: DataFrame, size: Column | None = None, most: int = BROADCAST_BYTES) -> bool:
    """Whether a stored table has at most ``most`` bytes; size: of a row, beside 16 bytes for each column."""
    per = F.lit(16 * len(df.columns)) + (size if size is not None else F.lit(0))
    return (df.agg(F.sum(per.cast("long"))).first()[0] or 0) <= most


#: A key is hot if it has over this share of a table's rows in one of as many parts as there are shuffle partitions.
HOT_SHARE = 2


def hot_keys(counts: DataFrame, keys: Sequence[str], n: str = "n") -> DataFrame:
    """(keys, _parts): of the stored table of row counts by key, the keys that have far more rows than a task should, and
    into how many parts to cut each.  There are at most HOT_SHARE times as many as shuffle partitions, so they can be broadcast."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    limit = max(1000, total // (HOT_SHARE * int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return counts.where(F.col(n) > limit).select(*keys, F.ceil(F.col(n) / limit).cast("int").alias("_parts"))


def salted_join(big: DataFrame, small: DataFrame, keys: Sequence[str], by: Column, hot: DataFrame, how: str = "inner") -> DataFrame:
    """big joined with small (one row a key) on keys, the rows of hot keys dealt out to several tasks by the hash of ``by``,
    a column of big; small's row of a hot key goes to each of them."""
    keys = list(keys)
    parts = F.coalesce("_parts", F.lit(1))
    wide = big.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.pmod(F.xxhash64(by), parts).cast("int")).drop("_parts")
    many = small.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return wide.join(many, [*keys, "_salt"], how).drop("_salt")


def crc_mod(column, m: int):
    """crc32 of the id as text, modulo m."""
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(m))


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))
