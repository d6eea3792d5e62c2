"""Near-duplicate groups by b-bit MinHash, confirmed on whole shingle sets.

1. Each text's set of distinct word shingles (64-bit hashes) gives a digest of the set, the minima of BANDS * ROWS
   hash functions folded into BANDS band keys, and the low BITS bits of each minimum packed into longs.
2. Texts with equal sets form a class at once; the class's least id stands for it from here on.
3. Classes that share a band key are candidates.  ROUNDS rounds link each class with one other of its bands, the one
   with the best similarity estimated from the packed bits (bit counts, corrected for chance agreement of BITS bits);
   links are confirmed on the full sets and contracted to components.  All pairs of band mates that are then still in
   different components are compared, so no candidate pair is lost, and none is made within a component.  Where the two
   have the same centre, what each lacks of it and has beyond it bounds what they share, which rules out most pairs of
   a large group exactly and before they leave the join.
A pair of similarity s shares no band with probability (1 - s**ROWS) ** BANDS: 3e-6 at 0.8, 4e-13 at 0.9.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.llm.common import Scratch, fresh, hot_keys, map_text, named, quoted, salted_join, small_enough, stored, take_memory

BANDS, ROWS, BITS = 32, 5, 2
HASHES = BANDS * ROWS
#: Candidates whose estimate is below threshold less this are dropped: over five standard deviations at 160 hashes.
MARGIN = 0.2
#: Rounds in which each band key has one centre; what they leave apart is compared pair by pair.
ROUNDS = 2
#: Distinct words whose hash a worker remembers.
MEMORY_WORDS = 400_000

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = _WordHash()


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; one of all words if there are fewer; none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    k = min(k, len(words))
    n = len(h) - k + 1
    s = np.full(n, k, np.uint64)
    for j in range(k):
        s = mix(s + h[j : j + n])
    return np.unique(s)


class Signer:
    """Minima of HASHES functions x -> a * x + b modulo 2**32 of shingles folded to 32 bits."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(0, 2**31, (HASHES, 1)).astype(np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = rng.integers(0, 2**32, (HASHES, 1)).astype(np.uint32)
        self.room = np.empty((HASHES, 256), np.uint32)

    def minima(self, values: np.ndarray) -> np.ndarray:
        least = np.full(HASHES, np.iinfo(np.uint32).max, np.uint32)
        short = (values >> np.uint64(32)).astype(np.uint32)
        for i in range(0, len(short), 256):
            part = short[None, i : i + 256]
            room = self.room[:, : part.shape[1]]
            np.multiply(part, self.a, out=room)
            np.add(room, self.b, out=room)
            np.minimum(least, room.min(axis=1), out=least)
        return least

    def __call__(self, values: np.ndarray) -> tuple[list, list]:
        least = mix(self.minima(values).astype(np.uint64))
        rows = least.reshape(BANDS, ROWS)
        key = np.arange(BANDS, dtype=np.uint64)
        for j in range(ROWS):
            key = mix(key + rows[:, j])
        low = (least & np.uint64((1 << BITS) - 1)).astype(np.uint8)
        bits = np.unpackbits(low[:, None], axis=1, bitorder="little")[:, :BITS].reshape(-1)
        packed = np.packbits(np.pad(bits, (0, -len(bits) % 64)), bitorder="little").view("<i8")
        return key.view(np.int64).tolist(), packed.tolist()


SIGNATURE = T.StructType(
    [
        T.StructField("n_shingles", T.LongType(), False),
        T.StructField("set_hi", T.LongType()),
        T.StructField("set_lo", T.LongType()),
        T.StructField("bands", T.ArrayType(T.LongType(), False)),
        T.StructField("bits", T.ArrayType(T.LongType(), False)),
    ]
)


def _own_memory() -> None:
    take_memory("word hashes", _words.clear)


def _fresh_memory() -> None:
    if len(_words) > MEMORY_WORDS:
        _words.clear()


def _digest(s: np.ndarray) -> list:
    import xxhash

    return np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), "<i8").tolist() if len(s) else [None, None]


def signatures(docs: DataFrame, keep: list[str], text_col: str, k: int) -> DataFrame:
    def make():
        _own_memory()
        sign = Signer()

        def step(texts: list) -> dict:
            _fresh_memory()
            out = {f.name: [] for f in SIGNATURE}
            for t in texts:
                s = shingle_set(t, k)
                bands, bits = sign(s) if len(s) else (None, None)
                for name, v in zip(out, (len(s), *_digest(s), bands, bits)):
                    out[name].append(v)
            return out

        return step

    return map_text(docs, keep, text_col, make, SIGNATURE)


SET = T.StructType([SIGNATURE["set_hi"], SIGNATURE["set_lo"], T.StructField("shingles", T.ArrayType(T.LongType(), False))])


def shingle_sets(docs: DataFrame, text_col: str, k: int) -> DataFrame:
    """(set_hi, set_lo, shingles) of each row."""

    def make():
        _own_memory()

        def step(texts: list) -> dict:
            _fresh_memory()
            sets = [shingle_set(t, k) for t in texts]
            digests = [_digest(s) for s in sets]
            return {"set_hi": [d[0] for d in digests], "set_lo": [d[1] for d in digests], "shingles": [s.view(np.int64) for s in sets]}

        return step

    return map_text(docs, [], text_col, make, SET)


def estimate(a: Column, b: Column) -> Column:
    """Similarity from packed low bits: the share of equal fields, less the share that agrees by chance."""
    unlike = F.lit(0)
    for i in range((HASHES * BITS + 63) // 64):
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555))
        unlike = unlike + F.bit_count(x)
    chance = 2.0**-BITS
    return ((1 - unlike / F.lit(float(HASHES))) - F.lit(chance)) / F.lit(1 - chance)


def components(links: DataFrame, store=stored) -> DataFrame:
    """(id, comp) for each end of links (a, b): the least id that it reaches.  Every round each node joins its least
    neighbour and the graph is contracted; rounds grow with the logarithm of the longest chain.  ``store`` writes the result."""
    with Scratch(links.sparkSession) as keep:
        edges = keep(links.select("a", "b").where("a <> b").distinct(), "edges")
        label = None
        while True:
            both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            step = keep(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to")).select(F.col("a").alias("x"), "to"), "hook")
            if label is None:
                label = step.select(F.col("x").alias("id"), F.col("to").alias("comp"))
            else:
                label = label.join(step, label["comp"] == step["x"], "left").select("id", F.coalesce("to", "comp").alias("comp"))
            label = keep(label, "label")
            moved = edges.join(step, edges["a"] == step["x"]).select(F.col("to").alias("a"), "b")
            moved = moved.join(step, moved["b"] == step["x"]).select("a", F.col("to").alias("b")).where("a <> b")
            edges = keep(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
            if edges.isEmpty():
                return store(label, "components")


PROFILE = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("centre", T.LongType()),
        T.StructField("n", T.IntegerType()),
        T.StructField("n_centre", T.IntegerType()),
        T.StructField("lost", T.ArrayType(T.LongType())),
        T.StructField("own", T.ArrayType(T.LongType())),
        T.StructField("spare", T.IntegerType()),
    ]
)
MAP_LONGS = 16


def _profiles(there: DataFrame, sets: DataFrame, hot: DataFrame) -> DataFrame:
    """What sets (id, centre) lack of their centre's set, and have beyond it, as bit maps of MAP_LONGS longs; spare: how
    many more shingles beyond it there are than bits set."""
    x = sets.select("id", F.col("shingles").alias("s"))
    c = sets.select(F.col("id").alias("centre"), F.col("shingles").alias("c"))
    both = salted_join(there.join(x, "id"), c, ["centre"], F.col("id"), hot)
    both = both.select("id", "centre", F.size("s").alias("n"), F.size("c").alias("n_centre"), F.array_except("c", "s").alias("lost"), F.array_except("s", "c").alias("own"))

    def marks(values) -> np.ndarray:
        bits = np.zeros(64 * MAP_LONGS, np.uint8)
        bits[np.asarray(values, np.int64) % (64 * MAP_LONGS)] = 1
        return bits

    def run(batches):
        import pyarrow as pa

        for b in batches:
            lost, own, spare = [], [], []
            for x, y in zip(b.column(4), b.column(5)):
                x, y = marks(x.values.to_numpy()), marks(y.values.to_numpy())
                lost.append(np.packbits(x, bitorder="little").view("<i8"))
                own.append(np.packbits(y, bitorder="little").view("<i8"))
                spare.append(-int(y.sum()))
            n_own = [len(y.values) for y in b.column(5)]
            kind = pa.list_(pa.int64())
            arrays = [*b.columns[:4], pa.array(lost, kind), pa.array(own, kind), pa.array([n + s for n, s in zip(n_own, spare)], pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, PROFILE.names)

    return both.mapInArrow(run, PROFILE)


#: Members of a band key that are compared with as many others at once.
BLOCK = 256
BLOCK_FIELDS = ["id", "comp", "minor", "n", "n_centre", "centre", "spare", "bits", "lost", "own"]


def _likely(blocks: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components in blocks x and y of one band key that sizes, packed bits and the bound by
    a common centre C allow.  Two sets share at most |C| less what either lacks of it, plus what both have beyond it;
    bits count what either lacks from below, bits and spare what both have from above, so the bound is exact."""
    mask, chance = np.uint64(0x5555555555555555), 2.0**-BITS

    def columns(structs) -> dict[str, np.ndarray]:
        out = {}
        for name in BLOCK_FIELDS:
            c = structs.field(name)
            wide = name in ("bits", "lost", "own")
            c = c.flatten() if wide else c
            v = c.to_numpy(zero_copy_only=False)
            out[name] = v.astype(np.uint64).reshape(len(structs), -1) if wide else v
        return out

    def ones(v: np.ndarray) -> np.ndarray:
        return np.bitwise_count(v).sum(axis=2, dtype=np.int64)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for xs, ys in zip(batch.column(0), batch.column(1)):
                x, y = columns(xs.values), columns(ys.values)
                nx, ny = x["n"].astype(np.int64)[:, None], y["n"].astype(np.int64)[None, :]
                ok = (x["comp"][:, None] != y["comp"][None, :]) & (~y["minor"][None, :] | (x["id"][:, None] < y["id"][None, :]))
                ok &= 100 * np.minimum(nx, ny) >= percent * np.maximum(nx, ny)
                if ok.any():
                    d = x["bits"][:, None, :] ^ y["bits"][None, :, :]
                    unlike = ones((d | (d >> np.uint64(1))) & mask)
                    ok &= (1 - unlike / HASHES - chance) / (1 - chance) >= percent / 100 - MARGIN
                if ok.any():
                    most = x["n_centre"].astype(np.int64)[:, None] - ones(x["lost"][:, None, :] | y["lost"][None, :, :])
                    most += ones(x["own"][:, None, :] & y["own"][None, :, :]) + np.minimum(x["spare"][:, None], y["spare"][None, :])
                    ok &= (x["centre"][:, None] != y["centre"][None, :]) | (100 * most >= percent * (nx + ny - most))
                i, j = np.nonzero(ok)
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(x["id"][i]), pa.array(y["id"][j])], ["a", "b"])

    return blocks.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id, kept.

    Texts are linked where 100 * intersection >= percent * union of their sets of k-word shingles (fewer words: the
    whole sequence is one shingle).  component_id is the least id that links reach; kept marks the rows that have it.
    Null texts and texts without words have an empty set, are linked with nothing and kept.  Rows that repeat share
    their answer; rows with one id and different texts are answered each by its own text.  Rows whose id is null are
    linked with nothing: component_id null, kept true.  An empty table gives no rows.  Ids may be of any type that has an
    order.  Other columns are ignored, whatever their names; an output that is named like the id gets an underscore in front.
    """
    out = _groups(docs, id_col, text_col, k, percent).select("id", "n_shingles", "component_id", "kept")
    return out.toDF(id_col, *named([id_col], out.columns[1:]))


def _groups(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """(id, h, n_shingles, component_id, kept) for each row of docs; h: the text's hash."""
    spark = docs.sparkSession
    rows = docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text"), F.xxhash64(quoted(text_col)).alias("h"))
    with Scratch(spark) as keep:
        signed = keep(signatures(rows, ["id", "h"], "text", k), "signatures")
        shingled = signed.where("n_shingles > 0 and id is not null")
        classes = shingled.groupBy("set_hi", "set_lo").agg(F.min("id").alias("least"), F.count("*").alias("n"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("bits").alias("bits"))
        classes = keep(classes.withColumn("id", F.monotonically_increasing_id()), "classes")  # numbers, fixed by writing them
        comp = _linked(keep, classes, rows, k, percent)

        if comp is None:
            whole = classes.select("set_hi", "set_lo", "n", F.col("least").alias("component_id"))
        else:
            whole = classes.join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
            least = whole.groupBy("comp").agg(F.min("least").alias("component_id"), F.count("*").alias("m"))
            least = keep(least.where("m > 1"), "least")
            whole = salted_join(whole, least, ["comp"], F.col("id"), hot_keys(least, ["comp"], "m"), "left")
            whole = whole.select("set_hi", "set_lo", "n", F.coalesce("component_id", "least").alias("component_id"))
        whole = keep(whole, "groups")
        found = salted_join(shingled.select("id", "h", "n_shingles", "set_hi", "set_lo"), whole.drop("n"), ["set_hi", "set_lo"], F.struct("id", "h"), hot_keys(whole, ["set_hi", "set_lo"]))
        alone = signed.where("n_shingles = 0 or id is null").select("id", "h", "n_shingles", F.col("id").alias("component_id"))
        out = found.select("id", "h", "n_shingles", "component_id").unionByName(alone)
        return stored(out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))), "near-duplicates")


def _linked(keep: Scratch, classes: DataFrame, rows: DataFrame, k: int, percent: int) -> DataFrame | None:
    """(id, comp) of the classes that are linked with others, by their numbers; None if no two share a band."""
    keyed = classes.select("id", F.explode("bands").alias("key"))
    shared = keep(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shared-keys")
    hot = keep(hot_keys(shared, ["key"]), "hot-keys")
    mates = keep(salted_join(keyed, shared, ["key"], F.col("id"), hot), "band-mates")
    ids = keep(mates.groupBy("id").agg(F.sum("n").alias("degree")), "candidates")
    if ids.isEmpty():
        return None
    some = keep(classes.join(ids, "id").select("id", "set_hi", "set_lo", "n_shingles", "bits", "degree"), "bits")
    bits = some.select("id", "n_shingles", "bits")
    wanted = some.select("id", F.col("set_hi").alias("hi"), F.col("set_lo").alias("lo"))
    sets = shingle_sets(_first_rows(rows, classes, ids), "text", k)
    sets = sets.join(wanted, (F.col("set_hi") == F.col("hi")) & (F.col("set_lo") == F.col("lo"))).select("id", "shingles")
    sets = keep(sets.dropDuplicates(["id"]), "sets")

    def similar(pairs: DataFrame) -> DataFrame:
        """Of the pairs (a, b), those that sizes and packed bits allow, with the estimate."""
        x = bits.select(F.col("id").alias("a"), F.col("n_shingles").alias("na"), F.col("bits").alias("xa"))
        y = bits.select(F.col("id").alias("b"), F.col("n_shingles").alias("nb"), F.col("bits").alias("xb"))
        both = _with_partner(pairs.join(x, "a"), y)
        both = both.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
        return both.withColumn("est", estimate(F.col("xa"), F.col("xb"))).where(F.col("est") >= percent / 100 - MARGIN).select("a", "b", "est")

    def _with_partner(pairs: DataFrame, facts: DataFrame) -> DataFrame:
        """pairs (a, b, ...) with facts (b, ...).  A text that stands in the middle of a large group is b of many pairs."""
        pairs = keep(pairs, "pairs")
        often = keep(pairs.groupBy("b").agg(F.count("*").alias("n")), "partners")
        return salted_join(pairs, facts, ["b"], F.col("a"), hot_keys(often, ["b"]))

    def confirmed(pairs: DataFrame) -> DataFrame:
        x = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
        y = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
        both = _with_partner(pairs, y).join(x, "a").withColumn("both", F.size(F.array_intersect("sa", "sb")))
        return both.where(100 * F.col("both") >= percent * (F.size("sa") + F.size("sb") - F.col("both"))).select("a", "b")

    def by_key(big: DataFrame, small: DataFrame, how: str = "inner") -> DataFrame:
        return salted_join(big, small, ["key"], F.col("id"), hot, how)

    def member(comp: DataFrame | None) -> DataFrame:
        """(key, id, comp) of the band keys that more than one component has."""
        if comp is None:
            return mates.select("key", "id", F.col("id").alias("comp"))
        m = mates.join(comp, "id", "left").select("key", "id", F.coalesce("comp", "id").alias("comp"))
        split = m.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("key")
        return by_key(m, split)

    degree = some.select("id", "degree")
    links = comp = centres = None
    for turn in range(ROUNDS):
        m = keep(member(comp), "split-mates")
        if m.isEmpty():
            break
        # first the text that shares most bands with others, which is the likeliest to be a group's source; then any
        order = F.struct(F.col("degree"), F.col("id"), F.col("comp")) if turn == 0 else F.struct(F.xxhash64(F.lit(turn), "key", "id").alias("h"), F.col("id"), F.col("comp"))
        hub = keep((m.join(degree, "id") if turn == 0 else m).groupBy("key").agg(F.max(order).alias("h")), "hubs")
        if turn == 0:
            centres = by_key(mates.select("key", "id"), hub).groupBy("id").agg(F.max(F.struct("h.degree", "h.id")).alias("c")).select("id", F.col("c.id").alias("centre"))
            centres = keep(centres, "centres")
        spokes = by_key(m, hub.select("key", F.col("h.id").alias("b"), F.col("h.comp").alias("bc")))
        spokes = spokes.where("comp <> bc").select(F.col("id").alias("a"), "b").distinct()
        best = similar(spokes).groupBy("a").agg(F.max(F.struct("est", "b")).alias("m")).select("a", F.col("m.b").alias("b"))
        new = keep(confirmed(best), "links")
        links = new if links is None else links.unionAll(new)
        comp = components(links, keep)

    m = keep(member(comp), "split-mates")
    if not m.isEmpty():
        most = m.groupBy("key", "comp").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "comp")).alias("m"), F.sum("n").alias("size")).select("key", "size", F.col("m.comp").alias("main"))
        there = m.select("id").distinct().join(centres, "id")
        often = keep(there.groupBy("centre").agg(F.count("*").alias("n")), "common-centres")
        facts = keep(_profiles(there, sets, hot_keys(often, ["centre"])).join(bits.select("id", "bits"), "id"), "profiles")
        rows = by_key(m, most).join(facts, "id").withColumn("minor", F.col("comp") != F.col("main"))
        blocks = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / BLOCK))).groupBy("key", "block")
        blocks = blocks.agg(F.collect_list(F.struct(*BLOCK_FIELDS)).alias("y"))  # about BLOCK rows each
        blocks = keep(blocks, "blocks")
        x = blocks.select("key", F.filter("y", lambda r: r["minor"]).alias("x")).where(F.size("x") > 0)
        parts = F.coalesce("_parts", F.lit(1))
        x = x.join(F.broadcast(hot), "key", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
        y = blocks.join(F.broadcast(hot), "key", "left").withColumn("part", F.pmod(F.xxhash64("block"), parts).cast("int"))
        pairs = _likely(x.join(y.select("key", "part", "y"), ["key", "part"]).select("x", "y"), percent)
        rest = keep(confirmed(pairs.distinct()), "links")
        comp = components(rest if links is None else links.unionAll(rest), keep)
    return comp


def _first_rows(rows: DataFrame, classes: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose sets are wanted: of each class that has candidates, those with the class's least id."""
    least = classes.join(ids, "id", "left_semi").select(F.col("least").alias("wanted")).distinct()
    if small_enough(least, F.octet_length(F.col("wanted").cast("string"))):
        least = F.broadcast(least)
    return rows.join(least, F.col("id") == F.col("wanted"), "left_semi").select("text")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with all their columns, that stand for their group: one for each component.

    Null and empty texts stay, as do rows without id.  Of rows that repeat (id and text) one stays; rows with one id and
    different texts are judged each by its own text.  An empty table gives no rows.
    """
    groups = _groups(docs, id_col, text_col, k, percent).where("id is not null")
    i, h, ok, many = (fresh(docs.columns, n) for n in ("group_id", "group_hash", "group_kept", "group_rows"))
    decided = groups.groupBy(F.col("id").alias(i), F.col("h").alias(h)).agg(F.bool_or("kept").alias(ok), F.count("*").alias(many))
    decided = stored(decided.where(~quoted(ok) | (quoted(many) > 1)), "decided")
    own = docs.where(quoted(id_col).isNotNull())
    same = (quoted(id_col) == F.col(i)) & (F.xxhash64(quoted(text_col)) == F.col(h))
    odd = F.broadcast(decided) if small_enough(decided) else decided
    left = own.join(odd, same, "left")
    once = left.where(F.col(i).isNull()).select(docs["*"])
    again = left.where(F.col(ok)).select(docs["*"], F.xxhash64(quoted(text_col)).alias(h)).dropDuplicates([id_col, h]).drop(h)
    return once.unionAll(again).unionAll(docs.where(quoted(id_col).isNull()))
