"""Benchmark decontamination by winnowing, in DataFrame functions alone.

Texts become arrays of words; a k-gram is hashed at each word; a window of ``w`` consecutive k-grams is represented by
its least hash.  With k + w - 1 = 10 words, the window of k-grams that begins at a word covers exactly the ten words
from there, so two texts that share ten consecutive words share that window's fingerprint: nothing is lost.
Fingerprints of the test items are joined with those at each place of the documents; only documents with a common
fingerprint are read again, and only at those places are the ten words themselves compared (hits extend over the union
of such windows).  Items of under ten words are one window each, found by the hash of all their words.  What is shuffled
are row numbers, places and fingerprints; whole texts only if too many documents have one for a broadcast of their ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import Scratch, fresh, named, quoted, small_enough, stored

SPAN = 10
GRAM = 5

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Lower-case A-Z only, then the runs of letters, digits and non-ASCII characters; null has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower()), _BETWEEN), "")


def _run(words: Column, i: Column, n: int) -> list[Column]:
    return [F.get(words, i + j) if j else F.get(words, i) for j in range(n)]


def _first(values: Column, n: Column) -> Column:
    return F.slice(values, 1, F.greatest(n, F.lit(0)))


def gram_hashes(words: str, n_words: str, n: int) -> Column:
    """The hash of n words at each word that has n - 1 after it."""
    w = F.col(words)
    every = F.transform(w, lambda x, i: F.xxhash64(F.lit(n), x, *_run(w, i, n)[1:]))
    return _first(every, F.col(n_words) - F.lit(n - 1))


def window_minima(grams: str, n_words: str, span: int, k: int) -> Column:
    """The least of span - k + 1 consecutive hashes, for each run of span words."""
    g = F.col(grams)
    every = F.transform(g, lambda x, i: F.least(x, *[F.get(g, i + j) for j in range(1, span - k + 1)]))
    return _first(every, F.col(n_words) - F.lit(span - 1))


def _windowed(rows: DataFrame, span: int, short: list[int]) -> DataFrame:
    """rows with words as _w, their count as _n; adds _m10 (fingerprints by window) and _m1.. for the short lengths."""
    rows = rows.withColumn("_g", gram_hashes("_w", "_n", GRAM))
    rows = rows.withColumn(f"_m{span}", window_minima("_g", "_n", span, GRAM)).drop("_g")
    for n in short:
        rows = rows.withColumn(f"_m{n}", gram_hashes("_w", "_n", n))
    return rows


def item_windows(items: DataFrame, id_col: str, text_col: str, span: int = SPAN) -> DataFrame:
    """(n, fp, window, items): the different runs of span words of the items, or whole items if shorter, each with the
    items that hold it.  Items without id are left out."""
    rows = items.select(quoted(id_col).cast("string").alias("item"), words_of(quoted(text_col)).alias("_w"))
    rows = rows.where("item is not null").withColumn("_n", F.size("_w")).where("_n > 0")
    w = F.col("_w")
    long = _windowed(rows.where(F.col("_n") >= span), span, [])
    pairs = F.transform(F.col(f"_m{span}"), lambda x, i: F.struct(F.concat_ws(" ", *_run(w, i, span)).alias("window"), x.alias("fp")))
    out = long.select("item", F.lit(span).alias("n"), F.inline(pairs))
    whole = F.lit(None).cast("long")
    for n in range(1, span):
        whole = F.when(F.col("_n") == n, F.xxhash64(F.lit(n), *[F.get(w, F.lit(j)) for j in range(n)])).otherwise(whole)
    short = rows.where(F.col("_n") < span).select("item", F.col("_n").alias("n"), F.concat_ws(" ", "_w").alias("window"), whole.alias("fp"))
    return out.unionByName(short).groupBy("n", "fp", "window").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _places(mins: str, n: int) -> Column:
    """(s, len, fp) of each window of n words."""
    return F.transform(F.col(mins), lambda x, i: F.struct(i.alias("s"), F.lit(n).alias("len"), x.alias("fp")))


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    span: int = SPAN,
) -> DataFrame:
    """One row per row of docs: id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and empty texts have no words and are clean.  Rows that repeat are answered each for itself, as are rows
    whose id is null.  Items that repeat under one id count once; an empty item table leaves all documents clean.
    Other columns are ignored, whatever their names; an output that is named like the id gets an underscore in front.
    """
    out = _hits(docs, items, id_col, text_col, item_id_col, item_text_col, span)
    out = out.select(
        F.col("_id").alias("id"),
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )
    return out.toDF(id_col, *named([id_col], out.columns[1:]))


def _hits(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_id_col: str, item_text_col: str, span: int) -> DataFrame:
    """(_id, _h, n_words, n_hit, items) for each row of docs; _h: the text's hash; n_hit and items null where there are none."""
    spark = docs.sparkSession
    rows = docs.select(quoted(id_col).alias("_id"), quoted(text_col).alias("_t")).withColumn("_h", F.xxhash64("_t"))
    with Scratch(spark) as keep:
        windows = keep(item_windows(items, item_id_col, item_text_col, span), "item-windows")
        lengths = sorted(r["n"] for r in windows.select("n").distinct().collect())  # ten rows at most
        short = [n for n in lengths if n < span]
        fps = keep(windows.select("n", "fp").distinct(), "fingerprints")
        fps = F.broadcast(fps) if small_enough(fps) else fps

        # the first place of each row stands for the row, so rows without hits stay; the others only if an item has them
        placed = rows.select(F.monotonically_increasing_id().alias("_row"), "_id", "_h", words_of(F.col("_t")).alias("_w")).withColumn("_n", F.size("_w"))
        placed = _windowed(placed, span, short)
        row = F.array(F.struct(F.lit(-1).alias("s"), F.lit(0).alias("len"), F.xxhash64("_row").alias("fp")))  # any fp: no window has length 0
        every = F.concat(row, *[_places(f"_m{n}", n) for n in [span, *short]])
        placed = placed.select("_row", "_id", "_h", "_n", F.explode(every).alias("p")).select("_row", "_id", "_h", "_n", "p.*")
        if lengths:
            there = fps.select(F.col("n").alias("_n2"), F.col("fp").alias("_fp2"), F.lit(True).alias("there"))
            placed = placed.join(there, (F.col("fp") == F.col("_fp2")) & (F.col("len") == F.col("_n2")), "left").where("s < 0 or there")
        else:
            placed = placed.where("s < 0")
        found = placed.groupBy("_row", "_id", "_h", "_n").agg(F.collect_list(F.when(F.col("s") >= 0, F.struct("s", "len"))).alias("places"))
        found = keep(found.select("_id", "_h", F.col("_n").cast("long").alias("n_words"), "places"), "places")

        some = found.where(F.size("places") > 0).select(F.col("_id").alias("_id2"), F.col("_h").alias("_h2"), "places")
        some = keep(some.dropDuplicates(["_id2", "_h2"]), "hit-documents")
        same = F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_h") == F.col("_h2"))
        few = small_enough(some, 8 * F.size("places"))
        again = rows.join(F.broadcast(some) if few else some, same).select("_id", "_h", "places", words_of(F.col("_t")).alias("_w"))
        again = again.select("_id", "_h", F.inline(F.transform("places", lambda p: F.struct(p["s"].alias("s"), p["len"].alias("n"), F.concat_ws(" ", F.slice("_w", p["s"] + 1, p["len"])).alias("window")))))
        again = again.distinct()  # of rows that repeat
        known = windows.select("n", "window", "items")
        chars = F.octet_length("window") + F.aggregate("items", F.lit(0), lambda a, x: a + 16 + F.octet_length(x))
        hits = again.join(F.broadcast(known) if small_enough(known, chars) else known, ["n", "window"])
        hits = keep(hits.select("_id", "_h", "s", "n", "items"), "hits")

        covered = hits.select("_id", "_h", F.explode(F.sequence("s", F.col("s") + F.col("n") - 1)).alias("at")).distinct()
        covered = covered.groupBy("_id", "_h").agg(F.count("*").alias("n_hit")).select(F.col("_id").alias("_id3"), F.col("_h").alias("_h3"), "n_hit")
        named_ = hits.groupBy("_id", "_h").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))  # lists that windows share come once
        both = named_.join(covered, F.col("_id").eqNullSafe(F.col("_id3")) & (F.col("_h") == F.col("_h3")))
        both = keep(both.select(F.col("_id").alias("_id2"), F.col("_h").alias("_h2"), "n_hit", "items"), "answers")
        size = 16 + F.aggregate("items", F.lit(0), lambda a, x: a + 16 + F.octet_length(x))
        out = found.join(F.broadcast(both) if small_enough(both, size) else both, same, "left")
        return stored(out.select("_id", "_h", "n_words", "n_hit", "items"), "contamination")


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that hold no window of any item.

    Each row is judged by its own text: null and empty texts stay, rows that repeat stay or go together, rows with one id
    and different texts each for itself.  An empty item table drops nothing; an empty table gives no rows.
    """
    bad = _hits(docs, items, id_col, text_col, item_id_col, item_text_col, SPAN).where("n_hit is not null").select("_id", "_h").distinct()
    bad = stored(bad, "contaminated")
    k, h = fresh(docs.columns, "bad_id"), fresh(docs.columns, "bad_hash")
    bad = bad.toDF(k, h)
    same = quoted(id_col).eqNullSafe(F.col(k)) & (F.xxhash64(quoted(text_col)) == F.col(h))
    return docs.join(F.broadcast(bad) if small_enough(bad) else bad, same, "left_anti")
