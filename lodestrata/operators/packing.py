"""Packing a ranking into a token budget, and the control rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions import text as tx


def pack(ranked: DataFrame, docs: DataFrame, budget: int) -> DataFrame:
    """The longest prefix of each ranking (qid, doc, rank) whose costs fit; nothing after the first overflow."""
    if budget < 0:
        raise ValueError("the budget can't be negative")
    costs = docs.select("doc", tx.token_cost(F.col("text")).alias("cost"))
    w = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return costs.join(ranked, "doc").withColumn("used", F.sum("cost").over(w)).where(F.col("used") <= budget)


def pack_counts(queries: DataFrame, packed: DataFrame) -> DataFrame:
    """(qid, n_docs, tokens) for every query (qid, ...), those with nothing packed too."""
    got = packed.groupBy("qid").agg(F.count("*").alias("n_docs"), F.max("used").alias("tokens"))
    zero = F.lit(0).cast("long")
    return queries.select("qid").join(got, "qid", "left").select("qid", F.coalesce("n_docs", zero).alias("n_docs"), F.coalesce("tokens", zero).alias("tokens"))


def corpus_prefix(docs: DataFrame, budget: int, order: tuple[str, ...] = ("doc",)) -> DataFrame:
    """Documents in corpus order, or that of the columns ``order`` (doc among them), as long as they fit, for one query.

    Running sums are made by ranges of ids, then shifted by the ranges' totals: no task holds the corpus.
    """
    spark = docs.sparkSession
    sized = docs.select(*order, tx.token_cost(F.col("text")).alias("cost")).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("part", F.spark_partition_id())
    sums = sized.groupBy("part").agg(F.sum("cost").alias("c"), F.count("*").alias("n")).orderBy("part").collect()  # one row a task
    rows, used, seen = [], 0, 0
    for r in sums:
        rows.append((r["part"], used, seen))
        used, seen = used + r["c"], seen + r["n"]
    shift = spark.createDataFrame(rows, "part int, used0 long, seen0 long")
    w = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = sized.join(F.broadcast(shift), "part").withColumn("used", F.sum("cost").over(w) + F.col("used0"))
    out = out.withColumn("rank", F.row_number().over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long") + F.col("seen0"))
    return out.where(F.col("used") <= budget).select(*order, "rank", "cost", "used")


def shuffled(docs: DataFrame, seed: int, budget: int) -> DataFrame:
    """Documents in an order that a hash of seed and id gives, as long as they fit."""
    key = F.md5(F.concat(F.lit(f"{seed}/"), F.col("doc").cast("string")).cast("binary"))
    return corpus_prefix(docs.select("doc", "text", key.alias("key")), budget, ("key", "doc"))
