"""Tasks by arms in one plan: rank, pack, score, and the table of recovery by arm and depth."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions import text as tx
from lodestrata.operators import graph
from lodestrata.sources import tables


def _overlap(tasks: DataFrame, items: DataFrame) -> DataFrame:
    both = items.join(F.broadcast(tasks), "task_id")
    score = tx.jaccard(F.array_distinct(tx.tokens(F.col("query"))), F.array_distinct(tx.tokens(F.col("text"))))
    return both.select("task_id", "pos", "item_id", "text", score.alias("score"))


def run(tasks: DataFrame, items: DataFrame, gold: DataFrame, edges: DataFrame, budget: int = 150, hops: int = 3) -> DataFrame:
    """(arm, depth, recovery, recall, tokens): none packs nothing, words ranks by shared words, walk follows links from the best match."""
    scored = _overlap(tasks, items)
    w = Window.partitionBy("task_id").orderBy(F.round("score", 12).desc(), "pos")
    words = scored.withColumn("rank", F.row_number().over(w)).select(F.lit("words").alias("arm"), "task_id", "item_id", "text", "rank")
    seeds = words.where("rank = 1").select(F.col("item_id").alias("seed"), "task_id")
    seen = graph.reach(edges, seeds.select("seed"), hops, "out").join(seeds, "seed")
    order = Window.partitionBy("task_id").orderBy("depth", "node")
    walk = seen.withColumn("rank", F.row_number().over(order)).join(items.select(F.col("item_id").alias("node"), "text"), "node")
    walk = walk.select(F.lit("walk").alias("arm"), "task_id", F.col("node").alias("item_id"), "text", "rank")
    used = F.sum(tx.token_cost(F.col("text"))).over(Window.partitionBy("arm", "task_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    packed = words.unionByName(walk).withColumn("used", used).where(F.col("used") <= budget)
    arms = tasks.select("task_id", "depth").crossJoin(tasks.sparkSession.createDataFrame([("none",), ("words",), ("walk",)], "arm string"))
    hits = packed.join(gold, ["task_id", "item_id"], "left_semi").groupBy("arm", "task_id").agg(F.count("*").alias("hits"))
    need = gold.groupBy("task_id").agg(F.count("*").alias("need"))
    cost = packed.groupBy("arm", "task_id").agg(F.max("used").alias("tokens"))
    rows = arms.join(need, "task_id").join(hits, ["arm", "task_id"], "left").join(cost, ["arm", "task_id"], "left")
    hit = F.coalesce("hits", F.lit(0))
    return rows.groupBy("arm", "depth").agg(F.round(F.avg((hit == F.col("need")).cast("double")), 6).alias("recovery"), F.round(F.avg(hit / F.col("need")), 6).alias("recall"), F.round(F.avg(F.coalesce("tokens", F.lit(0))), 6).alias("tokens"))


def e2e_depth_crossover(spark, sf):
    return run(*tables.chain_tasks(spark))


FUNCTIONS = (e2e_depth_crossover,)
SQL: dict[str, str] = {}
