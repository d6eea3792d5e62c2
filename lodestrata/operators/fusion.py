"""Rank fusion and score fusion over (ranker, qid, doc, score or rank)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.operators.lexical import exact_sum


def reciprocal_rank(rankings: DataFrame, k: float = 60.0, first: int = 1) -> DataFrame:
    """Sum of 1 / (k + rank) over rankers.  rankings.rank counts from 1; first says what the best rank counts as (0 or 1)."""
    if k <= 0:
        raise ValueError("k must be positive")
    return rankings.groupBy("qid", "doc").agg(exact_sum(1e6 / (k + F.col("rank") - 1 + first)).alias("x")).select("qid", "doc", (F.col("x") / 1e6).alias("score"))


def min_max(scores: DataFrame) -> DataFrame:
    """Scores of a ranker and query mapped to 0..1; all 0 where they are equal."""
    w = Window.partitionBy("ranker", "qid")
    low, high = F.min("score").over(w), F.max("score").over(w)
    return scores.withColumn("norm", F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(F.lit(0.0)))


def combine(scores: DataFrame, how: str) -> DataFrame:
    """how: sum; mnz (times the rankers above 0); anz (over the rankers above 0, 0 if none)."""
    got = min_max(scores).groupBy("qid", "doc").agg(exact_sum(F.col("norm")).alias("s"), F.count_if(F.col("norm") > 0).alias("n"))
    score = {"sum": F.col("s"), "mnz": F.col("s") * F.col("n"), "anz": F.when(F.col("n") > 0, F.col("s") / F.col("n")).otherwise(F.lit(0.0))}[how]
    return got.select("qid", "doc", score.alias("score"))
