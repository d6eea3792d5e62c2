"""Queries on null shares, sample sizes, crossover intervals and posteriors, with their SQL."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from lodestrata.functions import stats
from lodestrata.operators import inference as inf
from lodestrata.plans.ranking import table

Z_ALPHA, Z_POWER = NormalDist().inv_cdf(0.975), NormalDist().inv_cdf(0.8)


def _mixed_tests(spark, sf):
    """A quarter of the tests has small p, the others spread over all of (0, 1)."""
    k = F.col("p_partkey")
    return table(spark, sf, "part").select((F.col("p_size") % 3).cast("long").alias("family"), k.alias("id"), (F.when(k % 4 == 0, 0.02).otherwise(1.0) * ((k * 7919 % 10007 + 1) / 10008)).alias("p"))


def null_share(spark, sf):
    return inf.null_share(_mixed_tests(spark, sf)).select("family", F.round("pi0", 9).alias("pi0"))


def storey_q_smoothed(spark, sf):
    """q values with the share of true nulls smoothed over 19 points."""
    t = _mixed_tests(spark, sf)
    return inf.step_up(t.join(inf.null_share(t), "family"), F.col("pi0")).select("family", "id", F.round("adjusted", 9).alias("adjusted"))


def sample_size_grid(spark, sf):
    """Rows a group to tell two shares apart, the normal deviate of the power of 100 rows, and the least effect that they show."""
    g = spark.range(1, 10).select((F.col("id") / 10).alias("p1")).crossJoin(spark.range(1, 10).select((F.col("id") / 10).alias("p2"))).where("p1 <> p2")
    a, b = F.col("p1"), F.col("p2")
    pooled, own = (a + b) / 2, a * (1 - a) + b * (1 - b)
    spread = Z_ALPHA * F.sqrt(2 * pooled * (1 - pooled)) + Z_POWER * F.sqrt(own)
    return g.select("p1", "p2", F.ceil(F.pow(spread / F.abs(a - b), 2.0)).alias("n"), F.round((F.abs(a - b) - Z_ALPHA * F.sqrt(2 * pooled * (1 - pooled) / 100)) / F.sqrt(own / 100), 6).alias("z_power"), F.round((Z_ALPHA + Z_POWER) * F.sqrt(2 * a * (1 - a) / 100), 6).alias("least_effect"))


def _cells(spark, sf):
    li = table(spark, sf, "lineitem")
    hit, open_ = F.col("l_quantity") > 10 + 4 * F.col("l_linenumber"), F.col("l_linestatus") == "O"
    return li.groupBy(F.col("l_returnflag").alias("key"), F.col("l_linenumber").cast("long").alias("x")).agg(F.count_if(open_ & hit).alias("a"), F.count_if(open_).alias("na"), F.count_if(~open_ & hit).alias("b"), F.count_if(~open_).alias("nb"))


def crossover_ci(spark, sf):
    """Where one line status first recovers more than the other, by return flag, with a bootstrap interval."""
    return inf.crossover_interval(_cells(spark, sf)).select("key", *[F.round(c, 6).alias(c) for c in ("point", "low", "high", "exists")])


def superiority_chance(spark, sf):
    """The chance that one line status has the greater share, by return flag and line number, drawn from both posteriors."""

    def run(frames):
        for f in frames:
            f["chance"] = [round(stats.chance_above((a, na), (b, nb)), 6) for a, na, b, nb in zip(f["a"], f["na"], f["b"], f["nb"])]
            yield f[["key", "x", "chance"]]

    return _cells(spark, sf).mapInPandas(run, "key string, x long, chance double")


FUNCTIONS = (null_share, storey_q_smoothed, sample_size_grid, crossover_ci, superiority_chance)

_SHARE = " + ".join(f"{w!r}::DOUBLE * ((count(*) FILTER (p > {x}::DOUBLE)) / (count(*) * (1 - {x}::DOUBLE)))" for w, x in zip(inf.end_weights(), inf.LAMBDAS))
_MIXED = f"t AS (SELECT CAST(p_size % 3 AS BIGINT) AS family, p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN 0.02::DOUBLE ELSE 1.0::DOUBLE END * ((p_partkey * 7919 % 10007 + 1) / 10008) AS p FROM part), s AS (SELECT family, least({_SHARE}, 1) AS pi0 FROM t GROUP BY family)"

SQL = {
    "null_share": f"WITH {_MIXED} SELECT family, round(pi0, 9) AS pi0 FROM s",
    "storey_q_smoothed": f"WITH {_MIXED}, r AS (SELECT t.*, pi0, count(*) OVER (PARTITION BY family) AS m, row_number() OVER (PARTITION BY family ORDER BY p, id) AS k FROM t JOIN s USING (family)) SELECT family, id, round(least(min(m / k * p) OVER (PARTITION BY family ORDER BY p DESC, id DESC) * pi0, 1), 9) AS adjusted FROM r",
    "sample_size_grid": f"WITH g AS (SELECT a / 10 AS p1, b / 10 AS p2 FROM range(1, 10) x(a), range(1, 10) y(b) WHERE a <> b), h AS (SELECT *, (p1 + p2) / 2 AS p, p1 * (1 - p1) + p2 * (1 - p2) AS own FROM g) SELECT p1, p2, CAST(ceil(power(({Z_ALPHA!r}::DOUBLE * sqrt(2 * p * (1 - p)) + {Z_POWER!r}::DOUBLE * sqrt(own)) / abs(p1 - p2), 2)) AS BIGINT) AS n, round((abs(p1 - p2) - {Z_ALPHA!r}::DOUBLE * sqrt(2 * p * (1 - p) / 100)) / sqrt(own / 100), 6) AS z_power, round(({Z_ALPHA!r}::DOUBLE + {Z_POWER!r}::DOUBLE) * sqrt(2 * p1 * (1 - p1) / 100), 6) AS least_effect FROM h",
}
