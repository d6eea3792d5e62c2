"""Statistical and closed-form queries, with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestrata.functions import stats, theory
from lodestrata.operators import inference as inf
from lodestrata.operators.lexical import exact_sum
from lodestrata.plans.ranking import table


def _tests(spark, sf):
    return table(spark, sf, "part").select(F.col("p_brand").alias("family"), F.col("p_partkey").alias("id"), ((F.col("p_partkey") * 7919 % 10007 + 1) / 10008 * ((F.col("p_partkey") % 7 + 1) / 70)).alias("p"))


def _adjusted(df):
    return df.select("family", "id", F.round("adjusted", 9).alias("adjusted"))


def holm(spark, sf):
    return _adjusted(inf.holm(_tests(spark, sf)))


def benjamini_hochberg(spark, sf):
    return _adjusted(inf.step_up(_tests(spark, sf)))


def benjamini_yekutieli(spark, sf):
    return _adjusted(inf.step_up(inf.by_family(_tests(spark, sf), "h", F.count("*"), inf.harmonic), F.col("h")))


def storey_q(spark, sf):
    """pi0 by the single point lambda = 0.05, for each family."""
    t = _tests(spark, sf)
    share = F.avg((F.col("p") > 0.05).cast("double"))
    return _adjusted(inf.step_up(inf.by_family(t, "pi0", share, lambda x: F.least(x / 0.95, F.lit(1.0))), F.col("pi0")))


def _blocks(spark, sf):
    """Mean discount by order date's year (block) and line number (treatment)."""
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    rows = li.join(o, li["l_orderkey"] == o["o_orderkey"])
    return rows.groupBy(F.year("o_orderdate").cast("long").alias("block"), F.col("l_linenumber").cast("long").alias("treatment")).agg(F.round(F.avg("l_quantity"), 9).alias("v"))


def avg_ranks(spark, sf):
    r = inf.ranks(_blocks(spark, sf), "block", "v")
    return r.groupBy("treatment").agg(F.round(F.avg("rank"), 6).alias("mean_rank"))


def friedman_stat(spark, sf):
    """Friedman's statistic with its tie correction, and its p."""
    r = inf.ranks(_blocks(spark, sf), "block", "v")
    ties = r.groupBy("block", "v").agg(F.count("*").alias("t")).agg(F.sum(F.pow(F.col("t").cast("double"), 3) - F.col("t")).alias("ties"))
    s = r.groupBy("treatment").agg(F.sum("rank").alias("r"), F.count("*").alias("n")).agg(F.sum(F.col("r") ** 2).alias("r2"), F.count("*").alias("k"), F.max("n").alias("n"))
    n, k = F.col("n"), F.col("k")
    c = 1 - F.col("ties") / (n * (F.pow(k.cast("double"), 3) - k))
    return s.join(F.broadcast(ties)).select(F.round((12 / (n * k * (k + 1)) * F.col("r2") - 3 * n * (k + 1)) / c, 6).alias("statistic"), n.alias("n"), k.alias("k"))


# Studentized range at 0.05 over the root of 2, by number of treatments from 2 on.
NEMENYI = (1.960, 2.344, 2.569, 2.728, 2.850, 2.949, 3.031, 3.102, 3.164, 3.219, 3.268, 3.313, 3.354, 3.391, 3.426, 3.458, 3.489, 3.517, 3.544)


def nemenyi_cd(spark, sf):
    """Critical difference for mean ranks of 2 to 20 treatments at 0.05."""
    s = _blocks(spark, sf).agg(F.countDistinct("block").alias("n"), F.countDistinct("treatment").alias("k"))
    q = F.get(F.array(*[F.lit(x) for x in NEMENYI]), (F.col("k") - 2).cast("int"))
    q = F.coalesce(q, F.raise_error(F.lit("the table holds 2 to 20 treatments")).cast("double"))
    return s.select(F.round(q * F.sqrt(F.col("k") * (F.col("k") + 1) / (6 * F.col("n"))), 6).alias("cd"))


def cliffs_delta(spark, sf):
    got = inf.superiority(table(spark, sf, "lineitem"), "l_returnflag", "A", "N", "l_extendedprice")
    size = F.abs("delta")
    return got.select(F.round("cles", 6).alias("cles"), F.round("delta", 6).alias("delta"), F.when(size < 0.147, "negligible").when(size < 0.33, "small").when(size < 0.474, "medium").otherwise("large").alias("magnitude"))


def _two(spark, sf):
    m = inf.moments(table(spark, sf, "lineitem").where(F.col("l_returnflag").isin("A", "N")), "l_returnflag", "l_quantity")
    return m.agg(*[F.max(F.when(F.col("l_returnflag") == g, F.col(c))).alias(f"{c}_{g}") for g in ("A", "N") for c in ("n", "mean", "var")])


def cohens_d(spark, sf):
    na, nb = F.col("n_A"), F.col("n_N")
    pooled = F.sqrt(((na - 1) * F.col("var_A") + (nb - 1) * F.col("var_N")) / (na + nb - 2))
    return _two(spark, sf).select(F.round((F.col("mean_A") - F.col("mean_N")) / pooled, 6).alias("d"))


def tost_moments(spark, sf):
    """Welch statistics of the two one-sided tests against a margin of one unit."""
    sa, sb = F.col("var_A") / F.col("n_A"), F.col("var_N") / F.col("n_N")
    se, d = F.sqrt(sa + sb), F.col("mean_A") - F.col("mean_N")
    df = (sa + sb) ** 2 / (sa**2 / (F.col("n_A") - 1) + sb**2 / (F.col("n_N") - 1))
    return _two(spark, sf).select(F.round((d + 1) / se, 6).alias("t_lower"), F.round((d - 1) / se, 6).alias("t_upper"), F.round(df, 4).alias("df"))


def _table22(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.agg(*[F.count_if((F.col("l_linestatus") == s) & ((F.col("l_quantity") > 25) == h)).alias(n) for n, s, h in (("a", "O", True), ("b", "O", False), ("c", "F", True), ("d", "F", False))])


def cohens_h_odds(spark, sf):
    a, b, c, d = (F.col(x) for x in "abcd")
    h = 2 * F.asin(F.sqrt(a / (a + b))) - 2 * F.asin(F.sqrt(c / (c + d)))
    return _table22(spark, sf).select(F.round(h, 6).alias("h"), F.round((a + 0.5) * (d + 0.5) / ((b + 0.5) * (c + 0.5)), 6).alias("odds_ratio"))


def mcnemar_counts(spark, sf):
    lab = table(spark, sf, "labels")
    return lab.agg(F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("b"), F.count_if((F.col("quality") == 0) & (F.col("toxic") == 1)).alias("c"))


def meta_dl(spark, sf):
    """Each line number is a study: its mean discount, and that mean's variance."""
    s = table(spark, sf, "lineitem").groupBy("l_linenumber").agg(F.avg("l_discount").alias("effect"), (F.var_samp("l_discount") / F.count("*")).alias("variance"))
    got = inf.random_effects(s)
    return got.select("k", *[F.round(c, 6).alias(c) for c in ("q", "i2")], *[F.round(c, 9).alias(c) for c in ("fixed", "pooled", "se")])


def mutual_info(spark, sf):
    return inf.mutual_information(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus").select(F.round("bits", 6).alias("bits"))


def _bets(spark, sf):
    e = table(spark, sf, "events")
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    return e.select(F.col("user_id").alias("key"), nth.alias("nth"), (F.get_json_object("props", "$.k").cast("double") / 100).alias("x"))


def eprocess_path(spark, sf):
    return inf.betting_path(_bets(spark, sf), 0.3, 1.0).select("key", "nth", F.round(F.log("capital"), 6).alias("log_capital"))


def eprocess_stop(spark, sf):
    path = inf.betting_path(_bets(spark, sf), 0.3, 1.0).withColumn("capital", F.round("capital", 9))
    return inf.first_rejection(path, 0.05)


def ecdf_dominance(spark, sf):
    got = inf.largest_ecdf_gaps(table(spark, sf, "lineitem"), "l_returnflag", "A", "R", "l_extendedprice")
    return got.select(F.round("above", 6).alias("above"), F.round("below", 6).alias("below"))


def conformal_q(spark, sf):
    li = table(spark, sf, "lineitem").select("l_returnflag", F.abs(F.col("l_quantity") - 25.5).alias("r"))
    return inf.conformal_half_width(li, "l_returnflag", "r", 0.1)


def decay_fit(spark, sf):
    """ln of the mean tax-free share over line numbers, as a straight line."""
    s = table(spark, sf, "lineitem").groupBy("l_linenumber").agg(F.log(F.avg("l_extendedprice")).alias("y"))
    x = F.col("l_linenumber").cast("double")
    return s.agg(F.round(F.regr_slope("y", x), 9).alias("slope"), F.round(F.regr_intercept("y", x), 6).alias("intercept"), F.round(F.regr_r2("y", x), 6).alias("r2"))


def link_fit(spark, sf):
    """Quality of one link from recovery by depth: through the origin in logs, at most 1."""
    s = table(spark, sf, "lineitem").groupBy("l_linenumber").agg(F.avg((F.col("l_quantity") > 5).cast("double")).alias("p"))
    d = F.col("l_linenumber")
    return s.agg(F.round(F.least(F.exp(F.sum(d * F.log("p")) / F.sum(d * d)), F.lit(1.0)), 6).alias("q"))


def mediation(spark, sf):
    got = inf.mediation(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", "l_discount")
    return got.select(*[F.round(c * F.lit(1e6), 3).alias(n) for c, n in ((F.col("total"), "total"), (F.col("direct"), "direct"), (F.col("indirect"), "indirect"))])


def partial_corr(spark, sf):
    got = inf.partial_correlation(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", "l_discount")
    return got.select(F.round("partial", 6).alias("partial"), F.round("semipartial", 6).alias("semipartial"))


def g_computation(spark, sf):
    """Mean outcome with and without treatment after a linear adjustment for one covariate."""
    li = table(spark, sf, "lineitem").select((F.col("l_linestatus") == "O").cast("double").alias("t"), F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"))
    s = li.agg(*[F.covar_samp(a, b).alias(a + b) for a, b in (("t", "t"), ("t", "x"), ("x", "x"), ("t", "y"), ("x", "y"))], F.count("*").alias("n"))
    ate = (F.col("ty") * F.col("xx") - F.col("xy") * F.col("tx")) / (F.col("tt") * F.col("xx") - F.col("tx") ** 2)
    return s.select(F.round(ate, 9).alias("ate"), "n")


def pinball(spark, sf):
    r = F.col("l_quantity") - 25
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.round(F.avg(F.greatest(0.7 * r, -0.3 * r)), 6).alias("loss"))


def isotonic_trend(spark, sf):
    s = table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").cast("long").alias("depth")).agg(F.avg("l_quantity").alias("m"), F.count("*").alias("n")).orderBy("depth").collect()  # one row a depth
    fit = stats.isotonic([r["m"] for r in s], [float(r["n"]) for r in s], rising=False)
    return spark.createDataFrame([(r["depth"], r["n"], round(f, 6)) for r, f in zip(s, fit)], "depth long, n long, fitted double")


def _resampled(spark, sf, fn, extra=()):
    """Interval of each event type's mean value, resampled within the group by numpy."""
    import pandas as pd

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("event_id")
        point, low, high = fn(f)
        return pd.DataFrame({"event_type": [f["event_type"].iloc[0]], "point": [round(point, 6)], "low": [round(low, 6)], "high": [round(high, 6)]})

    rows = table(spark, sf, "events").select("event_type", "event_id", "user_id", "value").where("value is not null")
    return rows.groupBy("event_type").applyInPandas(run, "event_type string, point double, low double, high double")


def bootstrap_ci(spark, sf):
    return _resampled(spark, sf, lambda f: stats.percentile_ci(f["value"]))


def studentized_ci(spark, sf):
    return _resampled(spark, sf, lambda f: stats.studentized_ci(f["value"]))


def subsample_ci(spark, sf):
    return _resampled(spark, sf, lambda f: stats.subsampling_ci(f["value"]))


def cluster_ci(spark, sf):
    return _resampled(spark, sf, lambda f: stats.cluster_ci(f["value"], f["user_id"]))


def _grid(spark):
    s0 = spark.range(1, 5).select((F.col("id") * 0.2).alias("s0"))
    rho = spark.range(1, 5).select((F.col("id") * 0.2).alias("rho"))
    q = spark.range(1, 5).select((0.6 + F.col("id") * 0.1).alias("q"))
    d = spark.range(1, 9).select(F.col("id").alias("d"))
    return s0.crossJoin(rho).crossJoin(q).crossJoin(d)  # 512 rows


def theory_grid(spark, sf):
    s0, rho, q, d = F.col("s0"), F.col("rho"), F.col("q"), F.col("d").cast("double")
    return _grid(spark).select(*[F.round(c, 6).alias(c) for c in ("s0", "rho", "q")], "d", F.round(theory.similarity_recovery(s0, rho, d), 9).alias("similarity"), F.round(theory.structured_recovery(q, d), 9).alias("structured"), F.round(theory.gap(s0, rho, q, d), 9).alias("gap"))


def crossover_grid(spark, sf):
    g = _grid(spark).where("d = 1")
    return g.select(*[F.round(c, 6).alias(c) for c in ("s0", "rho", "q")], F.round(theory.crossover_depth(F.col("s0"), F.col("rho"), F.col("q")), 6).alias("depth"), F.round(theory.half_life(F.col("rho")), 6).alias("half_life"))


def sensitivity_grid(spark, sf):
    s0, rho, q, d = F.col("s0"), F.col("rho"), F.col("q"), F.col("d").cast("double")
    a, b = theory.similarity_gradients(s0, rho, d)
    return _grid(spark).select(*[F.round(c, 6).alias(c) for c in ("s0", "rho", "q")], "d", F.round(a, 9).alias("by_s0"), F.round(b, 9).alias("by_rho"), F.round(theory.structured_gradient(q, d), 9).alias("by_q"))


def token_economics_grid(spark, sf):
    g = _grid(spark).where("q < 0.75")
    return g.select(*[F.round(c, 6).alias(c) for c in ("s0", "rho")], "d", F.round(theory.return_on_tokens(F.col("s0"), F.col("rho"), F.col("d"), 40), 9).alias("per_1k"))


def capacity_grid(spark, sf):
    p = F.col("id") / 100
    return spark.range(0, 101).select("id", F.round(theory.binary_entropy(p), 9).alias("entropy"), F.round(theory.channel_capacity(p), 9).alias("capacity"))


def supersession_grid(spark, sf):
    n = spark.range(1, 11).select(F.col("id").alias("n"))
    return n.select("n", F.round(theory.supersession_structured(0.9, F.col("n")), 9).alias("structured"), F.round(theory.supersession_similarity(F.col("n")), 9).alias("similarity"), F.round(theory.break_even_quality(F.col("n")), 9).alias("break_even"), F.round(theory.scatter_factor(0.8, F.col("n")), 9).alias("scatter"))


def economics_grid(spark, sf):
    """All of the token economics over the grid, at 40 tokens an item and 3 dollars a million."""
    got = theory.token_economics(F.col("s0"), F.col("rho"), F.col("q"), F.col("d").cast("double"), 40, 3e-6)
    return _grid(spark).where("d <= 4").select(*[F.round(c, 6).alias(c) for c in ("s0", "rho", "q")], "d", *[F.round(c, 9).alias(n) for n, c in got.items() if n not in ("similarity_cost", "cost_ratio", "return_ratio", "similarity_dollars")], *[F.round(F.log(got[n]), 6).alias(f"log_{n}") for n in ("similarity_cost", "cost_ratio", "return_ratio", "similarity_dollars")])


def value_grid(spark, sf):
    """Net value of structure, scattered recovery and elasticities over the grid."""
    s0, rho, q, d = F.col("s0"), F.col("rho"), F.col("q"), F.col("d").cast("double")
    a, b = theory.similarity_gradients(s0, rho, d)
    p = theory.similarity_recovery(s0, rho, d)
    return _grid(spark).select(*[F.round(c, 6).alias(c) for c in ("s0", "rho", "q")], "d", F.round(theory.net_value_gain(s0, rho, q, d, 10, 2), 9).alias("net"), F.round(theory.scattered_recovery(q, d, 0.9, 2), 9).alias("scattered"),
        F.round(theory.elasticity(a, s0, p), 6).alias("by_s0"), F.round(theory.elasticity(b, rho, p), 6).alias("by_rho"), F.round(theory.structured_gradient(q, d) - 0, 9).alias("gap_by_q"))


def crossover_search(spark, sf):
    """The first run of depths up to 64 at which structure wins by more than 0.05, and the depth at which it wins most."""
    d = spark.range(1, 65).select(F.col("id").alias("d"))
    g = _grid(spark).where("d = 1").drop("d").crossJoin(d)
    key = ("s0", "rho", "q")
    w = Window.partitionBy(*key).orderBy("d")
    g = g.withColumn("g", F.round(theory.gap(F.col("s0"), F.col("rho"), F.col("q"), F.col("d").cast("double")), 12)).withColumn("above", F.col("g") > 0.05)
    g = g.withColumn("first", F.min(F.when(F.col("above"), F.col("d"))).over(Window.partitionBy(*key)))
    g = g.withColumn("end", F.min(F.when(~F.col("above") & (F.col("d") > F.col("first")), F.col("d"))).over(Window.partitionBy(*key)))
    got = g.groupBy(*key).agg(F.min("first").alias("d_star"), F.coalesce(F.min("end") - 1, F.when(F.min("first").isNotNull(), F.lit(64))).cast("long").alias("last"), F.min_by("d", F.struct(-F.col("g"), F.col("d"))).alias("peak"))
    return got.select(*[F.round(c, 6).alias(c) for c in key], "d_star", "last", "peak")


def crossover_slopes(spark, sf):
    """How the crossover depth moves with each parameter, by central differences."""
    s0, rho, q = F.col("s0"), F.col("rho"), F.col("q")
    f = theory.crossover_depth
    by = {"s0": theory.central_difference(lambda x: f(x, rho, q), s0), "rho": theory.central_difference(lambda x: f(s0, x, q), rho), "q": theory.central_difference(lambda x: f(s0, rho, x), q)}
    return _grid(spark).where("d = 1").select(*[F.round(c, 6).alias(c) for c in ("s0", "rho", "q")], *[F.round(c, 3).alias(f"by_{n}") for n, c in by.items()])


def path_composition(spark, sf):
    """Survival of mixed paths: an order's lines are hops, typed ones at 0.9 and the others at 0.8 * 0.95^distance."""
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("path"), (F.col("l_linestatus") == "O").alias("typed"), F.col("l_linenumber").alias("i"))
    s = F.when(F.col("typed"), 0.9).otherwise(theory.similarity_at(0.8, 0.95, F.col("i").cast("double")))
    return li.groupBy("path").agg(F.count("*").alias("n_hops"), F.count_if("typed").alias("n_typed"), F.round(exact_sum(F.log(s)), 6).alias("log_survival"), F.round(F.exp(exact_sum(F.log(s))), 6).alias("survival"))


def fano_grid(spark, sf):
    """The least error that so many bits of uncertainty among k choices allow; the bits that it gives back beside it."""
    g = spark.range(2, 9).select(F.col("id").alias("k")).crossJoin(spark.range(0, 11).select((F.col("id") / 10).alias("share")))
    h = F.col("share") * F.log2(F.col("k").cast("double"))
    e = theory.fano_error(h, F.col("k").cast("double"))
    return g.select("k", "share", F.round(e, 9).alias("error"), F.round(theory.binary_entropy(e) + F.when(F.col("k") > 1, e * F.log2(F.col("k").cast("double") - 1)).otherwise(0.0) - h, 6).alias("off"))


def stochastic_dominance(spark, sf):
    return inf.dominance(table(spark, sf, "lineitem"), "l_returnflag", "A", "R", "l_quantity", 0.01)


def confidence_seq(spark, sf):
    """Bounds of each user's share of large keys after each event; all hold at once.  On a grid of 99 means."""
    e = table(spark, sf, "events")
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    rows = e.select(F.col("user_id").alias("key"), nth.alias("nth"), (F.get_json_object("props", "$.k").cast("long") >= 60).cast("int").alias("x"))
    got = inf.confidence_sequence(rows, grid=99)
    return got.select("key", "nth", F.round("lower", 6).alias("lower"), F.round("upper", 6).alias("upper"))


def measured_crossover(spark, sf):
    """Where the advantage of one line status over the other first turns positive, by return flag."""
    li = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("key"), F.col("l_linenumber").cast("long").alias("x"))
    y = F.avg(F.when(F.col("l_linestatus") == "O", F.col("l_quantity"))) - F.avg(F.when(F.col("l_linestatus") == "F", F.col("l_quantity")))
    return inf.first_crossing(li.agg(F.round(y, 9).alias("y"))).select("key", F.round("crossing", 6).alias("crossing"))


def wilcoxon_stat(spark, sf):
    """Signed ranks of the lines' quantity against 50 times their tax and discount."""
    li = table(spark, sf, "lineitem").select(F.col("l_quantity").alias("a"), F.round(25 + 200 * (F.col("l_discount") - F.col("l_tax")), 0).alias("b"))
    return inf.signed_ranks(li).select("n", "statistic", F.round("z", 6).alias("z"))


def decay_models(spark, sf):
    """Geometric and power-law decay of the mean price by line number, by their squared errors, AIC and BIC."""
    s = table(spark, sf, "lineitem").groupBy("l_linenumber").agg(F.log(F.avg("l_extendedprice")).alias("y"))
    n = F.count("*")
    parts = []
    for name, x in (("geometric", F.col("l_linenumber").cast("double")), ("power_law", F.log(F.col("l_linenumber") + 1.0))):
        rss = F.greatest(F.regr_syy("y", x) - F.regr_sxy("y", x) * F.regr_sxy("y", x) / F.regr_sxx("y", x), F.lit(0.0))
        fit = n * (F.log(2 * F.lit(np.pi) * rss / n) + 1)
        parts.append(s.agg(F.lit(name).alias("model"), F.round(F.regr_slope("y", x), 6).alias("slope"), F.round(fit + 6, 4).alias("aic"), F.round(fit + 3 * F.log(n.cast("double")), 4).alias("bic")))
    return parts[0].unionByName(parts[1])


def bic_factor(spark, sf):
    """The log of the Bayes factor for two shares against one, by their BIC, and for the first share against one half."""
    import math

    r = _table22(spark, sf).first()  # four counts
    sa, na, sb, nb = r["a"], r["a"] + r["b"], r["c"], r["c"] + r["d"]
    ll = lambda s, n, p: (s * math.log(p) if s else 0.0) + ((n - s) * math.log(1 - p) if n > s else 0.0)
    pooled = (sa + sb) / (na + nb)
    two = ll(sa, na, sa / na) + ll(sb, nb, sb / nb) - ll(sa, na, pooled) - ll(sb, nb, pooled) - math.log(na + nb) / 2
    return spark.createDataFrame([(round(two, 4), round(stats.log_bayes_factor(sa, na), 4))], "two_shares double, one_half double")


def tost_proportions(spark, sf):
    """The two one-sided statistics for the equivalence of two shares within five hundredths, unpooled."""
    pa, pb = F.col("a") / (F.col("a") + F.col("b")), F.col("c") / (F.col("c") + F.col("d"))
    se = F.sqrt(pa * (1 - pa) / (F.col("a") + F.col("b")) + pb * (1 - pb) / (F.col("c") + F.col("d")))
    return _table22(spark, sf).select(F.round(pa - pb, 9).alias("difference"), F.round((pa - pb + 0.05) / se, 6).alias("z_lower"), F.round((pa - pb - 0.05) / se, 6).alias("z_upper"))


FUNCTIONS = (
    holm, benjamini_hochberg, benjamini_yekutieli, storey_q, avg_ranks, friedman_stat, nemenyi_cd, cliffs_delta, cohens_d, tost_moments, cohens_h_odds, mcnemar_counts,
    meta_dl, mutual_info, eprocess_path, eprocess_stop, ecdf_dominance, conformal_q, decay_fit, link_fit, mediation, partial_corr, g_computation, pinball, isotonic_trend,
    bootstrap_ci, studentized_ci, subsample_ci, cluster_ci, theory_grid, crossover_grid, sensitivity_grid, token_economics_grid, capacity_grid, supersession_grid,
    economics_grid, value_grid, crossover_search, crossover_slopes, path_composition, fano_grid, stochastic_dominance, confidence_seq, measured_crossover, wilcoxon_stat, decay_models, bic_factor, tost_proportions,
)

_P = "t AS (SELECT p_brand AS family, p_partkey AS id, (p_partkey * 7919 % 10007 + 1) / 10008 * ((p_partkey % 7 + 1) / 70) AS p FROM part), r AS (SELECT *, count(*) OVER (PARTITION BY family) AS m, row_number() OVER (PARTITION BY family ORDER BY p, id) AS k FROM t)"
_UP = "min(m / k * p) OVER (PARTITION BY family ORDER BY p DESC, id DESC)"
_BL = "bl AS (SELECT CAST(year(o_orderdate) AS BIGINT) AS block, CAST(l_linenumber AS BIGINT) AS treatment, round(avg(l_quantity), 9) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2), rk AS (SELECT *, rank() OVER (PARTITION BY block ORDER BY v) + (count(*) OVER (PARTITION BY block, v) - 1) / 2 AS r FROM bl)"
_M2 = "mo AS (SELECT count(*) FILTER (l_returnflag = 'A') AS na, avg(l_quantity) FILTER (l_returnflag = 'A') AS ma, var_samp(l_quantity) FILTER (l_returnflag = 'A') AS va, count(*) FILTER (l_returnflag = 'N') AS nb, avg(l_quantity) FILTER (l_returnflag = 'N') AS mb, var_samp(l_quantity) FILTER (l_returnflag = 'N') AS vb FROM lineitem)"
_BE = "be AS (SELECT user_id AS key, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS nth, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 AS x FROM events), pa AS (SELECT key, nth, exp(sum(ln(1 + 1.0::DOUBLE * (x - 0.3::DOUBLE))) OVER (PARTITION BY key ORDER BY nth)) AS capital FROM be)"
_GR = "g AS (SELECT a * 0.2::DOUBLE AS s0, b * 0.2::DOUBLE AS rho, 0.6::DOUBLE + c * 0.1::DOUBLE AS q, CAST(d AS BIGINT) AS d FROM range(1, 5) x(a), range(1, 5) y(b), range(1, 5) z(c), range(1, 9) w(d)), h AS (SELECT *, exp(d * ln(s0) + d * (d + 1) / 2 * ln(rho)) AS ps, power(q, d) AS pq FROM g)"
_G3 = "round(s0, 6) AS s0, round(rho, 6) AS rho, round(q, 6) AS q"

SQL = {
    "holm": f"WITH {_P} SELECT family, id, round(least(max((m - k + 1) * p) OVER (PARTITION BY family ORDER BY p, id), 1), 9) AS adjusted FROM r",
    "benjamini_hochberg": f"WITH {_P} SELECT family, id, round(least({_UP}, 1), 9) AS adjusted FROM r",
    "benjamini_yekutieli": f"WITH {_P} SELECT family, id, round(least({_UP} * list_sum(list_transform(range(1, m + 1), lambda i: 1.0::DOUBLE / i)), 1), 9) AS adjusted FROM r",
    "storey_q": f"WITH {_P}, s AS (SELECT *, least(avg((p > 0.05)::INT::DOUBLE) OVER (PARTITION BY family) / 0.95::DOUBLE, 1) AS pi0 FROM r) SELECT family, id, round(least({_UP} * pi0, 1), 9) AS adjusted FROM s",
    "avg_ranks": f"WITH {_BL} SELECT treatment, round(avg(r), 6) AS mean_rank FROM rk GROUP BY treatment",
    "friedman_stat": f"WITH {_BL}, ti AS (SELECT sum(t * t * t - t)::DOUBLE AS ties FROM (SELECT count(*) AS t FROM rk GROUP BY block, v)), s AS (SELECT treatment, sum(r) AS r, count(*) AS n FROM rk GROUP BY treatment), g AS (SELECT max(n) AS n, count(*) AS k, sum(r * r) AS r2 FROM s) SELECT round((12 / (n * k * (k + 1)) * r2 - 3 * n * (k + 1)) / (1 - ties / (n * (k * k * k - k))), 6) AS statistic, n, k FROM g, ti",
    "nemenyi_cd": f"WITH {_BL}, g AS (SELECT count(DISTINCT treatment) AS k, count(DISTINCT block) AS n FROM bl) SELECT round({list(NEMENYI)}[CAST(k - 1 AS INT)]::DOUBLE * sqrt(k * (k + 1) / (6 * n)), 6) AS cd FROM g",
    "cliffs_delta": "WITH c AS (SELECT l_extendedprice AS v, count(*) FILTER (l_returnflag = 'A') AS na, count(*) FILTER (l_returnflag = 'N') AS nb FROM lineitem WHERE l_returnflag IN ('A', 'N') GROUP BY 1), b AS (SELECT *, coalesce(sum(nb) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c), s AS (SELECT sum(na * (below + nb / 2))::DOUBLE / (sum(na)::DOUBLE * sum(nb)) AS cles FROM b) SELECT round(cles, 6) AS cles, round(2 * cles - 1, 6) AS delta, CASE WHEN abs(2 * cles - 1) < 0.147 THEN 'negligible' WHEN abs(2 * cles - 1) < 0.33 THEN 'small' WHEN abs(2 * cles - 1) < 0.474 THEN 'medium' ELSE 'large' END AS magnitude FROM s",
    "cohens_d": f"WITH {_M2} SELECT round((ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)), 6) AS d FROM mo",
    "tost_moments": f"WITH {_M2} SELECT round((ma - mb + 1) / sqrt(va / na + vb / nb), 6) AS t_lower, round((ma - mb - 1) / sqrt(va / na + vb / nb), 6) AS t_upper, round((va / na + vb / nb) ** 2 / ((va / na) ** 2 / (na - 1) + (vb / nb) ** 2 / (nb - 1)), 4) AS df FROM mo",
    "cohens_h_odds": "WITH s AS (SELECT count(*) FILTER (l_linestatus = 'O' AND l_quantity > 25) AS a, count(*) FILTER (l_linestatus = 'O' AND l_quantity <= 25) AS b, count(*) FILTER (l_linestatus = 'F' AND l_quantity > 25) AS c, count(*) FILTER (l_linestatus = 'F' AND l_quantity <= 25) AS d FROM lineitem) SELECT round(2 * asin(sqrt(a / (a + b))) - 2 * asin(sqrt(c / (c + d))), 6) AS h, round((a + 0.5::DOUBLE) * (d + 0.5::DOUBLE) / ((b + 0.5::DOUBLE) * (c + 0.5::DOUBLE)), 6) AS odds_ratio FROM s",
    "mcnemar_counts": "SELECT count(*) FILTER (quality = 1 AND toxic = 0) AS b, count(*) FILTER (quality = 0 AND toxic = 1) AS c FROM labels",
    "meta_dl": "WITH s AS (SELECT avg(l_discount) AS y, var_samp(l_discount) / count(*) AS v FROM lineitem GROUP BY l_linenumber), a AS (SELECT count(*) AS k, sum(1 / v) AS w, sum(1 / v / v) AS w2, sum(y / v) AS wy, sum(y * y / v) AS wyy FROM s), b AS (SELECT *, wyy - wy * wy / w AS q, w - w2 / w AS c FROM a), t AS (SELECT *, greatest((q - (k - 1)) / c, 0) AS tau2, CASE WHEN q > 0 THEN greatest((q - (k - 1)) / q, 0) ELSE 0 END AS i2 FROM b) SELECT k, round(q, 6) AS q, round(i2, 6) AS i2, round(wy / w, 9) AS fixed, round(sum(y / (v + tau2)) / sum(1 / (v + tau2)), 9) AS pooled, round(1 / sqrt(sum(1 / (v + tau2))), 9) AS se FROM t, s GROUP BY k, q, i2, wy, w",
    "mutual_info": "WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1, 2), p AS (SELECT n / sum(n) OVER () * log2(n * sum(n) OVER () / (sum(n) OVER (PARTITION BY a) * sum(n) OVER (PARTITION BY b))) AS x FROM c) SELECT round(greatest(sum(x), 0), 6) AS bits FROM p",
    "eprocess_path": f"WITH {_BE} SELECT key, nth, round(ln(capital), 6) AS log_capital FROM pa",
    "eprocess_stop": f"WITH {_BE} SELECT key, min(nth) FILTER (round(capital, 9) >= 20) AS stopping, count(*) AS n FROM pa GROUP BY key",
    "ecdf_dominance": "WITH c AS (SELECT l_extendedprice AS v, count(*) FILTER (l_returnflag = 'A') AS na, count(*) FILTER (l_returnflag = 'R') AS nb FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1), d AS (SELECT sum(na) OVER (ORDER BY v)::DOUBLE / sum(na) OVER () - sum(nb) OVER (ORDER BY v)::DOUBLE / sum(nb) OVER () AS d FROM c) SELECT round(greatest(max(d), 0), 6) AS above, round(greatest(-min(d), 0), 6) AS below FROM d",
    "conformal_q": "WITH r AS (SELECT l_returnflag, abs(l_quantity - 25.5::DOUBLE) AS r, row_number() OVER (PARTITION BY l_returnflag ORDER BY abs(l_quantity - 25.5::DOUBLE)) AS nth, ceil(round((count(*) OVER (PARTITION BY l_returnflag) + 1) * 0.9::DOUBLE, 9)) AS k FROM lineitem) SELECT l_returnflag, max(r) FILTER (nth = k) AS half_width, count(*) AS n FROM r GROUP BY l_returnflag",
    "decay_fit": "WITH s AS (SELECT l_linenumber::DOUBLE AS x, ln(avg(l_extendedprice)) AS y FROM lineitem GROUP BY l_linenumber) SELECT round(regr_slope(y, x), 9) AS slope, round(regr_intercept(y, x), 6) AS intercept, round(regr_r2(y, x), 6) AS r2 FROM s",
    "link_fit": "WITH s AS (SELECT l_linenumber AS d, avg((l_quantity > 5)::INT::DOUBLE) AS p FROM lineitem GROUP BY 1) SELECT round(least(exp(sum(d * ln(p)) / sum(d * d)), 1), 6) AS q FROM s",
    "mediation": "WITH s AS (SELECT covar_samp(l_quantity, l_quantity) AS xx, covar_samp(l_quantity, l_extendedprice) AS xm, covar_samp(l_quantity, l_discount) AS xy, covar_samp(l_extendedprice, l_extendedprice) AS mm, covar_samp(l_extendedprice, l_discount) AS my FROM lineitem) SELECT round(xy / xx * 1e6, 3) AS total, round((xy * mm - my * xm) / (xx * mm - xm * xm) * 1e6, 3) AS direct, round(xm / xx * (my * xx - xy * xm) / (xx * mm - xm * xm) * 1e6, 3) AS indirect FROM s",
    "partial_corr": "WITH c AS (SELECT corr(l_quantity, l_extendedprice) AS xy, corr(l_quantity, l_discount) AS xz, corr(l_extendedprice, l_discount) AS yz FROM lineitem) SELECT round((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 6) AS partial, round((xy - xz * yz) / sqrt(1 - xz * xz), 6) AS semipartial FROM c",
    "g_computation": "WITH l AS (SELECT (l_linestatus = 'O')::INT::DOUBLE AS t, l_quantity AS x, l_discount AS y FROM lineitem), s AS (SELECT covar_samp(t, t) AS tt, covar_samp(t, x) AS tx, covar_samp(x, x) AS xx, covar_samp(t, y) AS ty, covar_samp(x, y) AS xy, count(*) AS n FROM l) SELECT round((ty * xx - xy * tx) / (tt * xx - tx * tx), 9) AS ate, n FROM s",
    "pinball": "SELECT l_returnflag, round(avg(greatest(0.7::DOUBLE * (l_quantity - 25), -0.3::DOUBLE * (l_quantity - 25))), 6) AS loss FROM lineitem GROUP BY l_returnflag",
    "isotonic_trend": """
WITH s AS (SELECT CAST(l_linenumber AS BIGINT) AS depth, avg(l_quantity) AS m, count(*) AS n FROM lineitem GROUP BY 1),
b AS (SELECT a.depth AS lo, c.depth AS hi, (SELECT sum(m * n) / sum(n) FROM s x WHERE x.depth BETWEEN a.depth AND c.depth) AS mean FROM s a JOIN s c ON a.depth <= c.depth),
i AS (SELECT s.depth, s.n, lo, max(mean) AS up FROM s JOIN b ON lo <= s.depth AND hi >= s.depth GROUP BY s.depth, s.n, lo)
SELECT depth, n, round(min(up), 6) AS fitted FROM i GROUP BY depth, n""",
    "economics_grid": f"WITH {_GR}, t AS (SELECT *, list_sum(list_transform(range(1, d + 1), lambda i: 40 / (s0 * power(rho, i)))) AS ts, 40.0::DOUBLE * d AS tx FROM h WHERE d <= 4) SELECT {_G3}, d, round(ts, 9) AS similarity_tokens, round(tx, 9) AS structured_tokens, round(d * 40 / ts, 9) AS similarity_precision, 1.0::DOUBLE AS structured_precision, round(ts * (d * 40 / ts), 9) AS similarity_signal, round(tx, 9) AS structured_signal, round(tx / pq, 9) AS structured_cost, round(ts / tx, 9) AS token_ratio, round(ps / ts, 9) AS similarity_return, round(pq / tx, 9) AS structured_return, round(tx / pq * 3e-6, 9) AS structured_dollars, round(ln(ts / ps), 6) AS log_similarity_cost, round(ln((ts / ps) / (tx / pq)), 6) AS log_cost_ratio, round(ln((pq / tx) / (ps / ts)), 6) AS log_return_ratio, round(ln(ts / ps * 3e-6), 6) AS log_similarity_dollars FROM t",
    "value_grid": f"WITH {_GR} SELECT {_G3}, d, round(10 * (pq - ps) - 2, 9) AS net, round(pq * power(0.9::DOUBLE, 2), 9) AS scattered, round(d::DOUBLE, 6) AS by_s0, round(d * (d + 1) / 2, 6) AS by_rho, round(d * pq / q, 9) AS gap_by_q FROM h",
    "crossover_search": f"WITH {_GR}, k AS (SELECT DISTINCT s0, rho, q FROM g), x AS (SELECT s0, rho, q, d, round(power(q, d) - exp(d * ln(s0) + d * (d + 1) / 2 * ln(rho)), 12) AS gp FROM k, (SELECT range AS d FROM range(1, 65))), f AS (SELECT *, min(d) FILTER (gp > 0.05) OVER (PARTITION BY s0, rho, q) AS f FROM x), e AS (SELECT *, min(d) FILTER (gp <= 0.05 AND d > f) OVER (PARTITION BY s0, rho, q) AS e FROM f) SELECT {_G3}, min(f) AS d_star, CAST(coalesce(min(e) - 1, CASE WHEN min(f) IS NOT NULL THEN 64 END) AS BIGINT) AS last, arg_min(d, (-gp, d)) AS peak FROM e GROUP BY s0, rho, q",
    "crossover_slopes": f"WITH {_GR}, k AS (SELECT DISTINCT s0, rho, q FROM g), e AS (SELECT *, 1e-5::DOUBLE AS h FROM k) SELECT {_G3}, round(((2 * (ln(q) - ln(s0 + h)) / ln(rho) - 1) - (2 * (ln(q) - ln(s0 - h)) / ln(rho) - 1)) / (2 * h), 3) AS by_s0, round(((2 * (ln(q) - ln(s0)) / ln(rho + h) - 1) - (2 * (ln(q) - ln(s0)) / ln(rho - h) - 1)) / (2 * h), 3) AS by_rho, round(((2 * (ln(q + h) - ln(s0)) / ln(rho) - 1) - (2 * (ln(q - h) - ln(s0)) / ln(rho) - 1)) / (2 * h), 3) AS by_q FROM e",
    "path_composition": "WITH h AS (SELECT l_orderkey AS path, l_linestatus = 'O' AS typed, CASE WHEN l_linestatus = 'O' THEN 0.9::DOUBLE ELSE 0.8::DOUBLE * power(0.95::DOUBLE, l_linenumber) END AS s FROM lineitem) SELECT path, count(*) AS n_hops, count(*) FILTER (typed) AS n_typed, round(CAST(sum(CAST(ln(s) AS DECIMAL(28,9))) AS DOUBLE), 6) AS log_survival, round(exp(CAST(sum(CAST(ln(s) AS DECIMAL(28,9))) AS DOUBLE)), 6) AS survival FROM h GROUP BY path",
    "stochastic_dominance": "WITH c AS (SELECT l_quantity AS v, count(*) FILTER (l_returnflag = 'A') AS na, count(*) FILTER (l_returnflag = 'R') AS nb FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1), d AS (SELECT v, sum(na) OVER (ORDER BY v)::DOUBLE / sum(na) OVER () - sum(nb) OVER (ORDER BY v)::DOUBLE / sum(nb) OVER () AS d, lead(v) OVER (ORDER BY v) - v AS w FROM c), a AS (SELECT *, sum(d * w) OVER (ORDER BY v) AS a FROM d) SELECT max(d) <= 0.01 AS first, coalesce(max(a), 0) <= 0.01 AS second FROM a",
    "confidence_seq": """
WITH b AS (SELECT user_id AS key, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS nth, (CAST(json_extract_string(props, '$.k') AS BIGINT) >= 60)::INT AS x FROM events),
g AS (SELECT *, range / 100 AS m FROM b, range(1, 100)),
c AS (SELECT *, exp(sum(ln(1 + 0.5::DOUBLE * (x - m))) OVER w) AS up, exp(sum(ln(1 - 0.5::DOUBLE * (x - m))) OVER w) AS down FROM g WINDOW w AS (PARTITION BY key, m ORDER BY nth)),
t AS (SELECT *, max(round(0.5::DOUBLE * up + 0.5::DOUBLE * down, 9)) OVER (PARTITION BY key, m ORDER BY nth) AS most FROM c),
a AS (SELECT key, nth, coalesce(min(m) FILTER (most < 1 / (1 - 0.95::DOUBLE)), 0) AS lo, coalesce(max(m) FILTER (most < 1 / (1 - 0.95::DOUBLE)), 1) AS hi FROM t GROUP BY key, nth)
SELECT key, nth, round(max(lo) OVER w, 6) AS lower, round(min(hi) OVER w, 6) AS upper FROM a WINDOW w AS (PARTITION BY key ORDER BY nth)""",
    "measured_crossover": "WITH s AS (SELECT l_returnflag AS key, CAST(l_linenumber AS BIGINT) AS x, round(avg(l_quantity) FILTER (l_linestatus = 'O') - avg(l_quantity) FILTER (l_linestatus = 'F'), 9) AS y FROM lineitem GROUP BY 1, 2), l AS (SELECT *, lag(x) OVER w AS x0, lag(y) OVER w AS y0 FROM s WINDOW w AS (PARTITION BY key ORDER BY x)) SELECT key, round(min(CASE WHEN y0 IS NULL AND y > 0 THEN x::DOUBLE WHEN y > 0 AND y0 <= 0 THEN x0 + (0 - y0) / (y - y0) * (x - x0) END), 6) AS crossing FROM l GROUP BY key",
    "wilcoxon_stat": "WITH d AS (SELECT l_quantity - round(25 + 200 * (l_discount - l_tax), 0) AS d FROM lineitem), c AS (SELECT abs(d) AS v, count(*) AS n, count(*) FILTER (d > 0) AS up FROM d WHERE d <> 0 GROUP BY 1), r AS (SELECT *, coalesce(sum(n) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2 AS r FROM c), g AS (SELECT sum(n)::DOUBLE AS n, sum(r * up) AS up, sum(r * (n - up)) AS down, sum(n::DOUBLE ** 3 - n) AS ties FROM r) SELECT CAST(n AS BIGINT) AS n, least(up, down) AS statistic, round((least(up, down) - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48), 6) AS z FROM g",
    "decay_models": "WITH s AS (SELECT l_linenumber::DOUBLE AS i, ln(avg(l_extendedprice)) AS y FROM lineitem GROUP BY l_linenumber), x AS (SELECT 'geometric' AS model, i AS x, y FROM s UNION ALL SELECT 'power_law', ln(i + 1), y FROM s), g AS (SELECT model, count(*) AS n, regr_slope(y, x) AS slope, greatest(regr_syy(y, x) - regr_sxy(y, x) ** 2 / regr_sxx(y, x), 0) AS rss FROM x GROUP BY model) SELECT model, round(slope, 6) AS slope, round(n * (ln(2 * pi() * rss / n) + 1) + 6, 4) AS aic, round(n * (ln(2 * pi() * rss / n) + 1) + 3 * ln(n), 4) AS bic FROM g",
    "bic_factor": "WITH t AS (SELECT (count(*) FILTER (l_linestatus = 'O' AND l_quantity > 25))::DOUBLE AS sa, (count(*) FILTER (l_linestatus = 'O'))::DOUBLE AS na, (count(*) FILTER (l_linestatus = 'F' AND l_quantity > 25))::DOUBLE AS sb, (count(*) FILTER (l_linestatus = 'F'))::DOUBLE AS nb FROM lineitem), p AS (SELECT *, sa / na AS pa, sb / nb AS pb, (sa + sb) / (na + nb) AS p FROM t) SELECT round(sa * ln(pa) + (na - sa) * ln(1 - pa) + sb * ln(pb) + (nb - sb) * ln(1 - pb) - (sa + sb) * ln(p) - (na + nb - sa - sb) * ln(1 - p) - ln(na + nb) / 2, 4) AS two_shares, round(lgamma(sa + 1) + lgamma(na - sa + 1) - lgamma(na + 2) - na * ln(0.5::DOUBLE), 4) AS one_half FROM p",
    "tost_proportions": "WITH t AS (SELECT (count(*) FILTER (l_linestatus = 'O' AND l_quantity > 25))::DOUBLE AS sa, (count(*) FILTER (l_linestatus = 'O'))::DOUBLE AS na, (count(*) FILTER (l_linestatus = 'F' AND l_quantity > 25))::DOUBLE AS sb, (count(*) FILTER (l_linestatus = 'F'))::DOUBLE AS nb FROM lineitem), p AS (SELECT sa / na - sb / nb AS d, sqrt(sa / na * (1 - sa / na) / na + sb / nb * (1 - sb / nb) / nb) AS se FROM t) SELECT round(d, 9) AS difference, round((d + 0.05::DOUBLE) / se, 6) AS z_lower, round((d - 0.05::DOUBLE) / se, 6) AS z_upper FROM p",
    "theory_grid": f"WITH {_GR} SELECT {_G3}, d, round(ps, 9) AS similarity, round(pq, 9) AS structured, round(pq - ps, 9) AS gap FROM h",
    "crossover_grid": f"WITH {_GR} SELECT {_G3}, round(2 * (ln(q) - ln(s0)) / ln(rho) - 1, 6) AS depth, round(ln(0.5::DOUBLE) / ln(rho), 6) AS half_life FROM h WHERE d = 1",
    "sensitivity_grid": f"WITH {_GR} SELECT {_G3}, d, round(d * ps / s0, 9) AS by_s0, round(d * (d + 1) / 2 * ps / rho, 9) AS by_rho, round(d * pq / q, 9) AS by_q FROM h",
    "token_economics_grid": f"WITH {_GR} SELECT round(s0, 6) AS s0, round(rho, 6) AS rho, d, round(1000 * ps / list_sum(list_transform(range(1, d + 1), lambda i: 40 / (s0 * power(rho, i)))), 9) AS per_1k FROM h WHERE q < 0.75",
    "capacity_grid": "WITH p AS (SELECT range AS id, range / 100 AS p FROM range(0, 101)), h AS (SELECT id, CASE WHEN p <= 0 OR p >= 1 THEN 0.0::DOUBLE ELSE -p * log2(p) - (1 - p) * log2(1 - p) END AS h FROM p) SELECT id, round(h, 9) AS entropy, round(1 - h, 9) AS capacity FROM h",
    "supersession_grid": "SELECT range AS n, round(power(0.9::DOUBLE, range - 1), 9) AS structured, round(1 / range, 9) AS similarity, round(CASE WHEN range <= 1 THEN 1 ELSE power(1 / range, 1 / (range - 1)) END, 9) AS break_even, round(power(0.8::DOUBLE, range), 9) AS scatter FROM range(1, 11)",
}
