"""Metrics of rankings, attempts and probabilities."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.operators.lineage import kept


def judged(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """(qid, doc, rank, rel): rankings with 1 where the document is gold."""
    marks = gold.select("qid", "doc").distinct().withColumn("g", F.lit(1))
    return ranked.select("qid", "doc", "rank").join(marks, ["qid", "doc"], "left").select("qid", "doc", "rank", F.coalesce("g", F.lit(0)).alias("rel"))


def retrieval_scores(ranked: DataFrame, gold: DataFrame, queries: DataFrame, p: float = 0.8) -> DataFrame:
    """One row per query of queries (qid): precision, recall, rr, ap, ndcg, rbp, err, r_precision, chain_recovered.

    Without gold: precision is 1 only for an empty ranking; recall, ap and ndcg are 1; the chain is not recovered.
    """
    rows = judged(ranked, gold)
    hits = F.sum("rel").over(Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    need = gold.select("qid", "doc").distinct().groupBy("qid").agg(F.count("*").alias("n_gold"))
    rows = rows.withColumn("hits", hits).join(need, "qid", "left")
    rel, rank = F.col("rel"), F.col("rank")
    one = rows.groupBy("qid").agg(
        F.count("*").alias("cut"),
        F.sum("rel").alias("tp"),
        F.min(F.when(rel == 1, rank)).alias("first"),
        F.sum(rel * F.col("hits") / rank).alias("ap"),
        F.sum(rel / F.log2(rank + 1.0)).alias("dcg"),
        F.sum(rel * F.pow(F.lit(p), rank - 1)).alias("rbp"),
        F.sum(rel / rank * F.pow(F.lit(0.5), F.col("hits"))).alias("err"),
        F.sum(F.when(rank <= F.col("n_gold"), rel)).alias("at_r"),
    )
    all_ = queries.select("qid").join(need, "qid", "left").join(one, "qid", "left")
    n, cut, tp = F.coalesce("n_gold", F.lit(0)), F.coalesce("cut", F.lit(0)), F.coalesce("tp", F.lit(0))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(n, cut), F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    r = lambda c: F.round(c, 6)
    return all_.select(
        "qid",
        r(F.when(cut == 0, F.when(n == 0, 1.0).otherwise(0.0)).otherwise(tp / cut)).alias("precision"),
        r(F.when(n == 0, 1.0).otherwise(tp / n)).alias("recall"),
        r(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("rr"),
        r(F.when(n == 0, 1.0).otherwise(F.coalesce("ap", F.lit(0.0)) / n)).alias("ap"),
        r(F.when(n == 0, 1.0).when(cut == 0, 0.0).otherwise(F.col("dcg") / ideal)).alias("ndcg"),
        r((1 - p) * F.coalesce("rbp", F.lit(0.0))).alias("rbp"),
        r(F.coalesce("err", F.lit(0.0))).alias("err"),
        r(F.when(n == 0, 0.0).otherwise(F.coalesce("at_r", F.lit(0)) / n)).alias("r_precision"),
        ((n > 0) & (tp == n)).alias("chain_recovered"),
    )


def cost_to_correct(attempts: DataFrame) -> DataFrame:
    """attempts (task, attempt, tokens, dollars, correct): sums up to the first correct attempt, of all if none is."""
    w = Window.partitionBy("task")
    first = F.min(F.when(F.col("correct"), F.col("attempt"))).over(w)
    rows = attempts.withColumn("first", first).where(F.col("first").isNull() | (F.col("attempt") <= F.col("first")))
    return rows.groupBy("task").agg(
        F.count("*").alias("attempts"), F.max("first").isNotNull().alias("resolved"), F.sum("tokens").alias("tokens"), F.sum("dollars").alias("dollars")
    )


def reliability_bins(rows: DataFrame, p: str, y: str, n: int = 10) -> DataFrame:
    """(bin, count, mean_p, mean_y): equal widths, the first bin closed, the others open below."""
    b = F.greatest(F.ceil(F.round(F.col(p) * n, 9)) - 1, F.lit(0)).cast("long")
    return rows.groupBy(b.alias("bin")).agg(F.count("*").alias("count"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("mean_y"))


def calibration(rows: DataFrame, p: str, y: str, n: int = 10) -> DataFrame:
    """raw_brier (of the probabilities), brier (of their bins' means, so that it is reliability - resolution + uncertainty),
    ece, reliability, resolution, uncertainty as one row."""
    bins = reliability_bins(rows, p, y, n)
    c, mp, my = F.col("count"), F.col("mean_p"), F.col("mean_y")
    sums = bins.agg(F.sum("count").alias("n"), F.sum(c * my).alias("pos"), F.sum(c * F.abs(mp - my)).alias("gap"), F.sum(c * (mp - my) ** 2).alias("rel"), F.sum(c * my * my).alias("my2"), F.sum(c * (mp * mp - 2 * mp * my + my)).alias("binned"))
    brier = rows.agg(F.avg((F.col(p) - F.col(y).cast("double")) ** 2).alias("raw"))
    n_, base = F.col("n"), F.col("pos") / F.col("n")
    return brier.join(F.broadcast(sums)).select(
        F.round("raw", 6).alias("raw_brier"), F.round(F.col("binned") / n_, 6).alias("brier"), F.round(F.col("gap") / n_, 6).alias("ece"), F.round(F.col("rel") / n_, 6).alias("reliability"),
        F.round(F.col("my2") / n_ - base * base, 6).alias("resolution"), F.round(base * (1 - base), 6).alias("uncertainty"),
    )


def wilson(hits: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    p = hits / n
    mid, half, den = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n
    return F.greatest((mid - half) / den, F.lit(0.0)), F.least((mid + half) / den, F.lit(1.0))


def cohens_kappa(pairs: DataFrame, a: str, b: str, weights: str = "none") -> float:
    """Agreement of two raters; pairs are reduced to their contingency table, which is small, before the driver sees it."""
    cells = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("n")).collect()
    names = sorted({r[a] for r in cells} | {r[b] for r in cells})
    at, k, n = {c: i for i, c in enumerate(names)}, len(names), sum(r["n"] for r in cells)
    w = lambda i, j: {"none": float(i != j), "linear": abs(i - j) / max(1, k - 1), "quadratic": ((i - j) / max(1, k - 1)) ** 2}[weights]
    seen = sum(w(at[r[a]], at[r[b]]) * r["n"] for r in cells) / n
    rows = [sum(r["n"] for r in cells if r[a] == c) / n for c in names]
    cols = [sum(r["n"] for r in cells if r[b] == c) / n for c in names]
    chance = math.fsum(w(i, j) * rows[i] * cols[j] for i in range(k) for j in range(k))
    return 1.0 if chance == 0 else 1 - seen / chance


def fleiss_counts(ratings: DataFrame) -> DataFrame:
    """ratings (unit, label): kappa, p_bar, p_e as one row; every unit has equally many ratings."""
    cells = ratings.groupBy("unit", "label").agg(F.count("*").alias("n"))
    units = cells.groupBy("unit").agg(F.sum("n").alias("m"), F.sum(F.col("n") * (F.col("n") - 1)).alias("agree"))
    p_bar = units.agg(F.avg(F.col("agree") / (F.col("m") * (F.col("m") - 1))).alias("p_bar"), F.sum("m").alias("total"))
    shares = cells.groupBy("label").agg(F.sum("n").alias("c")).join(F.broadcast(p_bar.select("total")))
    p_e = shares.agg(F.sum((F.col("c") / F.col("total")) ** 2).alias("p_e"))
    return p_bar.join(F.broadcast(p_e)).select("p_bar", "p_e", F.when(F.col("p_e") == 1, 1.0).otherwise((F.col("p_bar") - F.col("p_e")) / (1 - F.col("p_e"))).alias("kappa"))


def krippendorff(ratings: DataFrame) -> DataFrame:
    """ratings (unit, label), nulls missing: nominal alpha as one row."""
    cells = ratings.where("label is not null").groupBy("unit", "label").agg(F.count("*").alias("n"))
    units = cells.groupBy("unit").agg(F.sum("n").alias("m"), F.sum(F.col("n") * (F.col("n") - 1)).alias("same")).where("m > 1")
    pairs = units.agg(F.sum("m").alias("total"), F.sum((F.col("m") * (F.col("m") - 1) - F.col("same")) / (F.col("m") - 1)).alias("unlike"))
    by = cells.join(units.select("unit"), "unit").groupBy("label").agg(F.sum("n").alias("c")).agg(F.sum(F.col("c") * (F.col("c") - 1)).alias("cc"))
    t = F.col("total")
    expected = (t * (t - 1) - F.col("cc")) / (t - 1)
    return pairs.join(F.broadcast(by)).select(F.when(expected == 0, 1.0).otherwise(1 - F.col("unlike") / expected).alias("alpha"))


def pareto(points: DataFrame) -> DataFrame:
    """points (name, accuracy, cost) that no other point beats; equal points all stay.

    A point is beaten if some point of at least its accuracy is cheaper, or of more accuracy is no dearer: both are
    running minima over accuracy.  Points are dealt out by ranges of accuracy; a range needs of those above it only their
    least cost, one number a range, so no task sorts them all.
    """
    spark = points.sparkSession
    best = points.groupBy("accuracy").agg(F.min("cost").alias("low"))
    dealt = kept(best.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), F.col("accuracy").desc()).withColumn("part", F.spark_partition_id()))
    above, rows = None, []
    for r in dealt.groupBy("part").agg(F.min("low").alias("low")).orderBy("part").collect():  # one row a range
        rows.append((r["part"], above))
        above = r["low"] if above is None else min(above, r["low"])
    before = F.broadcast(spark.createDataFrame(rows, "part int, above double"))
    w = Window.partitionBy("part").orderBy(F.col("accuracy").desc()).rowsBetween(Window.unboundedPreceding, -1)
    front = dealt.join(before, "part").withColumn("better", F.least(F.min("low").over(w), "above")).where(F.col("better").isNull() | (F.col("low") < F.col("better")))
    return points.join(front.select("accuracy", F.col("low").alias("cost")), ["accuracy", "cost"], "left_semi")


def hypervolume(front: DataFrame, accuracy0: float, cost0: float) -> DataFrame:
    """The area that a frontier covers up to a reference point; points outside it are an error.  A frontier is small: its
    accuracies and costs rise together."""
    inside = (F.col("accuracy") >= accuracy0) & (F.col("cost") <= cost0)
    front = front.where(F.when(inside, True).otherwise(F.raise_error(F.lit("a point lies outside the reference")).cast("boolean")))
    w = Window.orderBy(F.col("accuracy").desc())
    rows = front.select("accuracy", "cost").distinct().withColumn("upper", F.coalesce(F.lag("cost").over(w), F.lit(cost0)))
    return rows.agg(F.coalesce(F.sum((F.col("accuracy") - accuracy0) * (F.col("upper") - F.col("cost"))), F.lit(0.0)).alias("hypervolume"))


def curve_area(points: DataFrame, normalised: bool = True) -> DataFrame:
    """points (arm, depth, value): trapezoid area over depth, divided by its span; a single depth gives its value."""
    w = Window.partitionBy("arm").orderBy("depth")
    rows = points.withColumn("d0", F.lag("depth").over(w)).withColumn("v0", F.lag("value").over(w))
    got = rows.groupBy("arm").agg(F.sum((F.col("depth") - F.col("d0")) * (F.col("value") + F.col("v0")) / 2).alias("area"), (F.max("depth") - F.min("depth")).alias("span"), F.max("value").alias("only"))
    if normalised:
        return got.select("arm", F.when(F.col("span") == 0, F.col("only")).otherwise(F.col("area") / F.col("span")).alias("area"))
    return got.select("arm", F.coalesce("area", F.lit(0.0)).alias("area"))


def half_life(points: DataFrame) -> DataFrame:
    """The depth at which each arm first falls to half its first value, between measured depths; null if it never does."""
    w = Window.partitionBy("arm").orderBy("depth")
    rows = points.withColumn("d0", F.lag("depth").over(w)).withColumn("v0", F.lag("value").over(w)).withColumn("half", F.first("value").over(w) / 2)
    v, v0, d, d0, h = (F.col(c) for c in ("value", "v0", "depth", "d0", "half"))
    at = F.when((v0 > h) & (v <= h), d0 + (v0 - h) / (v0 - v) * (d - d0))
    return rows.withColumn("at", at).groupBy("arm").agg(F.min("at").alias("half_life"))


def regret(scores: DataFrame, floor: str | None = None) -> DataFrame:
    """scores (task, arm, score): mean over tasks of (best - score) / (best - worst), worst being the floor arm's score
    where it is present; 0 without spread."""
    w = Window.partitionBy("task")
    low = F.coalesce(F.max(F.when(F.col("arm") == floor, F.col("score"))).over(w), F.min("score").over(w)) if floor else F.min("score").over(w)
    rows = scores.withColumn("best", F.max("score").over(w)).withColumn("low", low)
    span = F.col("best") - F.col("low")
    r = F.when(span <= 0, 0.0).otherwise(F.least(F.greatest((F.col("best") - F.col("score")) / span, F.lit(0.0)), F.lit(1.0)))
    return rows.withColumn("r", r).groupBy("arm").agg(F.avg("r").alias("regret"), F.count("*").alias("n_tasks"))


# tables over scored rows (dataset, arm, model, depth, compliance, recovered, recall, correct, tokens_in, tokens_out)


def of_line(rows: DataFrame, prefix: str) -> DataFrame:
    """Rows of the models whose name begins so."""
    return rows.where(F.col("model").startswith(prefix))


def headline(rows: DataFrame, line: str) -> DataFrame:
    return of_line(rows, line).groupBy("dataset", "arm").agg(F.avg("compliance").alias("compliance"))


def depth_crossover(rows: DataFrame, datasets, line: str) -> DataFrame:
    return of_line(rows, line).where(F.col("dataset").isin(*datasets)).groupBy("arm", "depth").agg(F.avg(F.col("recovered").cast("double")).alias("recovery"))


def robustness(rows: DataFrame, arm: str) -> DataFrame:
    """By dataset and model, whatever the model's line."""
    return rows.where(F.col("arm") == arm).groupBy("dataset", "model").agg(F.avg("compliance").alias("compliance"))


def ablation(rows: DataFrame, cells: DataFrame, datasets, line: str) -> DataFrame:
    """cells (arm, depth, label): a few rows that name what is compared; other cells are left out."""
    own = of_line(rows, line).where(F.col("dataset").isin(*datasets)).join(F.broadcast(cells), ["arm", "depth"])
    return own.groupBy("label").agg(F.avg("compliance").alias("compliance"), F.count("*").alias("n"))


def verified(claims: DataFrame) -> DataFrame:
    """Claims (system, value, needs_citation) with a value and a citation."""
    return claims.where(~F.col("needs_citation") & F.col("value").isNotNull())


def single_tier(rows: DataFrame) -> DataFrame:
    """rows, or an error where they mix tiers; the guard before any average."""
    n = rows.agg(F.countDistinct("tier")).first()[0]
    if n > 1:
        raise ValueError("measured and reported rows can't be averaged together")
    return rows


def two_tier(rows: DataFrame, claims: DataFrame) -> DataFrame:
    """(tier, name, value): measured means by arm, then others' verified claims as they are."""
    own = rows.groupBy(F.col("arm").alias("name")).agg(F.avg("compliance").alias("value")).select(F.lit("measured").alias("tier"), "name", "value")
    return own.unionByName(verified(claims).select(F.lit("reported").alias("tier"), F.col("system").alias("name"), "value"))


def priced(rows: DataFrame, prices: DataFrame) -> DataFrame:
    """rows with dollars, by prices (model, per_million_in, per_million_out); a model without a price is an error."""
    from lodestrata.functions.text import price

    got = rows.join(F.broadcast(prices.select(F.col("model").alias("_m"), "per_million_in", "per_million_out")), F.col("model") == F.col("_m"), "left")
    cost = price(F.col("tokens_in"), F.col("tokens_out"), F.col("per_million_in"), F.col("per_million_out"))
    known = F.when(F.col("_m").isNotNull(), cost).otherwise(F.raise_error(F.concat(F.lit("no price for "), F.coalesce("model", F.lit("null")))).cast("double"))
    return got.select(*rows.columns, known.alias("dollars"))


def frontier(rows: DataFrame) -> DataFrame:
    """(place, arm, accuracy, cost, area): arms that none beats, by cost and then accuracy, with their raw area over depth."""
    arms = rows.groupBy(F.col("arm").alias("name")).agg(F.avg(F.col("correct").cast("double")).alias("accuracy"), F.avg(F.col("tokens_in") + F.col("tokens_out")).alias("cost"))
    curve = rows.groupBy("arm", "depth").agg(F.avg(F.col("recovered").cast("double")).alias("value"))
    one = curve.groupBy("arm").agg(F.count("*").alias("n"), F.max("value").alias("only"))
    area = curve_area(curve, False).join(one, "arm").select(F.col("arm").alias("name"), F.when(F.col("n") == 1, F.col("only")).otherwise(F.col("area")).alias("area"))
    got = pareto(kept(arms)).join(area, "name")
    place = F.row_number().over(Window.orderBy("cost", F.col("accuracy").desc(), "name")).cast("long")  # a row an arm
    return got.select(place.alias("place"), F.col("name").alias("arm"), "accuracy", "cost", "area")


def factorized(rows: DataFrame) -> DataFrame:
    """By arm and depth: recall, kappa (compliance over recall, null without recall), and score intervals of both."""
    g = rows.groupBy("arm", "depth").agg(F.sum("recall").alias("r"), F.sum("compliance").alias("c"), F.count("*").alias("n"))
    clip = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    k, p = F.when(F.col("r") != 0, F.col("c") / F.col("r")), F.col("r") / F.col("n")
    low, high = wilson(clip(k) * F.col("r"), F.col("r"))
    ret_low, ret_high = wilson(clip(p) * F.col("n"), F.col("n"))
    return g.select("arm", "depth", "n", p.alias("p_ret"), k.alias("kappa"), low.alias("low"), high.alias("high"), ret_low.alias("ret_low"), ret_high.alias("ret_high"))


def cost_per_correct(rows: DataFrame) -> DataFrame:
    """(model, cost): tokens a correct attempt; infinite where none is correct."""
    g = rows.groupBy("model").agg(F.sum(F.col("tokens_in") + F.col("tokens_out")).alias("t"), F.count_if("correct").alias("c"))
    return g.select("model", F.when(F.col("c") > 0, F.col("t") / F.col("c")).otherwise(F.lit(float("inf"))).alias("cost"))


def cascade(ranked: DataFrame, most: int) -> DataFrame:
    """(qid, err, ap) of graded lists (qid, rank, grade): a reader stops at grade g with chance (2^g - 1) / 2^most; ap is over
    the relevant ones in the list, 0 without any."""
    stop = (F.pow(F.lit(2.0), F.col("grade")) - 1) / 2.0**most
    w = Window.partitionBy("qid").orderBy("rank")
    rel = (F.col("grade") > 0).cast("int")
    rows = ranked.withColumn("stop", stop).withColumn("before", F.coalesce(F.sum(F.log(1 - F.col("stop"))).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    rows = rows.withColumn("rel", rel).withColumn("hits", F.sum("rel").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = rows.groupBy("qid").agg(F.sum(F.col("stop") * F.exp("before") / F.col("rank")).alias("err"), F.sum(F.col("rel") * F.col("hits") / F.col("rank")).alias("s"), F.sum("rel").alias("r"))
    return g.select("qid", "err", F.when(F.col("r") == 0, 0.0).otherwise(F.col("s") / F.col("r")).alias("ap"))
