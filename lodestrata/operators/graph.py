"""Walks over typed edges (src, dst, rel, confidence) as joins by level."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.operators.lineage import kept


def directed(edges: DataFrame, direction: str = "both", rels: tuple[str, ...] = (), least: float = 0.0) -> DataFrame:
    """(a, b, rel, confidence): edges as steps a -> b, filtered."""
    if rels:
        edges = edges.where(F.col("rel").isin(*rels))
    edges = edges.where(F.col("confidence") >= least)
    out = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "rel", "confidence")
    back = edges.select(F.col("dst").alias("a"), F.col("src").alias("b"), "rel", "confidence")
    return {"out": out, "in": back, "both": out.unionAll(back)}[direction]


def degree(edges: DataFrame) -> DataFrame:
    return directed(edges).groupBy("a").agg(F.count("*").alias("degree"), F.countDistinct("b").alias("neighbours"))


def reach(edges: DataFrame, seeds: DataFrame, hops: int, direction: str = "both", rels: tuple[str, ...] = (), least: float = 0.0) -> DataFrame:
    """(seed, node, depth): nodes within hops (1 to 3) steps of each seed, at their least depth; seeds at 0."""
    steps = directed(edges, direction, rels, least).select("a", "b")
    front = seeds.select("seed", F.col("seed").alias("node"))
    seen = front.withColumn("depth", F.lit(0))
    for level in range(1, min(max(hops, 1), 3) + 1):
        nxt = front.join(steps, front["node"] == steps["a"]).select("seed", F.col("b").alias("node")).distinct()
        front = kept(nxt.join(seen.select("seed", "node"), ["seed", "node"], "left_anti"))
        seen = seen.unionByName(front.withColumn("depth", F.lit(level)))
    return seen


def walk(edges: DataFrame, seeds: DataFrame, hops: int, final: str) -> DataFrame:
    """reach(), but where a seed's walk follows an edge labelled ``final``, only the seed and such edges' ends stay."""
    seen = reach(edges, seeds, hops)
    ends = seen.where(F.col("depth") < hops).join(directed(edges), F.col("node") == F.col("a")).where(F.col("rel") == final)
    ends = ends.join(edges.where(F.col("rel") == final).select(F.col("dst").alias("t")).distinct(), F.col("b") == F.col("t"), "left_semi").select("seed", F.col("b").alias("node")).distinct()
    flagged = ends.select("seed").distinct().withColumn("has", F.lit(True))
    kept = seen.join(ends.withColumn("end", F.lit(True)), ["seed", "node"], "left").join(flagged, "seed", "left")
    return kept.where(F.col("has").isNull() | F.col("end").isNotNull() | (F.col("depth") == 0)).select("seed", "node", "depth")


def spread(edges: DataFrame, seeds: DataFrame, hops: int = 3, decay: float = 0.5, threshold: float = 0.0, direction: str = "out") -> DataFrame:
    """(seed, node, activation): each hop passes decay * activation * confidence on; totals add up over hops."""
    steps = directed(edges, direction).select("a", "b", "confidence")
    now = seeds.select("seed", F.col("seed").alias("node"), F.lit(1.0).alias("x"))
    parts = [now]
    for _ in range(hops):
        firing = now.where(F.col("x") >= threshold)
        now = firing.join(steps, firing["node"] == steps["a"]).groupBy("seed", F.col("b").alias("n")).agg(F.sum(decay * F.col("x") * F.col("confidence")).alias("x"))
        now = kept(now.where("x <> 0").select("seed", F.col("n").alias("node"), "x"))
        parts.append(now)
    return reduce(DataFrame.unionByName, parts).groupBy("seed", "node").agg(F.sum("x").alias("activation"))


def added(c: Column, n: Column) -> Column:
    """c added to 0 n times over, one after the other: what a sum over n equal rows gives, however tasks would share them."""
    stretch = lambda j: F.sequence(F.lit(1), F.least(F.lit(65536).cast("long"), n - j * 65536).cast("int"))
    many = F.aggregate(F.sequence(F.lit(0), ((n - 1) / 65536).cast("int")), F.lit(0.0), lambda s, j: F.aggregate(stretch(j), s, lambda t, i: t + c))
    return F.when(n == 1, c).otherwise(many)


def pagerank(edges: DataFrame, nodes: DataFrame, restart: Column, alpha: float = 0.15, iterations: int | None = None, cut: int = 5, tolerance: float = 1e-12, most: int = 200) -> DataFrame:
    """(node, mass) where a step changes the masses by less than ``tolerance`` in sum (after ``most`` steps at the latest),
    or after ``iterations`` steps if given.  restart: a weight by node, normalised here; nodes without out-edges hand their
    mass to it.  Parallel edges add.  Each step is kept, so none is worked out twice; equal shares that a node gets are counted and
    added one by one, so its mass doesn't depend on which task met which edge."""
    out = edges.groupBy("src", "dst").agg(F.sum("confidence").alias("w"))
    total = out.groupBy("src").agg(F.sum("w").alias("t"))
    step = out.join(total, "src").select("src", "dst", (F.col("w") / F.col("t")).alias("p"))
    base = nodes.select("node", restart.cast("double").alias("s"))
    whole = base.agg(F.sum("s").alias("s"), F.count("*").alias("n")).first()
    base = base.select("node", (F.col("s") / whole["s"] if whole["s"] else F.lit(1.0 / max(1, whole["n"]))).alias("s"))
    base = base.join(total.select(F.col("src").alias("node"), F.lit(True).alias("has")), "node", "left").select("node", "s", F.col("has").isNull().alias("dangling"))
    if iterations is None:
        return _settled(base, step, alpha, tolerance, most, cut)
    base, step = kept(base), kept(step)
    mass = base.withColumn("m", F.col("s"))
    for _ in range(iterations):
        loose = mass.agg(F.sum(F.when(F.col("dangling"), F.col("m")))).first()[0] or 0.0
        shares = mass.where("m <> 0").join(step, mass["node"] == step["src"]).groupBy("dst", (F.col("m") * F.col("p")).alias("c")).agg(F.count("*").alias("n"))
        flow = shares.groupBy("dst").agg(F.sum(added(F.col("c"), F.col("n"))).alias("f"))
        mass = mass.join(flow, mass["node"] == flow["dst"], "left")
        new = (1 - alpha) * (F.coalesce("f", F.lit(0.0)) + loose * F.col("s")) + alpha * F.col("s")
        mass = kept(mass.select("node", "s", "dangling", new.alias("m")))
    return mass.select("node", F.col("m").alias("mass"))


def _settled(base: DataFrame, step: DataFrame, alpha: float, tolerance: float, most: int, cut: int) -> DataFrame:
    """The fixed point of pagerank().

    What dangling nodes hand back goes where the restart goes, so the fixed point is the sum of (1 - alpha)^k times the
    restart after k steps along edges, scaled to 1.  Only nodes that the walk reaches move, and without cycles it ends.
    """
    if not 0 < alpha <= 1 or tolerance <= 0 or most < 1:
        raise ValueError("alpha must lie in (0, 1], the tolerance above 0, the steps at 1 at least")
    front = kept(base.where("s > 0").select("node", F.col("s").alias("m")))
    parts = [front]
    for _ in range(most):
        front = kept(front.join(step, front["node"] == step["src"]).groupBy(F.col("dst").alias("node")).agg(((1 - alpha) * F.sum(F.col("m") * F.col("p"))).alias("m")))
        moved = front.agg(F.sum("m")).first()[0] or 0.0
        parts.append(front)
        if 2 * moved < tolerance:  # scaled, the sums change by twice that at most
            break
        if len(parts) > cut:
            parts = [kept(reduce(DataFrame.unionByName, parts).groupBy("node").agg(F.sum("m").alias("m")))]
    total = reduce(DataFrame.unionByName, parts).groupBy("node").agg(F.sum("m").alias("m"))
    whole = total.agg(F.sum("m")).first()[0] or 1.0
    return base.select("node").join(total, "node", "left").select("node", (F.coalesce("m", F.lit(0.0)) / whole).alias("mass"))


def decayed(edges: DataFrame, tick: int, rate: float = 0.1, stale: int = 1, restore_at: int = 10, restore: float = 0.75, prune: float = 0.1) -> DataFrame:
    """Edges with their new confidence and what happened (reinforced, decayed, kept), without those pruned.

    Often followed edges gain restore * rate, up to 1; those never followed, or not for ``stale`` ticks, lose the share
    rate; then edges below prune that nobody followed go.
    """
    often = F.col("traversal_count") >= restore_at
    old = (F.col("traversal_count") == 0) | F.col("last_tick").isNull() | (tick - F.col("last_tick") >= stale)
    conf = F.when(often, F.least(F.lit(1.0), F.col("confidence") + restore * rate)).when(old, F.col("confidence") * (1 - rate)).otherwise(F.col("confidence"))
    what = F.when(often, "reinforced").when(old, "decayed").otherwise("kept")
    out = edges.withColumn("what", what).withColumn("confidence", conf)
    return out.where(~((F.col("confidence") < prune) & (F.col("traversal_count") == 0)))


def current_of(items: DataFrame, links: DataFrame) -> DataFrame:
    """(chain, item) that nothing supersedes; links (chain, src, dst): src supersedes dst.  A chain in which that is not
    exactly one item is an error."""
    old = links.select("chain", F.col("dst").alias("item")).distinct().withColumn("old", F.lit(True))
    marked = items.select("chain", "item").distinct().join(old, ["chain", "item"], "left")
    live = marked.groupBy("chain").agg(F.count_if(F.col("old").isNull()).alias("n"), F.min(F.when(F.col("old").isNull(), F.col("item"))).alias("item"))
    ok = F.when(F.col("n") == 1, F.col("item")).otherwise(F.raise_error(F.concat(F.lit("a chain has "), F.col("n").cast("string"), F.lit(" current items"))))
    return live.select("chain", ok.cast(items.schema["item"].dataType).alias("item"))


def checked_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges, or an error where an end is no node or a confidence lies outside 0 to 1."""
    ids = nodes.select("node").distinct()
    a = ids.select(F.col("node").alias("src"), F.lit(True).alias("_a"))
    b = ids.select(F.col("node").alias("dst"), F.lit(True).alias("_b"))
    ok = F.col("_a").isNotNull() & F.col("_b").isNotNull() & F.col("confidence").between(0, 1)
    rows = edges.join(a, "src", "left").join(b, "dst", "left").withColumn("_ok", F.when(ok, True).otherwise(F.raise_error(F.lit("an edge without a node at either end, or with a confidence outside 0 to 1")).cast("boolean")))
    return rows.where("_ok").select(*edges.columns)


def unique_nodes(nodes: DataFrame) -> DataFrame:
    """nodes, or an error where an id is empty or stands twice."""
    n = F.count("*").over(Window.partitionBy("node"))
    ok = F.when((n == 1) & (F.col("node") != ""), True).otherwise(F.raise_error(F.lit("a node id is empty or stands twice")).cast("boolean"))
    return nodes.withColumn("_ok", ok).where("_ok").drop("_ok")


def without_dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    ids = nodes.select("node")
    half = edges.join(ids, edges["dst"] == ids["node"], "left_semi")
    return half.join(ids, half["src"] == ids["node"], "left_semi")
