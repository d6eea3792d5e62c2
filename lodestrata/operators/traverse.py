"""Bounded walks over typed edges in breadth-first order, many at once, and the ranking arms that rest on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.operators import graph
from lodestrata.operators.lexical import exact_sum
from lodestrata.operators.lineage import kept

HOPS_MOST = 3


def neighbours(edges: DataFrame, direction: str = "both", rels: tuple[str, ...] = (), least: float = 0.0) -> DataFrame:
    """edges (seq, src, dst, rel, confidence) as steps (a, b, back, seq, rel, confidence, dst): out-edges before in-edges,
    each in the order of seq; an edge from a node to itself is two steps under ``both``."""
    e = edges.where(F.col("confidence") >= least)
    if rels:
        e = e.where(F.col("rel").isin(*rels))
    cols = ["seq", "rel", "confidence", "dst"]
    out = e.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(0).alias("back"), *cols)
    back = e.select(F.col("dst").alias("a"), F.col("src").alias("b"), F.lit(1).alias("back"), *cols)
    return {"out": out, "in": back, "both": out.unionByName(back)}[direction]


def traverse(edges: DataFrame, seeds: DataFrame, hops: int = 2, max_nodes: int = 100, direction: str = "both", rels: tuple[str, ...] = (), least: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(walk, node, depth, ord, truncated) in breadth-first order, and the steps followed (walk, seq, rel, dst, depth).

    seeds: (walk, node, pos), a row a start, pos in the order of starts.  Hops are held within 1 and 3.  A node is found by
    the first step that reaches it: by its parent's place, out-edges before in-edges, then seq.  A walk stops at max_nodes
    nodes; truncated says that it left some out.  Steps from every node above the last depth count as followed, those
    that lead to known nodes too.  A level is kept before the next one begins.
    """
    if max_nodes < 1:
        raise ValueError("max_nodes must be 1 at least")
    steps = neighbours(edges, direction, rels, least)
    w = Window.partitionBy("walk")
    first = seeds.groupBy("walk", "node").agg(F.min("pos").alias("pos")).withColumn("ord", F.row_number().over(w.orderBy("pos", "node")))
    front = kept(first.select("walk", "node", F.lit(0).alias("depth"), "ord"))
    seen, followed, cut = front, None, None
    for level in range(1, min(max(hops, 1), HOPS_MOST) + 1):
        took = kept(front.join(steps, front["node"] == steps["a"]).select("walk", "ord", "back", "seq", "rel", "dst", "b"))
        mine = took.select("walk", "seq", "rel", "dst", F.lit(level).alias("depth"))
        followed = mine if followed is None else followed.unionByName(mine)
        new = took.groupBy("walk", F.col("b").alias("node")).agg(F.min(F.struct("ord", "back", "seq")).alias("by"))
        new = new.join(seen.select("walk", "node"), ["walk", "node"], "left_anti")
        have = seen.groupBy("walk").agg(F.count("*").alias("have"))
        new = new.join(have, "walk").withColumn("ord", F.col("have") + F.row_number().over(w.orderBy("by")))
        new = kept(new.select("walk", "node", F.lit(level).alias("depth"), F.col("ord").cast("int").alias("ord")))
        over = new.where(F.col("ord") > max_nodes).select("walk").distinct()
        cut = over if cut is None else cut.unionByName(over)
        front = new.where(F.col("ord") <= max_nodes)
        seen = seen.unionByName(front)
    out = seen.join(cut.distinct().withColumn("truncated", F.lit(True)), "walk", "left")
    return out.select("walk", "node", "depth", "ord", F.coalesce("truncated", F.lit(False)).alias("truncated")), followed


def follow_links(edges: DataFrame, ranked: DataFrame, hops: int = 2, seeds: int = 5, final: str = "constrains") -> DataFrame:
    """(qid, doc, rank): from each of a query's best ``seeds`` documents (qid, doc, rank) a walk of its own; a walk that
    follows an edge of kind ``final`` keeps its start and the targets of such edges alone; walks follow one another in the
    order of their starts, and a document counts where it comes first."""
    top = kept(ranked.where(F.col("rank") <= seeds).select("qid", "doc", "rank"))
    starts = top.select(F.struct("qid", "rank").alias("walk"), F.col("doc").alias("node"), F.lit(0).alias("pos"))
    nodes, followed = traverse(edges, starts, hops)
    ends = kept(followed.where(F.col("rel") == final).select("walk", F.col("dst").alias("node")).distinct())
    has = ends.select("walk").distinct().withColumn("has", F.lit(True))
    rows = nodes.join(ends.withColumn("end", F.lit(True)), ["walk", "node"], "left").join(has, "walk", "left")
    rows = rows.where(F.col("has").isNull() | (F.col("depth") == 0) | F.col("end").isNotNull())
    first = rows.groupBy(F.col("walk.qid").alias("qid"), F.col("node").alias("doc")).agg(F.min(F.struct(F.col("walk.rank").alias("s"), "ord")).alias("at"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("at", "doc")).cast("long")).select("qid", "doc", "rank")


def traversal_counts(edges: DataFrame, followed: DataFrame, tick: int) -> DataFrame:
    """edges (seq, ..., traversal_count, last_tick) with the steps of a retrieval counted on them."""
    n = followed.groupBy("seq").agg(F.count("*").alias("n"))
    got = edges.join(n, "seq", "left")
    return got.select(*[c for c in edges.columns if c not in ("traversal_count", "last_tick")], (F.coalesce("traversal_count", F.lit(0)) + F.coalesce("n", F.lit(0))).cast("int").alias("traversal_count"), F.when(F.col("n") > 0, F.lit(tick)).otherwise(F.col("last_tick")).alias("last_tick"))


def follow_links_then_decay(edges: DataFrame, ranked: DataFrame, tick: int = 0, hops: int = 2, seeds: int = 5) -> tuple[DataFrame, DataFrame]:
    """follow_links() and the edges as the retrieval leaves them: its steps counted, then one pass of decay at the next tick."""
    top = ranked.where(F.col("rank") <= seeds)
    starts = top.select(F.struct("qid", "rank").alias("walk"), F.col("doc").alias("node"), F.lit(0).alias("pos"))
    _, followed = traverse(edges, starts, hops)
    return follow_links(edges, ranked, hops, seeds), graph.decayed(traversal_counts(edges, followed, tick), tick + 1)


def fuse_with_walk(edges: DataFrame, ranked: DataFrame, hops: int = HOPS_MOST, seeds: int = 5, k: float = 60.0) -> DataFrame:
    """(qid, doc, score): reciprocal ranks, from 1, of a ranking and of the breadth-first order of a walk from its best."""
    starts = ranked.where(F.col("rank") <= seeds).select(F.col("qid").alias("walk"), F.col("doc").alias("node"), F.col("rank").alias("pos"))
    nodes, _ = traverse(edges, starts, hops)
    both = ranked.select("qid", "doc", "rank").unionByName(nodes.select(F.col("walk").alias("qid"), F.col("node").alias("doc"), F.col("ord").cast("long").alias("rank")))
    return both.groupBy("qid", "doc").agg(exact_sum(1e6 / (k + F.col("rank"))).alias("x")).select("qid", "doc", (F.col("x") / 1e6).alias("score"))


def activated(edges: DataFrame, ranked: DataFrame, seeds: int = 5, hops: int = 3, decay: float = 0.5) -> DataFrame:
    """(qid, doc, score): activation spread from a query's best documents, each starting at 1; only what it reaches."""
    steps = kept(graph.directed(edges, "out").select("a", "b", "confidence"))
    now = kept(ranked.where(F.col("rank") <= seeds).select("qid", F.col("doc").alias("node"), F.lit(1.0).alias("x")))
    total = now
    for _ in range(hops):
        moved = now.join(steps, now["node"] == steps["a"]).groupBy("qid", F.col("b").alias("n")).agg(exact_sum(decay * F.col("x") * F.col("confidence")).alias("x"))
        now = kept(moved.where("x <> 0").select("qid", F.col("n").alias("node"), "x"))
        total = total.unionByName(now)
    return total.groupBy("qid", F.col("node").alias("doc")).agg(exact_sum(F.col("x")).alias("score"))
