"""Queries on vectors, graphs, metrics and tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions import text as tx
from lodestrata.operators import evaluate as ev
from lodestrata.operators import graph as gr
from lodestrata.operators import lexical, vector
from lodestrata.operators.lineage import kept
from lodestrata.plans.ranking import K, _BASE, _IDENTIFIERS, _PLUS, _plus, asked, corpus, table


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


def _near(spark, sf, k=K):
    """The query set is every vector whose id is divisible by 50, against all vectors."""
    v = _vectors(spark, sf)
    return vector.top_k(v.where("id % 50 = 0"), v, k)


def dense_topk(spark, sf):
    return _near(spark, sf).select("qid", "doc", "rank", F.round("score", 6).alias("score"))


def mmr_order(spark, sf):
    return vector.mmr(_near(spark, sf, 20), _vectors(spark, sf))


def cluster_tree_rank(spark, sf):
    return vector.cluster_tree(_near(spark, sf, 20), _vectors(spark, sf))


def vector_label_metrics(spark, sf):
    """Neighbours of the same label count as relevant."""
    labels = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc"), "label")
    near = _near(spark, sf).join(labels, "doc").join(labels.select(F.col("doc").alias("qid"), F.col("label").alias("want")), "qid")
    return near.groupBy("qid").agg(F.count_if(F.col("label") == F.col("want")).alias("same"), F.count("*").alias("n"))


# graph: nation -> region, customer -> nation, supplier -> nation, order -> customer


def _edges(spark, sf):
    t = lambda n: table(spark, sf, n)
    node = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    e = lambda df, a, b, rel, conf: df.select(a.alias("src"), b.alias("dst"), F.lit(rel).alias("rel"), F.lit(conf).alias("confidence"))
    return lexical.union_all(
        [
            e(t("nation"), node("n", "n_nationkey"), node("r", "n_regionkey"), "constrains", 0.9),
            e(t("customer"), node("c", "c_custkey"), node("n", "c_nationkey"), "part_of", 0.8),
            e(t("supplier"), node("s", "s_suppkey"), node("n", "s_nationkey"), "part_of", 0.7),
            e(t("orders"), node("o", "o_orderkey"), node("c", "o_custkey"), "caused_by", 0.6),
        ]
    )


def _regions(spark, sf):
    return table(spark, sf, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("seed"))


def _nations(spark, sf):
    return table(spark, sf, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("seed"))


def graph_neighbors(spark, sf):
    return gr.degree(_edges(spark, sf)).select(F.col("a").alias("node"), "degree", "neighbours")


def graph_bfs(spark, sf):
    return gr.reach(_edges(spark, sf), _regions(spark, sf), 3).withColumn("depth", F.col("depth").cast("long"))


def graph_bfs_directed(spark, sf):
    orders = table(spark, sf, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("seed"))
    seen = gr.reach(_edges(spark, sf), orders, 3, "out", least=0.5)
    return seen.groupBy("node").agg(F.count("*").alias("n"), F.min("depth").cast("long").alias("least"), F.max("depth").cast("long").alias("most"))


def graph_walk_1hop(spark, sf):
    return gr.walk(_edges(spark, sf), _nations(spark, sf), 1, "constrains").withColumn("depth", F.col("depth").cast("long"))


def graph_walk_3hop(spark, sf):
    return gr.walk(_edges(spark, sf), _nations(spark, sf), 3, "constrains").withColumn("depth", F.col("depth").cast("long"))


def spread_activation(spark, sf):
    orders = table(spark, sf, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("seed"))
    got = gr.spread(_edges(spark, sf), orders)
    return got.groupBy("node").agg(F.round(F.sum("activation"), 6).alias("activation"), F.count("*").alias("n_seeds"))


def _orders_rank(spark, sf, **how):
    edges = _edges(spark, sf)
    nodes = edges.select(F.col("src").alias("node")).unionAll(edges.select("dst")).distinct()
    return gr.pagerank(edges, nodes, F.when(F.col("node").startswith("o"), 1.0).otherwise(0.0), **how)


def pagerank_fixed_iter(spark, sf):
    return _orders_rank(spark, sf, iterations=4).select("node", F.round("mass", 9).alias("mass"))


def pagerank_converged(spark, sf):
    return _orders_rank(spark, sf).select("node", F.round("mass", 9).alias("mass"))


def _tracked(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("dst"), F.lit("caused_by").alias("rel"), (F.col("o_totalprice") / 500000).alias("confidence"),
        (F.col("o_orderkey") % 12).cast("int").alias("traversal_count"), F.when(F.col("o_orderkey") % 12 > 0, (F.col("o_orderkey") % 3).cast("int")).alias("last_tick"),
    )


def edge_decay(spark, sf):
    return gr.decayed(_tracked(spark, sf), 2).select("src", "dst", F.round("confidence", 9).alias("confidence"), "what")


def decay_report(spark, sf):
    kept = gr.decayed(_tracked(spark, sf), 2)
    return kept.groupBy("what").agg(F.count("*").alias("n"))


# metrics of the BM25+ ranking; gold: documents that contain the item's text


def _gold(spark, sf):
    """Documents that contain an item's text.  A document with the text has its first WORDS whole words in a row, so
    those are joined first, by hash; the texts themselves are compared for such pairs only."""
    return kept(containing(corpus(spark, sf), asked(spark, sf)))


WORDS = 4


def containing(docs, items):
    """(qid, doc): docs (doc, text) that contain the text of items (qid, text).  Words are runs of ASCII letters, digits and
    underscores; an item's second to fifth stand whole in any text that contains it.  Items with fewer words, or none, are
    compared with every document."""
    words = tx.cased_tokens(F.col("text"))
    keyed = kept(items.select("qid", "text", words.alias("ws")).withColumn("key", F.when(F.size("ws") > WORDS + 1, F.xxhash64(*[F.get("ws", F.lit(i + 1)) for i in range(WORDS)]))))
    small = keyed.count() <= lexical.BROADCAST_WORDS
    sent = F.broadcast if small else (lambda df: df)
    w = F.col("ws")
    rows = docs.select("doc", F.col("text").alias("whole"), words.alias("ws"))
    runs = F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - WORDS, F.lit(0))), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(WORDS)])))
    near = rows.select("doc", F.explode(runs).alias("key")).join(sent(keyed.where("key is not null").select("qid", "key")), "key").select("doc", "qid").distinct()
    some = kept(near)
    long = docs.join(some, "doc").join(sent(keyed.select("qid", F.col("text").alias("part"))), "qid").where(F.contains("text", "part")).select("qid", "doc")
    short = sent(keyed.where("key is null").select("qid", F.col("text").alias("part")))
    return long.unionByName(docs.join(short, F.contains(F.col("text"), F.col("part"))).select("qid", "doc")).distinct()


def _ranked(spark, sf):
    return lexical.best(_plus(spark, sf)[1], K)


def retrieval_metrics(spark, sf):
    return ev.retrieval_scores(_ranked(spark, sf), _gold(spark, sf), asked(spark, sf))


def mean_metrics(spark, sf):
    m = retrieval_metrics(spark, sf)
    return m.agg(*[F.round(F.avg(c), 5).alias(f"mean_{c}") for c in ("precision", "recall", "rr", "ap", "ndcg")], F.count_if("chain_recovered").alias("recovered"))


def _attempts(spark, sf):
    e = table(spark, sf, "events")
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select(F.col("user_id").alias("task"), nth.cast("long").alias("attempt"), k.alias("tokens"), "event_type", "value", (k >= 90).alias("correct"))


def cost_to_correct(spark, sf):
    rows = _attempts(spark, sf).withColumn("dollars", F.col("tokens") * 3 / 1000000)
    got = ev.cost_to_correct(rows)
    return got.select("task", "attempts", "resolved", "tokens", F.round("dollars", 9).alias("dollars"))


def return_on_tokens(spark, sf):
    g = _attempts(spark, sf).groupBy("event_type").agg(F.sum("tokens").alias("t"), F.count_if("correct").alias("c"))
    return g.select("event_type", F.round(1000 * F.col("c") / F.col("t"), 6).alias("per_1k"), F.round(F.col("t") / F.nullif("c", F.lit(0)), 6).alias("tokens_per_correct"))


def _compliance(spark, sf):
    """A turn must keep what the user said before it in its conversation: (conv_id, turn, role, text, total, honoured, ids)."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    said = c.where("role = 'user'").select("conv_id", F.col("turn").alias("t"), F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.col("text").alias("decision"))
    text = F.coalesce("text", F.lit(""))
    pairs = c.join(said, "conv_id").where("t < turn")
    ok = pairs.withColumn("ok", tx.honoured(F.col("decision"), F.col("id"), text))
    got = ok.groupBy("conv_id", "turn").agg(F.count("*").alias("total"), F.count_if("ok").alias("honoured"), F.sort_array(F.collect_list(F.when(F.col("ok"), F.struct("t", "id")))).alias("ids"))
    zero = F.lit(0).cast("long")
    rows = c.join(got, ["conv_id", "turn"], "left")
    return rows.select("conv_id", "turn", "role", "text", F.coalesce("total", zero).alias("total"), F.coalesce("honoured", zero).alias("honoured"), F.coalesce(F.array_join(F.transform("ids", lambda x: x["id"]), "|"), F.lit("")).alias("honoured_ids"))


def compliance_score(spark, sf):
    """How many of the user's earlier turns a turn keeps: by the identifiers that they name, else by their ids; 1 without any."""
    rate = F.when(F.col("total") == 0, 1.0).otherwise(F.col("honoured") / F.col("total"))
    return _compliance(spark, sf).select("conv_id", "turn", "total", "honoured", "honoured_ids", F.round(rate, 6).alias("rate"))


def merge_ready(spark, sf):
    """Whether a turn could be taken as it is, and why not: empty, a refusal, or something unkept."""
    c = _compliance(spark, sf)
    missed = F.col("total") - F.col("honoured")
    text = tx.stripped(F.col("text"))
    why = F.when(text == "", "empty response").when(tx.refuses(text), "refusal")
    why = why.when(missed > 0, F.concat(missed.cast("string"), F.lit("/"), F.col("total").cast("string"), F.lit(" governing decisions unmet"))).otherwise("all governing decisions honoured")
    return c.select("conv_id", "turn", why.alias("reason"), ((text != "") & ~tx.refuses(text) & (missed == 0)).alias("ready"))


def session_text(spark, sf):
    c = table(spark, sf, "conversations")
    turns = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "text").alias("line")))).alias("ts"), F.count("*").alias("n_turns"))
    return turns.select("conv_id", "n_turns", F.sha2(F.array_join(F.transform("ts", lambda t: t["line"]), "\n"), 256).alias("text_sha256"))


def recall_distance(spark, sf):
    """How many turns lie between a turn and the last one of its conversation."""
    c = table(spark, sf, "conversations")
    w = Window.partitionBy("conv_id")
    return c.select("conv_id", "turn", (F.max("turn").over(w) - F.col("turn")).alias("distance"))


def _probabilities(spark, sf):
    return table(spark, sf, "lineitem").select((F.col("l_discount") * 10).alias("p"), (F.col("l_quantity") > 25).cast("int").alias("y"))


def reliability_curve(spark, sf):
    return ev.reliability_bins(_probabilities(spark, sf), "p", "y").select("bin", "count", F.round("mean_p", 6).alias("mean_p"), F.round("mean_y", 6).alias("mean_y"))


def brier_decomposition(spark, sf):
    return ev.calibration(_probabilities(spark, sf), "p", "y")


def _ratings(spark, sf):
    lab = table(spark, sf, "labels")
    return lab.select(F.col("doc_id").alias("unit"), F.explode(F.array("quality", 1 - F.col("toxic"))).alias("label"))


def fleiss(spark, sf):
    return ev.fleiss_counts(_ratings(spark, sf)).select(*[F.round(c, 6).alias(c) for c in ("p_bar", "p_e", "kappa")])


def krippendorff(spark, sf):
    return ev.krippendorff(_ratings(spark, sf)).select(F.round("alpha", 6).alias("alpha"))


def cohen_weighted(spark, sf):
    lab = table(spark, sf, "lineitem").select("l_linenumber", F.ceil(F.col("l_quantity") / 8).cast("int").alias("q"))
    rows = [(w, round(ev.cohens_kappa(lab, "l_linenumber", "q", w), 6)) for w in ("none", "linear", "quadratic")]
    return spark.createDataFrame(rows, "weights string, kappa double")


def certify_depths(spark, sf):
    """Two raters' depths of an order: certified at the lesser one unless they differ by more than one."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("task"), (1 + F.col("o_orderkey") % 3).alias("a"), (1 + F.col("o_custkey") % 3).alias("b"))
    return o.where(F.abs(F.col("a") - F.col("b")) <= 1).groupBy(F.least("a", "b").alias("depth")).agg(F.count("*").alias("n"), F.count_if(F.col("a") == F.col("b")).alias("exact"))


# tables over scored rows: lineitem by dataset, arm and depth


def _scored(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(
        F.col("l_returnflag").alias("dataset"), F.concat_ws("-", "l_returnflag", "l_linestatus").alias("arm"), F.col("l_linenumber").cast("long").alias("depth"), F.col("l_orderkey").alias("task"),
        (F.col("l_discount") * 10).alias("compliance"), (F.col("l_quantity") > 10 + 4 * F.col("l_linenumber")).alias("recovered"), (1 - F.col("l_tax") * 5).alias("recall"), F.col("l_extendedprice").alias("cost"), "l_quantity",
    )


def headline(spark, sf):
    return _scored(spark, sf).groupBy("dataset", "arm").agg(F.round(F.avg("compliance"), 6).alias("compliance"))


def depth_crossover(spark, sf):
    return _scored(spark, sf).groupBy("arm", "depth").agg(F.round(F.avg(F.col("recovered").cast("double")), 6).alias("recovery"))


def ablation(spark, sf):
    cells = F.expr("CASE WHEN depth = 1 THEN 'shallow' WHEN depth = 3 THEN 'middle' WHEN depth = 7 THEN 'deep' END")
    return _scored(spark, sf).withColumn("label", cells).where("label IS NOT NULL").groupBy("label").agg(F.round(F.avg("compliance"), 6).alias("compliance"), F.count("*").alias("n"))


def crossover_pivot_all(spark, sf):
    """Recovery by arm, with a column for each depth that occurs."""
    s = _scored(spark, sf)
    depths = sorted(r[0] for r in s.select("depth").where("depth IS NOT NULL").distinct().collect())  # few
    got = s.groupBy("arm").pivot("depth", depths).agg(F.round(F.avg(F.col("recovered").cast("double")), 6))
    return got.select("arm", *[F.col(f"`{d}`").alias(f"d{d}") for d in depths])


DATASETS = ("alpha", "beta", "gamma")
ABLATION = (("none", 1, "full/none"), ("none", 3, "stripped/none"), ("words", 3, "stripped/words"), ("walk", 3, "stripped/walk"))


def _runs(spark, sf):
    """lineitem as attempts: dataset, arm, model, depth, spec, compliance, recovered, recall, correct, tokens, dollars."""
    li = table(spark, sf, "lineitem")
    pick = lambda names, n: F.element_at(F.array(*[F.lit(x) for x in names]), (n % len(names) + 1).cast("int"))
    return li.select(
        F.col("l_orderkey").alias("task_id"), pick(DATASETS, F.col("l_orderkey")).alias("dataset"), pick(("none", "words", "walk"), F.col("l_partkey")).alias("arm"),
        pick(("one-large", "one-small", "two"), F.col("l_suppkey")).alias("model"), ((F.col("l_linenumber") - 1) % 3 + 1).cast("long").alias("depth"), (F.col("l_discount") * 10).alias("compliance"),
        (F.col("l_quantity") > 20).alias("recovered"), (1 - F.col("l_tax") * 5).alias("recall"), (F.col("l_quantity") > 30).alias("correct"), F.col("l_quantity").alias("tokens_in"), (F.col("l_quantity") / 2).alias("tokens_out"),
    )


def headline_line(spark, sf):
    """Mean compliance by dataset and arm for one line of models."""
    return ev.headline(_runs(spark, sf), "one-").select("dataset", "arm", F.round("compliance", 6).alias("compliance"))


def crossover_line(spark, sf):
    """Recovery by arm and depth, on the datasets that can be stripped and one line of models."""
    return ev.depth_crossover(_runs(spark, sf), DATASETS[:2], "one-").select("arm", "depth", F.round("recovery", 6).alias("recovery"))


def robustness(spark, sf):
    """Mean compliance by dataset and model with the arm held fixed."""
    return ev.robustness(_runs(spark, sf), "walk").select("dataset", "model", F.round("compliance", 6).alias("compliance"))


def ablation_cells(spark, sf):
    """Cells of arm and depth by their labels; cells without a label are left out."""
    cells = spark.createDataFrame(list(ABLATION), "arm string, depth long, label string")
    return ev.ablation(_runs(spark, sf), cells, DATASETS[:2], "one-").select("label", F.round("compliance", 6).alias("compliance"), "n")


def two_tier(spark, sf):
    """Measured means and the claims of others, side by side and never averaged together."""
    claims = table(spark, sf, "part").select(F.concat_ws("/", "p_name", F.col("p_partkey").cast("string")).alias("system"), (F.col("p_retailprice") / 1000).alias("value"), (F.col("p_partkey") % 3 == 0).alias("needs_citation"))
    return ev.two_tier(_runs(spark, sf), claims).select("tier", "name", F.round("value", 6).alias("value"))


def priced_runs(spark, sf):
    """Dollars by model, by a table of prices a million tokens."""
    prices = spark.createDataFrame([("one-large", 3.0, 15.0), ("one-small", 1.0, 5.0), ("two", 5.0, 15.0)], "model string, per_million_in double, per_million_out double")
    return ev.priced(_runs(spark, sf), prices).groupBy("model").agg(F.round(F.sum(F.col("dollars") * 1e6), 3).alias("micro_dollars"))


def frontier_report(spark, sf):
    """Arms by mean tokens and share correct, cheapest first, with the area under their recovery by depth."""
    return ev.frontier(_runs(spark, sf)).select("place", "arm", F.round("accuracy", 6).alias("accuracy"), F.round("cost", 6).alias("cost"), F.round("area", 6).alias("area"))


def audc_raw(spark, sf):
    """The area under each arm's recovery by depth, not divided by its span."""
    return ev.curve_area(_curve(spark, sf), False).select("arm", F.round("area", 6).alias("area"))


def factor_rates(spark, sf):
    """Recall and what compliance makes of it, with score intervals for both shares."""
    return ev.factorized(_runs(spark, sf)).select("arm", "depth", "n", *[F.round(c, 6).alias(c) for c in ("p_ret", "kappa", "low", "high", "ret_low", "ret_high")])


def cost_per_correct(spark, sf):
    """Tokens for each correct attempt; infinite without one."""
    return ev.cost_per_correct(_runs(spark, sf).withColumn("correct", F.col("correct") & (F.col("model") != "two"))).select("model", F.round("cost", 6).alias("cost"))


def left_to_run(spark, sf):
    """Pairs of dataset and arm of a sweep that have no row yet."""
    grid = spark.createDataFrame([(d,) for d in (*DATASETS, "delta")], "dataset string").crossJoin(spark.createDataFrame([(a,) for a in ("none", "words", "walk", "other")], "arm string"))
    return grid.join(_runs(spark, sf).select("dataset", "arm").distinct(), ["dataset", "arm"], "left_anti")


def graded_err(spark, sf):
    """Expected reciprocal rank of graded lists: lines of an order by number, graded 0 to 4 by quantity."""
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("qid"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")).alias("rank"), F.floor(F.col("l_quantity") / 11).cast("int").alias("grade"))
    return ev.cascade(li, 4).select("qid", F.round("err", 6).alias("err"), F.round("ap", 6).alias("ap"))


def _points(spark, sf):
    s = _scored(spark, sf).groupBy("depth", "arm").agg(F.round(F.avg("compliance"), 6).alias("accuracy"), F.round(F.avg("cost"), 6).alias("cost"))
    return s.select(F.concat_ws("/", "arm", F.col("depth").cast("string")).alias("name"), "accuracy", "cost")


def pareto_frontier(spark, sf):
    return ev.pareto(_points(spark, sf)).select("name", "accuracy", "cost")


def dominated_set(spark, sf):
    p = _points(spark, sf)
    return p.join(ev.pareto(p).select("name"), "name", "left_anti").select("name")


def hypervolume(spark, sf):
    return ev.hypervolume(ev.pareto(_points(spark, sf)), 0.0, 100000.0).select(F.round("hypervolume", 3).alias("hypervolume"))


def _curve(spark, sf):
    return _scored(spark, sf).groupBy("arm", "depth").agg(F.avg(F.col("recovered").cast("double")).alias("value"))


def audc(spark, sf):
    return ev.curve_area(_curve(spark, sf)).select("arm", F.round("area", 6).alias("area"))


def half_life(spark, sf):
    return ev.half_life(_curve(spark, sf)).select("arm", F.round("half_life", 6).alias("half_life"))


def regret(spark, sf):
    s = _scored(spark, sf).groupBy("task", F.col("depth").alias("arm")).agg(F.max("compliance").alias("score"))
    return ev.regret(s).select("arm", F.round("regret", 6).alias("regret"), "n_tasks")


def factorization(spark, sf):
    g = _scored(spark, sf).groupBy("arm", "depth").agg(F.sum("recall").alias("r"), F.sum("compliance").alias("c"), F.count("*").alias("n"))
    low, high = ev.wilson(F.col("c") / F.col("n") * F.col("n"), F.col("n"))
    return g.select("arm", "depth", F.round(F.col("r") / F.col("n"), 6).alias("p_ret"), F.round(F.when(F.col("r") != 0, F.col("c") / F.col("r")), 6).alias("kappa"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def supersession_current(spark, sf):
    """The order of each customer that no later order supersedes."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("chain"), F.col("o_orderkey").alias("item"), "o_orderdate")
    newer = F.lead("item").over(Window.partitionBy("chain").orderBy("o_orderdate", "item"))
    links = o.withColumn("by", newer).where("by is not null").select("chain", F.col("by").alias("src"), F.col("item").alias("dst"))
    return gr.current_of(o.select("chain", "item"), links).select(F.col("chain").alias("o_custkey"), F.col("item").alias("o_orderkey"))


def supersession_rate(spark, sf):
    """How often the dearest order of a customer is the current one, and how often chance would be right."""
    o = table(spark, sf, "orders")
    g = o.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("current"), F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("applied"), F.count("*").alias("n"))
    return g.agg(F.count("*").alias("total"), F.count_if(F.col("current") == F.col("applied")).alias("correct"), F.round(F.avg((F.col("current") == F.col("applied")).cast("double")), 6).alias("rate"), F.round(F.avg(1 / F.col("n")), 6).alias("chance"))


FUNCTIONS = (
    dense_topk, mmr_order, cluster_tree_rank, vector_label_metrics,
    graph_neighbors, graph_bfs, graph_bfs_directed, graph_walk_1hop, graph_walk_3hop, spread_activation, pagerank_fixed_iter, pagerank_converged, edge_decay, decay_report,
    retrieval_metrics, mean_metrics, cost_to_correct, return_on_tokens, compliance_score, merge_ready, session_text, recall_distance,
    reliability_curve, brier_decomposition, fleiss, krippendorff, cohen_weighted, certify_depths,
    headline, depth_crossover, ablation, crossover_pivot_all, pareto_frontier, dominated_set, hypervolume, audc, audc_raw, half_life, regret, factorization,
    headline_line, crossover_line, robustness, ablation_cells, two_tier, priced_runs, frontier_report, factor_rates, cost_per_correct, left_to_run, graded_err,
    supersession_current, supersession_rate,
)

_E = """
WITH e AS (SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst, 'constrains' AS rel, 0.9::DOUBLE AS conf FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'part_of', 0.8 FROM customer
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'part_of', 0.7 FROM supplier
  UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, 'caused_by', 0.6 FROM orders),
u AS (SELECT src AS a, dst AS b, rel, conf FROM e UNION ALL SELECT dst, src, rel, conf FROM e)"""


def _bfs(seeds: str, steps: str, hops: int) -> str:
    out = f", l0 AS (SELECT seed, seed AS node FROM ({seeds}))"
    for i in range(1, hops + 1):
        out += f", l{i} AS (SELECT DISTINCT seed, b AS node FROM l{i - 1} JOIN {steps} ON node = a)"
    every = " UNION ALL ".join(f"SELECT seed, node, {i} AS depth FROM l{i}" for i in range(hops + 1))
    return out + f", seen AS (SELECT seed, node, CAST(min(depth) AS BIGINT) AS depth FROM ({every}) GROUP BY seed, node)"


def _walk(hops: int) -> str:
    return (
        _E
        + _bfs("SELECT 'n' || n_nationkey AS seed FROM nation", "u", hops)
        + f""", en AS (SELECT DISTINCT seed, b AS node FROM seen JOIN u ON node = a WHERE depth < {hops} AND rel = 'constrains' AND b IN (SELECT dst FROM e WHERE rel = 'constrains'))
SELECT seed, node, depth FROM seen WHERE depth = 0 OR seed NOT IN (SELECT seed FROM en) OR (seed, node) IN (SELECT (seed, node) FROM en)"""
    )


_PR = _E + ", nd AS (SELECT DISTINCT node FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e)), st AS (SELECT src, dst, conf / sum(conf) OVER (PARTITION BY src) AS p FROM (SELECT src, dst, sum(conf) AS conf FROM e GROUP BY src, dst)), s AS (SELECT node, (node LIKE 'o%')::INT::DOUBLE / (SELECT count(*) FROM nd WHERE node LIKE 'o%') AS s, node NOT IN (SELECT src FROM e) AS dang FROM nd), m0 AS (SELECT node, s AS m FROM s)"
for _i in range(1, 5):
    _PR += f", f{_i} AS (SELECT dst, sum(m * p) AS f FROM m{_i - 1} JOIN st ON node = src GROUP BY dst), m{_i} AS (SELECT s.node, 0.85::DOUBLE * (coalesce(f, 0) + (SELECT sum(m) FROM m{_i - 1} JOIN s USING (node) WHERE dang) * s.s) + 0.15::DOUBLE * s.s AS m FROM s LEFT JOIN f{_i} ON dst = node)"
_TR = "SELECT o_orderkey AS src, o_custkey AS dst, o_totalprice / 500000 AS c, o_orderkey % 12 AS tc, CASE WHEN o_orderkey % 12 > 0 THEN o_orderkey % 3 END AS lt FROM orders"
_DE = f"WITH t AS ({_TR}), n AS (SELECT src, dst, tc, CASE WHEN tc >= 10 THEN least(1.0, c + 0.075) WHEN tc = 0 OR lt IS NULL OR 2 - lt >= 1 THEN c * 0.9::DOUBLE ELSE c END AS c, CASE WHEN tc >= 10 THEN 'reinforced' WHEN tc = 0 OR lt IS NULL OR 2 - lt >= 1 THEN 'decayed' ELSE 'kept' END AS what FROM t), k AS (SELECT * FROM n WHERE NOT (c < 0.1 AND tc = 0))"
_METRICS = (
    _BASE
    + f""", s AS {_PLUS}, rk AS (SELECT * FROM (SELECT qid, doc, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc) AS rank FROM s) WHERE rank <= 10),
g AS (SELECT DISTINCT item_id AS qid, doc_id AS doc FROM documents d JOIN benchmark b ON contains(d.text, b.text)),
gn AS (SELECT qid, count(*) AS n FROM g GROUP BY qid),
j AS (SELECT rk.*, (g.doc IS NOT NULL)::INT AS rel, coalesce(gn.n, 0) AS n FROM rk LEFT JOIN g USING (qid, doc) LEFT JOIN gn USING (qid)),
h AS (SELECT *, sum(rel) OVER (PARTITION BY qid ORDER BY rank) AS hits FROM j),
o AS (SELECT qid, count(*) AS cut, sum(rel) AS tp, min(rank) FILTER (rel = 1) AS first, sum(rel * hits / rank) AS ap, sum(rel / log2(rank + 1)) AS dcg, sum(rel * power(0.8::DOUBLE, rank - 1)) AS rbp,
  sum(rel / rank * power(0.5::DOUBLE, hits)) AS err, sum(rel) FILTER (rank <= n) AS at_r FROM h GROUP BY qid),
a AS (SELECT b.item_id AS qid, coalesce(gn.n, 0) AS n, coalesce(o.cut, 0) AS cut, coalesce(tp, 0) AS tp, first, coalesce(ap, 0) AS ap, dcg, coalesce(rbp, 0) AS rbp, coalesce(err, 0) AS err, coalesce(at_r, 0) AS at_r
  FROM benchmark b LEFT JOIN gn ON gn.qid = b.item_id LEFT JOIN o ON o.qid = b.item_id),
met AS (SELECT qid, round(CASE WHEN cut = 0 THEN (n = 0)::INT::DOUBLE ELSE tp / cut END, 6) AS precision, round(CASE WHEN n = 0 THEN 1.0::DOUBLE ELSE tp / n END, 6) AS recall, round(coalesce(1.0::DOUBLE / first, 0), 6) AS rr,
  round(CASE WHEN n = 0 THEN 1.0::DOUBLE ELSE ap / n END, 6) AS ap,
  round(CASE WHEN n = 0 THEN 1.0::DOUBLE WHEN cut = 0 THEN 0.0::DOUBLE ELSE dcg / list_sum(list_transform(range(1, least(n, cut) + 1), lambda i: 1 / log2(i + 1))) END, 6) AS ndcg,
  round(0.2::DOUBLE * rbp, 6) AS rbp, round(err::DOUBLE, 6) AS err, round(CASE WHEN n = 0 THEN 0.0::DOUBLE ELSE at_r / n END, 6) AS r_precision, n > 0 AND tp = n AS chain_recovered FROM a)"""
)
_SC = "sc AS (SELECT l_returnflag AS dataset, l_returnflag || '-' || l_linestatus AS arm, CAST(l_linenumber AS BIGINT) AS depth, l_orderkey AS task, l_discount * 10 AS compliance, l_quantity > 10 + 4 * l_linenumber AS recovered, 1 - l_tax * 5 AS recall, l_extendedprice AS cost FROM lineitem)"
_PT = "pt AS (SELECT arm || '/' || depth AS name, round(avg(compliance), 6) AS accuracy, round(avg(cost), 6) AS cost FROM sc GROUP BY arm, depth), fr AS (SELECT * FROM pt a WHERE NOT EXISTS (SELECT 1 FROM pt b WHERE b.accuracy >= a.accuracy AND b.cost <= a.cost AND (b.accuracy > a.accuracy OR b.cost < a.cost)))"
_CV = "cv AS (SELECT arm, depth, avg(recovered::INT::DOUBLE) AS value FROM sc GROUP BY arm, depth), lg AS (SELECT *, lag(depth) OVER w AS d0, lag(value) OVER w AS v0, first_value(value) OVER w / 2 AS half FROM cv WINDOW w AS (PARTITION BY arm ORDER BY depth))"
_AT = "att AS (SELECT user_id AS task, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS attempt, CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) >= 90 AS correct FROM events)"
_RB = "pr AS (SELECT l_discount * 10 AS p, (l_quantity > 25)::INT AS y FROM lineitem), bn AS (SELECT CAST(greatest(ceil(round(p * 10, 9)) - 1, 0) AS BIGINT) AS bin, count(*) AS count, avg(p) AS mean_p, avg(y) AS mean_y FROM pr GROUP BY 1)"
_RA = "ra AS (SELECT doc_id AS unit, unnest([quality, 1 - toxic]) AS label FROM labels), ce AS (SELECT unit, label, count(*) AS n FROM ra GROUP BY unit, label), un AS (SELECT unit, sum(n) AS m, sum(n * (n - 1)) AS same FROM ce GROUP BY unit)"

_RUNS = """
WITH rn AS (SELECT l_orderkey AS task_id, ['alpha', 'beta', 'gamma'][CAST(l_orderkey % 3 + 1 AS INT)] AS dataset, ['none', 'words', 'walk'][CAST(l_partkey % 3 + 1 AS INT)] AS arm, ['one-large', 'one-small', 'two'][CAST(l_suppkey % 3 + 1 AS INT)] AS model,
  CAST((l_linenumber - 1) % 3 + 1 AS BIGINT) AS depth, l_discount * 10 AS compliance, l_quantity > 20 AS recovered, 1 - l_tax * 5 AS recall, l_quantity > 30 AS correct, l_quantity AS tokens_in, l_quantity / 2 AS tokens_out FROM lineitem)"""
_COMPLY = f"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations),
u AS (SELECT conv_id, turn AS t, concat_ws('-', CAST(conv_id AS VARCHAR), CAST(turn AS VARCHAR)) AS id, {_IDENTIFIERS.format(t="text")} AS kw FROM c WHERE role = 'user'),
p AS (SELECT c.conv_id, c.turn, u.t, u.id, CASE WHEN len(kw) > 0 THEN len(list_filter(kw, lambda k: contains(coalesce(text, ''), k))) > 0 ELSE contains(coalesce(text, ''), id) END AS ok FROM c JOIN u ON c.conv_id = u.conv_id AND u.t < c.turn),
g AS (SELECT conv_id, turn, count(*) AS total, count(*) FILTER (ok) AS honoured, string_agg(id, '|' ORDER BY t) FILTER (ok) AS ids FROM p GROUP BY conv_id, turn),
cs AS (SELECT c.*, CAST(coalesce(total, 0) AS BIGINT) AS total, CAST(coalesce(honoured, 0) AS BIGINT) AS honoured, coalesce(ids, '') AS honoured_ids FROM c LEFT JOIN g ON g.conv_id = c.conv_id AND g.turn = c.turn)"""

SQL = {
    "dense_topk": """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT a.vec_id AS qid, b.vec_id AS doc, list_cosine_similarity(a.v, b.v) AS score FROM v a, v b WHERE a.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, doc) AS BIGINT) AS rank FROM s)
SELECT qid, doc, rank, round(score, 6) AS score FROM r WHERE rank <= 10""",
    "vector_label_metrics": """
WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT a.vec_id AS qid, b.vec_id AS doc, a.label = b.label AS same, list_cosine_similarity(a.v, b.v) AS score FROM v a, v b WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, doc) AS rank FROM s)
SELECT qid, count(*) FILTER (same) AS same, count(*) AS n FROM r WHERE rank <= 10 GROUP BY qid""",
    "graph_neighbors": _E + " SELECT a AS node, count(*) AS degree, count(DISTINCT b) AS neighbours FROM u GROUP BY a",
    "graph_bfs": _E + _bfs("SELECT 'r' || r_regionkey AS seed FROM region", "u", 3) + " SELECT seed, node, depth FROM seen",
    "graph_bfs_directed": _E + ", d AS (SELECT src AS a, dst AS b FROM e WHERE conf >= 0.5)" + _bfs("SELECT 'o' || o_orderkey AS seed FROM orders", "d", 3) + " SELECT node, count(*) AS n, min(depth) AS least, max(depth) AS most FROM seen GROUP BY node",
    "graph_walk_1hop": _walk(1),
    "graph_walk_3hop": _walk(3),
    "spread_activation": _E
    + """, a0 AS (SELECT 'o' || o_orderkey AS seed, 'o' || o_orderkey AS node, 1.0::DOUBLE AS x FROM orders),
a1 AS (SELECT seed, dst AS node, sum(0.5::DOUBLE * x * conf) AS x FROM a0 JOIN e ON node = src GROUP BY seed, dst),
a2 AS (SELECT seed, dst AS node, sum(0.5::DOUBLE * x * conf) AS x FROM a1 JOIN e ON node = src GROUP BY seed, dst),
a3 AS (SELECT seed, dst AS node, sum(0.5::DOUBLE * x * conf) AS x FROM a2 JOIN e ON node = src GROUP BY seed, dst),
t AS (SELECT seed, node, sum(x) AS x FROM (SELECT * FROM a0 UNION ALL SELECT * FROM a1 UNION ALL SELECT * FROM a2 UNION ALL SELECT * FROM a3) GROUP BY seed, node)
SELECT node, round(sum(x), 6) AS activation, count(*) AS n_seeds FROM t GROUP BY node""",
    "pagerank_fixed_iter": _PR + " SELECT node, round(m, 9) AS mass FROM m4",
    "edge_decay": _DE + " SELECT src, dst, round(c, 9) AS confidence, what FROM k",
    "decay_report": _DE + " SELECT what, count(*) AS n FROM k GROUP BY what",
    "retrieval_metrics": _METRICS + " SELECT * FROM met",
    "mean_metrics": _METRICS + " SELECT round(avg(precision), 5) AS mean_precision, round(avg(recall), 5) AS mean_recall, round(avg(rr), 5) AS mean_rr, round(avg(ap), 5) AS mean_ap, round(avg(ndcg), 5) AS mean_ndcg, count(*) FILTER (chain_recovered) AS recovered FROM met",
    "cost_to_correct": f"WITH {_AT}, f AS (SELECT *, min(attempt) FILTER (correct) OVER (PARTITION BY task) AS first FROM att) SELECT task, count(*) AS attempts, max(first) IS NOT NULL AS resolved, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(tokens * 3 / 1000000), 9) AS dollars FROM f WHERE first IS NULL OR attempt <= first GROUP BY task",
    "return_on_tokens": f"WITH {_AT} SELECT event_type, round(1000 * count(*) FILTER (correct) / sum(tokens)::DOUBLE, 6) AS per_1k, round(sum(tokens)::DOUBLE / nullif(count(*) FILTER (correct), 0), 6) AS tokens_per_correct FROM att GROUP BY event_type",
    "compliance_score": _COMPLY + " SELECT conv_id, turn, total, honoured, honoured_ids, round(CASE WHEN total = 0 THEN 1.0::DOUBLE ELSE honoured / total END, 6) AS rate FROM cs",
    "merge_ready": _COMPLY
    + r""", tr AS (SELECT *, regexp_replace(coalesce(text, ''), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS t FROM cs),
re AS (SELECT *, contains(lower(t), 'i can''t') OR contains(lower(t), 'i cannot') OR contains(lower(t), 'i won''t') OR contains(lower(t), 'as an ai') OR contains(lower(t), 'i''m not able to') AS refused FROM tr)
SELECT conv_id, turn, CASE WHEN t = '' THEN 'empty response' WHEN refused THEN 'refusal' WHEN honoured < total THEN (total - honoured) || '/' || total || ' governing decisions unmet' ELSE 'all governing decisions honoured' END AS reason, t <> '' AND NOT refused AND honoured = total AS ready FROM re""",
    "session_text": "SELECT conv_id, count(*) AS n_turns, sha256(string_agg(concat_ws(': ', role, text), chr(10) ORDER BY turn, concat_ws(': ', role, text))) AS text_sha256 FROM conversations GROUP BY conv_id",
    "recall_distance": "SELECT conv_id, turn, max(turn) OVER (PARTITION BY conv_id) - turn AS distance FROM conversations",
    "reliability_curve": f"WITH {_RB} SELECT bin, count, round(mean_p, 6) AS mean_p, round(mean_y, 6) AS mean_y FROM bn",
    "brier_decomposition": f"WITH {_RB}, b AS (SELECT avg((p - y) ** 2) AS raw, avg(y) AS base, count(*) AS n FROM pr) SELECT round(raw, 6) AS raw_brier, round(sum(count * (mean_p * mean_p - 2 * mean_p * mean_y + mean_y)) / n, 6) AS brier, round(sum(count * abs(mean_p - mean_y)) / n, 6) AS ece, round(sum(count * (mean_p - mean_y) ** 2) / n, 6) AS reliability, round(sum(count * mean_y * mean_y) / n - base * base, 6) AS resolution, round(base * (1 - base), 6) AS uncertainty FROM bn, b GROUP BY raw, base, n",
    "fleiss": f"WITH {_RA}, b AS (SELECT avg(same / (m * (m - 1))) AS p_bar, sum(m) AS t FROM un), e AS (SELECT sum((c / t) ** 2) AS p_e FROM (SELECT label, sum(n) AS c FROM ce GROUP BY label), b) SELECT round(p_bar, 6) AS p_bar, round(p_e, 6) AS p_e, round(CASE WHEN p_e = 1 THEN 1 ELSE (p_bar - p_e) / (1 - p_e) END, 6) AS kappa FROM b, e",
    "krippendorff": f"WITH {_RA}, p AS (SELECT sum(m) AS t, sum((m * (m - 1) - same) / (m - 1)) AS un FROM un WHERE m > 1), c AS (SELECT sum(c * (c - 1)) AS cc FROM (SELECT label, sum(n) AS c FROM ce WHERE label IS NOT NULL GROUP BY label)) SELECT round(1 - un / ((t * (t - 1) - cc) / (t - 1)), 6) AS alpha FROM p, c",
    "cohen_weighted": """
WITH l AS (SELECT l_linenumber AS a, CAST(ceil(l_quantity / 8) AS INT) AS b FROM lineitem), nm AS (SELECT DISTINCT a AS x FROM l UNION SELECT DISTINCT b FROM l), ix AS (SELECT x, row_number() OVER (ORDER BY x) AS i FROM nm),
t AS (SELECT count(*)::DOUBLE AS n FROM l), k AS (SELECT count(*) - 1 AS k FROM ix),
o AS (SELECT i.i AS i, j.i AS j, count(*) / n AS p FROM l JOIN ix i ON i.x = a JOIN ix j ON j.x = b, t GROUP BY 1, 2, n),
e AS (SELECT i.i AS i, j.i AS j, coalesce(pa, 0) * coalesce(pb, 0) AS p FROM ix i CROSS JOIN ix j LEFT JOIN (SELECT a, count(*) / n AS pa FROM l, t GROUP BY a, n) ON a = i.x LEFT JOIN (SELECT b, count(*) / n AS pb FROM l, t GROUP BY b, n) ON b = j.x),
w AS (SELECT unnest(['none', 'linear', 'quadratic']) AS weights)
SELECT weights, round(1 - (SELECT sum(p * CASE weights WHEN 'none' THEN (i <> j)::INT WHEN 'linear' THEN abs(i - j) / k ELSE (abs(i - j) / k) ** 2 END) FROM o, k) / (SELECT sum(p * CASE weights WHEN 'none' THEN (i <> j)::INT WHEN 'linear' THEN abs(i - j) / k ELSE (abs(i - j) / k) ** 2 END) FROM e, k), 6) AS kappa FROM w""",
    "certify_depths": "SELECT least(a, b) AS depth, count(*) AS n, count(*) FILTER (a = b) AS exact FROM (SELECT 1 + o_orderkey % 3 AS a, 1 + o_custkey % 3 AS b FROM orders) WHERE abs(a - b) <= 1 GROUP BY 1",
    "headline": f"WITH {_SC} SELECT dataset, arm, round(avg(compliance), 6) AS compliance FROM sc GROUP BY dataset, arm",
    "depth_crossover": f"WITH {_SC} SELECT arm, depth, round(avg(recovered::INT::DOUBLE), 6) AS recovery FROM sc GROUP BY arm, depth",
    "ablation": f"WITH {_SC} SELECT CASE depth WHEN 1 THEN 'shallow' WHEN 3 THEN 'middle' ELSE 'deep' END AS label, round(avg(compliance), 6) AS compliance, count(*) AS n FROM sc WHERE depth IN (1, 3, 7) GROUP BY 1",
    "crossover_pivot_all": f"WITH {_SC} SELECT arm, " + ", ".join(f"round(avg(recovered::INT::DOUBLE) FILTER (depth = {d}), 6) AS d{d}" for d in range(1, 8)) + " FROM sc GROUP BY arm",
    "pareto_frontier": f"WITH {_SC}, {_PT} SELECT name, accuracy, cost FROM fr",
    "dominated_set": f"WITH {_SC}, {_PT} SELECT name FROM pt WHERE name NOT IN (SELECT name FROM fr)",
    "hypervolume": f"WITH {_SC}, {_PT}, c AS (SELECT DISTINCT accuracy, cost FROM fr), l AS (SELECT accuracy, cost, coalesce(lag(cost) OVER (ORDER BY accuracy DESC), 100000.0::DOUBLE) AS upper FROM c) SELECT round(sum(accuracy * (upper - cost)), 3) AS hypervolume FROM l",
    "audc": f"WITH {_SC}, {_CV} SELECT arm, round(CASE WHEN max(depth) = min(depth) THEN max(value) ELSE sum((depth - d0) * (value + v0) / 2) / (max(depth) - min(depth)) END, 6) AS area FROM lg GROUP BY arm",
    "half_life": f"WITH {_SC}, {_CV} SELECT arm, round(min(CASE WHEN v0 > half AND value <= half THEN d0 + (v0 - half) / (v0 - value) * (depth - d0) END), 6) AS half_life FROM lg GROUP BY arm",
    "regret": f"WITH {_SC}, s AS (SELECT task, depth AS arm, max(compliance) AS score FROM sc GROUP BY task, depth), b AS (SELECT *, max(score) OVER (PARTITION BY task) AS hi, min(score) OVER (PARTITION BY task) AS lo FROM s) SELECT arm, round(avg(CASE WHEN hi <= lo THEN 0 ELSE (hi - score) / (hi - lo) END), 6) AS regret, count(*) AS n_tasks FROM b GROUP BY arm",
    "factorization": f"WITH {_SC}, g AS (SELECT arm, depth, sum(recall) AS r, sum(compliance) AS c, count(*) AS n FROM sc GROUP BY arm, depth), w AS (SELECT *, c / n AS p, 1.959963984540054::DOUBLE AS z FROM g) SELECT arm, depth, round(r / n, 6) AS p_ret, round(c / r, 6) AS kappa, round(greatest((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 0), 6) AS low, round(least((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 1), 6) AS high FROM w",
    "audc_raw": f"WITH {_SC}, {_CV} SELECT arm, round(coalesce(sum((depth - d0) * (value + v0) / 2), 0), 6) AS area FROM lg GROUP BY arm",
    "headline_line": _RUNS + " SELECT dataset, arm, round(avg(compliance), 6) AS compliance FROM rn WHERE model LIKE 'one-%' GROUP BY dataset, arm",
    "crossover_line": _RUNS + " SELECT arm, depth, round(avg(recovered::INT::DOUBLE), 6) AS recovery FROM rn WHERE model LIKE 'one-%' AND dataset IN ('alpha', 'beta') GROUP BY arm, depth",
    "robustness": _RUNS + " SELECT dataset, model, round(avg(compliance), 6) AS compliance FROM rn WHERE arm = 'walk' GROUP BY dataset, model",
    "ablation_cells": _RUNS + ", ce(arm, depth, label) AS (VALUES ('none', 1, 'full/none'), ('none', 3, 'stripped/none'), ('words', 3, 'stripped/words'), ('walk', 3, 'stripped/walk')) SELECT label, round(avg(compliance), 6) AS compliance, count(*) AS n FROM rn JOIN ce ON rn.arm = ce.arm AND rn.depth = ce.depth WHERE model LIKE 'one-%' AND dataset IN ('alpha', 'beta') GROUP BY label",
    "two_tier": _RUNS + " SELECT 'measured' AS tier, arm AS name, round(avg(compliance), 6) AS value FROM rn GROUP BY arm UNION ALL SELECT 'reported', concat_ws('/', p_name, CAST(p_partkey AS VARCHAR)), round(p_retailprice / 1000, 6) FROM part WHERE p_partkey % 3 <> 0 AND p_retailprice IS NOT NULL",
    "priced_runs": _RUNS + " SELECT model, round(sum((tokens_in * CASE model WHEN 'one-large' THEN 3.0::DOUBLE WHEN 'one-small' THEN 1.0::DOUBLE ELSE 5.0::DOUBLE END + tokens_out * CASE model WHEN 'one-small' THEN 5.0::DOUBLE ELSE 15.0::DOUBLE END) / 1000000 * 1e6), 3) AS micro_dollars FROM rn GROUP BY model",
    "frontier_report": _RUNS + """, am AS (SELECT arm, avg(correct::INT::DOUBLE) AS accuracy, avg(tokens_in + tokens_out) AS cost FROM rn GROUP BY arm),
fr AS (SELECT * FROM am a WHERE NOT EXISTS (SELECT 1 FROM am b WHERE b.accuracy >= a.accuracy AND b.cost <= a.cost AND (b.accuracy > a.accuracy OR b.cost < a.cost))),
cv AS (SELECT arm, depth, avg(recovered::INT::DOUBLE) AS v FROM rn GROUP BY arm, depth), lg AS (SELECT *, lag(depth) OVER w AS d0, lag(v) OVER w AS v0 FROM cv WINDOW w AS (PARTITION BY arm ORDER BY depth)),
ar AS (SELECT arm, CASE WHEN max(depth) = min(depth) THEN max(v) ELSE sum((depth - d0) * (v + v0) / 2) END AS area FROM lg GROUP BY arm)
SELECT CAST(row_number() OVER (ORDER BY cost, accuracy DESC, arm) AS BIGINT) AS place, arm, round(accuracy, 6) AS accuracy, round(cost, 6) AS cost, round(area, 6) AS area FROM fr JOIN ar USING (arm)""",
    "factor_rates": _RUNS + """, g AS (SELECT arm, depth, sum(recall) AS r, sum(compliance) AS c, count(*) AS n FROM rn GROUP BY arm, depth), w AS (SELECT *, least(greatest(r / n, 0), 1) AS p, least(greatest(c / r, 0), 1) AS k, 1.959963984540054::DOUBLE AS z FROM g)
SELECT arm, depth, n, round(r / n, 6) AS p_ret, round(c / r, 6) AS kappa, round(greatest((k + z * z / (2 * r) - z * sqrt(k * (1 - k) / r + z * z / (4 * r * r))) / (1 + z * z / r), 0), 6) AS low, round(least((k + z * z / (2 * r) + z * sqrt(k * (1 - k) / r + z * z / (4 * r * r))) / (1 + z * z / r), 1), 6) AS high,
  round(greatest((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 0), 6) AS ret_low, round(least((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 1), 6) AS ret_high FROM w""",
    "cost_per_correct": _RUNS + " SELECT model, round(CASE WHEN count(*) FILTER (correct AND model <> 'two') = 0 THEN 'infinity'::DOUBLE ELSE sum(tokens_in + tokens_out) / count(*) FILTER (correct AND model <> 'two') END, 6) AS cost FROM rn GROUP BY model",
    "left_to_run": _RUNS + " SELECT * FROM (SELECT unnest(['alpha', 'beta', 'gamma', 'delta']) AS dataset) d CROSS JOIN (SELECT unnest(['none', 'words', 'walk', 'other']) AS arm) a WHERE (dataset, arm) NOT IN (SELECT (dataset, arm) FROM rn)",
    "graded_err": """
WITH l AS (SELECT l_orderkey AS qid, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rank, floor(l_quantity / 11) AS grade FROM lineitem),
s AS (SELECT *, (2 ** grade - 1) / 16.0::DOUBLE AS stop FROM l),
a AS (SELECT *, coalesce(sum(ln(1 - stop)) OVER (PARTITION BY qid ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum((grade > 0)::INT) OVER (PARTITION BY qid ORDER BY rank) AS hits FROM s)
SELECT qid, round(sum(stop * exp(before) / rank), 6) AS err, round(CASE WHEN sum((grade > 0)::INT) = 0 THEN 0 ELSE sum((grade > 0)::INT * hits / rank) / sum((grade > 0)::INT) END, 6) AS ap FROM a GROUP BY qid""",
    "supersession_current": "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1",
    "supersession_rate": "WITH g AS (SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS cur, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS app, count(*) AS n FROM orders GROUP BY o_custkey) SELECT count(*) AS total, count(*) FILTER (cur = app) AS correct, round(avg((cur = app)::INT::DOUBLE), 6) AS rate, round(avg(1 / n), 6) AS chance FROM g",
}
