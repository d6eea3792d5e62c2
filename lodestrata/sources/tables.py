"""Readers and writers of task files, and generators of tasks with a known answer chain."""

from __future__ import annotations

import json
import platform
import random
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCORED = "task_id string, dataset string, arm string, model string, depth int, spec_variant string, compliance_rate double, chain_recovered boolean, recall double, precision double, correct boolean, total_tokens int, dollars double"
DMR = "examples array<struct<question_id:string,question:string,answer:string,gold_session_id:string,sessions:array<struct<session_id:string,date:string,turns:array<struct<role:string,content:string>>>>>>"
DECISIONS = "decisions array<struct<id:string,topic:string,decision:string,rationale:string,category:string,severity:string>>"
GOTCHAS = "tasks array<struct<task_id:string,title:string,prompt:string,difficulty:string,category:string,gotchas:array<struct<decision_id:string,weight:int>>>>"


def read_scored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCORED).json(path)


def write_scored(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """(task_id, query, pos, item_id, text, gold, depth): one row a session; depth counts sessions from the gold one to the last."""
    e = spark.read.schema(DMR).option("multiLine", True).json(path).select(F.explode("examples").alias("e")).select("e.*")
    e = e.withColumn("at", F.array_position(F.transform("sessions", lambda s: s["session_id"]), F.col("gold_session_id")))
    e = e.withColumn("ok", F.when(F.col("at") > 0, True).otherwise(F.raise_error("the gold session is not among the sessions").cast("boolean"))).where("ok")
    rows = e.select(F.col("question_id").alias("task_id"), F.col("question").alias("query"), F.col("gold_session_id").alias("gold"), (F.size("sessions") - F.col("at") + 1).cast("int").alias("depth"), F.posexplode("sessions").alias("pos", "s"))
    return rows.select("task_id", "query", "pos", F.col("s.session_id").alias("item_id"), F.array_join(F.transform("s.turns", lambda t: F.concat_ws(": ", t["role"], t["content"])), "\n").alias("text"), "gold", "depth")


def read_decisions(spark: SparkSession, tasks: str, decisions: str) -> DataFrame:
    """(task_id, prompt, decision_ids, decision_texts): each task's distinct decisions in their first order."""
    d = spark.read.schema(DECISIONS).option("multiLine", True).json(decisions).select(F.explode("decisions").alias("d")).select("d.id", "d.decision")
    t = spark.read.schema(GOTCHAS).option("multiLine", True).json(tasks).select(F.explode("tasks").alias("t")).select("t.task_id", "t.prompt", F.array_distinct(F.transform("t.gotchas", lambda g: g["decision_id"])).alias("ids"))
    rows = t.select("task_id", "prompt", F.posexplode("ids").alias("pos", "id")).join(d, "id")
    got = rows.groupBy("task_id", "prompt").agg(F.sort_array(F.collect_list(F.struct("pos", "id", "decision"))).alias("x"))
    return got.select("task_id", "prompt", F.transform("x", lambda x: x["id"]).alias("decision_ids"), F.transform("x", lambda x: x["decision"]).alias("decision_texts"))


@dataclass
class Config:
    datasets: list[str]
    arms: list[str]
    budgets: dict[str, int]
    seed: int = 0
    per_depth: int = 10
    models: list[str] = field(default_factory=lambda: ["stub"])

    def validate(self) -> None:
        """Every dataset has one budget for all arms, and none is negative."""
        missing = [d for d in self.datasets if d not in self.budgets]
        if missing or any(b < 0 for b in self.budgets.values()):
            raise ValueError(f"budgets are missing for {missing} or negative")

    def grid(self, spark: SparkSession) -> DataFrame:
        self.validate()
        return spark.createDataFrame([(d, a, m, self.budgets[d], self.seed) for d in self.datasets for a in self.arms for m in self.models], "dataset string, arm string, model string, budget int, seed int")


def manifest(spark: SparkSession, config: Config) -> str:
    return json.dumps({"spark": spark.version, "python": platform.python_version(), "platform": platform.platform(), "config": config.__dict__}, sort_keys=True)


def chain_tasks(spark: SparkSession, depths: Sequence[int] = (1, 2, 3), per_depth: int = 10, seed: int = 0, distractors: int = 6) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(tasks, items, gold, edges): a rule is reached from the query's entry over ``depth`` links.

    The entry shares the query's words; each further item shares fewer, so ranking by words alone loses the chain with
    depth while the links keep it.  Items are shuffled among distractor chains of other subjects.
    """
    rng = random.Random(seed)
    tasks, items, gold, edges = [], [], [], []
    for depth in depths:
        for n in range(per_depth):
            task = f"chain-{depth}-{n}"
            words = [f"{a}{b}{n}" for a in "abcdefgh" for b in "xy"]
            rng.shuffle(words)
            tasks.append((task, " ".join(words[:8]), depth))
            own = []
            for subject in range(distractors + 1):
                ids = [f"{task}-{subject}-{h}" for h in range(depth + 1)]
                for h, i in enumerate(ids):
                    shared = words[: max(0, 8 - 4 * h)] if subject == 0 else words[8 + subject % 4 : 9 + subject % 4]
                    own.append((i, " ".join([*shared, *(f"z{subject}{h}{k}{rng.randrange(10**6)}" for k in range(6))])))
                edges += [(task, a, b, "constrains" if h == depth - 1 else "related", 1.0) for h, (a, b) in enumerate(zip(ids, ids[1:]))]
                if subject == 0:
                    gold += [(task, i) for i in ids[1:]]
            rng.shuffle(own)
            items += [(task, pos, i, text) for pos, (i, text) in enumerate(own)]
    return _task_frames(spark, tasks, items, gold, edges)


def _task_frames(spark: SparkSession, tasks: list, items: list, gold: list, edges: list) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    return (
        spark.createDataFrame(tasks, "task_id string, query string, depth int"),
        spark.createDataFrame(items, "task_id string, pos int, item_id string, text string"),
        spark.createDataFrame(gold, "task_id string, item_id string"),
        spark.createDataFrame(edges, "task_id string, src string, dst string, rel string, confidence double"),
    )


def revision_tasks(spark: SparkSession, length: int, n: int, seed: int = 0, others: int = 2, shuffled: bool = True) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(tasks, items, gold, edges): a setting was revised ``length`` times, each revision superseding the one before; the last
    one is gold.  Revisions read alike, so only the links tell them apart; ``others`` settings add chains of their own."""
    if length < 1 or n < 0:
        raise ValueError("a chain has a revision, and there are no fewer than 0 tasks")
    rng = random.Random(seed)
    tasks, items, gold, edges = [], [], [], []
    for i in range(n):
        task, own = f"revision-{length}-{i}", []
        for chain in range(max(0, others) + 1):
            subject = f"setting{i}x{chain}"
            ids = [f"{task}-{chain}-{k}" for k in range(length)]
            own += [(node, f"Revision {k}: {subject} is value{rng.randrange(10**6)} from now on.") for k, node in enumerate(ids)]
            edges += [(task, new, old, "supersedes", 1.0) for old, new in zip(ids, ids[1:])]
            if chain == 0:
                tasks.append((task, f"Which value of {subject} holds now?", length))
                gold.append((task, ids[-1]))
        if shuffled:
            rng.shuffle(own)
        items += [(task, pos, node, text) for pos, (node, text) in enumerate(own)]
    return _task_frames(spark, tasks, items, gold, edges)


def scattered_tasks(spark: SparkSession, depths: Sequence[int] = (1, 2, 3), scatter: int = 0, per_depth: int = 10, seed: int = 0, others: int = 6) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(tasks, items, gold, edges): as chain_tasks, but the hops lie in turn in ``scatter + 1`` areas of different words, so a
    chain of depth d changes area min(scatter, d) times and more.  Each area of the chain has two items of noise, each of
    ``others`` areas one."""
    if scatter < 0 or any(d < 1 for d in depths):
        raise ValueError("scatter is at least 0 and depths are at least 1")
    rng = random.Random(seed)
    tasks, items, gold, edges = [], [], [], []
    for depth in depths:
        for i in range(per_depth):
            task = f"scattered-{depth}-{i}"
            words = [[f"{chr(97 + a % 26)}{a}{k}{i}" for k in range(8)] for a in range(scatter + 1 + others)]
            fill = lambda: " ".join(f"z{rng.randrange(10**6)}" for _ in range(6))
            ids = [f"{task}-{h}" for h in range(depth + 1)]
            own = [(node, " ".join([*words[h % (scatter + 1)][: max(0, 8 * (depth - h + 1) // (depth + 1))], fill()])) for h, node in enumerate(ids)]
            own += [(f"{task}-noise-{a}-{k}", " ".join([*words[a][: 4 - k], fill()])) for a in range(scatter + 1) for k in range(2)]
            own += [(f"{task}-other-{a}", " ".join([*words[scatter + 1 + a], fill()])) for a in range(others)]
            rng.shuffle(own)
            tasks.append((task, " ".join(words[0]), depth))
            items += [(task, pos, node, text) for pos, (node, text) in enumerate(own)]
            gold.append((task, ids[-1]))
            edges += [(task, a, b, "constrains" if h == depth - 1 else "derived_from", 1.0) for h, (a, b) in enumerate(zip(ids, ids[1:]))]
    return _task_frames(spark, tasks, items, gold, edges)
