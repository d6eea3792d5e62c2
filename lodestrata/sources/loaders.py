"""Readers of question sets: each gives tasks, and the items that a task's corpus holds once a corpus, not once a question.

The files are single JSON values, so one task parses a file; everything after that is a plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Field names of the file formats, the category without evidence, the question types that may be asked for,
# the beginnings of task ids, the line before a definition in a query.
DIALOGUES = "sample_id string, conversation map<string,string>, qa array<struct<question:string,answer:string,evidence:array<string>,category:int>>"
TURNS = "array<struct<speaker:string,dia_id:string,text:string>>"
MULTI_HOP = "_id string, question string, answer string, level string, context array<array<string>>, supporting_facts array<array<string>>"
SNAPSHOT = (
    "questions array<struct<question_id:string,question_type:string,question:string,answer:string,depth:int,answer_session_ids:array<string>,"
    "sessions:array<struct<session_id:string,date:string,is_gold:boolean,turns:array<struct<role:string,content:string>>>>>>"
)
INSTANCES = "instances array<struct<instance_id:string,repo:string,base_commit:string,problem_statement:string,snippet_full:string,snippet_constraint:string,snippet_justification:string,remote_qualname:string>>"
ADVERSARIAL = 5
QUESTION_TYPES = ("knowledge-update", "temporal-reasoning")
LEVELS = ("easy", "medium", "hard")
DIALOGUE_ID, MULTI_HOP_ID, SNAPSHOT_ID = "locomo-", "hotpotqa-", "longmemeval-"
CODE = "\n\nRelevant code in this repo you must honour:\n"


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def _unless(bad: Column, why: Column) -> Column:
    """True, or an error for the rows that are bad."""
    return F.when(bad, F.raise_error(why).cast("boolean")).otherwise(True)


def read_dialogues(spark: SparkSession, path: str, categories: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(tasks, items) of dated dialogues.  tasks (task_id, corpus_id, query, gold, depth, answer): questions with evidence that are
    not adversarial, depth the span of the evidence's sessions; evidence that no turn has is an error.
    items (corpus_id, pos, item_id, text, session, date, speaker): the turns, by number of session."""
    samples = _json(spark, path, DIALOGUES)
    number = lambda key: F.regexp_extract(key, r"^session_(\d+)$", 1)
    entries = F.filter(F.map_entries("conversation"), lambda e: number(e["key"]) != "")
    dated = F.transform(entries, lambda e: F.struct(number(e["key"]).cast("int").alias("session"), F.coalesce(F.col("conversation")[F.concat(e["key"], F.lit("_date_time"))], F.lit("")).alias("date"), F.from_json(e["value"], TURNS).alias("turns")))
    turns = F.flatten(F.transform(F.array_sort(dated), lambda s: F.transform(s["turns"], lambda t: F.struct(t["dia_id"].alias("item_id"), F.concat_ws(": ", t["speaker"], t["text"]).alias("text"), s["session"].alias("session"), s["date"].alias("date"), t["speaker"].alias("speaker")))))
    rows = samples.select(F.col("sample_id").alias("corpus_id"), turns.alias("turns"), "qa")
    items = rows.select("corpus_id", F.posexplode("turns").alias("pos", "t")).select("corpus_id", "pos", "t.*")
    asked = rows.select("corpus_id", F.transform("turns", lambda t: t["item_id"]).alias("known"), F.posexplode("qa").alias("nth", "q"))
    category = F.coalesce("q.category", F.lit(0))
    asked = asked.where((category != ADVERSARIAL) & (F.size(F.coalesce("q.evidence", F.array().cast("array<string>"))) > 0))
    if categories is not None:
        asked = asked.where(category.isin(list(categories)))
    session = F.transform("q.evidence", lambda e: F.regexp_extract(e, r"^D(\d+):\d+$", 1).cast("int"))
    missing = F.array_except("q.evidence", "known")
    asked = asked.where(_unless(F.size(missing) > 0, F.concat(F.lit("evidence not in the dialogue: "), F.array_join(missing, ", "))))
    asked = asked.where(_unless(F.exists(session, lambda s: s.isNull()), F.lit("evidence is not named D<session>:<turn>")))
    name = F.concat(F.lit(DIALOGUE_ID), F.col("corpus_id"), F.lit("-q"), F.col("nth").cast("string"))
    tasks = asked.select(name.alias("task_id"), "corpus_id", F.col("q.question").alias("query"), F.array_distinct("q.evidence").alias("gold"), (F.array_max(session) - F.array_min(session) + 1).alias("depth"), F.col("q.answer").alias("answer"))
    return tasks, items


def sentence_id(title: Column, nth: Column) -> Column:
    return F.concat(title, F.lit(" :: s"), nth.cast("string"))


def read_multi_hop(spark: SparkSession, path: str, levels: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(tasks, items) of questions over several paragraphs: an item a sentence, depth the number of gold titles.

    Supporting facts that the context lacks are an error, and so are other levels than easy, medium and hard."""
    if levels is not None and not set(levels) <= set(LEVELS):
        raise ValueError(f"levels are among {LEVELS}")
    rows = _json(spark, path, MULTI_HOP)
    if levels is not None:
        rows = rows.where(F.col("level").isin(list(levels)))
    rows = rows.withColumn("task_id", F.concat(F.lit(MULTI_HOP_ID), F.col("_id")))
    gold = F.transform("supporting_facts", lambda f: sentence_id(f[0], f[1]))
    sentences = F.flatten(F.transform("context", lambda c: F.transform(F.from_json(c[1], "array<string>"), lambda s, i: F.struct(sentence_id(c[0], i).alias("item_id"), s.alias("text"), c[0].alias("title"), i.alias("sent_id")))))
    rows = rows.select("*", F.array_distinct(gold).alias("gold"), sentences.alias("sentences"))
    missing = F.array_except("gold", F.transform("sentences", lambda s: s["item_id"]))
    rows = rows.where(_unless(F.size(missing) > 0, F.concat(F.lit("supporting facts not in the context: "), F.array_join(missing, ", "))))
    depth = F.greatest(F.size(F.array_distinct(F.transform("supporting_facts", lambda f: f[0]))), F.lit(1))
    tasks = rows.select("task_id", F.col("task_id").alias("corpus_id"), F.col("question").alias("query"), "gold", depth.alias("depth"), "answer")
    items = rows.select(F.col("task_id").alias("corpus_id"), "gold", F.posexplode("sentences").alias("pos", "s"))
    return tasks, items.select("corpus_id", "pos", "s.*", F.array_contains("gold", F.col("s.item_id")).alias("is_supporting"))


def read_snapshots(spark: SparkSession, path: str, types: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(tasks, items) of questions about sessions, of the two types that may be asked for; an item is a whole session."""
    wanted = list(types if types is not None else QUESTION_TYPES)
    if not set(wanted) <= set(QUESTION_TYPES):
        raise ValueError(f"types are among {QUESTION_TYPES}")
    q = _json(spark, path, SNAPSHOT).select(F.explode("questions").alias("q")).select("q.*").where(F.col("question_type").isin(wanted))
    q = q.withColumn("task_id", F.concat(F.lit(SNAPSHOT_ID), F.col("question_id")))
    tasks = q.select("task_id", F.col("task_id").alias("corpus_id"), F.col("question").alias("query"), F.col("answer_session_ids").alias("gold"), "depth", "answer")
    items = q.select(F.col("task_id").alias("corpus_id"), F.posexplode("sessions").alias("pos", "s"))
    text = F.array_join(F.transform("s.turns", lambda t: F.concat_ws(": ", t["role"], t["content"])), "\n")
    return tasks, items.select("corpus_id", "pos", F.col("s.session_id").alias("item_id"), text.alias("text"), F.col("s.date").alias("date"), F.col("s.is_gold").alias("is_gold"))


def read_repositories(spark: SparkSession, path: str, certified: DataFrame, depth: int = 1, stripped: bool = False) -> tuple[DataFrame, DataFrame]:
    """(tasks, items) of code tasks; certified (task_id, depth) says how deep each may be asked.

    A repository's tasks share its definitions, the first of each name; at depth 3 a definition's reason is an item of its own.
    Unstripped tasks have depth 1 and carry the definition in the query; stripped ones have depth 2 or 3."""
    if depth not in ((2, 3) if stripped else (1,)):
        raise ValueError("unstripped tasks have depth 1, stripped ones 2 or 3")
    rows = _json(spark, path, INSTANCES).select(F.posexplode("instances").alias("nth", "i")).select("nth", "i.*")
    rows = rows.join(certified.where(F.col("depth") >= depth).select(F.col("task_id").alias("instance_id")).distinct(), "instance_id", "left_semi")
    query = F.col("problem_statement") if stripped else F.concat("problem_statement", F.lit(CODE), "snippet_full")
    ref = F.concat(F.lit("github.com/"), "repo", F.lit("@"), "base_commit")
    tasks = rows.select(F.col("instance_id").alias("task_id"), F.col("repo").alias("corpus_id"), query.alias("query"), F.array("remote_qualname").alias("gold"), F.lit(depth).alias("depth"), ref.alias("repo_ref"))
    first = rows.groupBy("repo", F.col("remote_qualname").alias("name")).agg(F.min("nth").alias("nth"), F.min_by(F.struct("snippet_full", "snippet_constraint", "snippet_justification"), "nth").alias("s"))
    item = lambda i, t, kind: F.struct(i.alias("item_id"), t.alias("text"), F.lit(kind).alias("kind"))
    if depth < 3:
        own = F.array(item(F.col("name"), F.col("s.snippet_full"), "definition"))
    else:
        both = F.array(item(F.col("name"), F.col("s.snippet_constraint"), "constraint"), item(F.concat("name", F.lit("-rationale")), F.col("s.snippet_justification"), "justification"))
        own = F.when(F.length("s.snippet_justification") > 0, both).otherwise(F.slice(both, 1, 1))
    return tasks, first.select(F.col("repo").alias("corpus_id"), (2 * F.col("nth")).alias("at"), F.posexplode(own).alias("k", "i")).select("corpus_id", (F.col("at") + F.col("k")).alias("pos"), "i.*")
