"""The corpus pipeline: each stage reads what its predecessor wrote and works on all of it."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm import bbit_minhash, byte_cnn, dp_packing, toxicity, winnow
from lodestrata.llm.common import dropped, give_back, scratch_path, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose expected severity is below the rejecting grade; null and empty texts stay.

    Learned from the stage's own documents and labels; without labels of both kinds nothing is dropped.
    """
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(docs, model)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a language at all; those without letters (null and empty texts too), or torn between languages, go."""
    return byte_cnn.identified_only(docs, byte_cnn.train(docs))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8); null and empty texts and rows without
    id stay, of rows that repeat one."""
    return bbit_minhash.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten words in a row of a benchmark item, nor all of a shorter one; null and empty texts stay."""
    return winnow.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences; null and empty texts are the end id alone."""
    return dp_packing.pack(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def begun_lean(stage: Stage) -> Stage:
    """The stage, begun when the executors have given back the heap that the stages before made them take."""

    @wraps(stage)
    def begun(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        give_back(spark)
        return stage(spark, docs, sf_dir)

    return begun


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", begun_lean(drop_toxic)),
    ("language_id", begun_lean(keep_known_languages)),
    ("near_dedup", begun_lean(keep_one_of_each)),
    ("decontamination", begun_lean(drop_contaminated)),
    ("packing", begun_lean(pack)),
]

#: Two stages are learned classifiers, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage wrote goes when the next one has read it."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"stage-{name}")
        docs = stored(stage(spark, docs, sf_dir), name, path)
        if before:
            dropped(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
