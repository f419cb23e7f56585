"""The corpus pipeline: each stage works on all that the one before it kept."""

from pyspark.sql import DataFrame, SparkSession

from procsight.llm import decontaminate, langid, packing, simhash, toxicity
from procsight.llm.queries import table, tokenizer_path
from procsight.llm.tables import drop, new_path, small_batches, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, learned from the labels, predicts toxic go."""
    small_batches(spark)
    return toxicity.without_toxic(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or in none of the learned languages with some probability, go."""
    small_batches(spark)
    return langid.with_language(docs, langid.learn(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the least doc_id: fingerprints within two bits."""
    small_batches(spark)
    return simhash.without_near_duplicates(docs, budget=2)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    small_batches(spark)
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, in sequences of 1024 tokens."""
    small_batches(spark)
    return packing.pack(docs, tokenizer_path(), size=1024)


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unknown_language),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminated),
    ("packing", pack),
]

#: Fitted models, fingerprints and token ids have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, old = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"stage-{name}")
        docs = written(stage(spark, docs, sf_dir), path)
        if old:
            drop(spark, old)
        old = path
    return STAGES[-1][1](spark, docs, sf_dir)
