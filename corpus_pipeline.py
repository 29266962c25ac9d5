"""From raw documents to a mixed and sharded corpus, in five stages.

Each stage works on all rows that the one before has kept, and its result is written before the next one
reads it.  All but the last return the columns of ``documents``; the last adds ``slot`` and ``shard``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from emberline.llm import decontaminate, mixing, placement, sigtree, toxicity
from emberline.llm.common import table
from emberline.session import apply_settings, written


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier does not reject."""
    apply_settings(spark)
    return toxicity.without_toxic(docs, toxicity.fit_labels(docs, table(spark, sf_dir, "labels")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of the least id."""
    apply_settings(spark)
    return sigtree.deduplicated(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark, also not with other numbers, units or names."""
    apply_settings(spark)
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, each as often as the mix of sources takes it: not at all, once or twice."""
    apply_settings(spark)
    return mixing.mixed_documents(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with its slot and shard."""
    apply_settings(spark)
    return placement.place(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("ngram_jaccard", one_of_each_group),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
    ("sharding", sharded),
]
# SQL cannot express the classifier of the first stage; tests/llm/test_pipeline.py holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
