"""Retrieval for many questions at once: top-k per query, one hit per chunk, top list per question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.operators.nearest import cosine_topk

# How many hits to keep.
DEFAULT_TOP_K = 10
PER_QUERY = 5
PER_QUESTION = 10


def retrieve(queries: DataFrame, chunks: DataFrame, top_k: int | None = None, where: Column | None = None) -> DataFrame:
    """The best chunks per query vector.

    ``where`` filters on chunk metadata before ranking and reaches the scan.  A missing or zero
    ``top_k`` means the default.
    """
    if where is not None:
        chunks = chunks.where(where)
    return cosine_topk(
        queries, chunks, ["question_id", "query_pos"], ["paper_id", "chunk_index"], top_k or DEFAULT_TOP_K
    )


def keep_best_hit(hits: DataFrame) -> DataFrame:
    """One row per (question, chunk): the best score, the earlier query on a tie."""
    rank = Window.partitionBy("question_id", "paper_id", "chunk_index").orderBy(F.desc("score"), "query_pos")
    return hits.withColumn("_n", F.row_number().over(rank)).where("_n = 1").drop("_n")


def top_per_question(hits: DataFrame, k: int = PER_QUESTION) -> DataFrame:
    """The k best chunks per question, numbered from 1 in column ``rank``."""
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), "paper_id", "chunk_index")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def ranked_hits(queries: DataFrame, chunks: DataFrame, where: Column | None = None) -> DataFrame:
    """All retrieval steps: per query, then de-duplicated, then per question."""
    return top_per_question(keep_best_hit(retrieve(queries, chunks, PER_QUERY, where)))


def best_chunk_per_paper(hits: DataFrame) -> DataFrame:
    """The highest scoring chunk per question and paper; the earlier rank on a tie."""
    return hits.groupBy("question_id", "paper_id").agg(
        F.min_by(F.struct("chunk_index", "score"), F.struct(-F.col("score"), F.col("rank"))).alias("best")
    ).select("question_id", "paper_id", "best.chunk_index", "best.score")


def run_summary(hits: DataFrame, questions: DataFrame) -> DataFrame:
    """One row per question: its type, how many chunks it got, whether reasoning was asked for."""
    counted = hits.groupBy("question_id").agg(F.count("*").alias("chunk_count"))
    return questions.join(counted, "question_id", "left").select(
        "question_id",
        "question_type",
        F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"),
        F.col("question_type").isin("comparison", "causal", "recommendation").alias("complex"),
    )
