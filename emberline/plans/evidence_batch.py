"""From many questions to answer prompts in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.operators import evidence as ev
from emberline.operators import retrieval as rt
from emberline.session import written
from emberline.sources.tables import table


def question_labels(spark: SparkSession, folder: str) -> DataFrame:
    """A question text and type per label."""
    counts = table(spark, folder, "embeddings").groupBy(F.col("label").cast("long").alias("question_id")).agg(
        F.count("*").alias("n")
    )
    kinds = F.array(*[F.lit(k) for k in ("factual", "comparison", "causal", "process", "recommendation")])
    return counts.select(
        "question_id",
        F.get(kinds, (F.col("question_id") % 5).cast("int")).alias("question_type"),
        F.concat(
            F.lit("Which chunks of category "), F.col("question_id").cast("string"),
            F.lit(" matter most among "), F.col("n").cast("string"), F.lit("?"),
        ).alias("question"),
    )


def chunk_metadata(hits: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Text and paper metadata for ranked hits.

    The hits are ten per question.  They are written first, so that the planner knows their size and
    does not shuffle the texts to meet them; with very many questions it still may.
    """
    hits = written(hits, "hits")
    chunk = chunks.select("vec_id", "paper_id", "chunk_index", "section", "category")
    doc = documents.select(
        F.col("doc_id").alias("vec_id"),
        "text",
        F.left("text", F.lit(60)).alias("title"),
        F.left("text", F.lit(80)).alias("authors"),
    )
    year = F.when(F.col("vec_id") % 7 == 0, F.lit(0)).otherwise(1990 + F.col("vec_id") % 40)
    return hits.join(chunk, ["paper_id", "chunk_index"]).join(doc, "vec_id").withColumn("year", year)


def evidence_batch(queries: DataFrame, chunks: DataFrame, documents: DataFrame, questions: DataFrame) -> DataFrame:
    """Retrieve, rank, number and format the evidence of every question into a prompt."""
    hits = chunk_metadata(rt.ranked_hits(queries, chunks), chunks, documents)
    numbered = ev.number_references(ev.first_per_section(hits))
    texts = ev.evidence_text(numbered)
    nothing = F.lit("")
    return questions.join(texts, "question_id", "left").select(
        "question_id",
        "question_type",
        ev.answer_prompt(F.col("question"), F.col("evidence_text"), nothing, nothing).alias("prompt"),
    )
