"""Corpus ingest as one plan: papers to sections, chunks, catalogue rows and outcomes."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.functions.text import guess_title, guess_year, normalise_path, path_category
from emberline.operators.sections import chunk_rows, full_text, usable, with_chunks, with_sections
from emberline.session import written
from emberline.sources.catalog import catalog_rows

SUCCESS, FAILED, SKIPPED = "success", "failed", "skipped"


class Ingested(NamedTuple):
    catalog: DataFrame
    chunks: DataFrame
    outcomes: DataFrame


def parsed_papers(papers: DataFrame) -> DataFrame:
    """Papers with path, category, title, year, sections, chunks and the outcome of parsing.

    Papers without enough text, or without a chunk, fail; failures stay visible as rows.
    """
    text = full_text(F.col("pages"))
    rows = papers.withColumn("file_path", normalise_path(F.col("raw_path"))).withColumns(
        {
            "category": path_category(F.col("file_path")),
            "title": guess_title(text, F.col("file_path")),
            "year": guess_year(text),
            "usable": usable(text),
        }
    )
    rows = with_chunks(with_sections(rows))
    return rows.withColumn("chunk_count", F.size("chunks").cast("long")).withColumn(
        "status", F.when(F.col("usable") & (F.col("chunk_count") > 0), SUCCESS).otherwise(FAILED)
    )


def ingest(papers: DataFrame, seen: DataFrame, store: bool = False) -> Ingested:
    """Ingest the papers whose path is not in ``seen`` (file_path); the others are skipped.

    One join marks what is known.  With ``store`` the parsed papers are written once and all three
    results read them; without it each result is a plan of its own over the input columns it needs.
    """
    known = seen.select("file_path").distinct().withColumn("_known", F.lit(True))
    marked = papers.withColumn("file_path", normalise_path(F.col("raw_path"))).join(known, "file_path", "left")
    fresh = parsed_papers(marked.where("_known IS NULL").drop("_known", "file_path"))
    if store:
        fresh = written(fresh.drop("pages", "sections"), "parsed")
    good = fresh.where(F.col("status") == SUCCESS)
    empty = F.array().cast("array<string>")
    catalog = catalog_rows(
        good.select(
            "file_path", "title", empty.alias("authors"), F.lit("").alias("abstract"), empty.alias("keywords"), "year",
            "category", empty.alias("auto_topics"), F.col("lang").alias("language"), "chunk_count",
        )
    )
    skipped = marked.where("_known").select("paper_id", F.lit(SKIPPED).alias("status"), F.lit(0).cast("long").alias("chunk_count"))
    outcomes = fresh.select("paper_id", "status", "chunk_count").unionByName(skipped)
    return Ingested(catalog, chunk_rows(good, "paper_id", "category"), outcomes)


def outcome_report(outcomes: DataFrame) -> DataFrame:
    """Papers per outcome and the mean number of chunks."""
    return outcomes.groupBy("status").agg(
        F.count("*").alias("papers"), F.sum("chunk_count").alias("chunks"), F.avg("chunk_count").alias("mean_chunks")
    )


def progress(audit: DataFrame, total: int) -> DataFrame:
    """Mean seconds per processed paper and the time left, from an audit of (status, seconds)."""
    done = audit.agg(F.count("*").alias("processed"), F.sum("seconds").alias("elapsed"))
    mean = F.col("elapsed") / F.when(F.col("processed") > 0, F.col("processed")).otherwise(1)
    return done.select("processed", mean.alias("mean_seconds"), (mean * (F.lit(total) - F.col("processed"))).alias("seconds_left"))
