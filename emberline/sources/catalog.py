"""File listing, the paper catalogue and the chunk store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Lengths and counts kept in the catalogue and in chunk metadata.
CATALOG_TITLE, CHUNK_TITLE, ABSTRACT_CHARS = 500, 200, 5000
AUTHORS_KEPT, KEYWORDS_KEPT = 5, 10


def find_files(spark: SparkSession, root: str, pattern: str = "*.pdf") -> DataFrame:
    """All files under a folder, sorted; contents are not read unless asked for."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(root)
    )
    return files.select(F.col("path").alias("file_path"), "length", "modificationTime").orderBy("file_path")


def unseen(new: DataFrame, seen: DataFrame, key: str = "file_path") -> DataFrame:
    """Rows whose key is not in ``seen``."""
    return new.join(seen.select(key).distinct(), key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Keyed replace: rows of ``new`` win.  The result is meant for a fresh path, not in place."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def catalog_rows(papers: DataFrame) -> DataFrame:
    """Catalogue rows; lists become JSON text and the id follows from the path, so it is stable."""
    return papers.select(
        F.xxhash64("file_path").alias("id"),
        "file_path",
        F.left("title", F.lit(CATALOG_TITLE)).alias("title"),
        F.to_json("authors").alias("authors"),
        F.left("abstract", F.lit(ABSTRACT_CHARS)).alias("abstract"),
        F.to_json("keywords").alias("keywords"),
        "year",
        "category",
        F.to_json("auto_topics").alias("auto_topics"),
        "language",
        "chunk_count",
    )


def catalog_lists(catalog: DataFrame) -> DataFrame:
    """Catalogue rows with their JSON lists parsed; missing ones are empty."""
    empty = F.array().cast("array<string>")
    parsed = {
        c: F.coalesce(F.from_json(c, "array<string>"), empty) for c in ("authors", "keywords", "auto_topics")
    }
    return catalog.withColumns(parsed)


def store_rows(chunks: DataFrame, papers: DataFrame) -> DataFrame:
    """Chunk store rows: key ``paper_chunk`` and the paper's metadata on every chunk."""
    base = papers.select(
        "paper_id",
        F.left("title", F.lit(CHUNK_TITLE)).alias("title"),
        "category",
        F.coalesce("year", F.lit(0)).alias("year"),
        F.array_join(F.slice("authors", 1, AUTHORS_KEPT), ", ").alias("authors"),
        F.array_join(F.slice("keywords", 1, KEYWORDS_KEPT), ", ").alias("keywords"),
    )
    return chunks.join(base, "paper_id").select(
        F.concat_ws("_", F.col("paper_id").cast("string"), F.col("chunk_index").cast("string")).alias("id"), "*"
    )


def write_store(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").partitionBy("category").parquet(path)
