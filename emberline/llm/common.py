"""What the corpus operators share: tables, whole-word splitting, and file access from tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A word is a run without ASCII white space; ``bytes.split()`` cuts at the same characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def number_of(text: Column, digits: int = 13) -> Column:
    """A long from the first hexadecimal digits of the text's MD5: the same in any SQL engine."""
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def filesystem(path: str):
    """The file system of a folder that all executors reach, and the folder's path in it."""
    from pyarrow import fs

    if path.startswith("file:/"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)
