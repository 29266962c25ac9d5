"""Entity rows: the checkpoint of extracted entities, and an adapter over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.sources.tables import table

ENTITY_SCHEMA = (
    "paper_id bigint, title string, year int, authors array<string>, concepts array<string>, methods array<string>, "
    "materials array<string>, properties array<struct<name: string, unit: string>>, concept_relations array<array<string>>"
)


def read_entities(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Entity rows from JSON: one object per line, or with ``multi_line`` arrays over many lines."""
    return spark.read.schema(ENTITY_SCHEMA).option("multiLine", multi_line).json(path)


def append_entities(rows: DataFrame, path: str) -> None:
    """Add an increment; what is there is never rewritten."""
    rows.write.mode("append").json(path)


def pending(papers: DataFrame, done: DataFrame) -> DataFrame:
    """Papers whose entities are not extracted yet."""
    return papers.join(done.select("paper_id").distinct(), "paper_id", "left_anti")


def order_entities(spark: SparkSession, folder: str) -> DataFrame:
    """Entities made from orders: an order is a paper, its parts give concepts, methods and materials.

    The sets per order are bounded by the vocabulary of types, brands, names and flags.  Lines are moved
    to their order one by one: an order has few, and sets of one line take more bytes than the line.
    Related concepts are neighbours in the sorted set.
    """
    # a line without an order is in none
    lines = table(spark, folder, "lineitem").where("l_orderkey IS NOT NULL")
    lines = lines.join(table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
    lines = lines.select("l_orderkey", "p_type", "p_brand", "p_name", "l_returnflag").repartition("l_orderkey")
    sets = lines.groupBy(F.col("l_orderkey").alias("paper_id")).agg(
        F.array_sort(F.collect_set("p_type")).alias("concepts"),
        F.array_sort(F.collect_set("p_brand")).alias("methods"),
        F.array_sort(F.collect_set("p_name")).alias("materials"),
        F.array_sort(F.collect_set("l_returnflag")).alias("flags"),
    )
    orders = table(spark, folder, "orders").join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    rows = orders.join(sets, F.col("o_orderkey") == F.col("paper_id"), "left")
    none = F.array().cast("array<string>")
    flags = F.coalesce("flags", none)
    concepts = F.coalesce("concepts", none)
    return rows.select(
        F.col("o_orderkey").alias("paper_id"),
        F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"),
        F.year("o_orderdate").alias("year"),
        F.array_compact(F.array(F.concat(F.lit(" "), F.col("c_name")), F.lit(" "))).alias("authors"),
        concepts.alias("concepts"),
        F.coalesce("methods", none).alias("methods"),
        F.coalesce("materials", none).alias("materials"),
        F.transform(flags, lambda f: F.struct(F.concat(F.lit("flag "), f).alias("name"), F.col("o_orderpriority").alias("unit"))).alias("properties"),
        F.when(
            F.size(concepts) > 1,
            F.transform(
                F.sequence(F.lit(1), F.size(concepts) - 1),
                lambda i: F.array(F.element_at(concepts, i), F.element_at(concepts, i + 1)),
            ),
        ).otherwise(F.array().cast("array<array<string>>")).alias("concept_relations"),
    )
