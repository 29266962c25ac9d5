"""From entity rows to a stored graph."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from emberline.operators import graph as gr
from emberline.session import written


#: The graph is several times as many rows as its papers.
SMALL = {"compression": "zstd"}


class Graph(NamedTuple):
    nodes: DataFrame
    edges: DataFrame


def build_graph(entities: DataFrame) -> Graph:
    """Nodes and edges as plans over the entity rows."""
    clean = gr.clean_entities(entities)
    repeated = gr.repeated_papers(clean)
    return Graph(gr.build_nodes(clean, repeated), gr.build_edges(clean, repeated))


def stored_graph(entities: DataFrame) -> Graph:
    """Nodes and edges written once, by label and by relationship, and read back.

    Pattern queries then prune to the relationship they need, and self-joins do not rebuild the graph.
    The id of a relationship, which repeats all its columns, is put together when it is read.
    """
    plan = build_graph(written(entities, "entities", **SMALL))
    nodes = written(plan.nodes, "nodes", "label", **SMALL)
    return Graph(nodes, gr.with_edge_id(written(plan.edges.drop("edge_id"), "edges", "rel", **SMALL)))


def write_graph(graph: Graph, path: str) -> None:
    graph.nodes.write.mode("overwrite").partitionBy("label").parquet(f"{path}/nodes")
    graph.edges.write.mode("overwrite").partitionBy("rel").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> Graph:
    return Graph(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"))
