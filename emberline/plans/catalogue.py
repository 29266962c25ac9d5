"""All named queries and SQL twins, gathered from the catalogue modules."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from emberline.session import apply_settings

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (
    "catalogue_retrieval",
    "catalogue_blend",
    "catalogue_dialogue",
    "catalogue_graph",
    "catalogue_corpus",
    "catalogue_transcript",
    "catalogue_speech",
    "catalogue_streaming",
    "catalogue_models",
)


def _prepared(query: Query) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return query(apply_settings(spark), folder)

    run.__name__ = query.__name__
    run.__doc__ = query.__doc__
    return run


def _modules():
    return [import_module(f"emberline.plans.{name}") for name in MODULES]


def queries() -> dict[str, Query]:
    return {name: _prepared(query) for module in _modules() for name, query in module.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for module in _modules() for name, sql in module.ORACLES.items()}
