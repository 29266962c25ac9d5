"""Exact top-k by vector, without a pairwise join.

A block of at most ``BLOCK_LIMIT`` vectors is held by every task and multiplied with the rows that
pass by; only the k best per query and task leave the task.  When neither side fits in a block the
work is laid out as a grid: both sides are cut by hash into cells of bounded size, every cell pair is
one matrix product, and again only k rows per query and cell travel.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberline.session import rows_within

#: Most vectors one task may hold as a block: 4,096 vectors of 1,024 doubles are 32 MB.
BLOCK_LIMIT = 4096
#: Scores are compared after rounding, so that equal vectors tie and the key decides.
SCORE_DIGITS = 9


def _unit(matrix: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, length, out=np.full_like(matrix, np.nan), where=length > 0)


def _matrix(values: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in values])


def _best(frame: pd.DataFrame, query_key: list[str], item_key: list[str], k: int) -> pd.DataFrame:
    order = frame.sort_values([*query_key, "score", *item_key], ascending=[True] * len(query_key) + [False] + [True] * len(item_key))
    return order.groupby(query_key, sort=False).head(k)


def _scored(
    queries: pd.DataFrame, unit_queries: np.ndarray, items: pd.DataFrame,
    query_key: list[str], item_key: list[str], k: int,
) -> pd.DataFrame:
    """The k best items of one batch for each query."""
    scores = np.round(unit_queries @ _unit(_matrix(items["vec"])).T, SCORE_DIGITS)
    keys = items[item_key].reset_index(drop=True)
    picked = []
    for at, row in enumerate(scores):
        known = np.flatnonzero(~np.isnan(row))
        if len(known) > k:
            kth = np.partition(row[known], len(known) - k)[len(known) - k]
            known = known[row[known] >= kth]
        part = keys.iloc[known].assign(score=row[known])
        part = part.sort_values(["score", *item_key], ascending=[False] + [True] * len(item_key)).head(k)
        picked.append(part.assign(**{name: queries[name].iloc[at] for name in query_key}))
    return pd.concat(picked, ignore_index=True)


def cosine_topk(
    queries: DataFrame, items: DataFrame, query_key: list[str], item_key: list[str], k: int,
    block_limit: int = BLOCK_LIMIT,
) -> DataFrame:
    """Exact k nearest items per query by cosine; ties go to the smaller item key.

    ``queries`` and ``items`` carry their keys and an array column ``vec``.  The result has the keys
    and ``score``.
    """
    fields = [queries.schema[c] for c in query_key] + [items.schema[c] for c in item_key]
    schema = T.StructType([*fields, T.StructField("score", T.DoubleType())])
    names = schema.names
    queries = queries.select(*query_key, "vec").where(F.col("vec").isNotNull())
    items = items.select(*item_key, "vec").where(F.col("vec").isNotNull())
    rows = rows_within(queries, block_limit)
    if rows is not None:
        if not rows:
            return items.sparkSession.createDataFrame([], schema)
        partial = _against_block(rows, items, query_key, item_key, k, schema)
    else:
        partial = _grid(queries, items, query_key, item_key, k, schema, block_limit)
    rank = Window.partitionBy(*query_key).orderBy(F.desc("score"), *item_key)
    return partial.withColumn("_rank", F.row_number().over(rank)).where(F.col("_rank") <= k).select(*names)


def _against_block(
    rows: list[Row], items: DataFrame, query_key: list[str], item_key: list[str], k: int, schema: T.StructType
) -> DataFrame:
    block = pd.DataFrame([[row[c] for c in query_key] for row in rows], columns=query_key)
    unit_queries = _unit(np.array([row["vec"] for row in rows], dtype=np.float64))
    shared = items.sparkSession.sparkContext.broadcast((block, unit_queries))
    names = schema.names

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        queries, unit = shared.value
        best = None
        for batch in batches:
            if len(batch):
                part = _scored(queries, unit, batch, query_key, item_key, k)
                best = part if best is None else _best(pd.concat([best, part]), query_key, item_key, k)
        if best is not None:
            yield best[names]

    return items.mapInPandas(task, schema)


def _grid(
    queries: DataFrame, items: DataFrame, query_key: list[str], item_key: list[str], k: int,
    schema: T.StructType, block_limit: int,
) -> DataFrame:
    query_cells = max(1, math.ceil(queries.count() / block_limit * 1.5))
    item_cells = max(1, math.ceil(items.count() / block_limit * 1.5))
    names = schema.names
    left = queries.withColumn("_q", F.pmod(F.xxhash64(*query_key), F.lit(query_cells))).withColumn(
        "_i", F.explode(F.sequence(F.lit(0), F.lit(item_cells - 1)).cast("array<bigint>"))
    )
    right = items.withColumn("_i", F.pmod(F.xxhash64(*item_key), F.lit(item_cells))).withColumn(
        "_q", F.explode(F.sequence(F.lit(0), F.lit(query_cells - 1)).cast("array<bigint>"))
    )

    def cell(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({c: pd.Series(dtype="float64") for c in names})
        return _scored(a, _unit(_matrix(a["vec"])), b, query_key, item_key, k)[names]

    return left.groupBy("_q", "_i").cogroup(right.groupBy("_q", "_i")).applyInPandas(cell, schema)


def nearest_reference(rows: DataFrame, features: list[str], reference: DataFrame, key: str, values: list[str], k: int) -> DataFrame:
    """Mean of ``values`` over the k reference rows closest to each row (k-nearest regression).

    The reference rows are the training set.  They must fit in one block, which is checked; every
    row then finds its neighbours where it stands, without a shuffle.
    """
    known = rows_within(reference.select(key, *features, *values).orderBy(key), BLOCK_LIMIT)
    if known is None:
        raise ValueError(f"more than {BLOCK_LIMIT} reference rows; aggregate the training set first")
    points = np.array([[r[c] for c in features] for r in known], dtype=np.float64)
    targets = np.array([[r[c] for c in values] for r in known], dtype=np.float64)
    shared = rows.sparkSession.sparkContext.broadcast((points, targets))
    outputs = [f"{v}_knn" for v in values]
    schema = T.StructType([*rows.schema.fields, *[T.StructField(c, T.DoubleType()) for c in outputs]])

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, target = shared.value
        for batch in batches:
            if not len(batch):
                continue
            here = batch[features].to_numpy(dtype=np.float64)
            square = np.zeros((len(here), len(at)))
            for d in range(len(features)):
                square += (here[:, d : d + 1] - at[None, :, d]) ** 2
            # a stable sort on rounded distances lets the smaller key win ties
            order = np.argsort(np.round(square, SCORE_DIGITS), axis=1, kind="stable")[:, :k]
            mean = target[order].mean(axis=1)
            yield batch.assign(**{c: mean[:, j] for j, c in enumerate(outputs)})

    return rows.mapInPandas(task, schema)
