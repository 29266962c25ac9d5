"""Text vectors and approximate neighbours.

Vectors come from hashed word counts, or from a function the user supplies; both feed the same
retrieval.  They are not the vectors of a neural model.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.operators.nearest import _matrix, _scored, _unit, cosine_topk
from emberline.session import written

DIMENSIONS = 256
SEED = 42
SAMPLE, MOST_LISTS = 20_000, 4096  # rows that centroids are fitted on, and centroids that a task holds
PROBED, RECALL = 256, 0.93  # queries that the number of probes is measured on, and what it aims at there
CELL_ROWS = 10_000  # rows of a list that meet in one task


def text_vectors(corpus: DataFrame, text: str, *others: DataFrame, dimensions: int = DIMENSIONS) -> list[DataFrame]:
    """Unit TF-IDF vectors as ``vec`` for the corpus and other texts, weights learnt on the corpus."""
    stages = [
        RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"[^\p{L}\p{N}]+", toLowercase=True),
        HashingTF(inputCol="_words", outputCol="_tf", numFeatures=dimensions),
        IDF(inputCol="_tf", outputCol="_idf"),
        Normalizer(inputCol="_idf", outputCol="_unit", p=2.0),
    ]
    model = Pipeline(stages=stages).fit(corpus)
    dropped = ["_words", "_tf", "_idf", "_unit"]
    return [model.transform(df).withColumn("vec", vector_to_array("_unit")).drop(*dropped) for df in (corpus, *others)]


def embedded(df: DataFrame, text: str, embed: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """Add ``vec`` by a user's function from a batch of texts to a batch of vectors."""
    udf = F.pandas_udf(embed, "array<float>")
    return df.withColumn("vec", udf(F.col(text)))


def fit_centroids(items: DataFrame, lists: int, sample: int = SAMPLE, rounds: int = 12, seed: int = SEED) -> np.ndarray:
    """Directions of ``lists`` clusters of unit vectors, fitted on about ``sample`` rows, at most twice as many."""
    share = min(1.0, sample / max(1, items.count()))
    rows = items.select("vec").where(F.rand(seed) < share).limit(2 * sample).toPandas()
    vectors = _unit(_matrix(rows["vec"])) if len(rows) else np.zeros((0, 1))
    vectors = vectors[~np.isnan(vectors).any(axis=1)]
    if not len(vectors):
        return np.zeros((0, 1))
    different = np.unique(vectors, axis=0)
    centres = np.random.default_rng(seed).permutation(different)[:lists]
    for _ in range(rounds):
        own = (vectors @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, vectors)
        moved = _unit(sums)
        centres = np.where(np.isnan(moved), centres, moved)
    return centres


def nearest_lists(vec: Column, centres: np.ndarray, probes: int) -> Column:
    """The numbers of the nearest centroids, nearest first; none for a vector without direction."""

    def find(vectors: pd.Series) -> pd.Series:
        out = pd.Series([np.zeros(0, "i4")] * len(vectors), index=vectors.index)
        if len(vectors) and len(centres):
            scores = _unit(_matrix(vectors)) @ centres.T
            order = np.argsort(-scores, axis=1, kind="stable")[:, :probes].astype("i4")
            out[:] = [row if not np.isnan(score[0]) else row[:0] for row, score in zip(order, scores)]
        return out

    return F.pandas_udf(find, "array<int>")(vec)


def _cells(rows: DataFrame, key: list[str], name: str, cell_rows: int) -> tuple[DataFrame, DataFrame]:
    """Rows dealt over cells of their list so that a cell holds about ``cell_rows``, and the number of cells per list."""
    counts = rows.groupBy("list").agg(F.ceil(F.count("*") / cell_rows).cast("int").alias(f"n_{name}"))
    dealt = rows.join(counts, "list").withColumn(name, F.pmod(F.xxhash64(*key, "vec"), F.col(f"n_{name}")).cast("int")).drop(f"n_{name}")
    return dealt, counts


def file_items(items: DataFrame, centres: np.ndarray) -> DataFrame:
    """Items with the one ``list`` they are in."""
    return items.withColumn("list", F.explode(nearest_lists(F.col("vec"), centres, 1)))


def probing(queries: DataFrame, centres: np.ndarray, probes: int) -> DataFrame:
    """Queries once for each ``list`` they look into."""
    return queries.withColumn("list", F.explode(nearest_lists(F.col("vec"), centres, probes)))


def probes_needed(
    queries: DataFrame, items: DataFrame, filed: DataFrame, query_key: list[str], item_key: list[str], k: int, centres: np.ndarray, recall: float, sample: int = PROBED
) -> int:
    """In how many lists a query has to look so that the share ``recall`` of exact neighbours is found.

    Measured on a bounded sample of the queries, against all items.
    """
    some = written(queries.orderBy(F.xxhash64(*query_key), *query_key).limit(sample), "probed")
    order = some.select(*query_key, nearest_lists(F.col("vec"), centres, len(centres)).alias("_order"))
    exact = cosine_topk(some, items, query_key, item_key, k).join(filed.select(*item_key, "list"), item_key).join(order, query_key)
    places = np.sort([row[0] for row in exact.select(F.array_position("_order", F.col("list"))).collect()])  # k rows per query of the sample
    return int(places[min(len(places) - 1, math.ceil(recall * len(places)))]) if len(places) else 1


def approximate_topk(
    queries: DataFrame, items: DataFrame, query_key: list[str], item_key: list[str], k: int,
    recall: float = RECALL, lists: int | None = None, probes: int | None = None, sample: int = SAMPLE, cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """Nearest items by cosine among those filed under the centroids nearest to a query: an inverted file.

    Centroids are fitted on a bounded sample, every item is filed under the nearest one, and the items of the
    probed lists are ranked exactly, by matrix products of a cell of queries with a cell of items; a list
    with many rows has many cells.  By default there are four times as many lists as the root of the number of items,
    4,096 at most, and as many are probed as ``recall`` takes on a sample of queries: few where vectors
    gather, many where they point anywhere.  Neighbours in other lists are missed; ``cosine_topk`` is exact.
    Vectors without direction are left out.
    """
    left, right = queries.select(*query_key, "vec"), items.select(*item_key, "vec")
    lists = lists or max(1, min(MOST_LISTS, round(4 * right.count() ** 0.5)))
    centres = fit_centroids(right, lists, sample)
    filed = written(file_items(right, centres), "filed")
    probes = probes or probes_needed(left, right, filed, query_key, item_key, k, centres, recall)
    asked = written(probing(left, centres, probes), "asked")
    filed, item_cells = _cells(filed, item_key, "item_cell", cell_rows)
    asked, query_cells = _cells(asked, query_key, "query_cell", cell_rows)
    # every cell of queries meets every cell of items of its list
    asked = asked.join(item_cells, "list").withColumn("item_cell", F.explode(F.sequence(F.lit(0), F.col("n_item_cell") - 1)))
    filed = filed.join(query_cells, "list").withColumn("query_cell", F.explode(F.sequence(F.lit(0), F.col("n_query_cell") - 1)))
    cell = ["list", "item_cell", "query_cell"]
    kinds = {**dict(left.dtypes), **dict(right.dtypes)}
    schema = ", ".join(f"{c} {kinds[c]}" for c in (*query_key, *item_key)) + ", score double"

    def best(some: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(some) or not len(held):
            return pd.DataFrame(columns=[*query_key, *item_key, "score"])
        return _scored(some, _unit(_matrix(some["vec"])), held, query_key, item_key, k)[[*query_key, *item_key, "score"]]

    rows = asked.groupBy(*cell).cogroup(filed.groupBy(*cell)).applyInPandas(best, schema)
    rank = Window.partitionBy(*query_key).orderBy(F.desc("score"), *item_key)
    return rows.withColumn("_n", F.row_number().over(rank)).where(F.col("_n") <= k).drop("_n")
