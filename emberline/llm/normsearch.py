"""Ranked lexical search by buckets of impact vectors of like length.

A document is a vector over the terms of the queries: per term an integer impact, which grows with the
term's occurrences and shrinks with the document's length.  A query's vector holds the terms' weights times
their repeats, and a score is the product of the two, in 64-bit integers.

Vectors are written in order of their length (the Euclidean norm), longest first, and searched in buckets of
neighbours in that order.  The longest vectors of all are searched first; the scores of their best documents
are thresholds for the rest.  In each bucket

* a query is left out if its norm times the bucket's greatest norm is below its threshold (Cauchy-Schwarz);
* the others are left out if their weights times the bucket's greatest value of each coordinate are;
* of the bucket's vectors, coordinates of great weight give an exact part, and Cauchy-Schwarz over the other
  coordinates bounds the rest; vectors below the threshold are left out;
* survivors are scored exactly in integers.

Bounds are rounded up, and only what lies strictly below a threshold goes, so that results are exact.

Terms are runs of ASCII letters and digits and of all other characters beyond ASCII, with A-Z in lower case.
Null and empty texts have no terms: such documents are not counted, such queries find nothing.  Repeated
rows are documents of their own; null ids come last among equal scores.  Other columns are not read.  Queries
are taken in blocks of bounded size, each against all documents.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.llm.common import text_of
from emberline.session import written

TOP = 20
BLOCK_TERMS = 500_000  # distinct terms of the queries of one block, summed over them, unless a single query has more
LONGEST = 4096  # vectors that are searched first, with those of the same norm
SHARP = 0.75  # share of a query's squared norm that is computed exactly before the rest is bounded
NONE = 2**63 - 1  # stands for a null id
SLACK = 1 + 1e-9
# what is no part of a term becomes a space, and capital letters of ASCII small ones
TABLE = bytes(b if b >= 128 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))
TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
COUNTED = "doc_id long, n long, terms array<int>, tf array<long>"
FOUND = "query int, item_id long, doc_id long, score long"  # queries count within their block, as ids can repeat


def terms_of(text: str) -> list[bytes]:
    return text.encode().translate(TABLE).split()


def query_blocks(items: DataFrame, most: int) -> Iterator[list[tuple[int, dict[bytes, int]]]]:
    """Queries with their terms and repeats, in blocks; the driver holds one block at a time."""
    rows = items.select(F.col("item_id").cast("long"), text_of().alias("text")).orderBy(F.col("item_id").asc_nulls_last(), "text")
    block: list[tuple[int, dict[bytes, int]]] = []
    size = 0
    for row in rows.toLocalIterator():
        if not (terms := Counter(terms_of(row["text"]))):
            continue
        if block and size + len(terms) > most:
            yield block
            block, size = [], 0
        block.append((row["item_id"], terms))
        size += len(terms)
    if block:
        yield block


def counted(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """All documents with a term: number of terms, and occurrences of those in the vocabulary (bounded by a block)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = vocabulary.get
        for batch in batches:
            ids, sizes, terms, counts = [], [], [], []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                if not (words := terms_of(text)):
                    continue
                found = np.fromiter((t for t in map(get, words) if t is not None), "i8")
                own, tf = np.unique(found, return_counts=True)
                ids.append(doc_id)
                sizes.append(len(words))
                terms.append(own.astype("i4"))
                counts.append(tf.astype("i8"))
            if ids:
                yield pd.DataFrame({"doc_id": ids, "n": sizes, "terms": terms, "tf": counts})

    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NONE)).alias("doc_id"), text_of().alias("text"))
    return texts.mapInPandas(run, COUNTED)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(counts: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """doc_id, terms, impacts and the norm, with an empty vector left out."""
    m = F.expr(f"100 - 25 + ((25 * n * {n_docs}L) div {n_terms}L)")
    rows = counts.filter(F.size("terms") > 0).withColumn("m", m).withColumn("values", F.expr("transform(tf, x -> (1000000000 * x) div (1000 * x + 12 * m))"))
    norm = F.sqrt(F.expr("aggregate(values, 0D, (s, x) -> s + double(x) * double(x))"))
    return rows.select("doc_id", "terms", "values", norm.alias("norm"))


def by_norm(vectors: DataFrame) -> DataFrame:
    """Vectors written in falling order of their norm; equal norms are dealt over several parts."""
    tie = F.xxhash64("doc_id")
    ranged = vectors.repartitionByRange(F.desc("norm"), tie).sortWithinPartitions(F.desc("norm"), tie)
    return written(ranged, "norms")


def head_norm(vectors: DataFrame, longest: int) -> float:
    """A norm that at least ``longest`` vectors reach, if there are as many; read from counts of thousandths of its logarithm."""
    step = F.floor(F.log("norm") * 1000).alias("step")
    steps = vectors.groupBy(step).count().orderBy(F.desc("step")).collect()  # a few thousand at most, whatever the number of vectors
    seen = 0
    for row in steps:
        seen += row["count"]
        if seen >= longest:
            return math.exp(row["step"] / 1000) / SLACK
    return 0.0


class Queries:
    """Vectors of one block of queries over a vocabulary of their terms."""

    def __init__(self, block: list[tuple[int, dict[bytes, int]]]):
        self.ids = [item for item, _ in block]
        words = sorted({t for _, terms in block for t in terms})
        self.vocabulary = {t: i for i, t in enumerate(words)}
        self.terms = [np.array([self.vocabulary[t] for t in terms], "i8") for _, terms in block]
        self.repeats = [np.array(list(terms.values()), "i8") for _, terms in block]

    def weigh(self, weights: np.ndarray) -> None:
        """Fix the weights, order each query's coordinates by them, and mark those that are computed first."""
        self.weights = []
        for q, (terms, repeats) in enumerate(zip(self.terms, self.repeats)):
            own = weights[terms] * repeats
            order = np.argsort(-own, kind="stable")
            self.terms[q] = terms[order]
            self.weights.append(own[order])
        squares = [np.cumsum(w.astype("f8") ** 2) for w in self.weights]
        self.norms = np.array([math.sqrt(s[-1]) for s in squares]) * SLACK
        self.sharp = [int(np.searchsorted(s, SHARP * s[-1])) + 1 for s in squares]
        self.rest = [math.sqrt(max(0.0, s[-1] - s[k - 1])) * SLACK for s, k in zip(squares, self.sharp)]


class Best:
    """The best rows of each query that a task has seen: score, then least id."""

    def __init__(self, n: int, top: int, thresholds: list[int]):
        self.top, self.least = top, np.array(thresholds, "i8")
        self.rows = [(np.zeros(0, "i8"), np.zeros(0, "i8")) for _ in range(n)]

    def add(self, q: int, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.rows[q][0], ids]), np.concatenate([self.rows[q][1], scores])
        order = np.lexsort((ids, -scores))[: self.top]
        self.rows[q] = ids[order], scores[order]
        if len(order) == self.top:
            self.least[q] = max(self.least[q], scores[order[-1]])


class Bucket:
    """Vectors of like norm: by row, and turned into lists of rows per coordinate."""

    def __init__(self, batch: pd.DataFrame):
        self.ids = batch["doc_id"].to_numpy()
        self.size = len(batch)
        self.norms = batch["norm"].to_numpy()
        sizes = np.fromiter(map(len, batch["terms"]), "i8", self.size)
        self.at = np.concatenate([[0], np.cumsum(sizes)])
        self.terms, self.values = np.concatenate(batch["terms"].to_list()).astype("i8"), np.concatenate(batch["values"].to_list()).astype("i8")
        order = np.argsort(self.terms, kind="stable")
        self.row_of = np.repeat(np.arange(self.size), sizes)[order]
        self.list_values = self.values[order]
        self.coordinates, self.starts = np.unique(self.terms[order], return_index=True)
        self.greatest = np.maximum.reduceat(self.list_values, self.starts)
        self.stops = np.append(self.starts[1:], len(order))

    def lists(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the terms occur here, and the number of each one's list."""
        at = np.minimum(np.searchsorted(self.coordinates, terms), len(self.coordinates) - 1)
        return np.flatnonzero(self.coordinates[at] == terms), at


def search_bucket(bucket: Bucket, queries: Queries, best: Best, dense: np.ndarray) -> int:
    """Add the bucket's best rows; the number of vectors that were scored exactly."""
    scored = 0
    for q in np.flatnonzero(queries.norms * bucket.norms.max() * SLACK >= best.least):
        terms, weights, least = queries.terms[q], queries.weights[q], best.least[q]
        held, at = bucket.lists(terms)
        if not held.size or (weights[held].astype("f8") * bucket.greatest[at[held]]).sum() * SLACK < max(least, 1):
            continue
        part, seen = np.zeros(bucket.size), np.zeros(bucket.size)
        some = held[held < queries.sharp[q]]
        for i in some:
            rows = slice(bucket.starts[at[i]], bucket.stops[at[i]])
            own = bucket.list_values[rows].astype("f8")
            part[bucket.row_of[rows]] += own * weights[i]
            seen[bucket.row_of[rows]] += own * own
        others = np.sqrt(np.maximum(bucket.norms**2 * SLACK - seen, 0)) * queries.rest[q]
        rows = np.flatnonzero((part + others) * SLACK >= max(least, 1))
        if not rows.size:
            continue
        scored += len(rows)
        dense[terms] = weights
        lengths = bucket.at[rows + 1] - bucket.at[rows]
        first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        entries = np.repeat(bucket.at[rows] - first, lengths) + np.arange(lengths.sum())
        scores = np.add.reduceat(dense[bucket.terms[entries]] * bucket.values[entries], first)
        dense[terms] = 0
        keep = scores >= max(least, 1)
        best.add(q, bucket.ids[rows[keep]], scores[keep])
    return scored


def search(vectors: DataFrame, queries: Queries, top: int, thresholds: list[int]) -> DataFrame:
    """The best rows of each task; a batch of the sorted table is a bucket."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best, dense = Best(len(queries.ids), top, thresholds), np.zeros(len(queries.vocabulary), "i8")
        for batch in batches:
            if len(batch):
                search_bucket(Bucket(batch), queries, best, dense)
        for q, (ids, scores) in enumerate(best.rows):
            if len(ids):
                yield pd.DataFrame({"query": q, "item_id": pd.Series([queries.ids[q]] * len(ids), dtype="Int64"), "doc_id": ids, "score": scores})

    return vectors.select("doc_id", "terms", "values", "norm").mapInPandas(run, FOUND)


def _top(found: DataFrame, top: int) -> DataFrame:
    """Ranks per query; a task has left at most ``top`` rows of each, and parts of a query are cut first."""
    order = [F.desc("score"), F.asc("doc_id")]
    part = F.pmod(F.xxhash64("doc_id"), F.lit(32))
    first = found.withColumn("rank", F.row_number().over(Window.partitionBy("query", part).orderBy(*order))).filter(F.col("rank") <= top)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).filter(F.col("rank") <= top)


def rank(docs: DataFrame, items: DataFrame, top: int = TOP, block_terms: int = BLOCK_TERMS, longest: int = LONGEST) -> DataFrame:
    """item_id, rank, doc_id and score of the best documents of each query with a score above 0."""
    results = []
    for block in query_blocks(items, block_terms):
        queries = Queries(block)
        counts = written(counted(docs, queries.vocabulary), "counts")
        total = counts.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
        if not total["docs"]:
            continue
        weights = np.full(len(queries.vocabulary), weight(total["docs"], 0), "i8")
        for row in counts.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # bounded by the block's terms
            weights[row["term"]] = weight(total["docs"], row["count"])
        queries.weigh(weights)
        vectors = by_norm(impacts(counts, total["docs"], total["terms"]))
        cut = head_norm(vectors, longest)
        head = written(search(vectors.filter(F.col("norm") >= cut), queries, top, [0] * len(block)), "head")
        least = dict(map(tuple, _top(head, top).filter(F.col("rank") == top).select("query", "score").collect()))
        rest = search(vectors.filter(F.col("norm") < cut), queries, top, [least.get(q, 0) for q in range(len(block))])
        results.append(written(_top(head.unionByName(rest), top), "ranked"))
    spark = docs.sparkSession
    if not results:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out.select("item_id", F.col("rank").cast("int"), F.when(F.col("doc_id") != NONE, F.col("doc_id")).alias("doc_id"), "score")


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP12_SQL = rf"""
WITH doc_terms AS (SELECT doc_id, unnest(regexp_extract_all({LOWER}, '{TERMS}')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM doc_terms GROUP BY ALL),
sizes AS (SELECT doc_id, count(*) AS n FROM doc_terms GROUP BY ALL),
total AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM sizes),
dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM dfs, total),
lengths AS (SELECT doc_id, 100 - 25 + ((25 * n * n_docs) // n_terms) AS m FROM sizes, total),
wanted AS (SELECT item_id, unnest(regexp_extract_all({LOWER}, '{TERMS}')) AS term FROM benchmark),
scores AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM wanted JOIN weights USING (term) JOIN tf USING (term) JOIN lengths USING (doc_id) GROUP BY ALL),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""
