"""Named queries that fit models or use random projections; checked by rows and by tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberline.operators import blend as bl
from emberline.operators import nearest as nn
from emberline.operators import regression as rg
from emberline.operators import textvectors as tv
from emberline.operators.retrieval import PER_QUERY, retrieve
from emberline.plans.catalogue_blend import _known
from emberline.session import written
from emberline.sources.tables import blends, chunks, question_vectors, table


def _training(spark, d):
    """All blends with their normalised features and targets."""
    mixed = bl.mix(blends(spark, d), _known(spark, d), (*bl.FEATURES, *rg.TARGETS))
    return written(bl.normalised(mixed), "training")


def quality_regression(spark, d):
    """Errors of each regressor on both targets, on the fifth of the blends that it was not fitted on."""
    training, out = _training(spark, d), None
    for name in rg.regressors():
        rows = rg.scores(training, name)
        out = rows if out is None else out.unionByName(rows)
    return out


def quality_predictions(spark, d):
    """Predictions of every fitted model for all blends, those held out marked."""
    rows, out = _training(spark, d), None
    for name in rg.regressors():
        models = {target: rg.fit(rows.filter(~rg.held_out(F.col("blend_id"))), name, target) for target in rg.TARGETS}
        found = rg.predict(rows, models, name)
        out = found if out is None else out.unionByName(found)
    return out.withColumn("held_out", rg.held_out(F.col("blend_id")))


def text_retrieval(spark, d):
    """The three documents closest to each benchmark text by hashed word weights."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    asked = table(spark, d, "benchmark").select("item_id", "text")
    items, queries = tv.text_vectors(docs, "text", asked)
    found = nn.cosine_topk(queries, items, ["item_id"], ["doc_id"], 3)
    return found.withColumn("score", F.round("score", 6))


def approximate_neighbours(spark, d):
    """Approximate top five per query, and whether each is in the exact top five."""
    queries, items = question_vectors(spark, d), chunks(spark, d)
    near = tv.approximate_topk(queries, items, ["question_id", "query_pos"], ["paper_id", "chunk_index"], PER_QUERY)
    keys = ["question_id", "query_pos", "paper_id", "chunk_index"]
    exact = retrieve(queries, items, PER_QUERY).select(*keys, F.lit(True).alias("exact"))
    return near.join(exact, keys, "left").select(*keys, F.round("score", 6).alias("score"), F.coalesce("exact", F.lit(False)).alias("exact"))


QUERIES = {f.__name__: f for f in (quality_regression, quality_predictions, text_retrieval, approximate_neighbours)}
ORACLES: dict[str, str] = {}
