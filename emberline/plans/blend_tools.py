"""The three blend tools over tables of requests; bad input becomes an error row, not an exception."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.operators import blend as bl
from emberline.operators.lattice import cheapest_on_lattice, scenario_rows
from emberline.operators.nearest import nearest_reference

list_components = bl.list_components


def optimize_blends(
    candidates: DataFrame, properties: DataFrame, limits: DataFrame,
    steps: int = 20, max_share_steps: int = 12, total_weight_g: float = bl.TOTAL_WEIGHT_G,
) -> DataFrame:
    """Cheapest lattice blend per scenario with its component rows, or an error.

    ``candidates`` is (scenario_id, limit_set, component).  Limits are always kept.
    """
    scenarios = scenario_rows(candidates, properties, limits)
    best = cheapest_on_lattice(scenarios, steps, max_share_steps)
    hoppers = F.zip_with(
        "components", "shares",
        lambda c, s: F.struct(
            c.alias("component"),
            F.round(s * (100.0 / steps), 1).alias("ratio"),
            F.round(s * (total_weight_g / steps), 1).alias("weight_g"),
        ),
    )
    return best.select(
        "scenario_id",
        F.when(F.col("cost").isNotNull(), bl.shown(hoppers)).alias("hoppers"),
        F.col("cost").alias("cost_per_ton"),
        F.lit(total_weight_g).alias("total_weight_g"),
        "optimizer",
        "error",
    )


def predict_quality(
    requests: DataFrame, properties: DataFrame, models: DataFrame, knn_reference: DataFrame, k: int = 5
) -> DataFrame:
    """Mixed features and a prediction per blend.

    ``models`` names a model per blend.  KNN predicts from the reference rows; the other regressors
    need fitted models (see ``operators.regression``), and a name without one gives an error.
    """
    features = bl.normalised(bl.mix(requests, properties))
    scaled = [f"{c}_n" for c in bl.FEATURES]
    near = nearest_reference(features, scaled, knn_reference, "profile", ["cri", "csr"], k)
    known = F.col("model") == "KNN"
    return near.join(models, "blend_id").select(
        "blend_id",
        "model",
        "ad",
        F.when(known, F.col("cri_knn")).alias("cri"),
        F.when(known, F.col("csr_knn")).alias("csr"),
        F.when(~known, F.concat(F.lit("Model '"), F.col("model"), F.lit("' not available"))).alias("error"),
    )
