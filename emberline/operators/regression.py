"""Coke quality regression on mixed and normalised blend features, one model per target.

The models are fitted here with Spark ML; they are not the fitted models of any other program.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions.numbers import round_binary
from emberline.operators.blend import FEATURES

TARGETS = ("cri", "csr")
SEED = 42
FOLDS = 5  # one of them is held out


def regressors() -> dict:
    return {
        "RF": RandomForestRegressor(numTrees=20, maxDepth=5, seed=SEED),
        "Linear": LinearRegression(),
        "DecisionTree": DecisionTreeRegressor(maxDepth=5, seed=SEED),
        "GBR": GBTRegressor(maxIter=10, maxDepth=3, seed=SEED),
    }


def fit(training: DataFrame, model: str, target: str) -> PipelineModel:
    """Fit one model on normalised features (columns ``<feature>_n``)."""
    assembler = VectorAssembler(inputCols=[f"{c}_n" for c in FEATURES], outputCol="_features", handleInvalid="skip")
    regressor = regressors()[model].copy().setFeaturesCol("_features").setLabelCol(target).setPredictionCol(f"{target}_pred")
    return Pipeline(stages=[assembler, regressor]).fit(training)


def predict(features: DataFrame, models: dict[str, PipelineModel], name: str) -> DataFrame:
    """Predictions of both targets beside the ash content, all to two decimals."""
    rows = features.select("blend_id", "ad", *[f"{c}_n" for c in FEATURES])
    for target in TARGETS:
        rows = models[target].transform(rows).drop("_features")
    return rows.select(
        "blend_id", F.lit(name).alias("model"), round_binary(F.col("ad"), 2).alias("ad"),
        *[round_binary(F.col(f"{t}_pred"), 2).alias(t) for t in TARGETS],
    )


def held_out(key: Column) -> Column:
    """Whether a row is for testing: a fifth of the keys, by their checksum."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def scores(rows: DataFrame, name: str, key: str = "blend_id") -> DataFrame:
    """Fit both targets on the rows that are not held out, and report the errors on those that are."""
    out = None
    for target in TARGETS:
        fitted = fit(rows.filter(~held_out(F.col(key))), name, target).transform(rows.filter(held_out(F.col(key))))
        error = F.col(target) - F.col(f"{target}_pred")
        row = fitted.agg(
            F.count("*").alias("rows"), F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(F.abs(error)).alias("mae")
        ).select(F.lit(name).alias("model"), F.lit(target).alias("target"), "rows", "rmse", "mae")
        out = row if out is None else out.unionByName(row)
    return out


def model_families(names: DataFrame) -> DataFrame:
    """Families of model names (the part before the underscore) in the order of ``pos``."""
    return names.groupBy(F.split("name", "_")[0].alias("family")).agg(F.min("pos").alias("first_seen")).orderBy("first_seen")
