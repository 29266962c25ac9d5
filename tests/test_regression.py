"""Fitted models on blends: errors on rows that they have not seen, and predictions for all rows."""

import random
import zlib

import numpy as np

from emberline.operators import regression as rg
from emberline.operators.blend import FEATURES


def blends(spark, n):
    rng, rows = random.Random(7), []
    for i in range(n):
        x = [rng.random() for _ in FEATURES]
        rows.append((i, 10 * x[0], *x, 20 + 5 * x[0] - 3 * x[-1], 60 - 4 * x[1] + rng.random()))
    names = ", ".join(f"{c}_n double" for c in FEATURES)
    return spark.createDataFrame(rows, f"blend_id long, ad double, {names}, cri double, csr double"), rows


def test_errors_are_those_of_rows_held_out(spark):
    df, rows = blends(spark, 200)
    unseen = {i for i in range(200) if zlib.crc32(str(i).encode()) % rg.FOLDS == 0}
    assert {r["blend_id"] for r in df.filter(rg.held_out(df["blend_id"])).collect()} == unseen
    x = np.array([[1, *r[2:-2]] for r in rows])
    seen = [i not in unseen for i in range(200)]
    found = {r["target"]: r for r in rg.scores(df, "Linear").collect()}
    for target, column in (("cri", -2), ("csr", -1)):
        y = np.array([r[column] for r in rows])
        weights = np.linalg.lstsq(x[seen], y[seen], rcond=None)[0]
        errors = (x @ weights - y)[np.logical_not(seen)]
        assert found[target]["rows"] == len(unseen)
        assert abs(found[target]["rmse"] - np.sqrt(np.mean(errors**2))) < 1e-4
        assert abs(found[target]["mae"] - np.mean(np.abs(errors))) < 1e-4


def test_predictions_cover_every_blend(spark):
    df, rows = blends(spark, 60)
    models = {t: rg.fit(df.filter(~rg.held_out(df["blend_id"])), "Linear", t) for t in rg.TARGETS}
    found = {r["blend_id"]: r for r in rg.predict(df, models, "Linear").collect()}
    assert len(found) == 60 and all(r["model"] == "Linear" for r in found.values())
    assert all(abs(found[r[0]]["cri"] - r[-2]) <= 0.02 for r in rows)
