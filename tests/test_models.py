import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from tidemill.operators import models as D


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(1)
    data = [(i, float(x), float(y), float(r.normal()), int(x + y > 0)) for i, (x, y) in enumerate(r.normal(size=(200, 2)))]
    return spark.createDataFrame(data, "k int, x double, y double, z double, label int").persist()


def test_contributions_and_intervals(rows):
    df = D.assembled(rows, ["x", "y"])
    model = RandomForestRegressor(featuresCol="features", labelCol="z", numTrees=4, maxDepth=3, seed=1).fit(df)
    for r in D.feature_contributions(model.transform(df), model).limit(50).collect():
        assert r.bias[0] + sum(r.contributions) == pytest.approx(r.prediction)
    assert D.prediction_interval(df, model, percentile=90).where("lower > upper").count() == 0
    assert D.interval_of([1.0] * 100) == (1.0, 1.0)


def test_rotation_forest(rows):
    out = D.RotationForest(3, depth=4).fit(rows, ["x", "y"], "label").transform(rows)
    assert out.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0] > 0.85
    assert out.where(F.abs(F.col("probabilities")[0] + F.col("probabilities")[1] - 1) > 1e-9).count() == 0


def test_calibration_and_selection(rows):
    df = D.assembled(rows, ["x", "y"])
    c = D.BinaryCalibrator().fit(df, "label", "k")
    assert 0 < c.beta <= 1 and c.transform(df).where("probability_1 < 0 or probability_1 > 1").count() == 0
    with pytest.raises(TypeError):
        D.BinaryCalibrator(object())
    loss = lambda out: out.agg(F.avg((F.col("prediction") != F.col("label")).cast("double"))).first()[0]
    kept, best = D.backward_selection(rows, rows, ["x", "y", "z"], LogisticRegression(maxIter=5), loss)
    assert {"x", "y"} <= set(kept) and best < 0.2


def test_saved_models_and_grid(rows, tmp_path):
    D.fit_and_save(rows, ["x", "y"], "label", str(tmp_path / "m"), numTrees=3, seed=1)
    assert D.load_and_predict(rows, str(tmp_path / "m")).count() == 200
    assert D.density_grid(rows, "x", "y", 10).agg(F.sum("n")).first()[0] == 200
    assert D.density_grid(rows.limit(0), "x", "y").count() == 0
