"""Softmax boosting against plain loops over the same rows."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tabsmith.operators.boosting import SoftmaxBooster, tree_nodes


def _data(n=600, seed=1):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 20, n), rng.integers(0, 12, n), rng.integers(0, 5, n)]).astype(float)
    y = np.where(x[:, 0] + rng.normal(size=n) > 12, 2, np.where(x[:, 1] + rng.normal(size=n) > 6, 1, 0))
    return x, y


def _frame(spark, x, y):
    return spark.createDataFrame([(Vectors.dense(a), float(b)) for a, b in zip(x, y, strict=True)], ["features", "label"]).repartition(3)


def _best_split(x, r):
    """(gain, feature, threshold) of the largest fall of squared error."""
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= t
            gain = r[low].sum() ** 2 / low.sum() + r[~low].sum() ** 2 / (~low).sum()
            if best is None or gain > best[0] + 1e-9:
                best = gain, f, t
    return best


def _brute(x, y, k, rounds, depth, step):
    f = np.tile(np.log(np.bincount(y, minlength=k) / len(y)), (len(y), 1))
    losses = []
    for _ in range(rounds):
        p = np.exp(f - f.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        losses.append(-np.log(p[np.arange(len(y)), y]).mean())
        moved = f.copy()
        for c in range(k):
            r = (y == c) - p[:, c]

            def grow(rows, left, c=c, r=r):
                if left and len(rows) > 1 and r[rows].std() > 0:
                    _, feature, t = _best_split(x[rows], r[rows])
                    low = x[rows, feature] <= t
                    grow(rows[low], left - 1)
                    grow(rows[~low], left - 1)
                    return
                h = (p[rows, c] * (1 - p[rows, c])).sum()
                moved[rows, c] += step * (k - 1) / k * r[rows].sum() / h

            grow(np.arange(len(y)), depth)
        f = moved
    p = np.exp(f - f.max(1, keepdims=True))
    return f, p / p.sum(1, keepdims=True), losses


@pytest.mark.parametrize("depth", [1, 2])
def test_two_rounds_equal_brute_force(spark, depth):
    x, y = _data()
    model = SoftmaxBooster(maxIter=2, maxDepth=depth, subsamplingRate=1.0, stepSize=0.3).fit(_frame(spark, x, y))
    f, p, losses = _brute(x, y, 3, 2, depth, 0.3)
    assert np.allclose(model.losses, losses, rtol=1e-9)
    frame = spark.createDataFrame([(n, Vectors.dense(a)) for n, a in enumerate(x)], ["id", "features"])
    out = model.transform(frame).select("id", vector_to_array("probability").alias("p"), vector_to_array("rawPrediction").alias("f"), "prediction").orderBy("id").toPandas()
    assert np.allclose(np.stack(out.f), f, atol=1e-9) and np.allclose(np.stack(out.p), p, atol=1e-9)
    assert out.prediction.tolist() == f.argmax(1).tolist()


def test_loss_falls_and_models_are_kept(spark, tmp_path):
    x, y = _data(400, 2)
    frame = _frame(spark, x, y)
    model = SoftmaxBooster(maxIter=12, maxDepth=3, subsamplingRate=0.8, numClasses=4).fit(frame)
    assert all(b < a for a, b in zip(model.losses, model.losses[1:], strict=False))
    assert model.featureImportances.toArray().sum() == pytest.approx(1) and model.featureImportances[2] < 0.2
    scored = model.transform(frame).select("label", "prediction", vector_to_array("probability").alias("p"))
    assert scored.where(F.abs(F.aggregate("p", F.lit(0.0), lambda a, v: a + v) - 1) > 1e-9).count() == 0
    # A class that the rows do not hold is never likely.
    assert scored.where("p[3] > 0.01 or prediction = 3").count() == 0
    assert scored.where("label = prediction").count() > 340
    PipelineModel([model]).write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m")).transform(frame).select("prediction")
    assert again.where("prediction = 1").count() == scored.where("prediction = 1").count()
    # The rows of a round do not depend on chance.
    assert SoftmaxBooster(maxIter=3, maxDepth=2).fit(frame).losses == pytest.approx(SoftmaxBooster(maxIter=3, maxDepth=2).fit(frame).losses)


def test_printed_trees():
    text = "Model: depth=2\n  If (feature 3 <= 0.5)\n   Predict: 1.0\n  Else (feature 3 > 0.5)\n   If (feature 1 <= -2.0E-4)\n    Predict: 2.0\n   Else (feature 1 > -2.0E-4)\n    Predict: 3.0\n"
    nodes = tree_nodes(text)
    assert nodes["feature"] == [3, -1, 1, -1, -1] and nodes["low"] == [1, 1, 3, 3, 4] and nodes["high"] == [2, 1, 4, 3, 4]
    assert nodes["leaf"] == [-1, 0, -1, 1, 2] and nodes["threshold"][2] == -2e-4
    with pytest.raises(ValueError):
        tree_nodes("Model\n  If (feature 0 in {1.0})\n   Predict: 1.0\n")
