"""Gradient boosting for several classes with one shared loss.

Every round fits one regression tree per class on the gradients of the multinomial loss, all from the same margins, so the classes
compete within a round. Trees are MLlib's; what a leaf adds is one Newton step, from sums per class and leaf.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark import StorageLevel, keyword_only
from pyspark.ml import Estimator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsmith.functions.jobs import checkpointed, together
from tabsmith.operators.preprocess import StateModel

#: Rounds after which the margins are written to a reliable checkpoint.
CHECKPOINT_ROUNDS = 10
#: A leaf whose curvature is below has no step.
FLAT = 1e-150
_SPLIT = re.compile(r"If \(feature (\d+) <= (\S+)\)")


def softmax(margins: Column) -> Column:
    top = F.array_max(margins)
    raised = F.transform(margins, lambda x: F.exp(x - top))
    total = F.aggregate(raised, F.lit(0.0), lambda a, x: a + x)
    return F.transform(raised, lambda x: x / total)


def tree_nodes(text: str) -> dict:
    """Nodes of a printed regression tree from the root on: feature (-1: leaf), threshold, and where to go below and above; `leaf` numbers the leaves."""
    lines = [x.strip() for x in text.splitlines()[1:] if x.strip()]
    nodes: dict[str, list] = {"feature": [], "threshold": [], "low": [], "high": [], "leaf": []}
    open_: list[int] = []
    leaves = 0
    for line in lines:
        if line.startswith("Else"):
            nodes["high"][open_.pop()] = len(nodes["feature"])
            continue
        split = _SPLIT.match(line)
        if split is None and not line.startswith("Predict"):
            raise ValueError(f"a tree with a split that is not numeric: {line}")
        place = len(nodes["feature"])
        nodes["feature"].append(int(split[1]) if split else -1)
        nodes["threshold"].append(float(split[2]) if split else 0.0)
        nodes["low"].append(place + 1 if split else place)
        nodes["high"].append(place)
        nodes["leaf"].append(-1 if split else leaves)
        if split:
            open_.append(place)
        else:
            leaves += 1
    return nodes


class SoftmaxBooster(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Boosted trees for labels 0 .. K - 1. Rows take part in a round by a hash of their place, the same for all its trees."""

    featuresCol = Param(Params._dummy(), "featuresCol", "feature vector", TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "class number", TypeConverters.toString)
    numClasses = Param(Params._dummy(), "numClasses", "number of classes", TypeConverters.toInt)
    maxIter = Param(Params._dummy(), "maxIter", "rounds", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "depth of a tree", TypeConverters.toInt)
    maxBins = Param(Params._dummy(), "maxBins", "candidate splits a feature", TypeConverters.toInt)
    stepSize = Param(Params._dummy(), "stepSize", "share of a step that is taken", TypeConverters.toFloat)
    subsamplingRate = Param(Params._dummy(), "subsamplingRate", "share of the rows in a round", TypeConverters.toFloat)
    seed = Param(Params._dummy(), "seed", "seed of the row hash", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", numClasses=None, maxIter=100, maxDepth=5, maxBins=32, stepSize=0.1, subsamplingRate=0.8, seed=42):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", maxIter=100, maxDepth=5, maxBins=32, stepSize=0.1, subsamplingRate=0.8, seed=42)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> "SoftmaxBoosterModel":
        get = self.getOrDefault
        rows = df.select(F.col(get(self.labelCol)).cast("int").alias("y"), F.col(get(self.featuresCol)).alias("x"))
        # Places must not change between rounds.
        rows = checkpointed(rows.withColumn("row", F.monotonically_increasing_id()))
        counts = dict(rows.groupBy("y").count().collect())
        k = get(self.numClasses) if self.isDefined(self.numClasses) else max(counts) + 1
        n = sum(counts.values())
        # A class without rows starts, and stays, far below the others.
        start = [math.log(max(counts.get(c, 0), 1e-9) / n) for c in range(k)]
        now = rows.withColumn("f", F.array(*[F.lit(v) for v in start]))
        width = len(rows.first()["x"])
        held, trees, losses, importance = [], [], [], np.zeros(width)
        for turn in range(get(self.maxIter)):
            trees_now, loss, shares, now, cached = self._round(now, turn, k)
            importance += shares
            trees.append(trees_now)
            losses.append(loss / n)
            for old in held:
                old.unpersist()
            held = [cached]
            if turn % CHECKPOINT_ROUNDS == CHECKPOINT_ROUNDS - 1:
                now = checkpointed(now)
        for old in held:
            old.unpersist()
        total = importance.sum()
        state = {"classes": k, "start": start, "step": get(self.stepSize), "trees": trees, "losses": losses,
                 "importance": (importance / total if total > 0 else importance).tolist(), "features_col": get(self.featuresCol)}
        return SoftmaxBoosterModel(state)

    def _round(self, now: DataFrame, turn: int, k: int):
        get = self.getOrDefault
        p = F.col("p")
        shown = now.withColumn("p", softmax(F.col("f")))
        taken = F.pmod(F.xxhash64("row", F.lit(get(self.seed)), F.lit(turn)), F.lit(1_000_000)) < get(self.subsamplingRate) * 1_000_000
        gradient = [(F.col("y") == c).cast("double") - F.get(p, F.lit(c)) for c in range(k)]
        ready = shown.select("row", "y", "x", "f", "p", taken.alias("taken"), *[g.alias(f"r{c}") for c, g in enumerate(gradient)]).persist(StorageLevel.MEMORY_AND_DISK)
        sample = ready.where("taken")

        def fitted(c: int):
            return DecisionTreeRegressor(featuresCol="x", labelCol=f"r{c}", predictionCol=f"t{c}", leafCol=f"l{c}", maxDepth=get(self.maxDepth), maxBins=get(self.maxBins), seed=get(self.seed)).fit(sample)

        models = together(*[lambda c=c: fitted(c) for c in range(k)])
        scored = ready
        for model in models:
            scored = model.transform(scored)
        # Sums per class and leaf over the rows of the round; the loss over all rows.
        parts = [F.struct(F.lit(c).alias("c"), F.col(f"l{c}").cast("int").alias("leaf"), F.when(F.col("taken"), F.col(f"r{c}")).otherwise(0.0).alias("g"),
                          F.when(F.col("taken"), F.get(p, F.lit(c)) * (1 - F.get(p, F.lit(c)))).otherwise(0.0).alias("h"), F.col("taken").cast("long").alias("n")) for c in range(k)]
        loss = F.struct(F.lit(-1).alias("c"), F.lit(0).alias("leaf"), (-F.log(F.get(p, F.col("y")))).alias("g"), F.lit(0.0).alias("h"), F.lit(0).cast("long").alias("n"))
        sums = scored.select(F.inline(F.array(*parts, loss))).groupBy("c", "leaf").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")).collect()
        found = {(r["c"], r["leaf"]): r for r in sums}
        trees, moved = [], []
        for c, model in enumerate(models):
            nodes = tree_nodes(model.toDebugString)
            leaves = 1 + max(nodes["leaf"])
            rows = [found.get((c, leaf)) for leaf in range(leaves)]
            steps = [(k - 1) / k * r["g"] / r["h"] if r is not None and abs(r["h"]) > FLAT else 0.0 for r in rows]
            nodes["value"] = [steps[leaf] if leaf >= 0 else 0.0 for leaf in nodes["leaf"]]
            nodes["rows"] = [rows[leaf]["n"] if leaf >= 0 and rows[leaf] is not None else 0 for leaf in nodes["leaf"]]
            trees.append(nodes)
            values = F.array(*[F.lit(v) for v in steps])
            moved.append(F.get(F.col("f"), F.lit(c)) + F.lit(get(self.stepSize)) * F.get(values, F.col(f"l{c}").cast("int")))
        shares = sum(m.featureImportances.toArray() for m in models)
        return trees, found[-1, 0]["g"], shares, scored.select("row", "y", "x", F.array(*moved).alias("f")), ready


class SoftmaxBoosterModel(StateModel):
    """Probabilities that sum to 1, and the class of the largest margin (ties: the first)."""

    @property
    def losses(self) -> list[float]:
        """Mean log loss of the training rows before each round."""
        return self.fitted["losses"]

    @property
    def featureImportances(self) -> DenseVector:
        return Vectors.dense(self.fitted["importance"])

    def _transform(self, df: DataFrame) -> DataFrame:
        s = self.fitted
        flat: dict[str, list] = {c: [] for c in ("feature", "threshold", "low", "high", "value")}
        roots, owner = [], []
        for trees in s["trees"]:
            for c, tree in enumerate(trees):
                base = len(flat["feature"])
                roots.append(base)
                owner.append(c)
                for name in ("feature", "threshold", "value"):
                    flat[name] += tree[name]
                for name in ("low", "high"):
                    flat[name] += [base + v for v in tree[name]]
        nodes = {c: np.array(v) for c, v in flat.items()}
        roots, owner, start, step = np.array(roots, int), np.array(owner, int), np.array(s["start"]), s["step"]

        def margins(features: pd.Series) -> pd.Series:
            out = []
            for low in range(0, len(features), 2048):
                x = np.stack(features.iloc[low : low + 2048].to_numpy())
                at = np.broadcast_to(roots, (len(x), len(roots)))
                while len(roots):
                    feature = nodes["feature"][at]
                    if (feature < 0).all():
                        break
                    below = np.take_along_axis(x, np.maximum(feature, 0), 1) <= nodes["threshold"][at]
                    at = np.where(feature < 0, at, np.where(below, nodes["low"][at], nodes["high"][at]))
                f = np.tile(start, (len(x), 1))
                for c in range(len(start)):
                    f[:, c] += step * nodes["value"][at[:, owner == c]].sum(1) if len(roots) else 0
                out += list(f)
            return pd.Series(out)

        found = F.pandas_udf(margins, "array<double>")(vector_to_array(F.col(s["features_col"])))
        scored = df.withColumn("_margins", found)
        best = (F.array_position("_margins", F.array_max("_margins")) - 1).cast("double")
        return scored.withColumns({"rawPrediction": array_to_vector(F.col("_margins")), "probability": array_to_vector(softmax(F.col("_margins"))), "prediction": best}).drop("_margins")
