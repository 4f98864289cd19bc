"""Feature selection: variance, correlation, relevance to the target."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsmith.functions.expr import as_double, chunks, col, finite, is_numeric, nan_to_null
from tabsmith.functions.fdist import f_upper_tail
from tabsmith.operators.correlation import pair_correlations
from tabsmith.operators.preprocess import StateModel, _pop
from tabsmith.operators.stats import COLUMNS_PER_PASS, moments


def zero_filled(name: str) -> Column:
    return F.coalesce(as_double(name), F.lit(0.0))


def anova_f(df: DataFrame, features: list[str], target: str) -> dict[str, tuple[float, float]]:
    """(F, p) per feature against the classes of the target.

    Spark reduces the data to count, mean and variance per class and feature, combined
    map-side; a class that holds most rows makes no difference.
    """
    rows_of: dict[str, list[tuple[int, float, float]]] = {f: [] for f in features}
    live = df.filter(col(target).isNotNull())
    for part in chunks(features, COLUMNS_PER_PASS):
        wide = live.select(col(target).alias("y"), *[zero_filled(f).alias(f"c{i}") for i, f in enumerate(part)])
        long = wide.unpivot("y", [f"c{i}" for i in range(len(part))], "column_id", "value")
        grouped = long.groupBy("column_id", "y").agg(
            F.count("value").alias("n"), F.avg("value").alias("mean"), F.var_pop("value").alias("var")
        )
        for r in grouped.collect():
            rows_of[part[int(r["column_id"][1:])]].append((r["n"], r["mean"], r["var"]))
    return {f: _f_test(groups) for f, groups in rows_of.items()}


def _f_test(groups: list[tuple[int, float, float]]) -> tuple[float, float]:
    k, n = len(groups), sum(g[0] for g in groups)
    if k < 2 or n <= k:
        return 0.0, 1.0
    centre = sum(c * m for c, m, _ in groups) / n
    between = sum(c * (m - centre) ** 2 for c, m, _ in groups) / (k - 1)
    within = sum(c * v for c, _, v in groups) / (n - k)
    if within <= 0.0:
        # Not defined for features without spread inside the classes.
        return 0.0, 1.0 if between <= 0.0 else 0.0
    f = between / within
    return f, f_upper_tail(f, k - 1, n - k)


class FeatureSelector(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Three filters over ``inputCols``, fitted on training rows.

    ``pValueThreshold < 0`` or no ``targetCol`` switches the relevance filter off.
    """

    inputCols = Param(Params._dummy(), "inputCols", "candidate features", TypeConverters.toListString)
    targetCol = Param(Params._dummy(), "targetCol", "target column", TypeConverters.toString)
    varianceThreshold = Param(Params._dummy(), "varianceThreshold", "keep above", TypeConverters.toFloat)
    correlationThreshold = Param(Params._dummy(), "correlationThreshold", "prune above", TypeConverters.toFloat)
    pValueThreshold = Param(Params._dummy(), "pValueThreshold", "drop at or above", TypeConverters.toFloat)
    minFeatures = Param(Params._dummy(), "minFeatures", "keep at least", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCols=None, targetCol=None, varianceThreshold=1e-4, correlationThreshold=0.95,
                 pValueThreshold=0.05, minFeatures=1):
        super().__init__()
        self._setDefault(varianceThreshold=1e-4, correlationThreshold=0.95, pValueThreshold=0.05, minFeatures=1)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> "FeatureSelectorModel":
        target = self.getOrDefault(self.targetCol) if self.isDefined(self.targetCol) else None
        types = {f.name: f.dataType for f in dataset.schema.fields}
        wanted = self.getOrDefault(self.inputCols) if self.isDefined(self.inputCols) else dataset.columns
        names = [n for n in wanted if n != target and n in types and is_numeric(types[n])]
        df = nan_to_null(dataset)
        found = dict(zip(names, moments(df, [zero_filled(n) for n in names])))
        removed: list[dict] = []
        varied = self._by_variance(names, found, removed)
        kept = self._by_correlation(df, varied, found, removed)
        scores: dict[str, tuple[float, float]] = {}
        limit = self.getOrDefault(self.pValueThreshold)
        if target is not None and limit >= 0 and kept:
            classes = df.filter(col(target).isNotNull()).select(col(target)).distinct().limit(2).count()
            if classes >= 2:
                scores = anova_f(df, kept, target)
                kept = self._by_relevance(kept, scores, limit, removed)
        return FeatureSelectorModel(
            {
                "initial": names,
                "selected": kept,
                "removed": removed,
                "scores": [{"feature": n, "f_statistic": f, "p_value": p} for n, (f, p) in scores.items()],
                "limits": [self.getOrDefault(self.varianceThreshold), self.getOrDefault(self.correlationThreshold), limit],
            }
        )

    def _by_variance(self, names: list[str], found: dict, removed: list[dict]) -> list[str]:
        limit = self.getOrDefault(self.varianceThreshold)
        kept = []
        for n in names:
            v = _pop(found[n]["var"], found[n]["count"])
            if v > limit:
                kept.append(n)
            else:
                removed.append({"feature": n, "rule_id": "RULE_FS_LOW_VARIANCE_FILTER", "statistic": v, "kept_feature": None,
                                "threshold": limit, "action": "remove_feature"})
        return kept

    def _by_correlation(self, df: DataFrame, names: list[str], found: dict, removed: list[dict]) -> list[str]:
        """Greedy in column order, over the pairs above the threshold; the others stay on the executors."""
        limit = self.getOrDefault(self.correlationThreshold)
        if len(names) < 2:
            return names
        pairs = pair_correlations(df, [zero_filled(n) for n in names], [found[n]["mean"] or 0.0 for n in names], True)
        strong = pairs.where(F.abs("r") > limit).orderBy("i", "j").collect()
        gone: set[int] = set()
        for i, j, r in strong:
            if i in gone or j in gone:
                continue
            lose, keep = (i, j) if (found[names[i]]["var"] or 0) <= (found[names[j]]["var"] or 0) else (j, i)
            gone.add(lose)
            removed.append({"feature": names[lose], "rule_id": "RULE_FS_HIGH_CORRELATION_PRUNE", "statistic": abs(r),
                            "kept_feature": names[keep], "threshold": limit, "action": "remove_redundant_feature"})
        return [n for i, n in enumerate(names) if i not in gone]

    def _by_relevance(self, names: list[str], scores: dict, limit: float, removed: list[dict]) -> list[str]:
        weak = sorted((n for n in names if scores[n][1] >= limit), key=lambda n: scores[n][0])
        weak = weak[: max(0, len(names) - self.getOrDefault(self.minFeatures))]
        for n in weak:
            removed.append({"feature": n, "rule_id": "RULE_FS_STATISTICAL_RELEVANCE_FILTER", "statistic": scores[n][1],
                            "kept_feature": None, "threshold": limit, "action": "remove_low_relevance_feature"})
        return [n for n in names if n not in set(weak)]


class FeatureSelectorModel(StateModel):
    """``transform`` keeps the selected features (absent ones as 0.0) and other columns."""

    @property
    def selected(self) -> list[str]:
        s = self.fitted
        # With nothing left, the unselected matrix is used.
        return s["selected"] or s["initial"]

    def _transform(self, df: DataFrame) -> DataFrame:
        initial, chosen = set(self.fitted["initial"]), self.selected
        present = set(df.columns)
        return df.select(
            *[col(c) for c in df.columns if c not in initial and c not in set(chosen)],
            *[(finite(as_double(c)) if c in present else F.lit(0.0)).alias(c) for c in chosen],
        )

    def trace(self, spark) -> DataFrame:
        """One row per removed and per retained feature."""
        s = self.fitted
        rows = [
            (r["feature"], r["rule_id"], r["action"], float(r["statistic"]), float(r["threshold"]), r["kept_feature"])
            for r in s["removed"]
        ]
        scores = {x["feature"]: x["p_value"] for x in s["scores"]}
        rows += [(f, "RULE_FS_FEATURE_RETAINED", "retain_for_model", scores.get(f), None, None) for f in s["selected"]]
        return spark.createDataFrame(
            rows,
            "feature string, rule_id string, selected_action string, statistic double, threshold double, kept_feature string",
        )

    def counts(self, spark) -> DataFrame:
        rules = [r["rule_id"] for r in self.fitted["removed"]]
        return spark.createDataFrame(
            [(len(self.fitted["initial"]), len(self.fitted["selected"]), rules.count("RULE_FS_LOW_VARIANCE_FILTER"),
              rules.count("RULE_FS_HIGH_CORRELATION_PRUNE"), rules.count("RULE_FS_STATISTICAL_RELEVANCE_FILTER"))],
            "initial_feature_count bigint, selected_count bigint, removed_low_variance_count bigint, "
            "removed_high_corr_count bigint, removed_low_relevance_count bigint",
        )

    def relevance(self, spark, top: int = 50) -> DataFrame:
        """Features by F statistic, strongest first."""
        s = self.fitted
        gone = {r["feature"] for r in s["removed"] if r["rule_id"] == "RULE_FS_STATISTICAL_RELEVANCE_FILTER"}
        rows = [(x["feature"], float(x["f_statistic"]), float(x["p_value"]), x["feature"] in gone) for x in s["scores"]]
        frame = spark.createDataFrame(rows, "feature string, f_statistic double, p_value double, is_removed boolean")
        order = Window.partitionBy(F.lit(1)).orderBy(F.desc("f_statistic"), "feature")
        ranked = frame.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
        return ranked.select(
            "rank", "feature", F.round("f_statistic", 4).alias("f_statistic"), F.round("p_value", 6).alias("p_value"), "is_removed"
        )
