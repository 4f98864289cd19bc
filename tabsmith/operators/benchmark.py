"""Comparison of three pipelines on one split: minimal, fixed and hybrid.

* minimal: mean imputation, ordinal codes
* fixed:   mean imputation, capped one-hot columns
* hybrid:  decision plan, ratio features, feature selection
All end with standardisation and an unweighted logistic regression.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsmith.functions.expr import col, nan_to_null
from tabsmith.operators.autoconfig import detect_leakage, detect_target
from tabsmith.operators.models import (
    LABEL,
    Clock,
    TrainedModel,
    TrainResult,
    diagnostics,
    evaluate,
    feature_importance,
    fit_learner,
    fit_learner_on_vector,
    label_index,
    make_learner,
    stored,
    text_of,
    train_hybrid,
)
from tabsmith.operators.preprocess import PlainPreprocessor
from tabsmith.operators.split import check_classes, class_counts, drop_missing_target, holdout_split, predictors
from tabsmith.plans import names

VECTOR = "_one_hot"

# Published metrics of the three pipelines on another data set, for context.
PUBLISHED = [
    ("minimal", 0.6062, 0.6156, 0.7505, 0.6764, 0.6598),
    ("fixed", 0.7124, 0.8745, 0.5553, 0.6792, 0.7723),
    ("hybrid", 0.7116, 0.8845, 0.5453, 0.6747, 0.7686),
]


@dataclass
class Benchmark:
    results: dict[str, TrainResult]
    split: dict
    total_sec: float

    def table(self, spark: SparkSession) -> DataFrame:
        """One row per pipeline: metrics, feature counts, timings, convergence."""
        out = None
        for name, r in self.results.items():
            t, c = r.timings, r.feature_counts
            row = r.metrics.select(
                F.lit(name).alias("pipeline"), "*",
                *[F.lit(c[k]).alias(f"features_{k}") for k in ("original", "post_preprocessing", "post_feature_engineering", "final")],
                *[F.lit(t.get(k, 0.0)).alias(k) for k in ("preprocessing_sec", "feature_engineering_sec", "feature_selection_sec",
                                                          "model_training_sec", "prediction_sec")],
                F.lit(r.diagnostics["n_iter"]).alias("n_iter"), F.lit(r.diagnostics["converged"]).alias("converged"),
            )
            out = row if out is None else out.unionByName(row)
        return out

    def export_columns(self, spark: SparkSession) -> DataFrame:
        """The metric columns that fit the kind of target, for export."""
        multi = self.split["classification_type"] == "multiclass"
        wanted = ["accuracy"]
        wanted += [f"{m}_{a}" for a in ("macro", "weighted") for m in ("precision", "recall", "f1")] if multi else ["precision", "recall", "f1"]
        return self.table(spark).select("pipeline", *wanted, "roc_auc", F.col("features_final").alias("final_feature_count"))

    @staticmethod
    def published(spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            PUBLISHED, "pipeline string, accuracy double, precision double, recall double, f1 double, roc_auc double"
        )


def _plain(train: DataFrame, inputs: list[str], encoding: str, cap: int, learner, clock: Clock):
    vector = VECTOR if encoding == "onehot" else None
    with clock.measure("preprocessing_sec"):
        pre = PlainPreprocessor(inputCols=inputs, encoding=encoding, maxCategories=cap, vectorCol=vector).fit(train)
    features = pre.feature_names
    with stored(pre.transform(train)) as prepared:
        if vector:
            pipeline = fit_learner_on_vector(prepared, vector, learner, [pre], clock)
        else:
            pipeline = fit_learner(prepared, features, learner, [pre], clock)
    n = len(features)
    counts = {"original": len(inputs), "post_preprocessing": n, "post_feature_engineering": n, "final": n}
    return pipeline, features, counts, {}


def run_benchmark(
    df: DataFrame,
    target: str | None = None,
    leakage: list[str] | None = None,
    specs: list[dict] | None = None,
    test_size: float = 0.20,
    seed: int = 42,
    key: list[str] | None = None,
    skewness_threshold: float = 1.0,
    outlier_threshold: float = 0.02,
    cardinality_threshold: int = 15,
    max_ohe_categories: int = 15,
    pipelines: tuple = ("minimal", "fixed", "hybrid"),
) -> Benchmark:
    started = time.perf_counter()
    df = nan_to_null(df)
    if not target or target == "auto":
        choice = detect_target(df)
        target = choice.column or choice.detected_column
        if not target:
            raise ValueError(f"Target column could not be determined automatically; columns: {df.columns[:10]}.")
    if target not in df.columns:
        raise ValueError(f"Target column '{target}' does not exist in the table; columns: {df.columns[:10]}.")
    if leakage is None:
        leakage = [r["column_name"] for r in detect_leakage(df, target).collect()]
    leakage = [c for c in leakage if c != target]
    df = drop_missing_target(df, target)
    counts = class_counts(df, target)
    check_classes(counts, target)
    inputs = predictors(df, target, leakage)
    if specs is None:
        numeric = [f.name for f in df.schema.fields if f.name in set(inputs) and f.dataType.typeName() in
                   ("byte", "short", "integer", "long", "float", "double", "decimal")]
        specs = names.ratio_specs(numeric)
    classes = list(counts)
    train, test = holdout_split(df, target, test_size, seed, key)
    label = label_index(target, classes, df.schema[target].dataType.simpleString())
    ready = train.select(*[col(c) for c in inputs], label.alias(LABEL))
    n_train = ready.count()
    results = {}
    thresholds = dict(skewnessThreshold=skewness_threshold, outlierThreshold=outlier_threshold, cardinalityThreshold=cardinality_threshold)
    for name in pipelines:
        clock = Clock()
        learner = make_learner("logistic_regression", n_train, len(classes), seed, False)
        if name == "hybrid":
            fitted = train_hybrid(ready, inputs, leakage, specs, target, learner, thresholds, clock)
        else:
            fitted = _plain(ready, inputs, "ordinal" if name == "minimal" else "onehot", max_ohe_categories, learner, clock)
        pipeline, features, feature_counts, stages = fitted
        text = [text_of(c) for c in classes]
        model = TrainedModel("logistic_regression", pipeline, target, text, text, inputs, features, leakage, "general")
        parts = evaluate(model, test, label, clock)
        results[name] = TrainResult(
            model=model, train=train, test=test, test_key=key, importance=feature_importance(model), timings=clock.seconds,
            feature_counts=feature_counts, diagnostics=diagnostics(pipeline), stages=stages, **parts,
        )
    n = sum(counts.values())
    split = {
        "total_rows": n, "train_rows": n_train, "test_rows": n - n_train, "test_percentage": round(test_size * 100, 1),
        "target_column": target, "classification_type": "binary" if len(classes) == 2 else "multiclass",
        "n_classes": len(classes), "leakage_columns_excluded": sorted(leakage),
    }
    return Benchmark(results, split, round(time.perf_counter() - started, 4))
