"""Training, evaluation and scoring of classification pipelines."""

from __future__ import annotations

import json
import time
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabsmith.functions.expr import as_text, col, nan_to_null
from tabsmith.functions.jobs import pinned
from tabsmith.operators.autoconfig import detect_leakage, resolve_target
from tabsmith.operators.boosting import SoftmaxBooster
from tabsmith.operators.metrics import classification_metrics, confusion_counts, full_class_report, label_grid
from tabsmith.operators.preprocess import FeatureStandardizer, FiniteGuard, HybridPreprocessor, vector_scaler
from tabsmith.operators.ratios import RatioFeatures
from tabsmith.operators.selection import FeatureSelector
from tabsmith.operators.split import class_counts, drop_missing_target, holdout_split, predictors
from tabsmith.plans import names

LABEL, WEIGHT, FEATURES, RAW = "_label", "_weight", "_features", "_raw"

# Learners and their settings.
LEARNERS = {
    "logistic_regression": {"maxIter": 1000, "tol": 1e-4},
    "decision_tree": {"maxDepth": 8, "minInstancesPerNode": 10},
    "random_forest": {"numTrees": 100, "maxDepth": 12, "minInstancesPerNode": 5},
    "gradient_boosting": {"maxIter": 100, "maxDepth": 5, "stepSize": 0.1, "subsamplingRate": 0.8},
}
LEARNER_NAMES = {
    "logistic_regression": "Logistic Regression",
    "decision_tree": "Decision Tree",
    "random_forest": "Random Forest",
    "gradient_boosting": "Gradient Boosting",
}


def make_learner(kind: str, n_rows: int, n_classes: int, seed: int, weighted: bool, **overrides):
    """A configured MLlib classifier. Gradient boosting takes no class weights."""
    if kind not in LEARNERS:
        raise ValueError(f"Unknown model type '{kind}'; available: {list(LEARNERS)}.")
    args = {"featuresCol": FEATURES, "labelCol": LABEL, **LEARNERS[kind], **overrides}
    if weighted and kind != "gradient_boosting":
        args["weightCol"] = WEIGHT
    if kind == "logistic_regression":
        # An L2 penalty with strength C = 1 on summed losses is 1 / n on the mean loss.
        return LogisticRegression(regParam=1.0 / n_rows, elasticNetParam=0.0, standardization=False, **args)
    if kind == "decision_tree":
        return DecisionTreeClassifier(seed=seed, **args)
    if kind == "random_forest":
        return RandomForestClassifier(featureSubsetStrategy="sqrt", seed=seed, **args)
    if n_classes == 2:
        return GBTClassifier(seed=seed, **args)
    return SoftmaxBooster(seed=seed, numClasses=n_classes, **args)


def label_index(target: str, classes: list, dtype: str) -> Column:
    """Position of the class in sorted order, as a double."""
    values = F.array(*[F.lit(c).cast(dtype) for c in classes])
    return (F.array_position(values, col(target)) - 1).cast("double")


def balanced_weight(counts: list[int]) -> Column:
    """n / (k * n_c) per label index."""
    n, k = sum(counts), len(counts)
    return F.element_at(F.array(*[F.lit(n / (k * c)) if c else F.lit(0.0) for c in counts]), F.col(LABEL).cast("int") + 1)


@contextmanager
def stored(df: DataFrame):
    """Keep a frame that several jobs read; spills to disk, recomputed when lost."""
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield df
    finally:
        df.unpersist()


@dataclass
class TrainedModel:
    """A fitted chain with what is needed to read its output."""

    kind: str
    pipeline: PipelineModel
    target: str
    classes: list[str]
    class_labels: list[str]
    inputs: list[str]
    features: list[str]
    leakage: list[str]
    domain_profile: str
    info: dict = field(default_factory=dict)

    def predict(self, df: DataFrame, keep: list[Column] | None = None) -> DataFrame:
        """Raw row as ``_raw``, kept columns, ``prediction`` and ``_p`` (probabilities)."""
        present = set(df.columns)
        ready = df.select(
            F.struct(*[col(c) for c in df.columns]).alias(RAW), *(keep or []), *[col(c) for c in self.inputs if c in present]
        )
        scored = self.pipeline.transform(ready)
        kept = [c for c in scored.columns if c in (RAW, LABEL)]
        return scored.select(*kept, "prediction", vector_to_array(F.col("probability")).alias("_p"))

    def score(self, df: DataFrame) -> DataFrame:
        """Batch or streaming rows with class, label, probabilities and bands."""
        p = self.predict(df)
        at = (F.col("prediction") + 1).cast("int")
        best = F.array_max("_p")
        confidence = F.when(best >= 0.7, "High").when(best >= 0.4, "Medium").otherwise("Low")
        labels = F.array(*[F.lit(x) for x in self.class_labels])
        out = [
            F.col(f"{RAW}.*"),
            F.element_at(F.array(*[F.lit(c) for c in self.classes]), at).alias("predicted_class"),
            F.element_at(labels, at).alias("predicted_label"),
            F.map_from_arrays(labels, F.transform("_p", lambda x: F.round(x, 4))).alias("probabilities"),
            confidence.alias("confidence_level"),
        ]
        positive = next((i for i, c in enumerate(self.classes) if c in ("1", "1.0")), None)
        if self.domain_profile == "supply_chain" or len(self.classes) == 2:
            risk = F.element_at("_p", positive + 1) if positive is not None else F.lit(0.0)
            out.append(F.round(risk, 4).alias("positive_probability"))
            out.append(F.when(risk >= 0.7, "High").when(risk >= 0.5, "Medium").otherwise("Low").alias("risk_level"))
        else:
            out.append(F.lit(None).cast("double").alias("positive_probability"))
            out.append(confidence.alias("risk_level"))
        return p.select(*out)

    def save(self, path: str) -> None:
        """Write the chain and its description below one folder."""
        self.pipeline.write().overwrite().save(f"{path}/pipeline")
        facts = {
            k: getattr(self, k)
            for k in ("kind", "target", "classes", "class_labels", "inputs", "features", "leakage", "domain_profile")
        }
        spark = SparkSession.active()
        spark.createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/facts")

    @staticmethod
    def load(path: str) -> "TrainedModel":
        spark = SparkSession.active()
        facts = json.loads(spark.read.text(f"{path}/facts", wholetext=True).first()[0])
        return TrainedModel(pipeline=PipelineModel.load(f"{path}/pipeline"), **facts)


@dataclass
class TrainResult:
    model: TrainedModel
    train: DataFrame
    test: DataFrame
    test_key: list[str] | None
    metrics: DataFrame
    confusion: DataFrame
    class_report: DataFrame
    importance: DataFrame
    timings: dict[str, float]
    feature_counts: dict[str, int]
    diagnostics: dict
    stages: dict = field(default_factory=dict)

    def sample_records(self, n: int = 10) -> DataFrame:
        return sample_records(self.model, self.test, self.test_key, n)

    def trace(self, spark: SparkSession) -> DataFrame:
        """Decisions of preprocessing, ratio features and selection in one table."""
        cols = ("stage", "feature", "rule_id", "selected_action")
        parts = []
        if "preprocessor" in self.stages:
            t = self.stages["preprocessor"].trace(spark)
            parts.append(t.select("stage", F.col("column_name").alias("feature"), "rule_id", F.col("planned_action").alias("selected_action")))
        if self.stages.get("ratios") is not None:
            r = self.stages["ratios"].report(spark)
            parts.append(r.select(F.lit("feature_engineering").alias("stage"), F.col("name").alias("feature"), "rule_id", "selected_action"))
        if "selector" in self.stages:
            s = self.stages["selector"].trace(spark)
            parts.append(s.select(F.lit("feature_selection").alias("stage"), "feature", "rule_id", "selected_action"))
        if not parts:
            return spark.createDataFrame([], ", ".join(f"{c} string" for c in cols))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out


class Clock:
    def __init__(self):
        self.seconds: dict[str, float] = {}

    @contextmanager
    def measure(self, name: str):
        t = time.perf_counter()
        yield
        self.seconds[name] = round(time.perf_counter() - t, 4)


def fit_learner(prepared: DataFrame, features: list[str], learner, stages: list, clock: Clock) -> PipelineModel:
    """Standardise, assemble and fit; returns the chain including the given stages."""
    scaler = FeatureStandardizer(inputCols=features).fit(prepared)
    assembler = VectorAssembler(inputCols=features, outputCol=FEATURES)
    keep = [c for c in (LABEL, WEIGHT) if c in prepared.columns]
    vectors = assembler.transform(scaler.transform(prepared)).select(*keep, FEATURES)
    with clock.measure("model_training_sec"), stored(vectors) as ready:
        fitted = learner.fit(ready)
    return PipelineModel([*stages, scaler, assembler, fitted])


def fit_learner_on_vector(prepared: DataFrame, vector: str, learner, stages: list, clock: Clock) -> PipelineModel:
    """The same for features that are one vector column already: scaled, not centred, so sparse ones stay sparse."""
    scaler = vector_scaler(prepared, vector, FEATURES)
    keep = [c for c in (LABEL, WEIGHT) if c in prepared.columns]
    with clock.measure("model_training_sec"), stored(scaler.transform(prepared).select(*keep, FEATURES)) as ready:
        fitted = learner.fit(ready)
    return PipelineModel([*stages, scaler, fitted])


def train_hybrid(
    train: DataFrame, inputs: list[str], leakage: list[str], specs: list[dict], target: str, learner, thresholds: dict, clock: Clock
):
    """Fit plan, ratio features and selection on the train rows (which carry LABEL)."""
    with clock.measure("preprocessing_sec"):
        pre = HybridPreprocessor(inputCols=inputs, leakageColumns=leakage, **thresholds).fit(train)
    names_pre = pre.feature_names
    with stored(pre.transform(train)) as prepared:
        chain: list = [pre]
        ratios = None
        candidates = list(names_pre)
        with clock.measure("feature_engineering_sec"):
            if specs:
                ratios = RatioFeatures(specs=specs, leakageColumns=leakage, targetCol=target).fit(prepared.select(*[col(c) for c in names_pre]))
                candidates = names_pre + ratios.feature_names
                chain += [ratios, FiniteGuard(inputCols=candidates)]
        current = prepared
        for stage in chain[1:]:
            current = stage.transform(current)
        with clock.measure("feature_selection_sec"):
            selector = FeatureSelector(inputCols=candidates, targetCol=LABEL).fit(current)
        features = selector.selected
        chain.append(selector)
        pipeline = fit_learner(selector.transform(current), features, learner, chain, clock)
    counts = {
        "original": len(inputs), "post_preprocessing": len(names_pre), "post_feature_engineering": len(candidates), "final": len(features),
    }
    return pipeline, features, counts, {"preprocessor": pre, "ratios": ratios, "selector": selector}


def diagnostics(pipeline: PipelineModel) -> dict:
    learner = pipeline.stages[-1]
    iterations = None
    if getattr(learner, "hasSummary", False):
        iterations = int(learner.summary.totalIterations)
    return {"n_iter": iterations, "converged": None if iterations is None else iterations < LEARNERS["logistic_regression"]["maxIter"]}


def evaluate(model: TrainedModel, test: DataFrame, label: Column, clock: Clock) -> dict[str, DataFrame]:
    """Metrics, confusion matrix and class report of unseen rows."""
    with clock.measure("prediction_sec"), stored(model.predict(test, [label.alias(LABEL)]).select(LABEL, "prediction", "_p")) as scored:
        k = len(model.classes)
        scores = {float(i): F.element_at("_p", i + 1) for i in range(k)}
        labels = [float(i) for i in range(k)]
        metrics = pinned(classification_metrics(scored, LABEL, "prediction", scores, labels))
        counts = pinned(confusion_counts(scored, LABEL, "prediction"))
    names_ = F.array(*[F.lit(c) for c in model.class_labels])
    values = F.array(*[F.lit(c) for c in model.classes])
    grid = label_grid(test.sparkSession, labels, "double")
    matrix = grid.join(counts, ["truth", "predicted"], "left").select(
        F.element_at(names_, (F.col("truth") + 1).cast("int")).alias("truth"),
        F.element_at(names_, (F.col("predicted") + 1).cast("int")).alias("predicted"),
        F.coalesce("cnt", F.lit(0)).cast("bigint").alias("cnt"),
    )
    named = counts.select(
        F.element_at(values, (F.col("truth") + 1).cast("int")).alias("truth"),
        F.element_at(values, (F.col("predicted") + 1).cast("int")).alias("predicted"), "cnt",
    )
    return {"metrics": metrics, "confusion": matrix, "class_report": full_class_report(named)}


def feature_importance(model: TrainedModel, mode: str = "first_class", top: int = 20) -> DataFrame:
    """Impurity decrease of trees, absolute coefficients of linear models; share in %.

    For several classes a linear model shows the row of the first class, or with
    ``mode="mean_abs"`` the mean over the rows.
    """
    learner = model.pipeline.stages[-1]
    if hasattr(learner, "coefficientMatrix"):
        m = abs(learner.coefficientMatrix.toArray())
        values = m[0] if mode == "first_class" else m.mean(axis=0)
    else:
        values = learner.featureImportances.toArray()
    total = float(values.sum()) or 1.0
    rows = [(f, float(v), float(v) / total * 100) for f, v in zip(model.features, values)]
    frame = SparkSession.active().createDataFrame(rows, "feature string, importance double, importance_pct double")
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc("importance"), "feature")
    return (
        frame.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
        .select("rank", "feature", F.round("importance", 6).alias("importance"), F.round("importance_pct", 2).alias("importance_pct"))
    )


def sample_records(model: TrainedModel, test: DataFrame, key: list[str] | None, n: int = 10) -> DataFrame:
    """First test rows in key order with truth, prediction and probability.

    Without a key any n rows are taken: a table has no row order.
    """
    rows = test.orderBy(*[col(k) for k in key]).limit(n) if key else test.limit(n)
    scored = model.score(rows)
    dtype = rows.schema[model.target].dataType
    truth = as_text(model.target, dtype)
    features = F.struct(*[col(c) for c in model.inputs if c in rows.columns])
    return scored.select(
        *[col(k) for k in (key or [])],
        truth.alias("true_class"), "predicted_class", "predicted_label", (truth == F.col("predicted_class")).alias("correct"),
        F.col("positive_probability"), features.alias("features"),
    )


def text_of(value) -> str:
    return str(value).lower() if isinstance(value, bool) else str(value)


def train_model(
    df: DataFrame,
    kind: str = "random_forest",
    target: str | None = None,
    domain_profile: str | None = None,
    leakage: list[str] | None = None,
    specs: list[dict] | None = None,
    test_size: float = 0.20,
    seed: int = 42,
    key: list[str] | None = None,
    balanced: bool = True,
    skewness_threshold: float = 1.0,
    outlier_threshold: float = 0.02,
    cardinality_threshold: int = 15,
    **learner_overrides,
) -> TrainResult:
    """Resolve target and leakage, split, prepare, fit and evaluate on unseen rows.

    ``key`` columns identify a row for the split; they stay predictors unless they are
    listed as leakage.
    """
    clock = Clock()
    started = time.perf_counter()
    if kind not in LEARNERS:
        raise ValueError(f"Unknown model type '{kind}'; available: {list(LEARNERS)}.")
    df = nan_to_null(df)
    found = resolve_target(df, target, domain_profile)
    target = found.column
    df = drop_missing_target(df, target)
    if leakage is None:
        leakage = [r["column_name"] for r in detect_leakage(df, target).collect()]
    inputs = predictors(df, target, leakage)
    if specs is None:
        specs = names.ratio_specs([f.name for f in df.schema.fields if f.name in set(inputs) and f.dataType.typeName() in _NUMERIC_NAMES])
    train, test = holdout_split(df, target, test_size, seed, key, on_rare_class="unstratified")
    dtype = df.schema[target].dataType.simpleString()
    label = label_index(target, found.classes, dtype)
    in_train = class_counts(train, target)
    counts = [in_train.get(c, 0) for c in found.classes]
    ready = train.select(*[col(c) for c in inputs], label.alias(LABEL))
    if balanced:
        ready = ready.withColumn(WEIGHT, balanced_weight(counts))
    learner = make_learner(kind, sum(counts), len(found.classes), seed, balanced, **learner_overrides)
    thresholds = dict(
        skewnessThreshold=skewness_threshold, outlierThreshold=outlier_threshold, cardinalityThreshold=cardinality_threshold
    )
    pipeline, features, feature_counts, stages = train_hybrid(ready, inputs, leakage, specs, target, learner, thresholds, clock)
    labels = names.class_labels(names.domain_profile(found.domain_profile, df.columns), found.classes)
    model = TrainedModel(
        kind, pipeline, target, [text_of(c) for c in found.classes], [labels[c] for c in found.classes], inputs, features, leakage,
        found.domain_profile,
    )
    parts = evaluate(model, test, label, clock)
    clock.seconds["total_pipeline_sec"] = round(time.perf_counter() - started, 4)
    return TrainResult(
        model=model, train=train, test=test, test_key=key, importance=feature_importance(model), timings=clock.seconds,
        feature_counts=feature_counts, diagnostics=diagnostics(pipeline), stages=stages, **parts,
    )


_NUMERIC_NAMES = {"byte", "short", "integer", "long", "float", "double", "decimal"}


def model_comparison(results: dict[str, TrainResult], spark: SparkSession) -> DataFrame:
    """One row per trained model."""
    out = None
    for kind, r in results.items():
        row = r.metrics.select(
            F.lit(kind).alias("model_type"), F.lit(LEARNER_NAMES.get(kind, kind)).alias("model_label"),
            "accuracy", "precision", "recall", "f1", "roc_auc",
            F.lit(r.timings.get("model_training_sec")).cast("double").alias("training_sec"),
            F.lit(r.timings.get("total_pipeline_sec")).cast("double").alias("total_pipeline_sec"),
            F.lit(r.feature_counts["final"]).alias("feature_count"),
        )
        out = row if out is None else out.unionByName(row)
    return out


def best_per_metric(comparison: DataFrame, metrics: tuple = ("accuracy", "precision", "recall", "f1", "roc_auc")) -> DataFrame:
    """(metric, model_type, value, is_best); values within 1e-4 of the maximum tie."""
    long = comparison.unpivot("model_type", list(metrics), "metric", "value")
    best = F.max("value").over(Window.partitionBy("metric"))
    return long.withColumn("is_best", F.coalesce(F.abs(F.col("value") - best) < 1e-4, F.lit(False)))
