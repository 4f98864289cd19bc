"""Decision plan: statistics -> rule -> action, with one trace row per rule.

All rules are ordered ``when`` chains over the one-row-per-column statistics, so a plan
costs no further pass over the data.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsmith.functions.expr import percent
from tabsmith.functions.jobs import pinned
from tabsmith.operators.stats import TableStats
from tabsmith.plans.names import LEAKAGE_NAMES, normal


@dataclass(frozen=True)
class Thresholds:
    """Fixed default thresholds of the plan."""

    skewness: float = 1.0
    outlier: float = 0.02
    cardinality: int = 15


def _stat(**items: Column) -> Column:
    pairs = [x for k, v in items.items() for x in (F.lit(k), v.cast("string"))]
    return F.create_map(*pairs)


def _decision(
    stage: str, rule_id: str, action: Column | str, stat: Column, condition: Column, reason: Column, change: str
) -> Column:
    as_col = lambda v: F.lit(v) if isinstance(v, str) else v
    return F.struct(
        F.lit(stage).alias("stage"),
        F.lit(rule_id).alias("rule_id"),
        as_col(action).alias("selected_action"),
        stat.alias("detected_statistic"),
        condition.alias("threshold_condition"),
        reason.alias("reason"),
        F.lit(change).alias("resulting_feature_change"),
    )


def _text(template: str, *cols: Column) -> Column:
    return F.format_string(template, *cols)


def _rounded(c: Column, places: int = 4) -> Column:
    return F.round(c, places)


def _status_rules(leakage: list[str]) -> Column:
    names = sorted({normal(c) for c in leakage})
    name = F.col("column_name")
    is_num = F.col("data_type") == "numeric"
    unique = F.col("unique_count")
    counted = _stat(unique_count=unique, total_rows=F.col("n_rows"))
    missing = _stat(missing_count=F.col("missing_count"), missing_percentage=F.col("missing_pct"))
    stage = "column_evaluation"
    known = F.lower(F.trim(name)).isin(names) if names else F.lit(False)
    return (
        F.when(
            F.col("non_null") == 0,
            _decision(stage, "RULE_COMPLETELY_MISSING_EXCLUSION", "exclude", missing, F.lit("no valid value"),
                      F.lit("The column holds no value at all."), "column left out"),
        )
        .when(
            known,
            _decision(stage, "RULE_TARGET_LEAKAGE_EXCLUSION", "exclude_from_features", _stat(column_name=name),
                      F.lit("name in leakage list"),
                      _text("'%s' is listed as known only after the outcome.", name), "column kept out of the features"),
        )
        .when(
            F.col("nested"),
            _decision(stage, "RULE_NESTED_TYPE_EXCLUSION", "exclude", counted, F.lit("array, map, struct or binary type"),
                      _text("'%s' has a nested type, for which no rule exists.", name), "column left out"),
        )
        .when(
            F.col("constant"),
            _decision(stage, "RULE_CONSTANT_COLUMN_EXCLUSION", "exclude", counted, F.lit("distinct values <= 1"),
                      _text("'%s' has a single value and cannot separate anything.", name), "column left out"),
        )
        .when(
            ~is_num & (unique == F.col("n_rows")) & (F.col("n_rows") > 1),
            _decision(stage, "RULE_HIGH_CARDINALITY_IDENTIFIER_EXCLUSION", "exclude", counted,
                      F.lit("text with a different value in every row"),
                      _text("'%s' differs in every row, like an identifier.", name), "column left out"),
        )
        .when(
            is_num,
            _decision(stage, "RULE_USABLE_NUMERIC_RETAIN", "retain", missing, F.lit("numeric with >= 2 values"),
                      F.lit("Numeric column with usable spread."), "enters the numeric steps"),
        )
        .otherwise(
            _decision(stage, "RULE_USABLE_CATEGORICAL_RETAIN", "retain", missing, F.lit("text with >= 2 values"),
                      F.lit("Text column with usable categories."), "enters the categorical steps"),
        )
    )


# Status of a column by the rule that decided it.
STATUS_BY_RULE = {
    "RULE_COMPLETELY_MISSING_EXCLUSION": "completely_missing",
    "RULE_TARGET_LEAKAGE_EXCLUSION": "leakage_candidate",
    "RULE_NESTED_TYPE_EXCLUSION": "nested_type",
    "RULE_CONSTANT_COLUMN_EXCLUSION": "constant",
    "RULE_HIGH_CARDINALITY_IDENTIFIER_EXCLUSION": "potential_identifier",
    "RULE_USABLE_NUMERIC_RETAIN": "usable_numeric",
    "RULE_USABLE_CATEGORICAL_RETAIN": "usable_categorical",
}


def _imputation_rules(t: Thresholds) -> Column:
    is_num = F.col("data_type") == "numeric"
    skew = F.abs(F.col("skewness"))
    shown = _rounded(skew)
    stat = _stat(missing_count=F.col("missing_count"), missing_percentage=F.col("missing_pct"),
                 skewness=_rounded(F.col("skewness")))
    limit = F.lit(t.skewness)
    return (
        F.when(
            F.col("missing_count") == 0,
            _decision("imputation", "RULE_IMPUTATION_NONE", "none", stat, F.lit("missing_count == 0"),
                      F.lit("Nothing is missing."), "values kept"),
        )
        .when(
            ~is_num,
            _decision("imputation", "RULE_CATEGORICAL_IMPUTATION_MODE", "most_frequent_imputation", stat,
                      F.lit("text and missing_count > 0"), F.lit("Missing text takes the most frequent category."),
                      "missing values become the train mode"),
        )
        .when(
            skew < limit,
            _decision("imputation", "RULE_SKEW_AWARE_IMPUTATION_MEAN", "mean_imputation", stat,
                      _text("|skewness| %s < %s", shown.cast("string"), limit.cast("string")),
                      F.lit("Nearly symmetric, so the mean represents it."), "missing values become the train mean"),
        )
        .otherwise(
            _decision("imputation", "RULE_SKEW_AWARE_IMPUTATION_MEDIAN", "median_imputation", stat,
                      _text("|skewness| %s >= %s", shown.cast("string"), limit.cast("string")),
                      F.lit("Skewed, so the median represents it better."), "missing values become the train median"),
        )
    )


def _log_rules(t: Thresholds) -> Column:
    skew = F.abs(F.col("skewness"))
    shown = _rounded(skew).cast("string")
    low = _rounded(F.col("min")).cast("string")
    limit = F.lit(t.skewness)
    stat = _stat(skewness=_rounded(F.col("skewness")), abs_skewness=_rounded(skew), min_value=_rounded(F.col("min")))
    return (
        F.when(
            (skew > limit) & (F.col("min") >= 0),
            _decision("log_transformation", "RULE_LOG1P_TRANSFORM_APPLY", "log1p_transformation", stat,
                      _text("|skewness| %s > %s and min %s >= 0", shown, limit.cast("string"), low),
                      F.lit("Strongly skewed and never negative."), "values become log(1 + x)"),
        )
        .when(
            skew > limit,
            _decision("log_transformation", "RULE_LOG1P_TRANSFORM_NEGATIVE_BLOCK", "none", stat,
                      _text("|skewness| %s > %s but min %s < 0", shown, limit.cast("string"), low),
                      F.lit("Strongly skewed, but negative values forbid a logarithm."), "values kept"),
        )
        .otherwise(
            _decision("log_transformation", "RULE_LOG1P_TRANSFORM_NOT_NEEDED", "none", stat,
                      _text("|skewness| %s <= %s", shown, limit.cast("string")),
                      F.lit("Symmetric enough for a linear scale."), "values kept"),
        )
    )


def _scaling_rules(t: Thresholds) -> Column:
    # The planned share is over all rows, missing ones included.
    share = F.try_divide(F.col("outlier_count").cast("double"), F.col("n_rows").cast("double"))
    shown = _rounded(share * 100, 2).cast("string")
    limit = F.lit(t.outlier)
    stat = _stat(outlier_count=F.col("outlier_count"), outlier_proportion=_rounded(share),
                 q1=_rounded(F.col("q1")), q3=_rounded(F.col("q3")), iqr=_rounded(F.col("iqr")))
    return F.when(
        share > limit,
        _decision("scaling", "RULE_OUTLIER_AWARE_SCALING_ROBUST", "RobustScaler", stat,
                  _text("outlier share %s%% > %s%%", shown, (limit * 100).cast("string")),
                  F.lit("Many outliers: centre by the median, scale by the quartile range."),
                  "median and IQR scaling"),
    ).otherwise(
        _decision("scaling", "RULE_OUTLIER_AWARE_SCALING_STANDARD", "StandardScaler", stat,
                  _text("outlier share %s%% <= %s%%", shown, (limit * 100).cast("string")),
                  F.lit("Few outliers: centre by the mean, scale by the standard deviation."),
                  "mean and standard deviation scaling"),
    )


def _encoding_rules(t: Thresholds) -> Column:
    unique = F.col("unique_count")
    limit = F.lit(t.cardinality)
    stat = _stat(cardinality=unique, threshold=limit)
    return F.when(
        unique <= limit,
        _decision("encoding", "RULE_CARDINALITY_ENCODING_ONEHOT", "one_hot_encoding", stat,
                  _text("cardinality %d <= %d", unique, limit), F.lit("Few categories: one indicator each."),
                  "one indicator column per category"),
    ).otherwise(
        _decision("encoding", "RULE_CARDINALITY_ENCODING_ORDINAL", "label_encoding", stat,
                  _text("cardinality %d > %d", unique, limit), F.lit("Many categories: one ordered code."),
                  "one code column"),
    )


def decision_plan(
    stats: TableStats,
    spark: SparkSession,
    leakage_columns: list[str] | None = None,
    thresholds: Thresholds = Thresholds(),
) -> DataFrame:
    """One row per column: status, statistics and the decisions as an array of structs.

    ``leakage_columns=None`` uses the default list, ``[]`` none.
    """
    if not stats.n_rows:
        raise ValueError("A plan needs at least one row.")
    leakage = LEAKAGE_NAMES if leakage_columns is None else leakage_columns
    base = stats.to_df(spark).select(
        "*",
        F.round(percent(F.col("missing_count"), F.col("n_rows")), 2).alias("missing_pct"),
        F.round(F.try_divide(F.col("unique_count").cast("double"), F.col("n_rows").cast("double")), 4).alias("cardinality"),
        (F.col("q3") - F.col("q1")).alias("iqr"),
        # Numeric columns are constant when min = max, so no distinct count is needed.
        F.when(F.col("data_type") == "numeric", F.col("min") == F.col("max"))
        .otherwise(F.col("unique_count") <= 1)
        .alias("constant"),
    )
    judged = pinned(base.withColumn("evaluation", _status_rules(leakage))).withColumn(
        "status",
        F.element_at(
            F.create_map(*[F.lit(x) for kv in STATUS_BY_RULE.items() for x in kv]), F.col("evaluation.rule_id")
        ),
    )
    numeric = [_imputation_rules(thresholds), _log_rules(thresholds), _scaling_rules(thresholds)]
    categorical = [_imputation_rules(thresholds), _encoding_rules(thresholds)]
    steps = (
        F.when(F.col("status") == "usable_numeric", F.array(F.col("evaluation"), *numeric))
        .when(F.col("status") == "usable_categorical", F.array(F.col("evaluation"), *categorical))
        .otherwise(F.array(F.col("evaluation")))
    )
    plan = judged.withColumn("decisions", steps).withColumn(
        "is_usable", F.col("status").isin("usable_numeric", "usable_categorical")
    )
    actions = F.transform(F.slice("decisions", 2, 3), lambda d: d["selected_action"])
    rationale = F.when(
        F.col("status") == "usable_numeric",
        # A log step is only named when it is taken.
        F.concat_ws(
            " -> ",
            F.element_at(actions, 1),
            F.when(F.element_at(actions, 2) != "none", F.lit("log1p")),
            F.element_at(actions, 3),
        ),
    ).otherwise(F.concat_ws(" -> ", actions))
    return pinned(
        plan.withColumn(
            "summary_rationale", F.when(F.col("is_usable"), rationale).otherwise(F.col("evaluation.reason"))
        ).drop("evaluation", "constant", "nested", "text_bytes")
    )


def decision_trace(plan: DataFrame) -> DataFrame:
    """One row per evaluated rule, in column and step order."""
    return plan.select(
        "position", "column_name", F.posexplode("decisions").alias("step", "d")
    ).select("position", "step", "column_name", "d.*")


def plan_counts(plan: DataFrame) -> DataFrame:
    """The counters of a plan in one row."""
    trace = decision_trace(plan)
    by_action = lambda a: F.count_if(F.col("selected_action") == a)
    by_rule = lambda r: F.count_if(F.col("rule_id") == r)
    excluded = [r for r, s in STATUS_BY_RULE.items() if not s.startswith("usable") and s != "leakage_candidate"]
    return trace.agg(
        by_action("mean_imputation").alias("mean_imputations"),
        by_action("median_imputation").alias("median_imputations"),
        by_action("most_frequent_imputation").alias("most_frequent_imputations"),
        by_action("RobustScaler").alias("robust_scalers"),
        by_action("StandardScaler").alias("standard_scalers"),
        by_action("log1p_transformation").alias("log1p_transformations"),
        by_action("one_hot_encoding").alias("one_hot_encodings"),
        by_action("label_encoding").alias("label_encodings"),
        by_rule("RULE_USABLE_NUMERIC_RETAIN").alias("usable_numeric_columns"),
        by_rule("RULE_USABLE_CATEGORICAL_RETAIN").alias("usable_categorical_columns"),
        F.count_if(F.col("rule_id").isin(excluded)).alias("excluded_columns"),
        by_rule("RULE_TARGET_LEAKAGE_EXCLUSION").alias("leakage_columns"),
        F.count(F.lit(1)).alias("total_decisions_logged"),
    )


def filter_plan(plan: DataFrame, search: str = "", status: str = "all") -> DataFrame:
    out = plan.filter(F.lower("column_name").contains(search.lower()))
    return out if status == "all" else out.filter(F.col("status") == status)


def filter_trace(trace: DataFrame, search: str = "", stage: str = "all") -> DataFrame:
    text = search.lower()
    hit = F.lit(False)
    for c in ("column_name", "rule_id", "reason"):
        hit = hit | F.lower(c).contains(text)
    out = trace.filter(hit)
    return out if stage == "all" else out.filter(F.col("stage") == stage)
