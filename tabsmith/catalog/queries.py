"""Registered queries: one entry per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsmith.catalog.tables import (
    dirty_events,
    dirty_lineitem,
    doubled_lineitem,
    flagged_lineitem,
    labelled_documents,
    order_facts,
    scored_lineitem,
    table,
)
from tabsmith.functions.jobs import scratch_folder
from tabsmith.operators import autoconfig, eda, metrics, models, profile
from tabsmith.operators.benchmark import run_benchmark
from tabsmith.operators.compare import Comparison
from tabsmith.operators.correlation import correlation_matrix, correlation_pairs, strong_pairs
from tabsmith.operators.preprocess import HybridPreprocessor, PlainPreprocessor
from tabsmith.operators.ratios import RatioFeatures
from tabsmith.operators.selection import FeatureSelector, anova_f
from tabsmith.operators.split import class_distribution, holdout_split
from tabsmith.operators.stats import TableStats, duplicate_row_count, table_stats
from tabsmith.plans.rules import decision_plan, decision_trace, plan_counts
from tabsmith.sources.sinks import export_table
from tabsmith.sources.tables import preview, read_csv, read_table
from tabsmith.streaming.scoring import read_file_stream, score_stream

Query = Callable[[SparkSession, str], DataFrame]


def stable(name: str) -> Column:
    """Large magnitudes lose decimals: two engines agree on about ten digits."""
    c = F.col(name)
    return F.when(F.abs(c) >= 1e6, F.round(c, 0)).otherwise(c).alias(name)


def _lean(df: DataFrame, **kwargs) -> TableStats:
    return table_stats(df, **{"numeric_values": False, "text_values": False, "quantiles": False, **kwargs})


# ---- profile -----------------------------------------------------------------------


def dataset_summary(spark, d):
    return profile.dataset_summary(doubled_lineitem(spark, d)).drop("data_bytes", "data_mb")


def duplicate_rows(spark, d):
    return duplicate_row_count(doubled_lineitem(spark, d))


def data_size(spark, d):
    return profile.data_bytes(table(spark, d, "part"))


def column_missing(spark, d):
    s = _lean(dirty_lineitem(spark, d)).to_df(spark)
    return s.select("column_name", "missing_count", F.round(F.col("missing_count") / F.col("n_rows") * 100, 2).alias("missing_percentage"))


def column_distinct(spark, d):
    p = profile.column_profiles(table_stats(dirty_lineitem(spark, d), quantiles=False), spark)
    return p.select("column_name", "unique_count", "cardinality")


def numeric_moments(spark, d):
    p = profile.column_profiles(_lean(dirty_lineitem(spark, d)), spark).filter("inferred_type = 'numeric'")
    return p.select("column_name", *[stable(c) for c in ("min", "max", "mean", "std", "variance", "skewness")])


def quartiles_iqr(spark, d):
    p = profile.column_profiles(_lean(dirty_events(spark, d), quantiles=True), spark)
    return p.filter("inferred_type = 'numeric'").select("column_name", "q1", "median", "q3", "iqr")


def iqr_outliers(spark, d):
    p = profile.column_profiles(_lean(dirty_events(spark, d), quantiles=True), spark)
    return p.filter("inferred_type = 'numeric'").select("column_name", "outlier_count", "outlier_percentage")


def most_frequent(spark, d):
    p = profile.column_profiles(table_stats(dirty_events(spark, d), numeric_values=False, quantiles=False), spark)
    return p.filter("inferred_type <> 'numeric'").select(
        "column_name", "most_frequent_value", "most_frequent_frequency", "most_frequent_percentage"
    )


def long_text_profile(spark, d):
    s = table_stats(table(spark, d, "documents"), numeric_values=False, quantiles=False).to_df(spark)
    return s.filter("data_type <> 'numeric'").select("column_name", "unique_count", "top_value", "top_count")


def quality_flags(spark, d):
    p = profile.column_profiles(table_stats(dirty_events(spark, d)), spark)
    return p.select("column_name", F.array_join("data_quality_flags", "|").alias("flags"))


def column_profile(spark, d):
    p = profile.column_profiles(table_stats(table(spark, d, "customer")), spark)
    return p.select(
        "column_name", "inferred_type", "missing_count", "unique_count", "cardinality",
        *[stable(c) for c in ("min", "max", "mean", "median", "std", "variance", "skewness", "q1", "q3", "iqr")],
        "outlier_count", "most_frequent_value", "most_frequent_frequency",
    )


def target_profile(spark, d):
    return profile.target_profile(dirty_lineitem(spark, d), "returnflag").drop("target_column")


def quality_score(spark, d):
    df = doubled_lineitem(spark, d)
    stats = table_stats(df, numeric_values=False)
    return profile.quality_score(
        profile.dataset_summary(df, stats), profile.column_profiles(stats, spark), profile.target_profile(df, "returnflag")
    )


# ---- exploratory analysis ----------------------------------------------------------


def missing_ranking(spark, d):
    return eda.missing_ranking(_lean(dirty_events(spark, d)), spark)


def missing_overview(spark, d):
    return eda.missing_overview(_lean(dirty_events(spark, d)), spark)


def numeric_summary(spark, d):
    s = eda.numeric_summary(_lean(dirty_events(spark, d), quantiles=True), spark)
    return s.select("interest_rank", "column_name", "count", *[stable(c) for c in ("mean", "std", "variance", "skewness")],
                    "outlier_count", "interest_score")


def histogram_10(spark, d):
    df = dirty_events(spark, d)
    return eda.histograms(df, _lean(df), ["value", "balance", "user_id"])


def boxplot(spark, d):
    df = dirty_events(spark, d)
    b = eda.boxplots(df, _lean(df, quantiles=True), ["value", "balance", "user_id"], ["event_id"])
    shown = F.array_join(F.transform("outliers_sample", lambda x: F.format_string("%.2f", x)), ",")
    return b.withColumn("outliers_sample", shown)


def categorical_summary(spark, d):
    stats = table_stats(dirty_events(spark, d), numeric_values=False, quantiles=False)
    return eda.categorical_summary(stats, spark).drop("position")


def category_topk(spark, d):
    df = table(spark, d, "part").drop("p_name")
    return eda.category_chart(df, table_stats(df, numeric_values=False, quantiles=False))


def corr_pairs(spark, d):
    df = dirty_lineitem(spark, d).drop("orderkey")
    return correlation_pairs(df, _lean(df)).select("column_1", "column_2", "correlation")


def corr_matrix(spark, d):
    df = table(spark, d, "part")
    return correlation_matrix(correlation_pairs(df, _lean(df)))


def corr_strong_pairs(spark, d):
    df = flagged_lineitem(spark, d)
    return strong_pairs(correlation_pairs(df, _lean(df)))


def outlier_table(spark, d):
    return eda.outlier_table(_lean(dirty_events(spark, d), quantiles=True), spark)


def _findings(spark, d):
    df = dirty_events(spark, d)
    stats = table_stats(df, numeric_values=False)
    return eda.findings(stats, correlation_pairs(df, stats), spark)


def findings(spark, d):
    return _findings(spark, d).select("section", "ord", "category", "severity", "message")


def severity_counts(spark, d):
    return eda.severity_counts(_findings(spark, d))


def top_findings(spark, d):
    return eda.top_findings(_findings(spark, d)).select("section", "category", "severity")


def eda_flags(spark, d):
    df = dirty_lineitem(spark, d)
    return eda.run_eda(df).flags


# ---- automatic configuration -------------------------------------------------------


def target_scores(spark, d):
    c = autoconfig.target_candidates(labelled_documents(spark, d))
    return c.select("rank", "column_name", "score", "unique_count", F.round("min_class_share", 6).alias("min_class_share"))


def leak_correlation(spark, d):
    rs = autoconfig.correlation_with_target(flagged_lineitem(spark, d), ["quantity", "discount", "rebate", "tax"], "flag")
    return spark.createDataFrame(list(rs.items()), "column_name string, abs_r double").withColumn("abs_r", F.round("abs_r", 6))


def leak_contingency(spark, d):
    return autoconfig.contingency(flagged_lineitem(spark, d), ["returnflag", "band", "actual_status"], "flag")


def leak_purity(spark, d):
    p = autoconfig.purity(flagged_lineitem(spark, d), ["returnflag", "band", "discount", "tax"], "flag")
    return p.select("column_name", F.round("purity", 6).alias("purity"), "categories")


def leakage(spark, d):
    found = autoconfig.detect_leakage(flagged_lineitem(spark, d), "flag")
    return found.select("column_name", "type", "severity", F.round("statistic", 6).alias("statistic"), "reason", "recommendation")


def auto_config(spark, d):
    return autoconfig.auto_config(labelled_documents(spark, d)).to_df(spark)


# ---- decision plan -----------------------------------------------------------------


def _plan(spark, d):
    return decision_plan(table_stats(dirty_events(spark, d), numeric_values=False), spark)


def plan_status(spark, d):
    return _plan(spark, d).select("column_name", "status", "is_usable", "missing_count")


def _stage(spark, d, stage):
    t = decision_trace(_plan(spark, d)).filter(F.col("stage") == stage)
    return t.select("column_name", "rule_id", "selected_action")


def plan_imputation(spark, d):
    return _stage(spark, d, "imputation")


def plan_scaling(spark, d):
    return _stage(spark, d, "scaling")


def plan_log1p(spark, d):
    return _stage(spark, d, "log_transformation")


def plan_encoding(spark, d):
    return _stage(spark, d, "encoding")


def plan_count(spark, d):
    return plan_counts(_plan(spark, d))


def plan_trace(spark, d):
    return decision_trace(_plan(spark, d)).select("column_name", "step", "stage", "rule_id", "selected_action")


# ---- preprocessing -----------------------------------------------------------------


def _fit(df: DataFrame, key: str):
    return HybridPreprocessor(inputCols=[c for c in df.columns if c != key]).fit(df)


def _rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(f"`{f.name}`", places).alias(f.name) if f.dataType.typeName() == "double" else F.col(f"`{f.name}`")
                       for f in df.schema.fields])


def cleaned_table(spark, d):
    df = dirty_events(spark, d)
    return _rounded(_fit(df, "event_id").transform_cleaned(df))


def impute_numeric(spark, d):
    df = dirty_lineitem(spark, d).select("orderkey", "partkey", "suppkey", "quantity", "price")
    m = HybridPreprocessor(inputCols=["quantity", "price"]).fit(df)
    return _rounded(m.transform_cleaned(df))


def impute_mode(spark, d):
    df = dirty_events(spark, d).select("event_id", "event_type", "props")
    return _fit(df, "event_id").transform_cleaned(df)


def log1p_scale_robust(spark, d):
    df = dirty_events(spark, d).select("event_id", "value", "balance")
    return _rounded(_fit(df, "event_id").transform(df))


def scale_standard(spark, d):
    df = dirty_lineitem(spark, d).select("orderkey", "partkey", "suppkey", "quantity", "price", "discount", "tax")
    m = HybridPreprocessor(inputCols=["quantity", "price", "discount", "tax"]).fit(df)
    return _rounded(m.transform(df), 4)


def one_hot(spark, d):
    df = dirty_events(spark, d).select("event_id", "event_type")
    return _fit(df, "event_id").transform(df)


def one_hot_hard_names(spark, d):
    """Categories with dots and backticks, and labels of two columns that meet."""
    city = F.concat(F.lit("St. "), F.translate("o_orderpriority", "-", "`"))
    meets = F.when(F.col("o_orderkey") % 2 == 0, "b_c").otherwise("x")
    df = table(spark, d, "orders").select("o_orderkey", city.alias("city"), meets.alias("a"), F.when(F.col("o_orderkey") % 3 == 0, "c").otherwise("y").alias("a_b"))
    m = HybridPreprocessor(inputCols=["city", "a", "a_b"]).fit(df)
    labels = dict(zip(m.feature_names, m.feature_labels))
    long = m.transform(df).unpivot("o_orderkey", m.feature_names, "feature", "value")
    label = F.element_at(F.create_map(*[F.lit(x) for pair in labels.items() for x in pair]), F.col("feature"))
    return long.groupBy(label.alias("label"), "feature").agg(F.sum("value").alias("ones")).select("label", "ones")


def ordinal(spark, d):
    df = dirty_events(spark, d).select("event_id", "props")
    return _fit(df, "event_id").transform(df)


def plain_ordinal(spark, d):
    df = dirty_lineitem(spark, d).select("orderkey", "partkey", "suppkey", "quantity", "returnflag")
    m = PlainPreprocessor(inputCols=["quantity", "returnflag"], encoding="ordinal").fit(df)
    return _rounded(m.transform(df), 4)


def one_hot_capped(spark, d):
    df = table(spark, d, "part").select("p_partkey", "p_brand", "p_type")
    m = PlainPreprocessor(inputCols=["p_brand", "p_type"], encoding="onehot").fit(df)
    out = m.transform(df)
    features = m.feature_names
    long = out.unpivot("p_partkey", features, "feature", "value")
    return long.groupBy("feature").agg(F.sum("value").alias("ones"), F.count("value").alias("n"))


def fit_metadata(spark, d):
    m = _fit(dirty_events(spark, d), "event_id").metadata(spark)
    return m.select("column_name", "imputation_method", "log1p_applied", "scaler_type", "outlier_percentage", "encoder_type", "cardinality")


# ---- comparison --------------------------------------------------------------------


def _comparison(spark, d):
    raw = doubled_lineitem(spark, d)
    return _compared(raw)


def _compared(raw):
    model = HybridPreprocessor().fit(raw)
    return Comparison(raw, model.transform_cleaned(raw), cleaned=model.cleaned_columns(raw))


def compare_overall(spark, d):
    return _comparison(spark, d).overall()


def compare_numeric(spark, d):
    c = _comparison(spark, d).numeric_columns()
    return c.select("column_name", "before_missing", "before_missing_pct", "after_missing", "before_outliers", "after_outliers",
                    *[stable(f"{s}_{k}") for s in ("before", "after") for k in ("min", "max", "mean", "median", "std", "skewness")])


def compare_hist(spark, d):
    return _comparison(spark, d).histograms()


def compare_categories(spark, d):
    return _comparison(spark, d).categories()


def compare_long_text(spark, d):
    """Whole texts as categories: copies and texts that occur once, before and after filling."""
    return _compared(table(spark, d, "documents").select("text", "lang", "source")).categories()


def impute_mode_long_text(spark, d):
    """English texts; where a document holds none, the most frequent one is filled in."""
    docs = table(spark, d, "documents").select("doc_id", F.when(F.col("lang") == "en", F.col("text")).alias("text"))
    cleaned = HybridPreprocessor(inputCols=["text"]).fit(docs.select("text")).transform_cleaned(docs)
    return cleaned.groupBy("text").agg(F.count(F.lit(1)).alias("cnt"), F.max("doc_id").alias("last_id")).select(F.sha2("text", 256).alias("digest"), "cnt", "last_id")


# ---- ratio features and selection --------------------------------------------------

RATIO_SPECS = [
    {"name": "unit_price", "numerator_col": "price", "denominator_col": "quantity", "leakage_risk": False},
    {"name": "tax_share", "numerator_col": "tax", "denominator_col": "discount", "leakage_risk": False},
    {"name": "same", "numerator_col": "price", "denominator_col": "linestatus", "leakage_risk": False},
    {"name": "flat", "numerator_col": "discount", "denominator_col": "price", "leakage_risk": False},
    {"name": "void", "numerator_col": "discount", "denominator_col": "nowhere", "leakage_risk": False},
    {"name": "leak", "numerator_col": "price", "denominator_col": "tax", "leakage_risk": True},
]


def ratio_validate(spark, d):
    m = RatioFeatures(specs=RATIO_SPECS, leakageColumns=[]).fit(dirty_lineitem(spark, d)).report(spark)
    stat = lambda k: F.round(F.try_element_at("detected_statistic", F.lit(k)).cast("double"), 4).alias(k)
    return m.select("name", "status", "rule_id", stat("variance"), stat("max_source_correlation"))


def ratio_apply(spark, d):
    df = dirty_lineitem(spark, d)
    out = RatioFeatures(specs=RATIO_SPECS).fit(df).transform(df)
    return _rounded(out.select("orderkey", "partkey", "suppkey", "unit_price", "tax_share"))


def _selector_input(spark, d):
    c = F.col
    return dirty_lineitem(spark, d).select(
        "quantity", "price", "discount", "tax", (c("discount") * 0.001).alias("tiny"), (c("quantity") * 3 + 1).alias("tripled"),
        (c("price") / 2 + c("tax")).alias("half_price"), "linestatus",
    )


def select_features(spark, d):
    m = FeatureSelector(targetCol="linestatus", pValueThreshold=-1.0).fit(_selector_input(spark, d))
    return m.trace(spark).select("feature", "rule_id", "selected_action", "kept_feature")


def select_relevance(spark, d):
    m = FeatureSelector(targetCol="linestatus").fit(_selector_input(spark, d))
    return m.relevance(spark)


def anova(spark, d):
    df = dirty_lineitem(spark, d)
    got = anova_f(df, ["quantity", "price", "discount", "tax"], "returnflag")
    return spark.createDataFrame([(k, v[0]) for k, v in got.items()], "feature string, f_statistic double").withColumn(
        "f_statistic", F.round("f_statistic", 6)
    )


def split_class_counts(spark, d):
    train, test = holdout_split(dirty_lineitem(spark, d), "linestatus", key=["orderkey", "partkey", "suppkey", "linenumber"])
    return class_distribution(train, test, "linestatus")


def split_many_classes(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 60).alias("class"))
    _, test = holdout_split(orders, "class", key=["o_orderkey"])
    return test.groupBy("class").agg(F.count(F.lit(1)).alias("test_rows"))


def split_plain(spark, d):
    train, test = holdout_split(table(spark, d, "orders"), None, key=["o_orderkey"])
    sides = [x.agg(F.lit(n).alias("split"), F.count(F.lit(1)).alias("split_rows")) for n, x in (("train", train), ("test", test))]
    return sides[0].unionByName(sides[1])


# ---- metrics -----------------------------------------------------------------------


def confusion(spark, d):
    return metrics.confusion_matrix(scored_lineitem(spark, d), "flag", "flag_predicted", ["A", "N", "R"])


def class_report(spark, d):
    counts = metrics.confusion_counts(scored_lineitem(spark, d), "flag", "flag_predicted")
    return metrics.full_class_report(counts)


def binary_metrics(spark, d):
    m = metrics.classification_metrics(scored_lineitem(spark, d), "truth", "predicted", {0: 1 - F.col("score"), 1: F.col("score")}, [0, 1])
    return m.select("accuracy", "precision", "recall", "f1", "precision_macro", "recall_macro", "f1_macro",
                    "precision_weighted", "recall_weighted", "f1_weighted", "roc_auc")


def roc_auc_ovr(spark, d):
    auc = metrics.roc_auc_by_class(
        scored_lineitem(spark, d), "flag", {"A": F.col("p_a"), "N": F.col("p_n"), "R": F.col("p_r")}
    )
    return auc.select(F.col("class_index").cast("bigint").alias("class_index"), F.round("auc", 6).alias("auc"))


def roc_auc_many_classes(spark, d):
    """One-vs-rest areas of 60 classes, of scores that lean on the class, with ties."""
    orders = table(spark, d, "orders").select((F.col("o_custkey") % 60).alias("y"), F.col("o_orderkey").alias("k"), F.floor("o_totalprice").alias("p"))
    own = lambda c: F.when(F.col("y") == c, 60 + 5 * c).otherwise(0)
    scores = {c: ((F.col("k") * (c + 7) + F.col("p")) % 997 + own(c)).cast("double") for c in range(60)}
    auc = metrics.roc_auc_by_class(orders, "y", scores)
    return auc.select(F.col("class_index").cast("bigint").alias("class_index"), F.round("auc", 6).alias("auc"))


# ---- models ------------------------------------------------------------------------


def _train(spark, d, kind):
    return models.train_model(
        order_facts(spark, d), kind, "large_order_flag", leakage=["o_orderkey"], specs=[], key=["o_orderkey"]
    )


def _metric_row(result):
    return result.metrics.select("accuracy", "precision", "recall", "f1", "roc_auc")


def train_logistic_regression(spark, d):
    return _metric_row(_train(spark, d, "logistic_regression"))


def train_decision_tree(spark, d):
    return _metric_row(_train(spark, d, "decision_tree"))


def train_random_forest(spark, d):
    return _metric_row(_train(spark, d, "random_forest"))


def train_gradient_boosting(spark, d):
    return _metric_row(_train(spark, d, "gradient_boosting"))


def benchmark_abc(spark, d):
    b = run_benchmark(order_facts(spark, d), "large_order_flag", leakage=["o_orderkey"], specs=[], key=["o_orderkey"])
    return b.table(spark).select("pipeline", "accuracy", "precision", "recall", "f1", "roc_auc", "features_final", "converged")


def feature_importance(spark, d):
    return _train(spark, d, "decision_tree").importance


def sample_records(spark, d):
    return _train(spark, d, "decision_tree").sample_records().select("o_orderkey", "true_class", "predicted_class", "correct")


def model_comparison(spark, d):
    results = {k: _train(spark, d, k) for k in ("logistic_regression", "decision_tree")}
    return models.best_per_metric(models.model_comparison(results, spark))


def score_batch(spark, d):
    df = order_facts(spark, d)
    scored = _train(spark, d, "logistic_regression").model.score(df)
    return scored.groupBy("predicted_class", "confidence_level", "risk_level").agg(F.count(F.lit(1)).alias("n"))


def score_streamed(spark, d):
    """Train, save, reload, then score the orders as a file stream."""
    folder = scratch_folder(spark)
    df = order_facts(spark, d)
    _train(spark, d, "logistic_regression").model.save(f"{folder}/model")
    df.write.parquet(f"{folder}/in")
    stream = read_file_stream(spark, f"{folder}/in", df.schema)
    query = score_stream(models.TrainedModel.load(f"{folder}/model"), stream, f"{folder}/out", f"{folder}/checkpoint")
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/out").groupBy("predicted_class").agg(F.count(F.lit(1)).alias("n"))


# ---- sources and sinks -------------------------------------------------------------


def csv_roundtrip(spark, d):
    """Export the cleaned table as CSV, read it back, describe what arrived."""
    folder = scratch_folder(spark)
    df = dirty_lineitem(spark, d)
    export_table(df, f"{folder}/cleaned")
    back = read_csv(spark, f"{folder}/cleaned")
    return back.agg(
        F.count(F.lit(1)).alias("n"), F.count("quantity").alias("quantities"), F.count("returnflag").alias("flags"),
        F.round(F.sum("price"), 2).alias("price_sum"), F.sum("linenumber").alias("line_sum"), F.max("linestatus").alias("last_status"),
    )


def csv_roundtrip_text(spark, d):
    """Whole texts with line breaks and quotes, and JSON-like properties, exported as CSV and read back."""
    folder = scratch_folder(spark)
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    events = table(spark, d, "events").select(F.col("event_id").alias("doc_id"), F.concat(F.lit('say "'), "props", F.lit('",\n')).alias("text"), F.lit("ev").alias("lang"), F.col("event_type").alias("source"), F.length("props").cast("bigint").alias("n_chars"))
    export_table(docs.unionByName(events), f"{folder}/texts")
    back = read_csv(spark, f"{folder}/texts")
    return back.select("doc_id", "lang", "source", "n_chars", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def preview_rows(spark, d):
    return preview(read_table(spark, f"{d}/nation.parquet").orderBy("n_nationkey"), 10)


def queries() -> dict[str, Query]:
    listed = [
        dataset_summary, duplicate_rows, data_size, column_missing, column_distinct, numeric_moments, quartiles_iqr,
        iqr_outliers, most_frequent, long_text_profile, quality_flags, column_profile, target_profile, quality_score,
        missing_ranking, missing_overview, numeric_summary, histogram_10, boxplot, categorical_summary, category_topk,
        corr_pairs, corr_matrix, corr_strong_pairs, outlier_table, findings, severity_counts, top_findings, eda_flags,
        target_scores, leak_correlation, leak_contingency, leak_purity, leakage, auto_config,
        plan_status, plan_imputation, plan_scaling, plan_log1p, plan_encoding, plan_count, plan_trace,
        cleaned_table, impute_numeric, impute_mode, log1p_scale_robust, scale_standard, one_hot, one_hot_hard_names, ordinal, plain_ordinal,
        one_hot_capped, fit_metadata, compare_overall, compare_numeric, compare_hist, compare_categories, compare_long_text, impute_mode_long_text,
        ratio_validate, ratio_apply, select_features, select_relevance, anova, split_class_counts, split_many_classes, split_plain,
        confusion, class_report, binary_metrics, roc_auc_ovr, roc_auc_many_classes,
        train_logistic_regression, train_decision_tree, train_random_forest, train_gradient_boosting, benchmark_abc,
        feature_importance, sample_records, model_comparison, score_batch, score_streamed, csv_roundtrip, csv_roundtrip_text,
        preview_rows,
    ]
    return {q.__name__: q for q in listed}
