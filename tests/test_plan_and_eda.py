import numpy as np
import pandas as pd
import pytest

from tabsmith.operators import correlation, eda
from tabsmith.operators.stats import table_stats
from tabsmith.plans.rules import Thresholds, decision_plan, decision_trace, filter_plan, filter_trace, plan_counts


def plan_of(spark, values, ddl, **kw):
    df = spark.createDataFrame(values, ddl)
    return decision_plan(table_stats(df), spark, **kw)


def rules(plan, stage):
    return {r["column_name"]: r["rule_id"] for r in decision_trace(plan).filter(f"stage = '{stage}'").collect()}


def test_statuses(spark):
    rows = [(i, f"n{i}", "k", None, float(i % 3), "xy"[i % 2], i * 2.0, [i]) for i in range(6)]
    ddl = ("num int, ident string, const string, void string, n2 double, two string, `Delivery Status` double, arr array<int>")
    status = {r["column_name"]: r["status"] for r in plan_of(spark, rows, ddl).collect()}
    assert status == {
        "num": "usable_numeric", "ident": "potential_identifier", "const": "constant", "void": "completely_missing",
        "n2": "usable_numeric", "two": "usable_categorical", "Delivery Status": "leakage_candidate", "arr": "nested_type",
    }
    free = {r["column_name"]: r["status"] for r in plan_of(spark, rows, ddl, leakage_columns=[]).collect()}
    assert free["Delivery Status"] == "usable_numeric"


def test_numeric_rules_both_ways(spark):
    skewed = [1.0, 2.0, 2.0, 3.0, 3.0, 4.0, 500.0, None]
    even = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, None]
    negative = [-50.0, 1.0, 1.0, 2.0, 2.0, 2.0, 900.0, 3.0]
    plan = plan_of(spark, list(zip(skewed, even, negative)), "s double, e double, n double")
    assert rules(plan, "imputation") == {
        "s": "RULE_SKEW_AWARE_IMPUTATION_MEDIAN", "e": "RULE_SKEW_AWARE_IMPUTATION_MEAN", "n": "RULE_IMPUTATION_NONE"}
    assert rules(plan, "log_transformation") == {
        "s": "RULE_LOG1P_TRANSFORM_APPLY", "e": "RULE_LOG1P_TRANSFORM_NOT_NEEDED", "n": "RULE_LOG1P_TRANSFORM_NEGATIVE_BLOCK"}
    assert rules(plan, "scaling") == {
        "s": "RULE_OUTLIER_AWARE_SCALING_ROBUST", "e": "RULE_OUTLIER_AWARE_SCALING_STANDARD", "n": "RULE_OUTLIER_AWARE_SCALING_ROBUST"}


def test_encoding_limit_and_counts_add_up(spark):
    rows = [(f"c{i % 15}", f"d{i % 16}", float(i)) for i in range(40)]
    plan = plan_of(spark, rows, "few string, many string, x double")
    assert rules(plan, "encoding") == {"few": "RULE_CARDINALITY_ENCODING_ONEHOT", "many": "RULE_CARDINALITY_ENCODING_ORDINAL"}
    counts = plan_counts(plan).first()
    assert counts["one_hot_encodings"] == counts["label_encodings"] == 1
    assert counts["total_decisions_logged"] == decision_trace(plan).count() == 4 + 3 + 3
    tight = plan_of(spark, rows, "few string, many string, x double", thresholds=Thresholds(cardinality=3))
    assert plan_counts(tight).first()["label_encodings"] == 2
    assert filter_plan(plan, "ma", "usable_categorical").count() == 1
    assert filter_trace(decision_trace(plan), "onehot", "encoding").count() == 1


def test_empty_table_is_refused(spark):
    df = spark.createDataFrame([], "a int")
    with pytest.raises(ValueError):
        decision_plan(table_stats(df), spark)
    with pytest.raises(ValueError):
        eda.run_eda(df)


def test_eda_numeric_only(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i + (i % 2) * 0.1, float((i * 7) % 5)) for i in range(8)], "n1 double, n2 double, n3 double")
    r = eda.run_eda(df)
    assert r.categorical is None and r.strong_pairs.count() >= 1 and r.missing.count() == 0
    assert r.findings.filter("category = 'Missingness' and severity = 'info'").count() == 1


def test_eda_text_only_and_single_numeric(spark):
    text = eda.run_eda(spark.createDataFrame([(c, c.upper()) for c in "abcab"], "c1 string, c2 string"))
    flags = text.flags.first()
    assert not flags["numeric_analysis"] and text.outliers is None and text.correlation_matrix is None
    single = eda.run_eda(spark.createDataFrame([(float(i), "ab"[i % 2]) for i in range(5)], "single_num double, cat string"))
    assert single.correlation_matrix is None and single.correlation_reason


def test_eda_missing_ranking_high_cardinality_and_skew(spark):
    missing = spark.createDataFrame([(1.0, None, "a"), (None, None, None), (3.0, 2.0, "b"), (4.0, None, "a"), (5.0, 1.0, "b")],
                                    "num1 double, num2 double, cat1 string")
    ranked = [r["column_name"] for r in eda.run_eda(missing).missing.orderBy("rank").collect()]
    assert ranked == ["num2", "num1", "cat1"]
    high = spark.createDataFrame([(f"i{i}", f"c{i}") for i in range(50)], "id_col string, cat_col string")
    r = eda.run_eda(high)
    assert all(x["is_high_cardinality"] for x in r.categorical.collect()) and r.category_chart.count() == 0
    skew = spark.createDataFrame([(float(v), i) for i, v in enumerate((1, 1, 2, 2, 3, 3, 4, 5, 100))], "skewed_col double, normal_col int")
    found = eda.run_eda(skew).findings
    assert found.filter("category = 'Outliers'").count() == 1 and found.filter("category like 'Distribution%'").count() == 1
    assert eda.top_findings(found).count() <= 5
    assert eda.filter_findings(found, "medium", "Outliers").count() == 1


def test_histogram_of_constant_and_outlier_sample(spark):
    df = spark.createDataFrame([(5.0, float(i if i < 30 else 1000 + i), i) for i in range(45)], "c double, x double, k int")
    s = table_stats(df)
    bins = {(r["column_name"], r["bin"]): r["bin_count"] for r in eda.histograms(df, s, ["c", "x"]).collect()}
    assert bins["c", 5] == 45 and sum(v for (n, _), v in bins.items() if n == "x") == 45
    skewed = spark.createDataFrame([(float(i % 5), i) for i in range(100)] + [(900.0 + i, 1000 + i) for i in range(15)], "x double, k int")
    box = eda.boxplots(skewed, table_stats(skewed), ["x"], ["k"]).first()
    assert box["outliers_sample"] == [900.0 + i for i in range(10)]


def _pairs(df):
    return [tuple(r) for r in correlation.correlations(df, table_stats(df)).orderBy("position_1", "position_2").collect()]


@pytest.mark.parametrize("holes", [False, True])
def test_correlations_in_tiles(spark, monkeypatch, holes):
    monkeypatch.setattr(correlation, "TILE", 7)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 20)) @ rng.normal(size=(20, 20)) + 1e6
    if holes:
        x[rng.random(x.shape) < 0.2] = np.nan
    df = spark.createDataFrame([tuple(float(v) for v in row) for row in x], [f"c{n}" for n in range(20)]).repartition(6)
    want = pd.DataFrame(x).corr().to_numpy()
    got = _pairs(df)
    assert len(got) == 190 and all(r == pytest.approx(want[i, j], abs=1e-9) for i, _, j, _, r in got)


def test_correlations_with_and_without_missing_values(spark):
    df = spark.range(400).selectExpr(
        "if(id % 5 = 0, null, id * 1.0) as a", "if(id % 7 = 0, null, cast(id * id % 31 as double)) as b",
        "cast(id % 11 as double) as c", "cast(id % 2 as double) + id / 500 as e").repartition(5)
    want = df.toPandas().astype(float).corr()
    got = _pairs(df)
    assert len(got) == 6 and all(r == pytest.approx(want.loc[x, y], abs=1e-10) for _, x, _, y, r in got)
    full = df.select("c", "e")
    assert _pairs(full)[0][4] == pytest.approx(want.loc["c", "e"], abs=1e-10)
    # An infinite value leaves a pair without correlation, whatever the number of columns.
    infinite = full.unionByName(spark.sql("select double('infinity') as c, 1.0D as e"))
    assert _pairs(infinite)[0][4] is None
    # A pair whose complete rows are constant has no correlation and raises nothing.
    gap = spark.createDataFrame([(1.0, 5.0), (1.0, 6.0), (2.0, None)], "x double, y double")
    assert _pairs(gap)[0][4] is None
