import pytest

from tabsmith.operators import autoconfig as ac
from tabsmith.plans import names


def leaks(df, target=None):
    return {r["column_name"]: r["type"] for r in ac.detect_leakage(df, target).collect()}


def test_numeric_table(spark):
    df = spark.range(200).selectExpr("rand(1) as feature_1", "rand(2) as feature_2", "rand(3) as feature_3", "cast(rand(4) > 0.5 as int) as target_class")
    c = ac.auto_config(df)
    assert c.target.column == "target_class" and c.target.confidence_level == "High" and c.pipeline_ready
    assert c.numeric_columns == ["feature_1", "feature_2", "feature_3"]


def test_mixed_table(spark):
    df = spark.range(300).selectExpr(
        "cast(20 + rand(1) * 50 as int) as age", "rand(2) * 1000 as income", "element_at(array('HR', 'IT', 'Ops'), cast(1 + rand(3) * 3 as int)) as department",
        "element_at(array('low', 'mid', 'top'), cast(1 + rand(5) * 3 as int)) as rating_level", "cast(rand(4) > 0.7 as int) as churn_label")
    assert ac.detect_target(df).column == "churn_label"


def test_leakage_kinds(spark):
    df = spark.range(200).selectExpr(
        "rand(1) as normal_metric", "cast(null as double) as empty_column", "id % 2 + rand(2) * 0.001 as leakage_perfect_proxy",
        "if(id % 2 = 1, 'yes', 'no') as actual_outcome_status", "rand(7) as post_score", "rand(6) as `Days for shipping (real)`", "id % 2 as is_approved")
    assert leaks(df, "is_approved") == {
        "empty_column": "all_missing", "leakage_perfect_proxy": "high_correlation", "actual_outcome_status": "categorical_proxy",
        "post_score": "post_event_semantic", "Days for shipping (real)": "domain_knowledge"}
    assert set(leaks(df)) == {"empty_column", "Days for shipping (real)"}
    assert ac.known_leakage(df).first()["column_name"] == "Days for shipping (real)"


def test_no_target(spark):
    df = spark.range(100).selectExpr("rand(1) as measurement_1", "rand(2) as measurement_2", "rand(3) as measurement_3")
    choice = ac.detect_target(df)
    assert choice.column is None and choice.confidence_level == "Low"


def test_resolution(spark):
    df = spark.range(60).selectExpr("rand(1) as x", "id % 3 as State", "id % 2 as Late_delivery_risk", "'k' as one", "cast(null as string) as void")
    assert ac.resolve_target(df, " late_DELIVERY_risk ").column == "Late_delivery_risk"
    assert ac.resolve_target(df, None, "supply_chain").column == "Late_delivery_risk"
    assert ac.resolve_target(df, "auto").classification_type == "binary"
    for bad, text in (("State", "geographical"), ("nope", "not found"), ("one", "distinct class"), ("void", "missing values")):
        with pytest.raises(ValueError, match=text):
            ac.resolve_target(df, bad)


def test_name_rules():
    assert names.is_geographic("Customer City") and not names.is_geographic("customer_city")
    assert names.detect_domain(["Shipping_Mode", "Delivery Status"]) == "supply_chain" and names.detect_domain(["a"]) == "general"
    assert names.ratio_specs(["Total_Profit", "revenue"])[0]["name"] == "profit_to_revenue_ratio"
    profile = names.domain_profile("supply_chain", [])
    assert names.class_labels(profile, [0, 1, "2"]) == {0: "On-Time Delivery", 1: "Late Delivery Risk", "2": "2"}


def test_target_overview(spark):
    df = spark.range(40).selectExpr("rand(1) as x", "id % 2 as Late_Delivery_Risk", "id % 4 as level")
    table, choice = ac.target_overview(df)
    assert choice is None and {r["class_count"] for r in table.collect()} == {20}
    table, choice = ac.target_overview(df.drop("Late_Delivery_Risk"))
    assert choice.detected_column == "level" and table.count() == 4
    assert ac.target_overview(df.select("x"))[0] is None
