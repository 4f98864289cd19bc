import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsmith.functions.fdist import f_upper_tail
from tabsmith.operators import correlation
from tabsmith.operators.ratios import RatioFeatures
from tabsmith.operators.selection import FeatureSelector, anova_f


def spec(name, num, den, risk=False):
    return {"name": name, "numerator_col": num, "denominator_col": den, "leakage_risk": risk}


def verdict(df, s, **kw):
    return RatioFeatures(specs=[s], **kw).fit(df).fitted["report"][0]["rule_id"]


def test_safe_ratio(spark):
    df = spark.createDataFrame([(10.0, 100.0), (5.0, 0.0), (30.0, 50.0), (8.0, None), (None, 4.0)], "num_profit double, num_revenue double")
    m = RatioFeatures(specs=[spec("r", "num_profit", "num_revenue")]).fit(df)
    assert [r["r"] for r in m.transform(df).collect()] == [0.1, 0.0, 0.6, 0.0, None]
    assert m.report(df.sparkSession).first()["status"] == "accepted"


def test_reject_rules(spark):
    df = spark.range(100).selectExpr(
        "cast(id as double) as a", "cast(id % 7 + 1 as double) as b", "'t' as text", "0.0 as zero", "if(id < 80, null, id * 1.0) as holes",
        "cast(1 as double) as one", "id % 2 as y")
    cases = {
        "RULE_FE_EXPLICIT_LEAKAGE": (spec("r", "a", "b", True), {}),
        "RULE_FE_TARGET_LEAKAGE": (spec("r", "a", "Y "), {"targetCol": "y"}),
        "RULE_FE_SOURCE_LEAKAGE": (spec("r", "a", "b"), {"leakageColumns": ["B"]}),
        "RULE_FE_MISSING_NUMERATOR": (spec("r", "q", "b"), {}),
        "RULE_FE_MISSING_DENOMINATOR": (spec("r", "a", "q"), {}),
        "RULE_FE_NON_NUMERIC_NUMERATOR": (spec("r", "text", "b"), {}),
        "RULE_FE_NON_NUMERIC_DENOMINATOR": (spec("r", "a", "text"), {}),
        "RULE_FE_NAME_COLLISION": (spec("one", "a", "b"), {}),
        "RULE_FE_INVALID_DENOMINATOR": (spec("r", "a", "zero"), {}),
        "RULE_FE_EXCESSIVE_MISSINGNESS": (spec("r", "holes", "b"), {}),
        "RULE_FE_NEAR_ZERO_VARIANCE": (spec("r", "one", "one"), {}),
        "RULE_FE_COLLINEAR_REDUNDANCY": (spec("r", "a", "one"), {}),
        "RULE_FE_ACCEPTED_VALID_SIGNAL": (spec("r", "a", "b"), {}),
    }
    for rule, (s, kw) in cases.items():
        assert verdict(df, s, **kw) == rule


def test_selector_stages(spark):
    df = spark.range(300).selectExpr(
        "sin(id) as low", "sin(id) * 5 as high", "cast(id % 2 as double) + rand(3) * 0.1 as informative", "rand(8) as noise",
        "3.0 as constant", "id % 2 as y")
    m = FeatureSelector(targetCol="y", pValueThreshold=0.01).fit(df)
    rules = {r["feature"]: r["rule_id"] for r in m.trace(spark).collect()}
    assert rules["constant"] == "RULE_FS_LOW_VARIANCE_FILTER" and rules["low"] == "RULE_FS_HIGH_CORRELATION_PRUNE"
    assert rules["informative"] == "RULE_FS_FEATURE_RETAINED" and rules["noise"] == "RULE_FS_STATISTICAL_RELEVANCE_FILTER"
    assert "informative" in m.selected
    out = m.transform(df.drop("informative"))
    assert out.columns == ["y", *m.selected] and out.agg(F.max("informative")).first()[0] == 0.0
    assert m.counts(spark).first()["removed_low_variance_count"] == 1
    assert m.relevance(spark).orderBy("rank").first()["feature"] == "informative"


def test_pruning_order_of_many_columns(spark, monkeypatch):
    monkeypatch.setattr(correlation, "TILE", 16)
    rng = np.random.default_rng(9)
    base = rng.normal(size=(120, 12))
    x = np.column_stack([base[:, n % 12] * (1 + n % 5) + 0.25 * rng.normal(size=120) * (n % 4) for n in range(60)])
    names = [f"f{n}" for n in range(60)]
    model = FeatureSelector().fit(spark.createDataFrame([tuple(map(float, r)) for r in x], names).repartition(5))
    r, var, gone = np.abs(np.corrcoef(x.T)), x.var(0), []
    for i in range(60):
        for j in range(i + 1, 60):
            if i in gone:
                break
            if j not in gone and r[i, j] > 0.95:
                gone.append(i if var[i] <= var[j] else j)
    assert len(gone) > 20 and model.selected == [f for n, f in enumerate(names) if n not in gone]
    removed = [y["feature"] for y in model.fitted["removed"] if y["rule_id"] == "RULE_FS_HIGH_CORRELATION_PRUNE"]
    assert removed == [names[n] for n in gone]


def test_selector_keeps_at_least_one(spark):
    df = spark.range(200).selectExpr("rand(1) as a", "rand(2) as b", "cast(rand(5) > 0.5 as int) as y")
    assert len(FeatureSelector(targetCol="y", pValueThreshold=1e-9).fit(df).selected) == 1


def test_train_only_constant(spark):
    train = spark.range(200).selectExpr("rand(1) as feat_a", "rand(2) as feat_b", "1.0 as feat_const_tr")
    m = FeatureSelector().fit(train)
    test = spark.range(50).selectExpr("rand(3) as feat_a", "rand(4) as feat_b", "rand(5) as feat_const_tr")
    assert m.transform(test).columns == ["feat_a", "feat_b"]


def test_f_distribution_tail(spark):
    dist = spark._jvm.org.apache.commons.math3.distribution.FDistribution
    for f in (0.01, 0.5, 1.0, 2.5, 4.0, 30.0):
        for d1, d2 in ((1, 10), (3, 40), (2, 5000), (20, 7), (4, 10**7)):
            want = 1.0 - dist(float(d1), float(d2)).cumulativeProbability(f)
            assert f_upper_tail(f, d1, d2) == pytest.approx(want, abs=1e-9)
    assert f_upper_tail(0.0, 2, 5) == 1.0
    # With endless rows 4 F is chi-squared with 4 degrees of freedom.
    for f in (0.5, 1.0, 3.0, 8.0):
        assert f_upper_tail(f, 4, 1e12) == pytest.approx(math.exp(-2 * f) * (1 + 2 * f), rel=1e-9)


def test_anova_against_jvm_and_hot_class(spark):
    df = spark.range(600).selectExpr("if(id % 3 < 2, 0, id % 5) as y", "cast(id % 13 as double) + if(id % 3 < 2, 0, 1) as x")
    from pyspark.ml.feature import VectorAssembler

    v = VectorAssembler(inputCols=["x"], outputCol="v").transform(df.selectExpr("cast(y as double) y", "x"))
    row = spark._jvm.org.apache.spark.ml.stat.ANOVATest.test(v._jdf, "v", "y").first()
    f, p = anova_f(df, ["x"], "y")["x"]
    assert f == pytest.approx(row.getAs("fValues").toArray()[0], rel=1e-9)
    assert p == pytest.approx(row.getAs("pValues").toArray()[0], rel=1e-9)
