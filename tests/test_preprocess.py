import math

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from tabsmith.functions import joins
from tabsmith.operators.compare import Comparison
from tabsmith.operators.preprocess import FeatureStandardizer, FiniteGuard, HybridPreprocessor, HybridPreprocessorModel, PlainPreprocessor, require_numeric, vector_scaler


def fit(spark, values, ddl, **kw):
    df = spark.createDataFrame(values, ddl)
    return df, HybridPreprocessor(**kw).fit(df)


def test_mean_and_median_imputation(spark):
    low = [10.0, 11.0, 9.0, 10.0, 12.0, 8.0, 10.0, None]
    high = [1.0, 2.0, 2.0, 3.0, 3.0, 4.0, 1000.0, None]
    _, m = fit(spark, list(zip(low, high)), "num double, skewed double")
    f = {x["name"]: x for x in m.fitted["numeric"]}
    assert f["num"]["method"] == "mean_imputation" and f["num"]["fill"] == pytest.approx(10.0)
    assert f["skewed"]["method"] == "median_imputation" and f["skewed"]["fill"] == 3.0


def test_scaler_choice_and_log(spark):
    df, m = fit(spark, [(float(v),) for v in (1, 2, 3, 4, 5, 6, 7, 8, 9, 500)], "vals double")
    f = m.fitted["numeric"][0]
    assert f["log"] and f["scaler"] == "RobustScaler"
    logs = sorted(math.log1p(v) for v in (1, 2, 3, 4, 5, 6, 7, 8, 9, 500))
    assert f["center"] == pytest.approx((logs[4] + logs[5]) / 2)
    got = [r[0] for r in m.transform(df).collect()]
    assert max(got) == pytest.approx((math.log1p(500) - f["center"]) / f["scale"])
    _, even = fit(spark, [(i,) for i in range(100)], "vals int")
    g = even.fitted["numeric"][0]
    assert g["scaler"] == "StandardScaler" and g["scale"] == pytest.approx((sum((i - 49.5) ** 2 for i in range(100)) / 100) ** 0.5)
    _, neg = fit(spark, [(float(v),) for v in (-50, 1, 1, 2, 2, 2, 3, 900)], "vals double")
    assert not neg.fitted["numeric"][0]["log"]


def test_one_hot_ordinal_and_unseen(spark):
    rows = [("ABC"[i % 3], f"v{i % 20:02d}") for i in range(60)]
    df, m = fit(spark, rows, "cat string, wide string")
    assert m.feature_names == ["cat_A", "cat_B", "cat_C", "wide_ordinal"]
    test = spark.createDataFrame([("A", "v05"), ("Z", "nope"), (None, None)], "cat string, wide string")
    got = [tuple(r) for r in m.transform(test).collect()]
    assert sorted(got) == sorted([(1.0, 0.0, 0.0, 5.0), (0.0, 0.0, 0.0, -1.0), (1.0, 0.0, 0.0, 0.0)])


def test_fit_uses_train_only_and_aligns_schema(spark):
    train, m = fit(spark, [(10.0, "a", 1), (10.0, "b", 2), (12.0, "a", 3), (8.0, "b", 4), (10.0, "a", 5)], "num double, t string, extra int")
    before = m.fitted
    test = spark.createDataFrame([(None,), (1e9,), (float("nan"),)], "num double")
    out = m.transform(test).collect()
    assert m.fitted == before and out[0]["num"] == out[2]["num"] == 0.0
    assert [f for f in out[0].asDict()] == m.feature_names
    assert out[0]["t_a"] == 0.0 and out[0]["t_b"] == 0.0
    cleaned = m.transform_cleaned(test).columns
    assert cleaned == ["num", "extra", "t"] or cleaned == ["num", "t", "extra"]


def test_cleaned_keeps_scale_and_drops_unusable(spark):
    rows = [(10.0, "a", 0, "x"), (None, None, 1, "y"), (1000.0, "a", 0, "x"), (12.0, "b", 1, "z")]
    df, m = fit(spark, rows, "col_num double, col_cat string, Late_delivery_risk int, `Delivery Status` string",
                inputCols=["col_num", "col_cat", "Delivery Status"])
    out = m.transform_cleaned(df)
    assert out.columns == ["col_num", "col_cat", "Late_delivery_risk"]
    got = out.collect()
    assert {10.0, 1000.0} <= {r["col_num"] for r in got} and all(r["col_num"] is not None and r["col_cat"] for r in got)
    again = m.transform_cleaned(out.withColumn("Delivery Status", out.col_cat)).drop("Delivery Status")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got))


def test_save_and_load(spark, tmp_path):
    df, m = fit(spark, [(float(i), f"k{i % 30:02d}", "ab"[i % 2]) for i in range(90)], "x double, wide string, two string")
    scaler = FeatureStandardizer(inputCols=m.feature_names).fit(m.transform(df))
    path = str(tmp_path / "chain")
    PipelineModel([m, FiniteGuard(inputCols=m.feature_names), scaler]).save(path)
    back = PipelineModel.load(path)
    assert isinstance(back.stages[0], HybridPreprocessorModel)
    want = scaler.transform(m.transform(df)).collect()
    assert sorted(map(tuple, back.transform(df).collect())) == sorted(map(tuple, want))


def test_plain_ordinal_and_capped_one_hot(spark):
    rows = [(1.0 if i else None, f"c{min(i, 16):02d}" if i < 40 else None) for i in range(45)]
    df = spark.createDataFrame(rows, "x double, t string")
    m = PlainPreprocessor(encoding="ordinal").fit(df)
    assert m.feature_names == ["x", "t"]
    codes = {r["t"] for r in m.transform(df).collect()}
    assert codes == {float(i) for i in range(18)}
    b = PlainPreprocessor(encoding="onehot").fit(df)
    assert len(b.feature_names) == 1 + 15 and b.feature_names[-1] == "t_infrequent_sklearn"
    new = spark.createDataFrame([(1.0, "c14"), (1.0, "never"), (1.0, "c16")], "x double, t string")
    got = [(r["t_infrequent_sklearn"], r["t_c16"]) for r in b.transform(new).collect()]
    assert sorted(got) == [(0.0, 0.0), (0.0, 1.0), (1.0, 0.0)]


def test_large_dictionary_paths_equal_small_ones(spark, monkeypatch):
    df = spark.range(3000).selectExpr("if(id % 3 = 0, 'hot', concat('v', id % 700)) as t", "id % 2 as y")
    small = HybridPreprocessor(inputCols=["t"]).fit(df)
    want = sorted(r["t_ordinal"] for r in small.transform(df).collect())
    monkeypatch.setattr(joins, "WINDOW_ROWS", 10)
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 10)
    large = HybridPreprocessor(inputCols=["t"]).fit(df)
    assert large.fitted["ordinal"][0]["hot"] == ["hot"]
    out = large.transform(df)
    assert out.count() == 3000 and sorted(r["t_ordinal"] for r in out.collect()) == want


def test_finite_guard(spark):
    odd = [float("nan"), float("inf"), float("-inf"), None, -1.5]
    df = spark.createDataFrame([(v, "k") for v in odd], "x double, key string")
    out = FiniteGuard(inputCols=["x", "absent"]).transform(df)
    assert [r["x"] for r in out.collect()] == [0.0, 0.0, 0.0, 0.0, -1.5] and out.columns == ["key", "x", "absent"]


def test_numeric_check(spark):
    df = spark.createDataFrame([(1, "a")], "x int, bad string")
    with pytest.raises(ValueError, match="bad"):
        require_numeric(df, ["x", "bad"])


def test_trace_shows_planned_and_applied(spark):
    # Raw: 2 of 100 rows beyond the fences is within 2 %; of the 60 filled ones it is not.
    df, m = fit(spark, [(float(i),) for i in range(1, 30)] + [(5000.0,)], "x double")
    t = {r["stage"]: r for r in m.trace(spark).collect()}
    assert t["log_transformation"]["applied_action"] == "log1p_transformation"
    assert t["scaling"]["planned_action"] == "RobustScaler"
    assert m.metadata(spark).first()["log1p_applied"]


def test_comparison(spark):
    raw = spark.createDataFrame([(10.0, "a"), (None, None), (1000.0, "a"), (11.0, "b"), (12.0, "b"), (11.0, "b")], "n double, c string")
    clean = HybridPreprocessor().fit(raw).transform_cleaned(raw)
    c = Comparison(raw, clean)
    o = {r["side"]: r for r in c.overall().collect()}
    assert (o["before"]["missing_values"], o["after"]["missing_values"], o["after"]["missing_resolved_pct"]) == (2, 0, 100.0)
    assert sum(r["before_count"] for r in c.histograms().collect()) == 5 and sum(r["after_count"] for r in c.histograms().collect()) == 6
    cats = {r["category"]: (r["before_count"], r["after_count"]) for r in c.categories().collect()}
    assert cats == {"b": (3, 4), "a": (2, 2), "(Missing)": (1, 0)}


def test_comparison_in_the_same_passes(spark):
    long = ["p" * 70 + c for c in "badc"]
    rows = [(10.0, "7", long[0], 1), (None, "x", long[1], 2), (1000.0, None, long[1], None), (11.0, "9", None, 4), (float("nan"), "7", long[2], 5), (12.0, "8", long[3], 6)]
    raw = spark.createDataFrame(rows, "n double, `t.x` string, c string, gone int")
    model = HybridPreprocessor(inputCols=["n", "c"]).fit(raw.select("n", "c"))
    # A text column that becomes a number, and one that is dropped.
    exprs = model.cleaned_columns(raw) | {"t.x": F.coalesce(F.col("`t.x`").try_cast("double"), F.lit(0.0))}
    del exprs["gone"]
    clean = raw.select(*[e.alias(c) for c, e in exprs.items()])
    two, one = Comparison(raw, clean), Comparison(raw, clean, cleaned=exprs)
    assert len(two.frames) == 2 and len(one.frames) == 1
    reports = ("overall", "numeric_columns", "histograms", "category_columns", "categories")
    for report in reports:
        a, b = (sorted(getattr(c, report)().collect(), key=str) for c in (two, one))
        assert a == b and a, report
    before, after = sorted(one.overall().collect(), key=lambda r: r["side"], reverse=True)
    assert (before["missing_values"], after["missing_values"], before["num_columns"], after["num_columns"]) == (5, 0, 4, 3)
    cats = [tuple(r)[2:] for r in sorted(one.categories().collect(), key=lambda r: r["rank"])]
    # Equal counts: the smaller text first, though all share their first characters but one.
    assert cats == [(long[1], 2, 3), ("(Missing)", 1, 0), (long[0], 1, 1), (long[3], 1, 1), (long[2], 1, 1)]
    assert [r["category"] for r in one.categories(top=3).orderBy("rank").collect()] == [long[1], "(Missing)", long[0]]


def by_label(model, df, vector="v", keep="k"):
    """{key: {label: value}} of a vector column, by the names in its ML attributes."""
    names = {a["idx"]: a["name"] for a in df.schema[vector].metadata["ml_attr"]["attrs"]["numeric"]}
    assert [names[i] for i in range(len(names))] == getattr(model, "vector_labels", model.feature_labels)
    return {r[keep]: {names[i]: x for i, x in enumerate(r[vector].toArray())} for r in df.collect()}


HARD_ROWS = [(i, float(i % 7) if i % 5 else None, ["a.b", "a`b", "", "1\x1fa", None][i % 5], f"w{i % 40:02d}", "xyz"[i % 3]) for i in range(120)]
HARD_SCHEMA = "k int, x double, t string, wide string, u string"


def test_vector_holds_the_same_features_as_columns(spark):
    df = spark.createDataFrame(HARD_ROWS, HARD_SCHEMA)
    fresh = spark.createDataFrame([(1000, None, None, "none such", "x"), (1001, 3.0, "a.b", None, "new"), (1002, float("inf"), "0\x1f", "w03", "")], HARD_SCHEMA)
    inputs = ["x", "t", "wide", "u"]
    pairs = [(HybridPreprocessor(inputCols=inputs).fit(df), HybridPreprocessor(inputCols=inputs, vectorCol="v").fit(df))]
    for encoding, cap in (("onehot", 15), ("onehot", 4), ("onehot", 2), ("ordinal", 15)):
        pairs.append(tuple(PlainPreprocessor(inputCols=inputs, encoding=encoding, maxCategories=cap, **v).fit(df) for v in ({}, {"vectorCol": "v"})))
    for plain, vector in pairs:
        for rows in (df, fresh):
            out = vector.transform(rows)
            assert out.columns == ["k", "v"]
            got = by_label(vector, out)
            for r in plain.transform(rows).collect():
                want = {label: r[name] for name, label in zip(plain.feature_names, plain.feature_labels)}
                assert got[r["k"]] == pytest.approx(want)
        assert vector.transform(df.limit(0)).count() == 0
    gone = pairs[0][1].transform(fresh.drop("t", "x"))
    assert by_label(pairs[0][1], gone)[1000]["t_a.b"] == 0.0


def test_vectors_are_sparse_scaled_and_saved(spark, tmp_path):
    from pyspark.ml.linalg import SparseVector

    rows = [(i, *[f"c{i * (j % 10 + 1) % 11}" for j in range(30)]) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, " + ", ".join(f"t{j} string" for j in range(30)))
    m = HybridPreprocessor(inputCols=df.columns[1:], vectorCol="v").fit(df)
    out = m.transform(df)
    first = out.first()["v"]
    assert isinstance(first, SparseVector) and first.size == 330 and first.numNonzeros() == 30
    scaled = vector_scaler(out, "v", "s").transform(out)
    assert isinstance(scaled.first()["s"], SparseVector)
    values = np.array([r["s"].toArray() for r in scaled.collect()])
    assert np.allclose(values.std(axis=0), 1.0)
    m.write().overwrite().save(str(tmp_path / "m"))
    again = type(m).load(str(tmp_path / "m"))
    assert again.transform(df).collect() == out.collect()


def test_learner_finds_the_same_coefficients_on_sparse_vectors(spark):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    df = spark.createDataFrame(HARD_ROWS, HARD_SCHEMA).withColumn("y", F.expr("cast((k * 7 + k % 3 * 20) % 50 > 22 as double)"))
    learner = LogisticRegression(featuresCol="f", labelCol="y", regParam=0.01, standardization=False, tol=1e-12, maxIter=500)
    plain = PlainPreprocessor(inputCols=["x", "t", "u"], encoding="onehot").fit(df)
    names = plain.feature_names
    dense = FeatureStandardizer(inputCols=names).fit(plain.transform(df)).transform(plain.transform(df))
    want = learner.fit(VectorAssembler(inputCols=names, outputCol="f").transform(dense)).coefficients.toArray()
    vectors = PlainPreprocessor(inputCols=["x", "t", "u"], encoding="onehot", vectorCol="v").fit(df).transform(df)
    got = learner.fit(vector_scaler(vectors, "v", "f").transform(vectors)).coefficients.toArray()
    assert np.allclose(got, want, atol=1e-5)
