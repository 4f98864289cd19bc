import math
import random

import numpy as np
import pandas as pd
import pytest

from tabsmith.functions import quantiles as q
from tabsmith.functions.expr import as_double
from tabsmith.operators import profile, stats
from tabsmith.operators.stats import duplicate_row_count, table_stats


def test_profile_values(spark):
    rows = [(float(10 * i), "ab"[i % 2], 7, None) for i in range(1, 11)]
    df = spark.createDataFrame(rows, "num double, cat string, const int, empty_col string")
    s = table_stats(df)
    assert (s["num"].min, s["num"].max) == (10.0, 100.0)
    p = {r["column_name"]: r for r in profile.column_profiles(s, spark).collect()}
    assert p["const"]["data_quality_flags"] == ["constant/near-constant"]
    assert p["empty_col"]["data_quality_flags"][0] == "completely missing"
    assert p["empty_col"]["data_quality_flags"][-1] == "constant/near-constant"
    assert p["cat"]["data_quality_flags"] == ["low cardinality"]
    assert p["num"]["inferred_type"] == "numeric" and p["cat"]["inferred_type"] == "categorical/text"


def test_matches_pandas_on_nulls_nans_and_constants(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"x": rng.exponential(3, 400), "y": rng.normal(size=400), "c": 4.0})
    pdf.loc[::7, "x"] = np.nan
    df = spark.createDataFrame(pdf)
    s = table_stats(df)
    for name in pdf:
        col = pdf[name]
        got = s[name]
        assert got.missing_count == col.isna().sum()
        assert got.unique_count == col.nunique()
        for ours, theirs in ((got.mean, col.mean()), (got.std, col.std()), (got.skewness, col.skew()), (got.q1, col.quantile(0.25)),
                             (got.median, col.median()), (got.q3, col.quantile(0.75))):
            assert ours == pytest.approx(theirs, abs=1e-9)
        low, high = got.fences
        assert got.outlier_count == ((col < low) | (col > high)).sum()


def test_adjusted_skewness_and_small_inputs(spark):
    df = spark.createDataFrame([(float(v), 1.0, 2.0) for v in (1, 2, 2, 3, 3, 3, 4, 4, 100)], "a double, b double, c double")
    assert table_stats(df)["a"].skewness == pytest.approx(pd.Series([1, 2, 2, 3, 3, 3, 4, 4, 100]).skew())
    two = table_stats(spark.createDataFrame([(1.0,), (9.0,)], "a double"))["a"]
    assert two.skewness == 0.0 and two.q1 == 3.0
    one = table_stats(spark.createDataFrame([(1.0,)], "a double"))["a"]
    assert one.std == 0.0 and one.variance == 0.0


@pytest.mark.parametrize("kind", ["uniform", "ties", "heavy", "hot", "infinite"])
def test_rank_selection_is_exact(spark, kind):
    rnd = random.Random(3)
    values = {
        "uniform": [rnd.random() for _ in range(3000)],
        "ties": [float(rnd.randrange(5)) for _ in range(3000)],
        "heavy": [10 ** rnd.uniform(-30, 30) for _ in range(3000)],
        "hot": [0.5] * 1500 + [rnd.random() for _ in range(1500)],
        "infinite": [float("-inf"), float("inf")] + [rnd.gauss(0, 1) for _ in range(2000)],
    }[kind]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    ranks = sorted({0, 1, len(values) // 3, len(values) // 2, len(values) - 2, len(values) - 1})
    got = q.select_ranks(df, [as_double("x")], [len(values)], [ranks], sort_limit=20)[0]
    ordered = sorted(values)
    assert got == {r: ordered[r] for r in ranks}


@pytest.mark.parametrize("limit", [0, 1_000_000])
def test_duplicates_with_nulls_and_hash_equal_rows(spark, monkeypatch, limit):
    monkeypatch.setattr(stats, "SUSPECT_ROWS", limit)
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (2, None), (3, "c")], "a int, b string")
    assert duplicate_row_count(df).first()[0] == 2
    # NULL positions do not change the row hash, so these rows collide but differ.
    near = spark.createDataFrame([(None, 5), (5, None), (5, 5)], "a int, b int")
    assert duplicate_row_count(near).first()[0] == 0
    hot = spark.range(300).selectExpr("1 as k", "array(1, 2) as v")
    assert duplicate_row_count(hot).first()[0] == 299


@pytest.mark.parametrize("limit", [0, 200_000])
def test_long_text_is_counted_by_digest(spark, monkeypatch, limit):
    monkeypatch.setattr(stats, "BROADCAST_ROWS", limit)
    texts = ["x" * 200 + str(i % 7) for i in range(20)] + ["y" * 300, "b" * 300, "b" * 300, "b" * 300]
    df = spark.createDataFrame([(t, t + str(i)) for i, t in enumerate(texts)], "a string, u string")
    s = table_stats(df)
    assert s["a"].unique_count == 9 and s["a"].top_count == 3
    assert s["a"].top_value == min(t for t in set(texts) if texts.count(t) == 3)
    assert s["u"].unique_count == 24 and s["u"].top_value == min(t + str(i) for i, t in enumerate(texts))


def test_nested_columns_and_booleans(spark):
    df = spark.createDataFrame([([1, 2], True), ([1, 2], False), (None, True)], "v array<int>, b boolean")
    s = table_stats(df)
    assert (s["v"].unique_count, s["v"].missing_count, s["v"].nested) == (1, 1, True)
    assert s["b"].data_type == "categorical/text" and s["b"].top_value == "true"


def test_summary_score_and_semantic_types(spark):
    df = spark.createDataFrame([(1, "a", "2020"), (1, "a", "2020"), (2, None, "2021"), (3, "c", "2022"), (3, "c", "2022")],
                               "order_id int, b string, ship_date string")
    summary = profile.dataset_summary(df)
    row = summary.first()
    assert (row["num_rows"], row["num_cols"], row["duplicate_row_count"], row["missing_value_count"]) == (5, 3, 2, 1)
    kinds = {r["kind"]: r["columns"] for r in profile.semantic_types(df).collect()}
    assert kinds == {"categorical": 1, "date": 1, "identifier": 1}
    profiles = profile.column_profiles(table_stats(df), spark)
    score = profile.quality_score(summary, profiles, profile.target_profile(df, "b")).first()
    # 6.67 % missing -> 17, repeats -> 10, smallest class 25 % -> 5
    assert score["quality_score"] == 68 and score["verdict"] == "moderate"
    assert profile.filter_profiles(profiles, "id", "numeric").count() == 1


def test_same_result_for_any_partitioning(spark):
    df = spark.range(500).selectExpr("id % 17 as a", "cast(sqrt(id) as double) as b", "cast(id % 3 as string) as c")
    one, many = table_stats(df.coalesce(1)), table_stats(df.repartition(7))
    for x, y in zip(one.columns, many.columns):
        assert (x.unique_count, x.q1, x.q3, x.top_value, x.outlier_count) == (y.unique_count, y.q1, y.q3, y.top_value, y.outlier_count)
        assert x.mean is None or math.isclose(x.mean, y.mean, rel_tol=1e-12)


def test_many_columns_are_split_into_passes(spark, monkeypatch):
    monkeypatch.setattr(stats, "COLUMNS_PER_PASS", 2)
    df = spark.range(50).selectExpr(*[f"id * {i} as c{i}" for i in range(1, 6)], "'k' as t", "'l' as u", "'m' as v")
    s = table_stats(df)
    assert [c.max for c in s.numeric] == [49.0 * i for i in range(1, 6)]
    assert all(c.unique_count == 1 for c in s.categorical)
