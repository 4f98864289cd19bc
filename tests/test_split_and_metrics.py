import random

import pytest
from pyspark.sql import functions as F

from tabsmith.operators import metrics, split


def sizes(train, test, y):
    return [{r[0]: r[1] for r in d.groupBy(y).count().collect()} for d in (train, test)]


def test_stratified_sizes_and_disjoint(spark):
    df = spark.range(1003).selectExpr("id", "if(id % 3 = 0, 'a', if(id % 7 = 0, 'b', 'c')) as y")
    train, test = split.holdout_split(df, "y", 0.2, 42, ["id"])
    assert (train.count(), test.count()) == (802, 201)
    assert train.join(test, "id").count() == 0
    counts = split.class_counts(df, "y")
    quotas = split.test_quotas(counts, 0.2)
    assert sizes(train, test, "y")[1] == quotas
    again = split.holdout_split(df.repartition(9), "y", 0.2, 42, ["id"])[1]
    assert {r[0] for r in again.collect()} == {r[0] for r in test.collect()}
    other = split.holdout_split(df, "y", 0.2, 7, ["id"])[1]
    assert {r[0] for r in other.collect()} != {r[0] for r in test.collect()}


def test_copies_of_one_row_are_split_exactly(spark):
    df = spark.range(900).selectExpr("if(id < 600, 0, id) as v", "if(id < 600, 'hot', 'rest') as y")
    train, test = split.holdout_split(df, "y")
    assert sizes(train, test, "y") == [{"hot": 480, "rest": 240}, {"hot": 120, "rest": 60}]


def test_split_is_a_filter(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    plan = split.holdout_split(df, "o_orderstatus", key=["o_orderkey"])[0]._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan


def test_rare_and_missing_classes(spark):
    rows = [(i, "a" if i < 50 else "b") for i in range(99)] + [(100, "c")] + [(200 + i, None) for i in range(5)]
    df = split.drop_missing_target(spark.createDataFrame(rows, "id int, y string"), "y")
    assert df.count() == 100
    with pytest.raises(ValueError, match="rare classes"):
        split.holdout_split(df, "y")
    train, test = split.holdout_split(df, "y", on_rare_class="unstratified")
    assert (train.count(), test.count()) == (80, 20)
    with pytest.raises(ValueError, match="at least 2"):
        split.holdout_split(df.filter("y = 'a'"), "y")
    with pytest.raises(ValueError, match="No predictor"):
        split.predictors(df, "y", ["id"])


def test_continuous_target_is_refused(spark, monkeypatch):
    monkeypatch.setattr(split, "MAX_CLASSES", 50)
    with pytest.raises(ValueError, match="no classes"):
        split.class_counts(spark.range(100), "id")


def brute_auc(pairs):
    pos = [s for t, s in pairs if t]
    neg = [s for t, s in pairs if not t]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("steps", [3, 40, 100000])
def test_auc_against_brute_force(spark, steps):
    rnd = random.Random(steps)
    pairs = [(rnd.random() < 0.3, rnd.randrange(steps) / steps) for _ in range(400)] + [(True, 0.5)] * 100
    df = spark.createDataFrame([(int(t), s) for t, s in pairs], "y int, s double")
    got = metrics.roc_auc_by_class(df, "y", {1: F.col("s")}).first()["auc"]
    assert got == pytest.approx(brute_auc(pairs), abs=1e-12)


def test_auc_undefined_for_one_class(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.4)], "y int, s double")
    m = metrics.classification_metrics(df.withColumn("p", F.lit(1)), "y", "p", {0: 1 - F.col("s"), 1: F.col("s")}, [0, 1]).first()
    assert m["roc_auc"] is None and m["roc_auc_note"]


def test_metrics_values(spark):
    rows = [("a", "a")] * 5 + [("a", "b")] * 2 + [("b", "b")] * 3 + [("c", "a")]
    df = spark.createDataFrame(rows, "t string, p string")
    rep = {r["label"]: r for r in metrics.full_class_report(metrics.confusion_counts(df, "t", "p")).collect()}
    assert rep["a"]["precision"] == 0.8333 and rep["a"]["recall"] == 0.7143 and rep["c"]["f1"] == 0.0
    assert rep["accuracy"]["f1"] == 0.7273 and rep["macro avg"]["recall"] == 0.5714
    grid = {(r[0], r[1]): r[2] for r in metrics.confusion_matrix(df, "t", "p", ["a", "b", "c"]).collect()}
    assert grid["b", "c"] == 0 and grid["c", "a"] == 1 and len(grid) == 9


def test_confusion_of_many_labels(spark):
    df = spark.createDataFrame([("a7", "a7"), ("a7", "a299"), ("a0", "zz"), (None, "a1")], "t string, p string")
    grid = metrics.confusion_matrix(df, "t", "p", [f"a{i}" for i in range(300)])
    assert grid.count() == 90_000 and grid.select("truth", "predicted").distinct().count() == 90_000
    assert sorted(tuple(r) for r in grid.filter("cnt > 0").collect()) == [("a7", "a299", 1), ("a7", "a7", 1)]
    assert metrics.confusion_matrix(df, "t", "p", []).count() == 0


def test_many_classes_with_copies_are_split_exactly(spark):
    """More classes than the filter holds; one of them is mostly copies of one row, one is nothing else, one is missing."""
    rows = spark.range(9000).selectExpr(
        "case when id < 4000 then 0 when id < 5000 then -1 when id < 5003 then null else id end as v",
        "case when id < 4100 then 'hot' when id < 5000 then 'same' when id < 5030 then null else concat('c', id % 60) end as y",
    )
    train, test = split.holdout_split(rows, "y")
    counts = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    quotas = split.test_quotas(dict(sorted(counts.items(), key=lambda kv: (kv[0] is None, kv[0] or ""))), 0.2)
    assert sizes(train, test, "y")[1] == quotas
    assert train.unionAll(test).exceptAll(rows).isEmpty() and train.count() + test.count() == 9000
    again = split.holdout_split(rows.repartition(7), "y")[1]
    assert sizes(again, test, "y")[0] == quotas
    assert again.filter("v > 0").exceptAll(test.filter("v > 0")).isEmpty()


def test_ranked_values_equal_a_sort(spark):
    numbers = random.Random(5)
    of = {y: [numbers.choice([0, 7, 2**63 - 1, 2**62, numbers.randrange(2**60), numbers.randrange(9)]) for _ in range(700)] for y in ("a", "b", None)}
    rows = spark.createDataFrame([(y, v) for y, vs in of.items() for v in vs], "y string, v bigint")
    for place in (1, 2, 333, 700):
        places = spark.createDataFrame([(y, place) for y in of], "y string, place bigint")
        for r in split._ranked(rows, places).collect():
            value = sorted(of[r["y"]])[place - 1]
            assert (r["v"], r["n"]) == (value, of[r["y"]].count(value))
            assert r["place"] == place - sum(v < value for v in of[r["y"]])


@pytest.mark.parametrize("coarse, fine", [(1, 1), (2, 3), (8, 4), (1024, 64)])
def test_auc_by_cells_equals_brute_force(spark, monkeypatch, coarse, fine):
    """Many classes, ties, classes that are told apart, scores far apart, infinite and missing ones."""
    monkeypatch.setattr(metrics, "COARSE_CELLS", coarse)
    monkeypatch.setattr(metrics, "FINE_CELLS", fine)
    numbers = random.Random(11)
    draws = [lambda hit: hit + numbers.random(), lambda hit: float(numbers.randrange(4)), lambda hit: 10.0 ** numbers.randrange(-300, 300), lambda hit: numbers.choice([float("inf"), -float("inf"), 1.0, 2.0]),
             lambda hit: numbers.choice([None, numbers.random()]), lambda hit: 0.5, lambda hit: numbers.random() / 1e6 + 0.3 * hit * numbers.randrange(2)]
    rows = []
    for _ in range(400):
        y = numbers.randrange(len(draws))
        rows.append((y, *[draw(int(y == c)) for c, draw in enumerate(draws)]))
    df = spark.createDataFrame(rows, "y int, " + ", ".join(f"s{c} double" for c in range(len(draws))))
    got = {r["class_index"]: r["auc"] for r in metrics.roc_auc_by_class(df, "y", {c: F.col(f"s{c}") for c in range(len(draws))}).collect()}
    for c in range(len(draws)):
        assert got[c] == pytest.approx(brute_auc([(r[0] == c, r[c + 1]) for r in rows if r[c + 1] is not None]), abs=1e-9)


def test_classes_told_apart_leave_no_rows_to_order(spark):
    long = spark.range(20_000).selectExpr("cast(id % 5 as int) as k", "(id % 7919) / 7919.0 + if(id % 3 = 0, 2, 0) as score", "cast(id % 3 = 0 as int) as hit")
    tally = metrics.score_tally(long)
    assert tally.count() <= 5 * (metrics.COARSE_CELLS + 1)
    assert tally.agg(F.sum("pos") + F.sum("neg")).first()[0] == 20_000


def rows_of_classes(numbers, draws, n=500):
    rows = []
    for _ in range(n):
        y = numbers.choice([None, "rest", *map(str, range(len(draws)))])
        rows.append((y, *[draw(y == str(c)) for c, draw in enumerate(draws)]))
    return rows


@pytest.mark.parametrize("class_scores, block", [(1, 7), (20, 100), (4096, 64), (4096, 1_048_576)])
def test_auc_of_classes_counted_out_and_in_cells(spark, monkeypatch, class_scores, block):
    """Classes of few and of many scores in one call, with missing, NaN and infinite ones, rows of no class and of an unknown one."""
    monkeypatch.setattr(metrics, "CLASS_SCORES", class_scores)
    monkeypatch.setattr(metrics, "BLOCK_SCORES", block)
    numbers = random.Random(3)
    nan, inf = float("nan"), float("inf")
    draws = [lambda hit: float(numbers.randrange(9) + 2 * hit), lambda hit: hit + numbers.random(), lambda hit: numbers.choice([None, -0.0, 0.0, 1.5]), lambda hit: numbers.choice([nan, 1.0, numbers.random()]),
             lambda hit: numbers.choice([inf, -inf, 0.0]), lambda hit: None, lambda hit: 0.25, lambda hit: nan]
    rows = rows_of_classes(numbers, draws)
    df = spark.createDataFrame(rows, "y string, " + ", ".join(f"s{c} double" for c in range(len(draws)))).repartition(3)
    scores = {str(c): F.col(f"s{c}") for c in range(len(draws))} | {None: F.lit(1.0), "absent": F.lit(1.0)}
    got = {r["class_index"]: r["auc"] for r in metrics.roc_auc_by_class(df, "y", scores).collect()}
    assert set(got) == {0, 1, 2, 3, 4, 6, 7, 9} and got[9] is None
    rank = lambda s: (2, 0.0) if s != s else (1, s)  # noqa: E731  NaN is above all
    for c in got.keys() - {9}:
        assert got[c] == pytest.approx(brute_auc([(r[0] == str(c), rank(r[c + 1])) for r in rows if r[0] is not None and r[c + 1] is not None]), abs=1e-9)


def test_many_classes_of_few_scores_are_counted_in_one_pass(spark, monkeypatch):
    """No row is written out for each class, and the scores of 60 classes are not one method that the JVM interprets."""
    monkeypatch.setattr(metrics, "score_tally", lambda *_: pytest.fail("rows and classes were multiplied"))
    orders = spark.range(3000).selectExpr("id % 60 as y", "id as k")
    scores = {c: ((F.col("k") * (c + 7)) % 97 + F.when(F.col("y") == c, 9).otherwise(0)).cast("double") for c in range(60)}
    got = {r["class_index"]: r["auc"] for r in metrics.roc_auc_by_class(orders, "y", scores).collect()}
    for c in (0, 31, 59):
        assert got[c] == pytest.approx(brute_auc([(i % 60 == c, i * (c + 7) % 97 + 9 * (i % 60 == c)) for i in range(3000)]), abs=1e-9)
    plan = metrics._score_rows(orders, "y", scores)._jdf.queryExecution().executedPlan().toString()
    assert all(not line.startswith("*") for line in plan.splitlines() if "AS scores" in line)
