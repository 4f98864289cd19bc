import pytest
from pyspark.sql import functions as F

from tabsmith.operators import benchmark, models
from tabsmith.operators.models import TrainedModel, train_model
from tabsmith.operators.prepare import prepare_dataset
from tabsmith.sources.sinks import export_table, export_training_result
from tabsmith.streaming.scoring import read_file_stream, score_stream


@pytest.fixture(scope="module")
def shipments(spark):
    pick = lambda seed, *v: f"element_at(array({', '.join(repr(x) for x in v)}), cast(1 + rand({seed}) * {len(v)} as int))"
    base = spark.range(400).selectExpr(
        "id", f"{pick(1, 'High', 'Low', 'Medium')} as Order_Priority", f"{pick(2, 'Air', 'Road', 'Sea', 'Rail')} as Shipping_Mode",
        "rand(3) * 100 as Sales", "rand(4) * 10 - 2 as Order_Profit_Per_Order", "cast(rand(5) * 5 as int) as Days_for_shipment_scheduled")
    risk = (F.col("Shipping_Mode").isin("Road", "Sea").cast("int") + (F.rand(6) > 0.85).cast("int")) > 0
    df = base.withColumn("Late_delivery_risk", risk.cast("int")).withColumn(
        "Delivery_Status", F.when(F.col("Late_delivery_risk") == 1, "late").otherwise("fine"))
    # Random columns must not change between jobs.
    return spark.createDataFrame(df.collect(), df.schema)


@pytest.mark.parametrize("kind", ["logistic_regression", "decision_tree", "random_forest", "gradient_boosting"])
def test_learners(spark, shipments, kind):
    small = {"random_forest": {"numTrees": 10}, "gradient_boosting": {"maxIter": 5}}.get(kind, {})
    r = train_model(shipments, kind, "Late_delivery_risk", leakage=["Delivery_Status", "id"], specs=[], key=["id"], **small)
    m = r.metrics.first()
    assert m["classification_type"] == "binary" and m["roc_auc"] > 0.7
    assert (r.train.count(), r.test.count()) == (320, 80)
    assert not any("Delivery_Status" in f for f in r.model.features)
    assert r.confusion.agg(F.sum("cnt")).first()[0] == 80
    assert r.importance.count() == min(20, len(r.model.features))


def test_leakage_is_found_and_result_is_reproducible(spark, shipments, tmp_path):
    a = train_model(shipments, "decision_tree", "Late_delivery_risk", key=["id"])
    export_training_result(a, str(tmp_path / "result"))
    assert spark.read.json(str(tmp_path / "result" / "metrics")).count() == 1
    b = train_model(shipments.repartition(3), "decision_tree", "Late_delivery_risk", key=["id"])
    assert "Delivery_Status" in a.model.leakage
    assert a.metrics.first() == b.metrics.first()
    assert a.sample_records().count() == 10
    best = models.best_per_metric(models.model_comparison({"decision_tree": a, "again": b}, spark))
    assert best.filter("is_best").count() >= 10
    assert {"imputation", "feature_selection"} <= {r["stage"] for r in a.trace(spark).select("stage").collect()}


@pytest.mark.parametrize("kind", ["logistic_regression", "gradient_boosting"])
def test_multiclass_text_target(spark, shipments, kind):
    df = shipments.withColumn("grade", F.when(F.col("Sales") > 66, "top").when(F.col("Sales") > 33, "mid").otherwise("low"))
    extra = {"maxIter": 3} if kind == "gradient_boosting" else {}
    r = train_model(df, kind, "grade", leakage=["id"], specs=[], key=["id"], **extra)
    m = r.metrics.first()
    assert m["classification_type"] == "multiclass" and m["n_classes"] == 3 and m["roc_auc"] > 0.8
    scored = r.model.score(df)
    total = scored.select(F.aggregate(F.map_values("probabilities"), F.lit(0.0), lambda a, x: a + x).alias("s")).agg(F.min("s"), F.max("s")).first()
    assert total[0] == pytest.approx(1.0, abs=1e-3) and total[1] == pytest.approx(1.0, abs=1e-3)
    assert {x["predicted_class"] for x in scored.select("predicted_class").distinct().collect()} <= {"low", "mid", "top"}


def test_score_saved_model_on_a_stream(spark, shipments, tmp_path):
    r = train_model(shipments, "logistic_regression", "Late_delivery_risk", leakage=["Delivery_Status", "id"], specs=[], key=["id"])
    r.model.save(str(tmp_path / "model"))
    back = TrainedModel.load(str(tmp_path / "model"))
    want = r.model.score(shipments).select("id", "predicted_label", "positive_probability", "risk_level")
    shipments.write.parquet(str(tmp_path / "in"))
    stream = read_file_stream(spark, str(tmp_path / "in"), shipments.schema)
    score_stream(back, stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select(want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert {"On-Time Delivery", "Late Delivery Risk"} >= {x[1] for x in want.collect()} or {"0", "1"} >= {x[1] for x in want.collect()}
    # A record without a column and with an unseen category is scored, too.
    odd = spark.createDataFrame([(1.0, "Rocket")], "Sales double, Shipping_Mode string")
    assert back.score(odd).first()["predicted_class"] in ("0", "1")


def test_benchmark(spark, shipments, tmp_path):
    df = shipments.withColumn("Sales", F.when(F.col("id") % 11 != 0, F.col("Sales"))).withColumn("Shipping_Mode", F.when(F.col("id") % 13 != 0, F.col("Shipping_Mode")))
    b = benchmark.run_benchmark(df, "Late_delivery_risk", leakage=["Delivery_Status", "id"], key=["id"])
    t = {r["pipeline"]: r for r in b.table(spark).collect()}
    assert set(t) == {"minimal", "fixed", "hybrid"} and all(r["roc_auc"] > 0.6 and r["converged"] for r in t.values())
    assert b.split["train_rows"] == 320 and t["minimal"]["features_original"] == 5
    assert t["fixed"]["features_final"] > t["minimal"]["features_final"]
    export_table(b.export_columns(spark), str(tmp_path / "metrics"))
    assert spark.read.option("header", True).csv(str(tmp_path / "metrics")).count() == 3
    assert b.published(spark).count() == 3


def test_bad_inputs(spark, shipments):
    with pytest.raises(ValueError, match="Unknown model type"):
        train_model(shipments, "oracle", "Late_delivery_risk")
    with pytest.raises(ValueError, match="does not exist"):
        benchmark.run_benchmark(shipments, "nothing")
    rare = shipments.withColumn("rare", F.when(F.col("id") == 0, "z").when(F.col("id") % 2 == 0, "a").otherwise("b"))
    with pytest.raises(ValueError, match="rare classes"):
        benchmark.run_benchmark(rare, "rare", leakage=[])


def test_prepare_dataset(spark, shipments):
    p = prepare_dataset(shipments, key=["id"])
    assert p.target == "Late_delivery_risk" and (p.train.count(), p.test.count()) == (320, 80)
    assert p.train.columns == p.test.columns
    assert p.cleaned.count() == 400 and "Late_delivery_risk" in p.cleaned.columns
    assert {r["side"] for r in p.comparison.overall().collect()} == {"before", "after"}
    assert p.class_distribution.count() == 4
    free = prepare_dataset(shipments.drop("Late_delivery_risk"), key=["id"])
    assert free.target is None and free.class_distribution is None and free.test.count() == 80
