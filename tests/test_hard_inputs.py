"""Ordinary inputs that once broke: dotted categories, quotes and line breaks in CSV, encodings, large counts."""

import pytest
from pyspark.sql import functions as F

from tabsmith.functions import jobs
from tabsmith.operators.autoconfig import detect_leakage
from tabsmith.operators.metrics import auc_of_tally
from tabsmith.operators.models import train_model
from tabsmith.operators.preprocess import HybridPreprocessor, safe_names
from tabsmith.operators.profile import target_profile
from tabsmith.sources.sinks import export_table
from tabsmith.sources.tables import read_csv


def test_names_are_safe_and_differ():
    names = safe_names(["city_St. Louis", "city_St_ Louis", "a_b_c", "a_b_c", "cat_A", "cat_a", "v`1"])
    assert len({n.lower() for n in names}) == 7 and not any(c in n for n in names for c in ".`")
    assert names[1:3] == ["city_St_ Louis", "a_b_c"] and names[4] == "cat_A"


@pytest.fixture(scope="module")
def cities(spark):
    names = ["St. Louis", "v1.0", "a`b", "Berlin"]
    rows = [(n, names[n % 4], ("b_c", "x")[n % 2], ("c", "y")[n % 3 == 0], float(n % 17), n % 2) for n in range(400)]
    return spark.createDataFrame(rows, "id long, city string, a string, a_b string, `price.net` double, late int")


def test_hard_categories_preprocess(spark, cities):
    model = HybridPreprocessor(inputCols=["city", "a", "a_b", "price.net"]).fit(cities)
    out = model.transform(cities)
    assert out.columns[2:] == model.feature_names
    assert "city_St. Louis" in model.feature_labels and model.feature_labels.count("a_b_c") == 2
    first = out.orderBy("id").first()
    assert first[model.feature_names[model.feature_labels.index("city_St. Louis")]] == 1.0


def test_hard_categories_train_and_score(cities):
    result = train_model(cities, "logistic_regression", "late", key=["id"])
    assert result.model.score(cities).count() == 400


def test_csv_round_trip_of_hard_text(spark, tmp_path):
    rows = [(1, 'say "hi", you'), (2, "two\nlines"), (3, "  spaces "), (4, None), (5, "café � ☕"), (6, "back\\slash\""), (7, ",")]
    export_table(spark.createDataFrame(rows, "id long, text string"), str(tmp_path / "t"))
    back = read_csv(spark, str(tmp_path / "t"))
    assert back.schema.simpleString() == "struct<id:bigint,text:string>"
    assert sorted((r.id, r.text) for r in back.collect()) == rows


def test_csv_encoding_is_told_by_file(spark, tmp_path):
    (tmp_path / "e").mkdir()
    (tmp_path / "e/a.csv").write_bytes("näme,x\ncafé,1\n".encode())
    (tmp_path / "e/b.csv").write_bytes("näme,x\nü,2\n".encode("latin-1"))
    only = read_csv(spark, str(tmp_path / "e/a.csv"))
    assert only.columns == ["näme", "x"] and only.first()[0] == "café"
    latin = read_csv(spark, str(tmp_path / "e/b.csv"))
    assert latin.columns == ["näme", "x"] and latin.first()[0] == "ü"
    (tmp_path / "f").mkdir()
    (tmp_path / "f/a.csv").write_bytes("name,x\ncafé,1\n".encode())
    (tmp_path / "f/b.csv").write_bytes("name,x\nü,2\n".encode("latin-1"))
    assert sorted(r.name for r in read_csv(spark, str(tmp_path / "f")).collect()) == ["café", "ü"]


def test_csv_types(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("whole,code,large,number,inf\n9007199254740993001,1d,123456789012345678901,1.5,inf\n9007199254740993003,2f,2,-2e3,1\n")
    back = read_csv(spark, str(path))
    assert [t for _, t in back.dtypes] == ["bigint", "string", "string", "double", "double"]
    assert back.select(F.countDistinct("whole")).first()[0] == 2


def test_auc_of_large_counts(spark):
    n = 5_000_000_000
    tally = spark.createDataFrame([(0, 0.1, 0, n), (0, 0.5, n, n), (0, 0.9, n, 0)], "k int, score double, pos long, neg long")
    assert auc_of_tally(tally, 2).first()["auc"] == pytest.approx(0.875)


def test_boolean_target_leaks_by_correlation(spark):
    rows = [(n % 2 == 0, (n % 2 == 0) * 1000.0 + n / 100, float(n * 37 % 101)) for n in range(400)]
    table = spark.createDataFrame(rows, "late boolean, proxy double, other double")
    kinds = {r["column_name"]: r for r in detect_leakage(table, "late").collect()}
    assert set(kinds) == {"proxy"}


def test_target_shares_of_many_classes(spark):
    table = spark.range(3000).select((F.col("id") % 1500).cast("string").alias("c"))
    shares = target_profile(table, "c")
    assert shares.count() == 1500 and shares.agg(F.sum("class_count")).first()[0] == 3000


def test_checkpoints_need_a_shared_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="checkpoint"):
        jobs.checkpoint_folder(Session())


def test_ordinal_codes_without_hot_keys(spark, monkeypatch):
    from tabsmith.functions import joins
    from tabsmith.operators.preprocess import PlainPreprocessor

    df = spark.range(4000).selectExpr("if(id % 10 > 0, null, concat('v', id % 700)) as t", "concat('w', id % 90) as u", "id % 2 as y")
    fresh = spark.createDataFrame([("v10", None), (None, "w3"), ("new", "w5"), ("missing", "new")] * 20, "t string, u string")
    want = {}
    for route in ("broadcast", "shuffled"):
        if route == "shuffled":
            monkeypatch.setattr(joins, "BROADCAST_ROWS", 10)
            monkeypatch.setattr(joins, "WINDOW_ROWS", 10)
        for maker in (HybridPreprocessor, PlainPreprocessor):
            model = maker(inputCols=["t", "u"]).fit(df)
            got = [sorted(map(str, model.transform(x).collect())) for x in (df, fresh)]
            if maker is HybridPreprocessor:
                got.append(sorted(map(str, model.transform(df.drop("u")).collect())))
                assert {r["u_ordinal"] for r in model.transform(df.drop("u")).collect()} == {-1.0}
                mode = next(f["mode"] for f in model.fitted["text"] if f["name"] == "t")
                code = model.transform(df.filter(F.col("t") == mode)).first()["t_ordinal"]
                assert {r["t_ordinal"] for r in model.transform(df.filter("t is null")).collect()} == {code}
            assert want.setdefault(maker.__name__, got) == got


def test_split_of_many_classes(spark):
    from tabsmith.operators.split import holdout_split

    df = spark.range(6000).selectExpr("id", "concat('k', id % 1500) as y", "id % 7 as x")
    train, test = holdout_split(df, "y", test_size=0.25, key=["id"])
    assert (train.count(), test.count()) == (4500, 1500)
    assert test.groupBy("y").count().filter("count != 1").count() == 0
    assert train.join(test, "id").count() == 0 and train.columns == df.columns
    # Copies that only a row id can tell apart.
    copies = df.select("y", (F.col("x") * 0).alias("x"))
    train, test = holdout_split(copies, "y", test_size=0.25)
    assert (train.count(), test.count()) == (4500, 1500)
    assert test.groupBy("y").count().filter("count != 1").count() == 0
    with pytest.raises(ValueError, match="rare"):
        holdout_split(df.union(spark.sql("select 9999L, 'alone', 0L")), "y")
    train, test = holdout_split(df.union(spark.sql("select 9999L, 'alone', 0L")), "y", on_rare_class="plain")
    assert test.count() == 1201


def test_split_of_missing_targets_by_filter_and_by_table(spark, monkeypatch):
    from tabsmith.operators import split

    df = spark.range(600).selectExpr("id", "case when id % 3 > 0 then id % 7 end y")
    sizes = []
    for most in (48, 5):
        monkeypatch.setattr(split, "FILTER_CLASSES", most)
        train, test = split.holdout_split(df, "y", test_size=0.25, key=["id"])
        sizes.append([{r.y: r["count"] for r in side.groupBy("y").count().collect()} for side in (train, test)])
        assert sum(sizes[-1][1].values()) == 150 and sizes[-1][1][None] == 50
    assert sizes[0] == sizes[1]
    # A single row without target is no rare class.
    single = df.where("y is not null").union(spark.sql("select -1L, cast(null as bigint)"))
    train, test = split.holdout_split(single, "y", test_size=0.25, key=["id"])
    assert test.count() == 101 and train.count() == 300
