import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import DATA

SLOW = {"train_logistic_regression", "train_decision_tree", "train_random_forest", "train_gradient_boosting", "benchmark_abc",
        "feature_importance", "sample_records", "model_comparison", "score_batch", "score_streamed"}
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float)) or hasattr(v, "as_integer_ratio"):
        return "nan" if math.isnan(v) else float(v)
    return str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    cur = duck.execute(SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    order = lambda rows: sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))
    want = order([tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall()])
    got = order([tuple(plain(r[c]) for c in cols) for r in df.collect()])
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - SLOW))
def test_other_queries_run(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(SQL) <= set(QUERIES)
