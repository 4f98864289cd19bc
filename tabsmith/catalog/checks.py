"""Queries that certify fitted values: each has a SQL counterpart that finds the same optimum, split or role on its own."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith.catalog.oracle import EV, SELECTOR, TARGET_SCORES, anova_sql, r, union
from tabsmith.catalog.tables import LABELLED, table
from tabsmith.operators.boosting import SoftmaxBooster, tree_nodes
from tabsmith.operators.models import FEATURES, LABEL, WEIGHT, Clock, balanced_weight, fit_learner, make_learner
from tabsmith.operators.preprocess import HybridPreprocessor

STUMP_FEATURES = ["quantity", "discount", "linenumber", "tax"]


def graded_lineitem(spark, d) -> DataFrame:
    """Line items with a label that leans on the quantity, and with three grades."""
    c = F.col
    cents = F.round(c("l_extendedprice") * 100).cast("bigint")
    return table(spark, d, "lineitem").select(
        c("l_quantity").alias("quantity"), c("l_discount").alias("discount"), c("l_linenumber").cast("double").alias("linenumber"), c("l_tax").alias("tax"),
        (cents % 1000 * 60 < c("l_quantity") * 1000).cast("double").alias(LABEL),
        F.when(c("l_quantity") <= 15, 0).when(c("l_linenumber") + cents % 3 <= 3, 1).otherwise(2).alias("grade"),
    )


GRADED = """graded AS (SELECT l_quantity AS quantity, l_discount AS discount, CAST(l_linenumber AS DOUBLE) AS linenumber, l_tax AS tax,
 CAST(c % 1000 * 60 < l_quantity * 1000 AS DOUBLE) AS y, CASE WHEN l_quantity <= 15 THEN 0 WHEN l_linenumber + c % 3 <= 3 THEN 1 ELSE 2 END AS grade
 FROM (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS c FROM lineitem))"""


def _weighted(df: DataFrame):
    counts = dict(df.groupBy(LABEL).count().collect())
    return df.withColumn(WEIGHT, balanced_weight([counts.get(0.0, 0), counts.get(1.0, 0)])), sum(counts.values())


def logistic_optimum(spark, d):
    """Intercept and coefficient of the balanced, penalised logistic regression of the label on the standardised quantity."""
    df, n = _weighted(graded_lineitem(spark, d))
    learner = make_learner("logistic_regression", n, 2, 42, True, tol=1e-12)
    model = fit_learner(df, ["quantity"], learner, [], Clock()).stages[-1]
    rows = [("intercept", float(model.intercept)), ("quantity", float(model.coefficients[0]))]
    return spark.createDataFrame(rows, "term string, value double").withColumn("value", F.round("value", 4))


def tree_stump(spark, d):
    """Split and leaves of a balanced decision tree of depth 1: where, how many rows and positives, probability and prediction."""
    df, n = _weighted(graded_lineitem(spark, d))
    pipeline = fit_learner(df, STUMP_FEATURES, make_learner("decision_tree", n, 2, 42, True, maxDepth=1, maxBins=64), [], Clock())
    tree = tree_nodes(pipeline.stages[-1].toDebugString)
    leaves = pipeline.transform(df).groupBy(F.round(vector_to_array("probability")[1], 6).alias("p1"), "prediction")
    split = [F.lit(STUMP_FEATURES[tree["feature"][0]]).alias("feature"), F.round(F.lit(tree["threshold"][0]), 5).alias("threshold")]
    return leaves.agg(F.count("*").alias("n_rows"), F.sum(LABEL).cast("bigint").alias("positives")).select(*split, "p1", F.col("prediction").cast("int").alias("predicted"), "n_rows", "positives")


def softmax_round(spark, d):
    """The first round of boosting for three classes: per class the split, its leaves' rows and their Newton steps."""
    df = VectorAssembler(inputCols=STUMP_FEATURES, outputCol=FEATURES).transform(graded_lineitem(spark, d))
    model = SoftmaxBooster(featuresCol=FEATURES, labelCol="grade", numClasses=3, maxIter=1, maxDepth=1, maxBins=64, subsamplingRate=1.0).fit(df)
    rows = [(k, STUMP_FEATURES[t["feature"][0]], t["threshold"][0], t["rows"][1], t["rows"][2], t["value"][1], t["value"][2]) for k, t in enumerate(model.fitted["trees"][0])]
    out = spark.createDataFrame(rows, "grade int, feature string, threshold double, low_rows bigint, high_rows bigint, low_step double, high_step double")
    return out.withColumns({c: F.round(c, 6) for c in ("threshold", "low_step", "high_step")})


def impute_mode_long_text(spark, d):
    """Missing whole texts take the most frequent text."""
    docs = table(spark, d, "documents")
    df = docs.select("doc_id", F.when(F.col("doc_id") % 5 != 0, F.col("text")).alias("text"), "lang", "n_chars")
    cleaned = HybridPreprocessor(inputCols=["text", "lang", "n_chars"]).fit(df).transform_cleaned(df)
    return cleaned.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "lang")


def queries() -> dict:
    return {q.__name__: q for q in (logistic_optimum, tree_stump, softmax_round, impute_mode_long_text)}


def _standardised(c: str) -> str:
    return f"({c} - avg({c}) OVER ()) / sqrt(var_pop({c}) OVER ())"


def _stumps(columns: list[str], value: str, extra: str = "") -> str:
    """Every candidate split: rows and sums of both sides, per `extra` key."""
    keys = f"{extra}, " if extra else ""
    part = f"PARTITION BY {extra}" if extra else ""
    return union(
        [
            f"""SELECT {keys}'{c}' AS feature, {n} AS place, ({c} + lead({c}) OVER ({part} ORDER BY {c})) / 2 AS threshold,
 sum(n) OVER ({part} ORDER BY {c}) AS nl, sum(w) OVER ({part} ORDER BY {c}) AS wl, sum(s) OVER ({part} ORDER BY {c}) AS sl, sum(n) OVER ({part}) AS n, sum(w) OVER ({part}) AS w, sum(s) OVER ({part}) AS s,
 sum(k) OVER ({part} ORDER BY {c}) AS kl, sum(k) OVER ({part}) AS k
 FROM (SELECT {keys}{c}, count(*) AS n, sum(w) AS w, sum({value}) AS s, sum(y) AS k FROM rows_ GROUP BY ALL)"""
            for n, c in enumerate(columns)
        ]
    )


def _fit_metadata() -> str:
    """Imputation, log and scaling of each numeric column, each judged on the output of the step before."""
    numeric = []
    for c in ("user_id", "value", "balance"):
        numeric.append(f"""SELECT '{c}' AS column_name, any_value(method) AS imputation_method, any_value(lg) AS log1p_applied,
 CASE WHEN sum(out) / CAST(count(*) AS DOUBLE) > 0.02 THEN 'RobustScaler' ELSE 'StandardScaler' END AS scaler_type,
 {r('sum(out) / CAST(count(*) AS DOUBLE) * 100', 2)} AS outlier_percentage, CAST(NULL AS VARCHAR) AS encoder_type, CAST(NULL AS BIGINT) AS cardinality
FROM (SELECT method, lg, CAST(v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1) AS INTEGER) AS out FROM (
 SELECT *, quantile_cont(v, 0.25) OVER () AS q1, quantile_cont(v, 0.75) OVER () AS q3 FROM (
 SELECT method, lg, CASE WHEN lg THEN ln(1 + greatest(f, 0)) ELSE f END AS v FROM (
 SELECT method, f, abs(skewness(f) OVER ()) > 1 AND min(f) OVER () >= 0 AS lg FROM (
 SELECT CASE WHEN abs(skew) < 1 THEN 'mean_imputation' ELSE 'median_imputation' END AS method, coalesce(CAST({c} AS DOUBLE), CASE WHEN abs(skew) < 1 THEN mean ELSE med END) AS f
 FROM ev CROSS JOIN (SELECT skew, mean, med FROM st WHERE column_name = '{c}'))))))""")
    text = """SELECT column_name, 'most_frequent_imputation', CAST(NULL AS BOOLEAN), NULL, NULL, CASE WHEN uniq <= 15 THEN 'OneHotEncoder' ELSE 'OrdinalEncoder' END, uniq
 FROM st WHERE column_name IN ('event_type', 'props')"""
    return EV + union([*numeric, text])


def _auto_config() -> str:
    others = {"doc_id": "numeric", "lang": "categorical", "source": "categorical", "n_chars": "numeric", "quality": "numeric"}
    leaks = union(
        [
            f"""SELECT '{c}' AS column_name, {f"coalesce((SELECT abs(corr({c}, toxic)) FROM docs) >= 0.9, FALSE)" if kind == "numeric" else "FALSE"}
 OR (SELECT count(*) BETWEEN 2 AND 20 AND avg(share) >= 0.98 FROM (SELECT max(k) / CAST(sum(k) AS DOUBLE) AS share FROM (SELECT {c} AS v, toxic, count(*) AS k FROM docs WHERE {c} IS NOT NULL AND toxic IS NOT NULL GROUP BY ALL) GROUP BY v)) AS leaks,
 '{kind}' AS kind"""
            for c, kind in others.items()
        ]
    )
    return f"""WITH scores AS ({TARGET_SCORES}), {LABELLED}, roles AS ({leaks})
SELECT 'target' AS role, column_name FROM scores WHERE rank = 1
UNION ALL SELECT CASE WHEN leaks THEN 'leakage' ELSE kind END, column_name FROM roles"""


def _select_relevance() -> str:
    """F statistics of the features left, and their p values by Simpson's rule on Student's density (two classes: F is t squared)."""
    tested = ["price", "discount", "tax", "tripled"]
    return SELECTOR + f""", f AS ({anova_sql(tested, 'linestatus')}),
nu AS (SELECT count(*) - 2.0 AS nu FROM src WHERE linestatus IS NOT NULL),
p AS (SELECT feature, any_value(f) AS f, greatest(0, 1 - 2 * sum(CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * pow(1 + pow(i * least(sqrt(f), 12) / 4000, 2) / nu, -(nu + 1) / 2))
 * any_value(least(sqrt(f), 12)) / 4000 / 3 * any_value(exp(lgamma((nu + 1) / 2) - lgamma(nu / 2)) / sqrt(nu * pi()))) AS p FROM f CROSS JOIN nu CROSS JOIN (SELECT unnest(range(4001)) AS i) GROUP BY feature),
w AS (SELECT *, row_number() OVER (ORDER BY f DESC, feature) AS rank, p >= 0.05 AS weak, row_number() OVER (PARTITION BY p >= 0.05 ORDER BY f) AS weakest, count(*) OVER () AS features FROM p)
SELECT CAST(rank AS INTEGER) AS rank, feature, {r('f', 4)} AS f_statistic, {r('p', 6)} AS p_value, weak AND weakest <= features - 1 AS is_removed FROM w"""


def oracle_sql() -> dict[str, str]:
    q = {}
    q["logistic_optimum"] = f"""WITH RECURSIVE {GRADED}, counts AS (SELECT count(*) AS n, sum(y) AS n1 FROM graded),
z AS (SELECT {_standardised('quantity')} AS z, y, CASE WHEN y = 1 THEN n / (2.0 * n1) ELSE n / (2.0 * (n - n1)) END AS w, n FROM graded CROSS JOIN counts),
it AS (SELECT 0 AS k, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1
 UNION ALL SELECT k + 1, b0 - (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b1 - (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) FROM (
  SELECT k, b0, b1, sum(w * (p - y)) AS g0, sum(w * (p - y) * z) + b1 AS g1, sum(w * p * (1 - p)) AS h00, sum(w * p * (1 - p) * z) AS h01, sum(w * p * (1 - p) * z * z) + 1 AS h11
  FROM (SELECT k, b0, b1, z, y, w, 1 / (1 + exp(-b0 - b1 * z)) AS p FROM it CROSS JOIN z WHERE k < 12) GROUP BY k, b0, b1)),
best AS (SELECT b0, b1 FROM it WHERE k = 12)
SELECT 'intercept' AS term, {r('b0', 4)} AS value FROM best UNION ALL SELECT 'quantity', {r('b1', 4)} FROM best"""
    gini = lambda s, w: f"({w}) - (pow({s}, 2) + pow({w} - ({s}), 2)) / ({w})"
    scaled = ", ".join(f"{_standardised(c)} AS {c}" for c in STUMP_FEATURES)
    q["tree_stump"] = f"""WITH {GRADED}, counts AS (SELECT count(*) AS n, sum(y) AS n1 FROM graded),
rows_ AS (SELECT {scaled}, y, CASE WHEN y = 1 THEN n / (2.0 * n1) ELSE n / (2.0 * (n - n1)) END AS w FROM graded CROSS JOIN counts),
cand AS ({_stumps(STUMP_FEATURES, 'w * y')}),
best AS (SELECT * FROM cand WHERE threshold IS NOT NULL AND nl >= 10 AND n - nl >= 10 ORDER BY {gini('sl', 'wl')} + {gini('(s - sl)', '(w - wl)')}, place LIMIT 1),
leaves AS (SELECT feature, threshold, sl / wl AS p1, nl AS rows, kl AS positives FROM best UNION ALL SELECT feature, threshold, (s - sl) / (w - wl), n - nl, k - kl FROM best)
SELECT feature, {r('threshold', 5)} AS threshold, {r('p1', 6)} AS p1, CAST(p1 > 0.5 AS INTEGER) AS predicted, CAST(rows AS BIGINT) AS n_rows, CAST(positives AS BIGINT) AS positives FROM leaves"""
    q["softmax_round"] = f"""WITH {GRADED}, priors AS (SELECT grade AS g, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS p FROM graded GROUP BY grade),
rows_ AS (SELECT g, {', '.join(STUMP_FEATURES)}, y, CAST(grade = g AS INTEGER) - p AS res, p * (1 - p) AS w FROM graded CROSS JOIN priors),
cand AS ({_stumps(STUMP_FEATURES, 'res', 'g')}),
best AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY pow(sl, 2) / nl + pow(s - sl, 2) / (n - nl) DESC, place) AS rn FROM cand WHERE threshold IS NOT NULL)
SELECT CAST(g AS INTEGER) AS grade, feature, {r('threshold', 6)} AS threshold, CAST(nl AS BIGINT) AS low_rows, CAST(n - nl AS BIGINT) AS high_rows,
 {r('sl / wl * 2 / 3', 6)} AS low_step, {r('(s - sl) / (w - wl) * 2 / 3', 6)} AS high_step FROM best WHERE rn = 1"""
    q["impute_mode_long_text"] = """WITH d AS (SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN text END AS text, lang FROM documents),
t AS (SELECT text FROM d WHERE text IS NOT NULL GROUP BY text ORDER BY count(*) DESC, text LIMIT 1),
l AS (SELECT lang FROM d WHERE lang IS NOT NULL GROUP BY lang ORDER BY count(*) DESC, lang LIMIT 1)
SELECT doc_id, md5(coalesce(text, (SELECT text FROM t))) AS text_md5, coalesce(lang, (SELECT lang FROM l)) AS lang FROM d"""
    q["fit_metadata"] = _fit_metadata()
    q["auto_config"] = _auto_config()
    q["select_relevance"] = _select_relevance()
    return q
