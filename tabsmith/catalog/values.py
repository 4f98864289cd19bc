"""Queries of steps that other queries only pass through: guards, alignment, weights, resolution, filters; each with SQL."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from tabsmith.catalog.oracle import CUST, EV, KIND, PLAN, r, union
from tabsmith.catalog.tables import DIRTY, dirty_events, dirty_lineitem, doubled_lineitem, table
from tabsmith.operators import autoconfig, profile, split
from tabsmith.operators.compare import Comparison
from tabsmith.operators.models import LABEL, balanced_weight, label_index
from tabsmith.operators.preprocess import FeatureStandardizer, FiniteGuard, HybridPreprocessor, PlainPreprocessor
from tabsmith.operators.ratios import RatioFeatures
from tabsmith.operators.selection import FeatureSelector
from tabsmith.operators.stats import table_stats
from tabsmith.plans import names
from tabsmith.plans.rules import decision_plan, decision_trace, filter_plan, filter_trace
from tabsmith.sources.tables import use_dataframe


def one_hot_vector(spark, d):
    """Capped one-hot as one sparse vector: what each slot stands for, and how many rows hold it."""
    df = table(spark, d, "part").select("p_partkey", "p_brand", "p_type")
    out = PlainPreprocessor(inputCols=["p_brand", "p_type"], encoding="onehot", vectorCol="v").fit(df).transform(df)
    labels = F.array(*[F.lit(a["name"]) for a in out.schema["v"].metadata["ml_attr"]["attrs"]["numeric"]])
    sums = out.select(Summarizer.metrics("sum", "count").summary(F.col("v")).alias("m"))
    slots = sums.select(F.col("m.count").alias("n"), F.posexplode(vector_to_array("m.sum")).alias("slot", "ones"))
    return slots.select("slot", F.get(labels, "slot").alias("feature"), "ones", "n")


def class_weights(spark, d):
    """Rows with a target, the place of each class in sorted order, and its balanced weight."""
    df = split.drop_missing_target(dirty_lineitem(spark, d), "returnflag")
    counts = split.class_counts(df, "returnflag")
    labelled = df.select("returnflag", label_index("returnflag", list(counts), "string").alias(LABEL))
    weighted = labelled.withColumn("weight", balanced_weight(list(counts.values())))
    return weighted.groupBy(F.col("returnflag").alias("class"), F.col(LABEL).alias("label"), F.round("weight", 6).alias("weight")).agg(F.count("*").alias("n"))


def class_checks(spark, d):
    """What the checks say of a target with two classes, of one with a rare class, and of one without a second class."""
    orders = table(spark, d, "orders").select("o_orderkey")
    low = F.col("o_orderkey") == orders.agg(F.min("o_orderkey")).first()[0]
    targets = {"even": F.col("o_orderkey") % 2, "rare": F.when(low, 7).otherwise(F.col("o_orderkey") % 2), "single": F.lit(1), "missing": F.when(low, 1)}
    rows = []
    for name, value in targets.items():
        counts = split.class_counts(orders.select(value.alias("y")), "y")
        try:
            outcome = "stratified" if split.check_classes(counts, "y") else "not stratified"
        except ValueError as e:
            outcome = next(k for k in ("fewer than two", "at least 2", "rare classes") if k in str(e))
        rows.append((name, outcome, sum(n for k, n in counts.items() if k is not None)))
    return spark.createDataFrame(rows, "target string, outcome string, n bigint")


def cleaned_absent_columns(spark, d):
    """Fitted on three columns, two of which the rows to clean do not have."""
    events = dirty_events(spark, d)
    m = HybridPreprocessor(inputCols=["value", "balance", "event_type"]).fit(events)
    out = m.transform_cleaned(events.select("event_id", "balance"))
    return out.select("event_id", F.round("balance", 6).alias("balance"), F.round("value", 6).alias("value"), "event_type")


def finite_guard(spark, d):
    x = F.expr("case event_id % 10 when 0 then double('inf') when 1 then double('-inf') when 2 then double('nan') when 3 then null else value end")
    return FiniteGuard(inputCols=["x", "absent"]).transform(table(spark, d, "events").select("event_id", x.alias("x")))


def final_scaling(spark, d):
    """Standard scores of a finished feature matrix; missing values count as 0."""
    names_ = ["quantity", "price", "tax"]
    df = dirty_lineitem(spark, d).select("orderkey", "linenumber", *names_)
    out = FeatureStandardizer(inputCols=names_).fit(df).transform(df)
    return out.select("orderkey", "linenumber", *[F.round(c, 4).alias(c) for c in names_])


def selection_applied(spark, d):
    """The selected features of a table that lacks one of them."""
    c = F.col
    df = dirty_lineitem(spark, d).select("quantity", "price", "discount", "tax", (c("quantity") * 3 + 1).alias("tripled"), (c("discount") * 0.001).alias("tiny"))
    out = FeatureSelector().fit(df).transform(df.drop("tax"))
    return out.unpivot([], out.columns, "feature", "value").groupBy("feature").agg(F.count("value").alias("n"), F.round(F.sum("value"), 2).alias("total"))


def selection_fallback(spark, d):
    """Constant features alone: nothing is left, so all stay."""
    df = table(spark, d, "lineitem").select(F.lit(1.0).alias("one"), (F.col("l_quantity") * 0 + 2).alias("two"))
    out = FeatureSelector().fit(df).transform(df)
    return out.unpivot([], out.columns, "feature", "value").groupBy("feature").agg(F.sum("value").alias("total"))


def target_resolved(spark, d):
    """A table that its column names mark as one of deliveries: target by hint, names of its classes, rows of each."""
    c = F.col
    df = table(spark, d, "orders").select(
        c("o_orderpriority").alias("Shipping Mode"), c("o_orderstatus").alias("Delivery Status"), c("o_totalprice").alias("total"), F.when(c("o_custkey") % 9 != 0, (c("o_custkey") % 4 == 0).cast("int")).alias("Late_delivery_risk")
    )
    found = autoconfig.resolve_target(df, " AUTO")
    labels = names.class_labels(names.domain_profile(None, df.columns), found.classes)
    shown = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    rows = split.drop_missing_target(df, found.column).groupBy(F.get(F.map_values(F.map_filter(shown, lambda k, _: k == c(found.column))), F.lit(0)).alias("label")).agg(F.count("*").alias("n"))
    return rows.select(F.lit(found.column).alias("target"), F.lit(found.classification_type).alias("kind"), F.lit(found.domain_profile).alias("domain"), "label", "n")


def ratio_discovered(spark, d):
    """The ratio that column names suggest, applied."""
    c = F.col
    df = dirty_lineitem(spark, d).select((c("price") * c("discount")).alias("Line_Profit"), c("quantity").alias("units"), (c("price") - 950).alias("Total_Revenue"))
    specs = names.ratio_specs(df.columns)
    out = RatioFeatures(specs=specs).fit(df).transform(df)
    return out.agg(F.lit(specs[0]["name"]).alias("feature"), F.count("*").alias("n"), F.count(specs[0]["name"]).alias("known"), F.round(F.avg(specs[0]["name"]), 8).alias("mean"))


def profile_filtered(spark, d):
    profiles = profile.column_profiles(table_stats(table(spark, d, "customer")), spark)
    parts = [profile.filter_profiles(profiles, *a).select(F.lit(k).alias("filter"), "column_name", "inferred_type", "unique_count") for k, a in (("numeric", ("KEY", "numeric")), ("text", ("m", "text")), ("all", ("c_na", "all")))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def plan_filtered(spark, d):
    plan = decision_plan(table_stats(dirty_events(spark, d), numeric_values=False), spark)
    kept = filter_plan(plan, "VAL", "usable_numeric").select(F.lit("plan").alias("part"), "column_name", F.col("status").alias("found"))
    steps = filter_trace(decision_trace(plan), "Balance", "scaling").select(F.lit("trace").alias("part"), "column_name", F.col("selected_action").alias("found"))
    return kept.unionByName(steps)


def compare_strategy(spark, d):
    """The imputation that a comparison names: the given one, else what the raw column calls for."""
    raw = doubled_lineitem(spark, d).withColumn("skewed", F.pow("price", F.lit(5.0)))
    model = HybridPreprocessor().fit(raw)
    c = Comparison(raw, model.transform_cleaned(raw), {"tax": "stated"}, cleaned=model.cleaned_columns(raw))
    return spark.createDataFrame([(n, c.strategy(n)) for n in c.common], "column_name string, strategy string")


def leakage_by_name(spark, d):
    """Without a target: columns without any value, and those whose names say that they come too late."""
    events = dirty_events(spark, d).withColumnRenamed("event_type", "Delivery Status")
    found = autoconfig.detect_leakage(events)
    rows = events.agg(*[F.count(f"`{c}`").alias(c) for c in events.columns]).unpivot([], events.columns, "column_name", "n_values")
    return found.select("column_name", "type", "severity").join(rows, "column_name")


def used_table(spark, d):
    """An existing DataFrame taken as the input table."""
    df = use_dataframe(dirty_lineitem(spark, d))
    return df.agg(F.lit(len(df.columns)).cast("bigint").alias("num_columns"), F.count("*").alias("num_rows"), F.count("price").alias("prices"))


def queries() -> dict:
    listed = (
        one_hot_vector, class_weights, class_checks, cleaned_absent_columns, finite_guard, final_scaling, selection_applied, selection_fallback, target_resolved,
        ratio_discovered, profile_filtered, plan_filtered, compare_strategy, leakage_by_name, used_table,
    )
    return {q.__name__: q for q in listed}


def oracle_sql() -> dict[str, str]:
    q = {}
    q["one_hot_vector"] = "SELECT CAST(row_number() OVER (ORDER BY col, rare, feature) - 1 AS INTEGER) AS slot, feature, ones, n FROM (" + union(
        [
            f"""SELECT '{c}' AS col, rn > cap AS rare, '{c}_' || CASE WHEN rn <= cap THEN v ELSE 'infrequent_sklearn' END AS feature, CAST(sum(k) AS DOUBLE) AS ones, (SELECT count(*) FROM part) AS n
 FROM (SELECT {c} AS v, count(*) AS k, row_number() OVER (ORDER BY count(*) DESC, {c}) AS rn, CASE WHEN (SELECT count(DISTINCT {c}) FROM part) > 15 THEN 14 ELSE 15 END AS cap FROM part GROUP BY {c}) GROUP BY ALL"""
            for c in ("p_brand", "p_type")
        ]
    ) + ")"
    q["class_weights"] = f"""WITH {DIRTY} SELECT returnflag AS class, CAST(row_number() OVER (ORDER BY returnflag) - 1 AS DOUBLE) AS label,
 {r('sum(count(*)) OVER () / (CAST(count(*) OVER () AS DOUBLE) * count(*))', 6)} AS weight, count(*) AS n FROM dirty WHERE returnflag IS NOT NULL GROUP BY returnflag"""
    q["class_checks"] = """WITH low AS (SELECT min(o_orderkey) AS low FROM orders), t AS (
SELECT 'even' AS target, o_orderkey % 2 AS y FROM orders UNION ALL SELECT 'rare', CASE WHEN o_orderkey = low THEN 7 ELSE o_orderkey % 2 END FROM orders, low
UNION ALL SELECT 'single', 1 FROM orders UNION ALL SELECT 'missing', CASE WHEN o_orderkey = low THEN 1 END FROM orders, low),
c AS (SELECT target, y, count(*) AS k FROM t WHERE y IS NOT NULL GROUP BY ALL)
SELECT target, CASE WHEN sum(k) < 2 THEN 'fewer than two' WHEN count(*) < 2 THEN 'at least 2' WHEN min(k) < 2 THEN 'rare classes' ELSE 'stratified' END AS outcome, CAST(sum(k) AS BIGINT) AS n FROM c GROUP BY target"""
    q["cleaned_absent_columns"] = EV + f"""SELECT event_id, {r('balance', 6)} AS balance, {r("(SELECT CASE WHEN abs(skew) < 1 THEN mean ELSE med END FROM st WHERE column_name = 'value')", 6)} AS value, 'missing' AS event_type FROM ev"""
    q["finite_guard"] = "SELECT event_id, CASE WHEN event_id % 10 < 4 THEN 0.0 ELSE value END AS x, CAST(0 AS DOUBLE) AS absent FROM events"
    scores = ", ".join(f"{r(f'(coalesce({c}, 0) - avg(coalesce({c}, 0)) OVER ()) / stddev_pop(coalesce({c}, 0)) OVER ()', 4)} AS {c}" for c in ("quantity", "price", "tax"))
    q["final_scaling"] = f"WITH {DIRTY} SELECT orderkey, linenumber, {scores} FROM dirty"
    q["selection_applied"] = f"WITH {DIRTY} " + union(
        [f"SELECT '{c}' AS feature, count(*) AS n, {r(f'sum({x})', 2)} AS total FROM dirty" for c, x in (("price", "coalesce(price, 0)"), ("discount", "discount"), ("tax", "CAST(0 AS DOUBLE)"), ("tripled", "coalesce(quantity * 3 + 1, 0)"))]
    )
    q["selection_fallback"] = "SELECT unnest(['one', 'two']) AS feature, unnest([count(*), 2 * count(*)])::DOUBLE AS total FROM lineitem"
    q["target_resolved"] = """SELECT 'Late_delivery_risk' AS target, 'binary' AS kind, 'supply_chain' AS domain, CASE WHEN o_custkey % 4 = 0 THEN 'Late Delivery Risk' ELSE 'On-Time Delivery' END AS label, count(*) AS n
FROM orders WHERE o_custkey % 9 <> 0 GROUP BY ALL"""
    ratio = "CASE WHEN price - 950 IS NULL OR price - 950 = 0 THEN 0 ELSE price * discount / (price - 950) END"
    q["ratio_discovered"] = f"WITH {DIRTY} SELECT 'profit_to_revenue_ratio' AS feature, count(*) AS n, count({ratio}) AS known, {r(f'avg({ratio})', 8)} AS mean FROM dirty"
    q["profile_filtered"] = CUST + f""", p AS (SELECT column_name, {KIND} AS inferred_type, uniq AS unique_count FROM st)
SELECT 'numeric' AS filter, * FROM p WHERE column_name LIKE '%key%' AND inferred_type = 'numeric' UNION ALL SELECT 'text', * FROM p WHERE column_name LIKE '%m%' AND inferred_type <> 'numeric'
UNION ALL SELECT 'all', * FROM p WHERE contains(column_name, 'c_na')"""
    q["plan_filtered"] = PLAN + """SELECT 'plan' AS part, column_name, status AS found FROM plan WHERE column_name LIKE '%val%' AND status = 'usable_numeric'
UNION ALL SELECT 'trace', column_name, selected_action FROM steps WHERE column_name LIKE '%balance%' AND stage = 'scaling'"""
    numeric = {c: c for c in ("orderkey", "partkey", "suppkey", "linenumber", "quantity", "price", "discount")} | {"skewed": "pow(price, 5)"}
    q["compare_strategy"] = f"WITH {DIRTY}, doubled AS (SELECT * FROM dirty UNION ALL SELECT * FROM dirty WHERE linenumber = 1) " + union(
        [f"SELECT '{c}' AS column_name, CASE WHEN abs(skewness({x})) > 1 THEN 'median imputation' ELSE 'mean imputation' END AS strategy FROM doubled" for c, x in numeric.items()]
        + ["SELECT unnest(['tax', 'returnflag', 'linestatus']), unnest(['stated', 'mode imputation', 'mode imputation'])"]
    )
    q["leakage_by_name"] = EV + """SELECT 'nothing' AS column_name, 'all_missing' AS type, 'high' AS severity, count(nothing) AS n_values FROM ev HAVING count(nothing) = 0
UNION ALL SELECT 'Delivery Status', 'domain_knowledge', 'high', count(event_type) FROM ev"""
    q["used_table"] = f"WITH {DIRTY} SELECT CAST(10 AS BIGINT) AS num_columns, count(*) AS num_rows, count(price) AS prices FROM dirty"
    return q
