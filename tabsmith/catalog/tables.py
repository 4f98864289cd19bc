"""Input tables of the registered queries, in Spark and in SQL.

The supplied tables hold no missing values and no repeated rows, so both are put in by
the same expressions on both sides. Every row of the source takes part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dirty_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return table(spark, sf_dir, "lineitem").select(
        c("l_orderkey").alias("orderkey"),
        c("l_partkey").alias("partkey"),
        c("l_suppkey").alias("suppkey"),
        c("l_linenumber").alias("linenumber"),
        F.when(c("l_partkey") % 11 != 0, c("l_quantity")).alias("quantity"),
        F.when(c("l_suppkey") % 13 != 0, c("l_extendedprice")).alias("price"),
        c("l_discount").alias("discount"),
        c("l_tax").alias("tax"),
        F.when(c("l_orderkey") % 17 != 0, c("l_returnflag")).alias("returnflag"),
        c("l_linestatus").alias("linestatus"),
    )


def doubled_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dirty_lineitem(spark, sf_dir)
    return d.unionByName(d.filter("linenumber = 1"))


def dirty_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return table(spark, sf_dir, "events").select(
        "event_id",
        "user_id",
        F.when(c("user_id") % 7 != 0, c("event_type")).alias("event_type"),
        F.when(c("event_id") % 9 != 0, c("value")).alias("value"),
        (c("value") - 40).alias("balance"),
        F.when(c("event_id") % 5 != 0, c("props")).alias("props"),
        F.lit("web").alias("channel"),
        F.lit(None).cast("double").alias("nothing"),
    )


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select(
        "doc_id", "lang", "source", "n_chars", "quality", "toxic"
    )


def flagged_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return table(spark, sf_dir, "lineitem").select(
        c("l_quantity").alias("quantity"),
        c("l_discount").alias("discount"),
        (c("l_discount") * 2 + c("l_tax") * 0.01).alias("rebate"),
        c("l_tax").alias("tax"),
        c("l_returnflag").alias("returnflag"),
        F.when(c("l_discount") > 0.05, "high").otherwise("low").alias("band"),
        c("l_linestatus").alias("actual_status"),
        (c("l_discount") > 0.05).cast("int").alias("flag"),
    )


def scored_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deterministic score in [0, 1) and predictions for two and three classes."""
    c = F.col
    cents = F.round(c("l_extendedprice") * 100).cast("bigint")
    two = (cents % 1000) / 1000.0
    return table(spark, sf_dir, "lineitem").select(
        (c("l_returnflag") == "R").cast("int").alias("truth"),
        two.alias("score"),
        (two >= 0.5).cast("int").alias("predicted"),
        c("l_returnflag").alias("flag"),
        F.when(c("l_partkey") % 3 == 0, "A").when(c("l_partkey") % 3 == 1, "N").otherwise("R").alias("flag_predicted"),
        ((cents % 700) / 700.0).alias("p_a"),
        ((cents % 300) / 300.0).alias("p_n"),
        ((cents % 110) / 110.0).alias("p_r"),
    )


def order_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customer: a table for training, with a learnable target."""
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer")
    joined = orders.join(customers, orders.o_custkey == customers.c_custkey)
    return joined.select(
        "o_orderkey", "o_totalprice", "c_acctbal", "c_mktsegment", "c_nationkey", "o_orderpriority", "o_orderstatus",
        (F.col("o_totalprice") > F.col("c_acctbal") * 20 + 150000).cast("int").alias("large_order_flag"),
    )


# The same tables as SQL, each usable as `WITH ... SELECT`.
DIRTY = """
dirty AS (SELECT l_orderkey AS orderkey, l_partkey AS partkey, l_suppkey AS suppkey, l_linenumber AS linenumber,
 CASE WHEN l_partkey % 11 <> 0 THEN l_quantity END AS quantity,
 CASE WHEN l_suppkey % 13 <> 0 THEN l_extendedprice END AS price,
 l_discount AS discount, l_tax AS tax,
 CASE WHEN l_orderkey % 17 <> 0 THEN l_returnflag END AS returnflag, l_linestatus AS linestatus FROM lineitem)"""
DOUBLED = DIRTY + ", doubled AS (SELECT * FROM dirty UNION ALL SELECT * FROM dirty WHERE linenumber = 1)"
EVENTS = """
ev AS (SELECT event_id, user_id, CASE WHEN user_id % 7 <> 0 THEN event_type END AS event_type,
 CASE WHEN event_id % 9 <> 0 THEN value END AS value, value - 40 AS balance,
 CASE WHEN event_id % 5 <> 0 THEN props END AS props, 'web' AS channel, CAST(NULL AS DOUBLE) AS nothing FROM events)"""
LABELLED = """
docs AS (SELECT l.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic FROM labels l JOIN documents d USING (doc_id))"""
FLAGGED = """
flagged AS (SELECT l_quantity AS quantity, l_discount AS discount, l_discount * 2 + l_tax * 0.01 AS rebate, l_tax AS tax,
 l_returnflag AS returnflag, CASE WHEN l_discount > 0.05 THEN 'high' ELSE 'low' END AS band,
 l_linestatus AS actual_status, CAST(l_discount > 0.05 AS INTEGER) AS flag FROM lineitem)"""
SCORED = """
cents AS (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS c FROM lineitem),
scored AS (SELECT CAST(l_returnflag = 'R' AS INTEGER) AS truth, (c % 1000) / 1000.0 AS score,
 CAST((c % 1000) / 1000.0 >= 0.5 AS INTEGER) AS predicted, l_returnflag AS flag,
 CASE l_partkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS flag_predicted,
 (c % 700) / 700.0 AS p_a, (c % 300) / 300.0 AS p_n, (c % 110) / 110.0 AS p_r FROM cents)"""
