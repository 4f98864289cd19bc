"""Connected components of a link table, and samples by hash, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabsmith.llm.common import stored

#: Rows of (id, label) that are sent to all tasks at most (16 bytes each).
BROADCAST_ROWS = 1_000_000


def sent(df: DataFrame, rows: int) -> DataFrame:
    """A side of a join: sent to all tasks while it is known to be small, shuffled beyond."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def components(links: DataFrame) -> DataFrame:
    """(id, label) of every node of the links (a, b); the label is the component's smallest id.

    Each round takes the smallest label among a node's neighbours, then the label of that label, so long chains shrink
    by half or more a round. Rounds go through written tables.
    """
    both = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "id"))
    n = labels.count()
    while n:
        near = both.join(sent(labels.select(F.col("id").alias("b"), "label"), n), "b").groupBy("a").agg(F.min("label").alias("low"))
        lower = near.withColumnRenamed("a", "id").join(sent(labels, n), "id").select("id", F.col("label").alias("was"), F.least("label", "low").alias("low"))
        jump = labels.select(F.col("id").alias("low"), F.col("label").alias("far"))
        after = stored(lower.join(sent(jump, n), "low").select("id", "was", F.least("low", "far").alias("label")))
        labels = after.select("id", "label")
        if after.where(F.col("was") != F.col("label")).isEmpty():
            break
    return labels


def first_by_hash(rows: DataFrame, group: str, quota: int) -> DataFrame:
    """(id, group) of the `quota` different ids of each group whose hashes are smallest (ties: the smaller id).

    A threshold from the group's count leaves little more than the quota; only those rows are sorted. Where it left too few, it is widened.
    """
    hashed = rows.select("id", group).distinct().withColumn("hash", F.xxhash64("id"))
    counts = stored(hashed.groupBy(group).agg(F.count("*").alias("total")))
    wanted, groups = quota + 8 * quota**0.5 + 8, counts.count()
    while True:
        limit = F.when(F.col("total") <= wanted, F.lit((1 << 63) - 1)).otherwise((wanted / F.col("total") * 2.0**64 - 2.0**63).cast("long"))
        near = stored(hashed.join(sent(counts.select(group, "total", limit.alias("limit")), groups), group).where("hash <= limit"))
        short = near.groupBy(group).agg(F.count("*").alias("n"), F.first("total").alias("total"))
        if short.where(F.col("n") < F.least("total", F.lit(quota))).isEmpty() and short.count() == groups:
            break
        wanted *= 4
    place = F.row_number().over(W.partitionBy(group).orderBy("hash", "id"))
    return near.withColumn("n", place).where(F.col("n") <= quota).select("id", group)
