"""Dictionary lookups that survive large dictionaries and hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabsmith.functions.jobs import checkpointed

# A side is only broadcast when it is known to stay below both limits.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 * 1024 * 1024
# Ranks of dictionaries within both limits are computed by one window per column.
WINDOW_ROWS = 200_000
WINDOW_BYTES = 64 * 1024 * 1024
HOT_SHARE = 200
SALTS = 64


def ranked_dictionary(counts: DataFrame, total_values: int, columns: int) -> DataFrame:
    """(column_id, value, cnt, idx): 0-based position of each value in sorted order.

    Large dictionaries are range-sorted over all executors; the position is the place
    inside the partition plus the values in earlier partitions.
    """
    counts = checkpointed(counts)
    size = counts.agg(F.sum(F.octet_length("value"))).first()[0] or 0
    if total_values <= WINDOW_ROWS and size <= WINDOW_BYTES:
        order = Window.partitionBy("column_id").orderBy("value")
        return checkpointed(counts.withColumn("idx", (F.row_number().over(order) - 1).cast("double")))
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = counts.repartitionByRange(parts, "column_id", "value").sortWithinPartitions("column_id", "value")
    # The row id holds partition and place; the checkpoint pins both.
    placed = checkpointed(ordered.withColumn("place", F.monotonically_increasing_id()))
    placed = placed.withColumn("part", F.shiftright("place", 33))
    spans = placed.groupBy("part", "column_id").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    # At most partitions + columns rows.
    before = Window.partitionBy("column_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = spans.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    joined = placed.join(F.broadcast(offsets), ["part", "column_id"])
    idx = (F.col("place") - F.col("first") + F.col("offset")).cast("double")
    return checkpointed(joined.select("column_id", "value", "cnt", idx.alias("idx")))


def fits_broadcast(rows: int, size: int) -> bool:
    return rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES


def lookup(
    df: DataFrame, key: str, dictionary: DataFrame, rows: int, size: int, hot: list[str], out: str
) -> DataFrame:
    """Left join ``df[key]`` with ``dictionary(value, idx)`` into column ``out``.

    Small dictionaries are broadcast. For large ones both sides are shuffled, and the
    values that hold a large share of the rows are spread over salted copies. Rows without a key
    match nothing; they are spread evenly too.
    """
    entries = dictionary.select(F.col("value").alias("_dk"), F.col("idx").alias(out))
    if fits_broadcast(rows, size):
        return df.join(F.broadcast(entries), df[key] == F.col("_dk"), "left").drop("_dk")
    spread = F.col(key).isNull() | F.col(key).isin(hot) if hot else F.col(key).isNull()
    # The row's place in its partition: the same when a lost task runs again.
    turn = F.when(F.col(key).isNull(), F.monotonically_increasing_id()).otherwise(F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    salted = df.withColumn("_salt", F.when(spread, turn).otherwise(0))
    every = F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))
    copies = F.when(F.col("_dk").isin(hot), every).otherwise(F.array(F.lit(0).cast("bigint"))) if hot else F.array(F.lit(0).cast("bigint"))
    spread = entries.withColumn("_ds", F.explode(copies))
    match = (salted[key] == F.col("_dk")) & (salted["_salt"] == F.col("_ds"))
    return salted.join(spread, match, "left").drop("_dk", "_ds", "_salt")
