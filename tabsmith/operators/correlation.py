"""Pearson correlations over pairwise complete rows.

The Gram matrix is cut into tiles. A task multiplies its rows tile by tile and passes on one sum per pair of columns; Spark adds them
up by pair, and the coefficients are an expression over those sums. Pairs are rows of a table throughout: only those that a caller asks for
(the strong ones, a corner of the matrix) reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsmith.functions.expr import as_double, nan_to_null
from tabsmith.functions.jobs import checkpointed
from tabsmith.operators.stats import TableStats

#: Columns of a tile.
TILE = 256
#: Sums of a pair: rows, values and squares on either side, products.
SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def pair_sums(df: DataFrame, values: list[Column], centres: list[float], complete: bool) -> DataFrame:
    """(i, j, sums) for i < j: co-moments of all pairs of `values` over the rows that hold both, shifted by `centres`.

    Without missing values (`complete`) a task holds one number per pair, else six; rows of a wide table are read by no more
    tasks than there are cores, since each of them passes on all pairs once.
    """
    k = len(values)
    shift = np.array(centres, float)
    tiles = [(a, min(a + TILE, k)) for a in range(0, k, TILE)]
    pairs = [(s, t) for n, s in enumerate(tiles) for t in tiles[n:]]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, sx, sxx = {}, 0, np.zeros(k), np.zeros(k)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
            n += len(x)
            if complete:
                x -= shift
                sx += x.sum(0)
                sxx += (x * x).sum(0)
                for (a, b), (c, d) in pairs:
                    found = x[:, a:b].T @ x[:, c:d]
                    total[a, c] = total[a, c] + found if (a, c) in total else found
                continue
            mask = (~np.isnan(x)).astype(float)
            x = np.where(mask > 0, x - shift, 0.0)
            square = x * x
            for (a, b), (c, d) in pairs:
                m, w, y, z = mask[:, a:b].T, mask[:, c:d], x[:, a:b].T, x[:, c:d]
                found = np.stack([m @ w, y @ w, m @ z, square[:, a:b].T @ w, m @ square[:, c:d], y @ z])
                total[a, c] = total[a, c] + found if (a, c) in total else found
        for (a, b), (c, d) in pairs if n else []:
            i, j = np.meshgrid(np.arange(a, b), np.arange(c, d), indexing="ij")
            keep = i < j
            i, j = i[keep], j[keep]
            found = total.pop((a, c))
            if complete:
                sums = [np.full(len(i), float(n)), sx[i], sx[j], sxx[i], sxx[j], found[keep]]
            else:
                sums = [part[keep] for part in found]
            columns = [pa.array(i.astype("int32")), pa.array(j.astype("int32")), *map(pa.array, sums)]
            yield pa.RecordBatch.from_arrays(columns, names=["i", "j", *SUMS])

    if len(tiles) > 1:
        df = df.coalesce(max(1, df.sparkSession.sparkContext.defaultParallelism))
    schema = "i int, j int, " + ", ".join(f"{s} double" for s in SUMS)
    parts = df.select(*[v.alias(f"c{p}") for p, v in enumerate(values)]).mapInArrow(partial, schema)
    return parts.groupBy("i", "j").agg(*[F.sum(s).alias(s) for s in SUMS])


def pair_correlations(df: DataFrame, values: list[Column], centres: list[float], complete: bool) -> DataFrame:
    """(i, j, r) for i < j; r is NULL where a side does not vary over the common rows."""
    n = F.col("n")
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / n
    spread = lambda s, ss: F.sqrt(F.greatest(F.col(ss) - F.col(s) * F.col(s) / n, F.lit(0.0)))
    scale = spread("sx", "sxx") * spread("sy", "syy")
    defined = (n >= 2) & (scale > 0) & ~F.isnan(scale)
    return pair_sums(df, values, centres, complete).select("i", "j", F.when(defined, cov / scale).alias("r"))


def correlations(df: DataFrame, stats: TableStats, columns: list[str] | None = None) -> DataFrame | None:
    """(position_1, column_1, position_2, column_2, correlation) of the pairs of numeric columns that vary; None for fewer than two."""
    chosen = [s for s in stats.numeric if s.non_null > 1 and s.min != s.max]
    if columns is not None:
        chosen = [s for s in chosen if s.column_name in columns]
    names = [s.column_name for s in chosen]
    if len(names) < 2:
        return None
    complete = not any(s.missing_count for s in chosen)
    found = pair_correlations(nan_to_null(df), [as_double(n) for n in names], [s.mean for s in chosen], complete)
    # One row per column.
    named = df.sparkSession.createDataFrame(list(enumerate(names)), "p int, c string")
    first = F.broadcast(named.select(F.col("p").alias("i"), F.col("c").alias("column_1")))
    second = F.broadcast(named.select(F.col("p").alias("j"), F.col("c").alias("column_2")))
    return found.join(first, "i").join(second, "j").select(
        F.col("i").alias("position_1"), "column_1", F.col("j").alias("position_2"), "column_2", F.col("r").alias("correlation")
    )


def correlation_pairs(df: DataFrame, stats: TableStats) -> DataFrame:
    """Upper triangle of the matrix, rounded to 4 places; undefined pairs are NULL. A written table: reports ask it several times."""
    found = correlations(df, stats)
    if found is None:
        return df.sparkSession.createDataFrame([], "position_1 int, column_1 string, position_2 int, column_2 string, correlation double")
    return checkpointed(found.withColumn("correlation", F.round("correlation", 4)))


def correlation_matrix(pairs: DataFrame, max_columns: int = 15) -> DataFrame:
    """Long square matrix of the first columns; undefined correlations show as 0."""
    ends = F.array(
        F.struct(F.col("position_1").alias("p"), F.col("column_1").alias("c")),
        F.struct(F.col("position_2").alias("p"), F.col("column_2").alias("c")),
    )
    diagonal = (
        pairs.select(F.inline(ends))
        .distinct()
        .select(F.col("p").alias("position_1"), F.col("c").alias("column_1"), F.col("p").alias("position_2"),
                F.col("c").alias("column_2"), F.lit(1.0).alias("correlation"))
    )
    swapped = pairs.select(
        F.col("position_2").alias("position_1"), F.col("column_2").alias("column_1"),
        F.col("position_1").alias("position_2"), F.col("column_1").alias("column_2"), "correlation",
    )
    full = pairs.unionByName(swapped).unionByName(diagonal)
    return full.filter((F.col("position_1") < max_columns) & (F.col("position_2") < max_columns)).select(
        "column_1", "column_2", F.coalesce("correlation", F.lit(0.0)).alias("correlation")
    )


def strong_pairs(pairs: DataFrame, threshold: float = 0.70) -> DataFrame:
    """Pairs with |r| at or above the threshold, strongest first."""
    strong = pairs.filter(F.abs("correlation") >= threshold)
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc("abs_correlation"), "position_1", "position_2")
    return (
        strong.withColumn("abs_correlation", F.round(F.abs("correlation"), 4))
        .withColumn("rank", F.row_number().over(order))
        .select("rank", "column_1", "column_2", "correlation", "abs_correlation")
    )
