"""Train/test splits as pure row filters.

A row goes to the test side when its hash is among the smallest of its class. The
cut value per class is found by exact rank selection, so the split needs no sort and no
shuffle of rows: both sides are filters over the source, stay the same when an
executor is lost, and need not be stored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsmith.functions.expr import as_text, col, is_nested, nan_to_null
from tabsmith.functions.jobs import checkpointed
from tabsmith.functions.quantiles import select_ranks

RID = "_tabsmith_row"
# Classes whose labels a learner can hold; splits have no such limit.
MAX_CLASSES = 10_000
# Up to so many classes have their cuts in the filter itself; more are looked up in a table.
FILTER_CLASSES = 48
# Classes of a table that is broadcast at most, and buckets that a bracket of a class is cut into.
BROADCAST_CLASSES = 200_000
HASH_BUCKETS = 256


def drop_missing_target(df: DataFrame, target: str) -> DataFrame:
    """Rows with a target; NaN counts as missing."""
    return nan_to_null(df).filter(col(target).isNotNull())


def class_counts(df: DataFrame, target: str) -> dict:
    """Rows per class; refuses a target that is no set of classes."""
    grouped = df.groupBy(col(target).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    rows = grouped.limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"Target column '{target}' has more than {MAX_CLASSES} distinct values, which are no classes.")
    return {r["y"]: r["n"] for r in sorted(rows, key=lambda r: (r["y"] is None, r["y"]))}


def _few_classes(df: DataFrame, target: str) -> dict | None:
    """Rows per class, or None for more than ``FILTER_CLASSES``."""
    rows = df.groupBy(col(target).alias("y")).agg(F.count(F.lit(1)).alias("n")).limit(FILTER_CLASSES + 1).collect()
    return {r["y"]: r["n"] for r in sorted(rows, key=lambda r: (r["y"] is None, r["y"]))} if len(rows) <= FILTER_CLASSES else None


def check_classes(counts: dict, target: str, on_rare_class: str = "error") -> bool:
    """Whether the split can be stratified; errors where classification is impossible."""
    counts = {k: n for k, n in counts.items() if k is not None}
    if sum(counts.values()) < 2:
        raise ValueError(f"Target column '{target}' has fewer than two non-missing values.")
    if len(counts) < 2:
        raise ValueError(f"Target column '{target}' has only {len(counts)} distinct class(es); at least 2 are required.")
    rare = sorted(str(k) for k, n in counts.items() if n < 2)
    if rare and on_rare_class == "error":
        raise ValueError(f"Target column '{target}' has rare classes with fewer than 2 samples: {rare}.")
    return not rare


def predictors(df: DataFrame, target: str, leakage: list[str]) -> list[str]:
    left = [c for c in df.columns if c != target and c not in set(leakage)]
    if not left:
        raise ValueError(f"No predictor columns remain without the target '{target}' and the leakage columns.")
    return left


def test_quotas(counts: dict, test_size: float) -> dict:
    """Test rows per stratum: ceil(n * size) in total, shares by largest remainder."""
    n = sum(counts.values())
    n_test = math.ceil(n * test_size)
    n_train = n - n_test
    if n_train < 1 or n_test < 1:
        raise ValueError("Both sides of a split need at least one row.")
    exact = {k: n_train * c / n for k, c in counts.items()}
    train = {k: math.floor(v) for k, v in exact.items()}
    left = n_train - sum(train.values())
    order = sorted(counts, key=lambda k: -(exact[k] - train[k]))
    for k in order[:left]:
        train[k] += 1
    return {k: counts[k] - train[k] for k in counts}


def row_hash(df: DataFrame, key: list[str] | None, seed: int) -> Column:
    """53-bit row hash as a double (exact); of the key, or of the whole row."""
    chosen = [f for f in df.schema.fields if key is None or f.name in key]
    parts = [as_text(f.name, f.dataType) if is_nested(f.dataType) else col(f.name) for f in chosen]
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *parts), 11).cast("double")


def holdout_split(
    df: DataFrame,
    target: str | None = None,
    test_size: float = 0.20,
    seed: int = 42,
    key: list[str] | None = None,
    on_rare_class: str = "error",
) -> tuple[DataFrame, DataFrame]:
    """(train, test) with exact sizes; class shares are kept when a target is given.

    ``key`` names the columns that identify a row; without it the whole row is hashed.
    """
    counts = {None: df.count()}
    strata: Column | None = None
    if target is not None:
        by_class = _few_classes(df, target)
        if by_class is None:
            table = _class_table(df, target, on_rare_class)
            if table is not None:
                return _split_by_table(df, target, _table_quotas(table, counts[None], test_size), seed, key)
        elif check_classes(by_class, target, on_rare_class):
            counts, strata = by_class, col(target)
    quotas = {k: q for k, q in test_quotas(counts, test_size).items() if q > 0}
    h = row_hash(df, key, seed)
    classes = list(quotas)

    def of(c) -> Column:
        return F.lit(True) if strata is None else strata.eqNullSafe(F.lit(c))

    cuts = select_ranks(
        df,
        [F.when(of(c), h) for c in classes],
        [counts[c] for c in classes],
        [[quotas[c] - 1] for c in classes],
        [(0.0, float(2**53))] * len(classes),
    )
    cut = {c: found[quotas[c] - 1] for c, found in zip(classes, cuts)}
    limit = F.lit(-1.0)
    for c in classes:
        limit = F.when(of(c), F.lit(cut[c])).otherwise(limit)
    tally = (
        df.select((F.lit(None) if strata is None else strata).alias("y"), h.alias("h"), limit.alias("limit"))
        .groupBy("y")
        .agg(F.count_if(F.col("h") < F.col("limit")).alias("less"), F.count_if(F.col("h") == F.col("limit")).alias("same"))
        .collect()
    )
    found = {r["y"]: r for r in tally}
    tied = [c for c in classes if found[c]["less"] + found[c]["same"] > quotas[c]]
    chosen = h <= limit
    if tied:
        # Copies of one row share a hash: pick the exact number by their stored row id.
        df = checkpointed(df.withColumn(RID, F.monotonically_increasing_id()))
        h = row_hash(df.drop(RID), key, seed)
        need = {c: quotas[c] - found[c]["less"] for c in tied}
        rid = F.col(RID).cast("double")
        ids = select_ranks(
            df,
            [F.when(of(c) & (h == F.lit(cut[c])), rid) for c in tied],
            [found[c]["same"] for c in tied],
            [[need[c] - 1] for c in tied],
        )
        last = F.lit(float("inf"))
        for c, got in zip(tied, ids):
            last = F.when(of(c), F.lit(got[need[c] - 1])).otherwise(last)
        chosen = (h < limit) | ((h == limit) & (rid <= last))
    test = df.filter(chosen)
    train = df.filter(~chosen)
    return train.drop(RID), test.drop(RID)


def _class_table(df: DataFrame, target: str, on_rare_class: str) -> DataFrame | None:
    """(y, n) of every class, NULL too, stored; None where the split cannot be stratified. A single NULL is no rare class."""
    table = checkpointed(df.groupBy(col(target).alias("y")).agg(F.count(F.lit(1)).alias("n")))
    rare = [str(r["y"]) for r in table.filter("n < 2 and y is not null").orderBy("y").limit(20).collect()]
    if rare and on_rare_class == "error":
        raise ValueError(f"Target column '{target}' has rare classes with fewer than 2 samples: {rare}.")
    return None if rare else table


def _table_quotas(table: DataFrame, n: int, test_size: float) -> DataFrame:
    """(y, quota): test rows per class by largest remainder, as ``test_quotas`` finds them for few classes."""
    n_train = n - math.ceil(n * test_size)
    if n_train < 1 or n_train == n:
        raise ValueError("Both sides of a split need at least one row.")
    exact = F.col("n") * F.lit(float(n_train)) / F.lit(float(n))
    shares = table.select("y", "n", F.floor(exact).alias("train"), (exact - F.floor(exact)).alias("rest"))
    left = n_train - shares.agg(F.sum("train")).first()[0]
    more = shares.orderBy(F.desc("rest"), F.asc_nulls_last("y")).limit(left).select(F.col("y").alias("_y"), F.lit(1).alias("one"))
    joined = shares.join(more, F.col("y").eqNullSafe(F.col("_y")), "left")
    return checkpointed(joined.select("y", (F.col("n") - F.col("train") - F.coalesce("one", F.lit(0))).alias("quota")))


def _split_by_table(df: DataFrame, target: str, quotas: DataFrame, seed: int, key: list[str] | None) -> tuple[DataFrame, DataFrame]:
    """The split for any number of classes: one row per class says where its test rows end."""
    wanted = quotas.filter("quota > 0")
    rows, rid = df, F.lit(0)
    h = row_hash(df, key, seed).cast("bigint")
    cuts = _ranked(df.select(col(target).alias("y"), h.alias("v")), wanted.select("y", F.col("quota").alias("place")))
    known = cuts.select(F.col("y").alias("_y"), F.col("v").alias("_h"), F.lit(0).cast("bigint").alias("_rid"))
    tied = cuts.filter("place < n").select(F.col("y").alias("_y"), F.col("v").alias("_h"), "place")
    if not tied.isEmpty():
        # Copies of one row share a hash: their stored row id decides.
        rows, rid = checkpointed(df.withColumn(RID, F.monotonically_increasing_id())), F.col(RID)
        h = row_hash(rows.drop(RID), key, seed).cast("bigint")
        copies = rows.select(col(target).alias("y"), h.alias("h"), F.col(RID).alias("v")).join(_sent(tied.drop("place")), col("y").eqNullSafe(F.col("_y")) & (F.col("h") == F.col("_h")))
        last = _ranked(copies.select("y", "v"), tied.select(F.col("_y").alias("y"), "place"))
        last = last.select(F.col("y").alias("_ty"), F.col("v").alias("_last"))
        # Without a tie every row of the cut hash is a test row.
        every = F.lit(2**63 - 1)
        known = known.join(last, F.col("_y").eqNullSafe(F.col("_ty")), "left").select("_y", "_h", F.coalesce("_last", every).alias("_rid"))
    placed = rows.withColumns({"_hash": h, "_row": rid.cast("bigint")}).join(_sent(known), col(target).eqNullSafe(F.col("_y")), "left")
    chosen = F.coalesce((F.col("_hash") < F.col("_h")) | ((F.col("_hash") == F.col("_h")) & (F.col("_row") <= F.col("_rid"))), F.lit(False))
    return tuple(placed.filter(side).select(*[col(c) for c in df.columns]) for side in (~chosen, chosen))


def _sent(by_class: DataFrame) -> DataFrame:
    """A table of one row per class, broadcast if it is small."""
    return F.broadcast(by_class) if by_class.count() <= BROADCAST_CLASSES else by_class


def _ranked(rows: DataFrame, places: DataFrame) -> DataFrame:
    """The value (bigint ``v``, 0 or more) at a place (from 1) among the rows of its class: (y, v, place, n).

    ``n`` counts the rows of that value, ``place`` is the place among them. Each pass counts the buckets of every class's bracket and
    narrows it to the bucket that holds the place, until it holds one value: rows are only ever counted, so that
    any number of equal ones costs one entry per task and pass.
    """
    edges = rows.groupBy("y").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n"))
    wanted = places.select(F.col("y").alias("_y"), "place")
    brackets = checkpointed(edges.join(wanted, F.col("y").eqNullSafe(F.col("_y"))).select("y", "lo", "hi", "place", "n"))
    found = []
    while True:
        found.append(brackets.filter("lo = hi").select("y", F.col("lo").alias("v"), "place", "n"))
        open_ = brackets.filter("lo < hi")
        if open_.isEmpty():
            break
        known = _sent(open_.select(F.col("y").alias("_y"), "lo", "hi"))
        # Rounding keeps the order, and both ends of a bracket lie in different buckets.
        share = (F.col("v") - F.col("lo")).cast("double") / ((F.col("hi") - F.col("lo")).cast("double") + 1)
        inside = rows.join(known, col("y").eqNullSafe(F.col("_y")) & F.col("v").between(F.col("lo"), F.col("hi")))
        held = inside.groupBy("y", F.floor(share * HASH_BUCKETS).alias("bucket")).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n"))
        # At most HASH_BUCKETS + 1 rows per class.
        before = F.sum("n").over(Window.partitionBy("y").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
        held = held.withColumn("before", F.coalesce(before, F.lit(0)))
        placed = held.join(_sent(open_.select(F.col("y").alias("_y"), "place")), col("y").eqNullSafe(F.col("_y")))
        placed = placed.filter((F.col("before") < F.col("place")) & (F.col("place") <= F.col("before") + F.col("n")))
        brackets = checkpointed(placed.select("y", "lo", "hi", (F.col("place") - F.col("before")).alias("place"), "n"))
    return checkpointed(reduce(DataFrame.union, found))


def class_distribution(train: DataFrame, test: DataFrame, target: str) -> DataFrame:
    """Rows per side and class."""
    sides = [
        d.groupBy(F.lit(name).alias("split"), col(target).cast("string").alias("class")).agg(
            F.count(F.lit(1)).alias("class_count")
        )
        for name, d in (("train", train), ("test", test))
    ]
    return sides[0].unionByName(sides[1])
