"""Mixing sources to target weights by exponential keys (Efraimidis and Spirakis), as DataFrame expressions only.

Each document draws the key -ln(u) / weight, u from a hash of its id; sorted by key, the documents of a source are a weighted
sample without replacement, whatever its length. A source's target buys whole passes over it first; the rest buys a
prefix of the sorted documents. The prefix's end is found from token sums per key bucket, and only the bucket
that holds the end is sorted, so no source, however hot, meets in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabsmith.llm.common import CARRIED, WORD, packed, stored, unpacked

#: Buckets of keys in each source; the last one taken is sorted.
BUCKETS = 4096
#: Sources that are sent to all tasks at most; above, they are joined by a shuffle.
BROADCAST_SOURCES = 100_000
#: Symbols that mark poor text.
SYMBOLS = "#*$%&|<>"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column, size: Column) -> Column:
    """1 for plain text, less with more symbols a word: size / (size + symbols)."""
    symbols = F.coalesce(F.length(text) - F.length(F.translate(text, SYMBOLS, "")), F.lit(0))
    return F.greatest(size, F.lit(1)) / (F.greatest(size, F.lit(1)) + symbols)


def uniform(id_: Column, copy: Column) -> Column:
    """A number between 0 and 1 from the first 52 bits of an MD5 of the id, and of the copy's number from the second copy on."""
    seed = F.concat(F.coalesce(id_.cast("string"), F.lit("")), F.when(copy > 0, F.concat(F.lit(":"), copy.cast("string"))).otherwise(""))
    bits = F.conv(F.substring(F.md5(seed.cast("binary")), 1, 13), 16, 10)
    return (bits.cast("double") + 0.5) / F.lit(float(1 << 52))


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: Sequence[str] = ()) -> DataFrame:
    """id, source, `_size`, `_weight` (and `carry`) of each row."""
    text = F.col(text_col)
    rows = docs.select(*dict.fromkeys([id_col, source_col, *carry]), word_count(text).alias("_size"), text.alias("_text"))
    return rows.select("*", quality_weight(F.col("_text"), F.col("_size")).alias("_weight")).drop("_text")


def with_keys(rows: DataFrame, id_col: str, copy: Column) -> DataFrame:
    return rows.withColumn("_key", -F.log(uniform(F.col(id_col), copy)) / F.col("_weight"))


def copy_numbers(rows: DataFrame, alike: Sequence[str]) -> DataFrame:
    """(`_place`, `_copy`) of the rows with a `_place` that are not the first ones equal in the columns `alike`, numbered from 1.

    Rows are numbered within stretches of 65,536 places, and stretches by the counts of those before, so copies of
    one row, however many, never meet in one task.
    """
    rows = rows.select("_place", *alike).withColumn("_run", F.shiftright("_place", 16))
    counts = rows.groupBy("_run", *alike).count()
    before = F.sum("count").over(W.partitionBy(*alike).orderBy("_run").rowsBetween(W.unboundedPreceding, -1))
    counts = counts.select("_run", *alike, F.coalesce(before, F.lit(0)).alias("_before"))
    inner = F.row_number().over(W.partitionBy("_run", *alike).orderBy("_place")) - 1
    placed = rows.withColumn("_inner", inner).where((F.col("_inner") > 0) | (F.col("_run") > 0)).alias("x")
    same = F.col("x._run") == F.col("y._run")
    for c in alike:
        same &= F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}"))
    numbered = placed.join(counts.alias("y"), same).select("x._place", (F.col("y._before") + F.col("x._inner")).alias("_copy"))
    return numbered.where("_copy > 0")


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """`target` of each source: its weight's share of all sizes, at most `most` times its size, the excess reshared by weight.

    Takes one row per source (`source`, `source_size`). Resharing until nothing is above its limit ends where every source
    below its limit has the same target per weight; that level is found from running sums over the sources in the
    order in which they reach their limits.
    """
    ranked = sizes.select("source", "source_size", (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1).alias("n"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("n") % len(weights) + 1).cast("int"))
    rows = ranked.select("source", "source_size", "n", weight.alias("w"), (F.col("source_size") * most).alias("most"))
    order = W.orderBy(F.col("most") / F.col("w"), "n")
    full = F.coalesce(F.sum("most").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("w").over(order.rowsBetween(0, W.unboundedFollowing))
    level = (F.sum("source_size").over(W.partitionBy()) * share - full) / left
    stepped = rows.withColumn("level", level)
    fits = F.when(F.col("level") * F.col("w") <= F.col("most"), F.struct(F.col("most") / F.col("w"), "n", "level"))
    shared = stepped.withColumn("shared", F.min(fits).over(W.partitionBy()))
    return shared.select("source", "source_size", F.coalesce(F.least("most", F.col("shared.level") * F.col("w")), F.col("most")).alias("target"))


def source_plan(rows: DataFrame, id_col: str, source_col: str, weights: Sequence[float], share: float, most: int, buckets: int) -> DataFrame:
    """Per source: `source_size`, `target`, `passes` over all of it, and the place (`last`) of the last document taken once more."""
    rows = rows.withColumnRenamed(source_col, "source")
    bucket = F.floor((1 - F.exp(-F.col("_key"))) * buckets)
    counted = stored(rows.groupBy("source", bucket.alias("bucket")).agg(F.sum("_size").alias("words")))
    plan = targets(counted.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = plan.withColumn("passes", passes).withColumn("budget", F.col("target") - F.col("passes") * F.col("source_size"))
    before = F.sum("words").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    running = counted.withColumn("before", F.coalesce(before, F.lit(0)))
    plan = stored(plan)
    ends = _by_source(running, plan, "source").where(F.col("before") < F.col("budget"))
    # The last bucket that begins within the budget: every earlier one is taken as a whole.
    ends = stored(ends.groupBy("source").agg(F.max(F.struct("bucket", "before", "budget")).alias("end")).select("source", "end.*"))
    inside = _by_source(rows.withColumn("at", bucket), ends, "source").where(F.col("at") == F.col("bucket"))
    place = F.struct(F.col("_key").alias("key"), F.col(id_col).alias("id"), F.col("_size").alias("size"))
    sorted_ = W.partitionBy("source").orderBy("_key", id_col, "_size").rowsBetween(W.unboundedPreceding, -1)
    inside = inside.withColumn("ahead", F.col("before") + F.coalesce(F.sum("_size").over(sorted_), F.lit(0)))
    inside = inside.where(F.col("ahead") + F.col("_size") / 2 <= F.col("budget"))
    last = inside.groupBy("source").agg(F.max(place).alias("last"))
    bucketed = ends.select(F.col("source").alias("_s"), F.col("bucket").alias("end_bucket"))
    plan = plan.join(last.withColumnRenamed("source", "_l"), F.col("source").eqNullSafe(F.col("_l")), "left").drop("_l")
    return stored(plan.join(bucketed, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s"))


def _by_source(rows: DataFrame, plan: DataFrame, source: str) -> DataFrame:
    """Rows with their source's line of the plan. A plan of few sources is sent to all tasks, so that no source is shuffled."""
    plan = plan.withColumnRenamed("source", "_source")
    if plan.count() <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    return rows.join(plan, F.col(source).eqNullSafe(F.col("_source"))).drop("_source")


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.0,
    most: int = 3,
    buckets: int = BUCKETS,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    carry: Sequence[str] = (),
) -> DataFrame:
    """Per row: id, source, `carry`, `size` (words), `source_size`, `target` (words of its source), `copies` and `taken` (words of all copies).

    Sources in order of code points, NULL last and a source of its own, have the weights by turns. NULL texts have size 0 and are
    never needed. A source of size 0 has target 0. Ties of keys are broken by id, then size. Rows that are equal in source, id, size and
    weight draw keys of their own, by their number among them. Reruns take the same documents. An empty table gives no rows. Other
    columns may have any names.
    """
    # Sizes and weights cost a look at the whole texts, so the plan reads a small table of them.
    small = stored(sized(docs, id_col, text_col, source_col))
    alike = [source_col, id_col, "_size", "_weight"]
    if small.groupBy(*alike).count().where("count > 1").isEmpty():
        first = F.lit(0)
        rows, small = with_keys(sized(docs, id_col, text_col, source_col, carry), id_col, first), with_keys(small, id_col, first)
    else:
        # Numbers of copies hold for one reading of the rows only, so the rows are written with their places.
        placed = stored(sized(docs, id_col, text_col, source_col, carry).withColumn("_place", F.monotonically_increasing_id()))
        copies = placed.join(stored(copy_numbers(placed, alike)), "_place", "left")
        rows = stored(with_keys(copies, id_col, F.coalesce("_copy", F.lit(0))).drop("_place", "_copy"))
        small = rows.select(*dict.fromkeys([id_col, source_col]), "_size", "_key")
    plan = source_plan(small, id_col, source_col, weights, share, most, buckets)
    joined = _by_source(rows, plan, source_col)
    at = F.floor((1 - F.exp(-F.col("_key"))) * buckets)
    place = F.struct(F.col("_key").alias("key"), F.col(id_col).alias("id"), F.col("_size").alias("size"))
    more = (at < F.coalesce("end_bucket", F.lit(-1))) | F.coalesce((at == F.col("end_bucket")) & (place <= F.col("last")), F.lit(False))
    copies = F.col("passes") + F.when(more, 1).otherwise(0)
    keep = [F.col(c) for c in dict.fromkeys([id_col, source_col, *carry])]
    return joined.select(*keep, F.col("_size").alias("size"), "source_size", "target", copies.cast("int").alias("copies"), (copies * F.col("_size")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix: each row as often as the mix takes it."""
    own = ["doc_id", "text", "source"]
    seen = mix(packed(docs, own), carry=("text", CARRIED), **options).where(F.col("copies") > 0)
    repeated = seen.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies"))))
    return unpacked(repeated, docs.columns, own)


#: The mix of the registered query over `documents`, for DuckDB.
MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), weighted AS (
  SELECT doc_id, source, size, greatest(size, 1)::DOUBLE / (greatest(size, 1) + coalesce(length(text) - length(translate(text, '#*$%&|<>', '')), 0)) AS weight FROM sized
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY source, doc_id, size, weight) - 1 AS copy FROM weighted
), keyed AS (
  SELECT doc_id, source, size,
    -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || CASE WHEN copy > 0 THEN ':' || copy ELSE '' END), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0) / weight AS key
  FROM numbered
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT source, source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS n FROM sources
), weighed AS (
  SELECT source, source_size, n, CASE n % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, source_size * 3.0::DOUBLE AS most FROM ranked
), stepped AS (
  SELECT *, (sum(source_size) OVER () ::DOUBLE
      - coalesce(sum(most) OVER (ORDER BY most / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY most / w, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed
), levels AS (
  SELECT level FROM stepped WHERE level * w <= most ORDER BY most / w, n LIMIT 1
), planned AS (
  SELECT source, source_size, coalesce(least(most, (SELECT level FROM levels) * w), most) AS target FROM stepped
), passes AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS passes FROM planned
), placed AS (
  SELECT k.doc_id, k.size, p.source_size, p.target, p.passes, p.target - p.passes * p.source_size AS budget,
    coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM keyed k JOIN passes p ON k.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target,
  (size * (passes + CASE WHEN budget > 0 AND ahead + size / 2.0 <= budget THEN 1 ELSE 0 END))::BIGINT AS taken
FROM placed
"""
