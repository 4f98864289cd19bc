"""Classification metrics from a scored table.

Everything but the ROC area is derived from the confusion counts: one aggregation of the
scored rows to classes x classes, then arithmetic over those few rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabsmith.functions.jobs import checkpointed, together

# Cells that the scores of a class are counted in: at first, and each of those again whose order matters.
COARSE_CELLS, FINE_CELLS = 1024, 64
# Rows of a table of cells that is broadcast at most.
BROADCAST_CELLS = 500_000
# Different scores that a task counts one by one: of a class, and of all classes together.
CLASS_SCORES, TASK_SCORES = 4096, 262_144
# Scores that a task sorts at once.
BLOCK_SCORES = 1_048_576
_MIXED = "pos > 0 and neg > 0 and lo < hi"


def confusion_counts(scored: DataFrame, truth: str, predicted: str) -> DataFrame:
    return scored.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("cnt")
    )


def confusion_matrix(scored: DataFrame, truth: str, predicted: str, labels: list) -> DataFrame:
    """Zero-filled (truth, predicted, cnt) over a fixed label order."""
    grid = label_grid(scored.sparkSession, labels, scored.schema[truth].dataType.simpleString())
    counts = confusion_counts(scored, truth, predicted)
    return grid.join(counts, ["truth", "predicted"], "left").select(
        "truth", "predicted", F.coalesce("cnt", F.lit(0)).cast("bigint").alias("cnt")
    )


def label_grid(spark: SparkSession, labels: list, kind: str) -> DataFrame:
    """All pairs (truth, predicted) of the labels."""
    k = len(labels)
    named = F.broadcast(spark.createDataFrame(list(enumerate(labels)), f"place bigint, label {kind}"))
    # Only the labels leave the driver; the pairs are numbers that the executors count out.
    pairs = spark.range(k * k).select(F.floor(F.col("id") / F.lit(max(k, 1))).alias("t"), (F.col("id") % F.lit(max(k, 1))).alias("p"))
    grid = pairs.join(named.select(F.col("place").alias("t"), F.col("label").alias("truth")), "t")
    return grid.join(named.select(F.col("place").alias("p"), F.col("label").alias("predicted")), "p").select("truth", "predicted")


def class_report(counts: DataFrame) -> DataFrame:
    """precision, recall, f1 and support of every class seen in truth or prediction."""
    sides = counts.select(
        F.inline(
            F.array(
                F.struct(F.col("truth").alias("class"), F.col("cnt").alias("support"), F.lit(0).cast("bigint").alias("chosen"), _hit().alias("hits")),
                F.struct(F.col("predicted").alias("class"), F.lit(0).cast("bigint").alias("support"), F.col("cnt").alias("chosen"), F.lit(0).cast("bigint").alias("hits")),
            )
        )
    )
    per = sides.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("support", "chosen", "hits")])
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    with_pr = per.select(
        "class", "support", "hits",
        ratio(F.col("hits"), F.col("chosen")).alias("precision"), ratio(F.col("hits"), F.col("support")).alias("recall"),
    )
    f1 = ratio(F.col("precision") * F.col("recall") * 2, F.col("precision") + F.col("recall"))
    return with_pr.withColumn("f1", f1).filter("support > 0 or precision is not null")


def _hit() -> Column:
    return F.when(F.col("truth") == F.col("predicted"), F.col("cnt")).otherwise(F.lit(0)).cast("bigint")


def averages(report: DataFrame) -> DataFrame:
    """accuracy, macro (plain mean over classes) and weighted (by support) averages."""
    w = F.sum("support").cast("double")
    weighted = lambda c: F.coalesce(F.try_divide(F.sum(F.col(c) * F.col("support")), w), F.lit(0.0))
    return report.agg(
        F.coalesce(F.try_divide(F.sum("hits").cast("double"), w), F.lit(0.0)).alias("accuracy"),
        *[F.avg(c).alias(f"{c}_macro") for c in ("precision", "recall", "f1")],
        *[weighted(c).alias(f"{c}_weighted") for c in ("precision", "recall", "f1")],
    )


def full_class_report(counts: DataFrame) -> DataFrame:
    """Per-class rows plus accuracy, macro and weighted rows, rounded to 4 places."""
    report = class_report(counts)
    r4 = [F.round(c, 4).alias(c) for c in ("precision", "recall", "f1")]
    rows = report.select(F.col("class").cast("string").alias("label"), *r4, "support")
    total = report.agg(F.sum("support").alias("support"), F.sum("hits").alias("hits"),
                       *[F.avg(c).alias(f"m_{c}") for c in ("precision", "recall", "f1")],
                       *[F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support").cast("double")).alias(f"w_{c}") for c in ("precision", "recall", "f1")])
    accuracy = F.try_divide(F.col("hits").cast("double"), F.col("support").cast("double"))
    summary = total.select(
        F.inline(
            F.array(
                F.struct(F.lit("accuracy").alias("label"), *[F.round(accuracy, 4).alias(c) for c in ("precision", "recall", "f1")], F.col("support")),
                F.struct(F.lit("macro avg").alias("label"), *[F.round(f"m_{c}", 4).alias(c) for c in ("precision", "recall", "f1")], F.col("support")),
                F.struct(F.lit("weighted avg").alias("label"), *[F.round(f"w_{c}", 4).alias(c) for c in ("precision", "recall", "f1")], F.col("support")),
            )
        )
    )
    return rows.unionByName(summary)


def roc_auc_by_class(scored: DataFrame, truth: str, scores: dict[object, Column], parts: int | None = None) -> DataFrame:
    """Exact one-vs-rest ROC area per class: (class_index, auc), NULL when undefined.

    One pass counts the scores of every class one by one, as long as a task meets few different ones. The other classes are
    counted in cells twice, coarse and fine. A cell whose rows are all positive, all negative, or of one score needs no order
    inside, so it is one entry whatever its rows. Only rows of the other fine cells are shuffled, combined by (class, score).
    The entries are range-partitioned and summed up inside each range; what is above a range comes from one total per range,
    so no task ever sees all scores.
    """
    spark = scored.sparkSession
    parts = parts or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # One entry per class and score; a class that a task has not counted out has its ends there.
    counted = checkpointed(
        _tasks_tally(_score_rows(scored, truth, scores), len(scores)).groupBy("k", "lo", "hi").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    )
    # One row per class.
    edges = counted.groupBy("k").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.bool_or(F.col("lo") < F.col("hi")).alias("open"))
    left = [r["k"] for r in edges.filter("open").select("k").collect()]
    tally = counted.filter(~F.col("k").isin(left)).select("k", F.col("lo").alias("score"), "pos", "neg")
    if left:
        some = {c: s if i in left else F.lit(None) for i, (c, s) in enumerate(scores.items())}
        rows = _score_rows(scored, truth, some).filter("place is not null").select(F.posexplode_outer("scores").alias("k", "score"), "place")
        long = rows.filter("score is not null").select("k", "score", (F.col("k") == F.col("place")).cast("int").alias("hit"))
        tally = tally.unionByName(score_tally(long, edges.filter("open").drop("open")))
    return auc_of_tally(tally, parts)


def _score_rows(scored: DataFrame, truth: str, scores: dict[object, Column]) -> DataFrame:
    """(scores, place): the scores of a row by class, and which class it is of: -1 for none of them, NULL if that cannot be told.

    `exists` keeps Spark from generating one method for the whole row: beyond 8,000 bytes of code the JVM interprets it.
    """
    hits = {i: F.col(truth) == F.lit(c) for i, c in enumerate(scores) if c is not None}
    known = F.exists(F.array(next(iter(hits.values()), F.lit(None).cast("boolean"))), lambda h: h.isNotNull())
    # One flat chain, whatever the number of classes.
    place = F.when(~known, F.lit(None).cast("int"))
    for i, hit in hits.items():
        place = place.when(hit, F.lit(i))
    values = [F.lit(None).cast("double") if c is None else s.cast("double") for c, s in scores.items()]
    return scored.select(F.array(*values).alias("scores"), place.otherwise(F.lit(-1)).alias("place"))


def _tasks_tally(rows: DataFrame, classes: int) -> DataFrame:
    """(k, lo, hi, pos, neg) of each task: an entry per score (lo = hi), or the ends alone of a class with more scores than a task holds."""
    most, block = min(CLASS_SCORES, max(64, TASK_SCORES // max(classes, 1))), max(1, BLOCK_SCORES // max(classes, 1))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # By class: its different scores in order, rows and positive rows of each; rows and positive rows of NaN.
        values, rows_of = [np.empty(0)] * classes, [np.zeros((2, 0), np.int64)] * classes
        missing, ends = np.zeros((classes, 2), np.int64), {}
        for batch in batches:
            place, x = batch.column(1).fill_null(-2).to_numpy(), batch.column(0).flatten()
            there = None if not x.null_count else x.is_valid().to_numpy(zero_copy_only=False).reshape(-1, classes)
            x = x.to_numpy(zero_copy_only=False).reshape(-1, classes)
            for start in range(0, len(x), block):
                own, known = place[start : start + block], place[start : start + block] > -2
                columns = np.ascontiguousarray(x[start : start + block].T)
                for k in range(classes):
                    score, hit = columns[k], own == k
                    if there is not None or not known.all():
                        kept = known if there is None else known & there[start : start + block, k]
                        score, hit = score[kept], hit[kept]
                    if not len(score):
                        continue
                    if k in ends:
                        ends[k] = np.fmin(ends[k][0], np.fmin.reduce(score)), np.maximum(ends[k][1], score.max())
                        continue
                    good, score = np.sort(score[hit]), np.sort(score)
                    # NaN comes last.
                    n, n_good = np.searchsorted(score, np.nan), np.searchsorted(good, np.nan)
                    missing[k] += len(score) - n, len(good) - n_good
                    score, good = score[:n], good[:n_good]
                    first = np.flatnonzero(np.concatenate([[True], score[1:] != score[:-1]])) if n else np.empty(0, np.int64)
                    found = score[first]
                    at = np.searchsorted(values[k], found)
                    new = np.ones(len(found), bool)
                    new[at < len(values[k])] = values[k][at[at < len(values[k])]] != found[at < len(values[k])]
                    if len(values[k]) + new.sum() > most:
                        both = np.concatenate([values[k], found])
                        ends[k] = both.min(), np.nan if missing[k][0] else both.max()
                        values[k], rows_of[k], missing[k] = np.empty(0), np.zeros((2, 0), np.int64), 0
                        continue
                    if new.any():
                        values[k], rows_of[k] = np.insert(values[k], at[new], found[new]), np.insert(rows_of[k], at[new], 0, axis=1)
                        at = np.searchsorted(values[k], found)
                    rows_of[k][0, at] += np.diff(first, append=n)
                    rows_of[k][1] += np.bincount(np.searchsorted(values[k], good), minlength=len(values[k]))
        for k in range(classes):
            if k in ends:
                lo, hi, rows_k = [ends[k][0]], [ends[k][1]], np.zeros((2, 1), np.int64)
            else:
                nan = int(missing[k][0] > 0)
                lo = hi = np.concatenate([values[k], np.full(nan, np.nan)])
                rows_k = np.concatenate([rows_of[k], missing[k][:, None][:, :nan]], axis=1)
            if len(lo):
                columns = [np.full(len(lo), k, np.int32), np.asarray(lo, float), np.asarray(hi, float), rows_k[1], rows_k[0] - rows_k[1]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["k", "lo", "hi", "pos", "neg"])

    return rows.mapInArrow(tally, "k int, lo double, hi double, pos bigint, neg bigint")


def score_tally(long: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """(k, score, pos, neg) from (k, score, hit): in the order of scores, and complete for every pair of unlike rows.

    `edges`: (k, lo, hi), the least and the greatest score of each class, where they are known.
    """
    counted = [F.sum("hit").alias("pos"), F.sum(F.lit(1) - F.col("hit")).alias("neg")]
    ends = [F.min("score").alias("lo"), F.max("score").alias("hi")]
    entry = ["k", F.col("lo").alias("score"), "pos", "neg"]
    # One row per class.
    edges = edges if edges is not None else checkpointed(long.groupBy("k").agg(*ends))
    coarse = long.join(F.broadcast(edges), "k").select("k", "score", "hit", _cell(COARSE_CELLS).alias("cell"))
    cells = checkpointed(coarse.groupBy("k", "cell").agg(*ends, *counted))
    known = cells.filter(_MIXED).select("k", "cell", "lo", "hi")
    # At most COARSE_CELLS + 1 rows per class.
    known = F.broadcast(known) if known.count() <= BROADCAST_CELLS else known
    fine = coarse.join(known, ["k", "cell"]).select("k", "cell", "score", "hit", _cell(FINE_CELLS).alias("part"))
    inner = checkpointed(fine.groupBy("k", "cell", "part").agg(*ends, *counted))
    tally = cells.filter(f"not ({_MIXED})").select(*entry).unionByName(inner.filter(f"not ({_MIXED})").select(*entry))
    open_ = inner.filter(_MIXED).select("k", "cell", "part")
    left = open_.count()
    if not left:
        return tally
    rows = fine.join(F.broadcast(open_) if left <= BROADCAST_CELLS else open_, ["k", "cell", "part"])
    return tally.unionByName(rows.groupBy("k", "score").agg(*counted))


def _cell(cells: int) -> Column:
    """The cell of a score between `lo` and `hi`: rounding keeps the order of scores. Infinite and NaN ends make one cell."""
    share = (F.col("score") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-300))
    return F.coalesce(F.when(F.col("hi") - F.col("lo") < float("inf"), F.floor(share * cells)), F.lit(0)).cast("bigint")


def auc_of_tally(tally: DataFrame, parts: int) -> DataFrame:
    """ROC area per class from (k, score, pos, neg) counts; products of counts are taken as doubles."""
    ranged = tally.repartitionByRange(parts, "k", "score").withColumn("part", F.spark_partition_id())
    inner = Window.partitionBy("part", "k").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn("above", F.coalesce(F.sum("pos").over(inner), F.lit(0)))
    wins = F.col("neg") * (F.col("above") + F.col("pos") / 2)
    by_part = local.groupBy("k", "part").agg(F.sum(wins).alias("wins"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    # One row per class and range from here on.
    outer = Window.partitionBy("k").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    placed = by_part.withColumn("before", F.coalesce(F.sum("pos").over(outer), F.lit(0)))
    total = placed.groupBy("k").agg(
        F.sum(F.col("wins") + F.col("neg").cast("double") * F.col("before")).alias("wins"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg")
    )
    return total.select(
        F.col("k").alias("class_index"),
        F.try_divide(F.col("wins").cast("double"), F.col("pos").cast("double") * F.col("neg")).alias("auc"),
    )


def classification_metrics(
    scored: DataFrame, truth: str, predicted: str, scores: dict[object, Column] | None, labels: list
) -> DataFrame:
    """One row of metrics, 4 places. Binary metrics take the second label as positive."""
    spark = scored.sparkSession
    counts, aucs = together(
        lambda: confusion_counts(scored, truth, predicted).collect(),
        lambda: roc_auc_by_class(
            scored, truth, scores if len(labels) > 2 else {labels[1]: list(scores.values())[-1]}
        ).collect()
        if scores and len(labels) >= 2
        else None,
    )
    kind = scored.schema[truth].dataType.simpleString()
    frame = spark.createDataFrame([tuple(r) for r in counts], f"truth {kind}, predicted {kind}, cnt bigint")
    report = class_report(frame)
    seen = {r["truth"] for r in counts if r["truth"] is not None}
    binary = len(seen) == 2 and len(labels) == 2
    note = None
    auc = None
    if aucs is None:
        note = "ROC-AUC omitted: no probabilities"
    else:
        values = [r["auc"] for r in aucs]
        if len(values) < (1 if binary else len(labels)) or any(v is None for v in values):
            note = "ROC-AUC omitted: a class has no positive or no negative rows"
        else:
            auc = sum(values) / len(values)
    means = averages(report)
    if binary:
        positive = report.filter(F.col("class") == F.lit(labels[1])).select("precision", "recall", "f1")
        head = positive.agg(*[F.coalesce(F.max(c), F.lit(0.0)).alias(c) for c in ("precision", "recall", "f1")])
        joined = means.withColumn("_k", F.lit(1)).join(head.withColumn("_k", F.lit(1)), "_k").drop("_k")
    else:
        joined = means.withColumns({c: F.col(f"{c}_macro") for c in ("precision", "recall", "f1")})
    r4 = ["accuracy", "precision", "recall", "f1", "precision_macro", "recall_macro", "f1_macro",
          "precision_weighted", "recall_weighted", "f1_weighted"]
    return joined.select(
        F.lit("binary" if binary else "multiclass").alias("classification_type"),
        F.lit(len(seen)).alias("n_classes"),
        *[F.round(c, 4).alias(c) for c in r4],
        F.round(F.lit(auc).cast("double"), 4).alias("roc_auc"),
        F.lit(note).cast("string").alias("roc_auc_note"),
    )
