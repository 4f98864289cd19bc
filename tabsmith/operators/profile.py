"""Dataset profile: summary, column profiles, quality flags, target classes, score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsmith.functions.expr import as_text, col, numeric_columns, percent
from tabsmith.functions.jobs import together
from tabsmith.operators.stats import TableStats, duplicate_row_count, table_stats


def data_bytes(df: DataFrame) -> DataFrame:
    """Bytes of all values in text form (a size that does not depend on storage)."""
    sizes = [F.coalesce(F.octet_length(as_text(f.name, f.dataType)), F.lit(0)) for f in df.schema.fields]
    total = sizes[0]
    for s in sizes[1:]:
        total = total + s
    return df.agg(F.coalesce(F.sum(total), F.lit(0)).cast("bigint").alias("data_bytes"))


def dataset_summary(df: DataFrame, stats: TableStats | None = None) -> DataFrame:
    """One row: rows, columns by kind, duplicates, missing cells and data size."""
    spark = df.sparkSession
    got, dup, size = together(
        lambda: stats
        or table_stats(df, numeric_values=False, text_values=False, quantiles=False),
        lambda: duplicate_row_count(df).first()[0],
        lambda: data_bytes(df).first()[0],
    )
    cells = got.n_rows * len(got.columns)
    one = spark.createDataFrame(
        [(got.n_rows, len(got.columns), len(got.numeric), len(got.categorical), dup, got.missing_cells, cells, size)],
        "num_rows bigint, num_cols bigint, numeric_column_count bigint, categorical_column_count bigint, "
        "duplicate_row_count bigint, missing_value_count bigint, cells bigint, data_bytes bigint",
    )
    return one.select(
        "num_rows", "num_cols", "numeric_column_count", "categorical_column_count", "duplicate_row_count",
        "missing_value_count",
        F.round(percent(F.col("missing_value_count"), F.col("cells")), 2).alias("missing_value_percentage"),
        "data_bytes",
        F.round(F.col("data_bytes") / F.lit(1024 * 1024), 2).alias("data_mb"),
    )


def quality_flags(numeric: Column) -> Column:
    """Array of flag names; thresholds and names are fixed values."""
    text = ~numeric
    n, unique = F.col("num_rows"), F.col("unique_count")
    return F.array_compact(
        F.array(
            F.when(F.col("missing_percentage_raw") == 100.0, F.lit("completely missing")).when(
                F.col("missing_percentage_raw") > 20.0, F.lit("high missingness")
            ),
            F.when(text & (unique <= 10), F.lit("low cardinality")),
            F.when(text & (unique > n * 0.5) & (n > 10), F.lit("high cardinality")),
            F.when(
                text & ((unique == n) | ((F.try_divide(unique.cast("double"), n.cast("double")) > 0.99) & (n > 1))),
                F.lit("potential identifier"),
            ),
            F.when(numeric & (F.abs("skewness") > 1.0), F.lit("highly skewed")),
            F.when(numeric & (F.col("outlier_percentage") > 5.0), F.lit("outlier-heavy")),
            F.when((unique <= 1) | (F.col("top_percentage_raw") >= 95.0), F.lit("constant/near-constant")),
        )
    )


def column_profiles(stats: TableStats, spark: SparkSession) -> DataFrame:
    """One row per column with statistics rounded for reading, and quality flags."""
    s = stats.to_df(spark)
    numeric = F.col("data_type") == "numeric"
    r4 = lambda c: F.round(F.col(c), 4).alias(c)
    base = s.select(
        "position",
        "column_name",
        F.col("data_type").alias("inferred_type"),
        F.col("n_rows").alias("num_rows"),
        "missing_count",
        percent(F.col("missing_count"), F.col("n_rows")).alias("missing_percentage_raw"),
        "unique_count",
        F.round(F.coalesce(F.try_divide(F.col("unique_count").cast("double"), F.col("n_rows").cast("double")), F.lit(0.0)), 4).alias("cardinality"),
        *[r4(c) for c in ("min", "max", "mean", "median", "std", "variance", "skewness", "q1", "q3")],
        F.round(F.col("q3") - F.col("q1"), 4).alias("iqr"),
        F.when(numeric, F.col("outlier_count")).alias("outlier_count"),
        F.when(numeric, F.round(percent(F.col("outlier_count"), F.col("n_rows")), 2)).alias("outlier_percentage"),
        F.when(~numeric, F.col("top_value")).alias("most_frequent_value"),
        F.when(~numeric, F.col("top_count")).alias("most_frequent_frequency"),
        percent(F.col("top_count"), F.col("n_rows")).alias("top_percentage_raw"),
    )
    return base.select(
        "*",
        F.round("missing_percentage_raw", 2).alias("missing_percentage"),
        F.when(F.col("inferred_type") != "numeric", F.round("top_percentage_raw", 2)).alias("most_frequent_percentage"),
        quality_flags(F.col("inferred_type") == "numeric").alias("data_quality_flags"),
    ).drop("missing_percentage_raw", "top_percentage_raw", "num_rows")


def filter_profiles(profiles: DataFrame, search: str = "", kind: str = "all") -> DataFrame:
    out = profiles.filter(F.lower("column_name").contains(search.lower()))
    if kind == "all":
        return out
    is_num = F.col("inferred_type") == "numeric"
    return out.filter(is_num if kind == "numeric" else ~is_num)


def target_profile(df: DataFrame, target: str) -> DataFrame:
    """Count per class, NULL being a class; percentages over the non-NULL rows."""
    dtype = df.schema[target].dataType
    counts = df.groupBy(as_text(target, dtype).alias("class")).agg(F.count(F.lit(1)).alias("class_count"))
    # One total beside the classes: no task sees all of them.
    total = df.agg(F.count(as_text(target, dtype)).alias("valid"))
    valid = F.col("valid")
    return counts.join(F.broadcast(total)).select(
        F.lit(target).alias("target_column"),
        "class",
        "class_count",
        F.round(percent(F.col("class_count"), valid), 2).alias("class_percentage"),
    )


def semantic_types(df: DataFrame) -> DataFrame:
    """How many columns are numeric, categorical, dates and identifiers, by name."""
    spark = df.sparkSession
    numeric = set(numeric_columns(df))
    names = spark.createDataFrame([(c, c in numeric) for c in df.columns], "name string, numeric boolean")
    low = F.lower("name")
    is_date = low.contains("date") | low.contains("time")
    is_id = ~is_date & (low.endswith("_id") | low.contains(" id") | (low == "id"))
    counts = names.agg(
        F.count_if(is_date).alias("d"), F.count_if(is_id).alias("i"),
        F.count_if("numeric").alias("n"), F.count_if(~F.col("numeric")).alias("c"),
    )
    return counts.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(k).alias("kind"), v.cast("bigint").alias("columns"))
                    for k, v in (
                        ("numeric", F.greatest(F.lit(0), F.col("n") - F.col("i"))),
                        ("categorical", F.greatest(F.lit(0), F.col("c") - F.col("d"))),
                        ("date", F.col("d")),
                        ("identifier", F.col("i")),
                    )
                ]
            )
        )
    ).filter("columns > 0")


def quality_score(summary: DataFrame, profiles: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """100 minus fixed deductions, at least 10, with a verdict. Three tiny inputs."""
    heavy = profiles.agg(
        F.count_if((F.col("inferred_type") == "numeric") & (F.col("outlier_percentage") > 5)).alias("outlier_columns")
    ).withColumn("k", F.lit(1))
    if classes is None:
        worst = summary.select(F.lit(None).cast("double").alias("min_share"), F.lit(1).alias("k"))
    else:
        worst = classes.agg(F.min("class_percentage").alias("min_share")).withColumn("k", F.lit(1))
    joined = summary.withColumn("k", F.lit(1)).join(heavy, "k").join(worst, "k")
    # Half up, like the rounding of the published rule.
    missing = F.least(F.lit(25.0), F.floor(F.col("missing_value_percentage") * 2.5 + 0.5))
    duplicates = F.when(F.col("duplicate_row_count") > 0, 10).otherwise(0)
    outliers = F.least(F.lit(15), F.col("outlier_columns") * 2)
    imbalance = F.when(F.col("min_share") < 15, 10).when(F.col("min_share") < 30, 5).otherwise(0)
    scored = joined.select(
        missing.cast("bigint").alias("missing_deduction"),
        duplicates.cast("bigint").alias("duplicate_deduction"),
        outliers.cast("bigint").alias("outlier_deduction"),
        imbalance.cast("bigint").alias("imbalance_deduction"),
    )
    total = sum((F.col(c) for c in scored.columns[1:]), F.col("missing_deduction"))
    with_score = scored.withColumn("quality_score", F.greatest(F.lit(10), F.lit(100) - total).cast("bigint"))
    return with_score.withColumn(
        "verdict",
        F.when(F.col("quality_score") >= 85, "excellent")
        .when(F.col("quality_score") >= 70, "good")
        .when(F.col("quality_score") >= 50, "moderate")
        .otherwise("poor"),
    )
