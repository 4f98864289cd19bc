"""Automated exploratory analysis."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsmith.functions.expr import (
    as_double,
    as_text,
    bin_edges,
    bin_index,
    chunks,
    col,
    nan_to_null,
    percent,
)
from tabsmith.operators.correlation import correlation_matrix, correlation_pairs, strong_pairs
from tabsmith.operators.stats import COLUMNS_PER_PASS, TableStats, outside, table_stats, value_counts

def _ranked(df: DataFrame, *order: Column | str) -> DataFrame:
    """Rank the rows of a report: one row per column of a table, never its data rows."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)))


def missing_ranking(stats: TableStats, spark) -> DataFrame:
    """Columns with missing values, most missing first."""
    s = stats.to_df(spark).filter("missing_count > 0")
    return _ranked(s, F.desc("missing_count"), "position").select(
        "rank", "column_name", "missing_count",
        F.round(percent(F.col("missing_count"), F.col("n_rows")), 2).alias("missing_percentage"),
    )


def missing_chart(ranking: DataFrame, top: int = 15) -> DataFrame:
    return ranking.filter(F.col("rank") <= top)


def missing_overview(stats: TableStats, spark) -> DataFrame:
    cells = stats.n_rows * len(stats.columns)
    one = spark.createDataFrame([(stats.missing_cells, cells)], "total_missing_values bigint, cells bigint")
    return one.select(
        (F.col("total_missing_values") > 0).alias("has_missing_values"),
        "total_missing_values",
        F.round(percent(F.col("total_missing_values"), F.col("cells")), 2).alias("overall_missing_percentage"),
    )


def numeric_summary(stats: TableStats, spark) -> DataFrame:
    """Fourteen statistics per numeric column with values; most interesting first."""
    s = stats.to_df(spark).filter("data_type = 'numeric' and non_null > 0")
    share = percent(F.col("outlier_count"), F.col("n_rows"))
    scored = s.withColumn("interest", F.abs("skewness") + share / 10.0)
    r4 = lambda c: F.round(F.col(c), 4).alias(c)
    return _ranked(scored, F.desc("interest"), "position").select(
        F.col("rank").alias("interest_rank"), "position", "column_name", F.col("non_null").alias("count"),
        *[r4(c) for c in ("min", "max", "mean", "median", "std", "variance", "skewness", "q1", "q3")],
        F.round(F.col("q3") - F.col("q1"), 4).alias("iqr"),
        "outlier_count", F.round(share, 2).alias("outlier_percentage"),
        F.round("interest", 4).alias("interest_score"),
    )


def interesting_columns(stats: TableStats, top: int = 10) -> list[str]:
    scored = [
        (-(abs(s.skewness) + s.outlier_count / s.n_rows * 10.0), s.position, s.column_name)
        for s in stats.numeric
        if s.non_null
    ]
    return [name for _, _, name in sorted(scored)[:top]]


def bin_range(low: float, high: float) -> tuple[float, float]:
    """A constant column gets half a unit on both sides."""
    return (low, high) if low < high else (low - 0.5, high + 0.5)


def histogram_counts(df: DataFrame, ranges: dict[str, tuple[float, float]], bins: int) -> DataFrame:
    """(column_id, bin, cnt) of several columns from one scan."""
    df = nan_to_null(df)
    parts = []
    names = list(ranges)
    for part in chunks(names, COLUMNS_PER_PASS):
        exprs = {}
        for n in part:
            lo, hi = ranges[n]
            x = as_double(n)
            exprs[names.index(n)] = F.when((x >= lo) & (x <= hi), bin_index(x, lo, hi, bins))
        parts.append(value_counts(df, exprs, "bin"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def histograms(df: DataFrame, stats: TableStats, columns: list[str] | None = None, bins: int = 10) -> DataFrame:
    """Equal-width histogram of the most interesting numeric columns, zero-filled."""
    spark = df.sparkSession
    names = interesting_columns(stats) if columns is None else columns
    if not names:
        return spark.createDataFrame([], "column_name string, bin int, bin_start double, bin_end double, bin_count bigint")
    ranges = {n: bin_range(stats[n].min, stats[n].max) for n in names}
    counts = histogram_counts(df, ranges, bins)
    grid = []
    for i, n in enumerate(names):
        edges = bin_edges(*ranges[n], bins)
        grid += [(f"c{i}", b, n, edges[b], edges[b + 1]) for b in range(bins)]
    frame = spark.createDataFrame(grid, "column_id string, bin int, column_name string, bin_start double, bin_end double")
    return frame.join(counts, ["column_id", "bin"], "left").select(
        "column_name", "bin", F.round("bin_start", 2).alias("bin_start"), F.round("bin_end", 2).alias("bin_end"),
        F.coalesce("cnt", F.lit(0)).cast("bigint").alias("bin_count"),
    )


def boxplots(
    df: DataFrame, stats: TableStats, columns: list[str] | None = None, key: list[str] | None = None, sample: int = 10
) -> DataFrame:
    """Five numbers per column and the first outliers in key order.

    ``key`` orders the outliers (a table has no row order); without one they are ordered
    by value. Every task keeps only its own first ``sample`` values per column.
    """
    spark = df.sparkSession
    df = nan_to_null(df)
    names = interesting_columns(stats) if columns is None else columns
    box = spark.createDataFrame(
        [(i, n, stats[n].min, stats[n].q1, stats[n].median, stats[n].q3, stats[n].max) for i, n in enumerate(names)],
        "i int, column_name string, min double, q1 double, median double, q3 double, max double",
    )
    wide = df.select(
        F.struct(*([col(k) for k in key] if key else [])).alias("k") if key else F.lit(0).alias("k"),
        *[F.when(outside(as_double(n), stats[n].fences), as_double(n)).alias(f"c{i}") for i, n in enumerate(names)],
    )
    long = wide.unpivot("k", [f"c{i}" for i in range(len(names))], "column_id", "value").filter("value is not null")
    # Catalyst turns rank <= k into a WindowGroupLimit, applied before the shuffle.
    order = Window.partitionBy("column_id").orderBy("k", "value")
    first = long.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= sample)
    lists = first.groupBy("column_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("r", F.round("value", 2).alias("v")))), lambda s: s["v"]).alias("outliers_sample")
    )
    joined = box.withColumn("column_id", F.concat(F.lit("c"), "i")).join(lists, "column_id", "left")
    return joined.select(
        "column_name",
        *[F.round(c, 4).alias(c) for c in ("min", "q1", "median", "q3", "max")],
        F.coalesce("outliers_sample", F.array().cast("array<double>")).alias("outliers_sample"),
    )


def _high_cardinality(limit: int) -> Column:
    ratio = F.try_divide(F.col("unique_count").cast("double"), F.col("n_rows").cast("double"))
    return F.coalesce((F.col("unique_count") > limit) | ((ratio > 0.5) & (F.col("n_rows") > 10)), F.lit(False))


def categorical_summary(stats: TableStats, spark, max_cardinality: int = 25) -> DataFrame:
    s = stats.to_df(spark).filter("data_type <> 'numeric'")
    return s.select(
        "position", "column_name", "unique_count",
        F.round(F.try_divide(F.col("unique_count").cast("double"), F.col("n_rows").cast("double")), 4).alias("cardinality"),
        "missing_count",
        F.col("top_value").alias("most_frequent_value"),
        F.col("top_count").alias("most_frequent_frequency"),
        F.round(percent(F.col("top_count"), F.col("n_rows")), 2).alias("most_frequent_percentage"),
        _high_cardinality(max_cardinality).alias("is_high_cardinality"),
    )


def manageable_columns(stats: TableStats, max_cardinality: int = 25) -> list[str]:
    def high(s) -> bool:
        return s.unique_count > max_cardinality or (s.unique_count / s.n_rows > 0.5 and s.n_rows > 10)

    return [s.column_name for s in stats.categorical if s.unique_count and not high(s) and not s.nested]


def category_chart(df: DataFrame, stats: TableStats, top: int = 10, max_cardinality: int = 25) -> DataFrame:
    """Largest categories of the columns with few categories (bounded by design)."""
    spark = df.sparkSession
    names = manageable_columns(stats, max_cardinality)
    if not names:
        return spark.createDataFrame([], "column_name string, rank int, category string, category_count bigint, percentage double")
    types = {f.name: f.dataType for f in df.schema.fields}
    counts = value_counts(df, {i: as_text(n, types[n]) for i, n in enumerate(names)})
    order = Window.partitionBy("column_id").orderBy(F.desc("cnt"), "value")
    label = F.element_at(F.array(*[F.lit(n) for n in names]), F.substring("column_id", 2, 10).cast("int") + 1)
    return (
        counts.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= top)
        .select(
            label.alias("column_name"), "rank", F.col("value").alias("category"), F.col("cnt").alias("category_count"),
            F.round(percent(F.col("cnt"), F.lit(stats.n_rows)), 2).alias("percentage"),
        )
    )


def outlier_table(stats: TableStats, spark) -> DataFrame:
    """Columns with values beyond the quartile fences, most outliers first."""
    s = stats.to_df(spark).filter("data_type = 'numeric' and outlier_count > 0")
    iqr = F.col("q3") - F.col("q1")
    return _ranked(s, F.desc("outlier_count"), "position").select(
        "rank", "column_name", "outlier_count",
        F.round(percent(F.col("outlier_count"), F.col("n_rows")), 2).alias("outlier_percentage"),
        F.round(F.col("q1") - iqr * 1.5, 4).alias("lower_bound"),
        F.round(F.col("q3") + iqr * 1.5, 4).alias("upper_bound"),
        *[F.round(c, 4).alias(c) for c in ("min", "max", "q1", "median", "q3")],
        F.round(iqr, 4).alias("iqr"),
    )


def findings(stats: TableStats, pairs: DataFrame | None, spark) -> DataFrame:
    """Readable findings with category and severity, in report order."""

    def rows(df: DataFrame, section: int, order: Column, category: str, severity: Column, message: Column) -> DataFrame:
        return df.select(
            F.lit(section).alias("section"), order.cast("bigint").alias("ord"), F.lit(category).alias("category"),
            severity.alias("severity"), message.alias("message"),
        )

    share = F.col("missing_percentage")
    overview = missing_overview(stats, spark)
    overall = F.col("overall_missing_percentage")
    summary = numeric_summary(stats, spark)
    outliers = outlier_table(stats, spark)
    high = categorical_summary(stats, spark).filter("is_high_cardinality")
    parts = [
        rows(
            overview, 0, F.lit(0), "Missingness",
            F.when(~F.col("has_missing_values"), "info").when(overall > 15.0, "high").otherwise("medium"),
            F.format_string("%d missing values in the table (%s%%)", "total_missing_values", overall.cast("string")),
        ),
        rows(
            missing_ranking(stats, spark).filter("rank <= 5"), 1, F.col("rank"), "Missingness",
            F.when(share > 50.0, "high").when(share > 10.0, "medium").otherwise("low"),
            F.format_string("'%s' misses %s%% of its values", "column_name", share.cast("string")),
        ),
        rows(
            summary.filter(F.abs("skewness") > 1.0), 2, F.col("position"), "Distribution / Skewness", F.lit("medium"),
            F.format_string(
                "'%s' is skewed to the %s (skewness %s)", F.col("column_name"),
                F.when(F.col("skewness") > 0, "right").otherwise("left"), F.col("skewness").cast("string"),
            ),
        ),
        rows(
            outliers.filter("rank <= 5 and outlier_percentage > 2.0"), 3, F.col("rank"), "Outliers",
            F.when(F.col("outlier_percentage") > 5.0, "medium").otherwise("low"),
            F.format_string("'%s' has %d outliers (%s%% of rows)", F.col("column_name"), F.col("outlier_count"),
                            F.col("outlier_percentage").cast("string")),
        ),
        rows(
            high, 5, F.col("position"), "Cardinality", F.lit("info"),
            F.format_string("'%s' has %d different values", "column_name", "unique_count"),
        ),
    ]
    if pairs is not None:
        parts.append(
            rows(
                strong_pairs(pairs).filter("rank <= 5"), 4, F.col("rank"), "Correlation",
                F.when(F.abs("correlation") < 0.90, "info").otherwise("medium"),
                F.format_string("'%s' and '%s' move together (r = %s)", F.col("column_1"), F.col("column_2"),
                                F.col("correlation").cast("string")),
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _weight() -> Column:
    s = F.lower("severity")
    return F.when(s == "high", 3).when(s == "medium", 2).when(s == "low", 1).otherwise(0)


def top_findings(found: DataFrame, top: int = 5) -> DataFrame:
    return found.orderBy(_weight().desc(), "section", "ord").limit(top)


def severity_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("severity").agg(F.count(F.lit(1)).alias("findings"))


def filter_findings(found: DataFrame, severity: str = "all", category: str = "all") -> DataFrame:
    out = found
    if severity != "all":
        out = out.filter(F.lower("severity") == severity.lower())
    if category != "all":
        out = out.filter(F.lower("category") == category.lower())
    return out


@dataclass
class EdaReport:
    """Parts of a report; a part is None where the column kinds do not allow it."""

    flags: DataFrame
    missing: DataFrame
    findings: DataFrame
    numeric: DataFrame | None = None
    histograms: DataFrame | None = None
    boxplots: DataFrame | None = None
    outliers: DataFrame | None = None
    categorical: DataFrame | None = None
    category_chart: DataFrame | None = None
    correlation_matrix: DataFrame | None = None
    strong_pairs: DataFrame | None = None
    correlation_reason: str | None = None


def run_eda(df: DataFrame, stats: TableStats | None = None) -> EdaReport:
    """Analyse a table; parts that make no sense for its columns are not run."""
    spark = df.sparkSession
    stats = stats or table_stats(df)
    if not stats.n_rows:
        raise ValueError("The table has no rows.")
    has_numeric, has_text = bool(stats.numeric), bool(stats.categorical)
    varying = [s for s in stats.numeric if s.non_null > 1 and s.min != s.max]
    pairs, reason = None, None
    if len(stats.numeric) < 2:
        reason = "At least two numeric columns are needed."
    elif len(varying) < 2:
        reason = "Fewer than two numeric columns vary."
    else:
        pairs = correlation_pairs(df, stats)
    flags = spark.createDataFrame(
        [(True, stats.missing_cells > 0, has_numeric, has_text, len(stats.numeric) >= 2, has_numeric)],
        "missing_analysis boolean, missing_charts boolean, numeric_analysis boolean, "
        "categorical_analysis boolean, correlation_analysis boolean, outlier_analysis boolean",
    )
    return EdaReport(
        flags=flags,
        missing=missing_ranking(stats, spark),
        findings=findings(stats, pairs, spark),
        numeric=numeric_summary(stats, spark) if has_numeric else None,
        histograms=histograms(df, stats) if has_numeric else None,
        boxplots=boxplots(df, stats) if has_numeric else None,
        outliers=outlier_table(stats, spark) if has_numeric else None,
        categorical=categorical_summary(stats, spark) if has_text else None,
        category_chart=category_chart(df, stats) if has_text else None,
        correlation_matrix=correlation_matrix(pairs) if pairs is not None else None,
        strong_pairs=strong_pairs(pairs) if pairs is not None else None,
        correlation_reason=reason,
    )
