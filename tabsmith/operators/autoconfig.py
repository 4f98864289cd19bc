"""Automatic configuration: target, leakage and ratio candidates."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.functions.expr import as_double, as_text, chunks, col, is_numeric, nan_to_null
from tabsmith.operators.profile import target_profile
from tabsmith.operators.split import class_counts
from tabsmith.operators.stats import COLUMNS_PER_PASS, TableStats, table_stats
from tabsmith.plans import names

# Words of a standard two-class encoding.
BINARY_WORDS = ["0", "1", "true", "false", "yes", "no", "Y", "N"]
# Limits of the leakage checks.
ALL_MISSING_PCT = 99.9
LEAK_CORRELATION = 0.90
LEAK_PURITY = 0.98
LEAK_CATEGORIES = 20
LEAK_MIN_ROWS = 30
LEAK_MIN_STD = 1e-7
# A distinct estimate up to this value is close enough to the limit to be counted exactly.
SHORTLIST = 60

CANDIDATE_DDL = "position int, column_name string, score double, unique_count bigint, min_class_share double, reason string"
LEAK_DDL = "position int, column_name string, type string, severity string, statistic double, reason string, recommendation string"
ADVICE = {"high": "Leave it out of the predictors after a look at it; profiling keeps it.", "medium": "Look at it before it becomes a predictor."}


def _approx_distinct(df: DataFrame, wanted: list[str]) -> dict[str, int]:
    types = {f.name: f.dataType for f in df.schema.fields}
    out: dict[str, int] = {}
    for part in chunks(wanted, 16):
        row = df.agg(
            *[F.approx_count_distinct(_value(n, types[n]), 0.02).alias(f"d{i}") for i, n in enumerate(part)]
        ).first()
        out.update(zip(part, row))
    return out


def _value(name: str, dtype):
    return col(name).cast("double") if is_numeric(dtype) else as_text(name, dtype)


def class_shares(df: DataFrame, few: list[str]) -> DataFrame:
    """(column_name, value, cnt) of columns with few distinct values."""
    types = {f.name: f.dataType for f in df.schema.fields}
    parts = []
    for part in chunks(few, COLUMNS_PER_PASS):
        wide = df.select(*[as_text(n, types[n]).alias(f"c{i}") for i, n in enumerate(part)])
        long = wide.unpivot([], wide.columns, "column_id", "value").filter("value is not null")
        label = F.element_at(F.array(*[F.lit(n) for n in part]), F.substring("column_id", 2, 10).cast("int") + 1)
        parts.append(long.groupBy(label.alias("column_name"), "value").agg(F.count(F.lit(1)).alias("cnt")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def target_candidates(df: DataFrame, stats: TableStats | None = None) -> DataFrame:
    """Scored candidate columns, best first.

    Distinct estimates sort out the columns with many values; only the few others are
    counted exactly, so no high-cardinality column is ever grouped.
    """
    spark = df.sparkSession
    df = nan_to_null(df)
    stats = stats or table_stats(df, numeric_values=False, text_values=False, quantiles=False)
    live = [s for s in stats.columns if s.non_null and not s.nested and not names.is_geographic(s.column_name)]
    estimate = _approx_distinct(df, [s.column_name for s in live])
    few = [s.column_name for s in live if estimate[s.column_name] <= SHORTLIST]
    if not few:
        return spark.createDataFrame([], "rank int, " + CANDIDATE_DDL)
    summary = (
        class_shares(df, few)
        .groupBy("column_name")
        .agg(
            F.count(F.lit(1)).alias("unique_count"),
            F.min("cnt").alias("smallest"),
            F.sum("cnt").alias("non_null"),
            F.min(F.col("value").isin(BINARY_WORDS + ["0.0", "1.0"])).alias("binary_words"),
        )
        .filter("unique_count <= 15")
    )
    facts = spark.createDataFrame(
        [
            (s.position, s.column_name, s.numeric, names.looks_like_id(s.column_name), names.target_pattern(s.column_name),
             s.position == len(stats.columns) - 1)
            for s in live
        ],
        "position int, column_name string, is_numeric boolean, id_name boolean, pattern string, is_last boolean",
    )
    c = summary.join(F.broadcast(facts), "column_name")
    n, unique = F.lit(stats.n_rows), F.col("unique_count")
    ratio = unique / n
    skip = (unique <= 1) | (F.col("id_name") & (ratio > 0.3)) | ((ratio > 0.8) & (n > 20))
    classes = (
        F.when(unique == 2, 55.0).when(unique <= 6, 35.0).when(~F.col("is_numeric"), 15.0)
    )
    share = F.col("smallest") / F.col("non_null")
    balance = F.when(share >= 0.05, 15.0).when(share >= 0.01, 5.0).otherwise(-10.0)
    extra = (
        F.when(F.col("pattern").isNotNull(), 30.0).otherwise(0.0)
        + F.when(F.col("is_last"), 10.0).otherwise(0.0)
        + F.when((unique == 2) & F.col("binary_words"), 15.0).otherwise(0.0)
    )
    reason = F.concat_ws(
        "; ",
        F.format_string("%d classes", unique),
        F.when(F.col("pattern").isNotNull(), F.format_string("name matches '%s'", "pattern")),
        F.when(F.col("is_last"), F.lit("last column")),
        F.when((unique == 2) & F.col("binary_words"), F.lit("standard binary encoding")),
    )
    scored = c.filter(~skip).select(
        "position", "column_name", (classes + balance + extra).alias("score"), "unique_count",
        share.alias("min_class_share"), reason.alias("reason"),
    ).filter("score is not null")
    # One row per column of the table.
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc("score"), "position")
    return scored.withColumn("rank", F.row_number().over(order))


@dataclass
class TargetChoice:
    column: str | None
    detected_column: str | None
    confidence: float
    confidence_level: str
    reason: str
    candidates: list[str] = field(default_factory=list)


def detect_target(df: DataFrame, stats: TableStats | None = None, top: int = 8) -> TargetChoice:
    rows = target_candidates(df, stats).filter(F.col("rank") <= top).orderBy("rank").collect()
    if not rows:
        return TargetChoice(None, None, 0.0, "Low", "No suitable low-cardinality column found.", df.columns[:10])
    best = rows[0]
    score = best["score"]
    if score >= 70.0:
        level, confidence = "High", min(0.99, round(score / 110.0, 2))
    elif score >= 45.0:
        level, confidence = "Medium", min(0.84, round(score / 100.0, 2))
    else:
        level, confidence = "Low", max(0.1, round(score / 100.0, 2))
    name = best["column_name"]
    return TargetChoice(
        name if level != "Low" else None, name, confidence, level, best["reason"], [r["column_name"] for r in rows]
    )


def correlation_with_target(df: DataFrame, features: list[str], target: str) -> dict[str, float]:
    """|r| with a numeric target over complete rows; 0.0 where it is not defined."""
    out = {}
    # A boolean target counts as 0 and 1.
    y = col(target).cast("int").cast("double") if isinstance(df.schema[target].dataType, T.BooleanType) else as_double(target)
    for part in chunks(features, 12):
        aggs = [
            F.struct(F.regr_count(as_double(f), y).alias("n"), F.regr_syy(as_double(f), y).alias("xx"),
                     F.regr_sxx(as_double(f), y).alias("yy"), F.regr_sxy(as_double(f), y).alias("xy"))
            for f in part
        ]
        row = df.agg(*[a.alias(f"a{i}") for i, a in enumerate(aggs)]).first()
        for f, p in zip(part, row):
            n = p["n"] or 0
            ok = n > LEAK_MIN_ROWS and (p["xx"] / n) ** 0.5 > LEAK_MIN_STD and (p["yy"] / n) ** 0.5 > LEAK_MIN_STD
            out[f] = abs(p["xy"]) / (p["xx"] ** 0.5 * p["yy"] ** 0.5) if ok else 0.0
    return out


def contingency(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """(column_name, value, y) -> cnt over rows where both are present."""
    types = {f.name: f.dataType for f in df.schema.fields}
    live = df.filter(col(target).isNotNull())
    y = _value(target, types[target]).cast("string").alias("y")
    wide = live.select(y, *[as_text(f, types[f]).alias(f"c{i}") for i, f in enumerate(features)])
    long = wide.unpivot("y", [f"c{i}" for i in range(len(features))], "column_id", "value").filter("value is not null")
    label = F.element_at(F.array(*[F.lit(f) for f in features]), F.substring("column_id", 2, 10).cast("int") + 1)
    return long.groupBy(label.alias("column_name"), "value", "y").agg(F.count(F.lit(1)).alias("cnt"))


def purity(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """Mean share of the leading class per category, with the number of categories."""
    table = contingency(df, features, target)
    by_value = table.groupBy("column_name", "value").agg(
        (F.max("cnt") / F.sum("cnt")).alias("share"), F.count(F.lit(1)).alias("classes"), F.min("y").alias("y0"), F.max("y").alias("y1")
    )
    return by_value.groupBy("column_name").agg(
        F.avg("share").alias("purity"),
        F.count(F.lit(1)).alias("categories"),
        (F.min("y0") != F.max("y1")).alias("several_classes"),
    )


def leak_reason(kind: str, name: str, value: float | None) -> str:
    """Why a column is listed, with the statistic that shows it."""
    if kind == "domain_knowledge":
        return names.LEAKAGE_NAMES[names.normal(name)]
    return {
        "all_missing": "No row has a value.",
        "high_correlation": f"Its correlation with the target is {value or 0:.4f}.",
        "categorical_proxy": f"Within its values, {100 * (value or 0):.2f} % of the rows share one class on average.",
        "post_event_semantic": "Its name points to something that is recorded after the event.",
    }[kind]


def detect_leakage(
    df: DataFrame, target: str | None = None, stats: TableStats | None = None
) -> DataFrame:
    """Columns that must not be used as predictors, with the reason type.

    The whole table is examined; no sample is drawn.
    """
    spark = df.sparkSession
    df = nan_to_null(df)
    stats = stats or table_stats(df, numeric_values=False, text_values=False, quantiles=False)
    found: dict[str, tuple] = {}

    def add(s, kind: str, severity: str, value: float | None = None) -> None:
        found[s.column_name] = (s.position, s.column_name, kind, severity, value, leak_reason(kind, s.column_name, value), ADVICE[severity])

    others = [s for s in stats.columns if s.column_name != target]
    for s in others:
        if stats.n_rows and s.missing_count / stats.n_rows * 100 >= ALL_MISSING_PCT:
            add(s, "all_missing", "high")
        elif names.normal(s.column_name) in names.LEAKAGE_NAMES:
            add(s, "domain_knowledge", "high")
    if target is not None and target in df.columns:
        types = {f.name: f.dataType for f in df.schema.fields}
        open_ = [s for s in others if s.column_name not in found and not s.nested]
        if is_numeric(types[target]) or isinstance(types[target], T.BooleanType):
            rs = correlation_with_target(df, [s.column_name for s in open_ if s.numeric], target)
            for s in open_:
                r = rs.get(s.column_name, 0.0)
                if r >= LEAK_CORRELATION:
                    add(s, "high_correlation", "high", r)
        open_ = [s for s in open_ if s.column_name not in found]
        both = df.filter(col(target).isNotNull())
        estimate = _approx_distinct(both, [s.column_name for s in open_])
        few = [s for s in open_ if estimate[s.column_name] <= SHORTLIST]
        numeric_few = _exact_distinct(df, [s.column_name for s in few if s.numeric])
        few = [s for s in few if not s.numeric or numeric_few[s.column_name] <= LEAK_CATEGORIES]
        pure = {}
        if few:
            pure = {r["column_name"]: r for r in purity(df, [s.column_name for s in few], target).collect()}
        for s in open_:
            p = pure.get(s.column_name)
            leaks = (
                p is not None and p["several_classes"] and 1 < p["categories"] <= LEAK_CATEGORIES and p["purity"] >= LEAK_PURITY
            )
            if leaks:
                add(s, "categorical_proxy", "high", p["purity"])
            elif any(f in s.column_name.lower() for f in names.POST_EVENT_FRAGMENTS):
                add(s, "post_event_semantic", "medium")
    return spark.createDataFrame(sorted(found.values()), LEAK_DDL)


def _exact_distinct(df: DataFrame, few: list[str]) -> dict[str, int]:
    if not few:
        return {}
    rows = class_shares(df, few).groupBy("column_name").agg(F.count(F.lit(1)).alias("n")).collect()
    return {r["column_name"]: r["n"] for r in rows}


def known_leakage(df: DataFrame) -> DataFrame:
    """Columns whose name alone marks them as known only after the event, with the reason and what to do."""
    rows = [(i, c, leak_reason("domain_knowledge", c, None), ADVICE["high"]) for i, c in enumerate(df.columns) if names.normal(c) in names.LEAKAGE_NAMES]
    return df.sparkSession.createDataFrame(rows, "position int, column_name string, reason string, recommendation string")


def target_overview(df: DataFrame, target: str | None = None) -> tuple[DataFrame | None, TargetChoice | None]:
    """Class profile of the given, hinted or detected target, and how it was chosen."""
    choice = None
    if target is None:
        hints = names.DOMAIN_PROFILES["supply_chain"]["target_hints"]
        target = next((c for c in df.columns if names.normal(c) in hints), None)
    if target is None:
        choice = detect_target(df)
        target = choice.column or choice.detected_column
    if target is None or target not in df.columns:
        return None, choice
    return target_profile(nan_to_null(df), target), choice


@dataclass
class AutoConfig:
    target: TargetChoice
    leakage_columns: list[str]
    numeric_columns: list[str]
    categorical_columns: list[str]
    feature_specs: list[dict]
    domain_profile: str
    pipeline_ready: bool
    test_size: float = 0.20
    seed: int = 42
    skewness_threshold: float = 1.0
    outlier_threshold: float = 0.02
    cardinality_threshold: int = 15

    def to_df(self, spark: SparkSession) -> DataFrame:
        """The configuration as (role, column_name) rows."""
        rows = [("target", self.target.column or self.target.detected_column)] if self.target.detected_column else []
        rows += [("leakage", c) for c in self.leakage_columns]
        rows += [("numeric", c) for c in self.numeric_columns]
        rows += [("categorical", c) for c in self.categorical_columns]
        rows += [("ratio", s["name"]) for s in self.feature_specs]
        return spark.createDataFrame(rows, "role string, column_name string")


def auto_config(df: DataFrame) -> AutoConfig:
    """Target, leakage, column roles and ratio candidates of any table."""
    df = nan_to_null(df)
    stats = table_stats(df, numeric_values=False, text_values=False, quantiles=False)
    choice = detect_target(df, stats)
    target = choice.column or choice.detected_column
    leaks = [r["column_name"] for r in detect_leakage(df, target, stats).collect()]
    usable = [s for s in stats.columns if s.column_name != target and s.column_name not in set(leaks)]
    numeric = [s.column_name for s in usable if s.numeric]
    return AutoConfig(
        target=choice,
        leakage_columns=leaks,
        numeric_columns=numeric,
        categorical_columns=[s.column_name for s in usable if not s.numeric],
        feature_specs=names.ratio_specs(numeric),
        domain_profile=names.detect_domain(df.columns),
        pipeline_ready=choice.confidence_level in ("High", "Medium"),
    )


@dataclass
class ResolvedTarget:
    column: str
    classes: list
    classification_type: str
    domain_profile: str


def resolve_target(df: DataFrame, target: str | None = None, profile: str | None = None) -> ResolvedTarget:
    """Find the target by name, domain hint or detection, and check it for classification."""
    domain = names.domain_profile(profile, df.columns)
    wanted = (target or "").strip().lower()
    by_name = {c.strip().lower(): c for c in reversed(df.columns)}
    if wanted and wanted != "auto":
        if wanted not in by_name:
            raise ValueError(f"Target column '{target}' was not found; columns: {df.columns[:10]}.")
        found = by_name[wanted]
    else:
        hints = [by_name[h] for h in domain["target_hints"] if h in by_name]
        if hints:
            found = hints[0]
        else:
            choice = detect_target(df)
            found = choice.column or choice.detected_column
        if not found:
            raise ValueError(f"Target column could not be determined automatically; columns: {df.columns[:10]}.")
    if names.is_geographic(found):
        raise ValueError(f"Invalid target column '{found}': geographical columns cannot be the target.")
    classes = [c for c in class_counts(nan_to_null(df.select(col(found))), found) if c is not None]
    if not classes:
        raise ValueError(f"Target column '{found}' contains only missing values.")
    if len(classes) < 2:
        raise ValueError(f"Target column '{found}' has only {len(classes)} distinct class(es); at least 2 are required.")
    return ResolvedTarget(found, classes, "binary" if len(classes) == 2 else "multiclass", domain["key"])
