"""Column statistics: the few data passes every report, plan and fit is built on.

Pass structure for K columns, independent of the number of rows:

1. ``moments``    one aggregate over (column, value) pairs, combined map-side to one
                  row per column, inside whole-stage codegen;
2. ``values``     distinct count and most frequent value from one long
                  (column, value) -> count aggregation with map-side combine;
3. ``quantiles``  exact quartiles by bounded-memory bucket counts;
4. ``fences``     outliers outside the quartile fences, quartiles as literals.

Passes that do not need each other run as concurrent jobs. Only one row per column
reaches the driver.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.functions.expr import (
    INTEGRAL,
    adjusted_skewness,
    as_double,
    as_text,
    chunks,
    col,
    is_nested,
    is_numeric,
    nan_to_null,
)
from tabsmith.functions.jobs import checkpointed, together
from tabsmith.functions.joins import BROADCAST_ROWS
from tabsmith.functions.quantiles import linear_quantiles

COLUMNS_PER_PASS = 48
# Text longer than this on average is grouped by its SHA-256 digest instead of itself.
LONG_TEXT_BYTES = 64
# Up to this many 8-byte hashes of possibly repeated rows are broadcast.
SUSPECT_ROWS = 1_000_000
QUARTILES = [0.25, 0.5, 0.75]


@dataclass
class ColumnStats:
    column_name: str
    position: int
    data_type: str
    nested: bool
    n_rows: int
    non_null: int = 0
    missing_count: int = 0
    unique_count: int | None = None
    min: float | None = None
    max: float | None = None
    mean: float | None = None
    median: float | None = None
    std: float | None = None
    variance: float | None = None
    variance_pop: float | None = None
    skewness: float | None = None
    q1: float | None = None
    q3: float | None = None
    outlier_count: int = 0
    top_value: str | None = None
    top_count: int | None = None
    text_bytes: int | None = None

    @property
    def numeric(self) -> bool:
        return self.data_type == "numeric"

    @property
    def iqr(self) -> float | None:
        return None if self.q1 is None else self.q3 - self.q1

    @property
    def fences(self) -> tuple[float, float] | None:
        if self.q1 is None:
            return None
        return self.q1 - 1.5 * self.iqr, self.q3 + 1.5 * self.iqr


_SQL_TYPES = {"str": "string", "int": "bigint", "float": "double", "bool": "boolean"}


def _ddl() -> str:
    return ", ".join(f"`{f.name}` {_SQL_TYPES[str(f.type).split(' |')[0]]}" for f in fields(ColumnStats))


@dataclass
class TableStats:
    """Statistics of one table: a row count and one record per column."""

    n_rows: int
    columns: list[ColumnStats]

    def __getitem__(self, name: str) -> ColumnStats:
        return next(c for c in self.columns if c.column_name == name)

    @property
    def numeric(self) -> list[ColumnStats]:
        return [c for c in self.columns if c.numeric]

    @property
    def categorical(self) -> list[ColumnStats]:
        return [c for c in self.columns if not c.numeric]

    @property
    def missing_cells(self) -> int:
        return sum(c.missing_count for c in self.columns)

    def to_df(self, spark: SparkSession) -> DataFrame:
        """One row per column; every rule and report is an expression over it."""
        return spark.createDataFrame([tuple(asdict(c).values()) for c in self.columns], _ddl())


def table_stats(
    df: DataFrame,
    *,
    numeric_values: bool = True,
    text_values: bool = True,
    quantiles: bool = True,
) -> TableStats:
    """Compute the statistics of all columns.

    ``numeric_values=False`` skips exact distinct counts of numeric columns (the one
    part that shuffles their values); ``text_values`` does the same for the others.
    """
    df = nan_to_null(df)
    schema = df.schema.fields
    numeric = [f.name for f in schema if is_numeric(f.dataType)]
    (n_rows, counts, text_bytes), rows = together(
        lambda: _counts(df, [f for f in schema if not is_numeric(f.dataType)]),
        lambda: moments(df, [as_double(c) for c in numeric]),
    )
    found = dict(zip(numeric, rows))
    counts.update({c: m["count"] for c, m in found.items()})
    stats = [
        ColumnStats(
            column_name=f.name,
            position=i,
            data_type="numeric" if is_numeric(f.dataType) else "categorical/text",
            nested=is_nested(f.dataType),
            n_rows=n_rows,
            non_null=counts[f.name],
            missing_count=n_rows - counts[f.name],
            text_bytes=text_bytes.get(f.name),
        )
        for i, f in enumerate(schema)
    ]
    table = TableStats(n_rows, stats)
    for s in table.numeric:
        if s.non_null:
            m = found[s.column_name]
            s.min, s.max, s.mean, s.skewness = m["min"], m["max"], m["mean"], m["skew"]
            s.variance = m["var"] or 0.0
            s.std = s.variance**0.5
            s.variance_pop = s.variance * (s.non_null - 1) / s.non_null
    jobs = []
    if quantiles:
        jobs.append(lambda: (_quartiles(df, table), _fences(df, table)))
    if numeric_values:
        jobs += _value_jobs(df, table.numeric)
    if text_values:
        jobs += _value_jobs(df, table.categorical)
    together(*jobs)
    return table


def add_quartiles(df: DataFrame, table: TableStats) -> None:
    """Quartiles and outlier counts, for statistics that were measured without them."""
    df = nan_to_null(df)
    _quartiles(df, table)
    _fences(df, table)


def add_values(df: DataFrame, table: TableStats, names: list[str]) -> None:
    """Distinct counts and most frequent values of some columns, for statistics that were measured without them."""
    together(*_value_jobs(nan_to_null(df), [table[n] for n in names]))


def long_doubles(df: DataFrame, exprs: list[Column]) -> DataFrame:
    """(column_id, value) pairs of double expressions, one Expand and no shuffle.

    One small generated loop serves any number of columns; a wide aggregate with
    hundreds of functions would outgrow what the JVM compiles.
    """
    wide = df.select(*[e.cast("double").alias(f"c{i}") for i, e in enumerate(exprs)])
    return wide.unpivot([], wide.columns, "column_id", "value")


def moments(df: DataFrame, exprs: list[Column]) -> list[Row]:
    """count, min, max, mean, var, skew of each expression, in order."""
    found: list[Row] = []
    for part in chunks(exprs, COLUMNS_PER_PASS):
        x = F.col("value")
        rows = (
            long_doubles(df, part)
            .groupBy("column_id")
            .agg(
                F.count(x).alias("count"),
                F.min(x).alias("min"),
                F.max(x).alias("max"),
                F.avg(x).alias("mean"),
                F.var_samp(x).alias("var"),
                adjusted_skewness(x).alias("skew"),
            )
            .collect()
        )
        by_id = {r["column_id"]: r for r in rows}
        empty = Row(count=0, min=None, max=None, mean=None, var=None, skew=0.0)
        found += [by_id.get(f"c{i}", empty) for i in range(len(part))]
    return found


def _counts(df: DataFrame, other: list[T.StructField]) -> tuple[int, dict[str, int], dict[str, int]]:
    """Row count, and non-NULL count and bytes of the non-numeric columns."""
    counts: dict[str, int] = {}
    text_bytes: dict[str, int] = {}
    n_rows = 0
    for part in chunks(other, COLUMNS_PER_PASS) or [[]]:
        aggs: list[Column] = [F.count(F.lit(1))]
        for f in part:
            aggs.append(F.count(col(f.name)))
            text = isinstance(f.dataType, T.StringType)
            aggs.append(F.sum(F.octet_length(col(f.name))) if text else F.lit(None).cast("bigint"))
        row = df.agg(*[a.alias(f"a{i}") for i, a in enumerate(aggs)]).first()
        n_rows = row[0]
        for i, f in enumerate(part):
            counts[f.name] = row[1 + 2 * i]
            if row[2 + 2 * i] is not None:
                text_bytes[f.name] = row[2 + 2 * i]
    return n_rows, counts, text_bytes


def _quartiles(df: DataFrame, table: TableStats) -> None:
    todo = [s for s in table.numeric if s.non_null]
    found = linear_quantiles(
        df,
        [as_double(s.column_name) for s in todo],
        [s.non_null for s in todo],
        QUARTILES,
        [(s.min, s.max) for s in todo],
    )
    for s, (q1, q2, q3) in zip(todo, found):
        s.q1, s.median, s.q3 = q1, q2, q3


def outside(c: Column, fences: tuple[float, float]) -> Column:
    return (c < F.lit(fences[0])) | (c > F.lit(fences[1]))


def _fences(df: DataFrame, table: TableStats) -> None:
    # A column without values beyond its fences needs no second look.
    todo = [s for s in table.numeric if s.q1 is not None]
    open_ended = [s for s in todo if s.min < s.fences[0] or s.max > s.fences[1]]
    for part in chunks(open_ended, COLUMNS_PER_PASS):
        row = df.agg(
            *[
                F.count_if(outside(as_double(s.column_name), s.fences)).alias(f"o{i}")
                for i, s in enumerate(part)
            ]
        ).first()
        for s, n in zip(part, row):
            s.outlier_count = n


def _value_jobs(df: DataFrame, todo: list[ColumnStats]) -> list:
    types = {f.name: f.dataType for f in df.schema.fields}
    groups: dict[str, list[ColumnStats]] = {}
    for s in todo:
        if s.non_null:
            groups.setdefault(_carrier(types[s.column_name], s), []).append(s)
        else:
            s.unique_count, s.top_count = 0, 0
    return [
        lambda part=part, carrier=carrier: _digest_values(df, part, types)
        if carrier == "digest"
        else _plain_values(df, part, types, carrier)
        for carrier, members in groups.items()
        for part in chunks(members, COLUMNS_PER_PASS)
    ]


def _carrier(dtype: T.DataType, s: ColumnStats) -> str:
    if isinstance(dtype, INTEGRAL):
        return "bigint"
    if is_numeric(dtype) and not isinstance(dtype, T.DecimalType):
        return "double"
    if isinstance(dtype, T.DecimalType):
        return dtype.simpleString()
    if s.text_bytes is not None and s.text_bytes > LONG_TEXT_BYTES * s.non_null:
        return "digest"
    return "string"


def carried(name: str, dtype: T.DataType, carrier: str) -> Column:
    return as_text(name, dtype) if carrier == "string" else col(name).cast(carrier)


def value_counts(df: DataFrame, exprs: dict[int, Column], value: str = "value") -> DataFrame:
    """Long frequency table (column id, value, count) of the non-NULL values.

    Unpivot becomes one Expand below a partial aggregate: hot values are
    combined before the shuffle, so their frequency does not matter.
    """
    wide = df.select(*[e.alias(f"c{i}") for i, e in exprs.items()])
    long = wide.unpivot([], [f"c{i}" for i in exprs], "column_id", value).filter(F.col(value).isNotNull())
    return long.groupBy("column_id", value).agg(F.count(F.lit(1)).alias("cnt"))


def _plain_values(df: DataFrame, part: list[ColumnStats], types: dict, carrier: str) -> None:
    exprs = {i: carried(s.column_name, types[s.column_name], carrier) for i, s in enumerate(part)}
    aggs = [F.count(F.lit(1)).alias("distinct"), F.max("cnt").alias("peak")]
    if carrier == "string":
        aggs.append(F.min_by("value", F.struct(-F.col("cnt"), F.col("value"))).alias("top"))
    for row in value_counts(df, exprs).groupBy("column_id").agg(*aggs).collect():
        s = part[int(row["column_id"][1:])]
        s.unique_count, s.top_count = row["distinct"], row["peak"]
        if carrier == "string":
            s.top_value = row["top"]


def digest(text: Column) -> Column:
    """What stands for a long text wherever texts are counted or looked up."""
    return F.unhex(F.sha2(text, 256))


def _digest_values(df: DataFrame, part: list[ColumnStats], types: dict) -> None:
    """Long text: shuffle 256-bit digests, then look up the text of the winners."""
    spark = df.sparkSession
    text = {i: as_text(s.column_name, types[s.column_name]) for i, s in enumerate(part)}
    counts = value_counts(df, {i: digest(t) for i, t in text.items()}, "digest")
    # How many values occur how often: gives the peak and the number of values that tie.
    spread = counts.groupBy("column_id", "cnt").agg(F.count(F.lit(1)).alias("values"))
    peak = spread.groupBy("column_id").agg(
        F.sum("values").alias("distinct"), F.max("cnt").alias("peak"), F.max_by("values", "cnt").alias("ties")
    )
    found = {int(r["column_id"][1:]): r for r in peak.collect()}
    for i, s in enumerate(part):
        s.unique_count, s.top_count = found[i]["distinct"], found[i]["peak"]
    unique = [i for i in text if found[i]["peak"] == 1]
    if unique:
        row = df.agg(*[F.min(text[i]).alias(f"m{i}") for i in unique]).first()
        for i in unique:
            part[i].top_value = row[f"m{i}"]
    repeated = {i: text[i] for i in text if i not in unique}
    if repeated:
        # Ties for the first place are settled by the smallest text among them.
        peaks = spark.createDataFrame(
            [(f"c{i}", found[i]["peak"]) for i in repeated], "column_id string, cnt bigint"
        )
        winners = counts.join(F.broadcast(peaks), ["column_id", "cnt"], "left_semi").select("column_id", "digest")
        if sum(found[i]["ties"] for i in repeated) <= BROADCAST_ROWS:
            # The texts are then filtered where they are read and never shuffled.
            winners = F.broadcast(winners)
        wide = df.select(*[t.alias(f"c{i}") for i, t in repeated.items()])
        long = (
            wide.unpivot([], [f"c{i}" for i in repeated], "column_id", "value")
            .withColumn("digest", digest(F.col("value")))
            .join(winners, ["column_id", "digest"], "left_semi")
        )
        for r in long.groupBy("column_id").agg(F.min("value").alias("value")).collect():
            part[int(r["column_id"][1:])].top_value = r["value"]


def duplicate_row_count(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier row (NULLs equal), as a one-row DataFrame.

    Grouping whole rows would shuffle the whole table. Instead one 64-bit hash per
    row is counted; only rows whose hash occurs more than once can be repeats and
    only those are grouped by their real values, so a hash collision cannot change
    the result. With few suspect hashes the other rows are dropped where they are read;
    with many, whole rows are grouped, where copies combine before the shuffle.
    """
    df = nan_to_null(df)
    keyed = df.select(
        *[
            (as_text(f.name, f.dataType) if is_nested(f.dataType) else col(f.name)).alias(f"k{i}")
            for i, f in enumerate(df.schema.fields)
        ]
    )
    keys = keyed.columns
    hashed = keyed.withColumn("h", F.xxhash64(*[F.col(k) for k in keys]))
    suspects = checkpointed(hashed.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h"))
    if suspects.count() <= SUSPECT_ROWS:
        keyed = hashed.join(F.broadcast(suspects), "h", "left_semi")
    groups = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("duplicate_row_count"))
