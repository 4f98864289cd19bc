"""Before/after comparison of a raw and a cleaned table."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.functions.expr import as_text, bin_edges, col, is_numeric, nan_to_null, percent
from tabsmith.functions.jobs import checkpointed, together
from tabsmith.functions.joins import BROADCAST_ROWS
from tabsmith.operators.eda import histogram_counts
from tabsmith.operators.stats import LONG_TEXT_BYTES, ColumnStats, TableStats, add_quartiles, add_values, digest, duplicate_row_count, table_stats

#: Characters of a long text that are counted beside its digest; they settle most ties without the text itself.
PREFIX = 64


class Comparison:
    """Statistics of both tables; each is measured once, when a report first needs it.

    Columns are numeric when they are numeric in the cleaned table; raw text values of
    such columns are read as numbers where possible. ``cleaned`` gives the columns of the
    cleaned table as expressions over the raw one: both sides are then measured in the
    same passes over the raw table.
    """

    def __init__(
        self,
        raw: DataFrame,
        clean: DataFrame,
        strategies: dict[str, str] | None = None,
        cleaned: dict[str, Column] | None = None,
    ):
        self.spark = raw.sparkSession
        self.original = nan_to_null(raw)
        self.clean = nan_to_null(clean)
        self.strategies = strategies or {}
        self.common = [c for c in raw.columns if c in clean.columns]
        kinds = {f.name: is_numeric(f.dataType) for f in self.clean.schema.fields}
        self.numeric = [c for c in self.common if kinds[c]]
        self.categorical = [c for c in self.common if not kinds[c]]
        before = self._columns("b", self.original, {c: col(c) for c in raw.columns})
        after = self._columns("a", self.clean, cleaned or {c: col(c) for c in clean.columns})
        if cleaned is None:
            self.frames = [self.original.select(*before), self.clean.select(*after)]
        else:
            self.frames = [self.original.select(*before, *after)]
        self.frames = [nan_to_null(f) for f in self.frames]

    def _columns(self, side: str, df: DataFrame, exprs: dict[str, Column]) -> list[Column]:
        """``<side><place>`` per common column, and ``<side>p<place>`` where only the number of values counts."""
        out = []
        for i, f in enumerate(df.schema.fields):
            convert = f.name in self.numeric and not is_numeric(f.dataType)
            if f.name in self.common:
                out.append((exprs[f.name].try_cast("double") if convert else exprs[f.name]).alias(f"{side}{self.common.index(f.name)}"))
            # Text that is no number counts as missing in the statistics, not in the raw table.
            if convert or f.name not in self.common:
                out.append(F.when(exprs[f.name].isNotNull(), True).alias(f"{side}p{i}"))
        return out

    @cached_property
    def _measured(self) -> list[TableStats]:
        return together(
            *[lambda f=f: table_stats(f, numeric_values=False, text_values=False, quantiles=False) for f in self.frames]
        )

    @cached_property
    def _columns_by_name(self) -> dict[str, ColumnStats]:
        return {s.column_name: s for t in self._measured for s in t.columns}

    def _of(self, side: str, name: str) -> ColumnStats:
        return self._columns_by_name[f"{side}{self.common.index(name)}"]

    def _presence(self, side: str, name: str) -> ColumnStats:
        """Statistics that hold the column's own number of missing values."""
        df = self.original if side == "b" else self.clean
        found = self._columns_by_name
        return found.get(f"{side}p{df.columns.index(name)}") or self._of(side, name)

    @cached_property
    def _quartiles_known(self) -> bool:
        together(*[lambda f=f, t=t: add_quartiles(f, t) for f, t in zip(self.frames, self._measured)])
        return True

    @cached_property
    def _values_known(self) -> bool:
        wanted = {f"{side}{self.common.index(c)}" for c in self.categorical for side in "ba"}
        together(*[lambda f=f, t=t: add_values(f, t, [c for c in f.columns if c in wanted]) for f, t in zip(self.frames, self._measured)])
        return True

    def _outliers(self, s: ColumnStats) -> int:
        return s.outlier_count if s.non_null >= 5 and s.iqr > 0 else 0

    def overall(self) -> DataFrame:
        """One row per side, and the share of missing values that were resolved."""
        dup_before, dup_after, _ = together(
            lambda: duplicate_row_count(self.original).first()[0],
            lambda: duplicate_row_count(self.clean).first()[0],
            lambda: self._quartiles_known,
        )

        def side(name: str, key: str, df: DataFrame, dup: int) -> tuple:
            rows = self._measured[0 if key == "b" else -1].n_rows
            missing = sum(self._presence(key, c).missing_count for c in df.columns)
            outliers = sum(self._outliers(self._of(key, c)) for c in self.numeric)
            return name, rows, len(df.columns), missing, dup, outliers

        rows = [side("before", "b", self.original, dup_before), side("after", "a", self.clean, dup_after)]
        frame = self.spark.createDataFrame(
            rows,
            "side string, num_rows bigint, num_columns bigint, missing_values bigint, duplicate_rows bigint, outliers bigint",
        )
        m0, m1 = rows[0][3], rows[1][3]
        resolved = F.round(F.lit(100.0 if m0 == 0 else (m0 - m1) / m0 * 100), 2)
        return frame.withColumn("missing_resolved_pct", resolved)

    def strategy(self, name: str) -> str:
        if name in self.strategies:
            return self.strategies[name]
        if name not in self.numeric:
            return "mode imputation"
        return "median imputation" if abs(self._of("b", name).skewness or 0.0) > 1.0 else "mean imputation"

    def numeric_columns(self) -> DataFrame:
        """One row per numeric column with both sides next to each other."""
        fields = ["missing", "outliers", "min", "max", "mean", "median", "std", "skewness"]

        assert self._quartiles_known

        def values(side: str, c: str) -> list:
            s = self._of(side, c)
            zero = lambda v: 0.0 if v is None else v
            return [self._presence(side, c).missing_count, self._outliers(s), *[zero(v) for v in (s.min, s.max, s.mean, s.median, s.std, s.skewness)]]

        n_before, n_after = self._measured[0].n_rows, self._measured[-1].n_rows
        rows = [(c, self.strategy(c), n_before, n_after, *values("b", c), *values("a", c)) for c in self.numeric]
        ddl = "column_name string, strategy string, rows_before bigint, rows_after bigint"
        for side in ("before", "after"):
            ddl += "".join(f", {side}_{f} {'bigint' if f in ('missing', 'outliers') else 'double'}" for f in fields)
        frame = self.spark.createDataFrame(rows, ddl)
        out = [F.col("column_name"), F.col("strategy")]
        for side in ("before", "after"):
            out.append(F.col(f"{side}_missing"))
            out.append(F.round(percent(F.col(f"{side}_missing"), F.col(f"rows_{side}")), 2).alias(f"{side}_missing_pct"))
            out.append(F.col(f"{side}_outliers"))
            out += [F.round(f"{side}_{f}", 4).alias(f"{side}_{f}") for f in fields[2:]]
        return frame.select(*out)

    def histograms(self, bins: int = 10) -> DataFrame:
        """Counts of both sides over common edges; one bin for a constant column."""
        ranges, grid = {}, []
        for i, c in enumerate(self.numeric):
            sides = [s for s in (self._of("b", c), self._of("a", c)) if s.non_null]
            lo, hi = min([s.min for s in sides] or [0.0]), max([s.max for s in sides] or [0.0])
            constant = lo == hi
            ranges[c] = (lo - 0.5, hi + 0.5) if constant else (lo, hi)
            edges = bin_edges(*ranges[c], 1 if constant else bins)
            for b in range(len(edges) - 1):
                grid.append((i, b, c, edges[b], edges[b + 1], constant))
        frame = self.spark.createDataFrame(
            grid, "column int, bin int, column_name string, bin_start double, bin_end double, constant boolean"
        )
        kinds = F.broadcast(frame.select("column", "constant").distinct())

        def counted(df: DataFrame) -> DataFrame:
            """(column, bin, b, a): at most two rows per column and bin."""
            names = {f"{side}{self.common.index(c)}": (i, side, ranges[c]) for i, c in enumerate(self.numeric) for side in "ba"}
            held = {n: v for n, v in names.items() if n in df.columns}
            places = self.spark.createDataFrame(
                [(f"c{k}", i, side) for k, (i, side, _) in enumerate(held.values())], "column_id string, column int, side string"
            )
            counts = histogram_counts(df, {n: v[2] for n, v in held.items()}, bins).join(F.broadcast(places), "column_id")
            # The single bin of a constant column takes all of its values.
            return counts.join(kinds, "column").select(
                "column", F.when(F.col("constant"), 0).otherwise(F.col("bin")).alias("bin"),
                *[F.when(F.col("side") == side, F.col("cnt")).alias(side) for side in "ba"],
            )

        if not self.numeric:
            return self.spark.createDataFrame(
                [], "column_name string, bin int, bin_start double, bin_end double, before_count bigint, after_count bigint"
            )
        counts = counted(self.frames[0])
        for f in self.frames[1:]:
            counts = counts.unionByName(counted(f))
        both = frame.join(counts.groupBy("column", "bin").agg(F.sum("b").alias("b"), F.sum("a").alias("a")), ["column", "bin"], "left")
        return both.select(
            "column_name", "bin", F.round("bin_start", 2).alias("bin_start"), F.round("bin_end", 2).alias("bin_end"),
            F.coalesce("b", F.lit(0)).cast("bigint").alias("before_count"),
            F.coalesce("a", F.lit(0)).cast("bigint").alias("after_count"),
        )

    def category_columns(self) -> DataFrame:
        """Missing and distinct values of the text columns on both sides."""
        assert self._values_known
        rows = [
            (c, self.strategy(c), self._presence("b", c).missing_count, self._presence("a", c).missing_count,
             self._of("b", c).unique_count, self._of("a", c).unique_count)
            for c in self.categorical
        ]
        return self.spark.createDataFrame(
            rows,
            "column_name string, strategy string, before_missing bigint, after_missing bigint, "
            "before_unique bigint, after_unique bigint",
        )

    def categories(self, top: int = 8) -> DataFrame:
        """Largest raw categories of the text columns, counted on both sides; ties go to the smaller text.

        Long texts are counted by their first characters and a digest; only the texts of candidates are read again.
        """
        if not self.categorical:
            return self.spark.createDataFrame(
                [], "column_name string, rank int, category string, before_count bigint, after_count bigint"
            )
        long = [c for c in self.categorical if self._is_long(c)]

        def shown(df: DataFrame, side: str, c: str) -> Column:
            name = f"{side}{self.common.index(c)}"
            return F.coalesce(as_text(name, df.schema[name].dataType), F.lit("(Missing)"))

        def entries(df: DataFrame) -> DataFrame:
            """(column, side, value, digest) of every value."""
            wide = {}
            for i, c in enumerate(self.categorical):
                for k, side in enumerate("ba"):
                    if f"{side}{self.common.index(c)}" in df.columns:
                        text = shown(df, side, c)
                        parts = (F.substring(text, 1, PREFIX), digest(text)) if c in long else (text, F.lit(None).cast("binary"))
                        wide[f"c{2 * i + k}"] = F.struct(parts[0].alias("value"), parts[1].alias("digest"))
            place = F.substring("id", 2, 10).cast("int")
            keys = df.select(*[e.alias(n) for n, e in wide.items()]).unpivot([], list(wide), "id", "key")
            return keys.select(F.floor(place / 2).cast("int").alias("column"), (place % 2).alias("side"), "key.value", "key.digest")

        found = entries(self.frames[0])
        for f in self.frames[1:]:
            found = found.unionByName(entries(f))
        counts = found.groupBy("column", "value", "digest").agg(
            F.count_if(F.col("side") == 0).alias("before_count"), F.count_if(F.col("side") == 1).alias("after_count")
        )
        # rank() <= top is applied per task first; it keeps long texts that tie in their first characters.
        order = Window.partitionBy("column").orderBy(F.desc("before_count"), "value")
        best = counts.filter("before_count > 0").withColumn("rank", F.rank().over(order)).filter(F.col("rank") <= top)
        if long:
            best = checkpointed(best)
            wanted = best.filter("digest is not null").select("column", "digest")
            wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
            df = self.frames[0]
            wide = df.select(*[shown(df, "b", c).alias(f"c{self.categorical.index(c)}") for c in long])
            texts = wide.unpivot([], wide.columns, "id", "text")
            texts = texts.select(F.substring("id", 2, 10).cast("int").alias("column"), digest(F.col("text")).alias("digest"), "text")
            texts = texts.join(wanted, ["column", "digest"], "left_semi").groupBy("column", "digest").agg(F.min("text").alias("text"))
            best = best.join(texts, ["column", "digest"], "left").withColumn("value", F.coalesce("text", "value"))
            best = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
        names = F.array(*[F.lit(c) for c in self.categorical])
        return best.select(
            F.element_at(names, F.col("column") + 1).alias("column_name"),
            "rank", F.col("value").alias("category"), "before_count", "after_count",
        )

    def _is_long(self, name: str) -> bool:
        s = self._of("b", name)
        return s.text_bytes is not None and s.text_bytes > LONG_TEXT_BYTES * s.non_null
