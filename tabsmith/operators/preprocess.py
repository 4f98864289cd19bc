"""Preprocessing as Spark ML stages: statistics from the training rows only.

``HybridPreprocessor`` follows the decision plan: impute, log1p and scale numeric
columns, impute and encode text columns. A fitted model is one projection (plus one
dictionary join per text column with many categories), so it works the same on a
batch, on a stream and after a reload.
"""

from __future__ import annotations

import json
import re

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import (
    DefaultParamsReadable,
    DefaultParamsReader,
    DefaultParamsWritable,
    DefaultParamsWriter,
)
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsmith.functions.expr import as_double, as_text, chunks, col, finite, is_numeric, nan_to_null
from tabsmith.functions.jobs import together
from tabsmith.functions.joins import HOT_SHARE, fits_broadcast, lookup, ranked_dictionary
from tabsmith.functions.quantiles import linear_quantiles
from tabsmith.operators.stats import COLUMNS_PER_PASS, QUARTILES, moments, outside, table_stats, value_counts
from tabsmith.plans.rules import Thresholds, decision_plan, decision_trace


class StateModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """A model whose fitted values are one JSON parameter."""

    state = Param(Params._dummy(), "state", "fitted values as JSON", TypeConverters.toString)

    def __init__(self, state: dict | None = None):
        super().__init__()
        if state is not None:
            self._set(state=json.dumps(state))

    @property
    def fitted(self) -> dict:
        return json.loads(self.getOrDefault(self.state))


# ---- numeric steps -----------------------------------------------------------------


def numeric_fill(s, threshold: float) -> tuple[str, float]:
    """Imputation method and value of a numeric column from its train statistics."""
    if not s.non_null:
        return "mean", 0.0
    if abs(s.skewness) < threshold:
        return "mean_imputation", s.mean
    return "median_imputation", s.median


def unit(scale: float | None) -> float:
    return scale if scale else 1.0


def fit_numeric(df: DataFrame, columns: list, t: Thresholds) -> list[dict]:
    """Fit impute, log1p and scale in sequence, each on the output of the one before.

    ``columns`` are ColumnStats of the raw train data; columns that a step leaves as
    they are keep their statistics, the others are measured again.
    """
    out = []
    for s in columns:
        method, fill = numeric_fill(s, t.skewness)
        out.append({"name": s.column_name, "method": method, "fill": fill, "skewness": s.skewness or 0.0})
    n = columns[0].n_rows if columns else 0
    filled = [(f, s) for f, s in zip(out, columns) if s.missing_count]
    again = moments(df, [F.coalesce(as_double(f["name"]), F.lit(f["fill"])) for f, _ in filled])
    shape = {s.column_name: (s.skewness, s.min, s.mean, s.variance_pop) for s in columns}
    for (f, _), m in zip(filled, again):
        shape[f["name"]] = (m["skew"], m["min"], m["mean"], _pop(m["var"], n))
    for f in out:
        skew, low = shape[f["name"]][:2]
        f["log"] = bool(abs(skew) > t.skewness and low >= 0)
    changed = [(f, s) for f, s in zip(out, columns) if s.missing_count or f["log"]]
    exprs = [numeric_value(as_double(f["name"]), f) for f, _ in changed]
    measured = moments(df, exprs)
    quartiles = linear_quantiles(df, exprs, [n] * len(exprs), QUARTILES, [(m["min"], m["max"]) for m in measured])
    final = {s.column_name: (s.mean, s.variance_pop, s.q1, s.median, s.q3, s.outlier_count) for s in columns}
    fences = [(q[0] - 1.5 * (q[2] - q[0]), q[2] + 1.5 * (q[2] - q[0])) for q in quartiles]
    outliers: list[int] = []
    for part in chunks(list(zip(exprs, fences)), COLUMNS_PER_PASS):
        row = df.agg(*[F.count_if(outside(e, b)).alias(f"o{i}") for i, (e, b) in enumerate(part)]).first()
        outliers += list(row)
    for (f, _), m, q, o in zip(changed, measured, quartiles, outliers):
        final[f["name"]] = (m["mean"], _pop(m["var"], n), *q, o)
    for f in out:
        mean, var, q1, median, q3, count = final[f["name"]]
        share = count / n if n else 0.0
        f["outlier_share"] = share
        if share > t.outlier:
            f.update(scaler="RobustScaler", center=median, scale=unit(q3 - q1))
        else:
            f.update(scaler="StandardScaler", center=mean, scale=unit(var**0.5))
    return out


def _pop(var: float | None, n: int) -> float:
    return (var or 0.0) * (n - 1) / n if n else 0.0


def numeric_value(x: Column, f: dict) -> Column:
    """Imputed, then log1p where decided."""
    v = F.coalesce(x, F.lit(f["fill"]))
    return F.log1p(F.greatest(v, F.lit(0.0))) if f["log"] else v


def scaled(x: Column, center: float, scale: float) -> Column:
    return (x - F.lit(center)) / F.lit(scale)


# ---- text steps --------------------------------------------------------------------


def categories_of(df: DataFrame, names: list[str], missing: str | None = None) -> dict[str, list[tuple[str, int]]]:
    """(category, count) per column, for columns known to have few categories."""
    if not names:
        return {}
    types = {f.name: f.dataType for f in df.schema.fields}
    fill = (lambda c: F.coalesce(c, F.lit(missing))) if missing is not None else (lambda c: c)
    rows = value_counts(df, {i: fill(as_text(n, types[n])) for i, n in enumerate(names)}).collect()
    out: dict[str, list[tuple[str, int]]] = {n: [] for n in names}
    for r in rows:
        out[names[int(r["column_id"][1:])]].append((r["value"], r["cnt"]))
    return {n: sorted(v) for n, v in out.items()}


def safe_names(labels: list[str]) -> list[str]:
    """Column names for feature labels: none holds a dot or backtick, and no two are the same, whatever their case.

    Most labels are their own names; the others get "_" for these characters and a number where names meet.
    """
    names: list[str] = []
    taken = {x.lower() for x in labels if not re.search("[.`]", x)}
    seen: set[str] = set()
    for label in labels:
        plain = re.sub("[.`]", "_", label)
        name, n = plain, 1
        while name.lower() in seen or (name != label and name.lower() in taken):
            n += 1
            name = f"{plain}_{n}"
        seen.add(name.lower())
        names.append(name)
    return names


def one_hot(c: Column, category: str) -> Column:
    return F.when(c == F.lit(category), F.lit(1.0)).otherwise(F.lit(0.0))


# Columns of a row on its way into a vector.
DENSE, TOKENS, HOT = "_tabsmith_dense", "_tabsmith_tokens", "_tabsmith_hot"


def token(place: int, category: str) -> str:
    """Slot of a category of the text column at a place; no two columns share one."""
    return f"{place}\x1f{category}"


def as_vector(df: DataFrame, kept: list[str], dense: list[Column], tokens: list[Column], slots: list[str], labels: list[str], output: str) -> DataFrame:
    """Kept columns and one vector: the dense features, then one slot per category, found by a dictionary.

    A row holds one token per text column, so its cost follows the columns, not the categories. ``labels`` go into the column's
    ML attributes, slot by slot.
    """
    numbers = [f"{DENSE}{i}" for i in range(len(dense))]
    out = df.select(*[col(c) for c in kept], *[d.alias(n) for d, n in zip(dense, numbers)], F.array_compact(F.array(*tokens).cast("array<string>")).alias(TOKENS))
    parts = list(numbers)
    if slots:
        out = CountVectorizerModel.from_vocabulary(slots, TOKENS, HOT, binary=True).transform(out)
        parts.append(HOT)
    out = VectorAssembler(inputCols=parts, outputCol=output).transform(out)
    attributes = {"attrs": {"numeric": [{"idx": i, "name": x} for i, x in enumerate(labels)]}, "num_attrs": len(labels)}
    return out.select(*[col(c) for c in kept], col(output)).withMetadata(output, {"ml_attr": attributes})


class DictionaryModel(StateModel):
    """A fitted model that also keeps a value dictionary, stored as Parquet."""

    def __init__(self, state: dict | None = None, dictionary: DataFrame | None = None):
        super().__init__(state)
        self.dictionary = dictionary

    def write(self):
        return _DictionaryWriter(self)

    @classmethod
    def read(cls):
        return _DictionaryReader(cls)

    def copy(self, extra=None):
        twin = super().copy(extra)
        twin.dictionary = self.dictionary
        return twin

    def encode_ordinal(self, df: DataFrame, entries: list[dict], raw: dict[str, Column | None], fill: dict[str, str]) -> DataFrame:
        """Add one code column per entry; values not in the dictionary stay NULL.

        Missing values have the code of the value that fills them, and absent columns (None) that of "missing": known from
        fitting, so these rows never take part in a join on one hot key.
        """
        for i, e in enumerate(entries):
            key, out, text = f"_key{i}", f"_idx{i}", raw[e["name"]]
            if text is None:
                df = df.withColumn(out, F.lit(e["codes"].get("missing")).cast("double"))
                continue
            known = self.dictionary.filter(F.col("column_id") == e["name"])
            df = lookup(df.withColumn(key, text), key, known, e["rows"], e["bytes"], e["hot"], out)
            filled = F.lit(e["codes"].get(fill[e["name"]])).cast("double")
            df = df.withColumn(out, F.when(F.col(key).isNull(), filled).otherwise(F.col(out))).drop(key)
        return df


class _DictionaryWriter(DefaultParamsWriter):
    def saveImpl(self, path: str) -> None:
        super().saveImpl(path)
        if self.instance.dictionary is not None:
            self.instance.dictionary.write.mode("overwrite").parquet(path.rstrip("/") + "/dictionary")


class _DictionaryReader(DefaultParamsReader):
    def load(self, path: str):
        model = super().load(path)
        if model.fitted["ordinal"]:
            model.dictionary = self.sparkSession.read.parquet(path.rstrip("/") + "/dictionary")
        return model


def fit_dictionary(
    df: DataFrame, names: list[str], sizes: dict[str, int], n_rows: int, missing: str | None = None, fills: dict[str, str] | None = None
) -> tuple[DataFrame | None, list[dict]]:
    """Sorted value dictionary of several columns and the lookup facts of each.

    `fills` names the value that stands for missing ones; its code is kept with the facts.
    """
    if not names:
        return None, []
    types = {f.name: f.dataType for f in df.schema.fields}
    fill = (lambda c: F.coalesce(c, F.lit(missing))) if missing is not None else (lambda c: c)
    counts = value_counts(df, {i: fill(as_text(n, types[n])) for i, n in enumerate(names)})
    label = F.element_at(F.array(*[F.lit(n) for n in names]), F.substring("column_id", 2, 10).cast("int") + 1)
    counts = counts.withColumn("column_id", label)
    dictionary = ranked_dictionary(counts, sum(sizes[n] + 1 for n in names), len(names))
    # One row per column: how large each dictionary really is.
    facts = dictionary.groupBy("column_id").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("value")).alias("bytes")
    )
    measured = {r["column_id"]: r for r in facts.collect()}
    # At most two values per column.
    standing = F.array(F.lit("missing"), *[F.lit(v) for v in {missing, *(fills or {}).values()} if v is not None])
    codes: dict[str, dict[str, float]] = {n: {} for n in names}
    for r in dictionary.filter(F.array_contains(standing, F.col("value"))).collect():
        if r["value"] in ("missing", missing, (fills or {}).get(r["column_id"])):
            codes[r["column_id"]][r["value"]] = r["idx"]
    entries = []
    for n in names:
        rows, size = (measured[n]["rows"], measured[n]["bytes"]) if n in measured else (0, 0)
        hot: list[str] = []
        if not fits_broadcast(rows, size):
            # Fewer than HOT_SHARE values can each hold more than 1 / HOT_SHARE of the rows.
            often = dictionary.filter((F.col("column_id") == n) & (F.col("cnt") * HOT_SHARE > n_rows))
            hot = [r["value"] for r in often.select("value").collect()]
        entries.append({"name": n, "rows": rows, "bytes": size, "hot": hot, "codes": codes[n]})
    return dictionary, entries


# ---- the hybrid preprocessor -------------------------------------------------------


class HybridPreprocessor(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Plan-driven preprocessing of the columns in ``inputCols`` (default: all)."""

    inputCols = Param(Params._dummy(), "inputCols", "predictor columns", TypeConverters.toListString)
    leakageColumns = Param(Params._dummy(), "leakageColumns", "columns to keep out", TypeConverters.toListString)
    skewnessThreshold = Param(Params._dummy(), "skewnessThreshold", "skewness limit", TypeConverters.toFloat)
    outlierThreshold = Param(Params._dummy(), "outlierThreshold", "outlier share limit", TypeConverters.toFloat)
    cardinalityThreshold = Param(Params._dummy(), "cardinalityThreshold", "one-hot limit", TypeConverters.toInt)
    vectorCol = Param(Params._dummy(), "vectorCol", "one vector column instead of a column per feature", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCols=None, leakageColumns=None, skewnessThreshold=1.0, outlierThreshold=0.02, cardinalityThreshold=15, vectorCol=None):
        super().__init__()
        self._setDefault(skewnessThreshold=1.0, outlierThreshold=0.02, cardinalityThreshold=15)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> "HybridPreprocessorModel":
        spark = dataset.sparkSession
        names = self.getOrDefault(self.inputCols) if self.isDefined(self.inputCols) else dataset.columns
        leakage = self.getOrDefault(self.leakageColumns) if self.isDefined(self.leakageColumns) else None
        t = Thresholds(
            self.getOrDefault(self.skewnessThreshold),
            self.getOrDefault(self.outlierThreshold),
            self.getOrDefault(self.cardinalityThreshold),
        )
        df = nan_to_null(dataset.select(*[col(n) for n in names]))
        stats = table_stats(df, numeric_values=False)
        plan = decision_plan(stats, spark, leakage, t)
        status = {r["column_name"]: r["status"] for r in plan.select("column_name", "status").collect()}
        usable = [s for s in stats.columns if status[s.column_name] == "usable_numeric"]
        text = [s for s in stats.columns if status[s.column_name] == "usable_categorical"]
        few = [s for s in text if s.unique_count <= t.cardinality]
        many = [s for s in text if s.unique_count > t.cardinality]
        numeric, cats, (dictionary, ordinal) = together(
            lambda: fit_numeric(df, usable, t),
            lambda: categories_of(df, [s.column_name for s in few]),
            lambda: fit_dictionary(
                df, [s.column_name for s in many], {s.column_name: s.unique_count for s in many}, stats.n_rows,
                fills={s.column_name: s.top_value for s in many},
            ),
        )
        trace = [r.asDict(recursive=True) for r in decision_trace(plan).collect()]
        state = {
            "inputs": names,
            "numeric": numeric,
            "text": [
                {
                    "name": s.column_name,
                    "mode": s.top_value,
                    "cardinality": s.unique_count,
                    "encoder": "OneHotEncoder" if s.unique_count <= t.cardinality else "OrdinalEncoder",
                    "categories": [c for c, _ in cats.get(s.column_name, [])],
                }
                for s in text
            ],
            "ordinal": ordinal,
            "status": status,
            "trace": trace,
            "vector": self.getOrDefault(self.vectorCol) if self.isDefined(self.vectorCol) else None,
        }
        return HybridPreprocessorModel(state, dictionary)


class HybridPreprocessorModel(DictionaryModel):
    """Fitted plan. ``transform`` replaces the input columns by the features."""

    @property
    def feature_names(self) -> list[str]:
        """Names of the feature columns, in the order of ``feature_labels``."""
        return safe_names(self.feature_labels)

    @property
    def feature_labels(self) -> list[str]:
        """What the features stand for: column, or column and category."""
        s = self.fitted
        names = [f["name"] for f in s["numeric"]]
        for f in s["text"]:
            if f["encoder"] == "OneHotEncoder":
                names += [f"{f['name']}_{c}" for c in f["categories"]]
            else:
                names.append(f"{f['name']}_ordinal")
        return names

    @property
    def vector_labels(self) -> list[str]:
        """What the slots of a vector stand for: numbers and codes first, then the categories."""
        s = self.fitted
        coded = [f for f in s["text"] if f["encoder"] != "OneHotEncoder"]
        hot = [f for f in s["text"] if f["encoder"] == "OneHotEncoder"]
        return [f["name"] for f in s["numeric"]] + [f"{f['name']}_ordinal" for f in coded] + [f"{f['name']}_{c}" for f in hot for c in f["categories"]]

    def _inputs(self, df: DataFrame) -> tuple[dict[str, Column], dict[str, Column]]:
        """Numeric and imputed text expressions; absent columns count as missing."""
        s = self.fitted
        types = {f.name: f.dataType for f in df.schema.fields}
        numeric = {}
        for f in s["numeric"]:
            x = as_double(f["name"]) if f["name"] in types else F.lit(None).cast("double")
            numeric[f["name"]] = F.when(~F.isnan(x), x)
        text = {}
        for f in s["text"]:
            if f["name"] in types:
                text[f["name"]] = F.coalesce(as_text(f["name"], types[f["name"]]), F.lit(f["mode"]))
            else:
                text[f["name"]] = F.lit("missing")
        return numeric, text

    def _transform(self, df: DataFrame) -> DataFrame:
        s = self.fitted
        numeric, text = self._inputs(df)
        kept = [c for c in df.columns if c not in set(s["inputs"])]
        types = {f.name: f.dataType for f in df.schema.fields}
        raw = {f["name"]: as_text(f["name"], types[f["name"]]) if f["name"] in types else None for f in s["text"]}
        df = self.encode_ordinal(df, s["ordinal"], raw, {f["name"]: f["mode"] for f in s["text"]})
        place = {e["name"]: i for i, e in enumerate(s["ordinal"])}
        features = [
            finite(scaled(numeric_value(numeric[f["name"]], f), f["center"], f["scale"]))
            for f in s["numeric"]
        ]
        code = {n: F.coalesce(F.col(f"_idx{i}"), F.lit(-1.0)) for n, i in place.items()}
        if s.get("vector"):
            hot = [f for f in s["text"] if f["encoder"] == "OneHotEncoder"]
            tokens = [F.concat(F.lit(token(i, "")), text[f["name"]]) for i, f in enumerate(hot)]
            slots = [token(i, c) for i, f in enumerate(hot) for c in f["categories"]]
            dense = features + [code[f["name"]] for f in s["text"] if f["name"] in code]
            return as_vector(df, kept, dense, tokens, slots, self.vector_labels, s["vector"])
        for f in s["text"]:
            if f["encoder"] == "OneHotEncoder":
                features += [one_hot(text[f["name"]], c) for c in f["categories"]]
            else:
                features.append(code[f["name"]])
        return df.select(*[col(c) for c in kept], *[f.alias(n) for f, n in zip(features, self.feature_names)])

    def transform_cleaned(self, df: DataFrame) -> DataFrame:
        """Imputed only: original scale, text and order; unusable columns dropped.

        Numeric columns come out as double, text columns as string.
        """
        return df.select(*[e.alias(c) for c, e in self.cleaned_columns(df).items()])

    def cleaned_columns(self, df: DataFrame) -> dict[str, Column]:
        """The columns of ``transform_cleaned`` as expressions over the raw ones."""
        s = self.fitted
        numeric, text = self._inputs(df)
        fills = {f["name"]: f["fill"] for f in s["numeric"]}
        types = {f.name: f.dataType for f in df.schema.fields}
        out = {}
        for c in df.columns:
            if c in fills:
                out[c] = F.coalesce(numeric[c], F.lit(fills[c]))
            elif c in text:
                out[c] = text[c]
            elif c not in set(s["inputs"]):
                out[c] = col(c)
        absent = [c for c in [*fills, *text] if c not in types]
        return out | {c: F.lit(fills[c]) if c in fills else text[c] for c in absent}

    def metadata(self, spark) -> DataFrame:
        """One row per usable column: what was fitted for it."""
        s = self.fitted
        rows = [
            (f["name"], "numeric", f["method"], str(round(f["fill"], 4)), round(f["skewness"], 4), f["log"],
             f["scaler"], round(f["outlier_share"] * 100, 2), None, None)
            for f in s["numeric"]
        ]
        rows += [
            (f["name"], "categorical/text", "most_frequent_imputation", f["mode"], None, None, None, None,
             f["encoder"], f["cardinality"])
            for f in s["text"]
        ]
        return spark.createDataFrame(
            rows,
            "column_name string, data_type string, imputation_method string, imputed_value string, skewness double, "
            "log1p_applied boolean, scaler_type string, outlier_percentage double, encoder_type string, cardinality bigint",
        )

    def trace(self, spark) -> DataFrame:
        """Planned action per rule, with the action that was applied after fitting.

        The plan looks at raw data; log and scaling are fitted on imputed data, so the two
        may differ.
        """
        s = self.fitted
        applied = {}
        for f in s["numeric"]:
            applied[f["name"], "log_transformation"] = "log1p_transformation" if f["log"] else "none"
            applied[f["name"], "scaling"] = f["scaler"]
        rows = [
            (r["position"], r["step"], r["column_name"], r["stage"], r["rule_id"], r["selected_action"],
             applied.get((r["column_name"], r["stage"]), r["selected_action"]), r["detected_statistic"],
             r["threshold_condition"], r["reason"], r["resulting_feature_change"])
            for r in s["trace"]
        ]
        return spark.createDataFrame(
            rows,
            "position int, step int, column_name string, stage string, rule_id string, planned_action string, "
            "applied_action string, detected_statistic map<string,string>, threshold_condition string, reason string, "
            "resulting_feature_change string",
        )


# ---- plain preprocessing of the baseline runs --------------------------------------


class PlainPreprocessor(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Mean imputation and standard scaling; text as ordinal codes or capped one-hot.

    Missing text is a category of its own here (``nan``), as in the baselines this
    reproduces, so no mode imputation takes place.
    """

    inputCols = Param(Params._dummy(), "inputCols", "predictor columns", TypeConverters.toListString)
    encoding = Param(Params._dummy(), "encoding", "ordinal or onehot", TypeConverters.toString)
    maxCategories = Param(Params._dummy(), "maxCategories", "one-hot columns per text column", TypeConverters.toInt)
    vectorCol = Param(Params._dummy(), "vectorCol", "one vector column instead of a column per feature", TypeConverters.toString)

    MISSING = "nan"

    @keyword_only
    def __init__(self, *, inputCols=None, encoding="ordinal", maxCategories=15, vectorCol=None):
        super().__init__()
        self._setDefault(encoding="ordinal", maxCategories=15)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> "PlainPreprocessorModel":
        names = self.getOrDefault(self.inputCols) if self.isDefined(self.inputCols) else dataset.columns
        df = nan_to_null(dataset.select(*[col(n) for n in names]))
        fields = {f.name: f.dataType for f in df.schema.fields}
        numeric = [n for n in names if is_numeric(fields[n])]
        text = [n for n in names if not is_numeric(fields[n])]
        capped = self.getOrDefault(self.encoding) == "onehot"
        stats = table_stats(df, numeric_values=False, text_values=False, quantiles=False)
        num = []
        for n in numeric:
            s = stats[n]
            mean = s.mean if s.non_null else 0.0
            # Filling with the mean leaves the mean and spreads the variance over all rows.
            var = (s.variance_pop or 0.0) * s.non_null / s.n_rows if s.n_rows else 0.0
            num.append({"name": n, "fill": mean, "log": False, "center": mean, "scale": unit(var**0.5)})
        vector = self.getOrDefault(self.vectorCol) if self.isDefined(self.vectorCol) else None
        state = {"inputs": names, "numeric": num, "text": [], "ordinal": [], "vector": vector}
        dictionary = None
        coded = text
        if capped:
            # The rare categories are kept as a dictionary to tell them from unseen ones.
            state["text"] = self._top_categories(df, text)
            coded = [f["name"] for f in state["text"] if f["infrequent"]]
        dictionary, state["ordinal"] = fit_dictionary(df, coded, self._sizes(df, coded), stats.n_rows, self.MISSING)
        return PlainPreprocessorModel(state, dictionary)

    def _sizes(self, df: DataFrame, text: list[str]) -> dict[str, int]:
        if not text:
            return {}
        got = table_stats(df.select(*[col(n) for n in text]))
        return {s.column_name: s.unique_count for s in got.columns}

    def _top_categories(self, df: DataFrame, text: list[str]) -> list[dict]:
        """The most frequent categories; the rest share one column."""
        if not text:
            return []
        cap = self.getOrDefault(self.maxCategories)
        types = {f.name: f.dataType for f in df.schema.fields}
        counts = value_counts(
            df, {i: F.coalesce(as_text(n, types[n]), F.lit(self.MISSING)) for i, n in enumerate(text)}
        )
        # rank <= cap becomes a per-task limit before the shuffle.
        order = Window.partitionBy("column_id").orderBy(F.desc("cnt"), "value")
        top = counts.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= cap + 1).collect()
        out = []
        for i, n in enumerate(text):
            mine = [r["value"] for r in sorted((r for r in top if r["column_id"] == f"c{i}"), key=lambda r: r["r"])]
            rare = len(mine) > cap
            out.append({"name": n, "categories": sorted(mine[: cap - 1] if rare else mine), "infrequent": rare})
        return out


class PlainPreprocessorModel(DictionaryModel):
    @property
    def feature_names(self) -> list[str]:
        """Names of the feature columns, in the order of ``feature_labels``."""
        return safe_names(self.feature_labels)

    @property
    def feature_labels(self) -> list[str]:
        s = self.fitted
        spread = {f["name"] for f in s["text"]}
        names = [f["name"] for f in s["numeric"]] + [e["name"] for e in s["ordinal"] if e["name"] not in spread]
        for f in s["text"]:
            names += [f"{f['name']}_{c}" for c in f["categories"]]
            names += [f"{f['name']}_infrequent_sklearn"] if f["infrequent"] else []
        return names

    def _transform(self, df: DataFrame) -> DataFrame:
        s = self.fitted
        types = {f.name: f.dataType for f in df.schema.fields}
        kept = [c for c in df.columns if c not in set(s["inputs"])]
        text = {
            e["name"]: F.coalesce(as_text(e["name"], types[e["name"]]), F.lit(PlainPreprocessor.MISSING))
            for e in s["ordinal"] + s["text"]
        }
        raw = {e["name"]: as_text(e["name"], types[e["name"]]) for e in s["ordinal"]}
        df = self.encode_ordinal(df, s["ordinal"], raw, {e["name"]: PlainPreprocessor.MISSING for e in s["ordinal"]})
        out = []
        for f in s["numeric"]:
            x = as_double(f["name"])
            out.append(finite(scaled(numeric_value(F.when(~F.isnan(x), x), f), f["center"], f["scale"])))
        spread = {f["name"] for f in s["text"]}
        index = {e["name"]: F.col(f"_idx{i}") for i, e in enumerate(s["ordinal"])}
        out += [F.coalesce(i, F.lit(-1.0)) for n, i in index.items() if n not in spread]
        # A category that was rare in training; one never seen stays all zero.
        rare = {f["name"]: ~text[f["name"]].isin(f["categories"]) & index[f["name"]].isNotNull() for f in s["text"] if f["infrequent"]}
        if s.get("vector"):
            tokens, slots = [], []
            for i, f in enumerate(s["text"]):
                # Rare values take the slot of a place of its own, so no value can name it.
                other = token(i + len(s["text"]), "")
                own = F.concat(F.lit(token(i, "")), text[f["name"]])
                tokens.append(F.when(rare[f["name"]], F.lit(other)).otherwise(own) if f["infrequent"] else own)
                slots += [token(i, c) for c in f["categories"]] + ([other] if f["infrequent"] else [])
            return as_vector(df, kept, out, tokens, slots, self.feature_labels, s["vector"])
        for f in s["text"]:
            out += [one_hot(text[f["name"]], c) for c in f["categories"]]
            if f["infrequent"]:
                out.append(F.when(rare[f["name"]], 1.0).otherwise(0.0))
        return df.select(*[col(c) for c in kept], *[f.alias(n) for f, n in zip(out, self.feature_names)])


# ---- standardisation of a finished feature matrix ----------------------------------


class FeatureStandardizer(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Zero mean, unit population variance for ``inputCols``; constant columns only centred."""

    inputCols = Param(Params._dummy(), "inputCols", "feature columns", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, inputCols=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> "FeatureStandardizerModel":
        names = self.getOrDefault(self.inputCols)
        found = moments(dataset, [finite(as_double(n)) for n in names])
        state = {
            "features": [
                {"name": n, "center": m["mean"] or 0.0, "scale": unit(_pop(m["var"], m["count"]) ** 0.5)}
                for n, m in zip(names, found)
            ]
        }
        return FeatureStandardizerModel(state)


class FeatureStandardizerModel(StateModel):
    def _transform(self, df: DataFrame) -> DataFrame:
        known = {f["name"]: f for f in self.fitted["features"]}
        return df.select(
            *[
                scaled(finite(as_double(c)), known[c]["center"], known[c]["scale"]).alias(c) if c in known else col(c)
                for c in df.columns
            ]
        )


def vector_scaler(df: DataFrame, vector: str, output: str) -> ElementwiseProduct:
    """Unit population variance for every slot of a vector; constant slots stay. Nothing is centred, so sparse vectors stay sparse.

    A learner with an intercept that is not penalised finds the same coefficients as on centred features.
    """
    # One value per slot.
    found = df.select(Summarizer.metrics("variance", "count").summary(col(vector)).alias("m")).select("m.*").first()
    n = found["count"]
    scales = [1.0 / unit(_pop(v, n) ** 0.5) for v in found["variance"].toArray()]
    return ElementwiseProduct(scalingVec=Vectors.dense(scales), inputCol=vector, outputCol=output)


class FiniteGuard(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """NULL, NaN and infinities of ``inputCols`` become 0.0; absent columns are added as 0.0."""

    inputCols = Param(Params._dummy(), "inputCols", "feature columns", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, inputCols=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, df: DataFrame) -> DataFrame:
        names = self.getOrDefault(self.inputCols)
        require_numeric(df, [n for n in names if n in df.columns])
        kept = [c for c in df.columns if c not in set(names)]
        present = set(df.columns)
        return df.select(
            *[col(c) for c in kept],
            *[(finite(as_double(n)) if n in present else F.lit(0.0)).alias(n) for n in names],
        )


def require_numeric(df: DataFrame, names: list[str], stage: str = "features") -> None:
    """Raise and name the columns that are not numeric."""
    bad = [f.name for f in df.schema.fields if f.name in set(names) and not is_numeric(f.dataType)]
    if bad:
        raise ValueError(f"Non-numeric columns detected in {stage}: {bad}.")
