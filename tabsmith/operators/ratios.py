"""Ratio features: candidates are checked in a fixed order of rules, then applied."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
import json

from tabsmith.functions.expr import as_double, chunks, is_numeric, nan_to_null, safe_ratio
from tabsmith.operators.preprocess import StateModel
from tabsmith.plans.names import normal

# Limits of the candidate checks.
MIN_VARIANCE = 1e-4
MAX_MISSING = 0.5
MAX_CORRELATION = 0.98
MIN_NONZERO = 0.01
MIN_ROWS_FOR_CORRELATION = 5
MIN_STD_FOR_CORRELATION = 1e-7

REPORT_DDL = (
    "name string, numerator_col string, denominator_col string, status string, rule_id string, "
    "selected_action string, detected_statistic map<string,string>, threshold_condition string, reason string"
)


class RatioFeatures(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """``specs``: JSON list of {name, numerator_col, denominator_col, leakage_risk}."""

    specs = Param(Params._dummy(), "specs", "candidate features as JSON", TypeConverters.toString)
    leakageColumns = Param(Params._dummy(), "leakageColumns", "columns known to leak", TypeConverters.toListString)
    targetCol = Param(Params._dummy(), "targetCol", "target column", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, specs=None, leakageColumns=None, targetCol=None):
        super().__init__()
        self._setDefault(specs="[]", leakageColumns=[])
        given = {k: v for k, v in self._input_kwargs.items() if v is not None}
        if "specs" in given and not isinstance(given["specs"], str):
            given["specs"] = json.dumps(given["specs"])
        self._set(**given)

    def _fit(self, dataset: DataFrame) -> "RatioFeaturesModel":
        specs = json.loads(self.getOrDefault(self.specs))
        df = nan_to_null(dataset)
        verdicts = [self._by_schema(df, s) for s in specs]
        measured = [s for s, v in zip(specs, verdicts) if v is None]
        facts = iter(_measure(df, measured))
        report = [
            {**_entry(s), **(v if v is not None else _by_data(s, next(facts)))} for s, v in zip(specs, verdicts)
        ]
        return RatioFeaturesModel({"report": report})

    def _by_schema(self, df: DataFrame, s: dict) -> dict | None:
        """Rules that need names and types only."""
        num, den = s.get("numerator_col"), s.get("denominator_col")
        leaks = {normal(c) for c in self.getOrDefault(self.leakageColumns)}
        target = normal(self.getOrDefault(self.targetCol)) if self.isDefined(self.targetCol) else None
        types = {f.name: f.dataType for f in df.schema.fields}
        sides = [normal(str(num or "")), normal(str(den or ""))]
        rules = [
            ("RULE_FE_EXPLICIT_LEAKAGE", lambda: bool(s.get("leakage_risk")), "marked as leaking", "leakage_risk is false"),
            ("RULE_FE_TARGET_LEAKAGE", lambda: target is not None and target in sides, "uses the target", "source is not the target"),
            ("RULE_FE_SOURCE_LEAKAGE", lambda: bool(leaks.intersection(sides)), "uses a leaking column", "source not in leakage list"),
            ("RULE_FE_MISSING_NUMERATOR", lambda: num not in types, "numerator column is absent", "numerator exists"),
            ("RULE_FE_MISSING_DENOMINATOR", lambda: den not in types, "denominator column is absent", "denominator exists"),
            ("RULE_FE_NON_NUMERIC_NUMERATOR", lambda: not is_numeric(types[num]), "numerator is not numeric", "numerator is numeric"),
            ("RULE_FE_NON_NUMERIC_DENOMINATOR", lambda: not is_numeric(types[den]), "denominator is not numeric", "denominator is numeric"),
            ("RULE_FE_NAME_COLLISION", lambda: s.get("name") in types, "name is already a column", "name is new"),
        ]
        for rule, broken, reason, condition in rules:
            if broken():
                return _reject(rule, reason, condition, {"numerator": str(num), "denominator": str(den)})
        return None


def _entry(s: dict) -> dict:
    return {"name": s.get("name"), "numerator_col": s.get("numerator_col"), "denominator_col": s.get("denominator_col")}


def _reject(rule: str, reason: str, condition: str, stat: dict) -> dict:
    return {
        "status": "rejected", "rule_id": rule, "selected_action": "reject_candidate",
        "detected_statistic": {k: str(v) for k, v in stat.items()}, "threshold_condition": condition, "reason": reason,
    }


def _measure(df: DataFrame, specs: list[dict]) -> list[dict]:
    """All facts of all surviving candidates, a few aggregates for any number of rows."""
    out = []
    for part in chunks(specs, 6):
        aggs = []
        for s in part:
            num, den = as_double(s["numerator_col"]), as_double(s["denominator_col"])
            ratio = safe_ratio(num, den)
            aggs.append(
                F.struct(
                    F.count(F.lit(1)).alias("n"),
                    F.count(num).alias("num_n"),
                    F.count(den).alias("den_n"),
                    F.count_if(den != 0).alias("nonzero"),
                    F.var_pop(ratio).alias("variance"),
                    _pair(num, ratio).alias("num_pair"),
                    _pair(den, ratio).alias("den_pair"),
                )
            )
        row = df.agg(*[a.alias(f"s{i}") for i, a in enumerate(aggs)]).first()
        out += [r.asDict(recursive=True) for r in row]
    return out


def _pair(x: Column, y: Column) -> Column:
    """Centred sums over the complete rows; a correlation without a division."""
    return F.struct(
        F.regr_count(x, y).alias("n"), F.regr_sxx(x, y).alias("yy"), F.regr_syy(x, y).alias("xx"), F.regr_sxy(x, y).alias("xy")
    )


def _strength(p: dict) -> float:
    n = p["n"]
    if not n or n <= MIN_ROWS_FOR_CORRELATION:
        return 0.0
    x, y = (p["xx"] / n) ** 0.5, (p["yy"] / n) ** 0.5
    if x <= MIN_STD_FOR_CORRELATION or y <= MIN_STD_FOR_CORRELATION:
        return 0.0
    return abs(p["xy"] / n / (x * y))


def _by_data(s: dict, f: dict) -> dict:
    n = f["n"]
    nonzero = f["nonzero"] / n if n else 0.0
    if not f["den_n"] or nonzero < MIN_NONZERO:
        return _reject("RULE_FE_INVALID_DENOMINATOR", "denominator is almost always zero or missing",
                       f"non-zero share >= {MIN_NONZERO}", {"non_zero_ratio": round(nonzero, 4)})
    num_missing, den_missing = 1 - f["num_n"] / n, 1 - f["den_n"] / n
    if num_missing > MAX_MISSING or den_missing > MAX_MISSING:
        return _reject("RULE_FE_EXCESSIVE_MISSINGNESS", "a source column is mostly missing",
                       f"missing share <= {MAX_MISSING}",
                       {"numerator_missing_ratio": round(num_missing, 4), "denominator_missing_ratio": round(den_missing, 4)})
    variance = f["variance"] if f["variance"] is not None and n > 1 else 0.0
    if variance != variance or variance < MIN_VARIANCE:
        return _reject("RULE_FE_NEAR_ZERO_VARIANCE", "the ratio hardly varies", f"variance >= {MIN_VARIANCE}",
                       {"variance": round(variance, 6)})
    num_r, den_r = _strength(f["num_pair"]), _strength(f["den_pair"])
    stat = {"variance": round(variance, 6), "corr_numerator": round(num_r, 4), "corr_denominator": round(den_r, 4),
            "max_source_correlation": round(max(num_r, den_r), 4)}
    if max(num_r, den_r) > MAX_CORRELATION:
        return _reject("RULE_FE_COLLINEAR_REDUNDANCY", "the ratio repeats one of its sources", f"|r| <= {MAX_CORRELATION}", stat)
    return {
        "status": "accepted", "rule_id": "RULE_FE_ACCEPTED_VALID_SIGNAL", "selected_action": "accept_and_engineer",
        "detected_statistic": {k: str(v) for k, v in stat.items()}, "threshold_condition": "all checks passed",
        "reason": "sources are valid and the ratio adds something new",
    }


class RatioFeaturesModel(StateModel):
    @property
    def feature_names(self) -> list[str]:
        return [r["name"] for r in self.fitted["report"] if r["status"] == "accepted"]

    def _transform(self, df: DataFrame) -> DataFrame:
        present = set(df.columns)
        added = {
            r["name"]: safe_ratio(as_double(r["numerator_col"]), as_double(r["denominator_col"]))
            for r in self.fitted["report"]
            if r["status"] == "accepted" and {r["numerator_col"], r["denominator_col"]} <= present
        }
        return df.withColumns(added) if added else df

    def report(self, spark) -> DataFrame:
        """One row per candidate, accepted or rejected, with the rule that decided."""
        keys = [c.split()[0] for c in REPORT_DDL.split(", ")]
        return spark.createDataFrame([tuple(r[k] for k in keys) for r in self.fitted["report"]], REPORT_DDL)
