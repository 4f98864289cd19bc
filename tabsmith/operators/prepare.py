"""One call from a raw table to prepared train and test rows and a cleaned table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from tabsmith.functions.expr import col, nan_to_null
from tabsmith.operators.compare import Comparison
from tabsmith.operators.preprocess import HybridPreprocessor, HybridPreprocessorModel
from tabsmith.operators.split import class_distribution, holdout_split
from tabsmith.plans.names import normal


@dataclass
class Prepared:
    target: str | None
    model: HybridPreprocessorModel
    train: DataFrame
    test: DataFrame
    cleaned: DataFrame
    class_distribution: DataFrame | None
    raw: DataFrame

    @property
    def comparison(self) -> Comparison:
        """Before/after statistics; computed when asked for."""
        return Comparison(self.raw, self.cleaned, self.model.fitted["status"], self.model.cleaned_columns(self.raw))


def prepare_dataset(
    df: DataFrame,
    target: str | None = None,
    leakage: list[str] | None = None,
    test_size: float = 0.20,
    seed: int = 42,
    key: list[str] | None = None,
    skewness_threshold: float = 1.0,
    outlier_threshold: float = 0.02,
    cardinality_threshold: int = 15,
) -> Prepared:
    """Split, fit on the train side only, transform both sides and clean all rows.

    Without a target a column named ``late_delivery_risk`` is taken, else the split is
    plain. ``leakage=None`` uses the default names.
    """
    df = nan_to_null(df)
    if target is None:
        target = next((c for c in df.columns if normal(c) == "late_delivery_risk"), None)
    strata = target if target in df.columns else None
    train, test = holdout_split(df, strata, test_size, seed, key, on_rare_class="unstratified")
    inputs = [c for c in df.columns if c != strata]
    settings = dict(
        skewnessThreshold=skewness_threshold, outlierThreshold=outlier_threshold, cardinalityThreshold=cardinality_threshold
    )
    model = HybridPreprocessor(inputCols=inputs, leakageColumns=leakage, **settings).fit(train.select(*[col(c) for c in inputs]))
    return Prepared(
        target=strata,
        model=model,
        train=model.transform(train),
        test=model.transform(test),
        cleaned=model.transform_cleaned(df),
        class_distribution=class_distribution(train, test, strata) if strata else None,
        raw=df,
    )
