"""Small Column builders shared by every operator.

They pin down the places where plain Spark and the tabular semantics of this
library differ: NaN counts as missing, skewness is bias-adjusted, division never
raises under ANSI mode, names may hold blanks, dots and brackets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATING = (T.FloatType, T.DoubleType)
NESTED = (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType)


def col(name: str) -> Column:
    """Column reference that is safe for any column name."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric(dtype: T.DataType) -> bool:
    """Byte to Double and Decimal are numeric; boolean is categorical everywhere."""
    return isinstance(dtype, T.NumericType)


def is_nested(dtype: T.DataType) -> bool:
    return isinstance(dtype, NESTED)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def categorical_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if not is_numeric(f.dataType)]


def nan_to_null(df: DataFrame) -> DataFrame:
    """Fold NaN of float and double columns into NULL (one projection, no shuffle)."""
    if not any(isinstance(f.dataType, FLOATING) for f in df.schema.fields):
        return df
    return df.select(
        *[
            F.when(~F.isnan(col(f.name)), col(f.name)).alias(f.name)
            if isinstance(f.dataType, FLOATING)
            else col(f.name)
            for f in df.schema.fields
        ]
    )


def as_double(name: str) -> Column:
    return col(name).cast("double")


def as_text(name: str, dtype: T.DataType) -> Column:
    """Text form of a non-numeric value; nested values become JSON."""
    c = col(name)
    if isinstance(dtype, T.BinaryType):
        return F.base64(c)
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return F.when(c.isNotNull(), F.to_json(c))
    if isinstance(dtype, T.VariantType):
        return F.to_json(c)
    return c.cast("string")


def adjusted_skewness(c: Column) -> Column:
    """Bias-adjusted sample skewness; 0.0 up to two values and for constants."""
    n = F.count(c).cast("double")
    factor = F.try_divide(F.sqrt(n * (n - 1)), n - 2)
    return F.when(n > 2, F.coalesce(F.skewness(c) * factor, F.lit(0.0))).otherwise(F.lit(0.0))


def safe_ratio(num: Column, den: Column) -> Column:
    """0.0 where the denominator is 0 or missing; a missing numerator stays NULL."""
    return F.when(den.isNull() | F.isnan(den) | (den == 0), F.lit(0.0)).otherwise(F.try_divide(num, den))


def finite(c: Column) -> Column:
    """NULL, NaN and both infinities become 0.0 (NaN sorts above infinity)."""
    return F.when(F.abs(c) < F.lit(float("inf")), c).otherwise(F.lit(0.0))


def percent(part: Column, whole: Column) -> Column:
    """part / whole * 100, 0.0 for an empty whole."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")) * 100, F.lit(0.0))


def bin_index(c: Column, low: float, high: float, bins: int) -> Column:
    """0-based equal-width bin of c in [low, high]; the last bin is closed."""
    width = high - low
    raw = F.floor((c - F.lit(low)) * F.lit(float(bins)) / F.lit(width))
    return F.least(raw, F.lit(bins - 1)).cast("int")


def bin_edges(low: float, high: float, bins: int) -> list[float]:
    step = (high - low) / bins
    return [low + step * i for i in range(bins)] + [high]


def chunks(items: list, size: int) -> list[list]:
    return [items[i : i + size] for i in range(0, len(items), size)]
