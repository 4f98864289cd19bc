"""Writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith.functions.expr import is_nested


def export_table(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> None:
    """Write a table (cleaned data, metrics, comparison) in parallel part files.

    CSV cannot hold nested values, so those are written as JSON text. Quotes inside a field are doubled, white space is
    kept, and an empty text is written as "" to tell it from NULL.
    """
    if fmt == "csv":
        flat = df.select(
            *[
                F.to_json(f"`{f.name}`").alias(f.name) if is_nested(f.dataType) else F.col(f"`{f.name}`")
                for f in df.schema.fields
            ]
        )
        options = {"header": True, "escape": '"', "emptyValue": '""', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
        flat.write.mode(mode).options(**options).csv(path)
    else:
        df.write.mode(mode).format(fmt).save(path)


def cleaned_name(source: str) -> str:
    """Name of the cleaned export of a file."""
    base = source.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0]
    return f"cleaned_{base}.csv"


def export_training_result(result, path: str, mode: str = "overwrite") -> None:
    """Metrics, leading importances, confusion counts and class report of one model as JSON."""
    result.metrics.write.mode(mode).json(f"{path}/metrics")
    result.importance.filter("rank <= 15").write.mode(mode).json(f"{path}/importance")
    result.confusion.write.mode(mode).json(f"{path}/confusion")
    result.class_report.write.mode(mode).json(f"{path}/class_report")
