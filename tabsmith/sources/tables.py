"""Reading and checking tables, preview."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.functions.expr import FLOATING, chunks, col, is_numeric
from tabsmith.functions.jobs import checkpointed
from tabsmith.sources.quoted_csv import read_quoted_csv

# Field texts that mean "missing" in a CSV file.
MISSING_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
# Boolean words of a CSV file.
BOOLEAN_WORDS = ["true", "True", "TRUE", "false", "False", "FALSE"]


# Texts of a number column; a trailing type letter is no number.
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^[+-]?(?i:inf|infinity)$"
FILE = "_file"
# Files of another encoding than UTF-8 that all tasks are told of; beyond, rows and files meet by a shuffle.
MANY_FILES = 10_000
# Bytes of any file survive this encoding, so the real one can be judged afterwards.
BYTES = "ISO-8859-1"


def _read_text(spark: SparkSession, path: str | list[str], lines: bool) -> DataFrame:
    """All fields as text, byte by byte, and the file of each row in the column `FILE`."""
    plain = (
        spark.read.option("header", True)
        .option("inferSchema", False)
        .option("encoding", BYTES)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", lines)
        .csv(path)
    )
    if lines:
        # The plain reader only tells the names: it would read every such file in one task.
        return read_quoted_csv(spark, path, plain.columns, BYTES)
    return plain.select(F.col("_metadata.file_path").alias(FILE), *[col(c) for c in plain.columns])


def _has_open_quotes(spark: SparkSession, path: str | list[str]) -> bool:
    """Whether some line holds an odd number of quotes: then fields may hold line breaks."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not spark.read.text(path).filter(quotes % 2 == 1).isEmpty()


def read_csv(spark: SparkSession, path: str | list[str], multi_line: bool | None = None) -> DataFrame:
    """Read CSV files: encoding fallback, missing tokens, inferred column types.

    A file of which every field is valid UTF-8 is UTF-8, any other is ISO-8859-1. Quotes inside quoted
    fields are doubled. Fields may hold line breaks: unless ``multi_line`` says so or not, the
    quotes of the lines tell, and only then records are cut by the parity of quotes, split by split. Types are found in one
    aggregate over the text columns: bigint, double, boolean, else text; whole numbers beyond bigint stay text.
    """
    lines = _has_open_quotes(spark, path) if multi_line is None else multi_line
    text = _read_text(spark, path, lines)
    validate_table(text.drop(FILE))
    text = _decoded(text)
    tokens = [t for t in MISSING_TOKENS if t]
    cleaned = text.select(
        *[F.when(~F.trim(col(c)).isin(tokens) & (col(c) != ""), col(c)).alias(c) for c in text.columns]
    )
    return cleaned.select(
        *[(_typed(c, kind)).alias(c) for c, kind in zip(cleaned.columns, _kinds(cleaned))]
    )


def _decoded(text: DataFrame) -> DataFrame:
    """Fields read byte by byte as the text of their file's encoding."""
    names = [c for c in text.columns if c != FILE]
    valid = reduce(lambda a, b: a & b, [F.coalesce(F.is_valid_utf8(F.encode(col(c), BYTES)), F.lit(True)) for c in names])
    other = checkpointed(text.groupBy(FILE).agg(F.bool_and(valid).alias("valid")).where(~F.col("valid")).select(FILE))
    many = other.count()
    plain = F.lit(False)
    if many:
        files = other.withColumn("_plain", F.lit(True))
        text = text.join(F.broadcast(files) if many <= MANY_FILES else files, FILE, "left")
        plain = F.coalesce("_plain", F.lit(False))
    try:
        shown = [c.encode(BYTES).decode("utf-8") for c in names]
    except UnicodeError:
        shown = names
    return text.select(*[F.when(plain, col(c)).otherwise(F.decode(F.encode(col(c), BYTES), "UTF-8")).alias(n) for c, n in zip(names, shown)])


def _kinds(text: DataFrame) -> list[str]:
    kinds: list[str] = []
    for part in chunks(text.columns, 24):
        aggs = []
        for c in part:
            v = F.trim(col(c))
            has = col(c).isNotNull()
            digits = has & v.rlike(r"^[+-]?\d+$")
            aggs.append(
                F.struct(
                    F.count_if(has).alias("n"),
                    F.count_if(digits).alias("digits"),
                    F.count_if(digits & v.try_cast("bigint").isNotNull()).alias("whole"),
                    F.count_if(has & v.rlike(NUMBER)).alias("number"),
                    F.count_if(has & v.isin(BOOLEAN_WORDS)).alias("truth"),
                )
            )
        row = text.agg(*[a.alias(f"k{i}") for i, a in enumerate(aggs)]).first()
        for k in row:
            if k["n"] == 0:
                kinds.append("double")
            elif k["digits"] == k["n"]:
                kinds.append("bigint" if k["whole"] == k["n"] else "string")
            elif k["number"] == k["n"]:
                kinds.append("double")
            elif k["truth"] == k["n"]:
                kinds.append("boolean")
            else:
                kinds.append("string")
    return kinds


def _typed(name: str, kind: str):
    return col(name) if kind == "string" else F.trim(col(name)).try_cast(kind)


def validate_table(df: DataFrame) -> DataFrame:
    """Raise on a table without columns, rows or any readable header."""
    if not df.columns:
        raise ValueError("The table has no columns.")
    if df.isEmpty():
        raise ValueError("The table has no rows.")
    blank = [c for i, c in enumerate(df.columns) if not c.strip() or c == f"_c{i}" or c.startswith("Unnamed:")]
    if len(blank) == len(df.columns):
        raise ValueError("The table has no readable column headers.")
    return df


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """Any Spark format (parquet, orc, json, ...), or CSV with the rules of read_csv."""
    if fmt == "csv":
        return read_csv(spark, path)
    return validate_table(spark.read.format(fmt).options(**options).load(path))


def use_dataframe(df: DataFrame) -> DataFrame:
    """Take an existing DataFrame as the input table."""
    return validate_table(df)


def preview(df: DataFrame, limit: int = 50) -> DataFrame:
    """First rows with NaN and infinities shown as NULL, timestamps as text."""
    cols = []
    for f in df.schema.fields:
        c = col(f.name)
        if isinstance(f.dataType, FLOATING):
            c = F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            c = c.cast("string")
        cols.append(c.alias(f.name))
    return df.select(*cols).limit(max(limit, 0))


def column_metadata(df: DataFrame) -> DataFrame:
    rows = [
        (i, f.name, "numeric" if is_numeric(f.dataType) else "categorical/text", f.dataType.simpleString())
        for i, f in enumerate(df.schema.fields)
    ]
    return df.sparkSession.createDataFrame(rows, "position int, column_name string, inferred_type string, dtype string")
