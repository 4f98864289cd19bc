"""CSV records whose fields hold line breaks, from files that many tasks read at once.

A line break ends a record where the number of quotes before it is even. Each split of a file is read by its own task: the parity
of its quotes is counted first, the parities of the splits before it tell how it begins, and a second reading cuts it into
records. Only the pieces of records that reach over the edge of a split, two for each split at most, are put together by a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Splits that begin within a field and that all tasks are told of, 8 bytes each; beyond, larger splits are needed.
MOST_SPLITS = 4_000_000
_RECORD, _HEAD, _TAIL = 0, 1, 2


def lines_of(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, block, split, line): the bytes between two line breaks, and the file split they lie in."""
    at = F.col("_metadata")
    lines = spark.read.option("lineSep", "\n").text(path).select(at["file_path"].alias("file"), at["file_block_start"].alias("block"), F.col("value").cast("binary").alias("line"))
    return lines.withColumn("split", F.xxhash64("file", "block"))


def open_splits(lines: DataFrame) -> np.ndarray:
    """Splits that begin within a quoted field, sorted."""
    text = F.decode("line", "ISO-8859-1")
    quotes = F.length(text) - F.length(F.replace(text, F.lit('"'), F.lit("")))
    # One row per split.
    parity = lines.groupBy("file", "block", "split").agg((F.sum(quotes) % 2).alias("odd"))
    before = F.sum("odd").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    found = parity.withColumn("before", F.coalesce(before, F.lit(0))).where("before % 2 = 1").select("split").limit(MOST_SPLITS + 1).toArrow()
    if found.num_rows > MOST_SPLITS:
        raise ValueError(f"more than {MOST_SPLITS} file splits begin within a field; raise spark.sql.files.maxPartitionBytes")
    return np.sort(found.column("split").to_numpy())


def records_of(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, first, record): all records as bytes, without empty ones; `first` marks the first one of each file."""
    lines = lines_of(spark, path)
    begun = spark.sparkContext.broadcast(open_splits(lines))
    names, kinds = ["file", "block", "kind", "first", "record"], [pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()]

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = begun.value
        split = file = block = None
        open_ = head = fresh = False
        pieces: list[bytes] = []
        out: list[tuple] = []

        def put(kind: int) -> None:
            nonlocal fresh
            record = b"\n".join(pieces)
            if kind != _RECORD or record.strip(b"\r"):
                out.append((file, block, kind, fresh, record))
                fresh = False
            pieces.clear()

        for batch in batches:
            quotes = pc.count_substring(batch.column("line"), '"').to_numpy(zero_copy_only=False) % 2
            rows = zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), batch.column("split").to_pylist(), batch.column("line").to_pylist(), quotes.tolist(), strict=True)
            for f, b, s, line, odd in rows:
                if s != split:
                    if pieces:
                        put(_HEAD if head else _TAIL)
                    file, block, split = f, b, s
                    k = int(np.searchsorted(told, s))
                    open_ = head = k < len(told) and told[k] == s
                    fresh = b == 0
                pieces.append(line)
                if odd:
                    open_ = not open_
                if not open_:
                    put(_HEAD if head else _RECORD)
                    head = False
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                out.clear()
        if pieces:
            put(_HEAD if head else _TAIL)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    pieces = lines.mapInArrow(cut, "file string, block long, kind int, first boolean, record binary")
    whole = pieces.where(F.col("kind") == _RECORD).select("file", "first", "record")
    # A tail begins a record; the heads after it, up to the next tail, go on with it.
    edges = pieces.where(F.col("kind") != _RECORD)
    number = F.sum((F.col("kind") == _TAIL).cast("int")).over(Window.partitionBy("file").orderBy("block", "kind").rowsBetween(Window.unboundedPreceding, 0))
    parts = edges.withColumn("number", number).groupBy("file", "number").agg(F.max("first").alias("first"), F.sort_array(F.collect_list(F.struct("block", "kind", "record"))).alias("parts"))
    glued = F.aggregate("parts", F.lit(None).cast("binary"), lambda a, x: F.when(a.isNull(), x["record"]).otherwise(F.concat(a, F.lit(b"\n"), x["record"])))
    return whole.unionByName(parts.select("file", "first", glued.alias("record")))


def read_quoted_csv(spark: SparkSession, path: str | list[str], names: list[str], encoding: str) -> DataFrame:
    """(`_file`, the columns `names` as text) of all records but each file's first, which holds its header."""
    text = F.regexp_replace(F.decode("record", encoding), "\r$", "")
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    options = {"sep": ",", "quote": '"', "escape": '"', "multiLine": "true"}
    parsed = records_of(spark, path).where(~F.col("first")).select(F.col("file").alias("_file"), F.from_csv(text, schema, options).alias("r"))
    return parsed.select("_file", *[F.col("r").getField(f"c{i}").alias(n) for i, n in enumerate(names)])
