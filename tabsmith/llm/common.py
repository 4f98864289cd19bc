"""Helpers of the training-data operators: Arrow slices, flat text buffers, shared scratch tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsmith.functions.jobs import checkpoint_folder

#: A word of every operator here: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Text bytes that one step inside a task holds at once; a longer single text is one step of its own.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of a column as text, modulo: the fold of a row. NULL for a NULL id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def slices(batches: Iterable[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in steps of at most `limit` text bytes (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes.astype(np.int64))
        start, before = 0, 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, end - start)
            start, before = end, int(ends[end - 1])


def raw(column: pa.Array) -> pa.LargeBinaryArray:
    """A text column as bytes, NULL as empty."""
    if pa.types.is_null(column.type):
        return pa.array([b""] * len(column), pa.large_binary())
    return pc.fill_null(column.cast(pa.large_binary()), b"")


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column after one another, and where each text starts (one entry more than rows)."""
    column = raw(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    buffer = column.buffers()[2]
    if buffer is None or offsets[0] == offsets[-1]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def sums(values: np.ndarray, starts: np.ndarray, dtype=np.int64) -> np.ndarray:
    """Sum of values[starts[i]:starts[i + 1]] for each i; empty parts give 0."""
    total = np.zeros(len(values) + 1, dtype)
    np.cumsum(values, dtype=dtype, out=total[1:])
    return total[starts[1:]] - total[starts[:-1]]


#: Holds all columns that an operator only passes on, so that no name of theirs meets one of its own.
CARRIED = "carried_columns"


def packed(docs: DataFrame, own: Sequence[str]) -> DataFrame:
    """The columns `own`, and all others in one struct."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in own]
    return docs.select(*own, F.struct(*(rest or [F.lit(True).alias("none")])).alias(CARRIED))


def unpacked(df: DataFrame, columns: Sequence[str], own: Sequence[str]) -> DataFrame:
    """The columns as they were before `packed`."""
    return df.select(*[F.col(c) if c in own else F.col(CARRIED).getField(c).alias(c) for c in columns])


def ship(spark: SparkSession) -> None:
    """Send the library to the executors, once per context: tasks import it, and machines of a cluster may not have it."""
    context = spark.sparkContext
    if getattr(context, "_tabsmith_sent", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="tabsmith-"), "tabsmith.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.join("tabsmith", os.path.relpath(path, top)))
    context.addPyFile(archive)
    context._tabsmith_sent = True


#: What the worker keeps from task to task: one tokenizer or one model's tables.
_RESIDENT: dict = {}


def resident(key, build: Callable):
    """A large thing that a worker needs in every task of a stage, built once; another one takes its place."""
    if key not in _RESIDENT:
        # Before the other one is built: a worker never holds two.
        _RESIDENT.clear()
        _RESIDENT[key] = build()
    return _RESIDENT[key]


def free_resident() -> None:
    """Let go of what an earlier stage left in this worker."""
    _RESIDENT.clear()


def in_batches(df: DataFrame, step: Callable, schema, keeps: bool = False) -> DataFrame:
    """`mapInArrow` of a step that uses this library; a step that keeps nothing `resident` frees what the worker holds."""
    ship(df.sparkSession)

    def freed(batches):
        free_resident()
        return step(batches)

    return df.mapInArrow(step if keeps else freed, schema)


def scratch(spark: SparkSession) -> str:
    """A new folder under the cluster's checkpoint folder; it goes when the driver's JVM ends."""
    folder = f"{checkpoint_folder(spark).rstrip('/')}/tabsmith-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def stored(df: DataFrame) -> DataFrame:
    """The rows as a written table in the shared folder: lineage ends here, and a lost executor loses nothing."""
    folder = scratch(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
