"""Scoring of a stream with a saved model.

Scoring keeps no state between rows, so it needs no watermark; a checkpoint folder makes
the sink exactly-once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tabsmith.operators.models import TrainedModel


def read_file_stream(spark: SparkSession, path: str, schema: StructType | str, fmt: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema).format(fmt).load(path)


def score_stream(
    model: TrainedModel, stream: DataFrame, out: str, checkpoint: str, fmt: str = "parquet", available_now: bool = True
) -> StreamingQuery:
    """Write the scored stream to files; ``available_now`` drains the input and stops."""
    writer = (
        model.score(stream).writeStream.format(fmt).outputMode("append")
        .option("path", out).option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()
