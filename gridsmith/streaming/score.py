"""Fitted row-local steps on arriving files.

A fitted recipe or preparation is a projection, so it runs on ``readStream`` input
unchanged. There is no state, watermark or window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def read_files(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema).format(fmt).load(path)


def replay(fitted, stream: DataFrame, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Write the transformed rows as Parquet, exactly once per input file."""
    writer = fitted.transform(stream).writeStream.format("parquet").option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.outputMode("append").start(out)
