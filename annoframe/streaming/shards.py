"""Stateless stages on newly arrived shards.

Cleaning, labels with given edges and column work need one row at a time, so
they run unchanged on a stream. Fitting edges needs the whole table and stays a
batch job.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def process_new_shards(
    spark: SparkSession, source: str, schema: StructType, stage: Callable[[DataFrame], DataFrame], target: str,
    checkpoint: str,
) -> StreamingQuery:
    """Run ``stage`` over the shard files of ``source`` not seen yet, append to ``target`` and stop.

    ``checkpoint`` must lie in a folder all executors share; it remembers which
    files are done, so a stopped run neither loses nor repeats a file.
    """
    shards = spark.readStream.schema(schema).parquet(source)
    writer = stage(shards).writeStream.format("parquet").option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(availableNow=True).start(target)
