"""Speaker statistics that go on with every new shard.

The aggregates of a speaker are the state of a streaming query, so a shard is read once and
old shards never again. Each batch writes the speakers that it changed under its own
number; a batch that is run again after a crash writes the same rows in the same place. The
newest row of each speaker is the table that a batch query over all shards gives, and edges
are fitted on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from annoframe.functions import binning as B


def _aggregates(category: str, value: str, order_by: str | None) -> list[Column]:
    number = B.finite(F.col(value))
    order = F.col(category if order_by is None else order_by)
    return [
        F.avg(number).alias("mean"),
        F.min_by(F.col(category), F.when(F.col(category).isNotNull(), order)).alias("category"),
        F.count(F.lit(1)).alias("rows"),
        F.count(number).alias("values"), F.sum(number).alias("total"), F.sum(number * number).alias("squares"),
        F.min(number).alias("low"), F.max(number).alias("high"),
    ]


def speaker_moments(df: DataFrame, speaker: str, category: str, value: str, order_by: str | None = None) -> DataFrame:
    """Per speaker: mean, first known category, rows, and count, sum, sum of squares and extremes of the values.

    Works on a table and on a stream. Rows without a speaker are left out.
    """
    named = df.where(F.col(speaker).isNotNull())
    return named.groupBy(F.col(speaker).alias("speaker")).agg(*_aggregates(category, value, order_by))


def update_speakers(
    spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, speaker: str, category: str,
    value: str, order_by: str | None = None, files_per_batch: int | None = None,
) -> StreamingQuery:
    """Take the shard files of ``source`` not seen yet into the statistics at ``target`` and stop.

    ``checkpoint`` must lie in a folder all executors share; it holds the state and
    remembers which files are done.
    """
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    moments = speaker_moments(reader.parquet(source), speaker, category, value, order_by)

    def put(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{target}/batch={batch}")

    writer = moments.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).foreachBatch(put).start()


def current_speakers(spark: SparkSession, target: str) -> DataFrame:
    """The newest row of every speaker."""
    changes = spark.read.parquet(target)
    rest = [name for name in changes.columns if name not in ("speaker", "batch")]
    newest = changes.groupBy("speaker").agg(F.max_by(F.struct(*rest), "batch").alias("newest"))
    return newest.select("speaker", "newest.*")
