"""Statistics over shards as they arrive."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annoframe.operators import speakers
from annoframe.streaming import speakers as streamed

from .bins import FITTED_CATEGORIES, utterances
from .registry import SQL, Tables, query


def _folder(df: DataFrame) -> str:
    """A new folder that all executors share; a session on one machine may have its own."""
    spark = df.sparkSession
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith(("local[", "local*")):
        raise ValueError("spark.checkpoint.dir names no folder that all executors share")
    return f"{(named or 'file://' + tempfile.mkdtemp(prefix='annoframe-')).rstrip('/')}/annoframe-stream-{uuid.uuid4().hex}"


def _streamed(t: Tables) -> DataFrame:
    """The orders in three shards, taken in one after another."""
    given = utterances(t)
    folder = _folder(given)
    given.repartition(3, "o_orderkey").write.parquet(f"{folder}/shards")
    names = ("o_custkey", "category", "o_totalprice", "o_orderkey")
    streamed.update_speakers(given.sparkSession, f"{folder}/shards", given.schema, f"{folder}/speakers", f"{folder}/state", *names, files_per_batch=1).awaitTermination()
    return streamed.current_speakers(given.sparkSession, f"{folder}/speakers")


@query(
    """
    SELECT o_custkey AS speaker, round(avg(o_totalprice), 6) AS mean, count(*) AS rows, round(min(o_totalprice), 4) AS low, round(max(o_totalprice), 4) AS high,
      round(sum(o_totalprice), 2) AS total, arg_min(o_orderpriority, o_orderkey) FILTER (WHERE o_orderstatus <> 'P' AND o_orderpriority IS NOT NULL) AS category
    FROM orders WHERE o_custkey IS NOT NULL GROUP BY o_custkey
    """
)
def incremental_speakers(t: Tables) -> DataFrame:
    return _streamed(t).select(
        "speaker", F.round("mean", 6).alias("mean"), "rows", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"), F.round("total", 2).alias("total"), "category"
    )


@query(SQL["category_edges"])
def incremental_category_edges(t: Tables) -> DataFrame:
    edges = speakers.fit_category_edges(_streamed(t), 7, FITTED_CATEGORIES)
    named = F.create_map(*[part for name in FITTED_CATEGORIES for part in (F.lit(name), F.col(name))])
    rows = edges.select(F.explode(named).alias("category", "edges")).select("category", F.posexplode("edges").alias("edge_no", "edge"))
    return rows.select("category", F.col("edge_no").cast("long").alias("edge_no"), F.round("edge", 4).alias("edge"))
