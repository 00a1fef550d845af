"""Connected components of a graph of any size, by large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annoframe.llm import shared


def components(nodes: DataFrame, edges: DataFrame, a: str, b: str) -> DataFrame:
    """(__node, __component) of every node of ``__node``: the smallest node that edges reach.

    Each round hangs every node's larger neighbours, then its smaller ones, on the smallest
    of its neighbourhood, until nothing moves. Minima combine before the shuffle and no
    neighbourhood is gathered. Rounds are cut by tables in the shared folder.
    """
    now = shared.kept(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("__v"), F.least(a, b).alias("__u")).distinct(), "edges")
    mark = None
    while True:
        both = now.union(now.select(F.col("__u").alias("__v"), F.col("__v").alias("__u")))
        low = both.groupBy("__v").agg(F.min("__u").alias("__low")).select("__v", F.least("__v", "__low").alias("__low"))
        # Larger neighbours hang on the smallest.
        large = both.join(low, "__v").where("__u > __v").select(F.col("__u").alias("__v"), F.col("__low").alias("__u")).distinct()
        down = large.groupBy("__v").agg(F.min("__u").alias("__low"))
        # Smaller neighbours, and the node itself, do so too.
        hung = large.join(down, "__v")
        small = hung.select(F.col("__u").alias("__v"), F.col("__low").alias("__u")).union(hung.select("__v", F.col("__low").alias("__u")))
        now = shared.kept(small.where("__v <> __u").distinct(), "edges")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("__v", "__u").cast("decimal(38,0)"))).first()
        if mark == state:
            break
        mark = state
    low = now.groupBy(F.col("__v").alias("__node")).agg(F.min("__u").alias("__component"))
    return shared.kept(nodes.join(low, "__node", "left").select("__node", F.coalesce("__component", "__node").alias("__component")), "components")
