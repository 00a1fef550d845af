"""Columns, splits, row numbers, shards and unions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annoframe.operators import columns, ordering
from annoframe.sources import tables

from .registry import Tables, query


@query("SELECT doc_id, source, n_chars, lang FROM documents WHERE lang = 'fr'")
def load_split(t: Tables) -> DataFrame:
    return tables.only_split(t.documents, "fr", "lang").select("doc_id", "source", "n_chars", "lang")


@query("SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders")
def drop_columns(t: Tables) -> DataFrame:
    return columns.drop_columns(t.orders, "o_orderstatus+o_orderdate")


@query(
    """
    SELECT o_orderkey AS segment_id, o_custkey AS speaker, o_orderstatus, o_totalprice AS utterance_pitch_mean,
           o_orderdate, o_orderpriority FROM orders
    """
)
def rename_columns(t: Tables) -> DataFrame:
    return columns.rename_columns(
        t.orders, {"o_orderkey": "segment_id", "o_custkey": "speaker", "o_totalprice": "utterance_pitch_mean"}
    )


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100")
def head_n(t: Tables) -> DataFrame:
    return columns.first_rows(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), 100, ["o_orderkey"])


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def filter_by_label(t: Tables) -> DataFrame:
    return columns.ids_with_label(t.orders, "o_orderpriority", ("1-URGENT", "2-HIGH"), "o_orderkey")


DAY = 86400


@query(
    f"""
    SELECT l_orderkey, l_linenumber, l_partkey,
      ({DAY} * date_diff('day', DATE '1970-01-01', o_orderdate::DATE))::BIGINT AS begin_time,
      ({DAY} * date_diff('day', DATE '1970-01-01', l_shipdate::DATE))::BIGINT AS end_time
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    WHERE date_diff('day', o_orderdate::DATE, l_shipdate::DATE) >= 30
    """
)
def min_duration(t: Tables) -> DataFrame:
    epoch = F.to_date(F.lit("1970-01-01"))
    orders = t.orders.select(
        F.col("o_orderkey").alias("l_orderkey"),
        (F.datediff(F.to_date("o_orderdate"), epoch).cast("long") * DAY).alias("begin_time"),
    )
    lines = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        (F.datediff(F.to_date("l_shipdate"), epoch).cast("long") * DAY).alias("end_time"),
    )
    return columns.at_least_seconds(lines.join(orders, "l_orderkey"), seconds=30 * DAY)


@query("SELECT doc_id, lang, 'TmpSpeaker_' || row_number() OVER (ORDER BY doc_id) AS speaker FROM documents")
def sequential_ids(t: Tables) -> DataFrame:
    return ordering.sequential_ids(t.documents.select("doc_id", "lang"), ["doc_id"])


@query(
    """
    WITH n AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS idx,
                      count(*) OVER (PARTITION BY lang) AS n FROM documents)
    SELECT doc_id, lang,
           (CASE WHEN n // 5 = 0 THEN 4 ELSE least(idx // greatest(n // 5, 1), 4) END)::INTEGER AS shard FROM n
    """
)
def contiguous_shards(t: Tables) -> DataFrame:
    return ordering.contiguous_shards(t.documents.select("doc_id", "lang"), ["doc_id"], 5, "lang")


@query(
    """
    SELECT c_custkey AS id, c_name AS name, c_nationkey AS nationkey, c_acctbal AS acctbal, c_mktsegment AS segment
    FROM customer
    UNION ALL SELECT s_suppkey, s_name, s_nationkey, s_acctbal, NULL FROM supplier
    """
)
def union_shards(t: Tables) -> DataFrame:
    customers = t.customer.select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nationkey"),
        F.col("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("segment"),
    )
    suppliers = t.supplier.select(
        F.col("s_acctbal").alias("acctbal"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"),
        F.col("s_nationkey").alias("nationkey"),
    )
    return ordering.union_shards([customers, suppliers])
