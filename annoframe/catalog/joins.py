"""Keyed joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annoframe.functions import signal as S
from annoframe.operators import lookup
from annoframe.plans import stages

from .registry import Tables, query


def label_sides(t: Tables) -> dict[str, DataFrame]:
    """Two side attributes made from the labels."""
    return {
        "toxicity": t.labels.select(
            "doc_id",
            F.when(F.col("toxic") == 1, "toxic").otherwise("clean").alias("toxicity"),
            F.col("quality").cast("double").alias("toxicity_value"),
        ),
        "grade": t.labels.select(
            "doc_id",
            F.when(F.col("quality") == 1, "good").otherwise("poor").alias("grade"),
            F.when(F.col("toxic") == 1, 0.95).otherwise(0.96).alias("grade_value"),
        ),
    }


@query(
    """
    WITH s AS (SELECT d.doc_id,
        coalesce(CASE WHEN toxic IS NULL THEN NULL WHEN toxic = 1 THEN 'toxic' ELSE 'clean' END, 'None') AS toxicity_ori,
        coalesce(quality::DOUBLE, 0.0::DOUBLE) AS toxicity_value,
        coalesce(CASE WHEN quality IS NULL THEN NULL WHEN quality = 1 THEN 'good' ELSE 'poor' END, 'None') AS grade_ori,
        coalesce(CASE WHEN toxic IS NULL THEN NULL WHEN toxic = 1 THEN 0.95::DOUBLE ELSE 0.96::DOUBLE END,
                 0.0::DOUBLE) AS grade_value
      FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
    SELECT *, CASE WHEN toxicity_value > 0.95::DOUBLE THEN toxicity_ori ELSE 'None' END AS toxicity,
              CASE WHEN grade_value > 0.95::DOUBLE THEN grade_ori ELSE 'None' END AS grade FROM s
    """
)
def annotate_left_join(t: Tables) -> DataFrame:
    return lookup.annotate(t.documents.select("doc_id"), label_sides(t), "doc_id")


@query(
    """
    SELECT doc_id, CASE WHEN quality::DOUBLE > 0.95::DOUBLE
                        THEN CASE WHEN toxic = 1 THEN 'toxic' ELSE 'clean' END ELSE 'None' END AS toxicity
    FROM labels
    """
)
def threshold_label(t: Tables) -> DataFrame:
    side = label_sides(t)["toxicity"]
    return side.select("doc_id", lookup.confident_label(F.col("toxicity"), F.col("toxicity_value")).alias("toxicity"))


@query(
    """
    SELECT l_orderkey AS order_id, count(*) AS lines, max(l_returnflag) AS flag_ori, max(l_discount) AS flag_value,
           CASE WHEN max(l_discount) > 0.08::DOUBLE THEN max(l_returnflag) ELSE 'None' END AS flag
    FROM lineitem GROUP BY l_orderkey
    """
)
def annotate_strict_join(t: Tables) -> DataFrame:
    lines = t.lineitem.withColumnRenamed("l_orderkey", "order_id")
    orders = lines.groupBy("order_id").agg(F.count(F.lit(1)).alias("lines"))
    flags = lines.groupBy("order_id").agg(F.max("l_returnflag").alias("flag"), F.max("l_discount").alias("flag_value"))
    return lookup.annotate(orders, {"flag": flags}, "order_id", confidence=0.08, strict=True)


@query("SELECT lang, doc_id, n_chars, source, length(text) AS written, doc_id AS metadata_doc_id FROM documents")
def merge_verified(t: Tables) -> DataFrame:
    texts = t.documents.select("lang", "doc_id", "n_chars", F.length("text").cast("long").alias("written"))
    metadata = t.documents.select("lang", "doc_id", "source", "n_chars")
    return lookup.merge_verified(texts, metadata, "doc_id", split="lang", drop="n_chars")


@query(
    """
    WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings),
    m AS (SELECT vec_id, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std FROM e GROUP BY vec_id)
    SELECT vec_id, label, mean, std, round(embedding[1]::DOUBLE, 6) AS first_value, len(embedding)::INTEGER AS samples
    FROM embeddings JOIN m USING (vec_id)
    """
)
def combine_branches(t: Tables) -> DataFrame:
    signal = F.col("embedding")
    levels = t.embeddings.select(
        "vec_id", F.round(S.array_mean(signal), 6).alias("mean"), F.round(S.array_sample_std(signal), 6).alias("std")
    )
    heads = t.embeddings.select(
        "vec_id", F.round(F.get(signal, F.lit(0)).cast("double"), 6).alias("first_value"), F.size(signal).alias("samples")
    )
    return lookup.combine_branches(t.embeddings.select("vec_id", "label"), [levels, heads], "vec_id")


@query(
    """
    WITH tags AS (SELECT user_id, arg_max(event_type, event_id) AS tag FROM events GROUP BY user_id)
    SELECT c_custkey, c_name, coalesce(tag, 'None') AS background
    FROM customer LEFT JOIN tags ON c_custkey = user_id
    """
)
def tag_lookup_last_wins(t: Tables) -> DataFrame:
    tags = t.events.select(F.col("user_id").alias("c_custkey"), F.col("event_type").alias("tag"), "event_id")
    return lookup.add_tag(t.customer.select("c_custkey", "c_name"), tags, "c_custkey", "tag", "event_id")


@query("SELECT doc_id, lang, n_chars FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def resume_anti_join(t: Tables) -> DataFrame:
    return lookup.unfinished(t.documents.select("doc_id", "lang", "n_chars"), t.labels, ["doc_id"])


@query(
    """
    WITH s AS (SELECT d.doc_id, n_chars,
        coalesce(CASE WHEN toxic IS NULL THEN NULL WHEN toxic = 1 THEN 'toxic' ELSE 'clean' END, 'None') AS toxicity_ori,
        coalesce(quality::DOUBLE, 0.0::DOUBLE) AS toxicity_value,
        coalesce(CASE WHEN quality IS NULL THEN NULL WHEN quality = 1 THEN 'good' ELSE 'poor' END, 'None') AS grade_ori,
        coalesce(CASE WHEN toxic IS NULL THEN NULL WHEN toxic = 1 THEN 0.95::DOUBLE ELSE 0.96::DOUBLE END,
                 0.0::DOUBLE) AS grade_value
      FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
    SELECT doc_id AS segment_id, n_chars, toxicity_ori, toxicity_value, grade_ori, grade_value,
              'TmpSpeaker_' || row_number() OVER (ORDER BY doc_id) AS speaker,
              CASE WHEN toxicity_value > 0.95::DOUBLE THEN toxicity_ori ELSE 'None' END AS toxicity,
              CASE WHEN grade_value > 0.95::DOUBLE THEN grade_ori ELSE 'None' END AS grade FROM s
    """
)
def annotate_stage(t: Tables) -> DataFrame:
    measured = t.documents.select(F.col("doc_id").alias("segment_id"), "n_chars")
    sides = {name: side.withColumnRenamed("doc_id", "segment_id") for name, side in label_sides(t).items()}
    return stages.annotate(measured, sides)
