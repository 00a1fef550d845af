"""A corpus from raw documents to packed sequences.

Every stage works on all documents that the one before kept, and its decisions take
effect: toxic documents go, shared lines stay in one document, one document of each
group of near copies stays, passages of benchmark items are cut out (and documents that
are mostly such passages go), what is left is packed into sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annoframe.llm import decontam, jaccard, lines, packing, shared, toxicity as toxic

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _as_documents(cleaned: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``; where it counts characters, they are counted anew."""
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        cleaned = cleaned.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return cleaned.select(docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the threshold; the models learn from labelled rows that aren't held out."""
    model = toxic.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), toxic.not_held_out())
    return toxic.score(docs, model).where(F.col("__score") < toxic.THRESHOLD).select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that five or more share; the largest id keeps each."""
    return _as_documents(lines.dedup_lines(docs), docs)


def _row_key(docs: DataFrame) -> Column:
    """Id and digest of the text as one string that sorts by id; rows without an id come last."""
    doc = F.col("doc_id")
    if dict(docs.dtypes)["doc_id"] in ("tinyint", "smallint", "int", "bigint"):
        doc = F.lpad(F.hex(doc.cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")  # in the order of the numbers
    return F.concat(F.coalesce(F.concat(F.lit("0"), doc.cast("string")), F.lit("1")), F.lit(" "), F.md5(F.coalesce("text", F.lit(""))))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: that with the smallest id, of equal ids that whose text has the smallest digest; rows without an id come last.

    Rows are told apart by id and text, so that ids which are missing or stand at several
    texts take part; a row that is repeated as a whole stays once.
    """
    keyed = docs.withColumn("__key", _row_key(docs))
    groups = jaccard.similar_documents(keyed.select("__key", "text"), id="__key")
    keepers = groups.where("__key = component_id").select("__key").distinct()
    return keyed.join(keepers, "__key", "left_semi").dropDuplicates(["__key"]).select(docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the passages of items, but for those that are mostly such passages."""
    return _as_documents(decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")), docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: SQL expresses neither the toxicity models nor the packing.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = shared.kept(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
