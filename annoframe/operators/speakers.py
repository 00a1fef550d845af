"""Speaker-level statistics, per-category edges and the label of every utterance's speaker."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annoframe.functions import binning as B
from annoframe.functions import vocabulary as V

from .bins import bound, edge_row, moments, near_mean
from .lookup import failing_unless, key_counts, sliced_join, spreading_columns


def speaker_table(
    df: DataFrame, speaker: str, category: str, value: str, order_by: str | None = None
) -> DataFrame:
    """Per speaker: mean value, first known category (first by ``order_by``) and number of rows.

    Rows without a speaker are left out. Both aggregates combine map-side, so a
    speaker with very many utterances costs one partial row per task.
    """
    order = F.col(category if order_by is None else order_by)
    return (
        df.where(F.col(speaker).isNotNull())
        .groupBy(F.col(speaker).alias("speaker"))
        .agg(
            F.avg(B.finite(F.col(value))).alias("mean"),
            F.min_by(F.col(category), F.when(F.col(category).isNotNull(), order)).alias("category"),
            F.count(F.lit(1)).alias("rows"),
        )
    )


def _moments(categories: Sequence[str]) -> list[Column]:
    return [
        moments(F.when(F.col("category") == name, F.col("mean"))).alias(f"s{i}") for i, name in enumerate(categories)
    ]


def _bounds(categories: Sequence[str], tolerance: float | None) -> list[Column]:
    bounds = []
    for i, name in enumerate(categories):
        mean = F.when(F.col("category") == name, F.col("mean"))
        kept = F.when(near_mean(mean, F.col("__stats")[f"s{i}"], tolerance), mean)
        bounds += [F.min(kept).alias(f"lo{i}"), F.max(kept).alias(f"hi{i}")]
    return bounds


def fit_category_edges(
    speakers: DataFrame, bins: int, categories: Sequence[str] = V.GENDERS, tolerance: float | None = V.PITCH_TOLERANCE
) -> DataFrame:
    """One row with an edge array per category, fitted on the speaker means of that category."""
    stats = speakers.agg(*_moments(categories))
    bounds = bound(speakers, "__stats", stats).agg(*_bounds(categories, tolerance))
    return edge_row(bounds, [(name, bins, None) for name in categories])


def category_label(
    mean: Column, category: Column, edges: Mapping[str, Column | Sequence[float]], labels: Sequence[str]
) -> Column:
    """Label of a speaker mean among the edges of the speaker's own category; other categories have none."""
    label = F.lit(None).cast("string")
    for name, own in edges.items():
        label = F.when(category == name, B.interval_label(mean, own, labels)).otherwise(label)
    return label


def label_by_speaker(
    df: DataFrame, speaker: str = "speaker", category: str = "gender_ori", value: str = "utterance_pitch_mean",
    label: str = "pitch", labels: Sequence[str] = V.PITCH_LABELS, categories: Sequence[str] = V.GENDERS,
    tolerance: float | None = V.PITCH_TOLERANCE, edges: Mapping[str, Sequence[float]] | None = None,
    order_by: str | None = None, strict: bool = False, spread: Sequence[str] | None = None,
) -> DataFrame:
    """Every utterance with the label of its speaker's mean.

    Two small aggregations over the speaker table find the moments, then the edges.
    They, the labels and the rows per speaker need the same columns of the speaker
    table, so all share its one shuffle. The utterances then look their speaker up,
    with speakers of very many rows split, and so the rows without a speaker.
    ``strict`` fails on a speaker whose category has no edges; otherwise it has no label.
    """
    table = speaker_table(df, speaker, category, value, order_by).withColumnRenamed("speaker", speaker)
    fitted = () if edges is not None else tuple(categories)
    labelled = table
    known = edges
    if edges is None:
        stats = table.agg(*_moments(fitted))
        bounds = bound(table, "__stats", stats).agg(*_bounds(fitted, tolerance))
        labelled = bound(table, "__fit", edge_row(bounds, [(name, len(labels), None) for name in fitted]))
        known = {name: F.col("__fit")[name] for name in categories}
    labelled = labelled.withColumn(label, category_label(F.col("mean"), F.col("category"), known, labels))
    if strict:
        listed = F.coalesce(F.col("category").isin(*known), F.lit(False))
        message = F.concat(F.lit("no edges for the category of speaker "), F.col(speaker).cast("string"))
        labelled = failing_unless(labelled, listed, message)
    spread = spread or [name for name in df.columns if name in ("segment_id", value)] or spreading_columns(df, [speaker])
    counts = table.select(speaker, "rows").unionByName(key_counts(df.where(F.col(speaker).isNull()), [speaker]))
    return sliced_join(df, labelled.select(speaker, label), [speaker], "left", counts, spread)
