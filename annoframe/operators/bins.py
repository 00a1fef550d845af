"""Outlier filter, fitted edges, labels and histograms.

Statistics are scalar subqueries: one row, computed once per query and then a
constant inside the compiled stage. No join and no collected column is involved.
Each subquery is bound to one helper column, so it is planned once however many
expressions use it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annoframe.functions import binning as B
from annoframe.functions import vocabulary as V


@dataclass(frozen=True)
class BinSpec:
    """Turn the numbers of ``value`` into the words ``labels`` under the name ``label``."""

    value: str
    label: str
    labels: tuple[str, ...]
    tolerance: float | None = None
    lower_range: float | None = None


DEFAULT_SPECS = (
    BinSpec("speaking_rate_value", "speaking_rate", V.SPEAKING_RATE_LABELS, V.SPEAKING_RATE_TOLERANCE),
    BinSpec("snr", "noise", V.NOISE_LABELS, V.NOISE_TOLERANCE),
    BinSpec("c50", "reverberation", V.REVERBERATION_LABELS, V.REVERBERATION_TOLERANCE),
    BinSpec("utterance_pitch_std", "speech_monotony", V.MONOTONY_LABELS, V.MONOTONY_TOLERANCE),
)


def moments(value: Column) -> Column:
    """Mean and population standard deviation as one struct."""
    return F.struct(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def near_mean(value: Column, stats: Column, tolerance: float | None) -> Column:
    """Strictly within ``tolerance`` population standard deviations; None keeps every value."""
    if tolerance is None:
        return value.isNotNull()
    return F.abs(value - stats["mean"]) < F.lit(float(tolerance)) * stats["std"]


def bound(df: DataFrame, name: str, one_row: DataFrame) -> DataFrame:
    """``df`` with the single row of another table as a struct column ``name``."""
    return df.withColumn(name, one_row.select(F.struct("*")).scalar())


def without_outliers(df: DataFrame, column: str, tolerance: float) -> DataFrame:
    """Rows whose value lies near the column mean; rows without a value go."""
    value = B.finite(F.col(column))
    stats = df.agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    return bound(df, "__stats", stats).where(near_mean(value, F.col("__stats"), tolerance)).drop("__stats")


def edge_row(bounds: DataFrame, wanted: Sequence[tuple[str, int, float | None]]) -> DataFrame:
    """Edge arrays from a one-row table of ranges ``lo0, hi0, lo1, ...``.

    ``wanted`` gives name, number of bins and lower range in the same order. Empty
    ranges (nothing to fit on) give 0..1. The steps are separate projections, which
    keeps every expression small.
    """
    numbers = range(len(wanted))
    other = [name for name in bounds.columns if name not in {f"{end}{i}" for i in numbers for end in ("lo", "hi")}]
    filled, wide = [], []
    for i, (_, _, lower_range) in enumerate(wanted):
        low = F.col(f"lo{i}") if lower_range is None else F.lit(float(lower_range))
        filled.append(F.when(F.col(f"hi{i}").isNull(), 0.0).otherwise(low).alias(f"lo{i}"))
        filled.append(F.coalesce(f"hi{i}", F.lit(1.0)).alias(f"hi{i}"))
        first, last = B.widened(F.col(f"lo{i}"), F.col(f"hi{i}"))
        wide += [first.alias(f"lo{i}"), last.alias(f"hi{i}")]
    edges = [
        B.equal_width_edges(F.col(f"lo{i}"), F.col(f"hi{i}"), count).alias(name)
        for i, (name, count, _) in enumerate(wanted)
    ]
    return bounds.select(*other, *filled).select(*other, *wide).select(*other, *edges)


def fit_bin_edges(df: DataFrame, specs: Sequence[BinSpec]) -> DataFrame:
    """One row with an edge array per label column, named after the label.

    Two passes whatever the number of columns: all means and deviations, then the
    smallest and largest kept value of every column.
    """
    clean = df.select(*[B.finite(F.col(f"`{spec.value}`")).alias(f"v{i}") for i, spec in enumerate(specs)])
    fields = [moments(F.col(f"v{i}")).alias(f"s{i}") for i in range(len(specs))]
    stats = F.col("__stats")
    bounds = []
    for i, spec in enumerate(specs):
        value = F.col(f"v{i}")
        kept = F.when(near_mean(value, stats[f"s{i}"], spec.tolerance), value)
        bounds += [F.min(kept).alias(f"lo{i}"), F.max(kept).alias(f"hi{i}")]
    measured = bound(clean, "__stats", clean.agg(*fields)) if any(spec.tolerance is not None for spec in specs) else clean
    return edge_row(measured.agg(*bounds), [(spec.label, len(spec.labels), spec.lower_range) for spec in specs])


def label_columns(
    df: DataFrame, specs: Sequence[BinSpec], edges: Mapping[str, Sequence[float]] | None = None,
    fit_on: DataFrame | None = None,
) -> DataFrame:
    """Add one label column per spec.

    Specs named in ``edges`` use those edges; the others are fitted together on
    ``fit_on`` (or on ``df``). All labels are added in one projection.
    """
    given = edges or {}
    open_specs = [spec for spec in specs if spec.label not in given]
    table = bound(df, "__edges", fit_bin_edges(df if fit_on is None else fit_on, open_specs)) if open_specs else df
    added = {}
    for spec in specs:
        value = F.col(f"`{spec.value}`")
        source = given[spec.label] if spec.label in given else F.col("__edges")[spec.label]
        added[spec.label] = B.interval_label(value, source, spec.labels)
    return table.withColumns(added).drop("__edges")


def histogram_before_after(df: DataFrame, column: str, tolerance: float, bins: int = 100) -> DataFrame:
    """Equal-width counts of a column, once with and once without its outliers."""
    values = df.select(B.finite(F.col(column)).alias("value")).where(F.col("value").isNotNull())
    stats = values.agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    kept = near_mean(F.col("value"), F.col("__stats"), tolerance)
    member = F.when(kept, F.array(F.lit("before"), F.lit("after"))).otherwise(F.array(F.lit("before")))
    both = bound(values, "__stats", stats).select(F.explode(member).alias("series"), "value")
    return _histogram(both, ("before", "after"), bins)


def histogram_by(df: DataFrame, series: str, column: str, names: Sequence[str], bins: int = 100) -> DataFrame:
    """Equal-width counts of a column for each of the named series, such as speaker pitch per gender."""
    values = df.select(F.col(series).alias("series"), B.finite(F.col(column)).alias("value"))
    return _histogram(values.where(F.col("series").isin(*names) & F.col("value").isNotNull()), names, bins)


def histogram_all(df: DataFrame, specs: Sequence[BinSpec], bins: int = 100) -> DataFrame:
    """Counts of all columns in one call, with and without outliers, and the edges of each column's bins as markers.

    One row per ``label``, ``series`` ("before" or "after" the outlier filter) and slot, with
    ``edges`` fitted on the values of that series; ``lower_range`` holds for both. A column
    without a tolerance is the same before and after.
    """
    clean = df.select(*[B.finite(F.col(f"`{spec.value}`")).alias(f"v{i}") for i, spec in enumerate(specs)])
    measured = bound(clean, "__stats", clean.agg(*[moments(F.col(f"v{i}")).alias(f"s{i}") for i in range(len(specs))]))
    members, wanted = [], []
    for i, spec in enumerate(specs):
        value = F.col(f"v{i}")
        kept = near_mean(value, F.col("__stats")[f"s{i}"], spec.tolerance)
        for series, mine in (("before", value.isNotNull()), ("after", kept)):
            members.append(F.when(mine, F.struct(F.lit(f"{i} {series}").alias("series"), value.alias("value"))))
            wanted.append((f"{i} {series}", len(spec.labels), spec.lower_range))
    values = measured.select(F.explode(F.filter(F.array(*members), lambda m: m.isNotNull())).alias("m")).select("m.series", "m.value")
    counted = _histogram(values, [name for name, _, _ in wanted], bins)
    parts = F.split("series", " ")
    label = F.element_at(F.array(*[F.lit(spec.label) for spec in specs]), parts[0].cast("int") + 1)
    return _marked(counted, values, wanted).select(label.alias("label"), parts[1].alias("series"), "slot", "slot_from", "slot_to", "rows", "edges")


def histogram_by_before_after(
    df: DataFrame, series: str, column: str, names: Sequence[str], tolerance: float, bins: int = 100
) -> DataFrame:
    """Counts of a column for each named series, with and without the outliers of that series, such as pitch per gender."""
    values = df.select(F.col(series).alias("name"), B.finite(F.col(column)).alias("value"))
    values = values.where(F.col("name").isin(*names) & F.col("value").isNotNull())
    stats = values.agg(*[moments(F.when(F.col("name") == name, F.col("value"))).alias(f"s{i}") for i, name in enumerate(names)])
    kept = F.lit(False)
    for i, name in enumerate(names):
        kept = F.when(F.col("name") == name, near_mean(F.col("value"), F.col("__stats")[f"s{i}"], tolerance)).otherwise(kept)
    number = F.array_position(F.array(*[F.lit(name) for name in names]), F.col("name")) - 1
    states = F.when(kept, F.array(F.lit("before"), F.lit("after"))).otherwise(F.array(F.lit("before")))
    both = bound(values, "__stats", stats).select(F.explode(states).alias("state"), number.cast("string").alias("number"), "value")
    both = both.select(F.concat_ws(" ", "number", "state").alias("series"), "value")
    counted = _histogram(both, [f"{i} {state}" for i in range(len(names)) for state in ("before", "after")], bins)
    parts = F.split("series", " ")
    name = F.element_at(F.array(*[F.lit(name) for name in names]), parts[0].cast("int") + 1)
    return counted.select(name.alias("category"), parts[1].alias("series"), "slot", "slot_from", "slot_to", "rows")


def _marked(counted: DataFrame, values: DataFrame, wanted: Sequence[tuple[str, int, float | None]]) -> DataFrame:
    """The counts with the equal-width edges of their series, fitted on its values."""
    bounds = []
    for i, (name, _, _) in enumerate(wanted):
        value = F.when(F.col("series") == name, F.col("value"))
        bounds += [F.min(value).alias(f"lo{i}"), F.max(value).alias(f"hi{i}")]
    marked = bound(counted, "__edges", edge_row(values.agg(*bounds), wanted))
    own = F.lit(None).cast("array<double>")
    for name, _, _ in wanted:
        own = F.when(F.col("series") == name, F.col("__edges")[name]).otherwise(own)
    return marked.withColumn("edges", own).drop("__edges")


def _histogram(values: DataFrame, names: Sequence[str], bins: int) -> DataFrame:
    """Counts per series and slot: ``series, slot, slot_from, slot_to, rows``.

    Each series spans its own range: nothing gives 0..1, a single value is widened
    by a half on each side. Empty slots are listed with a zero. Rows are counted
    map-side, so what is shuffled is one row per series and slot and task.
    """
    bounds = []
    for i, name in enumerate(names):
        value = F.when(F.col("series") == name, F.col("value"))
        bounds += [F.min(value).alias(f"lo{i}"), F.max(value).alias(f"hi{i}")]
    ranges = values.agg(*bounds)
    low, high = F.lit(None).cast("double"), F.lit(None).cast("double")
    for i, name in enumerate(names):
        lo = F.coalesce(F.col(f"__ranges.lo{i}"), F.lit(0.0))
        hi = F.coalesce(F.col(f"__ranges.hi{i}"), F.lit(1.0))
        low = F.when(F.col("series") == name, F.when(lo == hi, lo - 0.5).otherwise(lo)).otherwise(low)
        high = F.when(F.col("series") == name, F.when(lo == hi, hi + 0.5).otherwise(hi)).otherwise(high)

    def ranged(rows: DataFrame) -> DataFrame:
        return bound(rows, "__ranges", ranges).withColumns({"lo": low, "hi": high}).drop("__ranges")

    counts = ranged(values).groupBy(
        "series", B.histogram_slot(F.col("value"), F.col("lo"), F.col("hi"), bins).alias("slot")
    ).agg(F.count(F.lit(1)).alias("rows"))
    slots = values.sparkSession.range(bins).select(
        F.explode(F.array(*[F.lit(name) for name in names])).alias("series"), F.col("id").alias("slot")
    )
    width = (F.col("hi") - F.col("lo")) / F.lit(bins)
    return ranged(slots.join(counts, ["series", "slot"], "left")).select(
        "series",
        "slot",
        (F.col("lo") + F.col("slot") * width).alias("slot_from"),
        F.when(F.col("slot") == bins - 1, F.col("hi")).otherwise(F.col("lo") + (F.col("slot") + 1) * width).alias("slot_to"),
        F.coalesce("rows", F.lit(0)).alias("rows"),
    )
