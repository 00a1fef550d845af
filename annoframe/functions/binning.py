"""Equal-width edges, interval labels and histogram slots as plain expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(value: Column) -> Column:
    """``value`` as double, with NaN turned into NULL."""
    number = value.cast("double")
    return F.when(~F.isnan(number), number)


def widened(first: Column, last: Column) -> tuple[Column, Column]:
    """A range of length zero grows by a half on each side; a range that runs backwards is an error."""
    message = F.concat(F.lit("lower range above the largest value "), last.cast("string"))
    low = F.when(first > last, F.raise_error(message)).when(first == last, first - 0.5).otherwise(first)
    return low, F.when(first == last, last + 0.5).otherwise(last)


def equal_width_edges(first: Column, last: Column, bins: int) -> Column:
    """``bins + 1`` edges from ``first`` to ``last``."""
    width = (last - first) / F.lit(bins)
    return F.array(*[first + F.lit(i) * width for i in range(bins)], last)


def interval_label(value: Column, edges: Column | Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the interval ``(edge[i], edge[i+1]]`` that holds ``value``.

    Values outside the edges take the first or last label, NaN the last, NULL
    none. Only inner edges are compared, as one CASE chain, so the expression is
    compiled with the rest of its stage.
    """
    count = len(labels) + 1
    if not isinstance(edges, Column):
        count = len(edges)
        edges = [F.lit(float(edge)) for edge in edges]
    top = min(len(labels), max(count, 1)) - 1
    label = F.when(value.isNull(), F.lit(None).cast("string"))
    for i in range(top):
        label = label.when(value <= edges[i + 1], F.lit(labels[i]))
    return label.otherwise(F.lit(labels[top]))


def histogram_slot(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Index of the equal-width slot of ``value``; slots are half-open and the last one is closed.

    The division only guesses the slot; the neighbouring edges decide, so a value
    equal to an edge lands where the edge says.
    """
    width = (high - low) / F.lit(bins)
    guess = F.least(F.floor((value - low) * F.lit(bins) / (high - low)), F.lit(bins - 1).cast("long"))
    down = value < low + guess * width
    up = (guess < bins - 1) & (value >= low + (guess + 1) * width)
    return F.when(down, guess - 1).when(up, guess + 1).otherwise(guess)
