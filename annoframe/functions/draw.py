"""Repeatable random draws: the same row and seed always give the same pick."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw_number(row_key: Column, seed: str, turn: int, below: int) -> Column:
    """A number in ``[0, below)`` made from the leading 32 bits of an MD5 digest."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), row_key.cast("string"), F.lit(str(turn))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % F.lit(below)


def draw_distinct(row_key: Column, seed: str, picks: int, population: int) -> list[Column]:
    """``picks`` different positions out of ``population``, in the order drawn.

    The n-th draw chooses among the positions still free: its number is moved up
    by one for every earlier pick at or below it. The cost per row is one digest
    per pick, whatever the population.
    """
    if not 0 < picks <= population:
        raise ValueError(f"cannot draw {picks} different positions out of {population}")
    chosen: list[Column] = []
    for turn in range(picks):
        position = draw_number(row_key, seed, turn, population - turn)
        for earlier in (F.sort_array(F.array(*chosen))[i] for i in range(turn)):
            position = position + F.when(position >= earlier, 1).otherwise(0)
        chosen.append(position)
    return chosen
