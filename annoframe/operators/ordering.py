"""Row numbers, shards and unions without a single-partition sort."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annoframe.functions import vocabulary as V

from .lookup import failing_unless, lookup_join

ROWS_PER_RANGE = 500_000
FANOUT = 1024
SAMPLES_PER_RANGE = 16

# Cuts up to this number are copied to every executor; there is at most one for ROWS_PER_RANGE rows.
BROADCAST_CUTS = 1_000_000


def _picked(keys: Column, parts: Column) -> Column:
    """Every so manieth of the sorted keys, so that they fall into ``parts`` ranges."""
    step = F.greatest(F.size(keys) / parts, F.lit(1.0))
    cuts = F.transform(F.sequence(F.lit(1), parts - 1), lambda i: F.get(keys, F.floor(i * step).cast("int")))
    return F.filter(cuts, lambda cut: cut.isNotNull())


def _in_sample(key: Column, rows: Column, parts: Column, salt: int) -> Column:
    """Whether a hash picks the key: about ``SAMPLES_PER_RANGE`` of them for each range."""
    one_in = F.greatest(F.floor(rows / (parts * SAMPLES_PER_RANGE)), F.lit(1))
    return F.pmod(F.xxhash64(key, F.lit(salt)), one_in) == 0


def _parts(rows: Column) -> Column:
    return F.least(F.ceil(rows / ROWS_PER_RANGE), F.lit(FANOUT)).cast("int")


def range_cuts(df: DataFrame, key: Column, rows: int) -> Column:
    """Sorted keys that part all keys into ranges of similar size, as a constant array of fewer than ``FANOUT``.

    Computed when the plan is built, like the bounds of a range partitioning. Cuts only
    place rows; every row is numbered, whatever the cuts are.
    """
    keys = df.select(key.alias("key"))
    kind = f"array<{keys.schema['key'].dataType.simpleString()}>"
    known = F.lit(rows)
    picked = keys.where(_in_sample(F.col("key"), known, _parts(known), 0)).agg(F.sort_array(F.collect_set("key")).alias("keys"))
    text = picked.select(F.to_json(_picked(F.col("keys"), _parts(known)))).first()[0]
    return F.from_json(F.lit(text), kind)


def range_of(key: Column, cuts: Column) -> Column:
    """Number of cuts at or below ``key``, found by halving steps: one comparison per power of two; without cuts 0."""
    steps = F.array(*[F.lit(2**power) for power in range(FANOUT.bit_length() - 1, -1, -1)])
    return F.aggregate(
        steps, F.lit(0), lambda low, step: F.when(F.get(cuts, low + step - 1) <= key, low + step).otherwise(low)
    )


def _met(left: DataFrame, right: DataFrame, path: Sequence[str], rows: int) -> DataFrame:
    """Rows with what is known of their range; there is at most one range for each ``ROWS_PER_RANGE`` rows."""
    if rows <= BROADCAST_CUTS * ROWS_PER_RANGE:
        return left.join(F.broadcast(right), list(path), "left")
    return lookup_join(left, right, path, "left")


def in_ranges(df: DataFrame, key: Column, rows: int) -> tuple[DataFrame, list[str]]:
    """Place every row in a tree of key ranges; returns the rows and the names of the columns that lead to a leaf.

    The root has up to ``FANOUT`` ranges. As long as that is too few for the rows, each range
    of more than ``ROWS_PER_RANGE`` rows gets cuts of its own, from a sample of its own.
    Cuts below the root are a table; rows meet those of their range, and no row moves.
    """
    placed, path = df.withColumn("__range0", range_of(key, range_cuts(df, key, rows))), ["__range0"]
    while rows > ROWS_PER_RANGE * FANOUT ** len(path):
        keys = placed.select(*path, key.alias("__key"))
        sizes = keys.groupBy(*path).agg(F.count(F.lit(1)).alias("__rows")).where(F.col("__rows") > ROWS_PER_RANGE)
        sample = _met(keys, sizes, path, rows).where(_in_sample(F.col("__key"), F.col("__rows"), _parts(F.col("__rows")), len(path)))
        sorted_keys = sample.groupBy(*path).agg(F.sort_array(F.collect_set("__key")).alias("__keys"), _parts(F.first("__rows")).alias("__parts"))
        cuts = sorted_keys.select(*path, _picked(F.col("__keys"), F.col("__parts")).alias("__cuts"))
        here = f"__range{len(path)}"
        placed = _met(placed, cuts, path, rows).withColumn(here, range_of(key, F.col("__cuts"))).drop("__cuts")
        path.append(here)
    return placed, path


def rows_below(placed: DataFrame, split: Sequence[str], path: Sequence[str]) -> DataFrame:
    """Per leaf (and split): ``__below``, the rows of all lower leaves.

    Sums go up the tree: a range adds those of its lower sisters, then its parent does, so no
    window holds more than ``FANOUT`` rows.
    """
    sizes = placed.groupBy(*split, *path).agg(F.count(F.lit(1)).alias("__rows"))
    leaves = sizes.withColumn("__below", F.lit(0).cast("long")).drop("__rows")
    for depth in range(len(path), 0, -1):
        node, parent = [*split, *path[:depth]], [*split, *path[: depth - 1]]
        lower = Window.partitionBy(*parent).orderBy(path[depth - 1])
        sisters = sizes.groupBy(*node).agg(F.sum("__rows").alias("__rows"))
        added = sisters.withColumn("__added", F.sum("__rows").over(lower) - F.col("__rows")).drop("__rows")
        leaves = leaves.join(added, node).withColumn("__below", F.col("__below") + F.col("__added")).drop("__added")
    return leaves


def row_index(
    df: DataFrame, order_by: Sequence[str], output: str = "row_index", within: str | None = None,
    total: str | None = None,
) -> DataFrame:
    """Zero-based row number by ``order_by``, optionally counted anew ``within`` each split.

    Rows are parted into key ranges, numbered inside their range and moved up by the rows
    of all lower ranges, a table with one row per range. The rows are numbered and meet it
    in one and the same shuffle. ``order_by`` must identify a row (within its split); a
    repeated key is an error, so no range can be much larger than the others. ``total`` also
    adds the number of rows of the split. Ranges derive from column values alone: a rerun
    gives the same numbers, and nothing has to be cached. Rows of one range need no tree.
    """
    key = F.col(order_by[0]) if len(order_by) == 1 else F.struct(*order_by)
    rows = df.count()
    # The name of a split as text, NULL included.
    split = [] if within is None else ["__split"]
    named = df if within is None else df.withColumn("__split", F.to_json(F.struct(F.col(within).alias("split"))))
    few = rows <= ROWS_PER_RANGE
    placed, path = (named.withColumn("__range0", F.lit(0)), ["__range0"]) if few else in_ranges(named, key, rows)
    own = Window.partitionBy(*split, *path)
    ordered = own.orderBy(*order_by)
    repeated = F.lag(F.struct(*order_by)).over(ordered) == F.struct(*order_by)
    numbered = placed.withColumns({"__position": F.row_number().over(ordered).cast("long"), "__repeated": repeated})
    if few and total is not None:
        numbered = numbered.withColumn(total, F.count(F.lit(1)).over(own))
    message = F.concat(F.lit(f"{', '.join(order_by)} does not identify a row: "), F.to_json(F.struct(*order_by)))
    unique = failing_unless(numbered, ~F.coalesce(F.col("__repeated"), F.lit(False)), message)
    if few:
        unique = unique.withColumn("__below", F.lit(0).cast("long"))
    else:
        leaves = rows_below(placed, split, path)
        if total is not None and not split:
            leaves = leaves.withColumn(total, F.lit(rows).cast("long"))
        elif total is not None:
            leaves = leaves.join(placed.groupBy(*split).agg(F.count(F.lit(1)).alias(total)), split)
        unique = unique.join(leaves, [*split, *path])
    return unique.withColumn(output, F.col("__below") + F.col("__position") - 1).drop("__split", *path, "__position", "__repeated", "__below")


def sequential_ids(
    df: DataFrame, order_by: Sequence[str], output: str = "speaker", pattern: str = "TmpSpeaker_%d"
) -> DataFrame:
    """A running name per row, starting at one."""
    numbered = row_index(df, order_by, "__index")
    return numbered.withColumn(output, F.format_string(pattern, F.col("__index") + 1)).drop("__index")


def contiguous_shards(
    df: DataFrame, order_by: Sequence[str], shards: int = V.SHARDS, split: str | None = None, output: str = "shard"
) -> DataFrame:
    """Number of the contiguous shard of every row; the last shard takes the remainder.

    With fewer rows than shards all rows are in the last shard.
    """
    numbered = row_index(df, order_by, "__index", split, total="__count")
    size = F.floor(F.col("__count") / shards)
    shard = F.when(size == 0, shards - 1).otherwise(
        F.least(F.floor(F.col("__index") / F.greatest(size, F.lit(1))), F.lit(shards - 1).cast("long"))
    )
    return numbered.withColumn(output, shard.cast("int")).drop("__index", "__count")


def union_shards(shards: Sequence[DataFrame]) -> DataFrame:
    """All rows of all shards, columns matched by name; a column some shards lack is NULL there."""
    return reduce(lambda all_rows, shard: all_rows.unionByName(shard, allowMissingColumns=True), shards)
