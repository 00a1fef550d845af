"""Joins on a key: side labels, tags, verified merges, unfinished rows.

Spark broadcasts a side whose size it has checked against its threshold, before
the query or after the shuffle; beyond that the joins below are shuffles on the
key. ``lookup_join`` also splits keys with very many rows. Only
``small_or_lookup_join`` asks for a broadcast, of a side it has measured.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annoframe.functions import vocabulary as V

# Rows of one key that a task joins; a key with more rows is dealt to several slices.
TARGET_ROWS = 1_000_000

# A dictionary up to this measured size is copied to every executor.
BROADCAST_BYTES = 64 * 1024 * 1024
ROW_BYTES = 64


def key_counts(df: DataFrame, on: Sequence[str]) -> DataFrame:
    """Exact ``rows`` per key, rows without a key included; counts combine before the shuffle."""
    return df.groupBy(*on).agg(F.count(F.lit(1)).alias("rows"))


def sliced_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str, counts: DataFrame, spread: Sequence[str]
) -> DataFrame:
    """Join with the rows of a frequent key dealt to slices on the left and repeated per slice on the right.

    ``counts`` holds the left rows per key. A key gets a slice for each ``TARGET_ROWS``
    rows, so a slice stays of one size however large the table and however many keys
    are frequent; rows without a key, which match nothing, are dealt out alike. There is
    at most one such key per ``TARGET_ROWS`` rows, and Spark decides by size how to send
    their list. Each left row meets each right row of its key exactly once. Rows are
    dealt by the content of ``spread``, not by row number, so a task that is run again
    gives the same slices.
    """
    if how not in ("left", "inner"):
        raise ValueError("only left and inner lookups keep one slice per left row")
    on = list(on)
    if not set(spread) - set(on):
        raise ValueError("a key cannot be spread by itself")
    frequent = counts.where(F.col("rows") > TARGET_ROWS).select(
        *[F.col(name).alias(f"__{name}") for name in on], F.ceil(F.col("rows") / TARGET_ROWS).cast("int").alias("__slices")
    )
    deal = F.coalesce(F.col("__slices"), F.lit(1))

    def with_slices(table: DataFrame) -> DataFrame:
        same = reduce(Column.__and__, [table[name].eqNullSafe(frequent[f"__{name}"]) for name in on])
        return table.join(frequent, same, "left")

    hidden = [f"__{name}" for name in on] + ["__slices"]
    dealt = with_slices(left).withColumn("__slice", F.pmod(F.xxhash64(*[F.col(name) for name in spread]), deal).cast("int")).drop(*hidden)
    repeated = with_slices(right).withColumn("__slice", F.explode(F.sequence(F.lit(0), deal - 1))).drop(*hidden)
    return dealt.join(repeated, [*on, "__slice"], how).drop("__slice")


def spreading_columns(df: DataFrame, on: Sequence[str]) -> list[str]:
    """Columns by whose content the rows of a key can be dealt out."""
    plain = ("map", "array", "struct", "binary", "variant")
    return [name for name, kind in df.dtypes if name not in on and not kind.startswith(plain)]


def lookup_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", spread: Sequence[str] | None = None
) -> DataFrame:
    """Join every left row to the right rows of its key, with frequent left keys split over many tasks.

    A table of keys alone has nothing to be dealt by; it takes part in a plain join.
    """
    spread = spread or spreading_columns(left, on)
    if not spread:
        return left.join(right, list(on), how)
    return sliced_join(left, right, on, how, key_counts(left, on), spread)


def measured_bytes(table: DataFrame) -> int:
    """Size of a table of strings: all characters in bytes plus ``ROW_BYTES`` per row."""
    texts = [F.coalesce(F.octet_length(F.col(name)), F.lit(0)) for name in table.columns]
    size = reduce(Column.__add__, texts, F.lit(ROW_BYTES))
    return table.agg(F.coalesce(F.sum(size.cast("long")), F.lit(0))).first()[0]


def small_or_lookup_join(left: DataFrame, right: DataFrame, on: Sequence[str], spread: Sequence[str]) -> DataFrame:
    """Left join to a dictionary: broadcast if it measures at most ``BROADCAST_BYTES``, else by ``lookup_join``."""
    if measured_bytes(right) <= BROADCAST_BYTES:
        return left.join(F.broadcast(right), list(on), "left")
    return lookup_join(left, right, on, "left", spread)


def failing_unless(df: DataFrame, condition: Column, message: Column) -> DataFrame:
    """``df``, with an error at run time for any row that breaks ``condition``."""
    return df.where(F.when(condition, F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))


def stack_sides(sides: Mapping[str, DataFrame], on: str) -> DataFrame:
    """All attribute tables as one row per id: ``{attr}_ori``, ``{attr}_value`` and a row count per attribute."""
    stacked = reduce(
        DataFrame.unionByName,
        [
            side.select(
                F.col(on),
                F.lit(name).alias("attribute"),
                F.col(name).cast("string").alias("label"),
                F.col(f"{name}_value").cast("double").alias("score"),
            )
            for name, side in sides.items()
        ],
    )
    columns = []
    for name in sides:
        mine = F.col("attribute") == name
        columns += [
            F.max(F.when(mine, F.col("label"))).alias(f"{name}_ori"),
            F.max(F.when(mine, F.col("score"))).alias(f"{name}_value"),
            F.count(F.when(mine, True)).alias(f"__{name}_rows"),
        ]
    wide = stacked.groupBy(on).agg(*columns)
    single = reduce(lambda ok, name: ok & (F.col(f"__{name}_rows") <= 1), sides, F.lit(True))
    return failing_unless(wide, single, F.concat(F.lit("more than one side row for id "), F.col(on).cast("string")))


def confident_label(label: Column, score: Column, confidence: float = V.CONFIDENCE) -> Column:
    """The label where its score is above ``confidence``, else "None"."""
    return F.when(score > confidence, label).otherwise(F.lit(V.MISSING_LABEL))


def annotate(
    df: DataFrame, sides: Mapping[str, DataFrame], on: str = "segment_id", confidence: float = V.CONFIDENCE,
    strict: bool = False,
) -> DataFrame:
    """Add ``{attr}_ori``, ``{attr}_value`` and the thresholded ``{attr}`` for every attribute.

    The sides are aggregated to one row per id first, so the wide table takes part
    in a single join however many attributes there are. An id without a side row
    reads "None" and 0; with ``strict`` every side must cover exactly the ids of
    ``df``, each once, or the query fails. One aggregation checks all sides. A side
    with two rows for an id is an error, and so is a NULL id under ``strict``.
    """
    wide = stack_sides(sides, on)
    if strict:
        df = covered(df, sides, on)
    joined = df.drop(*[f"{name}{end}" for name in sides for end in ("", "_ori", "_value")]).join(
        wide.drop(*[f"__{name}_rows" for name in sides]), on, "left"
    )
    filled = {}
    for name in sides:
        score = F.col(f"{name}_value")
        filled[f"{name}_ori"] = F.coalesce(F.col(f"{name}_ori"), F.lit(V.MISSING_LABEL))
        filled[f"{name}_value"] = F.when(score.isNull() | F.isnan(score), V.MISSING_VALUE).otherwise(score)
    joined = joined.withColumns(filled)
    return joined.withColumns(
        {name: confident_label(F.col(f"{name}_ori"), F.col(f"{name}_value"), confidence) for name in sides}
    )


def key_digest(on: Sequence[str], weight: Column | None = None) -> list[Column]:
    """Sums that tell multisets of keys apart, in any order: the rows, and both halves of two hashes of the key.

    Each row counts ``weight`` times; with 1 for one table and -1 for another all sums are 0 if
    both hold the same keys equally often. Sums combine before anything is shuffled. Halves are
    signed numbers of 32 bits, so their sums stay far from the end of a long. NULLs are not
    hashed: count them beside.
    """
    weight = (F.lit(1) if weight is None else weight).cast("long")
    keys = [F.col(name) for name in on]
    parts = []
    for value in (F.xxhash64(*keys), F.xxhash64(F.lit("second"), *keys)):
        parts += [F.shiftright(value, 32), F.shiftright(F.shiftleft(value, 32), 32)]
    sums = [F.sum(weight), *[F.sum(weight * part) for part in parts]]
    return [F.coalesce(total, F.lit(0)).alias(f"__digest{number}") for number, total in enumerate(sums)]


def where_digests_differ(both: DataFrame, on: Sequence[str], weights: Sequence[Column]) -> DataFrame:
    """All rows if a digest under one of the ``weights`` is not 0 or a key is NULL, else none.

    The digests are one pass over the keys without a shuffle of them; what compares key by
    key after this has rows only where something is wrong.
    """
    fields, odd = [], F.col("__nulls") > 0
    for number, weight in enumerate(weights):
        named = [column.alias(f"__digest{number}_{part}") for part, column in enumerate(key_digest(on, weight))]
        fields += named
        odd = reduce(Column.__or__, [F.col(f"__digest{number}_{part}") != 0 for part in range(len(named))], odd)
    missing = reduce(Column.__or__, [F.col(name).isNull() for name in on])
    return both.where(both.agg(F.count(F.when(missing, True)).alias("__nulls"), *fields).select(odd).scalar())


def covered(df: DataFrame, sides: Mapping[str, DataFrame], on: str) -> DataFrame:
    """``df``, failing unless every side has exactly its ids and none of them is NULL.

    That no id stands twice follows from sides with one row an id, which ``stack_sides`` checks.
    """
    tables = [df, *sides.values()]
    both = reduce(DataFrame.unionAll, [table.select(on, F.lit(number).alias("__table")) for number, table in enumerate(tables)])
    mine, numbers = F.col("__table") == 0, range(1, len(tables))
    weights = [F.when(mine, 1).when(F.col("__table") == number, -1).otherwise(0) for number in numbers]
    rows = [F.count(F.when(F.col("__table") == number, True)).alias(f"__rows{number}") for number in (0, *numbers)]
    counted = where_digests_differ(both, [on], weights).groupBy(on).agg(*rows)
    bad = reduce(Column.__or__, [F.col(f"__rows{number}") != 1 for number in (0, *numbers)], F.col(on).isNull())
    wrong = counted.where(bad).agg(F.count(F.lit(1))).scalar()
    return without_wrong(df, wrong, f"attributes {', '.join(sides)}")


def ids_that_differ(left: DataFrame, right: DataFrame, on: Sequence[str]) -> Column:
    """A scalar: 0 if both tables hold the same keys, equally often and none of them NULL.

    Digests of the keys answer that without a shuffle; only where they differ are the keys
    themselves compared and the wrong ones counted. Keys that both tables repeat alike are
    not found here.
    """
    both = left.select(*on, F.lit(1).alias("l"), F.lit(0).alias("r")).unionAll(
        right.select(*on, F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    differing = where_digests_differ(both, on, [F.col("l") - F.col("r")])
    counted = differing.groupBy(*on).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    missing = reduce(Column.__or__, [F.col(name).isNull() for name in on])
    return counted.where((F.col("l") != 1) | (F.col("r") != 1) | missing).agg(F.count(F.lit(1))).scalar()


def without_repeats(df: DataFrame, on: Sequence[str], what: str) -> DataFrame:
    """``df``, failing where a key stands twice; a join on the same keys needs no further shuffle."""
    rows = df.withColumn("__rows", F.count(F.lit(1)).over(Window.partitionBy(*on)))
    key = F.concat_ws(" ", *[F.coalesce(F.col(name).cast("string"), F.lit("NULL")) for name in on])
    return failing_unless(rows, F.col("__rows") == 1, F.concat(F.lit(f"{what}: more than one row for id "), key)).drop("__rows")


def without_wrong(df: DataFrame, wrong: Column, what: str) -> DataFrame:
    """``df``, failing unless the scalar ``wrong`` is 0; it is bound to one column and so computed once."""
    message = F.concat(F.lit(f"{what}: ids that do not match: "), F.col("__wrong").cast("string"))
    return failing_unless(df.withColumn("__wrong", wrong), F.col("__wrong") == 0, message).drop("__wrong")


def merge_verified(
    left: DataFrame, right: DataFrame, on: str = "id", split: str | None = None, drop: Sequence[str] | str = (),
) -> DataFrame:
    """Put two tables with the same ids side by side; the right id stays as ``metadata_{id}``.

    Any id missing on either side, any duplicate, any missing split and any NULL is an error.
    Digests compare the ids of both sides; that none is repeated is seen on the right rows,
    which the join has by key anyway.
    """
    names = drop.split("+") if isinstance(drop, str) else list(drop)
    right = right.drop(*names)
    keys = [on] if split is None else [split, on]
    shared = sorted((set(left.columns) & set(right.columns)) - set(keys))
    if shared:
        raise ValueError(f"both tables have the columns {shared}; drop them on one side")
    wrong = ids_that_differ(left, right, keys)
    checked, single = without_wrong(left, wrong, "merge"), without_repeats(without_wrong(right, wrong, "merge"), keys, "merge")
    return checked.join(single.withColumn(f"metadata_{on}", F.col(on)), keys, "inner")


def last_tags(tags: DataFrame, on: str, tag: str, position: str) -> DataFrame:
    """One row per id: the tag of its last line."""
    return tags.groupBy(on).agg(F.max_by(tag, position).alias(tag))


def add_tag(
    df: DataFrame, tags: DataFrame, on: str = "segment_id", tag: str = "tag", position: str = "position",
    output: str = "background",
) -> DataFrame:
    """Look every row's tag up by id; no tag reads "None". The tags are one row per id, so this is a plain join."""
    lookup = last_tags(tags, on, tag, position).withColumnRenamed(tag, "__tag")
    joined = df.join(lookup, on, "left")
    return joined.withColumn(output, F.coalesce(F.col("__tag"), F.lit(V.MISSING_LABEL))).drop("__tag")


def combine_branches(base: DataFrame, branches: Sequence[DataFrame], on: str = "segment_id") -> DataFrame:
    """Side by side results of independent measurements of the same rows.

    Every branch must have exactly one row for each row of the base table: a base row
    without a branch row, a key that a branch repeats, and a NULL key are errors. The rows
    of all branches are one aggregation by key, which counts them too, and meet the base
    table in one join.
    """
    if not branches:
        return base
    names = [[name for name in branch.columns if name != on] for branch in branches]
    every = [name for own in names for name in own]
    if len(set(every)) < len(every):
        raise ValueError(f"branches share the columns {sorted({name for name in every if every.count(name) > 1})}")
    stacked = reduce(
        lambda left, right: left.unionByName(right, allowMissingColumns=True),
        [branch.withColumn("__branch", F.lit(number)) for number, branch in enumerate(branches, 1)],
    )
    id_text = F.coalesce(F.col(on).cast("string"), F.lit("NULL"))
    counts = {number: f"__rows{number}" for number in range(1, len(branches) + 1)}
    wide = stacked.groupBy(on).agg(
        *[F.first(f"`{name}`", ignorenulls=True).alias(name) for name in every],
        *[F.count(F.when(F.col("__branch") == number, True)).alias(name) for number, name in counts.items()],
    )
    for number, name in counts.items():
        wide = failing_unless(wide, F.col(name) <= 1, F.concat(F.lit(f"branch {number}: more than one row for id "), id_text))
    joined = base.join(wide, on, "left")
    for number, name in counts.items():
        found = F.coalesce(F.col(name), F.lit(0)) == 1
        joined = failing_unless(joined, found, F.concat(F.lit(f"branch {number}: no row for id "), id_text))
    return joined.drop(*counts.values())


def unfinished(df: DataFrame, done: DataFrame, on: Sequence[str] = ("segment_id",)) -> DataFrame:
    """Rows whose key has no finished result yet."""
    return df.join(done.select(*on), list(on), "left_anti")
