"""Exact comparison of pairs of classes, by the whole set of one document of each.

Sets of hashes don't compress, and a pair needs both. So what meets at a pair are the
compressed texts, about a third of the size; the sets are made anew where they meet. Each
class sends its text once for each side on which it stands, and once for each pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annoframe.llm import shared
from annoframe.operators import lookup

#: Pairs whose sets a task holds at once.
TOGETHER = 256
_SLICE = 2 << 20


def _frequent(pairs: DataFrame) -> set[str]:
    """The sides of the pairs on which a class stands in so many that they are dealt to slices."""
    if pairs.count() <= lookup.TARGET_ROWS:  # then no class has more
        return set()
    most = {side: lookup.key_counts(pairs, [side]).agg(F.max("rows")).first()[0] for side in ("__x", "__y")}
    return {side for side, rows in most.items() if rows > lookup.TARGET_ROWS}


def both_ends(pairs: DataFrame, x: DataFrame, y: DataFrame, names: dict[str, str]) -> DataFrame:
    """The pairs with the columns of both classes, ``names`` with ``_x`` and ``_y``; a class of very many pairs is dealt to slices.

    Whether there is such a class is counted first: without one, slices only make the plan
    longer, by four broadcasts that the driver builds. ``pairs`` is a table that was written.
    """
    frequent, joined = _frequent(pairs), pairs
    for own, other, rows in (("__x", "__y", x), ("__y", "__x", y)):
        side = rows.select(F.col("__class").alias(own), *(F.col(a).alias(b + own[2:]) for a, b in names.items()))
        joined = lookup.sliced_join(joined, side, [own], "inner", lookup.key_counts(pairs, [own]), [other]) if own in frequent else joined.join(side, own)
    return joined


def _sides(pairs: DataFrame) -> DataFrame:
    """The classes of the pairs, and on which sides they stand."""
    x, y = (pairs.select(F.col(side).alias("__class"), F.lit(side == "__x").alias("__is_x"), F.lit(side == "__y").alias("__is_y")) for side in ("__x", "__y"))
    return x.union(y).groupBy("__class").agg(F.max("__is_x").alias("__is_x"), F.max("__is_y").alias("__is_y"))


def _texts(docs: DataFrame, id: str, text: str, wanted: DataFrame, few: bool, sets_of: Callable, key_of: Callable, label: str) -> DataFrame:
    """(class, sides, compressed text) of the wanted classes, from a document that has the set of the class."""
    named = wanted.select(F.col("__first").alias("__wanted"), "__class", "__a", "__b", "__is_x", "__is_y")
    rows = docs.select(F.col(id), F.col(text).alias("__text")).join(F.broadcast(named) if few else named, F.col(id) == F.col("__wanted"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, met = pa.Codec("zstd"), set()
        for batch in batches:
            for piece in shared.slices(batch, "__text", _SLICE):
                classes, a, b, texts = (shared.column(piece, c).to_pylist() for c in ("__class", "__a", "__b", "__text"))
                keep = []
                for at, own in enumerate(sets_of(shared.column(piece, "__text"))):
                    if classes[at] not in met and key_of(own) == (a[at], b[at]):  # an id may stand at several texts
                        met.add(classes[at]), keep.append(at)
                raw = [texts[at].encode() for at in keep]
                sides = [shared.column(piece, c).take(pa.array(keep, pa.int64())) for c in ("__class", "__is_x", "__is_y")]
                yield pa.RecordBatch.from_arrays(
                    [*sides, pa.array(list(map(len, raw)), pa.int32()), pa.array([codec.compress(x, asbytes=True) for x in raw], pa.binary())], names=["__class", "__is_x", "__is_y", "__bytes", "__text"]
                )

    schema = "__class long, __is_x boolean, __is_y boolean, __bytes int, __text binary"
    made = shared.kept(shared.in_batches(rows.select("__text", "__class", "__a", "__b", "__is_x", "__is_y"), make, schema), f"texts-{label}")
    # Rows that repeat an id and a text in several tasks: one stands for the class.
    n, classes = made.agg(F.count("__class"), F.countDistinct("__class")).first()
    return made if n == classes else made.dropDuplicates(["__class"])


def linked(pairs: DataFrame, docs: DataFrame, id: str, text: str, classes: DataFrame, sets_of: Callable, key_of: Callable, broadcast_rows: int, label: str) -> DataFrame:
    """The pairs (__x, __y) of classes whose sets have 100 * intersection >= 80 * union.

    ``classes`` has (__class, __first, __a, __b): an id at which the set stands, and the key
    that ``key_of`` gives it. ``sets_of`` makes the sorted distinct hashes of each text. Up to
    ``broadcast_rows`` classes are broadcast to the documents; more meet them by shuffle.
    """
    wanted = shared.kept(classes.select("__class", "__first", "__a", "__b").join(_sides(pairs), "__class"), f"wanted-{label}")
    few = wanted.limit(broadcast_rows + 1).count() <= broadcast_rows
    texts = _texts(docs, id, text, wanted, few, sets_of, key_of, label)
    joined = both_ends(pairs.select("__x", "__y"), texts.where("__is_x"), texts.where("__is_y"), {"__text": "__text_", "__bytes": "__bytes_"})

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                piece = batch.slice(at, TOGETHER)
                numbers: dict[tuple[str, int], int] = {}
                raw, sides = [], []
                for side in ("x", "y"):
                    place = []
                    for number, blob, size in zip(*(shared.column(piece, f"__{c}{side}").to_pylist() for c in ("", "text_", "bytes_")), strict=True):
                        if number not in numbers:  # a class may stand in several pairs
                            numbers[number] = len(raw)
                            raw.append(codec.decompress(blob, size, asbytes=True))
                        place.append(numbers[number])
                    sides.append(place)
                sets = list(sets_of(pa.array(raw, pa.large_binary()).cast(pa.large_string())))
                both = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(*sides, strict=True)], np.int64)
                total = np.array([len(sets[x]) + len(sets[y]) for x, y in zip(*sides, strict=True)], np.int64)
                yield piece.select(["__x", "__y"]).filter(pa.array(100 * both >= 80 * (total - both)))

    return shared.kept(shared.in_batches(joined, compare, "__x long, __y long"), f"links-{label}")
