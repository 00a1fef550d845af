"""Pack documents into sequences of fixed length, by a grouping genetic algorithm.

Whole pieces fill a sequence each. The rest is dealt to groups of about ``GROUP`` pieces.
Each group is packed by several islands: an island evolves a few packings, and between
rounds its best one moves on to the next island. Offspring take well-filled bins of one
parent whole, then those bins of the other that share no document with them; documents
that lost their bin are put back where they fit best. A group rests once it has as few
bins as any packing can have.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annoframe.llm import shared, tokens

CAPACITY = 2048
GROUP = 4096
ISLANDS = 2
ROUNDS = 2
POPULATION = 4
GENERATIONS = 4
_SLICE = 4 << 20


def best_fit(sizes: list[int], items: list[int], bins: list[list[int]], capacity: int, as_given: bool = False) -> list[list[int]]:
    """Put the items, largest first or as given, each into the fullest bin with room for it, or into a new one."""
    room = sorted((capacity - sum(sizes[i] for i in b), k) for k, b in enumerate(bins))
    for item in items if as_given else sorted(items, key=lambda i: (-sizes[i], i)):
        at = bisect_left(room, (sizes[item], -1))
        if at == len(room):
            bins.append([item])
            insort(room, (capacity - sizes[item], len(bins) - 1))
        else:
            left, k = room.pop(at)
            bins[k].append(item)
            insort(room, (left - sizes[item], k))
    return bins


def least_bins(sizes: np.ndarray, capacity: int) -> int:
    """No packing has fewer bins: large pieces need one each, and what they leave holds only so much."""
    s = np.sort(sizes.astype(np.int64))
    total = np.concatenate([[0], np.cumsum(s)])
    half = int(np.searchsorted(s, capacity // 2, "right"))
    best = -(-int(total[-1]) // capacity)
    for k in np.unique(s[:half]).tolist() + [0]:
        lone = int(np.searchsorted(s, capacity - k, "right"))
        lo = int(np.searchsorted(s, k, "left"))
        large = len(s) - lone
        middle = lone - half
        left = middle * capacity - int(total[lone] - total[half])
        rest = int(total[half] - total[min(lo, half)]) - left
        best = max(best, large + middle + max(0, -(-rest // capacity)))
    return best


def fitness(sizes: list[int], bins: list[list[int]], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then fuller ones against emptier ones."""
    return -len(bins), sum((sum(sizes[i] for i in b) / capacity) ** 2 for b in bins)


def crossed(sizes: list[int], one: list[list[int]], other: list[list[int]], capacity: int, draw: np.random.Generator) -> list[list[int]]:
    """A packing of well-filled bins of one parent, of the other's bins that are untouched by them, and best fit for the rest."""
    fills = np.array([sum(sizes[i] for i in b) for b in one])
    order = np.argsort(-fills, kind="stable")
    taken = order[: max(1, int(len(one) * draw.uniform(0.3, 0.7)))]
    bins = [list(one[k]) for k in taken.tolist()]
    used = set().union(*bins)
    displaced = []
    for b in other:
        fresh = [i for i in b if i not in used]
        if len(fresh) == len(b) and sum(sizes[i] for i in b) > 0.9 * capacity:
            bins.append(list(b))
        else:
            displaced += fresh
    return best_fit(sizes, displaced, bins, capacity)


def mutated(sizes: list[int], bins: list[list[int]], capacity: int, draw: np.random.Generator) -> list[list[int]]:
    """The same with the two emptiest and a few other bins emptied, and their documents put back in random order."""
    fills = np.array([sum(sizes[i] for i in b) for b in bins])
    gone = {*np.argsort(fills, kind="stable")[:2].tolist(), *draw.choice(len(bins), min(len(bins), 4), replace=False).tolist()}
    items = [i for k in sorted(gone) for i in bins[k]]
    draw.shuffle(items)
    return best_fit(sizes, items, [list(b) for k, b in enumerate(bins) if k not in gone], capacity, as_given=True)


def evolve(sizes: list[int], elites: list[list[list[int]]], capacity: int, seed: int) -> list[list[int]]:
    """The best packing of an island after some generations, from the packings that came in."""
    least = least_bins(np.array(sizes), capacity)
    population = [e for e in elites if e] or [best_fit(sizes, list(range(len(sizes))), [], capacity)]
    best = max(population, key=lambda b: fitness(sizes, b, capacity))
    if len(best) <= least:
        return best
    draw = np.random.default_rng(seed)
    while len(population) < POPULATION:  # newcomers: large pieces by best fit, small ones in random order
        order = draw.permutation(len(sizes)).tolist()
        cut = int(draw.integers(0, len(order)))
        population.append(best_fit(sizes, order[cut:], best_fit(sizes, order[:cut], [], capacity), capacity, as_given=True))
    for _ in range(GENERATIONS):
        children = []
        for _ in range(POPULATION):
            a, b = draw.choice(len(population), 2, replace=len(population) < 2).tolist()
            child = crossed(sizes, population[a], population[b], capacity, draw)
            children.append(mutated(sizes, child, capacity, draw))
        population = sorted([*population, *children], key=lambda b: fitness(sizes, b, capacity), reverse=True)[:POPULATION]
        if len(population[0]) <= least:
            break
    return population[0]


def _bins_of(blob: bytes) -> list[list[int]]:
    of = np.frombuffer(blob, "<i4")
    bins: list[list[int]] = [[] for _ in range(int(of.max()) + 1 if len(of) else 0)]
    for item, k in enumerate(of.tolist()):
        bins[k].append(item)
    return bins


def _blob_of(bins: list[list[int]], n: int) -> bytes:
    of = np.empty(n, "<i4")
    for k, b in enumerate(bins):
        of[b] = k
    return of.tobytes()


def _round(capacity: int, turn: int):
    def island(items: pd.DataFrame, elites: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values("__row")
        sizes = items["length"].tolist()
        group, number = int(items["__group"].iloc[0]), int(items["__island"].iloc[0])
        bins = evolve(sizes, [_bins_of(x) for x in elites.sort_values("__from")["__bins"]], capacity, (turn * 1_000_003 + group) * 101 + number)
        return pd.DataFrame({"__group": [group], "__island": [number], "__count": [len(bins)], "__bins": [_blob_of(bins, len(sizes))]})

    return island


def pieces_of(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = 0, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32) of each piece: whole documents, or longer ones cut so that all but the first piece are full."""
    tokenizer = tokenizer or tokens.default_path()
    end = np.array([end_id], "<u4")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokens.encoder(tokenizer)
        for batch in batches:
            for part in shared.slices(batch, text, _SLICE):
                rows, numbers, starts, lengths, sums = [], [], [], [], []
                every, bounds = coder.encode(shared.column(part, text))
                every = every.astype("<u4")
                for row, (a, b) in enumerate(zip(bounds.tolist(), bounds[1:].tolist(), strict=False)):
                    ids = np.concatenate([every[a:b], end])
                    first = len(ids) % capacity or capacity
                    for number, start in enumerate([0, *range(first, len(ids), capacity)]):
                        own = ids[start : start + (capacity if number else first)]
                        rows.append(row), numbers.append(number), starts.append(start), lengths.append(len(own)), sums.append(zlib.crc32(own.tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [shared.column(part, id).take(pa.array(rows, pa.int64())), pa.array(numbers, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())],
                    names=[id, "piece", "start", "length", "ids_crc32"],
                )

    return shared.in_batches(docs.select(id, text), cut, f"`{id}` {dict(docs.dtypes)[id]}, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = 0, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every piece with its ``sequence_id`` and ``offset``; the places of a sequence follow each other from 0.

    A document is its ids and ``end_id``; NULL and empty texts are that id alone. Rows that
    repeat an id are packed each for itself, a NULL id stays NULL. An empty table gives none.
    """
    numbered = pieces_of(docs, tokenizer, capacity, end_id, id, text).withColumn("__row", F.monotonically_increasing_id())
    pieces = shared.kept(numbered, "pieces")
    full = pieces.where(F.col("length") == capacity).select(id, "piece", "start", "length", "ids_crc32", F.col("__row").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    part = pieces.where(F.col("length") < capacity)
    groups = max(1, -(-part.count() // GROUP))
    part = part.withColumn("__group", F.pmod(F.xxhash64("__row"), F.lit(groups)).cast("int"))
    islands = F.explode(F.array(*[F.lit(k) for k in range(ISLANDS)]))
    items = part.select("__group", "__row", "length", islands.alias("__island"))
    spark = docs.sparkSession
    found = spark.createDataFrame([], "__group int, __island int, __count int, __bins binary")
    for turn in range(ROUNDS):
        # An island goes on with its own best packing and that of the island before it.
        stay = found.select("__group", "__island", F.col("__island").alias("__from"), "__bins")
        come = found.select("__group", ((F.col("__island") + 1) % ISLANDS).alias("__island"), F.col("__island").alias("__from"), "__bins")
        elites = stay.unionByName(come)

        pairs = items.groupBy("__group", "__island").cogroup(elites.groupBy("__group", "__island"))
        found = shared.kept(pairs.applyInPandas(_round(capacity, turn), "__group int, __island int, __count int, __bins binary"), "islands")
    best = found.groupBy("__group").agg(F.min_by("__bins", F.struct("__count", "__island")).alias("__bins"))
    base = 1 << 62
    kind = dict(docs.dtypes)[id]
    fields = [id, "piece", "start", "length", "ids_crc32"]

    def place(items: pa.Table, best: pa.Table) -> pa.Table:
        items = items.sort_by("__row")
        of = np.frombuffer(best["__bins"][0].as_py(), "<i4").astype(np.int64)
        length = items["length"].to_numpy()
        order = np.argsort(of, kind="stable")
        ends = np.cumsum(length[order])
        first = np.searchsorted(of[order], of[order])
        offset = np.empty(len(of), np.int64)
        offset[order] = ends - length[order] - np.concatenate([[0], ends])[first]
        sequence = base + int(items["__group"][0].as_py() if len(of) else 0) * (1 << 20) + of
        return items.select(fields).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    placed = part.select("__group", "__row", *fields).groupBy("__group").cogroup(best.groupBy("__group")).applyInArrow(
        place, f"`{id}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
    return full.unionByName(placed)
