"""Join documents whose sets of word shingles have a Jaccard similarity of 0.8 or more.

Shingles are ordered from rare to frequent, by a sketch of counts over the whole corpus.
Two sets that overlap in t shingles share l shingles of their first (size - t + l), for
every l. Each document picks its own l: where its rare end is full of frequent shingles,
a longer prefix costs a few rows and spares many verifications, as a pair then has to
share l of them. A pair must share as many as the smaller of both asks for.

Pairs are not listed within groups. First every posting is held against one head of its
list, the document whose rare end is the most frequent. Then lists are searched for pairs
of documents that are not yet connected. So a group of thousands of near copies costs
its size, and no link between groups is lost. A pair counts a shared shingle only where
its places in both prefixes leave room for the overlap that both sizes ask for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annoframe.llm import shared
from annoframe.llm.components import components
from annoframe.llm.confirm import both_ends, linked
from annoframe.llm.words import NOT_SPACE, runs, whole, words_of

WIDTH = 5
#: Counters of the sketch (32 MB on the driver, 16 MB in a task).
SKETCH_BITS = 22
SKETCH = 1 << SKETCH_BITS
#: The longest multiple of prefix tokens a document may ask for.
MOST_SHARED = 8
#: What a verification costs, in postings of a list walked.
VERIFICATION = 0.5
#: Parts of the hash space by which sets are counted; the smaller counts of two sets bound their overlap.
PARTS = 64
#: Postings of a list that are held against one head; longer lists are dealt to several.
LIST_ROWS = 4096
#: Up to so many classes are broadcast to the scan that fetches texts, or to the postings with their components; beyond, they are joined.
BROADCAST_IDS = 1_000_000
#: Up to so many classes are broadcast with their keys to the prefixes (some 100 bytes each); beyond, they are joined.
BROADCAST_NAMES = 100_000


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; NULL and texts without words have none."""
    _, _, hashes, firsts = words_of(*shared.utf8(texts), NOT_SPACE, lower=True)
    every = runs(hashes, WIDTH)
    for lo, hi in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
        if hi - lo >= WIDTH:
            yield np.unique(every[lo : hi - WIDTH + 1])
        else:
            yield whole(hashes[lo:hi]) if hi > lo else np.zeros(0, np.uint64)


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def sketch_of(docs: DataFrame, text: str = "text") -> np.ndarray:
    """In how many documents the shingles of each bucket stand."""

    def count(batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray]:
        total = np.zeros(SKETCH, np.int64)
        for batch in batches:
            for piece in shared.slices(batch, text, 2 << 20):
                sets = list(shingle_sets(shared.column(piece, text)))
                total += np.bincount(_bucket(np.concatenate(sets)), minlength=SKETCH)
        return {"documents": total}

    return shared.summed(docs.select(text), count, {"documents": SKETCH})["documents"]


def signature(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that equal sets have in common."""
    if not len(shingles):
        return 0, 0
    a = np.bitwise_xor.reduce(shingles * np.uint64(0x9E3779B97F4A7C15) ^ (shingles >> np.uint64(29)))
    b = np.add.reduce((shingles ^ (shingles >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93))
    return int(a.astype(np.int64)), int((b ^ np.uint64(len(shingles))).astype(np.int64))


def needed_overlap(size: int) -> int:
    """The least shingles that a set of this size shares with a set linked to it: 80 % of its size, rounded up."""
    return -(-4 * size // 5)


def prefix(shingles: np.ndarray, counts: np.ndarray, noise: float) -> tuple[np.ndarray, int, int]:
    """A document's prefix, how many of its shingles a linked document shares at least, and the postings it meets.

    With l shared, the expected work is a row for each shingle of the prefix, a step for
    each posting it meets there, and a verification for each l-th posting met. Postings
    met: the sketch's counts above what chance collisions put there.
    """
    own = counts[_bucket(shingles)].astype(np.float64)
    order = np.lexsort((shingles, own))
    need = needed_overlap(len(shingles))
    base = len(shingles) - need
    most = min(MOST_SHARED, need)
    met = np.cumsum(np.maximum(own[order[: base + most]] - noise, 0))[base:]
    shared = np.arange(1, most + 1)
    best = int(np.argmin(shared + met * (1 + VERIFICATION / shared))) + 1
    return shingles[order[: base + best]], best, int(met[best - 1])


def _signed(docs: DataFrame, id: str, text: str, counts, noise: float) -> DataFrame:
    """id, set size, signature, counts by part, prefix, multiple and postings met of each row."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in shared.slices(batch, text, 2 << 20):
                sizes, a, b, least, met, prefixes, parts = [], [], [], [], [], [], []
                for shingles in shingle_sets(shared.column(piece, text)):
                    x, y = signature(shingles)
                    tokens, multiple, postings = prefix(shingles, counts.value, noise) if len(shingles) else (shingles, 0, 0)
                    sizes.append(len(shingles)), a.append(x), b.append(y), least.append(multiple), met.append(postings)
                    prefixes.append(tokens.astype(np.int64))
                    parts.append(np.bincount((shingles & np.uint64(PARTS - 1)).astype(np.int64), minlength=PARTS).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [shared.column(piece, id), *(pa.array(x, pa.int64()) for x in (sizes, a, b)), pa.array(least, pa.int32()), pa.array(met, pa.int64()), _lists(prefixes, np.int64), _lists(parts, np.int32)],
                    names=["__id", "__size", "__a", "__b", "__least", "__met", "__prefix", "__parts"],
                )

    kind = dict(docs.dtypes)[id]
    return shared.in_batches(docs.select(id, text), sign, f"__id {kind}, __size long, __a long, __b long, __least int, __met long, __prefix array<long>, __parts array<int>")


def _lists(values: list[np.ndarray], kind) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values) if values else np.zeros(0, kind)))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("__x").alias("__class")).union(pairs.select(F.col("__y").alias("__class"))).distinct()


def _likely(pairs: DataFrame, classes: DataFrame, label: str) -> DataFrame:
    """The pairs (__x, __y, ...) that the bound of their parts allows: one row of each class is read, and no shingle."""
    pairs = shared.kept(pairs, f"candidates-{label}")
    members = shared.kept(classes.select("__class", "__size", "__parts").join(_ends(pairs), "__class", "left_semi"), f"members-{label}")
    most = F.aggregate(F.zip_with("__parts_x", "__parts_y", lambda a, b: F.least(a, b)), F.lit(0).cast("long"), lambda total, n: total + n)
    likely = both_ends(pairs, members, members, {"__size": "__size_", "__parts": "__parts_"}).where(9 * most >= 4 * (F.col("__size_x") + F.col("__size_y")))
    return shared.kept(likely.select(pairs.columns), f"likely-{label}")


def _linked(pairs: DataFrame, docs: DataFrame, id: str, text: str, classes: DataFrame, label: str) -> DataFrame:
    """The pairs (__x, __y) whose sets are similar enough, by exact comparison."""
    return linked(pairs, docs, id, text, classes, shingle_sets, signature, BROADCAST_IDS, label)


def _may_link(x: str, y: str, least=None):
    """Whether a shingle that two prefixes share, at its places there, can count for a pair of these sizes.

    Linked sets overlap in t = 4/9 of both sizes, rounded up; they share l shingles among the
    first (size - t + l) of each. ``least`` is l; by default what both documents ask for.
    """
    size_x, size_y = F.col(f"{x}.size"), F.col(f"{y}.size")
    least = F.least(F.col(f"{x}.least"), F.col(f"{y}.least")) if least is None else F.lit(least)
    overlap = F.ceil(4 * (size_x + size_y) / 9)
    return (
        (5 * F.least(size_x, size_y) >= 4 * F.greatest(size_x, size_y))
        & (F.col(f"{x}.at") <= size_x - overlap + least) & (F.col(f"{y}.at") <= size_y - overlap + least)
    )


def _pairs(rows: DataFrame) -> DataFrame:
    """(__x, __y) of the rows (x, y), one for each shingle shared, that share as many as both ask for."""
    least = F.least("x.least", "y.least").alias("__least")
    return (
        rows.select(F.least("x.class", "y.class").alias("__x"), F.greatest("x.class", "y.class").alias("__y"), least)
        .groupBy("__x", "__y").agg(F.count(F.lit(1)).alias("__shared"), F.min("__least").alias("__least"))
        .where("__shared >= __least").select("__x", "__y")
    )


def _sharing(rows: DataFrame, signed: DataFrame, classes: DataFrame) -> DataFrame:
    """(__x, __y) of the rows (x, y), one for each pair found, that the bound of parts allows and whose prefixes share as many shingles as both ask for."""
    least = F.least("x.least", "y.least").alias("__least")
    found = rows.select(F.least("x.class", "y.class").alias("__x"), F.greatest("x.class", "y.class").alias("__y"), least).distinct()
    pairs = _likely(found, classes, "across")
    # One row for each class of these pairs: its whole prefix.
    named = classes.join(_ends(pairs), "__class", "left_semi").select("__a", "__b", F.col("__first").alias("__id"), "__class")
    few = named.limit(BROADCAST_NAMES + 1).count() <= BROADCAST_NAMES
    prefixes = signed.select("__a", "__b", "__id", "__prefix").join(F.broadcast(named) if few else named, ["__a", "__b", "__id"]).select("__class", "__prefix").dropDuplicates(["__class"])
    prefixes = shared.kept(prefixes, "prefixes")
    joined = both_ends(pairs, prefixes, prefixes, {"__prefix": "__prefix_"})
    return shared.kept(joined.where(F.size(F.array_intersect("__prefix_x", "__prefix_y")) >= F.col("__least")).select("__x", "__y"), "pairs-across")


def similar_classes(docs: DataFrame, id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(id, size, class) of every row with an id, and (class, component, smallest id) of every class."""
    spark = docs.sparkSession
    shared.ship(spark)
    sketch = sketch_of(docs, text)
    noise = float(sketch.mean() + 4 * np.sqrt(sketch.mean()) + 1)
    frequent = [(int(k), -(-int(sketch[k]) // LIST_ROWS)) for k in np.flatnonzero(sketch > LIST_ROWS + noise)]
    np.minimum(sketch, 0xFFFFFFFF, out=sketch)
    sketch = sketch.astype(np.uint32)
    counts = spark.sparkContext.broadcast(sketch)
    del sketch
    signed = shared.kept(_signed(docs.where(F.col(id).isNotNull()), id, text, counts, noise), "signed")
    counts.destroy()  # what it gave is written
    del counts
    own = ["__a", "__b", "__size", "__least", "__met", "__parts"]  # equal for equal sets
    classes = shared.kept(
        signed.where("__size > 0").groupBy("__a", "__b").agg(F.min("__id").alias("__first"), *(F.first(c).alias(c) for c in own[2:]))
        .withColumn("__class", F.monotonically_increasing_id()),
        "classes",
    )
    # One document of each class sends its prefix. Very frequent shingles are dealt to several lists.
    reps = signed.where("__size > 0").select("__a", "__b", "__id", "__prefix").join(
        classes.select("__a", "__b", F.col("__first").alias("__id"), "__class", "__size", "__least", "__met"), ["__a", "__b", "__id"]
    )
    postings = reps.select("__class", "__size", "__least", "__met", F.posexplode("__prefix").alias("__at", "__token"))
    lists = spark.createDataFrame(frequent, "__bucket int, __lists int")
    bucket = F.shiftrightunsigned("__token", 64 - SKETCH_BITS).cast("int")
    postings = (
        postings.withColumn("__bucket", bucket).join(F.broadcast(lists), "__bucket", "left").drop("__bucket")
        .withColumn("__lists", F.coalesce("__lists", F.lit(1))).withColumn("__deal", F.pmod("__class", "__lists").cast("int"))
    )
    posting = F.struct(*(F.col(f"__{c}").alias(c) for c in ("met", "class", "size", "least")), (F.col("__at") + 1).alias("at"))
    whole_list = Window.partitionBy("__token", "__deal")
    # Rows of one class may repeat (documents that repeat an id and a text); each counts once.
    listed = shared.kept(
        postings.select("__token", "__deal", "__lists", posting.alias("y")).select(
            "*", F.max("y").over(whole_list).alias("x"), F.min("y.class").over(whole_list).alias("__lo"), F.max("y.class").over(whole_list).alias("__hi")
        ).where("__lo < __hi OR __lists > 1").select("__token", "__deal", "__lists", "x", "y").distinct(),
        "postings",
    )

    # Every posting against the head of its list; heads of the lists of one shingle against the first of them.
    heads = listed.where("__lists > 1").groupBy("__token", "__deal").agg(F.max("x").alias("y"))
    tops = heads.groupBy("__token").agg(F.max("y").alias("x"))
    near = listed.select("x", "y").unionByName(heads.join(tops, "__token").select("x", "y"))
    pairs = _likely(_pairs(near.where((F.col("x.class") != F.col("y.class")) & _may_link("x", "y"))), classes, "near")
    links = _linked(pairs, docs, id, text, classes, "near")
    found = components(classes.select(F.col("__class").alias("__node")), links, "__x", "__y")

    # Lists that still hold several components: each document that isn't of the largest one there
    # against all documents of other components. The first shingle that a linked pair shares finds it.
    # A class that no link has moved is its own component, so only the others are looked up.
    moved = found.where("__node <> __component").select(F.col("__node").alias("__of"), F.col("__component").alias("__color"))
    few = moved.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    slim = listed.select("__token", F.struct(*(F.col(f"y.{c}").alias(c) for c in ("class", "size", "least", "at"))).alias("y"))
    colored = slim.join(F.broadcast(moved) if few else moved, F.col("y.class") == F.col("__of"), "left").select("__token", "y", F.coalesce("__color", "y.class").alias("__color"))
    several = colored.groupBy("__token").agg(F.min("__color").alias("__lo"), F.max("__color").alias("__hi")).where("__lo < __hi").select("__token")
    colored = shared.kept(colored.join(several, "__token"), "colored")
    tops = (
        colored.groupBy("__token", "__color").agg(F.count(F.lit(1)).alias("__n"))
        .groupBy("__token").agg(F.max(F.struct("__n", "__color")).alias("__top")).select("__token", F.col("__top.__color").alias("__main"))
    )
    asking = colored.join(tops, "__token").where("__color <> __main").select("__token", F.col("y").alias("x"), F.col("__color").alias("__color_x"), "__main")
    across = asking.join(
        colored, (asking["__token"] == colored["__token"]) & (F.col("__color_x") != F.col("__color"))
        & ((F.col("__color") == F.col("__main")) | (F.col("x.class") < F.col("y.class"))) & _may_link("x", "y", 1),
    ).select("x", "y")
    more = _linked(_sharing(across, signed, classes), docs, id, text, classes, "across")
    wider = components(found.select(F.col("__component").alias("__node")).distinct(), _between(more, found), "__x", "__y")
    found = found.select(F.col("__node").alias("__class"), F.col("__component").alias("__node")).join(wider, "__node").select("__class", "__component")
    rows = signed.select("__id", "__size", "__a", "__b").join(classes.select("__a", "__b", "__class"), ["__a", "__b"], "left").select("__id", "__size", "__class")
    smallest = found.join(classes.select("__class", "__first"), "__class").groupBy("__component").agg(F.min("__first").alias("__smallest"))
    return rows, found.join(smallest, "__component").select("__class", "__component", "__smallest")


def _between(links: DataFrame, found: DataFrame) -> DataFrame:
    """Links between classes as links between their components."""
    one = found.select(F.col("__node").alias("__x"), F.col("__component").alias("__cx"))
    other = found.select(F.col("__node").alias("__y"), F.col("__component").alias("__cy"))
    return links.join(one, "__x").join(other, "__y").select(F.col("__cx").alias("__x"), F.col("__cy").alias("__y")).distinct()


def similar_documents(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, ``n_shingles`` and ``component_id`` of every row.

    Words are runs of other than white space, A-Z lower-cased; the set of a text are its
    distinct runs of five words, or its one shorter sequence. Texts with equal sets are
    one class; classes link when 100 * intersection >= 80 * union. ``component_id`` is
    the smallest id that links reach.

    A text without words, or NULL, has no shingles and is linked with nothing. A row
    without an id belongs to no component (NULL). Rows that repeat an id each have the
    component of their own text. An empty table gives none.
    """
    rows, found = similar_classes(docs, id, text)
    named = rows.join(found.select("__class", "__smallest"), "__class", "left").select(
        F.col("__id").alias(id), F.col("__size").alias("n_shingles"), F.coalesce("__smallest", "__id").alias("component_id")
    )
    blank = docs.where(F.col(id).isNull()).select(id, text)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in shared.slices(batch, text, 2 << 20):
                yield pa.RecordBatch.from_arrays([pa.array([len(s) for s in shingle_sets(shared.column(piece, text))], pa.int64())], names=["n_shingles"])

    kind = dict(docs.dtypes)[id]
    unnamed = shared.in_batches(blank.select(text), count, "n_shingles long").select(F.lit(None).cast(kind).alias(id), "n_shingles", F.lit(None).cast(kind).alias("component_id"))
    return named.unionByName(unnamed)
