"""Drop lines that many documents share, keeping each in one document.

Two Bloom filters, for hashes seen once and hashes seen twice, are filled by every
task and folded together. Only lines that the second one holds are suspected: they
alone are shuffled, compared as whole strings, counted by document and traced back.
A full filter suspects more lines; it never changes a result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annoframe.llm import shared
from annoframe.llm.words import SPACES

#: Bits of each filter (8 MB), a power of two; bits set by a hash.
FILTER_BITS = 1 << 26
PROBES = 2
#: Keys that hold more than this part of all suspected lines are sent to every task; there are no more than so many.
HOT_KEYS = 1000
HOT_KEY_BYTES = 4096
#: Bytes of a filter that travel in one row.
_CHUNK = 1 << 17


def line_key(line: bytes) -> bytes:
    """The line without white space at both ends, A-Z lower-cased."""
    return line.strip(SPACES).lower()


def is_long(key: bytes, least: int) -> bool:
    return len(key) >= least and (key.isascii() or len(key.decode("utf-8", "replace")) >= least)


def long_keys(text: bytes | None, least: int) -> set[bytes]:
    return {key for key in map(line_key, (text or b"").split(b"\n")) if is_long(key, least)}


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The bits of each hash, one row per probe."""
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return np.stack([((hashes + np.uint64(k) * step) & np.uint64(bits - 1)).astype(np.int64) for k in range(PROBES)])


def _put(bitmap: np.ndarray, places: np.ndarray) -> None:
    places = np.unique(places)
    where, first = np.unique(places >> 3, return_index=True)
    if len(where):
        bitmap[where] |= np.bitwise_or.reduceat(np.left_shift(1, places & 7).astype(np.uint8), first)


def holds(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the filter may hold each hash; never False for one that was put in."""
    places = _places(hashes, len(bitmap) * 8)
    return (bitmap[places >> 3] >> (places & 7).astype(np.uint8) & 1).all(axis=0)


def _chunks(once: np.ndarray, twice: np.ndarray) -> pa.RecordBatch:
    parts, a, b = [], [], []
    for at in range(0, len(once), _CHUNK):
        x, y = once[at : at + _CHUNK], twice[at : at + _CHUNK]
        if x.any():
            parts.append(at // _CHUNK), a.append(zlib.compress(x.tobytes(), 1)), b.append(zlib.compress(y.tobytes(), 1))
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["part", "once", "twice"])


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Seen twice is what either part saw twice, and what both parts saw."""
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for part, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            x, y = (np.frombuffer(zlib.decompress(z), np.uint8) for z in (a, b))
            if part in held:
                once, twice = held[part]
                x, y = once | x, twice | y | (once & x)
            held[part] = x, y
    blobs = [zlib.compress(y.tobytes(), 1) for _, y in held.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(blobs, pa.binary())], names=["part", "twice"])


def twice_seen(docs: DataFrame, id: str = "doc_id", text: str = "text", least: int = 40, bits: int = FILTER_BITS) -> np.ndarray:
    """The filter of hashes of long line keys that stand in two documents or more."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in batches:
            for piece in shared.slices(batch, text):
                found = [xxhash.xxh3_64_intdigest(k) for t in shared.column(piece, text).cast(pa.binary()).to_pylist() for k in long_keys(t, least)]
                hashes, counts = np.unique(np.array(found, np.uint64), return_counts=True)
                again = hashes[(counts > 1) | holds(once, hashes)]
                _put(twice, _places(again, bits))
                _put(once, _places(hashes, bits))
        yield _chunks(once, twice)

    filled = shared.in_batches(docs.select(text), fill, "part int, once binary, twice binary")
    rows = shared.in_batches(filled.repartition("part"), _folded, "part int, twice binary").collect()
    out = np.zeros(bits // 8, np.uint8)
    for row in rows:
        out[row.part * _CHUNK : (row.part + 1) * _CHUNK] = np.frombuffer(zlib.decompress(row.twice), np.uint8)
    return out


def dedup_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", least: int = 40, documents: int = 5, bits: int = FILTER_BITS) -> DataFrame:
    """The documents without the lines that ``documents`` or more of them share.

    A line's key is the line without white space at both ends, A-Z lower-cased. A key of
    ``least`` code points or more, found in ``documents`` different ids or more, stays in
    the largest of these ids and loses all its lines elsewhere. All columns return, the
    text replaced, with ``__n_lines`` (before) and ``__n_dropped``.

    A NULL text is one empty line and stays NULL; an empty text likewise stays empty.
    Rows that repeat an id count as one document and lose the same lines. A NULL id is a
    document of its own that is smaller than all others. An empty table gives none.
    """
    spark = docs.sparkSession
    shared.ship(spark)
    twice = spark.sparkContext.broadcast(twice_seen(docs, id, text, least, bits))

    def suspect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in shared.slices(batch, text):
                rows, keys = [], []
                for row, t in enumerate(shared.column(piece, text).cast(pa.binary()).to_pylist()):
                    for key in long_keys(t, least):
                        rows.append(row), keys.append(key)
                hit = np.flatnonzero(holds(twice.value, np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)))
                ids = shared.column(piece, id).take(pa.array(np.array(rows, np.int64)[hit]))
                yield pa.RecordBatch.from_arrays([ids, pa.array([keys[k] for k in hit], pa.binary())], names=["__id", "__key"])

    plain = docs.select(F.col(id).alias(id), F.col(text).alias(text))
    kind = dict(docs.dtypes)[id]
    suspects = shared.kept(shared.in_batches(plain, suspect, f"__id {kind}, __key binary"), "lines")
    # MAX leaves NULL out: a NULL id keeps a line only if no other document holds it.
    crowded = shared.kept(
        suspects.groupBy("__key", "__id").agg(F.lit(1).alias("__one"))
        .groupBy("__key").agg(F.count(F.lit(1)).alias("__n"), F.max("__id").alias("__keeper"))
        .where(F.col("__n") >= documents),
        "crowded-lines",
    )
    # A key in more than a thousandth of all suspected lines: there are a thousand at most (4 MB),
    # which are sent to every task; the lines of the others meet in tasks by key.
    hot = (F.col("__n") * HOT_KEYS > suspects.count()) & (F.octet_length("__key") <= HOT_KEY_BYTES)
    frequent = F.broadcast(crowded.where(hot))
    found = suspects.join(frequent, "__key").unionByName(
        suspects.join(frequent.select("__key"), "__key", "left_anti").join(crowded.where(~hot), "__key")
    )
    lost = (
        found.where(~F.col("__id").eqNullSafe(F.col("__keeper")))
        .groupBy(F.col("__id").alias("__lost_by")).agg(F.collect_set("__key").alias("__lost"))
    )

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            texts, n_lines, n_dropped = [], [], []
            for t, lost_keys in zip(batch.column(at).cast(pa.binary()).to_pylist(), shared.column(batch, "__lost").to_pylist(), strict=True):
                n_lines.append(1 if t is None else t.count(b"\n") + 1)
                if not lost_keys or t is None:
                    texts.append(t), n_dropped.append(0)
                    continue
                gone = set(lost_keys)
                stay = [line for line in t.split(b"\n") if line_key(line) not in gone]
                texts.append(b"\n".join(stay)), n_dropped.append(n_lines[-1] - len(stay))
            columns = [pa.array(texts, pa.binary()).cast(batch.schema.field(at).type) if k == at else c for k, c in enumerate(batch.columns[:-1])]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=[*batch.schema.names[:-1], "__n_lines", "__n_dropped"])

    joined = docs.join(lost, docs[id].eqNullSafe(lost["__lost_by"]), "left").select(*[docs[c] for c in docs.columns], "__lost")
    schema = ", ".join([*(f"`{name}` {kind}" for name, kind in docs.dtypes), "__n_lines long", "__n_dropped long"])
    return shared.in_batches(joined, drop, schema)
