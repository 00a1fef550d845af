"""What the text operators share: shared folder, shipped code, slices of batches, sums over all tasks."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a batch are worked on in slices of about so many bytes of text.
SLICE_BYTES = 8 << 20
#: Counters of a distributed vector that travel in one row.
CHUNK = 1 << 14

#: Whether shuffle files are deleted at the end of the query that wrote them.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_OWN: dict[str, str] = {}
_SHIPPED: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a session on one machine that names none (tests) has a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not named and app not in _OWN:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        _OWN[app] = f"file://{tempfile.mkdtemp(prefix='annoframe-')}"
        spark.sparkContext.setCheckpointDir(_OWN[app])
    return (named or _OWN[app]).rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_folder(spark)}/annoframe-{label}-{uuid.uuid4().hex}"


def kept(df: DataFrame, label: str) -> DataFrame:
    """The table, written to the shared folder and read again: a lost executor costs nothing of it.

    What was shuffled for it goes once it is written, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a session: their Python workers import it."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent.parent
    archive = f"{tempfile.mkdtemp(prefix='annoframe-code-')}/annoframe_code.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, str(path.relative_to(root.parent)))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)


def release() -> None:
    """Give memory that a task has freed back to the system: the worker process stays, and others need it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def in_batches(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with the package at hand on the executors."""
    ship(df.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        release()

    return df.mapInArrow(task, schema)


def refuse(df: DataFrame, names: Sequence[str]) -> None:
    """An error where the table has a column that an operator adds."""
    taken = [c for c in df.columns if c.lower() in {name.lower() for name in names}]
    if taken:
        raise ValueError(f"the table already has columns that are added here: {', '.join(taken)}")


def crc_of_id(doc_id: Column) -> Column:
    """crc32 of the id as text; NULL where the id is NULL."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def held_out(doc_id: Column) -> Column:
    """True where crc32(id as text) mod 4 is 2; a row without an id is not held out."""
    return F.coalesce(crc_of_id(doc_id) % 4 == 2, F.lit(False))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and the bounds between them (one more than texts); NULL is empty."""
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    bounds = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    if texts.null_count:
        lengths = np.where(texts.is_valid().to_numpy(zero_copy_only=False), np.diff(bounds), 0)
        texts = texts.fill_null("")
        bounds = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
        assert (np.diff(bounds) == lengths).all()
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(batch: pa.RecordBatch, name: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``most`` bytes of text; a longer text is a run of its own."""
    _, bounds = utf8(column(batch, name))
    at = 0
    while at < batch.num_rows:
        upto = max(at + 1, int(np.searchsorted(bounds, bounds[at] + most, "right")) - 1)
        yield batch.slice(at, upto - at)
        at = upto


def record_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)


def packed_rows(vectors: dict[str, np.ndarray]) -> pa.RecordBatch:
    """Vectors of counters as rows of compressed chunks; chunks of zeros are left out."""
    names, parts, blobs = [], [], []
    for name, vector in vectors.items():
        for part in range(-(-len(vector) // CHUNK)):
            piece = vector[part * CHUNK : (part + 1) * CHUNK]
            if piece.any():
                names.append(name), parts.append(part), blobs.append(zlib.compress(piece.astype("<i8").tobytes(), 1))
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(parts, pa.int32()), pa.array(blobs, pa.binary())], names=["name", "part", "blob"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[tuple[str, int], np.ndarray] = {}
    for batch in batches:
        for name, part, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            piece = np.frombuffer(zlib.decompress(blob), "<i8")
            sums[name, part] = sums[name, part] + piece if (name, part) in sums else piece
    names, parts = [k[0] for k in sums], [k[1] for k in sums]
    blobs = [zlib.compress(v.tobytes(), 1) for v in sums.values()]
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(parts, pa.int32()), pa.array(blobs, pa.binary())], names=["name", "part", "blob"])


def summed(df: DataFrame, count: Callable[[Iterator[pa.RecordBatch]], dict[str, np.ndarray]], widths: dict[str, int]) -> dict[str, np.ndarray]:
    """Vectors of fixed width, counted by every task over its rows and added up by chunk.

    Every task sends each chunk once, chunks are added in tasks of their own, and the
    driver gets the sums alone: the given widths, whatever the number of rows.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield packed_rows(count(batches))

    schema = "name string, part int, blob binary"
    rows = in_batches(in_batches(df, each, schema).repartition("name", "part"), _added, schema).collect()
    out = {name: np.zeros(width, np.int64) for name, width in widths.items()}
    for row in rows:
        piece = np.frombuffer(zlib.decompress(row.blob), "<i8")
        out[row.name][row.part * CHUNK : row.part * CHUNK + len(piece)] = piece
    return out
