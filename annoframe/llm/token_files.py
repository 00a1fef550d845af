"""Write token ids to wavelet files and read them back.

Documents are ranged by id, sorted within each range and encoded there; every range
writes files of about ``SHARD_TOKENS`` ids each. A file is written under another name and
moved, and a task that runs again writes the same files.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annoframe.llm import shared, tokens, wavelet

#: Ids of a file (a document is never split), and bytes of text of a range.
SHARD_TOKENS = 4 << 20
RANGE_BYTES = 16 << 20
_SLICE = 4 << 20


def _put(folder: str, name: str, raw: bytes) -> None:
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    part = f"{path}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        out.write(raw)
    store.move(part, f"{path}/{name}")


def write_files(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 2, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write all documents in ascending order of id; returns (__range, __shard, __documents, __tokens) of every file.

    Each document ends with ``end_id``; NULL and empty texts are that id alone. NULL ids
    come first; rows of one id are ordered by text. An empty table writes no file.
    """
    spark = docs.sparkSession
    tokenizer = tokenizer or tokens.default_path()
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    ranges = max(1, -(-int(size) // RANGE_BYTES))
    ordered = docs.select(F.col(id).cast("long").alias("__id"), F.col(text).alias("__text")).repartitionByRange(ranges, "__id", F.xxhash64("__text")).sortWithinPartitions("__id", "__text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, shard = TaskContext.get().partitionId(), 0
        names: list[int | None] = []
        held: list[np.ndarray] = []
        written: list[tuple[int, int, int, int]] = []
        coder = tokens.encoder(tokenizer)
        end = np.array([end_id], coder.kind)
        bits = int(coder.kind.itemsize) * 8

        def flush() -> None:
            nonlocal shard, names, held
            if names:
                _put(folder, f"{here:06d}-{shard:06d}.wvlt", wavelet.build(np.concatenate(held), np.cumsum([len(x) for x in held]), names, bits))
                written.append((here, shard, len(names), sum(len(x) for x in held)))
                shard, names, held = shard + 1, [], []

        total = 0
        for batch in batches:
            for piece in shared.slices(batch, "__text", _SLICE):
                ids, bounds = coder.encode(piece.column(1))
                for name, a, b in zip(piece.column(0).to_pylist(), bounds.tolist(), bounds[1:].tolist(), strict=False):
                    names.append(name)
                    held.append(np.concatenate([ids[a:b], end]))
                    total += len(held[-1])
                    if total >= SHARD_TOKENS:
                        flush()
                        total = 0
        flush()
        a, b, c, d = (list(x) for x in zip(*written, strict=True)) if written else ([], [], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(c, pa.int64()), pa.array(d, pa.int64())], names=["__range", "__shard", "__documents", "__tokens"])

    return shared.kept(shared.in_batches(ordered, write, "__range int, __shard int, __documents long, __tokens long"), "manifest")


def read_files(spark: SparkSession, folder: str, manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Every document of the files: __id, __start (ids of all documents before it), __n_tokens, __crc32, and its ids if asked for."""
    shared.ship(spark)
    extra = ", __ids array<int>" if with_ids else ""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, raw in zip(shared.column(batch, "path"), shared.column(batch, "content"), strict=True):
                here, shard = (int(x) for x in path.as_py().rsplit("/", 1)[1].split(".")[0].split("-"))
                matrix = wavelet.WaveletMatrix(raw.as_buffer())
                ids = list(matrix.documents())
                starts = np.concatenate([[0], matrix.ends[:-1]]) if len(matrix.ends) else matrix.ends
                columns = [
                    pa.array(np.full(len(ids), here, np.int32)), pa.array(np.full(len(ids), shard, np.int32)), pa.array(matrix.names, pa.int64()), pa.array(starts, pa.int64()),
                    pa.array(np.diff(np.concatenate([[0], matrix.ends])), pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                ]
                names = ["__range", "__shard", "__id", "__at", "__n_tokens", "__crc32"]
                if with_ids:
                    columns.append(pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))
                    names.append("__ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    if manifest.isEmpty():
        return spark.createDataFrame([], "__id long, __start long, __n_tokens long, __crc32 long" + extra)
    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    rows = shared.in_batches(files, read, "__range int, __shard int, __id long, __at long, __n_tokens long, __crc32 long" + extra)
    # Ranges are few; files are added up within each of them.
    ranges = manifest.groupBy("__range").agg(F.sum("__tokens").alias("__in_range"))
    before = ranges.select("__range", (F.sum("__in_range").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__in_range")).alias("__before"))
    inside = Window.partitionBy("__range").orderBy("__shard").rowsBetween(Window.unboundedPreceding, 0)
    bases = manifest.join(before, "__range").select("__range", "__shard", (F.col("__before") + F.sum("__tokens").over(inside) - F.col("__tokens")).alias("__base"))
    return rows.join(bases, ["__range", "__shard"]).select("__id", (F.col("__base") + F.col("__at")).alias("__start"), "__n_tokens", "__crc32", *(["__ids"] if with_ids else []))
