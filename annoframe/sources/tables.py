"""Saved tables, named tables with splits, shard folders.

A table that is replaced is written beside the old one, and one small file says which
of them counts. Whoever reads it sees the old table until the new one is whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


#: The file that names the folder of the table that counts, and what such folders begin with. Spark skips both.
POINTER = "_current"
SNAPSHOT = "_snapshot-"


def _files(spark: SparkSession, path: str):
    """The Hadoop path, its file system, and what makes paths."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    root = make(path)
    return root, root.getFileSystem(spark._jsc.hadoopConfiguration()), make


def current_path(spark: SparkSession, path: str) -> str:
    """The folder that holds the table now: a snapshot if there is one, else ``path`` itself."""
    root, files, make = _files(spark, path)
    pointer = make(root, POINTER)
    if not files.exists(pointer):
        return path
    stream = files.open(pointer)
    name = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return f"{path.rstrip('/')}/{name}"


def read_table(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """A saved table, the newest snapshot of one that was replaced; a given schema saves the footer read."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(current_path(spark, path))


def read_split(
    spark: SparkSession, name: str, split: str | None = None, configuration: str | None = None,
    split_column: str = "split",
) -> DataFrame:
    """A named catalog table, or one split of it; the split predicate prunes partitions."""
    table = spark.read.table(f"{configuration or 'default'}.{name}")
    return table if split is None else only_split(table, split, split_column)


def only_split(table: DataFrame, split: str, split_column: str = "split") -> DataFrame:
    return table.where(F.col(split_column) == F.lit(split))


def leading_splits(table: DataFrame, name_part: str | Sequence[str] | None, split_column: str = "split") -> DataFrame:
    """The splits whose name contains ``name_part``, or one of several; every split if it is None."""
    if name_part is None:
        return table
    parts = [name_part] if isinstance(name_part, str) else list(name_part)
    return table.where(reduce(Column.__or__, [F.col(split_column).contains(part) for part in parts], F.lit(False)))


def read_shards(spark: SparkSession, root: str, name_part: str = "stage8") -> DataFrame:
    """All sub-folders of ``root`` whose name contains ``name_part``, read as one table."""
    return spark.read.parquet(f"{root.rstrip('/')}/*{name_part}*")


def _point_to(spark: SparkSession, path: str, name: str) -> None:
    """Let ``name`` count from now on; what counted before goes afterwards, but for the snapshot just replaced."""
    root, files, make = _files(spark, path)
    pointer, fresh = make(root, POINTER), make(root, f"{POINTER}-{uuid.uuid4().hex}")
    before = current_path(spark, path)
    out = files.create(fresh, True)
    out.write(bytearray(name.encode()))
    out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(root.toUri(), spark._jsc.hadoopConfiguration())
    overwrite = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = overwrite
    context.rename(files.makeQualified(fresh), files.makeQualified(pointer), options)
    kept = {POINTER, name, before.rsplit("/", 1)[1] if SNAPSHOT in before else name}
    for status in files.listStatus(root):
        if status.getPath().getName() not in kept:
            files.delete(status.getPath(), True)


def save_table(
    df: DataFrame, path: str, overwrite: bool = False, partition_by: tuple[str, ...] = (), expect: int | None = None,
) -> None:
    """Save; an existing folder is an error unless it is to be replaced.

    A replaced table is written beside the old one, which stays readable until the new one is
    whole; a write that fails leaves it as it was. The table may thus be replaced by one
    that is made from it. Read it with :func:`read_table`. ``expect`` is the number of rows
    there must be; rows are counted as they are written, and a new table of another number is
    an error and doesn't replace the old one.
    """
    spark = df.sparkSession
    root, files, _ = _files(spark, path)
    replaces = overwrite and files.exists(root)
    target = f"{path.rstrip('/')}/{SNAPSHOT}{uuid.uuid4().hex}" if replaces else path
    seen = Observation() if expect is not None else None
    rows = df if seen is None else df.observe(seen, F.count(F.lit(1)).alias("rows"))
    writer = rows.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(target)
    if seen is not None and seen.get["rows"] != expect:
        raise ValueError(f"{seen.get['rows']} rows written, {expect} expected: {target}")
    if replaces:
        _point_to(spark, path, target.rsplit("/", 1)[1])


def publish(df: DataFrame, name: str, configuration: str | None = None, split_column: str | None = None) -> None:
    """Save under a catalog name, with the configuration as the database."""
    database = configuration or "default"
    df.sparkSession.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    writer = df.write.mode("overwrite")
    if split_column is not None:
        writer = writer.partitionBy(split_column)
    writer.saveAsTable(f"`{database}`.`{name}`")
